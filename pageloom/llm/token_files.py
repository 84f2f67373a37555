"""Token counts by a separator scan of flat token files.

A token file is a run of little-endian integers, nothing else: documents one
after the other, each followed by the end-of-document id. There is no index, so
``count_tokens`` cuts the files into blocks of equal length, finds the
separators of a block with one vectorised comparison, and stitches documents
that cross blocks with a prefix scan over the blocks' summaries.
"""

from __future__ import annotations

import base64
import re
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pageloom.session import scratch_path, staged

# The pattern that splits a text before the merges of the rank files.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

RANKS_FILE = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
END_OF_DOCUMENT = 50256
FILE_BYTES = 32 << 20
BLOCK_TOKENS = 1 << 20
#: Blocks whose summaries one window task scans.
SCAN_BLOCKS = 4096


#: Runs of white space from this length on go past the splitter, which keeps a place on the stack for every sign of a run.
LONG_BLANK = 50_000
_BLANK = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def encode_text(encoding, text: str, long_blank: int = LONG_BLANK) -> list[int]:
    """The ids of a text, also where white space runs on very long.

    The splitter takes such a run as one piece, but for its last sign when something follows, which begins the next one. So the run is
    merged as the piece it is, and the rest is encoded by itself.
    """
    if len(text) < long_blank:
        return encoding.encode_ordinary(text)
    ids, at = [], 0
    for run in re.finditer(rf"{_BLANK}{{{long_blank},}}", text):
        end = run.end() - (run.end() < len(text))
        ids += encoding.encode_ordinary(text[at : run.start()])
        ids += encoding._encode_single_piece(text[run.start() : end])
        at = end
    return ids + encoding.encode_ordinary(text[at:])


def _open_fs(path: str):
    """The file system of a URI or local path, and the path inside it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1) if "://" in path else f"file://{path}" if path.startswith("/") else path.replace("file:/", "file:///", 1))


def write_token_files(
    docs: DataFrame,
    path: str,
    ranks_file: str = RANKS_FILE,
    end_id: int = END_OF_DOCUMENT,
    file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Tokenise ``docs(doc_id, text)`` into flat files of 16-bit ids under ``path``.

    Returns the manifest (file, ordinal, doc_id): which document stands where.
    A file gets a name of its own at every attempt, so a task that runs again
    leaves files which no manifest names. NULL and empty texts have no token, only the
    separator. Rows that repeat are written again; other columns are ignored.
    The rank file is read by the driver (under 1 MB) and sent to the tasks.
    """
    ranks_text = Path(ranks_file).read_bytes()

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_text.splitlines())}
        encoding = tiktoken.Encoding("ranks", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})
        system, root = _open_fs(path)
        system.create_dir(root, recursive=True)
        out, name, ids, size = None, "", [], 0

        def ended() -> pd.DataFrame:
            out.close()
            return pd.DataFrame({"file": name, "ordinal": np.arange(len(ids)), "doc_id": pd.array(ids, dtype="Int64"), "bytes": size})

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].astype("Int64"), batch["text"]):
                if out is None:
                    name, ids, size = f"{uuid.uuid4().hex}.bin", [], 0
                    out = system.open_output_stream(f"{root}/{name}")
                tokens = np.array([*(encode_text(encoding, text) if text else ()), end_id], dtype="<u2").tobytes()
                out.write(tokens)
                ids.append(doc_id)
                size += len(tokens)
                if size >= file_bytes:
                    yield ended()
                    out = None
        if out is not None:
            yield ended()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(write, "file string, ordinal long, doc_id long, bytes long")


def block_separators(spark: SparkSession, path: str, files: DataFrame, end_id: int, dtype: str, block_tokens: int) -> DataFrame:
    """(file, block, n, seps): tokens of each block of ``files(file, bytes)`` and where its separators are, counted from the file's start."""
    item = np.dtype(dtype).itemsize
    blocks = files.select(
        "file",
        F.col("bytes").cast("long").alias("bytes"),
        F.explode(F.expr(f"sequence(0L, (bytes + {item * block_tokens - 1}L) div {item * block_tokens}L - 1)")).alias("block"),
    ).where("block >= 0 AND bytes > 0")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = _open_fs(path)
        for batch in batches:
            for name, size, block in batch.itertuples(index=False):
                if size % item:
                    raise ValueError(f"{name}: {size} bytes are no whole number of {item}-byte ids")
                with system.open_input_file(f"{root}/{name}") as source:
                    start = block * block_tokens
                    data = source.read_at(min(item * block_tokens, size - item * start), item * start)
                tokens = np.frombuffer(data, dtype=dtype)
                yield pd.DataFrame({"file": [name], "block": [block], "n": [len(tokens)], "seps": [np.flatnonzero(tokens == end_id) + start]})

    # Blocks are cheap rows and dear tasks: deal them out by name and number, in a fixed number of parts.
    n = files.select(F.sum(F.ceil(F.col("bytes") / (item * block_tokens)))).first()[0] or 1
    return blocks.repartition(max(1, min(int(n), 20_000)), "file", "block").mapInPandas(scan, "file string, block long, n long, seps array<long>")


def count_tokens(
    spark: SparkSession,
    path: str,
    files: DataFrame,
    end_id: int = END_OF_DOCUMENT,
    dtype: str = "<u2",
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """(file, ordinal, start, n_tokens) of every document in the flat ``files(file, bytes)`` under ``path``.

    Two neighbouring separators enclose an empty document. Tokens after the last
    separator are a last, open document; nothing after it is none. An empty
    file has no document, a file named twice counts once. The number of documents before a block is a
    prefix sum over the blocks, the start of the document that a block ends
    first is a prefix maximum of separators; both are scanned inside runs of
    ``SCAN_BLOCKS`` blocks and then over the runs, so no task sees all blocks of a huge file.
    """
    files = files.groupBy("file").agg(F.max("bytes").alias("bytes"))
    blocks = staged(block_separators(spark, path, files, end_id, dtype, block_tokens), "token-blocks")
    known = blocks.select("file", "block", "n", F.expr(f"block div {SCAN_BLOCKS}").alias("run"), F.size("seps").alias("docs"), F.coalesce(F.array_max("seps"), F.lit(-1)).alias("last"))
    inside = Window.partitionBy("file", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("file").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = known.groupBy("file", "run").agg(F.sum("docs").alias("run_docs"), F.max("last").alias("run_last"))
    runs = runs.select("file", "run", F.coalesce(F.sum("run_docs").over(before), F.lit(0)).alias("docs_0"), F.coalesce(F.max("run_last").over(before), F.lit(-1)).alias("last_0"))
    known = known.withColumns({"docs_1": F.coalesce(F.sum("docs").over(inside), F.lit(0)), "last_1": F.coalesce(F.max("last").over(inside), F.lit(-1))})
    carried = known.join(runs, ["file", "run"]).select("file", "block", (F.col("docs_0") + F.col("docs_1")).alias("first"), F.greatest("last_0", "last_1").alias("carry"))
    closed = (
        blocks.join(carried, ["file", "block"])
        .select("file", "first", F.expr("concat(array(carry), seps)").alias("cuts"), F.posexplode("seps").alias("i", "sep"))
        .select("file", (F.col("first") + F.col("i")).alias("ordinal"), (F.expr("element_at(cuts, i + 1)") + 1).alias("start"), F.col("sep").alias("stop"))
    )
    open_end = (
        blocks.groupBy("file")
        .agg(F.sum("n").alias("stop"), F.sum(F.size("seps")).cast("long").alias("ordinal"), (F.coalesce(F.max(F.array_max("seps")), F.lit(-1)) + 1).alias("start"))
        .where("stop > start")
        .select("file", "ordinal", "start", "stop")
    )
    return closed.unionByName(open_end).select("file", F.col("ordinal").cast("long").alias("ordinal"), "start", (F.col("stop") - F.col("start")).alias("n_tokens"))


def corpus_token_counts(docs: DataFrame, ranks_file: str = RANKS_FILE, file_bytes: int = FILE_BYTES, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(doc_id, n_tokens) of ``docs(doc_id, text)``: token files are written to the shared folder, then scanned."""
    spark = docs.sparkSession
    path = scratch_path(spark, "token-files")
    manifest = staged(write_token_files(docs, path, ranks_file, file_bytes=file_bytes), "token-manifest")
    counts = count_tokens(spark, path, manifest.groupBy("file").agg(F.max("bytes").alias("bytes")), block_tokens=block_tokens)
    return manifest.join(counts, ["file", "ordinal"]).select("doc_id", "n_tokens")
