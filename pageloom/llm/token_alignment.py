"""Alignment of two tokenizers over a corpus by diagonal run skipping.

Both tokenizers cut the same bytes. Places where a token of each ends cut a text into groups. Most groups are one token against one, and as long as
they are, the two arrays of end offsets are equal along a diagonal: from the current places (i, j), whose difference is the shift, runs of 1, 2, 4, 8 ...
ends are compared at once and jumped over; a run that differs somewhere is halved down to its first difference. An irregular group
is resolved there by walking both arrays to the next common end, which gives the new shift.

Links are all pairs of tokens whose byte ranges overlap. How often the corpus links a pair of ids is counted inside the tasks and added up; the
counts come back to the texts in parts of at most ``PART_PAIRS`` pairs, so what is broadcast has a bound, and a vocabulary that
needs more parts costs more passes over the links, not more memory.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import accumulate
from operator import or_
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm.token_files import SPLIT_PATTERN
from pageloom.session import staged

BYTE_FILE = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_FILE = "/opt/tokenizers/piece_bpe_32k.model"
#: Pairs of one broadcast: 12 bytes each.
PART_PAIRS = 1 << 22
#: Links that a task holds before it adds them up, distinct pairs it holds before it sends them on.
HELD_LINKS, HELD_PAIRS = 1 << 20, 1 << 21
#: Links that a task looks up at once.
LOOKED_UP = 1 << 20
#: Texts tokenised at once: no more rows, and no more characters unless one text has more.
BATCH_ROWS, BATCH_CHARS = 256, 1 << 20
#: Runs without or of white space that one step of the splitter or of the merges would take whole.
LONG_RUN = 2000
_LONG_BLANK = re.compile(rf"\s{{{LONG_RUN}}}")


#: Ids as text, and as the high half of a link; both vocabularies have fewer than 2 ** 16.
_DIGITS = list(map(str, range(1 << 16))).__getitem__
_HIGH = [k << 16 for k in range(1 << 16)].__getitem__


def aligned(ids_a: list[int], ids_b: list[int], a: list[int], b: list[int]) -> tuple[int, str, list[int]]:
    """(number of groups, their text, links as a << 16 | b) from ids and their ascending end offsets, which agree at the last.

    A token without bytes cannot occur: every id stands for one byte or more.
    """
    n, parts, links = 0, [], []
    text_a, text_b = list(map(_DIGITS, ids_a)), list(map(_DIGITS, ids_b))
    high, link = list(map(_HIGH, ids_a)), links.append
    i, j, last = 0, 0, len(a)
    while i < last:
        if a[i] == b[j]:
            # One to one: probe along the diagonal with steps that double.
            start, step = i, 2
            i, j = i + 1, j + 1
            while i < last and a[i : i + step] == b[j : j + step]:
                i, j, step = i + step, j + step, 2 * step
            if i < last:
                # The first difference lies in the last step: halve it.
                while step > 1:
                    step //= 2
                    if a[i : i + step] == b[j : j + step]:
                        i, j = i + step, j + step
            else:
                i, j = last, len(b)
            n += i - start
            first = j - (i - start)
            parts.extend(map("|".join, zip(text_a[start:i], text_b[first:j])))
            links.extend(map(or_, high[start:i], ids_b[first:j]))
            if i >= last:
                break
        # Irregular: walk to the next common end, which is the new diagonal. Ranges interleave, each step ends one of the two.
        p, q = i, j
        x, y = a[p], b[q]
        link(high[p] | ids_b[q])
        while x != y:
            if x < y:
                p += 1
                x = a[p]
            else:
                q += 1
                y = b[q]
            link(high[p] | ids_b[q])
        n += 1
        parts.append(f"{','.join(text_a[i : p + 1])}|{','.join(text_b[j : q + 1])}")
        i, j = p + 1, q + 1
    return n, ";".join(parts), links


def _byte_values() -> dict[str, int]:
    """The byte behind each sign of a byte-level vocabulary: printable bytes stand for themselves, the others for U+0100 and up, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [k for k in range(256) if k not in set(plain)]
    return {chr(k): k for k in plain} | {chr(256 + k): byte for k, byte in enumerate(rest)}


class Tokenizers:
    """Two tokenizers from the contents of their files, with the bytes of every id."""

    def __init__(self, byte_json: str, piece_model: bytes):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(byte_json)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        value = _byte_values()
        special = {token.content for token in self.a.get_added_tokens_decoder().values()}
        bytes_a = [b""] * self.a.get_vocab_size()
        for token, k in self.a.get_vocab(with_added_tokens=False).items():
            if token not in special:
                bytes_a[k] = bytes(map(value.__getitem__, token))
        # The same vocabulary in an engine that is four times as fast: ids are the ranks of its merges.
        ranks = {token: k for k, token in enumerate(bytes_a) if token}
        self.fast_a = tiktoken.Encoding("byte-level", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})
        bytes_b = []
        for k in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(k)
            bytes_b.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(k) else piece.replace("▁", " ").encode())
        # Looked up by id: the bytes of B's pieces, the sizes of both.
        self.bytes_b = bytes_b.__getitem__
        self.size_a, self.size_b = list(map(len, bytes_a)).__getitem__, list(map(len, bytes_b)).__getitem__

    def ids_a(self, text: str) -> list[int]:
        """A's ids. Runs that the fast engine needs too long or too much stack for go through the other one."""
        if len(text) >= LONG_RUN and (_LONG_BLANK.search(text) or max(map(len, text.split()), default=0) >= LONG_RUN):
            return self.a.encode(text, add_special_tokens=False).ids
        return self.fast_a.encode_ordinary(text)

    def encode(self, texts: list[str]) -> Iterator[tuple[list[int], list[int], list[int], list[int]] | None]:
        """(ids of A, ids of B, ends of A, ends of B) of each text; None where the joined bytes are not those of the text behind a space."""
        for text, b in zip(texts, self.b.encode(texts, num_threads=1)):
            spaced = " " + text
            data, a = spaced.encode("utf-8"), self.ids_a(spaced)
            # A merges the very bytes of the text, so its tokens are these bytes if none is missing; B may normalise.
            ends = list(accumulate(map(self.size_a, a)))
            if ends[-1] != len(data) or b"".join(map(self.bytes_b, b)) != data:
                yield None
            else:
                yield a, b, ends, list(accumulate(map(self.size_b, b)))


@cache
def _tokenizers(byte_json: str, piece_model: bytes) -> Tokenizers:
    return Tokenizers(byte_json, piece_model)


def _portions(texts: list) -> Iterator[tuple[int, int]]:
    """Ranges of at most BATCH_ROWS texts and about BATCH_CHARS characters."""
    start = size = 0
    for k, text in enumerate(texts):
        if k > start and (k - start >= BATCH_ROWS or size + len(text or "") > BATCH_CHARS):
            yield start, k
            start, size = k, 0
        size += len(text or "")
    if texts:
        yield start, len(texts)


_ALIGNED = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups", pa.string()), ("links", pa.binary())])


def align(docs: DataFrame, byte_file: str = BYTE_FILE, piece_file: str = PIECE_FILE, digest: bool = False) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups, links) of each row of ``docs(doc_id, text)``.

    ``groups`` is ``a1,a2|b1;a3|b2,b3``, with ``digest`` its SHA-256 in hex; ``links`` holds a little-endian 32-bit a << 16 | b for each link. A text that is
    NULL or empty, or whose joined tokens are not its bytes behind a space, has no tokens: zeros, '' and no links. Rows that repeat are rows; an empty table gives an
    empty result; other columns are ignored. Both vocabulary files (under 5 MB) are read by the driver and sent to the tasks.
    """
    shared = docs.sparkSession.sparkContext.broadcast((Path(byte_file).read_text("utf-8"), Path(piece_file).read_bytes()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the cores already
        both = _tokenizers(*shared.value)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi in _portions(texts):
                usable = [k for k in range(lo, hi) if texts[k]]
                found = dict(zip(usable, both.encode([texts[k] for k in usable])))
                rows = []
                for k in range(lo, hi):
                    tokens = found.get(k)
                    if tokens is None:
                        rows.append((ids[k], 0, 0, 0, 0, "", b""))
                        continue
                    n, text, links = aligned(*tokens)
                    text = hashlib.sha256(text.encode()).hexdigest() if digest else text
                    rows.append((ids[k], len(tokens[0]), len(tokens[1]), n, len(links), text, array("I", links).tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ALIGNED.types)], schema=_ALIGNED)

    ddl = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, links binary"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ddl)


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with their summed counts."""
    all_keys, all_counts = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(all_keys, kind="stable")
    all_keys, all_counts = all_keys[order], all_counts[order]
    first = np.flatnonzero(np.concatenate(([True], all_keys[1:] != all_keys[:-1])))
    return all_keys[first], np.add.reduceat(all_counts, first)


def pair_counts(aligned_docs: DataFrame) -> DataFrame:
    """(pair, n, best) of all links: how often the corpus links the pair of ids, and whether no pair with the same id of B is more frequent.

    Tasks add up what they see before they send it on, a bounded number of pairs at a time.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held, waiting, n_waiting = [], [], 0, [], 0

        def settle():
            nonlocal keys, counts, held, waiting, n_waiting
            if waiting:
                distinct, n = np.unique(np.concatenate(waiting), return_counts=True)
                merged = _merged([*keys, distinct], [*counts, n])
                keys, counts, held, waiting, n_waiting = [merged[0]], [merged[1]], len(merged[0]), [], 0

        def sent():
            return pa.RecordBatch.from_arrays([pa.array(keys[0].astype(np.int64)), pa.array(counts[0].astype(np.int64))], names=["pair", "n"])

        for batch in batches:
            for cell in batch.column(0):
                waiting.append(np.frombuffer(cell.as_buffer(), dtype="<u4").copy())
                n_waiting += len(waiting[-1])
                if n_waiting >= HELD_LINKS:
                    settle()
                    if held >= HELD_PAIRS:
                        yield sent()
                        keys, counts, held = [], [], 0
        settle()
        if held:
            yield sent()

    counted = aligned_docs.where("n_links > 0").select("links").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counted = staged(counted, "pair-counts")
    # An id of B: its 16 low bits. There are as many maxima as ids, so they are broadcast.
    most = counted.groupBy(F.col("pair").bitwiseAND(F.lit(0xFFFF)).alias("b")).agg(F.max("n").alias("most"))
    return counted.join(F.broadcast(most), F.col("pair").bitwiseAND(F.lit(0xFFFF)) == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _parts(spark: SparkSession, counts: DataFrame, part_pairs: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The counts in parts of at most ``part_pairs`` pairs by range of the pair, in order: (pairs, counts, best)."""
    # Pairs are 32-bit numbers; 4,096 ranges of the id of B and a running sum of their sizes say where to cut.
    slot = F.col("pair").bitwiseAND(F.lit(0xFFFF))
    sizes = {r["slot"]: r["n"] for r in counts.groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("n")).collect()}
    start, held = 0, 0
    bounds = []
    for k in sorted(sizes):
        if held and held + sizes[k] > part_pairs:
            bounds.append((start, k))
            start, held = k, 0
        held += sizes[k]
    if sizes:
        bounds.append((start, 1 << 16))
    for lo, hi in bounds:
        part = counts.where((slot >= lo) & (slot < hi)).toArrow()
        pairs = part.column("pair").to_numpy().astype(np.uint32)
        order = np.argsort(pairs)
        yield pairs[order], part.column("n").to_numpy()[order], np.asarray(part.column("best").to_pylist(), dtype=bool)[order]


def count_links(aligned_docs: DataFrame, counts: DataFrame, part_pairs: int = PART_PAIRS) -> DataFrame:
    """``aligned_docs`` without links, with n_best and count_sum: links whose count is the highest of their id of B, and the sum of counts.

    One pass over the rows for all parts: each part is looked up for many rows at once, what it does not hold adds nothing.
    """
    spark = aligned_docs.sparkSession
    shared = [spark.sparkContext.broadcast(part) for part in _parts(spark, counts, part_pairs)]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answer(rows: pa.RecordBatch) -> pa.RecordBatch:
            cells = [np.frombuffer(c.as_buffer(), dtype="<u4") for c in rows.column("links")]
            ends = np.cumsum([0, *(len(c) for c in cells)])
            links = np.concatenate(cells) if cells else np.empty(0, dtype="<u4")
            distinct, back = np.unique(links, return_inverse=True)
            value, best = np.zeros(len(distinct), dtype=np.int64), np.zeros(len(distinct), dtype=bool)
            for part in shared:
                pairs, n, is_best = part.value
                if len(pairs) and len(distinct):
                    at = np.minimum(np.searchsorted(pairs, distinct), len(pairs) - 1)
                    hit = pairs[at] == distinct
                    value[hit], best[hit] = n[at[hit]], is_best[at[hit]]
            n_best, total = (np.diff(np.concatenate(([0], np.cumsum(found[back], dtype=np.int64)))[ends]) for found in (best, value))
            arrays = [rows.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
            return pa.RecordBatch.from_arrays([*arrays, pa.array(n_best), pa.array(total), rows.column("groups")], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"])

        for batch in batches:
            lo = size = 0
            for k, n in enumerate(batch.column("n_links").to_pylist()):
                if k > lo and size + n > LOOKED_UP:
                    yield answer(batch.slice(lo, k - lo))
                    lo, size = k, 0
                size += n
            if batch.num_rows:
                yield answer(batch.slice(lo))

    ddl = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
    return aligned_docs.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "links").mapInArrow(look_up, ddl)


def align_corpus(docs: DataFrame, byte_file: str = BYTE_FILE, piece_file: str = PIECE_FILE, digest: bool = False, part_pairs: int = PART_PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of each row of ``docs(doc_id, text)``; see ``align`` and ``count_links``.

    Tokens are made once: alignments and links are a table in the shared folder that both the counting and the looking up read.
    """
    done = staged(align(docs, byte_file, piece_file, digest), "alignments")
    return count_links(done, staged(pair_counts(done), "best-pairs"), part_pairs)

