import base64

import numpy as np
import tiktoken

from pageloom.llm import token_files as t
from pageloom.session import scratch_path, staged


def encoder():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(t.RANKS_FILE, "rb"))}
    return tiktoken.Encoding("x", pat_str=t.SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def test_counts_are_those_of_each_text(spark, documents):
    encode = encoder()
    docs = documents.where("doc_id < 300")
    expected = sorted((r["doc_id"], len(encode(r["text"]))) for r in docs.collect())
    got = t.corpus_token_counts(docs, file_bytes=50_000, block_tokens=257)
    assert sorted(map(tuple, got.collect())) == expected


def test_edges(spark, edge_docs, no_docs):
    encode = encoder()
    expected = [(r["doc_id"], len(encode(r["text"] or ""))) for r in edge_docs.collect()]
    got = t.corpus_token_counts(edge_docs, file_bytes=64, block_tokens=5000)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(expected, key=repr)
    assert t.corpus_token_counts(no_docs).collect() == []


def test_any_blocks_and_open_ends(spark, monkeypatch):
    monkeypatch.setattr(t, "SCAN_BLOCKS", 3)
    path = scratch_path(spark, "flat").removeprefix("file:")
    files = {"a": [9, 1, 2, 9, 9, 3], "b": [9], "c": [1, 2, 3, 4, 5, 6, 7, 8], "d": [], "e": [1, 9] * 20}
    import os

    os.makedirs(path)
    for name, tokens in files.items():
        np.array(tokens, dtype="<u4").tofile(f"{path}/{name}")
    table = spark.createDataFrame([(k, 4 * len(v)) for k, v in files.items()] + [("a", 24)], "file string, bytes long")
    expected = []
    for name, tokens in files.items():
        start, ordinal = 0, 0
        for k, x in enumerate(tokens):
            if x == 9:
                expected.append((name, ordinal, start, k - start))
                start, ordinal = k + 1, ordinal + 1
        if start < len(tokens):
            expected.append((name, ordinal, start, len(tokens) - start))
    for block in (1, 2, 5, 100):
        got = t.count_tokens(spark, path, table, end_id=9, dtype="<u4", block_tokens=block)
        assert sorted(map(tuple, got.collect())) == sorted(expected), block


def test_a_lost_attempt_leaves_only_files_without_a_name(spark, edge_docs):
    path = scratch_path(spark, "files")
    t.write_token_files(edge_docs, path).collect()
    manifest = staged(t.write_token_files(edge_docs, path), "manifest")
    got = t.count_tokens(spark, path, manifest.select("file", "bytes").distinct())
    assert got.count() == edge_docs.count()


def test_very_long_runs_of_blanks(spark):
    """One run of two million blanks; short runs give what the splitter gives; bounded by the encoder where it can take them."""
    import random

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(t.RANKS_FILE, "rb"))}
    encoding = tiktoken.Encoding("x", pat_str=t.SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    for _ in range(20_000):
        text = "".join(rng.choice(["a", "  ", " ", "\n", "\t", "é", "1", ".", "\u3000", "\x85", "\x1c"]) for _ in range(rng.randrange(30)))
        assert t.encode_text(encoding, text, 3) == encoding.encode_ordinary(text), repr(text)
    texts = [" " * 2_000_000, "a" + " " * 2_000_000 + "b", "x " + "\n" * 1_000_000, " " * 60_000 + "\t" * 60_000 + "end", "word" * 100_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = dict(map(tuple, t.corpus_token_counts(docs).collect()))
    assert got == {k: len(t.encode_text(encoding, x)) for k, x in enumerate(texts)}
    assert b"".join(map(encoding.decode_single_token_bytes, t.encode_text(encoding, texts[1]))) == texts[1].encode()
