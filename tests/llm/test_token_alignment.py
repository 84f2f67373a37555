"""Alignment and counts of two tokenizers against plain loops over all tokens."""

import hashlib
import random
from collections import Counter
from pathlib import Path

import pytest

from pageloom.llm import token_alignment as t

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def both():
    return t.Tokenizers(Path(t.BYTE_FILE).read_text("utf-8"), Path(t.PIECE_FILE).read_bytes())


def plain(a, b, ends_a, ends_b):
    """(groups text, links) token by token, by byte."""
    groups, links = [], []
    for end in sorted(set(ends_a) & set(ends_b)):
        start = max((e for e in set(ends_a) & set(ends_b) if e < end), default=0)
        groups.append("|".join(",".join(str(i) for i, e in zip(ids, ends) if start < e <= end) for ids, ends in ((a, ends_a), (b, ends_b))))
    starts_a, starts_b = [0, *ends_a[:-1]], [0, *ends_b[:-1]]
    for i, x, y in zip(a, starts_a, ends_a):
        links += [(i, j) for j, u, v in zip(b, starts_b, ends_b) if u < y and x < v]
    return ";".join(groups), links


def test_groups_of_made_ends():
    rng = random.Random(1)
    for _ in range(2000):
        n = rng.randrange(1, 40)
        a = sorted({*rng.sample(range(1, n + 1), rng.randrange(0, n + 1)), n})
        b = a[:] if rng.random() < 0.2 else sorted({*rng.sample(range(1, n + 1), rng.randrange(0, n + 1)), n, *rng.sample(a, len(a) // 2)})
        ids_a, ids_b = [rng.randrange(9) for _ in a], [rng.randrange(9) for _ in b]
        count, text, links = t.aligned(ids_a, ids_b, a, b)
        want, pairs = plain(ids_a, ids_b, a, b)
        assert (text, count) == (want, want.count(";") + 1)
        assert Counter(links) == Counter(x << 16 | y for x, y in pairs)


def test_a_long_diagonal_is_jumped():
    class Counted(list):
        looked = 0

        def __getitem__(self, k):
            Counted.looked += 1
            return list.__getitem__(self, k)

    ends, ids = Counted(range(1, 100_001)), [7] * 100_000
    n, text, links = t.aligned(ids, ids, ends, Counted(ends))
    assert n == 100_000 and text == ";".join(["7|7"] * n) and links == [7 << 16 | 7] * n
    assert Counted.looked < 100


def test_both_engines_of_the_first_tokenizer_agree(both):
    rng = random.Random(0)
    made = ["".join(rng.choice("ab  \n\t.,1 é日\U0001f600\u0301\u180e\u200b\x85'sre") for _ in range(rng.randrange(60))) for _ in range(5000)]
    made += [f"a{chr(c)}b {chr(c)}{chr(c)} 1{chr(c)}.{chr(c)} {chr(c)}" for c in range(1, 0x10000) if not 0xD800 <= c <= 0xDFFF]
    for text, found in zip(made, both.a.encode_batch_fast(made, add_special_tokens=False)):
        assert both.fast_a.encode_ordinary(text) == found.ids, text


TEXTS = ["", None, " ", "a", "The cat.", "  two  blanks ", "▁ sign", "<|endoftext|> and </s> <0x41>", "é\U0001f600 ñandú 日本語\n\n\ttab", "\x00 null", " " * 3000, "word " * 30_000, "a" * 100_000, "The cat."]


def expected(both, rows):
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) by plain counting."""
    done = {}
    for doc_id, text in rows:
        tokens = next(iter(both.encode([text]))) if text else None
        done[doc_id] = tokens and (tokens, *plain_fast(*tokens))
    total = Counter(p for x in done.values() if x for p in x[2])
    most = Counter()
    for (_, b), n in total.items():
        most[b] = max(most[b], n)
    return {
        d: (0, 0, 0, 0, 0, 0, "") if x is None else (len(x[0][0]), len(x[0][1]), x[1].count(";") + 1, len(x[2]), sum(total[p] == most[p[1]] for p in x[2]), sum(total[p] for p in x[2]), x[1])
        for d, x in done.items()
    }


def plain_fast(a, b, ends_a, ends_b):
    """As ``plain``, going through the tokens of B once."""
    common = sorted(set(ends_a) & set(ends_b))
    ga, gb = [[] for _ in common], [[] for _ in common]
    for ids, ends, out in ((a, ends_a, ga), (b, ends_b, gb)):
        k = 0
        for i, e in zip(ids, ends):
            while common[k] < e:
                k += 1
            out[k].append(str(i))
    links, first = [], 0
    for i, x, y in zip(a, [0, *ends_a[:-1]], ends_a):
        while ends_b[first] <= x:
            first += 1
        k = first
        while k < len(b) and (ends_b[k - 1] if k else 0) < y:
            links.append((i, b[k]))
            k += 1
    return ";".join(f"{','.join(x)}|{','.join(y)}" for x, y in zip(ga, gb)), links


def test_edge_texts(spark, both):
    rows = [(k, x) for k, x in enumerate(TEXTS)]
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, n_a int, links string, pair int").repartition(3)
    got = {r["doc_id"]: (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups"]) for r in t.align_corpus(docs).collect()}
    assert got == expected(both, rows)
    assert got[0][0] == got[1][0] == got[6][0] == 0 and got[2][0] > 0 and got[4] == got[13]
    assert t.align_corpus(docs.limit(0)).count() == 0
    twice = docs.unionByName(docs.selectExpr("CAST(NULL AS LONG) doc_id", "text", "n_a", "links", "pair"))
    assert t.align_corpus(twice).count() == 2 * len(rows)


def test_counts_in_small_parts(spark, both):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(40).collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    held = t.HELD_LINKS, t.HELD_PAIRS, t.LOOKED_UP
    t.HELD_LINKS, t.HELD_PAIRS, t.LOOKED_UP = 500, 300, 700
    try:
        got = {r["doc_id"]: tuple(r)[1:] for r in t.align_corpus(docs, part_pairs=1000).collect()}
    finally:
        t.HELD_LINKS, t.HELD_PAIRS, t.LOOKED_UP = held
    assert got == expected(both, rows)


def test_query(spark, both):
    import __spark_entry__ as driver

    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: tuple(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in driver.queries()["op12_token_alignment"](spark, SF).collect()}
    assert got == {d: (*x[:-1], hashlib.sha256(x[-1].encode()).hexdigest() if x[0] else "") for d, x in expected(both, rows).items()}
