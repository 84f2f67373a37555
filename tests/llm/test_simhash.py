import random

import pytest
import xxhash

from pageloom.llm import simhash as s


def slow_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def classes(prints, radius):
    """Least id by id, over pairs of all distinct fingerprints."""
    by = {}
    for d, f in prints:
        by.setdefault(f, []).append(d)
    parent = {f: f for f in by}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = list(by)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (a ^ b).bit_count() <= radius:
                parent[root(a)] = root(b)
    least = {}
    for f, ids in by.items():
        known = [d for d in ids if d is not None]
        least[root(f)] = min([*known, *([least[root(f)]] if root(f) in least else [])], default=least.get(root(f)))
    return {f: least[root(f)] for f in by}


def unsigned(x):
    return x & ((1 << 64) - 1)


def test_whole_table(documents, texts):
    got = s.near_duplicates(documents).collect()
    assert {r["doc_id"]: unsigned(r["fp"]) for r in got} == {d: slow_fingerprint(t) for d, t in texts.items()}
    expected = classes([(r["doc_id"], unsigned(r["fp"])) for r in got], 4)
    assert all(r["component_id"] == expected[unsigned(r["fp"])] for r in got)


def test_edges(edge_docs, no_docs):
    got = s.near_duplicates(edge_docs).collect()
    assert sorted(((r["doc_id"], unsigned(r["fp"])) for r in got), key=repr) == sorted(((r["doc_id"], slow_fingerprint(r["text"])) for r in edge_docs.collect()), key=repr)
    blank = {r["doc_id"]: r["component_id"] for r in got}
    assert blank[2] == blank[3] == blank[4] == 2 and blank[7] == 1 and blank[5] == 5 and blank[None] is None
    assert s.near_duplicates(no_docs).count() == 0


@pytest.mark.parametrize("shard_rows, pieces", [(7, 5), (4096, 5), (50, 6), (50, 7)])
def test_links_connect_what_all_pairs_connect(spark, monkeypatch, shard_rows, pieces):
    """Hot groups: walks that drift by a few bits, so classes are long chains, in keys of many fingerprints."""
    monkeypatch.setattr(s, "pieces_for", lambda n, radius: pieces)
    random.seed(shard_rows + pieces)
    values = set()
    for _ in range(6):
        x = random.getrandbits(64)
        for _ in range(70):
            values.add(x)
            for _ in range(random.choice((1, 2, 4, 5, 6))):
                x ^= 1 << random.randrange(64)
    values |= {random.getrandbits(64) for _ in range(100)} | {0, (1 << 64) - 1}
    numbered = list(enumerate(sorted(values)))
    nodes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, d) for d, f in numbered], "fp long, label long")
    found = {unsigned(r["fp"]): r["label"] for r in s.components(nodes, s.links(nodes.select("fp"), 4, shard_rows)).collect()}
    expected = classes(numbered, 4)
    assert {f: found.get(f, d) for d, f in numbered} == expected


def test_tree_follows_only_edges_within_the_radius():
    random.seed(3)
    values = [random.getrandbits(12) for _ in range(300)]
    tree = s.BKTree()
    for v in values:
        tree.add(v)
    for q in values[:50]:
        assert sorted(tree.near(q, 3)) == sorted(v for v in set(values) if 0 < (v ^ q).bit_count() <= 3)


def test_no_more_links_than_connect():
    values = [1 << k for k in range(40)]
    assert len(s.spanning_links(values, values, 2)) == 39
