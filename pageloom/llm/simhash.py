"""Near-duplicates by SimHash, searched with BK-trees.

Fingerprints that differ in at most ``radius`` bits are linked, and a class is
what links connect. Two such fingerprints agree on at least
``blocks - radius`` of any ``blocks`` pieces of their bits, so fingerprints are filed under
every choice of that many pieces and meet those that they agree with; no link is lost. The fingerprints
filed under one key form a shard with a BK-tree of its own: a child hangs on its parent by their
integer Hamming distance d, and a search with radius r follows only the edges from d - r to d + r. A key with more
than ``shard_rows`` fingerprints is cut into shards of at most that size, and each shard's tree goes to the tasks that search it,
so trees have a size bound however hot a key is. A shard gives back
a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import join_classes
from pageloom.session import staged

BITS = 64
RADIUS = 4
SHINGLE = 4
SEED = 42
SHARD_ROWS = 4096
_MARK = np.uint64(1) << np.arange(63, -1, -1, dtype=np.uint64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The SimHash of a text: bit by bit the majority of the XXH64 of its word shingles, repeats included.

    A-Z are lower-cased; fewer words than a shingle are one shingle; a text without words, and NULL, has 0.
    """
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    set_bits = np.zeros(BITS, dtype=np.int64)
    for k in range(0, n, 65536):  # bounded memory for very long texts
        hashes = np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts[k : k + 65536], stops[k : k + 65536])), dtype=np.uint64)
        set_bits += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(_MARK[2 * set_bits > n].sum())


def fingerprints(text: Column, shingle: int = SHINGLE) -> Column:
    """``fingerprint`` as a column of signed longs."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64))

    return of(text)


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


class BKTree:
    """A BK-tree over unsigned integers under the Hamming distance."""

    def __init__(self):
        self.root = None

    def add(self, value: int) -> None:
        if self.root is None:
            self.root = (value, {})
            return
        parent, children = self.root
        while True:
            d = (parent ^ value).bit_count()
            if d == 0:
                return
            if d not in children:
                children[d] = (value, {})
                return
            parent, children = children[d]

    def near(self, value: int, radius: int) -> Iterator[int]:
        """Values at 1 to ``radius`` differing bits."""
        stack = [self.root] if self.root else []
        while stack:
            node, children = stack.pop()
            d = (node ^ value).bit_count()
            if 0 < d <= radius:
                yield node
            if children:
                for edge, child in children.items():
                    if d - radius <= edge <= d + radius:
                        stack.append(child)


def spanning_links(tree_values: list[int], queries: list[int], radius: int) -> list[tuple[int, int]]:
    """Links between queries and tree, as many as join what they connect; trees and queries may share values."""
    tree, parent, out = BKTree(), {}, []

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    same = tree_values == queries
    if not same:
        for value in tree_values:
            tree.add(value)
    for value in queries:
        for other in tree.near(value, radius):
            a, b = root(value), root(other)
            if a != b:
                parent[a] = b
                out.append((value, other))
        if same:  # each pair once: search, then hang in
            tree.add(value)
    return out


def pieces_for(n: int, radius: int = RADIUS) -> int:
    """How many pieces to cut fingerprints into: the least that leave about 32 of ``n`` under a key. Any number finds all links."""
    for pieces in range(radius + 1, radius + 5):
        if n >> (BITS * (pieces - radius) // pieces) <= 32:
            return pieces
    return radius + 4


def links(prints: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(a, b): links between the distinct fingerprints of ``prints(fp long)`` that connect every class."""
    pieces = pieces_for(prints.count(), radius)
    bounds = [BITS * k // pieces for k in range(pieces + 1)]
    keys = []
    for chosen in combinations(range(pieces), pieces - radius):
        mask = sum(((1 << (bounds[k + 1] - bounds[k])) - 1) << bounds[k] for k in chosen)
        keys.append(F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long")))
    filed = prints.select("fp", F.posexplode(F.array(*keys)).alias("piece", "key"))
    hot = filed.groupBy("piece", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("shards", F.ceil(F.col("n") / shard_rows).cast("int"))
    # Shard i of a key is searched by shard j >= i: one unit of work, one tree.
    met = filed.join(hot, ["piece", "key"]).withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("shards")).cast("int"))
    unit = met.select("piece", "key", "fp", "mine", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("other"))
    unit = unit.withColumns({"i": F.least("mine", "other"), "j": F.greatest("mine", "other")}).groupBy("piece", "key", "i", "j").agg(
        F.collect_list(F.when(F.col("mine") == F.col("i"), F.col("fp"))).alias("tree"),
        F.collect_list(F.when(F.col("mine") == F.col("j"), F.col("fp"))).alias("queries"),
    )

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        full = (1 << 64) - 1
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        for batch in batches:
            out = []
            for tree, queries in zip(batch["tree"], batch["queries"]):
                tree, queries = sorted(int(x) & full for x in tree), sorted(int(x) & full for x in queries)
                out += [(signed(a), signed(b)) for a, b in spanning_links(tree, queries, radius)]
            if out:
                yield pd.DataFrame(out, columns=["a", "b"])

    return unit.select("tree", "queries").mapInPandas(search, "a long, b long")


def components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(fp, label): for every node of ``nodes(fp, label)`` that has an edge, the least label that ``edges(a, b)`` reach.

    Alternates large-star and small-star steps on (node, parent) pairs ordered by label, which halves distances, until the pairs stand
    still. Each step is a minimum per node and a join; its result is a table in the shared folder.
    """
    named = nodes.select("fp", F.struct("label", "fp").alias("node"))
    pairs = edges.join(named.withColumnsRenamed({"fp": "a", "node": "na"}), "a").join(named.withColumnsRenamed({"fp": "b", "node": "nb"}), "b")
    pairs = staged(pairs.select(F.greatest("na", "nb").alias("u"), F.least("na", "nb").alias("v")).distinct(), "links")
    before = None
    for _ in range(max_rounds):
        both = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = staged(moved.union(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        now = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    hubs = pairs.select(F.col("v.fp").alias("fp"), F.col("v.label").alias("label")).distinct()
    return pairs.select(F.col("u.fp").alias("fp"), F.col("v.label").alias("label")).union(hubs)


def _classes(docs: DataFrame, radius: int, shingle: int, shard_rows: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, text_key, fp) of ``docs`` and classes (fp, n, first): ``first`` is (no_id, doc_id, fp) of the least member of a fingerprint's class."""
    marked = staged(docs.select("doc_id", F.xxhash64("text").alias("text_key"), fingerprints(F.col("text"), shingle).alias("fp")), "fingerprints")
    nodes = staged(marked.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")), "distinct-fingerprints")
    edges = links(nodes.select("fp"), radius, shard_rows)
    # NULL sorts before all ids: stand a class of NULL ids alone behind the others. The fingerprint keeps classes apart whose least ids are equal.
    label = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "fp")
    ranked = nodes.select("fp", "n", label.alias("label"))
    found = components(ranked.select("fp", "label"), edges).select("fp", F.col("label").alias("least"))
    return marked, staged(ranked.join(found, "fp", "left").select("fp", "n", F.coalesce("least", "label").alias("first")), "classes")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs(doc_id, text)``.

    ``component_id`` is the smallest doc_id that links reach, the row's own included; NULL ids never win over others. NULL, empty and blank
    texts have fingerprint 0 and are linked like any other; rows that repeat fall into one class. Whole texts are read; an empty table
    gives an empty result; other columns are ignored.
    """
    marked, classes = _classes(docs, radius, shingle, shard_rows)
    named = classes.select("fp", "n", F.col("first.doc_id").alias("component_id"))
    return join_classes(marked.drop("text_key"), named, ["fp"]).select("doc_id", "fp", "component_id")


def first_of_classes(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row of ``docs`` for each near-duplicate class, with all its columns.

    The row of the smallest doc_id stays (a NULL id only where the class has no other), among different texts of one class with that id the one of
    the least hash. Two classes may have the same least id: each keeps a row. Of rows with equal doc_id and text one stays; where they
    differ in other columns, which one is not defined. NULL, empty and blank texts are one class. An empty table gives an empty one.
    """
    marked, classes = _classes(docs, radius, shingle, shard_rows)
    heads = classes.where("fp = first.fp").select(F.col("fp").alias("_fp"), F.col("first.doc_id").alias("_id"))
    rows = marked.join(heads, (F.col("fp") == F.col("_fp")) & F.col("doc_id").eqNullSafe(F.col("_id"))).groupBy("fp", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("n"))
    kept = rows.groupBy("fp").agg(F.min(F.struct("text_key", "doc_id", "n")).alias("row"))
    kept = staged(kept.select(F.col("row.doc_id").alias("_kept_id"), F.col("row.text_key").alias("_kept_key"), F.col("row.n").alias("_kept_n")), "kept-rows")
    same = docs["doc_id"].eqNullSafe(kept["_kept_id"]) & (F.xxhash64(docs["text"]) == kept["_kept_key"])
    alone = docs.join(kept.where("_kept_n = 1"), same, "left_semi")
    # The few kept rows that stand several times: their copies meet before the shuffle.
    several = docs.join(kept.where("_kept_n > 1"), same, "left_semi")
    return alone.unionByName(several.dropDuplicates(["doc_id", "text"]))
