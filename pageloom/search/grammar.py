"""One query string with operators: ``AND OR NOT ( ) "a phrase" word~2 pre* field:word``.

A string becomes clauses (words, wildcards, phrases, each in a field) and a tree over them, kept as an array in postfix order. The clauses of all
queries are looked up together by the joins of the plain searches; what a query met in some thousands of documents then comes
together, and the array is run through once for all of them.

Words side by side mean AND, which binds stronger than OR; NOT binds to what follows it. Operators are capitals. Words go through the analysis of
documents; one that it drops is as if not written. What is malformed has a meaning too: operators without something to join are dropped, a missing
bracket or quote closes at the end, one too many is left out. A document must meet a clause that is not excluded: a
query that only excludes finds nothing.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from pageloom.search.analysis import MIN_LENGTH, STOP_WORDS, TOKEN, is_kept
from pageloom.search.index import FIELDS, Index
from pageloom.search.match import FIELD, matches
from pageloom.search.modes import phrase_hits, wildcard_docs
from pageloom.search.rank import SCORE_DIGITS, scored_hits

# Words, wildcards and phrases reach the tree as they are written; the analysis of their text is done by column functions.
_PIECE = re.compile(r'\s*(?:([()])|(?:(\w+):(?=\S))?(?:"([^"]*)(?:"|$)(?:~\d*)?|([^\s()"]+)))')
_OPERATORS = {"AND", "OR", "NOT"}
#: Documents of which a task looks at all that a query met in them.
JUDGED_DOCS = 1 << 14
_BINDS = {"or": 1, "and": 2, "not": 3}
_PARSED = "clauses array<struct<clause:int,kind:string,field:string,text:string,excluded:boolean>>, tree array<struct<op:string,clause:int>>"


def _pieces(text: str) -> list[tuple]:
    """Brackets, operators and clauses of a text, with the AND between neighbours written out and senseless operators left out."""
    raw: list[tuple] = []
    for m in _PIECE.finditer(text):
        bracket, field, phrase, word = m.groups()
        if bracket:
            raw.append((bracket,))
        elif phrase is None and field is None and word in _OPERATORS:
            raw.append((word.lower(),))
        else:
            if field is not None and field not in (*FIELDS, "key"):
                # No field of that name: a word like any other.
                phrase, word, field = (None, f"{field}:{word}", None) if phrase is None else (phrase, word, None)
            text_of = phrase if phrase is not None else word
            if any(c.isalnum() or c == "_" for c in text_of) or set(text_of) & set("*?"):
                kind = "phrase" if phrase is not None else "wild" if set(text_of) & set("*?") else "word"
                raw.append(("clause", kind, field or FIELD, text_of))
    out: list[tuple] = []
    depth = 0
    for piece in raw:
        ends = bool(out) and out[-1][0] in ("clause", ")")
        kind = piece[0]
        if kind in ("and", "or"):
            # Joins something only behind an operand; one that follows another replaces nothing.
            if ends:
                out.append(piece)
            continue
        if kind == ")":
            while out and out[-1][0] in ("and", "or", "not"):
                out.pop()
            if depth and out:
                depth -= 1
                if out[-1][0] == "(":
                    out.pop()
                    while out and out[-1][0] in ("and", "or", "not"):
                        out.pop()
                else:
                    out.append(piece)
            continue
        if ends:
            out.append(("and",))
        depth += kind == "("
        out.append(piece)
    while out and out[-1][0] in ("and", "or", "not", "("):
        depth -= out.pop()[0] == "("
    return out + [(")",)] * depth


def parse(text: str | None) -> tuple[list[dict], list[dict]]:
    """(clauses, tree in postfix order) of a query string."""
    clauses, tree, waiting = [], [], []

    def settle(strength: int) -> None:
        while waiting and waiting[-1] != "(" and _BINDS[waiting[-1]] >= strength:
            tree.append({"op": waiting.pop(), "clause": -1})

    for piece in _pieces(text or ""):
        kind = piece[0]
        if kind == "clause":
            excluded = sum(w == "not" for w in waiting) % 2 == 1
            clauses.append({"clause": len(clauses), "kind": piece[1], "field": piece[2], "text": piece[3], "excluded": excluded})
            tree.append({"op": "clause", "clause": len(clauses) - 1})
            while waiting and waiting[-1] == "not":
                tree.append({"op": waiting.pop(), "clause": -1})
        elif kind == "(":
            waiting.append("(")
        elif kind == ")":
            settle(0)
            waiting.pop()
            while waiting and waiting[-1] == "not":
                tree.append({"op": waiting.pop(), "clause": -1})
        elif kind == "not":
            waiting.append("not")
        else:
            settle(_BINDS[kind])
            waiting.append(kind)
    settle(0)
    return clauses, tree


def parsed(text: Column) -> Column:
    @F.pandas_udf(_PARSED)
    def run(texts: pd.Series) -> pd.DataFrame:
        both = [parse(t) for t in texts]
        return pd.DataFrame({"clauses": [c for c, _ in both], "tree": [t for _, t in both]})

    return run(text)


def _held(tree: list[dict], met: np.ndarray) -> np.ndarray:
    """For which documents the tree holds; ``met`` has a row per clause and a column per document. An empty tree holds for none."""
    stack: list[np.ndarray] = []
    for node in tree:
        if node["op"] == "clause":
            stack.append(met[node["clause"]])
        elif node["op"] == "not":
            stack.append(~stack.pop())
        else:
            top = stack.pop()
            stack.append(stack.pop() & top if node["op"] == "and" else stack.pop() | top)
    return stack[-1] if stack else np.zeros(met.shape[1], dtype=bool)


def _found(trees: list[dict], rows: pa.Table) -> list[tuple[pa.Array, np.ndarray]]:
    """Keys and scores of the documents for which each of the trees of a query holds, from all that these documents met."""
    keys = rows.column("key").combine_chunks().dictionary_encode(null_encoding="encode")
    doc, clause, part = keys.indices.to_numpy(zero_copy_only=False), rows.column("clause").to_numpy(), rows.column("part").to_numpy()
    # Parts are added from the least on, so a sum does not hang on the order of rows.
    order = np.argsort(part, kind="stable")
    doc, clause, part = doc[order], clause[order], part[order]
    n, most = len(keys.dictionary), max([int(clause.max(initial=0)), *(x["clause"] for t in trees for x in t["tree"])])
    met = np.zeros((most + 1, n), dtype=bool)
    met[clause, doc] = True
    out = []
    for t in trees:
        counted = ~np.isin(clause, t["_excluded"])
        wanted, score = np.zeros(n, dtype=bool), np.bincount(doc[counted], weights=part[counted], minlength=n)
        wanted[doc[counted]] = True
        found = np.flatnonzero(_held(t["tree"], met) & wanted)
        out.append((keys.dictionary.take(pa.array(found)), score[found]))
    return out


def judged(each: DataFrame, trees: DataFrame, n_docs: int) -> DataFrame:
    """``(query_id, key, score)`` of the documents that meet the tree of their query.

    ``each(query_id, clause, key, part)`` has a row per clause that a document met, ``trees(query_id, tree, _excluded)`` the clauses in postfix order and
    those that do not count for the score. What a query met comes together by parts of the documents, a few thousand each, behind a row that carries the
    trees; a tree then runs once for all documents of the part, a column of them at a time.
    """
    parts = max(1, -(-n_docs // JUDGED_DOCS))
    # As text: Arrow looks into a nested column again for every row, though all but the heads have none.
    carried = trees.groupBy("query_id").agg(F.to_json(F.collect_list(F.struct("tree", "_excluded"))).alias("_trees"))
    heads = carried.select("query_id", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_part"), "_trees")
    place = F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int").alias("_part")
    rows = heads.unionByName(each.where("query_id IS NOT NULL").select("query_id", place, "key", "clause", "part"), allowMissingColumns=True)
    together = rows.where("query_id IS NOT NULL").repartition("query_id", "_part").sortWithinPartitions("query_id", "_part", F.col("_trees").isNull())
    schema = StructType([each.schema["query_id"], each.schema["key"], StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, held = None, []

        def settled() -> Iterator[pa.RecordBatch]:
            if head is None or not sum(map(len, held)):
                return
            for keys, scores in _found(json.loads(head.column("_trees")[0].as_py()), pa.Table.from_batches(held)):
                if len(keys):
                    query = head.column("query_id").take(pa.array(np.zeros(len(keys), dtype=np.int64)))
                    yield pa.RecordBatch.from_arrays([query, keys, pa.array(scores)], names=["query_id", "key", "score"])

        for batch in batches:
            starts = np.flatnonzero(batch.column("_trees").is_valid().to_numpy(zero_copy_only=False))
            for start, end in zip([-1, *starts], [*starts, batch.num_rows]):
                if start >= 0:
                    yield from settled()
                    head, held = batch.slice(start, 1), []
                held.append(batch.slice(start + 1, end - start - 1).select(["key", "clause", "part"]))
        yield from settled()

    return together.select("query_id", "_trees", "key", "clause", "part").mapInArrow(run, schema)


def _words(clauses: DataFrame) -> DataFrame:
    """Word and phrase clauses to their terms ``(query_id, clause, kind, field, ord, term, maxdist, n_terms)``.

    A word of a word clause may carry ``~`` or ``~k``; a word that falls into several terms needs all of them, in a row like a phrase.
    """
    plain = F.when(F.col("kind") == "word", F.regexp_replace("text", "~[0-9]?$", "")).otherwise(F.col("text"))
    edits = F.when(F.col("kind") == "word", F.regexp_extract("text", "~([0-9]?)$", 0))
    maxdist = F.when(F.coalesce(edits, F.lit("")) == "", 0).when(edits == "~", 1).otherwise(F.right(edits, F.lit(1)).cast("int"))
    found = F.regexp_extract_all(F.lower(plain), F.lit(TOKEN), F.lit(0))
    kept = F.filter(found, lambda t: is_kept(t, STOP_WORDS, MIN_LENGTH))
    return (
        clauses.where("kind <> 'wild'")
        .select("query_id", "clause", "field", maxdist.alias("maxdist"), kept.alias("_terms"))
        .select("query_id", "clause", "field", "maxdist", F.size("_terms").alias("n_terms"), F.posexplode("_terms").alias("ord", "term"))
    )


def _without(tree: Column, dropped: Column) -> Column:
    """The tree without the clauses that the analysis left nothing of.

    A dropped clause is a hole; NOT of a hole is a hole, a hole beside something leaves that. Nodes carry the text of their subtree as an array, so
    this is one more run through the postfix array.
    """
    nothing = F.array().cast("array<struct<op:string,clause:int>>")
    empty = F.array().cast("array<array<struct<op:string,clause:int>>>")

    def step(stack: Column, node: Column) -> Column:
        top, below, n = F.element_at(stack, -1), F.element_at(stack, -2), F.size(stack)
        one = F.array(node)
        leaf = F.when(F.array_contains(dropped, node["clause"]), nothing).otherwise(one)
        negated = F.when(F.size(top) == 0, nothing).otherwise(F.concat(top, one))
        both = F.when(F.size(top) == 0, below).when(F.size(below) == 0, top).otherwise(F.concat(below, top, one))
        return (
            F.when(node["op"] == "clause", F.concat(stack, F.array(leaf)))
            .when(node["op"] == "not", F.concat(F.slice(stack, F.lit(1), n - 1), F.array(negated)))
            .otherwise(F.concat(F.slice(stack, F.lit(1), n - 2), F.array(both)))
        )

    built = F.aggregate(tree, empty, step)
    return F.coalesce(F.try_element_at(built, F.lit(-1)), nothing)


def search_query(index: Index, queries: DataFrame) -> DataFrame:
    """``queries(query_id, text)`` with the grammar above: ``(query_id, key, score)``.

    The score sums, over the clauses met that are not excluded, BM25 of a word (the best expansion of a fuzzy one), of all words
    of a phrase, and 1 for a wildcard.
    """
    asked = queries.select("query_id", parsed(F.col("text")).alias("_p")).select("query_id", "_p.clauses", "_p.tree")
    clauses = asked.select("query_id", F.explode("clauses").alias("_c")).select("query_id", "_c.*")
    leaf = F.struct("query_id", "clause").alias("query_id")
    words = _words(clauses)
    single = words.where("n_terms = 1").select(leaf, "field", "ord", "term", "maxdist", "n_terms")
    found = scored_hits(matches(index, single, by_key=True), index).groupBy("query_id", "key").agg(F.max("part").alias("part"))
    several = words.where("n_terms > 1").select(leaf, "field", "ord", "term", "n_terms")
    in_a_row = phrase_hits(index, several)
    parts = scored_hits(matches(index, several.withColumn("maxdist", F.lit(0))), index).select("query_id", "key", "part")
    phrased = parts.join(in_a_row, ["query_id", "key"]).groupBy("query_id", "key").agg(F.sum("part").alias("part"))
    patterns = clauses.where("kind = 'wild'").select(leaf, "field", F.lower("text").alias("pattern")).distinct()
    wild = wildcard_docs(index, patterns).select("query_id", "key").distinct()
    keys = clauses.where("field = 'key' AND kind <> 'wild'").select(leaf, F.col("text").alias("key"))
    by_key = index.docs.select("key").join(keys, "key").select("query_id", "key")
    met = found.unionByName(phrased).unionByName(wild.withColumn("part", F.lit(1.0))).unionByName(by_key.withColumn("part", F.lit(1.0)))
    # What the analysis left nothing of is as if not written.
    left = words.select("query_id", "clause").distinct().withColumn("_left", F.lit(True))
    unsaid = clauses.join(left, ["query_id", "clause"], "left").where("_left IS NULL AND kind <> 'wild' AND field <> 'key'")
    dropped = unsaid.groupBy("query_id").agg(F.collect_set("clause").alias("_dropped"))
    none = F.array().cast("array<int>")
    trees = asked.join(dropped, "query_id", "left").select(
        "query_id",
        _without(F.col("tree"), F.coalesce("_dropped", none)).alias("tree"),
        F.transform(F.filter("clauses", lambda c: c["excluded"]), lambda c: c["clause"]).alias("_excluded"),
    )
    each = met.select(F.col("query_id.query_id").alias("query_id"), F.col("query_id.clause").alias("clause"), "key", "part")
    return judged(each, trees, index.docs.count()).withColumn("score", F.round("score", SCORE_DIGITS))
