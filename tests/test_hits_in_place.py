"""Hits that need no grouping stay where they lie; others move once for all queries."""

import re

from conftest import rows
from test_search import docs, queries

from pageloom.search import analysis, index, match, modes, rank
from pageloom.session import scratch_path


def test_queries_of_one_word_are_scored_where_their_postings_lie(spark):
    entries = [(f"k{i}", "", "", "data park" if i % 2 else "data hot hot", "") for i in range(8)]
    idx = index.build_index(docs(spark, entries), scratch_path(spark, "index"), buckets=2)
    plain = queries(spark, ["data", "hot", "nothing"])
    alone, others = match.parted_matches(idx, analysis.query_terms(plain))
    assert others is None
    plan = rank.bm25_scores(alone, others, idx)._jdf.queryExecution().toString()
    assert not re.search(r"hashpartitioning\([^)]*key#", plan)
    # Several words, several expansions, and a query that comes twice are still put together.
    for asked in (plain, queries(spark, ["data hot", "hott~1", "data~2", "park"]), plain.unionByName(plain.withColumn("text", plain.query_id.cast("string")))):
        asked = asked.unionByName(queries(spark, ["park data"]))
        terms = analysis.query_terms(asked)
        want = rank.bm25_score(match.matches(idx, terms), idx)
        assert rows(rank.bm25_scores(*match.parted_matches(idx, terms), idx)) == rows(want)
        assert rows(match.search_fuzzy(idx, asked)) == rows(want.select("query_id", "key"))


def test_a_posting_moves_once_for_all_queries(spark):
    entries = [(f"k{i}", "", "", "data park", "") for i in range(8)]
    idx = index.build_index(docs(spark, entries), scratch_path(spark, "index"), buckets=2)
    asked = queries(spark, ["data park"] * 5)
    _, others = match.parted_matches(idx, analysis.query_terms(asked))
    moved = [line for line in others._jdf.queryExecution().executedPlan().toString().split("\n") if "hashpartitioning(key" in line]
    assert len(moved) == 1
    assert match.complete(others).count() == 40


def test_a_pattern_is_looked_up_by_most_of_its_letters(spark):
    asked = spark.createDataFrame([("d?cument",), ("doc*",), ("*ment",), ("d*cume?t",), ("*?*",)], "pattern string")
    got = {r.pattern: tuple(r.k) for r in asked.select("pattern", modes._pattern_keys(asked.pattern).alias("k")).collect()}
    assert got == {"d?cument": ("tail", "ment"), "doc*": ("head", "doc"), "*ment": ("tail", "ment"), "d*cume?t": ("inside", "cume"), "*?*": ("head", "")}
    words = spark.createDataFrame([("content", w, 1) for w in ("document", "dcument", "doccument", "decument", "cement")], "field string, term string, df long")
    found = modes.wildcard_terms(asked.selectExpr("'content' AS field", "pattern"), words)
    assert rows(found.where("pattern = 'd?cument'"), "term") == [("decument",), ("document",)]
    assert found.where("pattern = '*ment'").count() == 5 and found.where("pattern = '*?*'").count() == 5
