"""Of a query of several words only documents with its rarest word are looked at further."""

import re

from conftest import rows
from test_search import docs, queries

from pageloom.search import analysis, index, match
from pageloom.session import scratch_path

ENTRIES = [(f"k{i}", "", "", "data date " + ("park " if i % 3 else "hot ") + ("rare" if i in (1, 3) else "common"), "") for i in range(12)] + [(None, "", "", "data rare park", "")]


def test_documents_without_the_rarest_word_make_no_hits(spark, monkeypatch):
    idx = index.build_index(docs(spark, ENTRIES), scratch_path(spark, "index"), buckets=2)
    near, write = [], match.staged
    monkeypatch.setattr(match, "staged", lambda df, name: (near.append((name, made := write(df, name))), made)[1])
    asked = queries(spark, ["data~1 rare~1 park~1", "data hot~1", "date~1", "data nothing~1", "common", "rere~1 data"]).unionByName(queries(spark, ["data~1 rare~1 park~1"]))
    asked = asked.unionByName(asked.limit(1).selectExpr("CAST(NULL AS INT) AS query_id", "text") if dict(asked.dtypes)["query_id"] == "int" else asked.limit(1).selectExpr("CAST(NULL AS BIGINT) AS query_id", "text"))
    got = rows(match.search_fuzzy(idx, asked))
    (made,) = [t for name, t in near if name == "documents-near"]
    counts = {tuple(r)[0]: r["count"] for r in made.groupBy("_query.query_id").count().collect()}
    assert counts[0] == 3 and counts[1] == 4 and counts[5] == 3 and 3 not in counts
    want = match.complete(match.matches(idx, analysis.query_terms(asked)))
    assert got == rows(want) and (None, "k1") in got and (0, None) in got and len(got) > 20
    assert not re.search("nothing", str(got))
