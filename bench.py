"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pageloom import queries  # noqa: E402
from pageloom.plans.search import search_one  # noqa: E402
from pageloom.queries.inputs import store_path  # noqa: E402
from pageloom.session import local_session  # noqa: E402

HEADLINE = (
    "domain_stats", "url_dedup", "content_dedup", "html_text_extract", "key_assign", "store_upsert", "ingest",
    "corpus_stats", "fuzzy_term_join", "bm25_score", "search_page", "search_batch", "search_phrase",
)


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return round(time.perf_counter() - start, 3)


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    queries.load_all()
    from pageloom.queries.searching import the_index

    seconds: dict[str, float] = {}

    run(spark.range(1000))
    store_path(spark, sf)
    # Built once; the searches below open it.
    seconds["index_build"] = timed(lambda: the_index(spark, sf))
    index = the_index(spark, sf)

    # The three shapes of a query: one word, a word with an edit, two words.
    words = [r["term"] for r in index.vocabulary.where("field = 'composite_text' AND length(term) > 6").orderBy("df", ascending=False).limit(2).collect()]
    shapes = {"word": words[0], "fuzzy": f"{words[0]} {words[1]}~1", "two_words": " ".join(words)}
    for name, text in shapes.items():
        times = [timed(lambda: search_one(index, text)[0].collect()) for _ in range(3)]
        seconds[f"search_{name}_p50"] = round(statistics.median(times), 3)
        seconds[f"search_{name}_max"] = max(times)

    for name in HEADLINE:
        seconds[name] = timed(lambda: run(queries.QUERIES[name](spark, sf)))
    total = round(sum(v for k, v in seconds.items() if not k.endswith("_max")), 3)
    print(json.dumps({"metric": "headline queries, total", "value": total, "unit": "sec", "queries": seconds, "sf": sf}))


if __name__ == "__main__":
    main()
