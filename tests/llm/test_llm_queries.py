"""The registered queries against their SQL, and the pipeline's stages against brute force."""

from collections import Counter, defaultdict

import corpus_pipeline as pipeline
import pytest

import __spark_entry__ as driver
from pageloom.llm import decontamination, mixing, quality_classifier, simhash
from pageloom.queries.compare import differences, duckdb_views

SF = "/root/testdata/sf0.001"


def names():
    return [n for n in driver.queries() if n.startswith("op") and n[2].isdigit()]


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in names()) == list(range(1, 14)) and "pipeline" in driver.queries()


@pytest.mark.parametrize("name", [n for n in names() if n in driver.oracle_sql()])
def test_sql(spark, name):
    assert differences(driver.queries()[name](spark, SF), duckdb_views(SF), driver.oracle_sql()[name]) == []


CONTRACT = {
    "op2": ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op4": ["fingerprint", "component_id"],
    "op5": ["size", "source_size", "target", "taken"],
    "op7": ["held_out", "score", "predicted"],
    "op8": ["held_out", "lang_pred", "score"],
    "op11": ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op12": ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
    "op10": ["size", "text_crc32", "law", "shard", "slot", "grown_shard"],
}


@pytest.mark.parametrize("name", [n for n in names() if n not in driver.oracle_sql()])
def test_rows(spark, name):
    got = driver.queries()[name](spark, SF)
    assert set(CONTRACT.get(name.split("_")[0], [])) <= set(got.columns)
    ids = Counter(r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect())
    assert Counter(r[0] for r in got.select("doc_id").collect()) == ids


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "", "en", "src0", 0), (None, "A text without an id stays a text.", "en", "src1", 7)], docs.schema)
    docs = docs.unionByName(odd)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    by_id = {r["doc_id"]: r for r in docs.collect()}

    model = quality_classifier.fit_quality(docs, labels)
    good = pipeline.keep_good(spark, docs, SF)
    assert good.columns == docs.columns
    assert {r["doc_id"] for r in good.collect()} == {d for d, r in by_id.items() if model.score(r["text"]) >= 0.7}

    one = pipeline.keep_first_of_copies(spark, good, SF)
    assert one.columns == docs.columns
    prints = {r["doc_id"]: simhash.fingerprint(r["text"]) for r in good.collect()}
    left = {r["doc_id"] for r in one.collect()}
    classes = {}
    for d, f in prints.items():
        near = [c for c in classes if any((f ^ g).bit_count() <= 4 for g in classes[c][1])]
        members = [(d, f), *((i, g) for c in near for i, g in zip(*classes.pop(c)))]
        classes[d] = tuple(zip(*members))
    assert left - {None} == {min(i for i in ids if i is not None) for ids, _ in classes.values() if any(i is not None for i in ids)}

    clean = pipeline.drop_leaks(spark, one, SF)
    bench = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    matcher = decontamination.WuManber(bench)
    assert {r["doc_id"] for r in clean.collect()} == {d for d in left if not matcher.search(decontamination.item_words(by_id[d]["text"]))[0]}

    mixed = pipeline.mix_sources(spark, clean, SF)
    assert mixed.columns == docs.columns
    wanted = {r["doc_id"]: r["copies"] for r in mixing.mix(clean).collect()}
    assert Counter(r["doc_id"] for r in mixed.collect()) == {d: n for d, n in wanted.items() if n}

    placed = pipeline.shard(spark, mixed, SF).collect()
    assert Counter(r["doc_id"] for r in placed) == {d: n for d, n in wanted.items() if n}
    slots = defaultdict(list)
    for r in placed:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_stages_of_odd_rows(spark):
    """Columns that clash with inner names, equal and missing ids, equal rows: nothing is lost, nothing stays twice."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, __copies int, class string, row string, _kept_id int, times int, text_key int, fp int"
    words = [" ".join(f"{w}{k}" for w in ("alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta")) for k in range(12)]
    rows = [(1, words[0]), (1, words[1]), (1, words[1]), (None, words[2]), (None, words[2]), (None, words[3]), (5, words[0]), (6, None), (7, ""), (8, "w " * 20_000)]
    docs = spark.createDataFrame([(i, t, "en", s, 1, 2, "c", "r", 3, 4, 5, 6) for i, t in rows for s in ("a",)], schema)
    one = pipeline.keep_first_of_copies(spark, docs, SF)
    assert one.columns == docs.columns
    got = Counter((r["doc_id"], r["text"]) for r in one.collect())
    assert got == Counter([(1, words[0]), (1, words[1]), (None, words[2]), (None, words[3]), (6, None), (8, "w " * 20_000)])
    mixed = pipeline.mix_sources(spark, docs, SF)
    assert mixed.columns == docs.columns
    wanted = Counter()
    for r in mixing.mix(docs).collect():
        wanted[r["size"]] += r["copies"]
    got = Counter()
    for r in mixed.collect():
        got[len((r["text"] or "").split())] += 1
    assert got == {s: n for s, n in wanted.items() if n}
    assert pipeline.drop_leaks(spark, docs, SF).count() == len(rows)
    assert pipeline.shard(spark, docs, SF).count() == len(rows)


def test_run(spark):
    assert pipeline.run(spark, SF).count() > 0


def test_stages_of_empty_tables(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
