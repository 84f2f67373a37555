import math
import re
from collections import Counter

from pyspark.sql import functions as F

from pageloom.llm import quality_rules as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def figures(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    n = Counter(windows)
    hit = {k + j for k, w in enumerate(windows) if n[w] > 1 for j in range(8)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(hit)


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def test_figures(documents, texts):
    got = {r[0]: tuple(r)[1:] for r in q.base_figures(documents).select("doc_id", *COLUMNS).collect()}
    assert got == {k: figures(v) for k, v in texts.items()}


def test_edges(edge_docs, no_docs):
    got = q.quality_by_votes(edge_docs)
    expected = sorted(((r["doc_id"], *figures(r["text"])) for r in edge_docs.collect()), key=repr)
    assert sorted((tuple(r) for r in got.select("doc_id", *COLUMNS).collect()), key=repr) == expected
    assert all(r["base_failed"] and not r["kept"] for r in got.where("n_words < 20").collect())
    assert q.quality_by_votes(no_docs).count() == 0


def test_model_is_that_of_plain_expectation_maximisation(documents):
    voted = q.votes(q.base_figures(documents))
    model = q.fit_votes(voted)
    names = [f"v_{r.name}" for r in q.RULES]
    rows = [tuple(r) for r in voted.select(*names).collect()]
    prior, right = 0.8, [0.9] * len(names)
    for _ in range(60):
        p = [1 / (1 + math.exp(-(math.log(prior / (1 - prior)) + sum(v * math.log(a / (1 - a)) for v, a in zip(r, right))))) for r in rows]
        new = [min(1 - 1e-6, max(0.5 + 1e-6, (sum(x if r[k] == 1 else 1 - x for r, x in zip(rows, p) if r[k]) + 0.9) / (sum(r[k] != 0 for r in rows) + 1))) for k in range(len(names))]
        now = (sum(p) + 0.8) / (len(p) + 1)
        moved = max(abs(a - b) for a, b in zip([prior, *right], [now, *new]))
        prior, right = now, new
        if moved < 1e-6:
            break
    assert all(abs(a - b) < 1e-6 for a, b in zip([model.prior, *model.accuracy], [prior, *right]))


def test_votes_agree_with_labels_that_they_never_saw(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    judged = q.quality_by_votes(documents).join(labels, "doc_id").where("NOT base_failed")
    assert judged.agg(F.avg((F.col("kept").cast("int") == F.col("quality")).cast("int"))).first()[0] > 0.97


def test_main_path_is_native(documents):
    plan = q.base_figures(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_words_with_marks_and_inner_signs_are_plain(spark):
    cases = {
        "यह एक साफ पाठ है।": 5, "ภาษาไทย สวัสดี": 2, "don't stop, well-known l’eau": 4, "e\u0301te\u0301 cafe\u0301.": 2, "நான் தமிழ் பேசுகிறேன்": 3,
        "a1 b2 --- 'x' -y z-": 0, "plain words, only; here: yes?": 5, "": 0, "-": 0,
    }
    docs = spark.createDataFrame([(k, x) for k, x in enumerate(cases)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_plain"] for r in q.base_figures(docs).collect()}
    assert [got[k] for k in range(len(cases))] == list(cases.values())
