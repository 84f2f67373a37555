from pyspark.sql import functions as F

from pageloom.llm.common import join_classes


def test_join_classes_hot_cold_and_null(spark):
    ids = spark.range(2500)
    # One key of 1,000 rows, NULL with 500, and 1,000 keys of one row, which are not hot.
    key = F.when(F.col("id") < 1000, F.lit(-1)).when(F.col("id") >= 1500, F.col("id"))
    rows = ids.select("id", key.alias("k"))
    classes = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    got = {r["id"]: (r["k"], r["n"], r["first"]) for r in join_classes(rows, classes, ["k"]).collect()}
    want = {i: (-1, 1000, 0) if i < 1000 else (None, 500, 1000) if i < 1500 else (i, 1, i) for i in range(2500)}
    assert got == want
    assert join_classes(rows.limit(0), classes.limit(0), ["k"]).count() == 0
