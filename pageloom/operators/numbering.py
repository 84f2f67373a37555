"""Dense numbers over a whole table without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# A bucket spans 2**16 consecutive positions. Positions are unique, so a bucket
# never holds more rows than that, whatever the data looks like.
BUCKET_BITS = 16


def _before(counts: DataFrame) -> DataFrame:
    """Rows ahead of every bucket: ``bucket, n`` -> ``bucket, before``.

    Buckets are summed up within groups of 2**16, and the few group totals in
    one short window.
    """
    grouped = counts.withColumn("_group", F.shiftright("_bucket", BUCKET_BITS))
    inside = Window.partitionBy("_group").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(F.lit(0)).orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    groups = (
        grouped.groupBy("_group")
        .agg(F.sum("_n").alias("_n"))
        .select("_group", F.coalesce(F.sum("_n").over(across), zero).alias("_groups_before"))
    )
    return (
        grouped.withColumn("_inside", F.coalesce(F.sum("_n").over(inside), zero))
        .join(groups, "_group")
        .select("_bucket", (F.col("_inside") + F.col("_groups_before")).alias("_before"))
    )


def number_rows(df: DataFrame, order: str, out: str) -> DataFrame:
    """Add ``out`` = 1, 2, 3 … in the order of the unique integer column ``order``.

    Rows are numbered inside buckets of the position and shifted by the number
    of rows in earlier buckets. Everything follows from values, so a task that
    runs again after a lost executor gives the same numbers.
    """
    placed = df.withColumn("_bucket", F.shiftright(F.col(order).cast("bigint"), BUCKET_BITS))
    counts = placed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    within = Window.partitionBy("_bucket").orderBy(order)
    return (
        placed.withColumn("_row", F.row_number().over(within))
        .join(_before(counts), "_bucket")
        .withColumn(out, F.col("_row") + F.col("_before"))
        .drop("_bucket", "_row", "_before")
    )


def first_rows(df: DataFrame, n: int, order: str) -> DataFrame:
    """Exactly the ``n`` rows with the lowest value of the integer column ``order``, or all if there are fewer.

    Which of the rows at one position come first is open.
    """
    return number_rows(df, order, "_seq").where(F.col("_seq") <= n).drop("_seq")


def first_per(df: DataFrame, by: str | list[str], *order: Column) -> DataFrame:
    """First row per group.

    The filter on the row number lets Spark keep one row per group and map task
    before the shuffle, so a group of any size sends one row per task.
    """
    by = [by] if isinstance(by, str) else by
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.where(F.col("_rank") == 1).drop("_rank")
