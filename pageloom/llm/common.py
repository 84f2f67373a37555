"""What several operators share: reading, words, numbers of a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, and the white space between words.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: A key with more than one of so many rows is hot; so there are fewer hot keys than this.
HOT_SHARE = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """The words of a text; none for NULL."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def n_words_of(text: Column) -> Column:
    """How many words a text has, without keeping them; 0 for NULL."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), rf"^{SPACE}", "")
    parts = F.split(trimmed, SPACE)
    return (F.size(parts) - F.when(F.element_at(parts, -1) == "", 1).otherwise(0)).cast("long")


def id_fold(doc_id: Column, folds: int) -> Column:
    """The fold of a row: crc32 of its id as text; a row without an id counts as the empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds).cast("int")


def first_by_hash(keys: DataFrame, n: int, key: str = "doc_id") -> DataFrame:
    """At most ``n`` rows, the same ones at every run: those whose key has the smallest hash."""
    return keys.orderBy(F.xxhash64(key), key).limit(n)


def join_classes(rows: DataFrame, classes: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """``rows`` with the columns of ``classes``, which has a row for each key of ``rows`` and in ``n`` its number of rows.

    Keys may be NULL. The classes with over a thousandth of all rows are fewer than a thousand, so they are broadcast, and no task of the
    shuffle that joins the others gets more than that share of the rows by one key. ``classes`` is read three times.
    """
    total = classes.agg(F.sum(n)).first()[0] or 0
    named = classes.withColumnsRenamed({k: f"_class_{k}" for k in keys})
    hot, cold = named.where(F.col(n) * HOT_SHARE > total), named.where(F.col(n) * HOT_SHARE <= total)
    same = [F.col(k).eqNullSafe(F.col(f"_class_{k}")) for k in keys]
    on_hot = rows.join(F.broadcast(hot), same)
    on_cold = rows.join(F.broadcast(hot), same, "left_anti").join(cold, same)
    return on_hot.unionByName(on_cold).drop(*(f"_class_{k}" for k in keys))
