"""Keys, unions and upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pageloom.functions.text import content_hash, is_blank
from pageloom.functions.urls import domain_extract, url_hash
from pageloom.operators.joins import concerned, latest_per_url, with_url_hash
from pageloom.operators.numbering import number_rows
from pageloom.operators.sizing import BROADCAST_ROWS, holds_at_most, small_side
from pageloom.schema import STORE
from pageloom.session import staged
from pageloom.sources.store import last_key, store_delta, store_near


def ok_error_union(ok: DataFrame, errored: DataFrame, skip_unreachable: bool = False) -> DataFrame:
    """Fetched rows and, unless left out, the errored ones."""
    if skip_unreachable:
        return ok.withColumn("error", F.lit(None).cast("string")) if "error" not in ok.columns else ok
    return ok.unionByName(errored, allowMissingColumns=True)


def to_store_rows(df: DataFrame) -> DataFrame:
    """Bring rows to the store's columns; hashes and domain follow from URL and content."""
    derived = {
        "url_hash": url_hash(F.col("url")),
        "domain": domain_extract(F.col("url")),
    }
    if "content" in df.columns:
        derived["content_hash"] = content_hash(F.col("content"))
    out = df.withColumns({name: value for name, value in derived.items() if name not in df.columns})
    return out.select(
        *[
            (F.col(f.name) if f.name in out.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in STORE.fields
        ]
    )


def next_key(store: DataFrame) -> "F.Column":
    """Highest key of the store, as a scalar subquery; 0 for an empty store."""
    return store.agg(F.coalesce(F.max("key"), F.lit(0)).alias("max_key")).scalar()


def key_assign(batch: DataFrame, store: DataFrame, order: str = "pos", small: bool | None = None, last: int | None = None) -> DataFrame:
    """Add ``key`` to a batch with one row per URL.

    Known URLs keep theirs, new ones count on from the highest key in the order
    of arrival. Only URL hash and key of the store take part. Who knows the highest key says so with ``last``.
    """
    hashed = with_url_hash(batch).withColumn("_order", F.col(order)).drop("key")
    keys = with_url_hash(store).select("url_hash", F.col("key").alias("_known"))
    # Looked at three times below: the old ones, the number of new ones, the new ones.
    matched = staged(hashed.join(concerned(keys, hashed, "url_hash", small), "url_hash", "left"), "matched")
    old = matched.where("_known IS NOT NULL").withColumn("key", F.col("_known"))
    new = number_rows(matched.where("_known IS NULL"), "_order", "_seq").withColumn(
        "key", F.col("_seq") + (next_key(store) if last is None else F.lit(last))
    )
    return old.drop("_known", "_order").unionByName(new.drop("_known", "_seq", "_order"))


def upsert_rows(store: DataFrame, batch: DataFrame, order: str = "pos", small: bool | None = None, last: int | None = None) -> DataFrame:
    """What an upsert of ``batch`` puts into the store: a row per URL with its key.

    Rows with a blank URL are skipped; of several rows with one URL the last counts.
    """
    latest = latest_per_url(batch.where(~is_blank(F.col("url"))), order)
    return to_store_rows(key_assign(latest, store, order, small, last))


def store_upsert(store: DataFrame, batch: DataFrame, order: str = "pos") -> DataFrame:
    """The store after a batch: same URL replaces the record and keeps its key, others are added.

    If the batch is small, the store is only read and filtered, not shuffled. ``upsert_into`` does the same on disk and writes only the batch.
    """
    small = holds_at_most(batch.select("url"), BROADCAST_ROWS)
    keyed = staged(upsert_rows(store, batch, order, small), "keyed")
    kept = store.join(small_side(keyed.select("url_hash"), small=small), "url_hash", "left_anti")
    return to_store_rows(kept).unionByName(keyed)


def upsert_into(batch: DataFrame, path: str, order: str = "pos", asked: DataFrame | None = None) -> int:
    """Upsert a batch into the store on disk as a delta: what is written follows from the batch; the new version.

    ``asked`` has the URLs of the batch, or more; it is counted and looked up instead, where making the batch twice costs much.

    Of the store only URL hashes and keys are read, and of those only segments that can hold a URL of a small batch. Running it again with the same batch adds a delta that changes nothing.
    """
    spark = batch.sparkSession
    asked = batch if asked is None else asked
    small = holds_at_most(asked.select("url"), BROADCAST_ROWS)
    hashed = with_url_hash(asked)
    known = concerned(with_url_hash(store_near(spark, path, hashed, "url_hash")).select("url_hash", "key"), hashed, "url_hash", small)
    # Picked by what was asked: the batch itself need not pick them again.
    return store_delta(upsert_rows(known, batch, order, False, last_key(spark, path)), path)
