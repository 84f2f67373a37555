"""Broadcasting only what is known to be small."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

# Rows of a few short columns: well under a hundred megabytes.
BROADCAST_ROWS = 200_000


def holds_at_most(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows.

    Takes rows without columns, a few partitions at a time, and stops when there
    are enough; a limited count would bring the rows of all partitions into one
    task.
    """
    return len(df.select(F.lit(1)).take(rows + 1)) <= rows


def pinned(df: DataFrame, rows: int) -> tuple[DataFrame, list[dict]] | None:
    """``df`` as a local table with its rows, when there are at most ``rows`` of them, else None.

    Meant for requests, their terms and the keys of a page: what follows neither runs their plan again nor writes them.
    """
    found = df.limit(rows + 1).toArrow()
    if found.num_rows > rows:
        return None
    return df.sparkSession.createDataFrame(found, df.schema), found.to_pylist()


def few_values(df: DataFrame, column: str, rows: int) -> list | None:
    """The different values of ``column`` when there are at most ``rows`` of them, else None. Rows that are few as they are need no shuffle."""
    values = df.select(column)
    few = pinned(values, rows) or pinned(values.distinct(), rows)
    return None if few is None else list(dict.fromkeys(r[column] for r in few[1]))


def local_column(spark: SparkSession, values: list[str], column: str) -> DataFrame:
    """A few strings as a local table."""
    return spark.createDataFrame(pa.table({column: pa.array(values, pa.string())}), f"{column} STRING")


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS, small: bool | None = None) -> DataFrame:
    """``df`` marked for broadcasting when its row count proves it small, else unmarked.

    Meant for narrow tables (ids, hashes, terms). Without the mark Spark joins
    by shuffling and splits skewed partitions itself. A caller who already knows
    from a count it made says so with ``small``.
    """
    if small is None:
        small = holds_at_most(df, rows)
    return F.broadcast(df) if small else df
