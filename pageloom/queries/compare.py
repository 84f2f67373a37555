"""Compare a query with its SQL, for tests and by hand."""

from __future__ import annotations

import math
from decimal import Decimal
from pathlib import Path

from pyspark.sql import DataFrame


def duckdb_views(sf: str):
    import duckdb

    db = duckdb.connect()
    for file in sorted(Path(sf).glob("*.parquet")):
        db.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return db


def _plain(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float) and not math.isnan(value):
        return int(value) if value.is_integer() else value
    return value


def _rows(columns, rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


def differences(df: DataFrame, db, sql: str) -> list[str]:
    """What sets the two results apart; empty when they are the same."""
    result = db.execute(sql)
    names = [d[0] for d in result.description]
    expected, found = _rows(names, result.fetchall()), _rows(df.columns, df.collect())
    out = []
    if sorted(names) != sorted(df.columns):
        out.append(f"columns {sorted(df.columns)} for {sorted(names)}")
    if len(expected) != len(found):
        out.append(f"{len(found)} rows for {len(expected)}")
    if not out:
        out = [f"row {f!r:.300} for {e!r:.300}" for e, f in zip(expected, found) if e != f][:3]
    else:
        out += [f"only in result {f!r:.300}" for f in sorted(set(found) - set(expected), key=repr)[:2]]
        out += [f"missing {e!r:.300}" for e in sorted(set(expected) - set(found), key=repr)[:2]]
    return out
