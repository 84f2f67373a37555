"""Dates of bookmarks."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pageloom.schema import MISSING


def iso_text(ts: Column) -> Column:
    """ISO text of a timestamp, with a fraction only when there is one."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    return F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))


def epoch_text(ts: Column) -> Column:
    """Seconds since the epoch with six decimals."""
    micros = F.unix_micros(ts.cast("timestamp"))
    return F.format_string("%d.%06d", F.floor(micros / 1000000), F.pmod(micros, F.lit(1000000)))


def date_extract(date_added: Column, crawl_time: Column, as_of: Column) -> Column:
    """Day of the bookmark: from ``date_added``, else ``crawl_time``, else ``as_of``.

    The day is the one written in the text; an offset does not shift it. Text
    that is no date (an epoch number, say) counts as missing.
    """
    added = F.when(date_added != MISSING, date_added)
    with_time = F.when(
        F.instr(added, "T") > 0,
        F.when(added.try_cast("timestamp").isNotNull(), F.left(added, F.lit(10)).try_cast("date")),
    )
    day_only = F.when(added.rlike(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"), added.try_cast("date"))
    return F.coalesce(with_time, day_only, F.to_date(crawl_time), as_of.cast("date"))
