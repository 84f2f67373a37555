"""Detection and repair of text decoded with the wrong charset."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F

# Shortest text looked at, share and run length of characters
# beyond ASCII that make a text suspect.
MIN_CHARS = 20
MIN_SHARE = 0.1
RUN = 10


def encoding_suspect(text: Column) -> Column:
    """True when the text is rich in, and has a long run of, non-ASCII characters."""
    n_foreign = F.length(F.regexp_replace(text, r"[\x00-\x7F]+", ""))
    return F.coalesce(
        (F.length(text) >= MIN_CHARS)
        & (n_foreign >= F.length(text) * F.lit(MIN_SHARE))
        & text.rlike(rf"[^\x00-\x7F]{{{RUN}}}"),
        F.lit(False),
    )


def _redecoder(charset: str):
    @F.pandas_udf("string")
    def redecode(texts: pd.Series) -> pd.Series:
        return texts.map(
            lambda t: None if t is None else t.encode("latin-1", "ignore").decode(charset, "replace")
        )

    return redecode


def encoding_repair(text: Column, charset: str) -> Column:
    """Suspect text is taken back to its Latin-1 bytes and decoded as ``charset``.

    UTF-8 stays in the JVM. Other charsets are unknown to Spark's ``decode``, so
    those go through an Arrow batch that only carries the suspect texts.
    """
    suspect = encoding_suspect(text)
    if charset.lower().replace("_", "-") in ("utf-8", "utf8"):
        raw = F.encode(F.regexp_replace(text, r"[^\x00-\xff]", ""), "ISO-8859-1")
        return F.when(suspect, F.make_valid_utf8(raw.cast("string"))).otherwise(text)
    only_suspect = F.when(suspect, text)
    return F.coalesce(_redecoder(charset)(only_suspect), text)
