"""From text to terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# What a token is (letters, digits and underscores, with single
# dots inside), the shortest term, and the words left out. The pattern never
# gives back what it took, which halves the time it needs.
TOKEN = r"[\p{L}\p{N}_]++(?:\.[\p{L}\p{N}_]++)*+"
MIN_LENGTH = 2
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "can", "for", "from", "have", "if", "in", "is", "it", "may",
    "not", "of", "on", "or", "tbd", "that", "the", "this", "to", "us", "we", "when", "will", "with", "yet", "you",
    "your",
)


def is_kept(token: Column, stop_words, min_length: int) -> Column:
    long_enough = F.length(token) >= min_length
    return long_enough & ~token.isin(*stop_words) if stop_words else long_enough


def tokens(text: Column, stop_words=STOP_WORDS, min_length: int = MIN_LENGTH) -> Column:
    """Terms of a text in order; NULL text has none."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))
    return F.filter(found, lambda t: is_kept(t, stop_words, min_length))


def analyze_text(df: DataFrame, text: str, stop_words=STOP_WORDS, min_len: int = MIN_LENGTH) -> DataFrame:
    """A row per term of the column ``text``: ``term`` and its ``position`` among the kept terms.

    The other columns stay, the text does not.
    """
    rest = [c for c in df.columns if c != text]
    return df.select(*rest, F.posexplode(tokens(F.col(text), stop_words, min_len)).alias("position", "term"))


def query_terms(queries: DataFrame, stop_words=STOP_WORDS, min_len: int = MIN_LENGTH) -> DataFrame:
    """``(query_id, text)`` to ``(query_id, ord, term, maxdist, n_terms)``.

    ``term~k`` allows k edits, a bare ``~`` one. Words go through the same
    analysis as documents.
    """
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(f"{TOKEN}(?:~[0-9]?)?"), F.lit(0))
    parsed = F.transform(
        words,
        lambda w: F.struct(
            F.regexp_extract(w, "^[^~]+", 0).alias("term"),
            F.when(F.instr(w, "~") == 0, 0)
            .when(w.endswith("~"), 1)
            .otherwise(F.right(w, F.lit(1)).cast("int"))
            .alias("maxdist"),
        ),
    )
    kept = F.filter(parsed, lambda p: is_kept(p["term"], stop_words, min_len))
    return (
        queries.select("query_id", kept.alias("_terms"))
        .select("query_id", F.size("_terms").alias("n_terms"), F.posexplode("_terms").alias("ord", "_term"))
        .select("query_id", "ord", "_term.term", "_term.maxdist", "n_terms")
    )
