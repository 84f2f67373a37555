"""Text clean-up as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Everything that counts as white space in Unicode text, not only ASCII blanks.
SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
_BLANK = r"[\s\x0b\x1c-\x1f\x85\p{Z}&&[^\n]]"


def strip(text: Column) -> Column:
    """Drop white space at both ends.

    A run inside the text is looked at once, from its first sign: the look-behind keeps the search from starting again in its middle.
    """
    return F.regexp_replace(text, rf"^{SPACE}++|(?<!{SPACE}){SPACE}++\z", "")


def is_blank(text: Column) -> Column:
    """True for NULL, empty and white-space-only text."""
    return F.coalesce(strip(text) == "", F.lit(True))


def clean_text(text: Column) -> Column:
    """Strip every line and drop the empty ones.

    A run of white space that holds a line break always ends up as exactly one
    line break, so the work is one replacement and a strip of the whole.
    """
    return strip(F.regexp_replace(text, rf"(?<!{_BLANK}){_BLANK}*+\n{SPACE}*+", "\n"))


def cut(text: Column, max_chars: int | None) -> Column:
    """Text over ``max_chars`` characters keeps that many and ends in dots; without a limit it stays whole."""
    if max_chars is None:
        return text
    return F.when(F.length(text) > max_chars, F.concat(F.left(text, F.lit(max_chars)), F.lit("..."))).otherwise(text)


def content_hash(content: Column) -> Column:
    """sha256 hex of the UTF-8 bytes."""
    return F.sha2(content, 256)


def composite_text(title: Column, content: Column, summary: Column) -> Column:
    """The text that plain searches run on."""
    parts = [F.coalesce(c, F.lit("")) for c in (title, content, summary)]
    return F.concat(parts[0], F.lit(" "), parts[1], F.lit(" "), parts[2])
