"""Text extraction from HTML with regular expressions and array functions.

The tables hold well-formed pages. Markup that a browser would repair (an
element that is never closed, say) is taken as it stands.
"""

from __future__ import annotations

import json
from html.entities import name2codepoint

from pyspark.sql import Column, functions as F

from pageloom.functions.text import SPACE, strip
from pageloom.schema import NO_TITLE

# Elements whose whole subtree is not page text (meta and link hold no text); those in RAW also hide comments.
DROPPED = ("nav", "footer", "header")
RAW = ("script", "style")

# Where an article body sits, best place first. A leading dot
# names a class, otherwise it is an element.
ARTICLE_SELECTORS = (".Post-RichText", ".RichText", ".AuthorInfo", "article")
CLASS_ELEMENTS = ("div", "section", "article", "main", "span", "p")

_NODE_BREAK = "\x01"


def _subtrees(tags: tuple[str, ...]) -> str:
    """Elements with all they hold, without the '<' they begin with."""
    return "|".join(rf"{tag}(?:[\s/][^>]*)?>.*?</{tag}\s*>" for tag in tags)


# Comments and raw elements go in one pass: whichever opens first hides the other.
_HIDDEN = rf"(?is)<(?:!--.*?-->|{_subtrees(RAW)})"
_BLOCKS = rf"(?is)<(?:{_subtrees(DROPPED)})"
# Their tags alone; the name has to end there.
_BLOCK_TAG_OPEN = rf"(?i)<(?:{'|'.join(DROPPED)})(?=[\s/>])"
_BLOCK_TAG_CLOSE = rf"(?i)</(?:{'|'.join(DROPPED)})(?=[\s/>])"
_BLOCK_TAG = rf"(?i)</?(?:{'|'.join(DROPPED)})(?=[\s/>])"
# A tag, with quoted attribute values that may hold '>'; a tag with a stray quote ends at the first '>'.
_TAG = r"""<[A-Za-z/!?](?:(?:[^'">]++|"[^"]*+"|'[^']*+')*+>|[^>]*>)"""
_TITLE = r"(?is)<title(?:\s[^>]*)?>(.*?)</title\s*>"
_ENTITY_PIECES = r"&#?[A-Za-z0-9]+;|[^&]+|&"


def _named_entities() -> Column:
    table = {name: chr(code) for name, code in name2codepoint.items()} | {"apos": "'"}
    return F.from_json(F.lit(json.dumps(table)), "map<string,string>")


def _code_point(number: Column) -> Column:
    """The character with this code; NULL outside the Unicode range."""
    valid = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
    return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))


def _entity(piece: Column) -> Column:
    dec = F.regexp_extract(piece, r"^&#([0-9]{1,8});$", 1)
    hexa = F.regexp_extract(piece, r"^&#[xX]([0-9A-Fa-f]{1,6});$", 1)
    known = F.coalesce(
        _code_point(F.when(dec != "", dec.cast("bigint"))),
        _code_point(F.when(hexa != "", F.conv(hexa, 16, 10).cast("bigint"))),
        F.element_at(_named_entities(), F.substring_index(F.substring(piece, 2, 40), ";", 1)),
    )
    return F.coalesce(known, piece)


def decode_entities(text: Column) -> Column:
    """Replace character references in one pass, so a decoded '&' starts no new one."""
    pieces = F.regexp_extract_all(text, F.lit(_ENTITY_PIECES), F.lit(0))
    decoded = F.transform(pieces, lambda p: F.when(p.startswith("&"), _entity(p)).otherwise(p))
    return F.when(F.instr(text, "&") > 0, F.array_join(decoded, "")).otherwise(text)


def html_title_extract(html: Column) -> Column:
    """The page's title, or the text for an untitled page."""
    title = strip(decode_entities(F.regexp_extract(html, _TITLE, 1)))
    return F.when(F.coalesce(title, F.lit("")) == "", F.lit(NO_TITLE)).otherwise(title)


def _depth_after(depth: Column, closes: Column) -> Column:
    """A closing tag without an open element closes nothing."""
    return F.when(closes, F.greatest(depth - F.lit(1), F.lit(0))).otherwise(depth + F.lit(1))


def _is_plain(html: Column) -> Column:
    """Whether dropped elements all close and none lies in another; looks at their tags only."""
    tags = F.regexp_extract_all(html, F.lit(_BLOCK_TAG), F.lit(0))

    def step(acc: Column, tag: Column) -> Column:
        closes = tag.startswith("</")
        depth = _depth_after(acc["depth"], closes)
        odd = acc["odd"] | (depth > 1) | (closes & (acc["depth"] == 0)) | (closes & (F.lower(F.substring(tag, 3, 10)) != acc["open"]))
        now = F.when(closes, F.lit("")).otherwise(F.lower(F.substring(tag, 2, 10)))
        return F.struct(depth.cast("int").alias("depth"), odd.alias("odd"), now.alias("open"))

    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("odd"), F.lit("").alias("open"))
    return F.aggregate(tags, start, step, lambda acc: ~acc["odd"] & (acc["depth"] == 0))


def _outside_blocks(html: Column) -> Column:
    """What lies outside dropped elements, by one run over their tags with a depth; an element that never closes ends with the page."""
    pieces = F.split(html, rf"(?={_BLOCK_TAG})")

    def step(acc: Column, piece: Column) -> Column:
        closes, opens = piece.rlike(rf"^{_BLOCK_TAG_CLOSE}"), piece.rlike(rf"^{_BLOCK_TAG_OPEN}")
        tag = closes | opens
        depth = F.when(tag, _depth_after(acc["depth"], closes)).otherwise(acc["depth"])
        rest = F.when(closes, F.regexp_replace(piece, r"^[^>]*>?", "\n")).otherwise(piece)
        kept = F.when(depth > 0, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(rest)))
        return F.struct(depth.cast("int").alias("depth"), kept.alias("kept"))

    start = F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("kept"))
    return F.aggregate(pieces, start, step, lambda acc: F.array_join(acc["kept"], ""))


def html_text_extract(html: Column) -> Column:
    """All text outside the dropped elements, one line break between text nodes.

    Elements that stand alone and close are taken out by a pattern. Where they are nested, crossed or never closed, a run over their tags keeps the depth.
    """
    text = F.regexp_replace(html, _HIDDEN, "\n")
    text = F.when(_is_plain(text), F.regexp_replace(text, _BLOCKS, "\n")).otherwise(_outside_blocks(text))
    return decode_entities(F.regexp_replace(text, _TAG, "\n"))


def _body_from(tail: Column, tag: str) -> Column:
    """Part of ``tail`` up to the close of the element it starts in; all of it when never closed.

    The fold carries three numbers only, so its cost is linear in the page.
    """
    pieces = F.split(tail, rf"(?i)(?=</?{tag}[\s/>])")

    def step(acc: Column, piece: Column) -> Column:
        move = (
            F.when(piece.rlike(rf"(?is)^</{tag}[\s/>]"), -1)
            .when(piece.rlike(rf"(?is)^<{tag}[\s/>]"), 1)
            .otherwise(0)
        )
        depth = F.when(acc["depth"] > 0, acc["depth"] + move).otherwise(0)
        grown = F.when(depth > 0, acc["size"] + F.length(piece)).otherwise(acc["size"])
        return F.struct(depth.cast("int").alias("depth"), grown.cast("int").alias("size"))

    start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("size"))
    return F.left(tail, F.aggregate(pieces, start, step, lambda acc: acc["size"]))


def _selected(html: Column, selector: str) -> Column:
    """Markup inside the first element the selector matches; NULL when there is none."""
    if selector.startswith("."):
        tags = CLASS_ELEMENTS
        attributes = rf"""\s(?:[^>]*\s)?class\s*=\s*["'](?:[^"'>]*\s)?{selector[1:]}(?:\s[^"'>]*)?["'][^>]*"""
    else:
        tags = (selector,)
        attributes = r"(?:\s[^>]*)?"
    found = []
    for tag in tags:
        opening = rf"(?is)^.*?<{tag}{attributes}>"
        tail = F.regexp_replace(html, opening, "")
        found.append(F.when(html.rlike(rf"(?is)<{tag}{attributes}>"), _body_from(tail, tag)))
    return F.coalesce(*found)


def article_extract(html: Column, selectors=ARTICLE_SELECTORS, strip_nodes: bool = True) -> Column:
    """Text of the first selector that matches, else of the whole page.

    With ``strip_nodes`` every text node is stripped before the nodes are joined
    without a separator; otherwise the nodes are joined as they are.
    """
    visible = F.regexp_replace(html, _HIDDEN, _NODE_BREAK)
    markup = F.coalesce(*[_selected(visible, s) for s in selectors], visible)
    if not strip_nodes:
        return decode_entities(F.translate(F.regexp_replace(markup, _TAG, ""), _NODE_BREAK, ""))
    text = decode_entities(F.regexp_replace(markup, _TAG, _NODE_BREAK))
    return strip(F.regexp_replace(text, rf"(?<!{SPACE}){SPACE}*+{_NODE_BREAK}[{_NODE_BREAK}{SPACE[1:]}*+", ""))
