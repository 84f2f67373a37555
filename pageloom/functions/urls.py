"""URL functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Scheme of parked tabs, pattern of a video address, sites that
# need a rendered page.
SUSPENDED_SCHEME = "chrome-extension://"
VIDEO_URL = r"^(?:https?://)?(?:www\.)?(?:youtube\.com/watch\?v=|youtu\.be/)([A-Za-z0-9_-]{11})"
RENDERED_SITES = ("zhihu.com",)
RENDERED, PLAIN = "selenium", "requests"
DECODE_ROUNDS = 5


def url_hash(url: Column) -> Column:
    """sha256 hex of the UTF-8 bytes."""
    return F.sha2(url, 256)


def _decode(text: Column) -> Column:
    """Query decoding; a '%' that starts no escape stays."""
    safe = F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(safe), text)


def suspended_url_rewrite(url: Column, max_rounds: int = DECODE_ROUNDS) -> Column:
    """The address a parked tab stands for; any other URL, and one that cannot be decoded, as it is."""
    query = F.regexp_extract(url, rf"^{SUSPENDED_SCHEME}[^?#]*\?([^#]*)", 1)
    first = F.regexp_extract(query, "(?:^|&)url=([^&]+)", 1)
    rounds = F.sequence(F.lit(1), F.lit(max_rounds))
    decoded = F.aggregate(
        rounds,
        _decode(first),
        lambda acc, _: F.when(F.instr(acc, "://") > 0, acc).otherwise(_decode(F.replace(acc, F.lit("+"), F.lit("%2B")))),
    )
    return F.when(
        url.startswith(SUSPENDED_SCHEME) & (F.instr(decoded, "://") > 0), decoded
    ).otherwise(url)


def video_id_extract(url: Column) -> Column:
    """The eleven-character video id, else NULL."""
    return F.nullif(F.regexp_extract(url, VIDEO_URL, 1), F.lit(""))


def site_route(url: Column, rendered_sites=RENDERED_SITES) -> Column:
    """How the page of this URL is obtained."""
    hit = F.lit(False)
    for site in rendered_sites:
        hit = hit | (F.instr(url, site) > 0)
    return F.when(hit, F.lit(RENDERED)).otherwise(F.lit(PLAIN))


def domain_extract(url: Column) -> Column:
    """Lower-cased network location without a leading ``www.``; empty when there is none.

    ``parse_url`` gives NULL for addresses with an odd character, so the
    location is cut out by pattern. Unbalanced brackets make it empty.
    """
    netloc = F.lower(F.regexp_extract(url, "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))
    balanced = (F.instr(netloc, "[") > 0) == (F.instr(netloc, "]") > 0)
    return F.when(balanced, F.regexp_replace(netloc, "^www[.]", "")).otherwise(F.lit(""))


def search_key(guid: Column, id_: Column, url: Column) -> Column:
    """First of guid and id that is present, else the stripped URL."""
    from pageloom.functions.text import strip
    from pageloom.schema import MISSING

    def present(c: Column) -> Column:
        return F.when(~c.isin("", MISSING), c)

    return F.coalesce(present(guid), present(id_), strip(F.coalesce(url, F.lit(""))))
