"""URL checks and canonical forms as Column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from beaconry.constants import MAX_URL_LENGTH

# RFC 3986 appendix B split: scheme, authority, path, query.
_PARTS = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, _PARTS, group)


def _port_ok(authority: Column) -> Column:
    port = F.regexp_extract(authority, r":([^:\]]*)$", 1)
    in_range = F.coalesce(port.try_cast("int"), F.lit(-1)).between(0, 65535)
    return (port == "") | (port.rlike(r"^\d{1,5}$") & in_range)


def _host(authority: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[^:\]]*$", "")


# A plain host without user and port and a path of plain letters: one look tells that the parts are fine.
_PLAIN = r"^https?://[A-Za-z0-9][A-Za-z0-9.-]*(?:/[\x21-\x7e]*)?\z"


def is_http_url(url: Column) -> Column:
    """Scheme http/https and a host; the weaker check used for signals and sources."""
    authority = _part(url, 2)
    by_parts = F.coalesce(
        F.lower(_part(url, 1)).isin("http", "https") & (_host(authority) != "") & _port_ok(authority),
        F.lit(False))
    return F.when(url.rlike(_PLAIN), True).otherwise(by_parts)


def signal_url(raw: Column) -> Column:
    """Trimmed URL when acceptable as a signal link, else null."""
    url = F.trim(raw)
    ok = (F.length(url) <= MAX_URL_LENGTH) & ~url.rlike(r"[\x00-\x1f]") & is_http_url(url)
    return F.when(ok, url)


def safe_url(raw: Column, fallback: Column) -> Column:
    """URL that is safe to show as a link; anything else gives the fallback."""
    url = F.trim(raw)
    authority = _part(url, 2)
    ok = (
        (F.length(url) <= MAX_URL_LENGTH)
        & ~url.rlike(r"[\x00-\x20\\\s]")
        & is_http_url(url)
        & ~F.contains(authority, F.lit("@"))
        & (F.regexp_replace(_host(authority), r"\.", "") != "")
    )
    return F.when(F.coalesce(ok, F.lit(False)), url).otherwise(fallback)


def _quote(text: Column) -> Column:
    # Java's encoder keeps '*' and encodes '~'; the canonical form does the opposite.
    return F.regexp_replace(F.regexp_replace(F.url_encode(text), r"\*", "%2A"), "%7E", "~")


def canonical_url(raw: Column) -> Column:
    """Lower-case scheme and host, no trailing slash, fragment, tracking or blank parameters."""
    url = F.trim(raw)
    path = F.regexp_replace(_part(url, 3), r"/+$", "")
    pairs = F.filter(
        F.split(_part(url, 4), "&"),
        lambda pair: pair.rlike(r"^[^=]*=.+$") & ~F.lower(pair).startswith("utm_"))
    encoded = F.transform(pairs, lambda pair: F.concat(
        _quote(F.coalesce(F.try_url_decode(F.substring_index(pair, "=", 1)), F.substring_index(pair, "=", 1))),
        F.lit("="),
        _quote(F.coalesce(F.try_url_decode(F.regexp_replace(pair, r"^[^=]*=", "")),
                          F.regexp_replace(pair, r"^[^=]*=", "")))))
    query = F.array_join(encoded, "&")
    return F.concat(
        F.lower(_part(url, 1)), F.lit("://"), F.lower(_part(url, 2)),
        F.when(path == "", F.lit("/")).otherwise(path),
        F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)))


def signal_id(kind: Column, url: Column) -> Column:
    digest = F.sha1(F.concat(kind, F.lit(":"), canonical_url(url)).cast("binary"))
    return F.concat(F.lit("signal_"), F.substring(digest, 1, 12))
