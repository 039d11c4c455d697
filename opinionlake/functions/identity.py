"""Stable identities: hashes, keyed pseudonyms, canonical URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinionlake import constants as C
from opinionlake.functions.text import casefold, normalize, strip_blank

_NUL = "\u0000"


def content_hash(*parts: Column) -> Column:
    """SHA-256 of the normalised parts joined by NUL; null counts as ''."""
    return F.sha2(F.concat_ws(_NUL, *[normalize(p.cast("string")) for p in parts]), 256)


def joined_hash(separator: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws(separator, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def subject_key(kind: Column, name: Column, address: Column) -> Column:
    folded = [casefold(strip_blank(F.coalesce(p, F.lit("")))) for p in (kind, name, address)]
    return F.sha2(F.concat_ws("|", *folded), 256)


def key_frame(spark, key: bytes) -> DataFrame:
    """The two padded HMAC keys as one row, so the secret is data and never plan text."""
    if len(key) < 32:
        raise ValueError("the author key needs at least 32 bytes")
    import hashlib

    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    row = (bytearray(b ^ 0x36 for b in block), bytearray(b ^ 0x5C for b in block))
    return spark.createDataFrame([row], "inner_pad binary, outer_pad binary")


def author_hash(keys: DataFrame, source: Column, author: Column) -> Column:
    """HMAC-SHA256(key, source NUL author); blank author gives null."""
    name = normalize(author)
    message = F.encode(F.concat(source, F.lit(_NUL), name), "UTF-8")
    inner = F.unhex(F.sha2(F.concat(keys.select("inner_pad").scalar(), message), 256))
    digest = F.sha2(F.concat(keys.select("outer_pad").scalar(), inner), 256)
    return F.when(name != "", digest)


# ---- URLs ---------------------------------------------------------------------------------
_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"
_HOST = r"^(?:([^@]*)@)?([^:@]*)(?::(\d*))?$"


def url_parts(url: Column) -> dict[str, Column]:
    """Scheme, user-info, host, port, path and query of an absolute URL ('' when absent)."""
    authority = F.regexp_extract(url, _PARTS, 2)
    return {
        "scheme": F.lower(F.regexp_extract(url, _PARTS, 1)),
        "has_user": F.contains(authority, F.lit("@")),
        "host": F.lower(F.regexp_extract(authority, _HOST, 2)),
        "port": F.regexp_extract(authority, _HOST, 3),
        "path": F.regexp_extract(url, _PARTS, 3),
        "query": F.regexp_replace(F.regexp_extract(url, _PARTS, 4), r"^\?", ""),
    }


_SAFE_URL = r"^(?i:https?)://(?:[^/?#@:\[\]]+|\[[^/?#@\]]+\])(?::\d*)?(?:[/?#].*)?$"


def safe_url(url: Column) -> Column:
    """The URL when it is http(s) with a host and no user-info, else null."""
    return F.when(url.rlike("(?s)" + _SAFE_URL), url)


# The whole article URL in one pattern: forum, number and query in groups 1 to 3.
_ARTICLE_URL = (
    r"^(?i:https://" + C.FORUM_HOST.replace(".", r"\.") + r")(?::(?:443)?)?/f/([A-Za-z0-9_-]+)/p/([0-9]+)/?(?:\?([^#]*))?(?:#.*)?$"
)


def _article(url: Column) -> Column:
    forum = F.lower(F.regexp_extract(url, _ARTICLE_URL, 1))
    number = F.regexp_replace(F.regexp_extract(url, _ARTICLE_URL, 2), r"^0+(?=\d)", "")
    return F.concat(F.lit(f"https://{C.FORUM_HOST}/f/"), forum, F.lit("/p/"), number)


def canonical_article(url: Column) -> Column:
    """struct(url, reason): the public article URL, or why it is refused."""
    trimmed = strip_blank(F.coalesce(url, F.lit("")))
    pairs = F.split(F.regexp_extract(trimmed, _ARTICLE_URL, 3), "&")
    tracking = F.forall(pairs, lambda pair: (pair == "") | pair.rlike(rf"(?i)^(utm_|({'|'.join(C.TRACKING_FIELDS)})(=|$))"))
    valid = trimmed.rlike(_ARTICLE_URL) & (F.length(F.regexp_extract(trimmed, _ARTICLE_URL, 1)) <= 64)
    reason = F.when(~valid, F.lit("not_a_public_article")).when(~tracking, F.lit("unknown_query_field"))
    return F.struct(F.when(valid & tracking, _article(trimmed)).alias("url"), reason.alias("reason"))


def discovered_article(href: Column, base: str = f"https://{C.FORUM_HOST}") -> Column:
    """A link found on a page, resolved against the site and canonicalised; null if foreign."""
    full = (
        F.when(href.startswith("//"), F.concat(F.lit("https:"), href))
        .when(href.startswith("/"), F.concat(F.lit(base), href))
        .otherwise(href)
    )
    return F.when(full.rlike(_ARTICLE_URL), _article(full))


def canonical_place(url: Column) -> Column:
    """Cut the query, the data segment and trailing slashes."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(url, r"(?s)\?.*$", ""), r"(?s)/data=.*$", ""), "/+$", "")


def place_allowed(url: Column) -> Column:
    p = url_parts(strip_blank(F.coalesce(url, F.lit(""))))
    on_site = p["host"].rlike(r"(^|\.)google\.com(\.tw)?$") & p["path"].startswith("/maps")
    return p["scheme"].isin("http", "https") & (on_site | p["host"].isin(*C.MAP_SHORT_HOSTS))
