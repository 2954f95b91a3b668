"""Canonical URLs and the exact-duplicate key, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .hosts import let, tidied, web_host, web_path, web_port, web_query
from .text import col, js_trim

# Query parameters that never identify a listing.
TRACKING = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id",
    "gclid", "fbclid", "msclkid", "dclid",
    "ref", "referrer", "source", "src", "cid", "mc_cid", "mc_eid",
    "campaign", "trk", "trkCampaign", "sid", "session", "token",
    "se", "v", "utm", "p", "pos",
)


#: What url_encode writes differently than a path does; the percent sign comes last.
_PATH_KEEPS = "/!$&'(),:;=@~[]|^"
_PATH_PLAIN = r"^[\x21\x23-\x3b\x3d\x3f-\x5b\x5d-\x5f\x61-\x7a\x7c\x7e]*$"


def form_decode(c: Column) -> Column:
    """A query's name or value without its escapes; a percent sign that starts none stays."""
    mended = F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25")
    return F.when(c.rlike("[%+]"), F.url_decode(mended)).otherwise(c)


def _escaped(x: Column) -> Column:
    coded = F.replace(F.replace(F.url_encode(x), F.lit("+"), F.lit("%20")), F.lit("%2B"), F.lit("+"))
    for c in _PATH_KEEPS:
        coded = F.replace(coded, F.lit(f"%{ord(c):02X}"), F.lit(c))
    return F.when(x.rlike(_PATH_PLAIN), x).otherwise(F.replace(coded, F.lit("%25"), F.lit("%")))


def _resolved(x: Column) -> Column:
    dot, up = r"(?i)^(?:\.|%2e)$", r"(?i)^(?:\.|%2e){2}$"
    none = F.array().cast("array<string>")
    parts = F.slice(F.split(x, "/"), 2, 1 << 30)
    # a last segment that vanishes leaves an empty one, so that the slash before it stays
    parts = F.concat(parts, F.when(x.rlike(r"(?i)/(?:\.|%2e){1,2}$"), F.array(F.lit(""))).otherwise(none))
    pop = lambda a: F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))
    kept = F.aggregate(parts, none, lambda a, s: F.when(s.rlike(up), pop(a)).when(s.rlike(dot), a).otherwise(F.concat(a, F.array(s))))
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def clean_path(path: Column) -> Column:
    """A path as it is sent: characters that no path may hold are escaped, existing escapes
    stay, backslashes are slashes, and segments ``.`` and ``..`` are resolved."""
    return let(path, _clean)


def _clean(path: Column) -> Column:
    dots = r"(?i)/(?:\.|%2e){1,2}(?:/|$)"
    tidy = path.rlike(_PATH_PLAIN) & ~path.rlike(dots)
    mended = let(_escaped(F.replace(path, F.lit("\\"), F.lit("/"))), lambda x: F.when(x.rlike(dots), _resolved(x)).otherwise(x))
    return F.when(path == "", "/").when(tidy, path).otherwise(mended)


def canonical_url(raw: str | Column) -> Column:
    """https, the host as clients read it (punycode, lower case) without ``www.``, no
    fragment, no tracking parameters, the other parameters sorted by name, no slash before
    the query or the end.  Tabs and line breaks inside are no part of a URL.

    What isn't a web URL with a host becomes its trimmed lower-case text; null stays null.
    """
    given = js_trim(raw)
    return F.coalesce(let(tidied(given), _canonical), F.lower(given))


def _canonical(x: Column) -> Column:
    """Null without a host."""
    # one slash before the query or the end goes, but the bare root keeps its own
    tail = F.regexp_replace(clean_path(web_path(x)), "(?<=.)/$", "")
    pairs = F.filter(F.split(web_query(x), "&"), lambda p: p != "")
    name = lambda p: form_decode(F.split_part(p, F.lit("="), F.lit(1)))
    value = lambda p: form_decode(F.when(p.contains("="), F.regexp_replace(p, "^[^=]*=", "")).otherwise(""))
    # stable by name: the position breaks ties; '?a' is written '?a='
    keyed = F.transform(pairs, lambda p, i: F.struct(name(p).alias("k"), i.alias("i"), value(p).alias("v")))
    kept = F.filter(keyed, lambda s: ~(s["k"].isin(*TRACKING) | F.lower(s["k"]).startswith("utm_")))
    query = F.array_join(F.transform(F.array_sort(kept), lambda s: F.concat(F.url_encode(s["k"]), F.lit("="), F.url_encode(s["v"]))), "&")
    asked = let(query, lambda q: F.when(q == "", "").otherwise(F.concat(F.lit("?"), q)))
    return F.concat(F.lit("https://"), F.regexp_replace(web_host(x), r"^www\.(?=.)", ""), web_port(x, secure=True), tail, asked)


def dedupe_hash(raw: str | Column) -> Column:
    return F.sha2(canonical_url(raw), 256)


def link_host(url: str | Column) -> Column:
    return F.coalesce(F.regexp_replace(web_host(tidied(js_trim(url))), r"^www\.(?=.)", ""), F.lit("the listing"))


__all__ = ["TRACKING", "canonical_url", "col", "dedupe_hash", "link_host"]
