"""Career pages: which URLs may be read, what robots rules allow, and the postings that
a page declares as JSON-LD."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hosts import let, tidied, web_host, web_origin, web_path
from ..functions.text import escape_re, html_to_text
from ..functions.urls import clean_path

# Boards that are never fetched, with all their subdomains.
BLOCKED_DOMAINS = (
    "seek.com.au", "seek.co.nz", "seek.com", "linkedin.com", "indeed.com", "au.indeed.com", "glassdoor.com", "glassdoor.com.au",
    "ziprecruiter.com", "monster.com", "careerone.com.au", "jora.com", "adzuna.com.au", "jooble.org",
)
# Names and address ranges (RFC 1918, loopback, link-local) that are never fetched.
PRIVATE_NAMES = ("localhost", "0.0.0.0", "::1")
PRIVATE_SUFFIXES = (".localhost", ".internal", ".local")
PRIVATE_RANGES = r"^(?:127|10)\.|^192\.168\.|^172\.(?:1[6-9]|2\d|3[01])\.|^169\.254\."
#: Characters of a page that are read.
MAX_HTML = 4_000_000


def blocked_reason(url: Column, domains: tuple[str, ...] = BLOCKED_DOMAINS) -> Column:
    """Why a URL isn't fetched, null if it may be.

    The host is the one that a client would connect to, however it is written.  What can't
    be parsed, or whose host isn't known for sure, is blocked."""
    x = tidied(url)
    scheme = F.coalesce(F.lower(F.regexp_extract(x, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)), F.lit(""))

    def judged(raw: Column) -> Column:
        host = F.regexp_replace(raw, r"\.$", "")
        listed = F.lit(None).cast("string")
        for d in reversed(domains):
            listed = F.when((host == d) | host.endswith("." + d), F.lit(f"{d} is a job board")).otherwise(listed)
        private = host.isin(*PRIVATE_NAMES) | host.startswith("[") | host.rlike(PRIVATE_RANGES)
        for suffix in PRIVATE_SUFFIXES:
            private |= host.endswith(suffix)
        return F.when(raw.isNull(), "not a valid absolute URL").when(listed.isNotNull(), listed).when(private, "private or loopback address")

    other = F.when(scheme == "", "not a valid absolute URL").when(~scheme.isin("http", "https"), F.concat(F.lit('unsupported scheme "'), scheme, F.lit(':"')))
    return F.coalesce(other, let(web_host(x), judged))


def robots_rules(text: str, agent: str) -> tuple[list[tuple[bool, str]], float | None]:
    """(allow, path) rules of the group for an agent, and its crawl delay.

    Consecutive user-agent lines share the rules that follow; the first named group that
    the agent's name contains wins over ``*``; an empty Disallow is no rule."""
    groups: dict[str, dict] = {}
    names: list[str] = []
    in_rules = False
    for raw in text.splitlines():
        field, colon, value = raw.split("#", 1)[0].strip().partition(":")
        field, value = field.strip().lower(), value.strip()
        if not colon:
            continue
        if field == "user-agent":
            names = [*([] if in_rules else names), value.lower()]
            in_rules = False
            continue
        if not names:
            continue
        in_rules = True
        own = [groups.setdefault(n, {"rules": [], "delay": None}) for n in names] if field in ("allow", "disallow", "crawl-delay") and (value or field == "allow") else []
        for g in own:
            if field == "crawl-delay":
                if re.fullmatch(r"\d+(\.\d+)?", value):
                    g["delay"] = float(value)
            else:
                g["rules"].append((field == "allow", value))
    low = agent.lower()
    chosen = next((g for n, g in groups.items() if n != "*" and n in low), groups.get("*"))
    return (chosen["rules"], chosen["delay"]) if chosen else ([], None)


def robots_pattern(path: str) -> str:
    """A rule's path as a regular expression: ``*`` is any run, a final ``$`` an anchor."""
    anchored = path.endswith("$")
    body = ".*".join(escape_re(p) for p in (path[:-1] if anchored else path).split("*"))
    return f"^{body}{'$' if anchored else ''}"


RULES = "array<struct<size: int, allow: boolean, pattern: string>>"


def robots_by_origin(fetched: DataFrame, agent: str) -> DataFrame:
    """(origin, readable, rules, crawl_delay) of robots files (origin, status, body), one a row.

    Client errors mean no rules; server errors, and no status or body at all, mean that the
    site may not be read.  One row an origin, so each file is parsed once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for origin, body in zip(pdf["origin"], pdf["body"], strict=True):
                rules, delay = robots_rules(body, agent) if isinstance(body, str) else ([], None)
                rows.append((origin, [(len(p), a, robots_pattern(p)) for a, p in rules], delay))
            yield pd.DataFrame(rows, columns=["origin", "rules", "crawl_delay"])

    readable = F.coalesce((F.col("status") < 400) & F.col("body").isNotNull() | F.col("status").between(400, 499), F.lit(False))
    kept = fetched.select("origin", readable.alias("readable"), F.when(F.col("status") < 400, F.col("body")).alias("body"))
    parsed = kept.where("body IS NOT NULL").select("origin", "body").mapInPandas(run, f"origin string, rules {RULES}, crawl_delay double")
    return kept.drop("body").join(parsed, "origin", "left")


def read_verdict(pages: DataFrame, robots: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with ``refusal``, why a page may not be read, null if it may, and the
    ``crawl_delay`` of its site in seconds.

    Denied hosts come first, then the robots rules of the page's origin, of which the
    longest that fits decides, Allow on ties.  An origin without a robots row is unread.
    Origins are compared as clients see them: ports that go without saying, letters' case
    and hosts in other notations make no difference."""
    x = tidied(F.col(url))
    asked = pages.withColumns({"_blocked": blocked_reason(F.col(url)), "_path": clean_path(web_path(x)), "_origin": web_origin(F.col(url))})
    rules = robots.select(web_origin(F.col("origin")).alias("_site"), F.col("readable").alias("_readable"), F.col("rules").alias("_rules"), F.col("crawl_delay").alias("_delay"))
    # several spellings of one origin: the strictest file decides
    rules = rules.where("_site IS NOT NULL").groupBy("_site").agg(F.min("_readable").alias("_readable"), F.flatten(F.collect_list("_rules")).alias("_rules"), F.max("_delay").alias("_delay"))
    x = asked.join(rules, F.col("_origin") == F.col("_site"), "left")
    fits = F.filter(F.coalesce("_rules", F.array().cast(RULES)), lambda r: F.rlike(F.col("_path"), r["pattern"]))
    allowed = F.coalesce(F.array_max(F.transform(fits, lambda r: F.struct(r["size"].alias("size"), r["allow"].alias("allow"))))["allow"], F.lit(True))
    refusal = (
        F.when(F.col("_blocked").isNotNull(), F.col("_blocked"))
        .when(~F.coalesce("_readable", F.lit(False)), "robots.txt could not be read, so fetching is not permitted")
        .when(~allowed, F.concat(F.lit("robots.txt disallows "), F.col("_path")))
    )
    return x.select(*pages.columns, refusal.alias("refusal"), F.when(F.col("_blocked").isNull(), F.col("_delay")).alias("crawl_delay"))


def read_pages(pages: DataFrame, robots: DataFrame, key: str = "page_id") -> DataFrame:
    """Every career page's outcome, from the cheapest refusal on: (key, url, reason, status,
    crawl_delay, html).  ``pages``: key, url, and what a fetch would give or gave: status,
    landed_url (after redirects, null for the same), html and error.

    ``reason`` is null for a page that was read; only such a page has ``html``, its first
    MAX_HTML characters, and ``url`` is then where it was found.  A page that redirects to a
    denied host is refused."""
    x = read_verdict(pages, robots)
    landed = F.coalesce("landed_url", "url")
    moved = F.when(F.col("landed_url").isNotNull(), blocked_reason(F.col("landed_url")))
    reason = (
        F.when(F.col("refusal").isNotNull(), F.col("refusal"))
        .when(F.col("error").isNotNull(), F.col("error"))
        .when(~F.coalesce(F.col("status").between(200, 299), F.lit(False)), F.concat(F.lit("HTTP "), F.coalesce(F.col("status").cast("string"), F.lit("0"))))
        .when(moved.isNotNull(), F.concat(F.lit("redirected to a blocked host: "), moved))
    )
    x = x.withColumn("reason", reason)
    read = F.col("reason").isNull()
    asked = F.col("refusal").isNull()
    return x.select(
        key, F.when(read, landed).otherwise(F.col("url")).alias("url"), "reason", F.when(asked & F.col("error").isNull(), F.col("status")).alias("status"), "crawl_delay",
        F.when(read, F.substring(F.coalesce("html", F.lit("")), 1, MAX_HTML)).alias("html"),
    )


def page_outcomes(read: DataFrame, postings: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, reason, status, crawl_delay, n_postings, needs_rendering) of ``read_pages`` and
    the postings found there: a page without any would have to be rendered, or is an index."""
    n = postings.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    n_postings = F.coalesce("n", F.lit(0))
    return read.drop("html", "url").join(n, key, "left").select(key, "reason", "status", "crawl_delay", n_postings.alias("n_postings"), F.when(F.col("reason").isNull(), n_postings == 0).alias("needs_rendering"))


def robots_allow(path: Column, rules: list[tuple[bool, str]]) -> Column:
    """The longest rule that matches decides, Allow on ties; without one, allowed."""
    best = F.lit(True)
    for allow, rule in sorted(rules, key=lambda r: (len(r[1]), r[0])):
        best = F.when(path.rlike(robots_pattern(rule)), F.lit(allow)).otherwise(best)
    return best


# How a page declares JSON-LD.
_SCRIPT = re.compile(r"<script\b[^>]*type\s*=\s*[\"']application/ld\+json[\"'][^>]*>(.*?)</script>", re.IGNORECASE | re.DOTALL)
_CONTROL = re.compile(r"[\x00-\x1f]")
#: Dates of other years are no dates: nanoseconds since 1970 don't reach them.
YEARS = range(1678, 2262)
POSTING = "position int, title string, company string, description_html string, url string, location_raw string, posted_date timestamp, employment_type string, salary_min double, salary_max double, salary_currency string"


def _text(v) -> str | None:
    if isinstance(v, str):
        return v.strip() or None
    if isinstance(v, bool) or not isinstance(v, (int, float)):
        return None
    return str(int(v)) if isinstance(v, int) or v.is_integer() else str(v)


def _number(v) -> float | None:
    if isinstance(v, bool) or not isinstance(v, (str, int, float)):
        return None
    try:
        n = float(v) if str(v).strip() else 0.0
    except (ValueError, OverflowError):
        return None
    return n if abs(n) != float("inf") and n == n else None


def _first(v):
    return (v[0] if v else None) if isinstance(v, list) else v


def _get(v, key: str):
    return v.get(key) if isinstance(v, dict) else None


def find_postings(node, depth: int = 0) -> Iterator[dict]:
    """Job postings in document order, through lists, @graph, itemListElement and item."""
    if depth > 6 or not node:
        return
    if isinstance(node, list):
        for x in node:
            yield from find_postings(x, depth + 1)
    elif isinstance(node, dict):
        kinds = node.get("@type")
        if any(isinstance(k, str) and k.lower() == "jobposting" for k in (kinds if isinstance(kinds, list) else [kinds])):
            yield node
        for key in ("@graph", "itemListElement", "item"):
            yield from find_postings(node.get(key), depth + 1)


def _place(p: dict) -> str | None:
    where = _first(p.get("jobLocation"))
    if not where:
        return "Remote" if _text(p.get("jobLocationType")) else None
    address = _get(where, "address") or where
    if isinstance(address, str):
        return address
    country = _get(address, "addressCountry")
    parts = [*(_text(_get(address, k)) for k in ("streetAddress", "addressLocality", "addressRegion", "postalCode")), _text(country) or _text(_get(country, "name"))]
    return ", ".join(x for x in parts if x) or None


def _date(v) -> datetime | None:
    raw = _text(v)
    try:
        d = datetime.fromisoformat(raw.replace("Z", "+00:00")) if raw else None
        d = d if d is None else d.replace(tzinfo=UTC) if d.tzinfo is None else d.astimezone(UTC)
    except (ValueError, OverflowError):
        return None
    return d if d is not None and d.year in YEARS else None


def _link(base: str, link: str | None) -> str | None:
    """None if the link can't be joined with its page's URL."""
    try:
        return urljoin(base, link) if link else None
    except ValueError:
        return None


def postings_of(html: str, page_url: str) -> list[tuple]:
    """Postings of a page, the first of each (title, url); a bad block is skipped."""
    out, seen = [], set()
    for block in _SCRIPT.findall(html or ""):
        try:
            found = list(find_postings(json.loads(_CONTROL.sub(" ", block))))
        except (ValueError, RecursionError):
            continue
        for p in found:
            title = _text(p.get("title")) or _text(p.get("name"))
            if not title:
                continue
            link = _text(p.get("url")) or _text(p.get("sameAs"))
            link = _link(page_url or "", link)
            key = (title.lower(), link or "")
            if key in seen:
                continue
            seen.add(key)
            org, pay = p.get("hiringOrganization"), p.get("baseSalary")
            value = _get(pay, "value")
            value = value if isinstance(value, dict) else pay
            single = _number(_get(value, "value"))
            low, high = _number(_get(value, "minValue")), _number(_get(value, "maxValue"))
            company = org if isinstance(org, str) else _text(_get(org, "name")) or _text(_get(org, "legalName"))
            out.append((len(out), title, company, _text(p.get("description")), link, _place(p), _date(p.get("datePosted")), _text(_first(p.get("employmentType"))),
                        single if low is None else low, single if high is None else high, _text(_get(pay, "currency")) or _text(_get(value, "currency"))))
    return out


def extract_postings(pages: DataFrame, key: str = "page_id", html: str = "html", url: str = "url") -> DataFrame:
    """One row per posting of each page with an allowed URL, from its first MAX_HTML characters.

    The walk through JSON of any shape is a Python generator; text clean-up is native."""
    from ..functions.text import _html_entities as entities

    names = [f.split()[0] for f in POSTING.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, *r) for k, h, u in zip(pdf[key], pdf["_html"], pdf["_url"], strict=True) for r in postings_of(h, u)]
            yield pd.DataFrame(rows, columns=[key, *names])

    kind = dict(pages.dtypes)[key]
    # rows without the marker never reach Python
    some = pages.withColumn("_html", F.substring(F.col(html), 1, MAX_HTML)).where(F.lower("_html").contains("ld+json") & blocked_reason(F.col(url)).isNull())
    out = some.select(key, "_html", F.col(url).alias("_url")).mapInPandas(run, f"{key} {kind}, {POSTING}")
    tidy = lambda c: entities(F.col(c))
    return out.withColumns({"title": tidy("title"), "company": F.when(F.col("company").isNotNull(), tidy("company")), "description": F.when(F.col("description_html").isNotNull(), html_to_text("description_html"))}).drop("description_html")
