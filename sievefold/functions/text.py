"""Text helpers whose results follow ECMAScript semantics on the JVM.

Java's ``\\s`` lacks the no-break space and its ``\\b`` is Unicode-aware, so white space
and word boundaries are spelled out.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ECMAScript white space, as the inside of a character class.
WS = r"\s\u000B   -     　﻿"
#: ASCII word boundaries.
B0, B1 = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def js_trim(c: str | Column) -> Column:
    return F.regexp_replace(col(c), rf"^[{WS}]+|[{WS}]+$", "")


def collapse(c: Column) -> Column:
    return js_trim(F.regexp_replace(c, rf"[{WS}]+", " "))


def escape_re(s: str) -> str:
    return re.sub(r"[.*+?^${}()|\[\]\\]", r"\\\g<0>", s)


def flexible(term: str, gap: str = rf"[{WS}-]*") -> str:
    """The term's words, joined by any run of white space and hyphens."""
    return gap.join(escape_re(w) for w in term.split())


def non_empty(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def number_text(c: Column) -> Column:
    """Shortest decimal form without a trailing ``.0``."""
    return F.regexp_replace(c.cast("string"), r"\.0$", "")


def normalise_name(c: str | Column) -> Column:
    return collapse(F.regexp_replace(F.lower(col(c)), "[.,]", " "))


# Filler words of titles.
_NOISE = "job|jobs|vacancy|vacancies|position|opportunity|opportunities|role|hiring|urgent|new|apply now|m/f/d"


def fingerprint_text(c: str | Column) -> Column:
    """Lower case, without filler words, only a-z and 0-9; null gives ''."""
    low = F.lower(F.coalesce(col(c), F.lit("")))
    bare = F.regexp_replace(low, f"{B0}(?:{_NOISE}){B1}", " ")
    return F.trim(F.regexp_replace(bare, "[^a-z0-9]+", " "))


def content_fingerprint(title: str | Column, company: str | Column) -> Column:
    """Identity across providers; the location doesn't enter."""
    return F.sha2(F.concat_ws("|", fingerprint_text(title), fingerprint_text(company)), 256)


def listing_text(title: str = "title", company: str = "company", description: str = "description") -> Column:
    return F.array_join(F.filter(F.array(title, company, description), lambda x: x != ""), "\n")


def decode_entities(c: Column) -> Column:
    """Named entities of provider teasers in one pass (so the ampersand goes last), a
    doubly encoded no-break space, and runs of blanks."""
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    c = F.replace(F.replace(c, F.lit("\u00c2\u00a0"), F.lit(" ")), F.lit("\u00a0"), F.lit(" "))
    return js_trim(F.regexp_replace(c, "[ \t]{2,}", " "))


def strip_html(c: Column) -> Column:
    return collapse(F.regexp_replace(c, "<[^>]+>", " "))


def html_to_text(c: str | Column) -> Column:
    """Readable text of an HTML page: entities are decoded before and after tags go,
    scripts and styles go whole, blocks end lines, list items start with a dash."""
    x = _html_entities(F.coalesce(col(c), F.lit("")))
    x = F.regexp_replace(x, r"(?is)<script\b[^>]*>.*?</script>", " ")
    x = F.regexp_replace(x, r"(?is)<style\b[^>]*>.*?</style>", " ")
    x = F.regexp_replace(x, r"(?i)<br\s*/?>", "\n")
    x = F.regexp_replace(x, r"(?i)</(?:p|div|li|h[1-6]|tr)>", "\n")
    x = F.regexp_replace(x, r"(?i)<li\b[^>]*>", "- ")
    x = _html_entities(F.regexp_replace(x, "<[^>]+>", " "))
    x = F.regexp_replace(x, "[ \t\u00a0]+", " ")
    x = F.regexp_replace(x, "\n{3,}", "\n\n")
    x = F.regexp_replace(x, "(?m)^[ \t]+|[ \t]+$", "")
    return js_trim(x)


def _html_entities(c: Column) -> Column:
    """Entities one after the other, ampersand first; numeric ones are UTF-16 units."""
    for a, b in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#039;", "'"), ("&apos;", "'"), ("&nbsp;", " ")):
        c = F.replace(c, F.lit(a), F.lit(b))
    parts = F.split(c, r"&#(?=\d+;)")

    def decoded(p: Column) -> Column:
        code = F.regexp_extract(p, r"^(\d+);", 1)
        unit = F.lpad(F.hex(F.pmod(F.coalesce(code.try_cast("bigint"), F.lit(0)), F.lit(65536))), 4, "0")
        return F.concat(F.decode(F.unhex(unit), "UTF-16BE"), F.substring(p, F.length(code) + 2, F.length(p)))

    many = F.concat(F.element_at(parts, 1), F.array_join(F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), decoded), ""))
    return F.when(F.size(parts) > 1, many).otherwise(c)


def to_bool(c: Column) -> Column:
    """Provider booleans arrive as "1", 1 or true."""
    return F.coalesce(c.cast("string").isin("1", "true"), F.lit(False))


def safe_date(c: Column) -> Column:
    """Timestamp, or null if it isn't one; fractions beyond microseconds are cut."""
    return F.try_to_timestamp(F.regexp_replace(c, r"(\.\d{6})\d+", "$1"))


def parse_salary_floor(c: Column) -> Column:
    number = F.regexp_extract(F.replace(c, F.lit(","), F.lit("")), r"(\d+(?:\.\d+)?)", 1).try_cast("double")
    return F.when(number > 0, number)


def map_commitment(c: Column) -> Column:
    """Free-text job type of provider B; the first word that occurs in this order wins."""
    low = F.lower(c)
    return F.when(low.contains("part"), "part_time").when(low.contains("casual"), "casual").when(low.contains("contract") | low.contains("temp"), "contract").when(low.contains("full"), "full_time")


def map_contract_time(c: Column) -> Column:
    return F.when(c.isin("full_time", "part_time"), c)
