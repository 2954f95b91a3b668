"""Web URLs taken apart, and hosts, as the URL standard reads them; native expressions.

A guard that compares host names must see the host that a client would connect to:
percent-decoded, full-width letters and dots as plain ones, other letters in punycode, and
an address in whatever notation as a dotted quad.  What the standard rejects has no host.

Letters whose mapping needs Unicode's compatibility tables (ligatures, circled or
mathematical letters, half-width kana, separate accents, joiners) have no host here
either, though the standard maps most of them: a host that isn't surely known is none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (URL standard): scheme, user, host, port, path, query and fragment of a URL
# whose scheme has an authority; any slashes and backslashes before that are passed over.
WEB_URL = r"(?is)^(https?):[/\\]*(?:[^/\\?#]*@)?(\[[^\]/\\?#]*\]|[^:/\\?#\[\]@]*)(?::(\d*))?((?:[/\\][^?#]*)?)(?:\?([^#]*))?(?:#.*)?$"
_SCHEME, _HOST, _PORT, _PATH, _QUERY = 1, 2, 3, 4, 5
MOST_PORT = 65535

_WIDE = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F))
_NARROW = "".join(map(chr, range(0x21, 0x7F)))
# Fixed values (UTS 46): other full stops, and code points that are passed over.
_STOPS = "\u3002\uff61"
_PASSED_OVER = "\u00ad\u034f\u180b\u180c\u180d\u180f\u200b\u2060\u2064\ufeff" + "".join(map(chr, range(0xFE00, 0xFE10)))
# Fixed values (Unicode): ranges of what has compatibility mappings or is a separate accent.
_MAPPED = (
    (0xA8, 0xA8), (0xAA, 0xAA), (0xAF, 0xAF), (0xB2, 0xB5), (0xB8, 0xBA), (0xBC, 0xBE), (0x132, 0x133), (0x13F, 0x140), (0x149, 0x149), (0x17F, 0x17F), (0x1C4, 0x1CC), (0x1F1, 0x1F3),
    (0x2B0, 0x2B8), (0x2D8, 0x2DD), (0x2E0, 0x2E4), (0x300, 0x36F), (0x37A, 0x37A), (0x384, 0x385), (0x387, 0x387), (0x3D0, 0x3D6), (0x3F0, 0x3F2), (0x3F4, 0x3F5), (0x3F9, 0x3F9), (0x587, 0x587),
    (0x675, 0x678), (0xE33, 0xE33), (0xEB3, 0xEB3), (0xEDC, 0xEDD), (0xF0C, 0xF0C), (0xF77, 0xF77), (0xF79, 0xF79), (0x10FC, 0x10FC), (0x1D2C, 0x1D6A), (0x1D78, 0x1D78), (0x1D9B, 0x1DBF),
    (0x1E9A, 0x1E9B), (0x1FBD, 0x1FC1), (0x1FCD, 0x1FCF), (0x1FDD, 0x1FDF), (0x1FED, 0x1FEF), (0x1FFD, 0x1FFE), (0x2000, 0x209F), (0x20A8, 0x20A8), (0x2100, 0x218F), (0x222C, 0x2230),
    (0x2460, 0x24FF), (0x2A0C, 0x2A0C), (0x2A74, 0x2A76), (0x2ADC, 0x2ADC), (0x2C7C, 0x2C7D), (0x2D6F, 0x2D6F), (0x2E80, 0x2FFF), (0x3036, 0x303A), (0x309B, 0x309F), (0x30FF, 0x30FF),
    (0x3130, 0x33FF), (0xA69C, 0xA69D), (0xA770, 0xA770), (0xA7F2, 0xA7F9), (0xAB5C, 0xAB69), (0xF900, 0xFB4F), (0xFB50, 0xFDFF), (0xFE10, 0xFEFF), (0xFF00, 0xFFFF),
    (0x1D15E, 0x1D164), (0x1D1BB, 0x1D1C0), (0x1D400, 0x1D7FF), (0x1EE00, 0x1EEFF), (0x1F100, 0x1F2FF), (0x1FBF0, 0x1FBF9), (0x2F800, 0x2FA1F),
)
# and what isn't assigned, a blank, or joins letters
_UNSURE = r"[\p{C}\p{Z}" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in _MAPPED) + "]"
# Fixed values (URL standard): what no host holds.
_FORBIDDEN = r"[\x00-\x20\x7f#%/:<>?@\[\\\]^|]"
_PLAIN = r"^[a-z0-9_-]+(?:\.[a-z0-9_-]+)*$"
_NUMBER_LAST = r"(?:^|\.)(?:[0-9]+|0x[0-9a-f]*)\.?$"


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def tidied(url: Column) -> Column:
    """A URL without blanks and controls around it, and without tabs and line breaks."""
    return F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\n\r]", "")


# --- punycode (RFC 3492) ---------------------------------------------------------------

# Fixed values (RFC 3492): parameters of the encoding.
_BASE, _T_MIN, _T_MAX, _SKEW, _DAMP, _BIAS, _FIRST = 36, 1, 26, 38, 700, 72, 128
_DIGITS = "abcdefghijklmnopqrstuvwxyz0123456789"


def _long(c) -> Column:
    return (c if isinstance(c, Column) else F.lit(c)).cast("long")


def _div(a: Column, b: Column) -> Column:
    return _long(F.floor(a / b))


def _digits(delta: Column, bias: Column) -> Column:
    """A number in digits of falling weight; the threshold of each says whether it is the last."""

    def step(s: Column, i: Column) -> Column:
        k = i * _BASE
        t = _long(F.greatest(F.lit(_T_MIN), F.least(F.lit(_T_MAX), k - bias)))
        digit = lambda d: F.substring(F.lit(_DIGITS), d.cast("int") + 1, F.lit(1))
        more = s["q"] - t
        last = F.struct(_long(-1).alias("q"), F.concat(s["text"], digit(s["q"])).alias("text"))
        next_ = F.struct(_div(more, _BASE - t).alias("q"), F.concat(s["text"], digit(t + more % (_BASE - t))).alias("text"))
        return F.when(s["q"] < 0, s).when(more < 0, last).otherwise(next_)

    start = F.struct(_long(delta).alias("q"), F.lit("").alias("text"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(9)), start, step)["text"]


def _adapted(delta: Column, length: Column, first: Column) -> Column:
    def step(s: Column, _: Column) -> Column:
        smaller = F.struct(_div(s["d"], F.lit(_BASE - _T_MIN)).alias("d"), (s["k"] + _BASE).alias("k"))
        return F.when(s["d"] > (_BASE - _T_MIN) * _T_MAX // 2, smaller).otherwise(s)

    half = _div(delta, F.when(first, F.lit(_DAMP)).otherwise(F.lit(2)))
    start = F.struct((half + _div(half, length)).alias("d"), _long(0).alias("k"))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(7)), start, step)
    return let(end, lambda s: s["k"] + _div((_BASE - _T_MIN + 1) * s["d"], s["d"] + _SKEW))


def punycode(label: Column) -> Column:
    """A label with other letters than ASCII, as ASCII, without its prefix.

    The other letters are inserted by rising code point, from left to right; each step
    writes how far the place and code point are from the last one's."""
    points = F.transform(F.split(label, ""), lambda c, i: F.struct(_long(F.ascii(c)).alias("c"), _long(i).alias("i")))

    def of(all_: Column) -> Column:
        basic = F.regexp_replace(label, r"[^\x00-\x7f]", "")
        head = F.when(basic == "", "").otherwise(F.concat(basic, F.lit("-")))
        start = F.struct(_long(_FIRST).alias("c"), _long(0).alias("i"), _long(F.length(basic)).alias("n"), _long(_BIAS).alias("bias"), F.lit(True).alias("first"), head.alias("text"))

        def step(s: Column, x: Column) -> Column:
            before = _long(F.size(F.filter(all_, lambda y: (y["i"] < x["i"]) & (y["c"] <= x["c"]))))
            grown = s["n"] + 1
            put = lambda at, delta: F.struct(x["c"].alias("c"), (at + 1).alias("i"), grown.alias("n"), _adapted(delta, grown, s["first"]).alias("bias"), F.lit(False).alias("first"), F.concat(s["text"], _digits(delta, s["bias"])).alias("text"))
            return let(before, lambda at: let((x["c"] - s["c"]) * grown + at - s["i"], lambda delta: put(at, delta)))

        return F.aggregate(F.array_sort(F.filter(all_, lambda x: x["c"] >= _FIRST)), start, step)["text"]

    return let(points, of)


# --- addresses -------------------------------------------------------------------------


def _number(part: Column) -> Column:
    """A part of an address: decimal, octal after a 0, hexadecimal after 0x; null if it is
    none, and 2**32 for anything above."""
    digits = F.regexp_replace(F.regexp_replace(part, "^0x", ""), "^0+(?=.)", "")
    read = lambda base, most: F.when(F.length(digits) > most, _long(1 << 32)).otherwise(_long(F.conv(F.when(digits == "", "0").otherwise(digits), base, 10)))
    return F.when(part.rlike("^0x[0-9a-f]*$"), read(16, 9)).when(part.rlike("^0[0-7]+$"), read(8, 12)).when(part.rlike("^(?:0|[1-9][0-9]*)$"), read(10, 11))


def ipv4(host: Column) -> Column:
    """The dotted quad of a host whose last label is a number; null if it is no address."""
    labels = F.split(F.regexp_replace(host, r"\.$", ""), r"\.")

    def quad(parts: Column) -> Column:
        n = F.size(parts)
        last = F.element_at(parts, -1)
        head = F.slice(parts, 1, n - 1)
        valid = (n <= 4) & ~F.exists(parts, lambda p: p.isNull()) & ~F.exists(head, lambda p: p > 255) & (last < F.lit(256.0) ** (5 - n))
        high = F.aggregate(F.transform(head, lambda p, i: _long(p * _long(F.lit(256.0) ** (3 - i)))), _long(0), lambda a, p: a + p)
        whole = let(high + last, lambda v: F.concat_ws(".", *(F.shiftright(v, 8 * k).bitwiseAND(_long(255)).cast("string") for k in (3, 2, 1, 0))))
        return F.when(F.coalesce(valid, F.lit(False)), whole)

    return let(F.transform(labels, _number), quad)


# --- hosts -----------------------------------------------------------------------------


def ascii_host(raw: Column) -> Column:
    """The host that a client connects to, null if there is none.

    An address in brackets is only checked for its characters."""
    return let(raw, _host)


def _host(raw: Column) -> Column:
    decoded = F.when(raw.contains("%"), F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B")))).otherwise(raw)
    # a capital sigma is lowered by its place in the word elsewhere
    mapped = F.lower(F.translate(decoded, _WIDE + _STOPS + "Σ" + _PASSED_OVER, _NARROW + ".." + "σ"))
    label = lambda x: F.when(x.rlike(r"^[\x00-\x7f]*$"), x).otherwise(F.concat(F.lit("xn--"), punycode(x)))
    labels = lambda m: F.array_join(F.transform(F.split(m, r"\."), label), ".")
    plain = lambda m: F.when(m.rlike(r"^[\x00-\x7f]*$"), m).when(m.rlike(_UNSURE), F.lit(None)).otherwise(labels(m))
    checked = lambda h: F.when((h == "") | h.rlike(_FORBIDDEN), F.lit(None)).when(h.rlike(_NUMBER_LAST), ipv4(h)).otherwise(h)
    other = let(let(mapped, plain), checked)
    return let(
        F.lower(raw),
        lambda low: F.when(low.rlike(_PLAIN) & ~low.rlike(_NUMBER_LAST), low).when(low.startswith("["), F.when(low.rlike(r"^\[[0-9a-f:.]+\]$"), low)).otherwise(other),
    )


def web_part(url: Column, part: int) -> Column:
    return F.regexp_extract(url, WEB_URL, part)


def web_host(url: Column) -> Column:
    """The host of a tidied http or https URL; null if it is no such URL."""
    port = web_part(url, _PORT)
    # a port that is too long to be cast is none
    sound = (port == "") | (F.coalesce(port.try_cast("long"), F.lit(MOST_PORT + 1)) <= MOST_PORT)
    return F.when(url.rlike(WEB_URL) & sound, ascii_host(web_part(url, _HOST)))


def web_port(url: Column, secure: bool = False) -> Column:
    """``:port``, or nothing where it is the scheme's own; ``secure``: https' too, whatever the scheme."""
    n = web_part(url, _PORT).try_cast("int")
    http = F.lower(web_part(url, _SCHEME)) == "http"
    own = (http & (n == 80)) | ((~http | F.lit(secure)) & (n == 443))
    return F.when(n.isNull() | own, "").otherwise(F.concat(F.lit(":"), n.cast("string")))


def web_origin(url: Column) -> Column:
    """scheme://host:port of a web URL, as two URLs of one site have it; null without a host."""
    t = tidied(url)
    return F.concat(F.lower(web_part(t, _SCHEME)), F.lit("://"), web_host(t), web_port(t))


def web_path(url: Column) -> Column:
    return web_part(url, _PATH)


def web_query(url: Column) -> Column:
    return web_part(url, _QUERY)


__all__ = ["WEB_URL", "ascii_host", "ipv4", "let", "punycode", "tidied", "web_host", "web_origin", "web_part", "web_path", "web_port", "web_query"]
