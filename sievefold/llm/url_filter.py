"""URL filter: ordered prefix rules, else a logistic regression on hashed
character n-grams of host and path.

Everything that touches the pages is DataFrame expressions: the URL is cut by
``substring``/``regexp_extract``, the n-grams are hashed by integer arithmetic
over code points, and the weights are one literal array.  Only the small labelled
table (at most ``MAX_LABELLED`` rows) reaches the driver, where the model is fitted.

Weights are rounded to multiples of 2**-16, so a score is an exact integer sum and
does not depend on the order of addition.
"""

from __future__ import annotations

import csv
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 4096
#: Polynomial hashes are taken modulo this first.
PRIME = 1_048_573
GRAMS = (3, 4, 5)
MAX_LABELLED = 5000
MAX_RULES = 1000
SCALE = 1 << 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: Longest rule wins; at equal length the longer host, then block before allow.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


#: URLs of several kinds of sites, labelled by hand: reference works, universities, news, offices,
#: code, shops and private sites (0), gambling, pills, adult sites, loans, warez, counterfeits,
#: advertising and phishing (1).  Subdomains, endings and half of the paths (numbers) are
#: alike in both classes, so that the hosts' words decide.
LABELLED = Path(__file__).with_name("labelled_urls.csv")


@lru_cache(maxsize=1)
def labelled_urls() -> list[tuple[str, int]]:
    """The small labelled table (1: block) that the registered query learns from, in order."""
    with LABELLED.open(encoding="utf-8", newline="") as f:
        return sorted((r["url"], int(r["label"])) for r in csv.DictReader(f))


def registrable_domain(url: str) -> str:
    """The part of a host that is registered: its last two labels, three behind an ending such
    as co.uk.  Rows of one are learned or held out together."""
    labels = url.split("://", 1)[1].split("/", 1)[0].lower().split(".")
    second = len(labels) > 2 and labels[-2] in ("co", "com", "ac", "gov", "org") and len(labels[-1]) == 2
    return ".".join(labels[-3 if second else -2 :])


def labelled_table(spark: SparkSession) -> DataFrame:
    """``labelled_urls`` as a table (url, label)."""
    return spark.createDataFrame(labelled_urls(), "url string, label int")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both '' if the url is null or has no ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def fitting_rule(host: Column, path: Column, rules: tuple[Rule, ...], what: str) -> Column:
    """``what`` (text or verdict) of the longest rule that fits, else null."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} become one expression")
    found = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), len(r.host), r.verdict == "block")):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.lit(getattr(r, what))).otherwise(found)
    return found


def text_of(host: str, path: str) -> str:
    return f"^{host}|{path}$"


def _codes(url: str) -> list[int]:
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([len(rest), *(rest.find(c) for c in "/?#" if c in rest)])
    tail = rest[cut:]
    path = tail[: min([len(tail), *(tail.find(c) for c in "?#" if c in tail)])]
    return [ord(c) for c in text_of(rest[:cut].translate(str.maketrans(_UPPER, _LOWER)), path)]


def _bucket(codes: list[int]) -> int:
    """Polynomial hash of the codes, and of their number."""
    n = len(codes)
    return (sum(c * 31 ** (n - 1 - j) for j, c in enumerate(codes)) + n * 31**n) % PRIME % BUCKETS


def buckets_of(url: str) -> list[int]:
    """The buckets of all n-grams of a URL's host and path."""
    codes = _codes(url)
    return [_bucket(codes[i : i + n]) for n in GRAMS for i in range(len(codes) - n + 1)]


@lru_cache(maxsize=8)
def train(rows: tuple[tuple[str, int], ...], epochs: int = 300, rate: float = 0.4, l2: float = 1e-3) -> tuple[tuple[int, ...], int]:
    """Weights (integers, in 1/SCALE) and bias: mean logistic loss of the n-gram counts with
    an L2 penalty, by full-batch gradient descent.  Without rows all are 0."""
    if not rows:
        return (0,) * BUCKETS, 0
    grams = [buckets_of(url) for url, _ in rows]
    y = np.array([label for _, label in rows], float)
    flat, doc = np.array([g for x in grams for g in x]), np.repeat(np.arange(len(grams)), [len(x) for x in grams])
    w, bias = np.zeros(BUCKETS), 0.0
    for _ in range(epochs):
        z = bias + np.bincount(doc, weights=w[flat], minlength=len(y))
        err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        w -= rate * (np.bincount(flat, weights=err[doc], minlength=BUCKETS) + l2 * w)
        bias -= rate * err.sum()
    return tuple(int(x) for x in np.rint(w * SCALE)), round(bias * SCALE)


def fit_labelled(df: DataFrame, url: str = "url", label: str = "label") -> tuple[tuple[int, ...], int]:
    """Fit on a labelled table of at most ``MAX_LABELLED`` rows; null urls or labels are left out."""
    rows = df.select(F.col(url).alias("u"), F.col(label).cast("int").alias("y")).where("u IS NOT NULL AND y IS NOT NULL").orderBy("u", "y").limit(MAX_LABELLED + 1).collect()
    if len(rows) > MAX_LABELLED:
        raise ValueError(f"the labelled table holds more than {MAX_LABELLED} rows")
    return train(tuple((r.u, r.y) for r in rows))


def score(host: Column, path: Column, weights: tuple[int, ...], bias: int) -> Column:
    """Integer logit (in 1/SCALE) as a native expression: one pass over the characters
    that carries the last ones' codes, so time is linear in the URL's length."""
    text = F.concat(F.lit("^"), host, F.lit("|"), path, F.lit("$"))
    table = F.lit(list(weights)).cast("array<bigint>")
    back = max(GRAMS) - 1
    none = F.lit(None).cast("long")
    start = F.struct(F.lit(bias).cast("long").alias("z"), *(none.alias(f"p{k}") for k in range(1, back + 1)))

    def step(s: Column, ch: Column) -> Column:
        codes = [F.ascii(ch).cast("long"), *(s[f"p{k}"] for k in range(1, back + 1))]
        z = s["z"]
        for n in GRAMS:
            h = F.lit(n * 31**n).cast("long")
            for j in range(n):
                h = h + codes[j] * 31**j
            # null until n characters were seen
            z = z + F.coalesce(F.element_at(table, (h % PRIME % BUCKETS).cast("int") + 1), F.lit(0))
        return F.struct(z.alias("z"), *(codes[k - 1].alias(f"p{k}") for k in range(1, back + 1)))

    return F.aggregate(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), start, step, lambda s: s["z"])


def url_filter(pages: DataFrame, rules: tuple[Rule, ...] = RULES, labelled: DataFrame | None = None, url: str = "url") -> DataFrame:
    """Adds host, path, rule, verdict and url_score to ``pages``.

    A rule fits its host and all subdomains if the path starts with the rule's path;
    the longest wins, and where none fits the model decides (block if its logit is
    above 0).  Null url or no ``://``: host and path are empty, no rule fits, and the
    model judges the empty url.  Repeated rows are judged alike; an empty table gives
    an empty result; columns of these names that ``pages`` has are replaced.
    ``labelled`` (url, label) is the table to learn from.
    """
    weights, bias = fit_labelled(labelled if labelled is not None else labelled_table(pages.sparkSession))
    host, path = host_and_path(F.col(url))
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "url_score")]
    h, p = F.col("host"), F.col("path")
    cut = pages.select(*keep, host.alias("host"), path.alias("path")).select("*", score(h, p, weights, bias).alias("url_score"))
    return cut.select(
        *keep, "host", "path",
        fitting_rule(h, p, rules, "text").alias("rule"),
        F.coalesce(fitting_rule(h, p, rules, "verdict"), F.when(F.col("url_score") > 0, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        "url_score",
    )


def oracle() -> str:
    weights, bias = train(tuple(labelled_urls()))
    order = sorted(RULES, key=lambda r: (-len(r.text), -len(r.host), r.verdict != "block"))
    fits = lambda r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
    case = lambda what: "CASE " + " ".join(f"WHEN {fits(r)} THEN '{getattr(r, what)}'" for r in order) + " END"

    def hashed(n: int) -> str:
        h = " + ".join([str(n * 31**n), *(f"cp[i + {j}] * {31 ** (n - 1 - j)}" for j in range(n))])
        return f"w[({h}) % {PRIME} % {BUCKETS} + 1]"

    sums = " + ".join(f"coalesce(list_sum([{hashed(n)} for i in range(1, len(cp) - {n} + 2)]), 0)" for n in GRAMS)
    return f"""
WITH cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
hosts AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*', 0) AS raw FROM cut),
parts AS (SELECT page_id, translate(raw, '{_UPPER}', '{_LOWER}') AS host, regexp_extract(substring(rest, length(raw) + 1), '^[^?#]*', 0) AS path FROM hosts),
codes AS (SELECT page_id, host, path, [ord(c)::BIGINT for c in string_split('^' || host || '|' || path || '$', '')] AS cp FROM parts),
weights AS (SELECT {list(weights)}::BIGINT[] AS w),
scored AS (SELECT page_id, host, path, {bias} + {sums} AS z FROM codes, weights)
SELECT page_id, host, path, {case('text')} AS rule, coalesce({case('verdict')}, CASE WHEN z > 0 THEN 'block' ELSE 'allow' END) AS verdict FROM scored"""
