"""Quality classifier by Bradley-Terry pairwise ranking.

A document's score is linear in features of its whole text.  The weights are learned
from preference pairs (a good and a bad document) by logistic loss on the difference of
their features.  Documents are kept whose score lies above a quantile of the scores of
the labelled documents; the quantile is chosen on the training labels alone.

Learning takes a bounded sample: ``SAMPLE`` labelled documents of each class, and
``PAIRS`` pairs among them.  Features are counted in one pass over the bytes of each
text, so a text of any length costs memory in proportion to itself only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import bounded_batches, hash_share
from ._text import buffers, chunks, code_points, span_hashes, words

SAMPLE = 2000
PAIRS = 40_000
#: The quantile threshold is mapped to this score.
CUT = 0.3

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_HIGH = np.arange(256) >= 128
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&<>{}[]\\^~=+_@"]] = True
_PIPE = np.arange(256) == ord("|")
_BANG = np.zeros(256, bool)
_BANG[[ord("!"), ord("?")]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord("."), ord(",")]] = True
NAMES = ("upper", "digit", "symbol", "pipe", "bang", "stops", "same_next", "distinct", "dup_lines", "word_length", "log_words", "short", "symbol_words", "upper_words", "one_char")


def features(arr: pa.Array) -> np.ndarray:
    """(texts, features); an empty or null text has zeros but for ``short``."""
    buf, offs = buffers(arr)
    n = len(offs) - 1
    s, e, w = words(buf, offs)
    out = np.zeros((n, len(NAMES)))

    def per_text(flag: np.ndarray, edges: np.ndarray = offs) -> np.ndarray:
        cum = np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])
        return cum[edges[1:]] - cum[edges[:-1]]

    chars = np.maximum(per_text(code_points(buf)), 1)
    n_words = np.diff(w)
    some = np.maximum(n_words, 1)
    upper, lower = per_text(_UPPER[buf]), per_text(_LOWER[buf])
    out[:, 0] = upper / np.maximum(upper + lower, 1)
    for i, t in ((1, _DIGIT), (2, _SYMBOL), (3, _PIPE), (4, _BANG), (5, _STOP)):
        out[:, i] = per_text(t[buf]) / chars
    h = span_hashes(buf, s, e)
    text = np.repeat(np.arange(n), n_words)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (text[1:] == text[:-1])
    out[:, 6] = per_text(same, w) / some
    out[:, 7] = [len(set(h[a:b].tolist())) / max(1, b - a) for a, b in zip(w[:-1].tolist(), w[1:].tolist(), strict=True)]
    out[:, 8] = _dup_lines(buf, offs)
    out[:, 9] = np.minimum(chars / some, 40) / 10
    out[:, 10] = np.log1p(n_words) / 8
    out[:, 11] = n_words < 4
    if len(h):
        cum = {k: np.concatenate([[0], np.cumsum(t[buf], dtype=np.int64)]) for k, t in (("sym", _SYMBOL | _PIPE | _BANG), ("up", _UPPER), ("low", _LOWER))}
        got = {k: v[e] - v[s] for k, v in cum.items()}
        out[:, 12] = per_text(got["sym"] > 0, w) / some
        out[:, 13] = per_text((got["up"] > 1) & (got["low"] == 0), w) / some
        out[:, 14] = per_text(e - s == 1, w) / some
    return out


def _dup_lines(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Share of a text's bytes that lie in lines equal to an earlier line."""
    n = len(offs) - 1
    if not len(buf):
        return np.zeros(n)
    nl = np.flatnonzero(buf == 10)
    start = np.sort(np.concatenate([offs[:-1], nl + 1]))
    end = np.sort(np.concatenate([offs[1:], nl]))
    text = np.sort(np.concatenate([np.arange(n), np.searchsorted(offs, nl, side="right") - 1]))
    keep = end - start > 1
    start, end, text = start[keep], end[keep], text[keep]
    h = span_hashes(buf, start, end)
    order = np.lexsort((h, text))
    again = np.zeros(len(h), bool)
    again[1:] = (h[order][1:] == h[order][:-1]) & (text[order][1:] == text[order][:-1])
    size = (end - start)[order]
    return np.bincount(text[order][again], weights=size[again], minlength=n) / np.maximum(np.diff(offs), 1)


def expand(x: np.ndarray) -> np.ndarray:
    """Features, their square roots and squares: monotone curves stay learnable."""
    x = np.clip(x, 0, 4)
    return np.concatenate([x, np.sqrt(x), x * x], 1)


@dataclass
class Ranker:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    slope: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return ((expand(x) - self.mean) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1, rising with the ranking score; the threshold quantile is at CUT."""
        z = (self.raw(x) - self.threshold) * self.slope + math.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, steps: int = 400, rate: float = 0.05, l2: float = 1e-3, seed: int = 11, quantile: float | None = None) -> Ranker:
    """Learn from features and labels (1 good, 0 bad).  The quantile that becomes the
    threshold is given, or the one that balances both classes' errors on the labels.
    Without labels of both classes every score is 1."""
    e = expand(x) if len(x) else np.zeros((0, 3 * len(NAMES)))
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        k = e.shape[1]
        return Ranker(np.zeros(k), np.ones(k), np.zeros(k), -40.0, 1.0)
    mean, scale = e.mean(0), e.std(0) + 1e-6
    z = (e - mean) / scale
    z = np.clip(z, -8, 8)
    r = np.random.default_rng(seed)
    diff = z[good[r.integers(len(good), size=pairs)]] - z[bad[r.integers(len(bad), size=pairs)]]
    w = np.zeros(z.shape[1])
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        part = diff[r.integers(len(diff), size=4096)]
        g = -(part * (1 / (1 + np.exp(np.clip(part @ w, -40, 40))))[:, None]).mean(0) + l2 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    raw = ((e - mean) / scale) @ w
    order = np.argsort(raw, kind="stable")
    if quantile is None:
        # after the i-th lowest: bad ones found, and good ones lost, each as a share of its class
        ok = y[order] == 1
        gain = np.cumsum(~ok) / len(bad) - np.cumsum(ok) / len(good)
        at = int(np.argmax(gain)) + 1
    else:
        at = min(len(order) - 1, max(1, round(quantile * len(order))))
    low = raw[order[at - 1]]
    high = raw[order[at]] if at < len(order) else low + 1
    spread = np.std(raw) + 1e-9
    return Ranker(mean, scale, w, float((low + high) / 2), float(4 / spread))


def sample(docs: DataFrame, labels: DataFrame, may_learn: Column, label: str = "quality", doc_id: str = "doc_id", text: str = "text", n: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``n`` labelled documents of each class: those of
    the smallest id hashes.  A document labelled more than once takes the smallest label; of
    its repeated rows the text of the smallest hash is learned from."""
    known = labels.where(may_learn & F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(doc_id).agg(F.min(label).cast("int").alias("_y"))
    counts = {r["_y"]: r["k"] for r in known.groupBy("_y").agg(F.count(F.lit(1)).alias("k")).collect()}
    picked = None
    for y in (0, 1):
        some = known.where((F.col("_y") == y) & hash_share(counts.get(y, 0), n, F.col(doc_id))).orderBy(F.xxhash64(doc_id), doc_id).limit(n)
        picked = some if picked is None else picked.union(some)
    rows = docs.select(F.col(doc_id).alias("i"), F.col(text).cast("string").alias("_t")).join(F.broadcast(picked.withColumnRenamed(doc_id, "i")), "i")  # at most 2 * n ids are broadcast
    rows = rows.groupBy("i").agg(F.first("_y").alias("y"), F.min_by("_t", F.struct(F.col("_t").isNull(), F.xxhash64("_t"))).alias("_t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "_t"):
            x = features(part.column(1))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(x), pa.list_(pa.float64()))], ["y", "x"])

    got = bounded_batches(rows).select("y", "_t").mapInArrow(run, "y int, x array<double>").collect()
    got = sorted((r.y, tuple(r.x)) for r in got)
    return np.array([r[1] for r in got]).reshape(len(got), len(NAMES)), np.array([r[0] for r in got])


def classify(docs: DataFrame, labels: DataFrame, may_learn: Column, label: str = "quality", doc_id: str = "doc_id", text: str = "text", quantile: float | None = None, extra: list[Column] | None = None, ranker: Ranker | None = None) -> DataFrame:
    """``extra`` columns with (score, predicted): score 0 to 1, predicted 1 from CUT on.

    ``may_learn`` is a condition on the label table; no other column than the text enters
    a score.  Null and empty texts are scored as empty texts; repeated rows alike; without
    labels of both classes every document scores 1.
    """
    ranker = ranker or fit(*sample(docs, labels, may_learn, label, doc_id, text), quantile=quantile)
    extra = extra if extra is not None else [F.col(doc_id).alias("doc_id")]
    given = bounded_batches(docs).select(F.col(text).cast("string").alias("_text"), *extra)
    names = [c for c in given.columns if c != "_text"]
    schema = ", ".join(f"`{c}` {t}" for c, t in given.dtypes if c != "_text") + ", score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "_text"):
            yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(ranker.score(features(part.column(0))))], [*names, "score"])

    return given.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= CUT).cast("int"))
