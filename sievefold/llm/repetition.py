"""Repetition rules from a suffix array over words.

The texts of a chunk share one suffix array in which every suffix stays within its
text.  It is built by prefix doubling; a suffix leaves the sort as soon as its prefix
is unique.  The names of all doubling levels give the longest common prefix (LCP) of
neighbours in logarithmically many steps, without a pass per text or character.

A suffix's longest repeat is the larger LCP to its two neighbours, which is the depth
of the deepest LCP interval that holds it.  Suffixes whose repeat can't be extended to
the left mark the maximal repeated substrings; the union of their spans is what a text
repeats, first occurrence included.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import WORD, bounded_batches
from ._text import buffers, chunks, code_points, span_hashes, words

#: The base rules.
MIN_WORDS = 10
BASE_WINDOW = 5
BASE_SHARE = 20
#: The method's rules: repeats of REPEAT_WORDS words or more may cover at most
#: MAX_COVERED percent of the words, and none may be longer than MAX_REPEAT words.
REPEAT_WORDS = 3
MAX_COVERED = 25
MAX_REPEAT = 50

_SYMBOL = np.zeros(256, np.uint8)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def longest_repeats(names: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """For each position, the length of the longest repeat that starts there: the
    longest common prefix with any other suffix of the same text.

    ``names`` are word identities and ``edges`` the n+1 offsets of the texts.
    """
    n = len(names)
    out = np.zeros(n, np.int64)
    text = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    codes = pd.factorize(names)[0].astype(np.int64)
    # level 0: rank by (text, word); a rank is the index of its group's first row
    key = text * (int(codes.max()) + 1 if n else 1) + codes
    rank, tied = _rank(key, np.arange(n), np.zeros(n, np.int64))
    levels = [rank]
    size, stop = 1, edges[1:][text]
    while len(tied):
        # a suffix that ends within the next half sorts before all that go on
        nxt = tied + size
        inside = nxt < stop[tied]
        second = np.where(inside, rank[np.where(inside, nxt, 0)] + 1, 0)
        # short tails of one text must not share a name: what follows them differs
        second = np.where(inside, second, -(stop[tied] - tied))
        rank = rank.copy()
        tied = _refine(rank, tied, second)
        levels.append(rank)
        size *= 2
    sa = np.empty(n, np.int64)
    sa[rank] = np.arange(n)
    # neighbours that share a level-0 name
    a, b = sa[:-1], sa[1:]
    near = np.flatnonzero(levels[0][a] == levels[0][b])
    i, j = a[near].copy(), b[near].copy()
    lcp = np.zeros(len(near), np.int64)
    limit = stop[b[near]]
    for k in range(len(levels) - 1, -1, -1):
        ok = (i < limit) & (j < limit)
        same = ok & (levels[k][np.where(ok, i, 0)] == levels[k][np.where(ok, j, 0)])
        step = same * (1 << k)
        lcp += step
        i += step
        j += step
    np.maximum.at(out, a[near], lcp)
    np.maximum.at(out, b[near], lcp)
    return out


def _rank(key: np.ndarray, rows: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    k = key[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    first = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    rank = np.empty(len(key), np.int64)
    rank[order] = first[group]
    sizes = np.diff(np.append(first, len(k)))
    return rank, order[sizes[group] > 1]


def _refine(rank: np.ndarray, tied: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Split the groups of ``tied`` rows by ``second``; changes ``rank``, returns rows still tied."""
    base = rank[tied]
    order = np.lexsort((second, base))
    rows, base, second = tied[order], base[order], second[order]
    at = np.arange(len(rows))
    top = np.ones(len(rows), bool)
    top[1:] = base[1:] != base[:-1]
    new = top.copy()
    new[1:] |= second[1:] != second[:-1]
    top_at = np.flatnonzero(top)[np.cumsum(top) - 1]
    new_at = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    rank[rows] = base + (new_at[group] - top_at)
    sizes = np.diff(np.append(new_at, len(rows)))
    return rows[sizes[group] > 1]


def repeat_spans(names: np.ndarray, edges: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length (both in words of the chunk) of every occurrence of a maximal
    repeated substring of at least ``min_words`` words, and the longest repeats."""
    longest = longest_repeats(names, edges)
    maximal = longest >= min_words
    first = np.zeros(len(longest), bool)
    first[edges[:-1][edges[:-1] < len(longest)]] = True
    # the span of a suffix whose left neighbour repeats one word further lies within that neighbour's span
    inner = np.zeros(len(longest), bool)
    inner[1:] = (longest[:-1] == longest[1:] + 1) & ~first[1:]
    start = np.flatnonzero(maximal & ~inner)
    return start, longest[start], longest


def covered(start: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """True for every word inside the union of the spans."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + length, -1)
    return np.cumsum(edge[:-1]) > 0


def _per_text(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    cum = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return cum[edges[1:]] - cum[edges[:-1]]


def _duplicate_lines(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    n_text = len(offs) - 1
    if not len(buf):
        return np.zeros(n_text, np.int64)
    nl = np.flatnonzero(buf == 10)
    owner = np.searchsorted(offs, nl, side="right") - 1
    start = np.concatenate([offs[:-1], nl + 1])
    end = np.concatenate([offs[1:], nl])
    text = np.concatenate([np.arange(n_text), owner])
    start.sort()
    end.sort()
    text.sort()
    solid = np.concatenate([[0], np.cumsum(~_SPACE[buf], dtype=np.int64)])
    keep = solid[end] > solid[start]
    start, end, text = start[keep], end[keep], text[keep]
    h = span_hashes(buf, start, end)
    order = np.lexsort((h, text))
    h, t = h[order], text[order]
    again = (h[1:] == h[:-1]) & (t[1:] == t[:-1])
    return np.bincount(t[1:][again], minlength=n_text)


def measure(arr: pa.Array, repeat_words: int = REPEAT_WORDS, window: int = BASE_WINDOW) -> dict[str, np.ndarray]:
    """The counts of every text of a chunk, with the maximal repeats' spans."""
    buf, offs = buffers(arr)
    s, e, w = words(buf, offs)
    points = np.concatenate([[0], np.cumsum(code_points(buf), dtype=np.int64)])
    h = span_hashes(buf, s, e)
    start, length, longest = repeat_spans(h, w, min(window, repeat_words))
    base = length >= window
    long_ = length >= repeat_words
    return {
        "n_words": np.diff(w),
        "word_chars": _per_text(points[e] - points[s], w),
        "n_symbols": _per_text(_SYMBOL[buf], offs),
        "n_dup_lines": _duplicate_lines(buf, offs),
        "n_repeat_words": _per_text(covered(start[base], length[base], len(s)), w),
        "covered_words": _per_text(covered(start[long_], length[long_], len(s)), w),
        "longest_repeat": np.array([longest[a:b].max() if b > a else 0 for a, b in zip(w[:-1].tolist(), w[1:].tolist(), strict=True)], np.int64),
        "_start": start[long_], "_length": length[long_], "_word": w, "_from": s, "_to": e, "_points": points, "_offs": offs,
    }


_LONGS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat")


def repetition_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", repeat_words: int = REPEAT_WORDS, max_covered: int = MAX_COVERED, max_repeat: int = MAX_REPEAT, with_spans: bool = False) -> DataFrame:
    """One row per document: the counts, base_failed, kept, and with ``with_spans`` the
    character spans (start, end) of the maximal repeats.

    base_failed: under MIN_WORDS words, or over BASE_SHARE percent of the words inside
    5-word windows that the text holds twice.  kept: not base_failed, maximal repeats of
    at least ``repeat_words`` words cover at most ``max_covered`` percent of the words, and
    none is longer than ``max_repeat`` words.  A null text has no words.  Repeated rows and
    equal ids are judged one by one; extra columns are not read.
    """
    kind = dict(docs.dtypes)[doc_id]
    schema = f"doc_id {kind}, " + ", ".join(f"{c} long" for c in _LONGS) + (", spans array<struct<start:long,end:long>>" if with_spans else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            m = measure(part.column(1), repeat_words)
            cols = [part.column(0), *(pa.array(m[c].astype(np.int64)) for c in _LONGS)]
            if with_spans:
                cols.append(_spans(m))
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", *_LONGS, *(["spans"] if with_spans else [])])

    out = bounded_batches(docs).select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * BASE_SHARE)
    good = (F.col("covered_words") * 100 <= F.col("n_words") * max_covered) & (F.col("longest_repeat") <= max_repeat)
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & good)


def _spans(m: dict[str, np.ndarray]) -> pa.Array:
    start, last = m["_start"], m["_start"] + m["_length"] - 1
    text = np.searchsorted(m["_word"], start, side="right") - 1
    origin = m["_points"][m["_offs"][text]]
    values = pa.StructArray.from_arrays([pa.array(m["_points"][m["_from"][start]] - origin), pa.array(m["_points"][m["_to"][last]] - origin)], ["start", "end"])
    offsets = np.searchsorted(text, np.arange(len(m["_word"])))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def oracle() -> str:
    """The verdict in SQL: repeats of L words or more are the L-word windows found twice,
    and a repeat is longer than M words exactly if an (M+1)-word window is found twice."""

    def cover(n: int) -> str:
        return f"""(SELECT doc_id, count(*)::BIGINT AS n FROM (
  SELECT DISTINCT doc_id, p + j AS q FROM (SELECT doc_id, unnest(ps) AS p FROM
    (SELECT doc_id, list(p) AS ps FROM (SELECT doc_id, p, array_to_string(w[p:p + {n - 1}], ' ') AS g FROM pos WHERE p + {n - 1} <= len(w)) GROUP BY doc_id, g HAVING count(*) > 1)), range(0, {n}) r(j)) GROUP BY doc_id)"""

    return f"""
WITH ws AS (SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
pos AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM ws),
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE regexp_matches(line, '{WORD}') GROUP BY doc_id),
base AS {cover(BASE_WINDOW)},
cov AS {cover(REPEAT_WORDS)},
too_long AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, array_to_string(w[p:p + {MAX_REPEAT}], ' ') AS g FROM pos WHERE p + {MAX_REPEAT} <= len(w) GROUP BY doc_id, g HAVING count(*) > 1)),
x AS (SELECT ws.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum([length(y) for y in w]), 0)::BIGINT AS word_chars,
  coalesce(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')), 0)::BIGINT AS n_symbols, coalesce(lines.n, 0)::BIGINT AS n_dup_lines,
  coalesce(base.n, 0)::BIGINT AS n_repeat_words, coalesce(cov.n, 0)::BIGINT AS covered, too_long.doc_id IS NOT NULL AS lengthy
  FROM ws LEFT JOIN lines USING (doc_id) LEFT JOIN base USING (doc_id) LEFT JOIN cov USING (doc_id) LEFT JOIN too_long USING (doc_id)),
y AS (SELECT *, n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * {BASE_SHARE} AS base_failed FROM x)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND covered * 100 <= n_words * {MAX_COVERED} AND NOT lengthy AS kept FROM y"""
