"""Edit-aware token counts.

A document is cut into segments, which the vocabulary encodes independently: its own
pre-tokens, each with the white space behind it.  (Words of up to LONG bytes are one segment
until an edit touches them.)  Up to ``2 * BLOCK`` neighbouring segments are a leaf of a
segment tree that holds characters and token counts.  An edit descends the tree to the
segments it touches and those next to its ends, cuts their edited text into segments
again, encodes only these, and updates the sums above their leaf.  A leaf that grows
beyond its bound is split and the sums are built anew, once in ``BLOCK`` insertions.

Cuts are made from left to right and depend on what follows by ``CONTEXT`` characters at
most, so an edit is cut again from that far before it on, until a cut falls on an old one.
Words with separate accents or other characters that the vocabulary's normaliser may join
over a cut, and with what may be a special token, are one segment whatever their length;
so is a run of letters, such as a sentence without blanks or punctuation, for it is one
pre-token.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _tokens
from ._spark import bounded_batches
from ._text import buffers, chunks, code_points, words

EDITS = "array<struct<pos:long,del:long,ins:string>>"


BLOCK = 64
LONG, CONTEXT = 64, 3
_WHITE_CLASS = r"[ \t-\r]"
_WORD = regex.compile(rf"({_WHITE_CLASS}*)([^ \t-\r]*)({_WHITE_CLASS}*)")
# Fixed values (the vocabulary's own split).
_PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+", regex.IGNORECASE)
#: What the normaliser could change over a cut, and what could begin a special token.
_JOINS = regex.compile(r"[\p{M}\p{C}\p{Z}\u1100-\u11ff\ua960-\ua97f\ud7b0-\ud7ff\u0130]|<\|")
_WHITE = b" \t\n\v\f\r"


def pre_tokens(word: str) -> list[str] | None:
    """A word's pre-tokens, None if it can't be cut."""
    if not word.isascii() and (_JOINS.search(word) or not unicodedata.is_normalized("NFC", word) or len(word.lower()) != len(word)) or "<|" in word:
        return None
    found = _PRE_TOKEN.findall(word)
    return found if sum(map(len, found)) == len(word) else None


def cut(text: str) -> list[str]:
    """Segments of a text: pre-tokens, or words that can't be cut, with the white space behind
    them, the first one also with that before it."""
    out: list[str] = []
    for lead, word, tail in _WORD.findall(text):
        if not word:
            if lead or tail:
                out.append(lead + tail)
            continue
        parts = list(pre_tokens(word) or (word,))
        parts[0] = lead + parts[0]
        parts[-1] += tail
        out += parts
    return out


class TokenTree:
    """Segment tree of one text.  ``chars`` and ``tokens`` are of its segments in order."""

    def __init__(self, text: str, chars: np.ndarray, tokens: np.ndarray, encoder: _tokens.WordIds):
        self.text, self.encoder = text, encoder
        self.counts = tokens
        self.from_ = np.concatenate([[0], np.cumsum(chars)])
        self.n_segments, self.reencoded = len(chars), 0
        # a leaf is a range of the text's segments, or (texts, counts) once it was edited
        starts = list(range(0, max(1, len(chars)), BLOCK))
        self.leaves: list = [(a, min(a + BLOCK, len(chars))) for a in starts]
        edges = np.minimum([*starts, len(chars)], len(chars))
        of_tokens = np.concatenate([[0], np.cumsum(tokens)])
        self._build(np.diff(self.from_[edges]).tolist(), np.diff(of_tokens[edges]).tolist())

    def _build(self, chars: list[int], tokens: list[int]) -> None:
        self.size = 1 << (len(chars) - 1).bit_length()
        more = [0] * (self.size - len(chars))
        self.chars, self.tokens = ([0] * self.size + x + more for x in (chars, tokens))
        for tree in (self.chars, self.tokens):
            for node in range(self.size - 1, 0, -1):
                tree[node] = tree[2 * node] + tree[2 * node + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def _find(self, pos: int) -> tuple[int, int]:
        """The leaf that holds character ``pos`` and the characters before that leaf."""
        node, before = 1, 0
        while node < self.size:
            node *= 2
            if pos - before >= self.chars[node] and self.chars[node + 1]:
                before += self.chars[node]
                node += 1
        return node - self.size, before

    def _parts(self, leaf: int) -> tuple[list[str], list[int]]:
        """Texts and token counts of a leaf's segments."""
        held = self.leaves[leaf]
        if isinstance(held[0], list):
            return held
        a, b = held
        edges = self.from_[a : b + 1].tolist()
        return [self.text[x:y] for x, y in zip(edges, edges[1:], strict=False)], self.counts[a:b].tolist()

    def _set(self, leaf: int, parts: list[str], counts: list[int]) -> None:
        self.leaves[leaf] = (parts, counts)
        node = leaf + self.size
        more_c, more_t = sum(map(len, parts)) - self.chars[node], sum(counts) - self.tokens[node]
        while node:
            self.chars[node] += more_c
            self.tokens[node] += more_t
            node //= 2

    def _segment(self, pos: int) -> tuple[int, int, int, str]:
        """The segment that holds character ``pos``: its leaf, place there, start and text."""
        leaf, before = self._find(pos)
        parts, _ = self._parts(leaf)
        i, at = _segment_at(parts, pos - before)
        return leaf, i, before + at, parts[i] if parts else ""

    def _between(self, start: int, end: int) -> str:
        """The text from ``start`` up to ``end``."""
        out = []
        while start < end:
            _, _, at, text = self._segment(start)
            out.append(text[start - at : end - at])
            start = at + len(text)
        return "".join(out)

    def edit(self, pos: int, delete: int, insert: str) -> int:
        """Deletes ``delete`` characters at ``pos`` and inserts ``insert`` there; both are
        clipped to the text.  Returns the new total."""
        n = self.chars[1]
        pos = min(max(pos, 0), n)
        delete = min(max(delete, 0), n - pos)
        left = self._segment(max(pos - CONTEXT, 0))[2] if n else 0
        right = pos + delete
        if right < n:
            _, _, at, text = self._segment(right)
            right = at + len(text)
        new = self._between(left, pos) + insert + self._between(pos + delete, right)
        while True:
            # a word that can't be cut is taken whole, and a cut must fall on the old one on the right
            grown = left > 0 and not _ends_white(before := self._segment(left - 1)[3]) and not _is_cut(before, new)
            if grown:
                left -= len(before)
                new = before + new
            if right < n and new and not _ends_white(new) and not _is_cut(new, after := self._segment(right)[3]):
                right += len(after)
                new += after
            elif not grown:
                break
        self._replace(left, right, cut(new))
        return self.total

    def _replace(self, left: int, right: int, fresh: list[str]) -> None:
        """Puts segments in place of those from ``left`` to ``right``, which begin and end there."""
        counts = [len(self.encoder.encode_word(w)) if (w := x.encode("utf-8").strip(_WHITE)) else 0 for x in fresh]
        self.reencoded += len(fresh)
        first, i, _, _ = self._segment(left if left < self.chars[1] else max(0, left - 1))
        parts, own = self._parts(first)
        if left >= self.chars[1]:
            i = len(parts)  # behind the last segment
        last, j = first, i - 1
        if right > left:
            last, j, _, _ = self._segment(right - 1)
        tail, tail_counts = (parts, own) if last == first else self._parts(last)
        parts, own = parts[:i] + fresh + tail[j + 1 :], own[:i] + counts + tail_counts[j + 1 :]
        for leaf in range(first + 1, last + 1):
            self._set(leaf, [], [])
        if len(parts) <= 2 * BLOCK:
            self._set(first, parts, own)
        else:
            self._split(first, parts, own)

    def _split(self, leaf: int, parts: list[str], counts: list[int]) -> None:
        new = [(parts[a : a + BLOCK], counts[a : a + BLOCK]) for a in range(0, len(parts), BLOCK)]
        chars, tokens = (tree[self.size : self.size + len(self.leaves)] for tree in (self.chars, self.tokens))
        chars[leaf : leaf + 1] = [sum(map(len, x[0])) for x in new]
        tokens[leaf : leaf + 1] = [sum(x[1]) for x in new]
        self.leaves[leaf : leaf + 1] = new
        some = [k for k, c in enumerate(chars) if c]
        self.leaves = [self.leaves[k] for k in some]
        self._build([chars[k] for k in some], [tokens[k] for k in some])

    def current(self) -> str:
        return "".join("".join(self._parts(leaf)[0]) for leaf in range(len(self.leaves)))


def _ends_white(text: str) -> bool:
    return text[-1:] in " \t\n\v\f\r"


def _is_cut(left: str, right: str) -> bool:
    """Whether a cut falls between two neighbouring texts, the first of which begins at one."""
    head = left[max(left.rfind(c) for c in " \t\n\v\f\r") + 1 :]
    ends = [i for i in (right.find(c) for c in " \t\n\v\f\r") if i >= 0]
    tail = right[: min(ends)] if ends else right
    if not tail:
        return True
    found = pre_tokens(head + tail)
    if found is None:
        return False
    at = 0
    for part in found:
        at += len(part)
        if at >= len(head):
            return at == len(head)
    return False


def _segment_at(parts: list[str], pos: int) -> tuple[int, int]:
    """The segment that holds character ``pos`` of a leaf and the characters before it."""
    before = 0
    for i, part in enumerate(parts):
        if pos < before + len(part):
            return i, before
        before += len(part)
    return max(0, len(parts) - 1), before - (len(parts[-1]) if parts else 0)


def trees(arr: pa.Array, encoder: _tokens.WordIds) -> Iterator[TokenTree]:
    """The tree of every text of a chunk."""
    counts, _, span_at = encoder.spans(arr, want_ids=False)
    buf, offs = buffers(arr)
    s, e, w = words(buf, offs)
    points = np.concatenate([[0], np.cumsum(code_points(buf), dtype=np.int64)])
    starts, _, _ = _tokens.spans(buf, offs)
    of_span = np.concatenate([[0], np.cumsum(counts)])
    by_word = of_span[np.append(np.searchsorted(starts, s), len(starts))]
    texts = arr.to_pylist()
    for i, text in enumerate(texts):
        a, b = int(w[i]), int(w[i + 1])
        if a == b:  # white space only: one segment without tokens
            size = int(points[offs[i + 1]] - points[offs[i]])
            yield TokenTree(text or "", np.array([size][: size > 0], np.int64), np.zeros(int(size > 0), np.int64), encoder)
            continue
        edge = np.append(points[s[a:b]], points[offs[i + 1]])
        edge[0] = points[offs[i]]  # leading white space belongs to the first word
        chars, tokens = np.diff(edge), np.diff(by_word[a : b + 1])
        for k in np.flatnonzero(e[a:b] - s[a:b] > LONG)[::-1].tolist():
            # from the last one on, so that the places before stay
            parts = cut(text[edge[k] - edge[0] : edge[k + 1] - edge[0]])
            each = [len(encoder.encode_word(x.encode("utf-8").strip(_WHITE))) for x in parts] if len(parts) > 1 else [int(tokens[k])]
            chars = np.concatenate([chars[:k], np.array([len(x) for x in parts], chars.dtype), chars[k + 1 :]])
            tokens = np.concatenate([tokens[:k], np.array(each, tokens.dtype), tokens[k + 1 :]])
        yield TokenTree(text, chars, tokens, encoder)


def count_edits(docs: DataFrame, edits: Column, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, tokens_before, tokens_after, segments, reencoded): token counts of every
    text before and after its ``edits``, applied in order; positions are code points.

    ``edits`` is an array of (pos, del, ins).  A null text is empty, a null array or edit
    changes nothing, null fields count as 0 and ''; positions and lengths are clipped to
    the text.  Repeated rows are counted alike; an empty table gives an empty result.
    """
    path = path or _tokens.default_path()
    kind = dict(docs.dtypes)[doc_id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _tokens.word_ids(path)
        for part in chunks(batches, "text"):
            rows = []
            for tree, todo in zip(trees(part.column(1), enc), part.column(2).to_pylist(), strict=True):
                before = tree.total
                for e in todo or ():
                    if e is not None:
                        tree.edit(e["pos"] or 0, e["del"] or 0, e["ins"] or "")
                rows.append((before, tree.total, max(1, tree.n_segments), tree.reencoded))
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(4))], ["doc_id", "tokens_before", "tokens_after", "segments", "reencoded"])

    given = bounded_batches(docs).select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), edits.cast(EDITS).alias("edits"))
    return given.mapInArrow(run, f"doc_id {kind}, tokens_before long, tokens_after long, segments long, reencoded long")


def seeded_edits(doc_id: str = "doc_id", text: str = "text", n: int = 3) -> Column:
    """``n`` edits of every text, drawn from the crc32 of its id: a position anywhere,
    0 to 15 characters deleted, and one of five insertions."""
    length = F.coalesce(F.length(F.col(text)), F.lit(0))

    def one(k: int) -> Column:
        c = F.crc32(F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(str(k))).cast("binary"))
        ins = F.element_at(F.array(*map(F.lit, ("", " ", "x", "two words", "\n- item. "))), (F.shiftright(c, 16) % 5 + 1).cast("int"))
        return F.struct((c % (length + 1)).alias("pos"), (F.shiftright(c, 8) % 16).alias("del"), ins.alias("ins"))

    return F.array(*(one(k) for k in range(n)))
