"""Token ids of whole texts under the public ``word_bpe_49k.json`` vocabulary.

That tokenizer drops white space and never joins characters across it, so a text's
ids are the ids of its words in order.  Words are cut
further where a run of letters meets ASCII punctuation (not around digits, apostrophes,
``<`` or characters beyond Latin letters), which is a cut of the vocabulary as well.
Every distinct span of a chunk is encoded once; spans are kept in a cache of at most
``CACHE_SPANS`` entries, for which an executor's memory counts once a worker process: those are used
again by what a session runs later.

Spans of ASCII and Latin letters up to U+017F go through the same merges in
``tiktoken`` (the end-of-word mark is the byte 0xFF, which no UTF-8 text holds);
all other words, and any that could hold a special token, go to ``tokenizers``.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa

from ._text import buffers, lower_ascii, span_hashes, words

VOCABULARY = "word_bpe_49k.json"
CACHE_SPANS = 50_000
#: The vocabulary's own split, for the characters of _SIMPLE.
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºÀ-ÖØ-öø-ſ]+|[0-9]|[^\sa-z0-9ªµºÀ-ÖØ-öø-ſ]+")
_SIMPLE = re.compile(r"(?:(?!<\|)[\x21-\x7eÀ-ÖØ-öø-įıĴ-ňŌ-ž])+")

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: Words with one of these bytes stay whole: controls, digits, ' and <, and lead bytes of anything but U+0100-U+017F.
_WHOLE = np.zeros(256, bool)
_WHOLE[[*range(0, 33), *range(48, 58), 39, 60, 127, *range(0xC0, 0xC4), *range(0xC6, 256)]] = True
_WHOLE[0xC3] = False  # U+00C0-U+00FF; the two signs among them are looked for apart


def spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every span, and n+1 offsets of the texts' spans."""
    s, e, w = words(buf, offs)
    if not len(s):
        return s, e, w
    whole = _WHOLE[buf]
    sign = (buf[:-1] == 0xC3) & ((buf[1:] == 0x97) | (buf[1:] == 0xB7))
    whole[:-1] |= sign
    bad = np.concatenate([[0], np.cumsum(whole, dtype=np.int64)])
    letter = _LETTER[buf]
    turn = np.zeros(len(buf), bool)
    turn[1:] = letter[1:] != letter[:-1]
    turn = np.flatnonzero(turn)
    of = np.searchsorted(s, turn, side="right") - 1  # the word that a turn stands in
    ok = (of >= 0) & (turn > s[of]) & (turn < e[of]) & (bad[e[of]] == bad[s[of]])
    turn = turn[ok]
    start = np.concatenate([s, turn])
    end = np.concatenate([e, turn])
    start.sort()
    end.sort()
    return start, end, np.searchsorted(start, offs)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


class WordIds:
    """Ids of words; one object per worker process and vocabulary file."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        # the printable stand-ins of bytes, as byte-level vocabularies write them
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        stand = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        ranks: dict[bytes, int] = {}
        for token, i in vocab.items():
            end = token.endswith("</w>")
            body = token[:-4] if end else token
            if all(c in stand for c in body) and body:
                ranks[bytes(stand[c] for c in body) + b"\xff" * end] = i
        ranks = dict(sorted(ranks.items(), key=lambda x: x[1]))
        self.fast = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.clear()

    def clear(self) -> None:
        self.slot: dict[int, int] = {}
        self.flat = array("I")
        self.ends = array("q", [0])

    def encode_word(self, word: bytes) -> list[int]:
        if word.isalpha():  # ASCII letters
            return self.fast(word.lower() + b"\xff")
        text = word.decode("utf-8")
        if not _SIMPLE.fullmatch(text):
            return self.slow.encode(text, add_special_tokens=False).ids
        out: list[int] = []
        for piece in _SPLIT.findall(text.lower()):
            out += self.fast(piece.encode() + b"\xff")
        return out

    def lookup(self, raw: bytes, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids of the distinct spans: their slots in the cache, every span's code, and the first place of each."""
        codes, uniques = pd.factorize(hashes)
        first = np.empty(len(uniques), np.int64)
        first[codes[::-1]] = np.arange(len(codes))[::-1]
        if len(self.slot) + len(uniques) > CACHE_SPANS and len(self.slot) > CACHE_SPANS // 2:
            self.clear()
        slot, flat, ends = self.slot, self.flat, self.ends
        where = np.empty(len(uniques), np.int64)
        s, e = start[first].tolist(), end[first].tolist()
        for i, h in enumerate(uniques.tolist()):
            at = slot.get(h)
            if at is None:
                flat.extend(self.encode_word(raw[s[i] : e[i]]))
                ends.append(len(flat))
                at = slot[h] = len(ends) - 2
            where[i] = at
        return where, codes, first

    def texts(self, arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and n+1 offsets of the texts."""
        counts, ids, w = self.spans(arr, want_ids=True)
        cum = np.concatenate([[0], np.cumsum(counts)])
        return ids, cum[w]

    def spans(self, arr: pa.Array, want_ids: bool) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
        """Ids per span, all ids if wanted, and n+1 offsets of the texts' spans."""
        buf, offs = buffers(arr)
        s, e, w = spans(buf, offs)
        if not len(s):
            return np.zeros(0, np.int64), np.zeros(0, np.uint32), w
        where, codes, _ = self.lookup(buf.tobytes(), s, e, span_hashes(lower_ascii(buf), s, e))
        ends = np.asarray(self.ends)
        begin, size = ends[where], ends[where + 1] - ends[where]
        counts = size[codes]
        if not want_ids:
            return counts, None, w
        flat = np.asarray(self.flat, np.uint32)
        to = np.cumsum(counts)
        shift = begin[codes] - (to - counts)
        return counts, flat[np.arange(to[-1]) + np.repeat(shift, counts)], w
