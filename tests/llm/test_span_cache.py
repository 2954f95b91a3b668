"""A worker process holds few bytes for the spans that it has encoded."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from sievefold.llm import _tokens


def texts(r, n):
    return [" ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(5, 9))) + r.choice(["", "", ".", "é", "'s", "7"]) for _ in range(100)) for _ in range(n)]


def test_cached_spans_are_few_bytes_and_change_no_ids():
    enc = _tokens.WordIds(_tokens.default_path())
    r = random.Random(5)
    tracemalloc.start()
    try:
        for _ in range(20):
            enc.texts(pa.array(texts(r, 150)))
        held = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert held < 25 << 20, held
    last = texts(r, 5)
    ids, offs = enc.texts(pa.array(last))
    want = [enc.slow.encode(t, add_special_tokens=False).ids for t in last]
    assert [x.tolist() for x in np.split(ids, offs[1:-1])] == want
