"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time on a bounded sample of
labelled texts, and then applied to every byte of every text.  A text is cut into
windows of ``WINDOW`` bytes, whose two states start at zero at the window's ends; all
windows of a chunk run side by side as one batch.  Each position gets a probability for
each language from both directions' states; a document's probability is the mean over
the positions of its letters.

The sample is bounded by ``SAMPLE_DOCS`` documents of each language and ``SAMPLE_BYTES``
characters of each, in ``PIECES`` pieces from all over the text; the model (a few thousand
numbers, whatever the corpus) is the only thing sent to the tasks.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import bounded_batches
from ._text import buffers, chunks

WINDOW = 48
HIDDEN = 6
SAMPLE_DOCS = 1200
SAMPLE_BYTES = 2048
#: A longer text is learned from this many pieces, one at a hashed place of each stretch.
PIECES = 8
#: Ids are chosen by their hashes modulo this.
_SPAN = 1 << 62
UNKNOWN = "und"
#: Input classes: ASCII folded to lower case, and all other bytes as they are.
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[65:91] += 32
_CLASS[:32] = 32
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


@dataclass
class Model:
    labels: list[str]
    params: dict[str, np.ndarray]


def init(n_labels: int, hidden: int = HIDDEN, seed: int = 7) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    p: dict[str, np.ndarray] = {}
    for d in "fb":
        for g in "zrc":
            p[f"E{g}{d}"] = (r.normal(0, 0.4, (256, hidden))).astype(np.float32)
            p[f"U{g}{d}"] = (r.normal(0, 0.5 / np.sqrt(hidden), (hidden, hidden))).astype(np.float32)
        p[f"O{d}"] = r.normal(0, 0.3, (hidden, n_labels)).astype(np.float32)
    p["b"] = np.zeros(n_labels, np.float32)
    return p


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def forward(p: dict[str, np.ndarray], x: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
    """States (T, B, H) of one direction over windows x (T, B)."""
    t_len, batch = x.shape
    hidden = p[f"Uz{d}"].shape[0]
    h = np.zeros((batch, hidden), np.float32)
    out = np.empty((t_len, batch, hidden), np.float32)
    ez, er, ec, uz, ur, uc = (p[k + d] for k in ("Ez", "Er", "Ec", "Uz", "Ur", "Uc"))
    for t in range(t_len) if d == "f" else range(t_len - 1, -1, -1):
        row = x[t]
        z = _sigmoid(ez[row] + h @ uz)
        r = _sigmoid(er[row] + h @ ur)
        c = np.tanh(ec[row] + (r * h) @ uc)
        if keep is not None:
            keep.append((t, h, z, r, c))
        h = h + z * (c - h)
        out[t] = h
    return out


def loss_and_grads(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy over all positions of windows x (T, B) with labels y (B),
    and its gradients by backpropagation through time in both directions."""
    t_len, batch = x.shape
    kept: dict[str, list] = {"f": [], "b": []}
    states = {d: forward(p, x, d, kept[d]) for d in "fb"}
    logits = sum(states[d] @ p[f"O{d}"] for d in "fb") + p["b"]
    logits -= logits.max(-1, keepdims=True)
    prob = np.exp(logits)
    prob /= prob.sum(-1, keepdims=True)
    cols = np.arange(batch)
    loss = float(-np.log(prob[:, cols, y] + 1e-9).mean())
    d_log = prob
    d_log[:, cols, y] -= 1
    d_log /= t_len * batch
    g = {k: np.zeros_like(v) for k, v in p.items()}
    g["b"] = d_log.sum((0, 1))
    for d in "fb":
        flat = states[d].reshape(-1, states[d].shape[-1])
        g[f"O{d}"] = flat.T @ d_log.reshape(-1, d_log.shape[-1])
        d_out = d_log @ p[f"O{d}"].T
        uz, ur, uc = p[f"Uz{d}"], p[f"Ur{d}"], p[f"Uc{d}"]
        dh = np.zeros_like(d_out[0])
        for t, h, z, r, c in reversed(kept[d]):
            dh = dh + d_out[t]
            dc = dh * z * (1 - c * c)
            dz = dh * (c - h) * z * (1 - z)
            drh = dc @ uc.T
            dr = drh * h * r * (1 - r)
            for gate, dg, inp in (("z", dz, h), ("r", dr, h), ("c", dc, r * h)):
                g[f"U{gate}{d}"] += inp.T @ dg
                np.add.at(g[f"E{gate}{d}"], x[t], dg)
            dh = dh * (1 - z) + drh * r + dz @ uz.T + dr @ ur.T
    return loss, g


def train(texts: list[tuple[bytes, ...]], labels: list[str], steps: int = 300, batch: int = 192, rate: float = 0.02, hidden: int = HIDDEN, window: int = WINDOW, seed: int = 7) -> Model:
    """Adam on random windows of the texts' pieces, every language equally often."""
    names = sorted(set(labels))
    p = init(len(names), hidden, seed)
    if len(names) < 2:
        return Model(names, p)
    r = np.random.default_rng(seed)
    pools = [[[np.frombuffer(part, np.uint8) for part in t] for t, x in zip(texts, labels, strict=True) if x == name] for name in names]
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        y = r.integers(0, len(names), batch)
        x = np.full((window, batch), 32, np.uint8)
        for i, k in enumerate(y.tolist()):
            parts = pools[k][r.integers(len(pools[k]))]
            own = parts[r.integers(len(parts))]
            at = int(r.integers(max(1, len(own) - window + 1)))
            piece = own[at : at + window]
            x[: len(piece), i] = _CLASS[piece]
        _, g = loss_and_grads(p, x, y)
        lr = rate * min(1.0, step / 20) * (1 - 0.9 * step / steps)
        for k in p:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v[k] = 0.99 * v[k] + 0.01 * g[k] * g[k]
            p[k] = p[k] - (lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return Model(names, p)


def position_probabilities(model: Model, x: np.ndarray) -> np.ndarray:
    """(T, labels, B): every position's probabilities in windows x (T, B) of byte classes.

    States are (H, B), so that one product with the stacked gate matrices gives
    contiguous rows for each gate.  Gates use tanh only; the halving of the logistic
    function is folded into the weights."""
    p = model.params
    t_len, batch = x.shape
    k = len(model.labels)
    logits = np.empty((t_len, k, batch), np.float32)
    half = np.float32(0.5)
    for d in "fb":
        hidden = p[f"Uz{d}"].shape[0]
        table = np.ascontiguousarray(np.concatenate([p[f"Ez{d}"] * half, p[f"Er{d}"] * half, p[f"Ec{d}"]], 1).T)
        gates = np.ascontiguousarray(np.concatenate([p[f"Uz{d}"] * half, p[f"Ur{d}"] * half], 1).T)
        uc, o = np.ascontiguousarray(p[f"Uc{d}"].T) * half, np.ascontiguousarray(p[f"O{d}"].T)
        h = np.zeros((hidden, batch), np.float32)
        pre = np.empty((3 * hidden, batch), np.float32)
        both, c = pre[: 2 * hidden], pre[2 * hidden :]
        z, r = pre[:hidden], pre[hidden : 2 * hidden]
        tmp2, tmp1 = np.empty_like(both), np.empty_like(h)
        step = np.empty((k, batch), np.float32)
        for t in range(t_len) if d == "f" else range(t_len - 1, -1, -1):
            np.take(table, x[t], axis=1, out=pre, mode="clip")
            both += np.matmul(gates, h, out=tmp2)
            np.tanh(both, out=both)
            both += 1  # twice the gates; the other halves are in uc and below
            r *= h
            c += np.matmul(uc, r, out=tmp1)
            np.tanh(c, out=c)
            c -= h
            c *= z
            c *= half
            h += c
            if d == "f":
                np.matmul(o, h, out=logits[t])
            else:
                logits[t] += np.matmul(o, h, out=step)
    logits += p["b"][:, None]
    np.exp(logits, out=logits)  # logits are bounded: |h| <= 1
    logits /= logits.sum(1, keepdims=True)
    return logits


def pooled(model: Model, arr: pa.Array, window: int = WINDOW, batch: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """(documents, labels) mean probabilities over the letter positions of every text,
    and the number of those positions."""
    buf, offs = buffers(arr)
    n = len(offs) - 1
    sizes = np.diff(offs)
    per = -(-sizes // window)
    doc = np.repeat(np.arange(n), per)
    first = offs[:-1][doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)) * window
    stop = offs[1:][doc]
    total = np.zeros((n, len(model.labels)))
    count = np.zeros(n, np.int64)
    padded = np.concatenate([buf, np.full(window, 32, np.uint8)])
    steps = np.arange(window)[:, None]
    for a in range(0, len(doc), batch):
        at = first[a : a + batch][None, :] + steps
        raw = padded[at]
        raw[at >= stop[a : a + batch][None, :]] = 32
        letter = _LETTER[raw]
        prob = position_probabilities(model, _CLASS[raw])
        own = doc[a : a + batch]
        of, at0 = np.unique(own, return_index=True)  # windows of a text stand together
        summed = np.einsum("tkb,tb->kb", prob, letter.astype(np.float32)).astype(np.float64)
        total[of] += np.add.reduceat(summed, at0, axis=1).T
        count[of] += np.add.reduceat(letter.sum(0), at0)
    return total / np.maximum(count, 1)[:, None], count


def has_letter(arr: pa.Array) -> np.ndarray:
    """Whether a text holds a letter of any script (null: no)."""
    buf, offs = buffers(arr)
    seen = np.concatenate([[0], np.cumsum(_ASCII_LETTER[buf], dtype=np.int64)])
    out = seen[offs[1:]] > seen[offs[:-1]]
    for i in np.flatnonzero(~out & (np.diff(offs) > 0)).tolist():
        out[i] = any(unicodedata.category(ch)[0] == "L" for ch in buf[offs[i] : offs[i + 1]].tobytes().decode("utf-8", "replace"))
    return out


def _pieces(text: Column, key: Column, n_chars: int, pieces: int = PIECES) -> Column:
    """The whole text, or of a text longer than ``n_chars`` one piece at a hashed place of
    each of ``pieces`` stretches that together cover it."""
    size, part = F.length(text), n_chars // pieces
    start = lambda i: F.floor(i * size / pieces)
    piece = lambda i: F.substring(text, (start(i) + F.pmod(F.xxhash64(key, i), start(i + 1) - start(i) - part + 1) + 1).cast("int"), F.lit(part))
    return F.when(size <= n_chars, F.array(text)).otherwise(F.transform(F.sequence(F.lit(0), F.lit(pieces - 1)), piece))


def sample(docs: DataFrame, may_learn: Column, label: str = "lang", text: str = "text", doc_id: str = "doc_id", n: int = SAMPLE_DOCS, n_bytes: int = SAMPLE_BYTES) -> tuple[tuple[tuple[bytes, ...], ...], tuple[str, ...]]:
    """At most ``n`` labelled documents of each language, as pieces of ``n_bytes`` characters
    in all: those of the smallest id hashes, so that equal tables give equal samples.

    Repeated rows of an id count once in each language, with the text of the smallest hash;
    a row without id counts by its text.  Empty texts aren't learned from."""
    t = F.col(text).cast("string")
    key = F.pmod(F.when(F.col(doc_id).isNotNull(), F.xxhash64(doc_id)).otherwise(F.xxhash64(t)), F.lit(_SPAN))
    known = docs.where(may_learn & F.col(label).isNotNull() & (F.length(t) > 0)).select(F.col(label).cast("string").alias("y"), key.alias("h"), t.alias("t"))
    found = {r.y: r.k for r in known.groupBy("y").agg(F.approx_count_distinct("h").alias("k")).collect()}
    if not found:
        return (), ()
    below = lambda cut: F.col("h") < F.element_at(F.create_map(*(F.lit(v) for pair in cut.items() for v in pair)), F.col("y"))
    # about 4 * n ids of each language, or all, reach the driver; then the rows of the n smallest
    near = known.where(below({y: int(min(1.0, 4 * n / k) * _SPAN) for y, k in found.items()})).select("y", "h").distinct().collect()
    ids: dict[str, list[int]] = {}
    for r in near:
        ids.setdefault(r.y, []).append(r.h)
    few = known.where(below({y: sorted(h)[:n][-1] + 1 for y, h in ids.items()}))
    few = few.groupBy("y", "h").agg(F.min_by(_pieces(F.col("t"), F.col("h"), n_bytes), F.xxhash64("t")).alias("t"))
    rows = sorted((r.y, r.h, tuple(x.encode() for x in r.t)) for r in few.collect())
    return tuple(r[2] for r in rows), tuple(r[0] for r in rows)


@lru_cache(maxsize=4)
def _trained(texts: tuple[tuple[bytes, ...], ...], labels: tuple[str, ...]) -> Model:
    return train(list(texts), list(labels))


def identify(docs: DataFrame, may_learn: Column, doc_id: str = "doc_id", text: str = "text", label: str = "lang", extra: list[Column] | None = None) -> DataFrame:
    """``extra`` columns with (lang_pred, score): the likeliest learned language and its
    pooled probability.

    Only rows for which ``may_learn`` holds are learned from, and no column but the text
    enters a prediction.  Null texts and texts without a letter, and everything if there
    is nothing to learn from, get ``und`` and score 0.  Repeated rows are judged alike.
    """
    model = _trained(*sample(docs, may_learn, label, text, doc_id))
    extra = extra if extra is not None else [F.col(doc_id).alias("doc_id")]
    given = bounded_batches(docs).select(F.col(text).cast("string").alias("_text"), *extra)
    names = [c for c in given.columns if c != "_text"]
    schema = ", ".join(f"`{c}` {t}" for c, t in given.dtypes if c != "_text") + ", lang_pred string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "_text"):
            lettered = has_letter(part.column(0))
            if model.labels:
                mean, _ = pooled(model, part.column(0))
                best = mean.argmax(1)
                score = np.clip(mean[np.arange(len(mean)), best], 0, 1)
                pred = [model.labels[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), lettered.tolist(), strict=True)]
            else:
                lettered[:] = False
                score, pred = np.zeros(len(lettered)), [UNKNOWN] * len(lettered)
            yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(pred, pa.string()), pa.array(np.where(lettered, score, 0.0))], [*names, "lang_pred", "score"])

    return given.mapInArrow(run, schema)
