"""Best-two-fit packing of whole documents into sequences of fixed capacity.

Texts are tokenised where they are read; only piece sizes are shuffled.  Pieces fall
by hash into groups of about ``PER_GROUP``, and each group is packed by one task over
a table of piece counts by length, so memory is bounded whatever the corpus is; a
group leaves at most one badly filled sequence.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _tokens
from ._spark import bounded_batches, materialize, n_groups
from ._text import chunks

CAPACITY = 4096
END_ID = 1
PER_GROUP = 60_000
#: Rows alike that are more than a group's SHARES-th part are dealt out one by one.
SHARES = 8
_PIECES = "doc_id {}, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): every text's ids and ``end_id``,
    cut into pieces of ``capacity`` ids of which the last may be shorter.  A null or
    empty text has the one id ``end_id``; ``ids_crc32`` is over little-endian uint32."""
    path = path or _tokens.default_path()
    kind = dict(docs.dtypes)[doc_id]
    schema = _PIECES.format(kind) + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _tokens.word_ids(path)
        for part in chunks(batches, "text"):
            ids, offs = enc.texts(part.column(1))
            sizes = np.diff(offs) + 1
            n = -(-sizes // capacity)
            row = np.repeat(np.arange(len(n)), n)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            start = nth * capacity
            length = np.minimum(capacity, sizes[row] - start)
            crc, kept = np.empty(len(row), np.int64), []
            tail = np.array([end_id], "<u4").tobytes()
            for i, (r, s, k) in enumerate(zip(row.tolist(), start.tolist(), length.tolist(), strict=True)):
                last = s + k == sizes[r]
                own = ids[offs[r] + s : offs[r] + s + k - last]
                c = zlib.crc32(np.ascontiguousarray(own, "<u4").data)
                crc[i] = zlib.crc32(tail, c) if last else c
                if with_ids:
                    kept.append(np.append(own, end_id).astype(np.int32) if last else own.astype(np.int32))
            cols = [part.column(0).take(pa.array(row)), pa.array(nth, pa.int32()), pa.array(start), pa.array(length), pa.array(crc)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                cols, names = [*cols, pa.array(kept, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names)

    return bounded_batches(docs).select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def best_two_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of every piece.

    A sequence opens with the longest piece left and takes the longest that fits until
    none does.  Then its smallest piece goes back if two pieces that are left fill the
    gap it leaves more tightly; of all such pairs the fullest is taken.  Ties fall to
    the earlier row.
    """
    lengths = np.asarray(lengths, np.int64)
    if len(lengths) and (lengths.min() < 1 or lengths.max() > capacity):
        raise ValueError(f"a piece must hold 1 to {capacity} tokens")
    by_size = np.argsort(lengths, kind="stable")[::-1]  # a size's rows, last first: pop() gives the earliest
    count = np.bincount(lengths, minlength=capacity + 1)
    ends = np.cumsum(count[::-1])[::-1]
    stack = {int(s): by_size[ends[s] - count[s] : ends[s]].tolist() for s in np.flatnonzero(count)}
    # fits[x]: the longest length left that is at most x
    fits = np.maximum.accumulate(np.where(count > 0, np.arange(capacity + 1), 0))
    seq, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)

    def take(size: int) -> int:
        rows = stack[size]
        row = rows.pop()
        if not rows:  # the lengths from here to the next longer one left now fall back
            below = fits[size - 1]
            stop = int(np.searchsorted(fits, size, side="right"))
            fits[size:stop] = below
        return row

    def give(size: int, row: int) -> None:
        rows = stack[size]
        if not rows:
            stop = int(np.searchsorted(fits, size, side="left"))
            fits[size:stop] = size
        rows.append(row)

    n = 0
    while fits[capacity]:
        held, gap = [], capacity
        while gap and (size := int(fits[gap])):
            held.append((size, take(size)))
            gap -= size
        if gap and len(held) > 1:
            small, row = held[-1]
            room = gap + small
            first = np.unique(fits[1 : room + 1])
            first = first[first > 0]
            if len(first):
                other = fits[room - first]
                # two of one length need two pieces of it
                twin = np.flatnonzero(other == first)
                for i in twin.tolist():
                    if len(stack[int(first[i])]) < 2:
                        other[i] = fits[first[i] - 1]
                total = np.where(other > 0, first + other, 0)
                best = int(np.argmax(total))
                if total[best] > small:
                    held.pop()
                    pair = int(first[best]), int(other[best])
                    held += [(x, take(x)) for x in pair]
                    give(small, row)
        at = 0
        for size, row in held:
            seq[row], offset[row] = n, at
            at += size
        n += 1
    return seq, offset


def pack(sized: DataFrame, capacity: int = CAPACITY, per_group: int = PER_GROUP) -> DataFrame:
    """Adds sequence_id and offset to rows with a ``length`` (1 to ``capacity``).

    Rows are spread over groups by a hash of doc_id, piece, start and ids_crc32, and rows
    of which a group would hold very many alike by their place in the table; the same
    stored table gives the same sequences.  ``sized`` must be stored (it is counted first).
    """
    groups = n_groups(sized.count(), per_group)
    names = [f"`{c}`" for c in sized.columns if c not in ("sequence_id", "offset")]
    schema = ", ".join(f"`{n}` {t}" for n, t in sized.dtypes if n not in ("sequence_id", "offset")) + ", sequence_id long, offset long"

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        keys = [(c, "ascending") for c in ("doc_id", "piece", "ids_crc32") if c in rows.column_names]
        rows = rows.drop_columns("_group").sort_by([("length", "descending"), *keys])
        seq, offset = best_two_fit(rows.column("length").to_numpy(), capacity)
        return rows.append_column("sequence_id", pa.array(seq + (key[0].as_py() << 40))).append_column("offset", pa.array(offset))

    keyed = sized.withColumn("_h", F.xxhash64(*(F.col(c) for c in ("doc_id", "piece", "start", "ids_crc32") if c in sized.columns)))
    # at most SHARES hashes for each group
    often = keyed.groupBy("_h").agg(F.count(F.lit(1)).alias("_k")).where(F.col("_k") * SHARES > per_group).select("_h", F.lit(1).alias("_often"))
    placed = keyed.withColumn("_at", F.monotonically_increasing_id()).join(F.broadcast(often), "_h", "left")
    group = F.pmod(F.xxhash64("_h", F.when(F.col("_often").isNotNull(), F.col("_at"))), F.lit(groups)).cast("long")
    return placed.select(*names, group.alias("_group")).groupBy("_group").applyInArrow(run, schema)


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its place: (doc_id, piece, start, length,
    ids_crc32[, ids], sequence_id, offset).

    Null text counts as empty; null ids are kept; repeated rows are documents of their
    own; an empty table gives no sequence; extra columns are not read.
    """
    return pack(materialize(pieces(docs, path, capacity, with_ids=with_ids)), capacity)


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, ids) of pieces placed with ``with_ids``: the sequences themselves,
    at most the capacity in ids each."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
