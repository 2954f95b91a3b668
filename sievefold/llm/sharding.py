"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard has ``VIRTUAL`` points on a ring of 64-bit hashes.  A document's home is the
shard of the first point at or after the hash of its id.  Shards have a capacity; what
overflows a full shard continues clockwise to the next one that has room.  Capacities sum
up to what there is, so loads are balanced whatever the ring's luck, and with one more
shard most documents stay where they are.

1. Rows of equal id and text are one class with a count; classes are all that is placed,
   so a group of copies is one row however large it is.
2. Rounds: in each, what isn't placed goes to its first open shard clockwise.  A shard
   takes classes by their rank, a hash that differs from round to round, up to its room;
   who arrives in an earlier round stays.  A shard that turns a class away is full and
   closed, so a round closes at least one, and there are no more rounds than shards.  A
   class at the edge is split.
3. Ranks are prefix sums on two levels, inside ranges of the rank's hash and over the
   ranges' totals; no task holds a shard.  Of the rounds, the driver sees totals per shard.
4. Slots are the ranks, counted on from round to round.  Classes are expanded to rows in
   pieces of bounded size.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import discard_since, made, materialize

SHARDS, VIRTUAL = 8, 128
LAWS = ("rows", "bytes")
#: Classes of a shard in a range of ranks, on average, and the least power of two of ranges.
PER_RANGE, MIN_BITS = 20_000, 5
#: Rows that one task makes of a class.
PIECE = 10_000


def ring(shards: int, virtual: int = VIRTUAL) -> tuple[np.ndarray, list[int]]:
    """The ring's points in order, as signed 64-bit numbers, and the shard of each."""
    at = lambda s, v: int.from_bytes(hashlib.blake2b(f"{s}/{v}".encode(), digest_size=8).digest(), "big", signed=True)
    points = sorted((at(s, v), s) for s in range(shards) for v in range(virtual))
    return np.array([p for p, _ in points], np.int64), [s for _, s in points]


def clockwise(owners: list[int], open_: set[int]) -> list[int]:
    """For every point of the ring the first open shard at or after it."""
    out, last = [0] * len(owners), -1
    for i in [*range(len(owners) - 1, -1, -1)] * 2:  # twice around, for what wraps
        last = owners[i] if owners[i] in open_ else last
        out[i] = last
    return out


def capacities(total: int, shards: int) -> list[int]:
    """Equal parts of the total, at most one apart."""
    return [total // shards + (s < total % shards) for s in range(shards)]


def _classes(docs: DataFrame, doc_id: str, text: str, points: np.ndarray) -> DataFrame:
    """(doc_id, size, text_crc32, h, k, at): a row per id and text, ``k`` rows of the table,
    with its place on the ring."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"), F.xxhash64(t).alias("h"))
    few = rows.groupBy("doc_id", "size", "text_crc32", "h").agg(F.count(F.lit(1)).alias("k"))
    # ids are hashed; without one the text's hash is the place
    place = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")).otherwise(F.col("h"))

    @F.pandas_udf("int")
    def point_of(h):
        import pandas as pd

        return pd.Series((np.searchsorted(points, h.to_numpy()) % len(points)).astype(np.int32))

    return few.select("*", point_of(place).alias("at"))


def rank_of(round_: int) -> Column:
    """Who comes first in a round.  What a round leaves over ranks high in it; in the next
    one it is spread over all ranks again."""
    return F.xxhash64(F.lit(round_), "doc_id", "h")


def _ranked(x: DataFrame, classes: int, unit: Column) -> DataFrame:
    """Adds what comes before each class in its shard, by rank: rows and units of load."""
    bits = max(MIN_BITS, math.ceil(math.log2(max(1, classes / PER_RANGE))))
    # shifting the signed hash keeps its order
    x = x.withColumn("range", F.shiftright("rank", 64 - bits)).withColumns({"_u": unit, "_w": unit * F.col("k")})
    totals = x.groupBy("shard", "range").agg(F.sum("k").alias("rows"), F.sum("_w").alias("units"))
    ahead = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sum0 = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    totals = totals.select("shard", "range", sum0("rows", ahead).alias("_rows"), sum0("units", ahead).alias("_units"))
    inside = Window.partitionBy("shard", "range").orderBy("rank", "doc_id", "h", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumns({"_r": sum0("k", inside), "_b": sum0("_w", inside)}).join(totals, ["shard", "range"])
    return x.withColumns({"rows_before": F.col("_r") + F.col("_rows"), "units_before": F.col("_b") + F.col("_units")}).drop("range", "_rows", "_units", "_r", "_b", "_w")


def _expanded(parts: DataFrame) -> DataFrame:
    """A row for each of the ``n`` slots of a part, from ``slot`` on."""
    each = lambda x: x.withColumn("_i", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int")))).withColumn("slot", F.col("slot") + F.col("_i")).drop("_i", "n")
    cut = parts.where(F.col("n") > PIECE).withColumn("_i", F.explode(F.expr(f"sequence(0L, (n - 1) div {PIECE})")))
    cut = cut.withColumns({"slot": F.col("slot") + F.col("_i") * PIECE, "n": F.least(F.lit(PIECE), F.col("n") - F.col("_i") * PIECE)}).drop("_i")
    return each(parts.where(F.col("n") <= PIECE)).unionByName(each(cut.repartition("shard", "slot")))


def shard_documents(docs: DataFrame, shards: int = SHARDS, law: str = "rows", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot), a row for every row of ``docs``.

    ``law`` is what the bound counts.  "rows": the numbers of rows differ by one at most.
    "bytes": the sizes, UTF-8 bytes plus one each, are near equal; a shard ends with the
    first row that reaches its part, so it exceeds it by less than one row, and the last
    shard to fill lacks what the others exceed theirs by.  Slots of a shard run from 0
    without gaps.  A null text is empty; rows without id go by their text's hash; rows
    of equal id and text are alike, so which of them is where isn't told.  With fewer rows
    than shards some shards stay empty; an empty table gives an empty result.  The result is
    the same in every run.
    """
    if law not in LAWS:
        raise ValueError(f"law must be one of {', '.join(LAWS)}")
    before = made()
    points, owners = ring(shards)
    unit = F.col("size") if law == "bytes" else F.lit(1).cast("long")
    left = materialize(_classes(docs, doc_id, text, points))
    total = left.agg(F.coalesce(F.sum(F.col("k") * unit), F.lit(0))).first()[0]
    room = dict(enumerate(capacities(total, shards)))
    filled, placed = dict.fromkeys(room, 0), []
    while n := left.count():
        open_ = {s for s, r in room.items() if r > 0}
        x = left.withColumn("rank", rank_of(len(placed))).withColumn("shard", F.get(F.lit(clockwise(owners, open_)), F.col("at")))
        of = lambda values: F.get(F.lit([int(values[s]) for s in range(shards)]).cast("array<long>"), F.col("shard"))
        x = _ranked(x, n // len(open_), unit)
        # rows are taken until the room is used up
        x = x.withColumn("_o", of(room) - F.col("units_before")).withColumn("n", F.expr("CASE WHEN _o > 0 THEN least(k, (_o + _u - 1) div _u) ELSE 0L END")).drop("_o")
        x = materialize(x.withColumn("slot", F.col("rows_before") + of(filled)).drop("rows_before", "units_before"))
        placed.append(x.where("n > 0").select("doc_id", "size", "text_crc32", "shard", "slot", "n"))
        for s, rows, units in x.groupBy("shard").agg(F.sum("n"), F.sum(F.col("n") * F.col("_u"))).collect():
            filled[s] += rows
            room[s] -= units
        left = x.where("n < k").withColumn("k", F.col("k") - F.col("n")).drop("shard", "slot", "n", "_u")
    if not placed:
        return left.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    whole = placed[0]
    for more in placed[1:]:
        whole = whole.unionByName(more)
    whole = materialize(whole)
    discard_since(before, whole)
    return _expanded(whole)
