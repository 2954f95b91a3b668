"""Vector code compression: product quantisation over weighted distinct parts.

A vector's components become integers and are cut into PARTS equal parts.  Equal parts at
one position are one weighted row, and all of the learning is done on these: rounds of
Lloyd's algorithm with weights give the same codebooks as over the vectors.

1. Every part of a vector is packed, with its position, into one number (or, where the
   values are too wide, an array), so that parts are compared and shuffled as one key.
2. Keys are counted, before the shuffle too: copies of a vector are one row per position.
3. A round is one pass over the distinct rows, without a shuffle: tasks add up weighted
   sums per codebook entry, and only these sums, PARTS * ENTRIES rows a task at most, are
   merged.  The driver holds the codebooks, whose size doesn't depend on the table.
4. The distinct rows get their codes and errors, once each, and are joined back to the
   vectors by key.  A key that many vectors have is broadcast, so no task gets all of them.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import bounded_batches, checked_broadcast, discard_since, join_unique, made, materialize

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
#: Integers end here, so that errors fit into 64 bits: components of 131072 and more.
LIMIT = 1 << 25
#: Sums of products below this are exact in floating point.
_EXACT = 1 << 53


def integers(vector: Column) -> Column:
    """floor(SCALE * x) of every component; null where the vector is null or holds a null or
    non-finite component."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf)))
    whole = F.transform(wide, lambda x: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.floor(x * SCALE))).cast("int"))
    return F.when(vector.isNotNull() & ~F.coalesce(bad, F.lit(True)), whole)


class Packing:
    """How a part and its position become one key, and back."""

    def __init__(self, width: int, low: int, high: int):
        self.width, self.low = width, low
        self.bits = max(1, (high - low).bit_length())
        self.in_long = 4 + self.bits * width <= 63

    def keys(self, v: Column) -> Column:
        """The PARTS keys of a vector of PARTS * width integers."""

        def key(p: Column) -> Column:
            part = F.slice(v, p * self.width + 1, self.width)
            if not self.in_long:
                return F.concat(F.array(p), part)
            # the last component is the highest, so reversed it comes first
            packed = F.aggregate(F.reverse(part), F.lit(0).cast("long"), lambda acc, x: F.shiftleft(acc, self.bits) + (x - F.lit(self.low)))
            return packed * PARTS + p

        return F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), key)

    @property
    def kind(self) -> str:
        return "long" if self.in_long else "array<int>"

    def parts(self, keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(position, part) of keys."""
        if not self.in_long:
            flat = keys.flatten().to_numpy().astype(np.int64).reshape(len(keys), self.width + 1)
            return flat[:, 0], flat[:, 1:]
        k = keys.to_numpy()
        shifts = 4 + self.bits * np.arange(self.width)
        return k % PARTS, (k[:, None] >> shifts & ((1 << self.bits) - 1)) + self.low


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest of ``entries``, the lower index on ties."""
    width = parts.shape[1]
    most = max(int(np.abs(x).max(initial=0)) for x in (parts, entries))
    if 4 * width * most * most < _EXACT:
        a, b = parts.astype(float), entries.astype(float)
        d = (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)
    else:
        d = np.zeros((len(parts), len(entries)), np.int64)
        for j in range(width):
            step = parts[:, j, None] - entries[None, :, j]
            d += step * step
    at = d.argmin(1)
    return at, d[np.arange(len(d)), at].astype(np.int64)


def _by_position(packing: Packing, keys: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(position, rows, their parts) of a batch."""
    at, parts = packing.parts(keys)
    for p in np.unique(at).tolist():
        rows = np.flatnonzero(at == p)
        yield p, rows, parts[rows]


def first_codebooks(rows: DataFrame, width: int) -> list[np.ndarray]:
    """The parts of the vectors with the ENTRIES smallest ids, null ids last, equal ids by
    vector.  Only ids are compared over all rows; the vectors are fetched afterwards."""
    order = lambda: (F.col("vec_id").asc_nulls_last(), F.col("v").asc())
    ids = rows.select("vec_id").where("vec_id IS NOT NULL").orderBy("vec_id").limit(ENTRIES).agg(F.count(F.lit(1)), F.max("vec_id")).first()
    some = rows if ids[0] < ENTRIES else rows.where(F.col("vec_id") <= F.lit(ids[1]))
    some = some.select("vec_id", "v").groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("k")).orderBy(*order()).limit(ENTRIES).collect()
    chosen = [r.v for r in some for _ in range(min(r.k, ENTRIES))][:ENTRIES]
    chosen = np.array(chosen, np.int64).reshape(len(chosen), PARTS, width)
    return [chosen[:, p] for p in range(PARTS)]


def improved(distinct: DataFrame, packing: Packing, codebooks: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after a round of weighted Lloyd: every entry is the floor of the mean of
    the parts nearest to it, as often as they occur; one without parts stays."""
    shape = (PARTS, len(codebooks[0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums = np.zeros(shape, np.int64), np.zeros((*shape, packing.width), np.int64)
        for batch in batches:
            w = batch.column(1).to_numpy()
            for p, rows, parts in _by_position(packing, batch.column(0)):
                code, _ = nearest(parts, codebooks[p])
                np.add.at(count[p], code, w[rows])
                np.add.at(sums[p], code, parts * w[rows, None])
        p, code = np.nonzero(count)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * packing.width, pa.int32()), pa.array(sums[p, code].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(code.astype(np.int32)), pa.array(count[p, code]), lists], ["p", "code", "k", "sums"])

    found = distinct.select("key", "weight").mapInArrow(run, "p int, code int, k long, sums array<long>")
    total = found.groupBy("p", "code").agg(F.sum("k").alias("k"), F.array(*(F.sum(F.col("sums")[j]) for j in range(packing.width))).alias("sums"))
    out = [c.copy() for c in codebooks]
    for r in total.collect():  # PARTS * ENTRIES rows at most
        out[r.p][r.code] = [s // r.k for s in r.sums]
    return out


def assigned(distinct: DataFrame, packing: Packing, codebooks: list[np.ndarray]) -> DataFrame:
    """(key, weight, code, error): each distinct part's nearest entry and squared distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, error = (np.zeros(batch.num_rows, np.int64) for _ in range(2))
            for p, rows, parts in _by_position(packing, batch.column(0)):
                code[rows], error[rows] = nearest(parts, codebooks[p])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code), pa.array(error)], ["key", "weight", "code", "error"])

    return distinct.select("key", "weight").mapInArrow(run, f"key {packing.kind}, weight long, code long, error long")


def codebook_text(codebooks: list[np.ndarray]) -> str:
    """All entries' components by part, entry and position within the part."""
    return ",".join(str(x) for c in codebooks for x in c.ravel().tolist())


def compress(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error) of every kept vector, stored, and the codebooks.

    Null vectors and those with a null or non-finite component are left out.  The others
    are filled up with zeros to the longest one's length, and this to a multiple of PARTS
    (an empty vector is all zeros).  Integers stop at LIMIT.  Repeated rows all count and all
    return, null ids too; with fewer than ENTRIES vectors the codebooks have as many entries.
    ``code`` has two hex digits per part.  Without kept vectors the result is empty and the
    codebooks have no entries.
    """
    before = made()
    kind, label_kind = (dict(vectors.dtypes)[c] for c in (vec_id, label))
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), integers(F.col(embedding)).alias("v")).where("v IS NOT NULL")
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()))  # stored, so a row's number stays
    n, longest, low, high = rows.agg(F.count(F.lit(1)), F.max(F.size("v")), F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
    width = math.ceil((longest or 0) / PARTS)
    packing = Packing(width, min(low or 0, 0), max(high or 0, 0))
    full = rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0), F.lit(PARTS * width) - F.size("v"))))
    codebooks = first_codebooks(full, width)
    keyed = full.select("row", "vec_id", "label", F.posexplode(packing.keys(F.col("v"))).alias("p", "key"))
    # each vector's id and label go with its first part only
    first = lambda c: F.when(F.col("p") == 0, F.col(c)).alias(c)
    keyed = keyed.select("row", "p", "key", first("vec_id"), first("label"))
    distinct = bounded_batches(materialize(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("weight"))))
    for _ in range(ROUNDS if n else 0):
        codebooks = improved(distinct, packing, codebooks)
    found = materialize(assigned(distinct, packing, codebooks)) if n else distinct.select("key", "weight", F.lit(0).cast("long").alias("code"), F.lit(0).cast("long").alias("error"))
    coded = join_unique(keyed, found, ["key"], n, "weight")
    digits = lambda half: F.sum(F.when(F.floor(F.col("p") / 8) == half, F.expr("shiftleft(code, 8 * (7 - p % 8))")).otherwise(0))
    whole = coded.groupBy("row").agg(F.first("vec_id", ignorenulls=True).alias("vec_id"), F.first("label", ignorenulls=True).alias("label"), digits(0).alias("a"), digits(1).alias("b"), F.sum("error").alias("error"))
    hex_ = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    out = materialize(whole.select(F.col("vec_id").cast(kind), F.col("label").cast(label_kind), F.concat(hex_("a"), hex_("b")).alias("code"), "error"))
    discard_since(before, out)
    return out, codebooks


def with_label_errors(coded: DataFrame, codebooks: list[np.ndarray]) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256): with the error summed over the
    vectors of equal label, null labels together."""
    x = coded.withColumns({"_label": F.coalesce(F.col("label").cast("string"), F.lit("")), "_none": F.col("label").isNull()})
    sums = materialize(x.groupBy("_label", "_none").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("_n")))
    if sums.count() <= 1000:
        x = x.join(checked_broadcast(sums.drop("_n")), ["_label", "_none"])
    else:
        x = join_unique(x, sums, ["_label", "_none"], coded.count(), "_n")
    digest = hashlib.sha256(codebook_text(codebooks).encode()).hexdigest()
    return x.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def oracle() -> str:
    dist = "list_sum([(p.x[i] - c.x[i]) * (p.x[i] - c.x[i]) for i in range(1, len(p.x) + 1)])::BIGINT"

    def assign(name: str, books: str) -> str:
        # distance first, then the lower index
        return f"{name} AS (SELECT p.row, p.pos, any_value(p.x) AS x, min({dist} * {ENTRIES} + c.k) AS best FROM p JOIN {books} c USING (pos) GROUP BY p.row, p.pos)"

    def update(name: str, by: str, books: str) -> str:
        return f"""{name}_s AS (SELECT pos, best % {ENTRIES} AS k, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM {by}, range(1, len(x) + 1) r(i) GROUP BY ALL),
{name}_m AS (SELECT pos, k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM {name}_s GROUP BY pos, k),
{name} AS (SELECT pos, k, coalesce(m.x, c.x) AS x FROM {books} c LEFT JOIN {name}_m m USING (pos, k))"""

    return f"""
WITH v AS (SELECT vec_id, label, [floor({SCALE} * x::DOUBLE)::BIGINT for x in embedding] AS w, row_number() OVER (ORDER BY vec_id) AS row FROM embeddings
  WHERE embedding IS NOT NULL AND NOT coalesce(list_bool_or([x IS NULL OR NOT isfinite(x) for x in embedding]), false)),
p AS (SELECT row, pos, w[pos * len(w) // {PARTS} + 1 : (pos + 1) * len(w) // {PARTS}] AS x FROM v, range({PARTS}) r(pos)),
c0 AS (SELECT pos, row - 1 AS k, x FROM p WHERE row <= {ENTRIES}),
{assign('a1', 'c0')}, {update('c1', 'a1', 'c0')}, {assign('a2', 'c1')}, {update('c2', 'a2', 'c1')}, {assign('a3', 'c2')},
r AS (SELECT row, string_agg(lower(lpad(to_hex(best % {ENTRIES}), 2, '0')), '' ORDER BY pos) AS code, sum(best // {ENTRIES})::BIGINT AS error FROM a3 GROUP BY row),
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY pos, k)) AS codebooks_sha256 FROM c2)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM v JOIN r USING (row), h"""
