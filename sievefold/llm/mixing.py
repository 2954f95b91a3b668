"""Mixing sources to target weights by weighted fair queueing, DataFrame only.

Every source's documents stand in a pseudo-random order.  Copy ``e`` of a document
gets the virtual finish time ``(e * source_size + tokens of its source up to and
including it) / target``; all copies, sorted by that time, are taken until the total
budget is used up.

No running sum is one task per source.  A source's prefix sum is two-level: its rows
fall into buckets by the first hex digits of their shuffle key, a window sums inside
(bucket, source), and a window over the few bucket totals gives the offsets; a source
with a third of all rows is thus spread over all buckets.  The global sort by finish
time is a range partitioning into time ranges: range totals give the one range in
which the budget ends, and only that range is sorted.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import WORD, materialize, word_count

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
#: Documents that one bucket or time range holds on average, at most.
PER_BUCKET = 20_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = MAX_COPIES) -> DataFrame:
    """(source, source_size, target) from one row per source.

    Sources by code point, null last, weigh ``weights`` in turn and share the total
    size; a target stops at ``cap`` times its source's size and the excess is shared
    by weight among the others until none is above.  Sorted by cap/weight, the capped
    sources are a prefix: source i is capped if, with all before it capped, its share
    of the rest reaches its cap.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    x = sizes.withColumn("nth", F.row_number().over(by_name) - 1)
    x = x.withColumn("w", F.element_at(F.lit(list(weights)), (F.col("nth") % len(weights) + 1).cast("int")).cast("double"))
    x = x.withColumn("room", F.col("source_size") * F.lit(float(cap))).withColumn("ratio", F.col("room") / F.col("w"))
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    x = (
        x.withColumn("total", F.sum("source_size").over(every).cast("double"))
        .withColumn("used", F.coalesce(F.sum("room").over(before), F.lit(0.0)))
        .withColumn("left_w", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.col("used")) / F.col("left_w"))
        .withColumn("capped", F.col("level") >= F.col("ratio"))
    )
    # the first source that isn't capped fixes the level of all that follow
    level = F.min(F.when(~F.col("capped"), F.struct("ratio", "level"))).over(every)
    x = x.withColumn("final", level["level"])
    return x.select("source", "source_size", F.when(F.col("capped"), F.col("room")).otherwise(F.col("final") * F.col("w")).alias("target"))


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken), one row per row of ``docs``.

    ``size`` is the number of words (null text: 0), ``taken`` the words that the mix
    takes of this document: 0 to ``max_copies`` times its size.  A null source is a
    source of its own, sorted last.  Rows with equal ids are different documents; rows
    equal in id, source and size are told apart by an occurrence number.  A table
    without words takes nothing (target 0); an empty table gives an empty result.
    Extra columns of ``docs`` are not read.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    rows = materialize(rows)  # the texts are read once
    n = rows.count()
    digits = max(2, math.ceil(math.log(max(1, n / PER_BUCKET), 16)))
    same = Window.partitionBy("doc_id", "source", "size").orderBy(F.lit(0))
    text_key = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("doc_id", "source", "size", "nth")))
    rows = rows.withColumn("nth", F.row_number().over(same)).withColumn("h", F.md5(text_key)).withColumn("b", F.substring("h", 1, digits))
    rows = rows.withColumn("skey", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null")))

    totals = rows.groupBy("skey", "source", "b").agg(F.sum("size").alias("sum"))
    targets = source_targets(totals.groupBy("source").agg(F.sum("sum").alias("source_size")), weights, max_copies)
    targets = targets.select(F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null")).alias("skey"), "source_size", "target")
    before = Window.partitionBy("skey").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("skey", "b", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("offset")).join(targets, "skey")
    inside = Window.partitionBy("b", "skey").orderBy("h", "doc_id", "nth").rowsBetween(Window.unboundedPreceding, 0)
    queued = rows.withColumn("inside", F.sum("size").over(inside)).join(offsets, ["skey", "b"])
    finish = [F.try_divide(e * F.col("source_size") + F.col("inside") + F.col("offset"), F.col("target")).alias(f"f{e}") for e in range(max_copies)]
    queued = materialize(queued.select("doc_id", "source", "size", "source_size", "target", "h", "skey", *finish))
    before_cut = _cut(queued, n, max_copies)
    taken = [F.when(before_cut(F.col(f"f{e}")), F.col("size")).otherwise(F.lit(0)) for e in range(max_copies)]
    return queued.select("doc_id", "source", "size", "source_size", "target", sum(taken[1:], taken[0]).cast("long").alias("taken"))


def _cut(queued: DataFrame, n: int, max_copies: int):
    """Where the budget (the documents' total size) ends in the order (finish, h):
    a function from a finish time to whether that copy is taken."""
    fine = max(256, math.ceil(n / PER_BUCKET))
    # linear up to virtual time 1, where every source has had its target, then logarithmic
    ranged = lambda f: F.when(f <= 1, F.floor(f * fine)).otherwise(fine + 1 + F.floor(F.log2(f) * fine)).cast("long")
    copies = queued.where("size > 0").select("size", "h", F.explode(F.array(*(f"f{e}" for e in range(max_copies)))).alias("f")).withColumn("t", ranged(F.col("f")))
    by_time = Window.orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    through = copies.groupBy("t").agg(F.sum("size").alias("sum")).withColumn("through", F.sum("sum").over(by_time))
    budget = queued.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("v")).first().v
    # the first range that goes beyond the budget; max_copies > 1 copies of all always do
    at = through.where(F.col("through") > budget).orderBy("t").limit(1).collect()
    if not at:
        return lambda f: f.isNotNull()
    t, start = at[0].t, at[0].through - at[0]["sum"]
    order = Window.orderBy("f", "h").rowsBetween(Window.unboundedPreceding, 0)
    last = copies.where(F.col("t") == t).withColumn("through", F.lit(start) + F.sum("size").over(order)).where(F.col("through") <= budget).agg(F.max(F.struct("f", "h")).alias("m")).first().m
    if last is None:
        return lambda f: ranged(f) < t
    return lambda f: (ranged(f) < t) | ((ranged(f) == t) & (F.struct(f.alias("f"), F.col("h").alias("h")) <= F.struct(F.lit(last.f).alias("f"), F.lit(last.h).alias("h"))))


def oracle(weights: tuple[int, ...] = WEIGHTS, cap: int = MAX_COPIES) -> str:
    copies = ", ".join(f"({e})" for e in range(cap))
    return f"""
WITH sized AS (SELECT doc_id, source, coalesce(length(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size FROM documents),
rows_ AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source, size) AS nth FROM sized),
keyed AS (SELECT *, md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(source, '') || '|' || size || '|' || nth) AS h FROM rows_),
sources AS (SELECT source, sum(size)::BIGINT AS source_size, [{', '.join(map(str, weights))}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)} + 1]::DOUBLE AS w FROM keyed GROUP BY source),
room AS (SELECT *, source_size * {cap}::DOUBLE AS room, source_size * {cap}::DOUBLE / w AS ratio FROM sources),
levels AS (SELECT *, (sum(source_size) OVER ())::DOUBLE AS total, coalesce(sum(room) OVER o, 0) AS used, sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS left_w
  FROM room WINDOW o AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
capped AS (SELECT *, (total - used) / left_w AS level, (total - used) / left_w >= ratio AS capped FROM levels),
targets AS (SELECT source, source_size, CASE WHEN capped THEN room ELSE (SELECT arg_min(level, ratio) FROM capped WHERE NOT capped) * w END AS target FROM capped),
queued AS (SELECT k.*, t.source_size, t.target, sum(size) OVER (PARTITION BY k.source ORDER BY h, k.doc_id, nth)::BIGINT AS cum FROM keyed k JOIN targets t ON k.source IS NOT DISTINCT FROM t.source),
copies AS (SELECT q.*, (e.e * source_size + cum) / target AS f FROM queued q, (VALUES {copies}) e(e) WHERE size > 0),
taken AS (SELECT *, sum(size) OVER (ORDER BY f, h) <= (SELECT sum(size) FROM keyed) AS yes FROM copies),
sums AS (SELECT h, sum(size)::BIGINT AS taken FROM taken WHERE yes GROUP BY h)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM queued LEFT JOIN sums USING (h)"""
