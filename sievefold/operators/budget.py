"""Budgets, quotas, cadence and state machines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BATCH = 8
# Dollars per million tokens.
PRICES = {"input": 2.0, "output": 10.0, "cache_write": 2.5, "cache_read": 0.2}


def request_cost_usd(fresh: Column, out: Column, written: Column, read: Column, prices: dict[str, float] = PRICES) -> Column:
    part = lambda c, k: F.coalesce(c, F.lit(0)) * F.lit(prices[k])
    return (part(fresh, "input") + part(out, "output") + part(written, "cache_write") + part(read, "cache_read")) / F.lit(1_000_000.0)


def running_total(df: DataFrame, value: Column, bucket: list[Column], order: list[Column], name: str) -> DataFrame:
    """Adds the sum of ``value`` over all rows up to and including each in ``order``,
    without one task that holds all rows: a window inside the buckets, and a window over
    the bucket totals.  ``bucket`` columns must be sorted as ``order`` is (coarser keys of
    the same order)."""
    keys = [f"_b{i}" for i in range(len(bucket))]
    x = df.withColumns({k: b for k, b in zip(keys, (_plain(b) for b in bucket), strict=True)} | {"_v": value})
    totals = x.groupBy(*keys).agg(F.sum("_v").alias("_t"))
    rank = [F.col(k).desc() if _descends(b) else F.col(k).asc() for k, b in zip(keys, bucket, strict=True)]
    ahead = Window.orderBy(*rank).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_before", F.coalesce(F.sum("_t").over(ahead), F.lit(0))).drop("_t")
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    offsets = offsets.select("_before", *(F.col(k).alias(f"_o{k}") for k in keys))
    met = [x[k].eqNullSafe(F.col(f"_o{k}")) for k in keys]  # a null bucket is a bucket
    return x.withColumn("_in", F.sum("_v").over(inside)).join(offsets, met).drop(*(f"_o{k}" for k in keys)).withColumn(name, F.col("_in") + F.col("_before")).drop(*keys, "_v", "_in", "_before")


class Desc:
    """Marks a bucket column that is sorted downwards."""

    def __init__(self, column: Column):
        self.column = column


def _plain(b) -> Column:
    return b.column if isinstance(b, Desc) else b


def _descends(b) -> bool:
    return isinstance(b, Desc)


def in_batches(df: DataFrame, bucket: list, order: list[Column], size: int = BATCH) -> DataFrame:
    """Adds rn (from 1), batch (from 0) and ref (from 1 inside the batch) along the order."""
    x = running_total(df, F.lit(1), bucket, order, "rn")
    return x.withColumn("batch", F.floor((F.col("rn") - 1) / size)).withColumn("ref", ((F.col("rn") - 1) % size + 1).cast("int"))


def within_budget(batches: DataFrame, budget: int, cost: str = "cost", order: str = "batch", per_bucket: int = 10_000) -> DataFrame:
    """Batches that run: those before which the cost spent so far is below the budget.
    The last one may exceed it, by one batch at most."""
    x = running_total(batches, F.col(cost), [F.floor(F.col(order) / per_bucket)], [F.col(order)], "_through")
    return x.withColumn("spent_before", F.col("_through") - F.col(cost)).drop("_through").where(F.col("spent_before") < budget)


def next_midnight(now: Column) -> Column:
    return F.date_trunc("day", now) + F.expr("INTERVAL 1 DAY")


def spend_allowance(cycle: Column, day: Column, spent: Column, reset: Column, now: Column) -> Column:
    """What may still be spent: the cycle's cap or what the day leaves, never negative.
    Past the reset the day starts anew."""
    today = F.when(now >= reset, F.lit(0)).otherwise(spent)
    return F.greatest(F.lit(0), F.least(cycle, day - today))


def source_due(now: Column) -> Column:
    """'due', or why a source (enabled, calls_today, max_calls_per_day, quota_reset_at,
    last_polled_at, poll_interval_minutes) isn't polled."""
    spent = (now < F.col("quota_reset_at")) & (F.col("calls_today") >= F.col("max_calls_per_day"))
    waited = (F.unix_micros(now) - F.unix_micros(F.col("last_polled_at"))) / F.lit(60_000_000.0)
    text = lambda c: F.col(c).cast("string")
    quota = F.concat(F.lit("daily quota spent ("), text("calls_today"), F.lit("/"), text("max_calls_per_day"), F.lit("), resets "), F.date_format("quota_reset_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    wait = F.concat(F.lit("not due for "), F.ceil(F.col("poll_interval_minutes") - waited).cast("string"), F.lit("m"))
    return F.when(~F.col("enabled"), "disabled").when(spent, quota).when(waited < F.col("poll_interval_minutes"), wait).otherwise("due")


def record_poll(sources: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """Source rows after polls (name, calls, ok, error): the quota rolls over at its reset,
    failures count up until a success."""
    o = outcomes.select("name", "calls", "ok", F.col("error").alias("_error"))
    x = sources.join(o, "name", "left")
    polled, over = F.col("calls").isNotNull(), now >= F.col("quota_reset_at")
    new = {
        "calls_today": F.when(over, F.lit(0)).otherwise(F.col("calls_today")) + F.col("calls"),
        "quota_reset_at": F.when(over, next_midnight(now)).otherwise(F.col("quota_reset_at")),
        "last_polled_at": now,
        "last_success_at": F.when(F.col("ok"), now).otherwise(F.col("last_success_at")),
        "last_error": F.when(F.col("ok"), F.lit(None)).otherwise(F.col("_error")),
        "consecutive_failures": F.when(F.col("ok"), F.lit(0)).otherwise(F.col("consecutive_failures") + 1),
    }
    return x.select(*(F.when(polled, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in sources.columns))


def failure_streaks(log: DataFrame, key: str, order: list[str], failed: Column) -> DataFrame:
    """Adds the number of failures in a row up to each event of its key."""
    w = Window.partitionBy(key).orderBy(*order)
    ok = (~failed).cast("int")
    return log.withColumn("_run", F.sum(ok).over(w)).withColumn("streak", F.sum(failed.cast("int")).over(Window.partitionBy(key, "_run").orderBy(*order)).cast("long")).drop("_run")


#: Decisions that a match may take from each status; a dashboard may set any.
TRANSITIONS = {"new": ("notified", "saved", "applied", "dismissed"), "notified": ("saved", "applied", "dismissed"), "saved": ("applied", "dismissed"), "applied": (), "dismissed": ()}


def latest_decision(events: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """The last event of each key wins."""
    return events.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


# What such errors say.
ACCOUNT_LEVEL = r"(?i)credit balance is too low|insufficient[_ ]quota|billing|payment required|401|authentication_error|invalid x-api-key|permission_error|403"


def account_level_failure(message: Column) -> Column:
    """Errors that no retry mends: the account's credentials or credit."""
    return F.coalesce(message.rlike(ACCOUNT_LEVEL), F.lit(False))


# What such reasoning holds.
LEAKED = r'\}\s*,\s*\{|"ref"\s*:'


def leaked_json(reasoning: Column) -> Column:
    """Whether a scorer's reasoning ran on into the next entries of its output."""
    return F.coalesce(reasoning.rlike(LEAKED), F.lit(False))


def batch_is_valid(scores: DataFrame, expected: DataFrame) -> DataFrame:
    """(batch, valid): as many scores as rows were sent, none with leaked output."""
    got = scores.groupBy("batch").agg(F.count(F.lit(1)).alias("_got"), F.max(leaked_json(F.col("reasoning")).cast("int")).alias("_leak"))
    want = expected.groupBy("batch").agg(F.count(F.lit(1)).alias("_want"))
    return want.join(got, "batch", "left").select("batch", (F.coalesce(F.col("_got"), F.lit(0)) == F.col("_want")).__and__(F.coalesce(F.col("_leak"), F.lit(0)) == 0).alias("valid"))


def score_bucket(score: Column) -> Column:
    return F.when(score >= 80, "80-100").when(score >= 70, "70-79").when(score >= 50, "50-69").when(score >= 25, "25-49").otherwise("0-24")


BUCKETS = ("80-100", "70-79", "50-69", "25-49", "0-24")
