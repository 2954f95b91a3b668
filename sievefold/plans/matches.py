"""Queries over matches and the listings they score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.budget import BATCH, Desc, in_batches, running_total, within_budget
from ..operators.settings import load_settings, sent_today

RANKING = ("fit_score", "base_score")


def ranked(df: DataFrame) -> DataFrame:
    return df.orderBy(*(F.desc(c) for c in RANKING), "match_id")


def with_listing(matches: DataFrame, listings: DataFrame) -> DataFrame:
    return matches.join(listings.withColumnRenamed("id", "listing_id"), "listing_id")


def work_queue(listings: DataFrame, matches: DataFrame, limit: int | None = None, rescore: bool = False) -> DataFrame:
    """Passed, canonical listings without a match, by multiplier and id."""
    todo = listings.where("status = 'passed' AND duplicate_of IS NULL")
    if not rescore:
        todo = todo.join(matches.select(F.col("listing_id").alias("id")), "id", "left_anti")
    todo = todo.orderBy(F.desc("preference_multiplier"), "id")
    return todo if limit is None else todo.limit(limit)


def score_batches(queue: DataFrame, cost: Column, budget: int, size: int = BATCH) -> DataFrame:
    """(batch, rows, cost, spent_before) of the batches that the budget lets run."""
    order = [F.desc("preference_multiplier"), F.col("id")]
    numbered = in_batches(queue, [Desc(F.col("preference_multiplier")), F.floor(F.col("id") / 100_000)], order, size)
    batches = numbered.groupBy("batch").agg(F.count(F.lit(1)).alias("rows"), F.sum(cost).alias("cost"))
    return within_budget(batches, budget)


def notify_queue(matches: DataFrame, listings: DataFrame, threshold: int, sent_today: int, cap: int, candidates: int = 100) -> DataFrame:
    """The best new matches above the threshold whose listing is no duplicate: the first
    ``candidates``, of which those within today's remaining quota are sent."""
    x = with_listing(matches.where((F.col("match_status") == "new") & (F.col("fit_score") >= threshold)), listings.where("duplicate_of IS NULL"))
    top = ranked(x).limit(candidates)
    # at most ``candidates`` rows from here on
    rank = running_total(top, F.lit(1), [Desc(F.col("fit_score"))], [F.desc("base_score"), F.col("match_id")], "rank")
    return rank.withColumn("send", F.col("rank") <= max(0, cap - sent_today))


def match_page(matches: DataFrame, listings: DataFrame, status: str = "undecided", min_score: int | None = None, search: str | None = None, page: int = 1, per_page: int = 25) -> tuple[DataFrame, DataFrame]:
    """One page of matches in rank order, and the number of all that fit (one row).

    ``undecided`` is new or notified, ``all`` no condition; in a search text the characters
    ``(),*"\\`` are blanks, and % and _ are wildcards."""
    x = with_listing(matches, listings)
    if status == "undecided":
        x = x.where(F.col("match_status").isin("new", "notified"))
    elif status != "all":
        x = x.where(F.col("match_status") == status)
    if min_score is not None:
        x = x.where(F.col("fit_score") >= min_score)
    words = "".join(" " if c in '(),*"\\' else c for c in search or "").strip()
    if words:
        x = x.where(F.col("title").ilike(f"%{words}%") | F.col("company").ilike(f"%{words}%"))
    per_page, page = min(100, max(1, per_page)), max(1, page)
    return ranked(x).offset((page - 1) * per_page).limit(per_page), x.agg(F.count(F.lit(1)).alias("total"))


def latest_decisions(matches: DataFrame, listings: DataFrame, statuses: tuple[str, ...] = ("saved", "applied", "dismissed"), limit: int = 20) -> DataFrame:
    """The newest decisions; listings that are duplicates stay in."""
    return with_listing(matches.where(F.col("match_status").isin(*statuses)), listings).orderBy(F.desc("updated_at"), "match_id").limit(limit)


def top_matches(matches: DataFrame, listings: DataFrame, n: int = 5) -> DataFrame:
    """The n best (1 to 10) undecided matches of canonical listings."""
    x = with_listing(matches.where(F.col("match_status").isin("new", "notified")), listings.where("duplicate_of IS NULL"))
    return ranked(x).limit(min(10, max(1, n)))


def pipeline_stats(listings: DataFrame, matches: DataFrame, threshold: int) -> DataFrame:
    """One row of counts.  ``above_threshold`` doesn't ask for a passed listing, and
    ``scored`` counts duplicates too."""
    l = listings.select(F.col("id").alias("listing_id"), F.lit(True).alias("_l"), (F.col("status") == "passed").alias("_passed"), F.col("duplicate_of").isNull().alias("_canonical"))
    m = matches.select("listing_id", F.lit(True).alias("_m"), "match_status", (F.col("fit_score") >= threshold).alias("_above"))
    # a listing has one match at most, so every row of either side occurs once
    x = l.join(m, "listing_id", "full")
    both, scorable = F.col("_l") & F.col("_m"), F.col("_passed") & F.col("_canonical")
    one = x.agg(
        F.count("_l").alias("listings_total"), F.count_if("_passed").alias("listings_passed"), F.count_if(~F.col("_canonical")).alias("duplicates"), F.count("_m").alias("scored"),
        F.count_if(both & F.col("_above") & F.col("_canonical")).alias("above_threshold"), (F.count_if(scorable) - F.count_if(both & scorable)).alias("_open"),
        *(F.count_if(F.col("match_status") == s).alias(f"n_{s}") for s in ("new", "notified", "saved", "applied", "dismissed")),
    )
    return one.withColumn("awaiting_score", F.greatest(F.lit(0), F.col("_open"))).drop("_open")


def full_stats(listings: DataFrame, matches: DataFrame, settings: DataFrame, log: DataFrame, now: str) -> DataFrame:
    """``pipeline_stats`` under the stored threshold, with the day's spend and notifications."""
    s, moment = load_settings(settings), F.lit(now).cast("timestamp")
    spent = F.when(moment >= F.lit(s.scoring_spend_reset_at), F.lit(0.0)).otherwise(F.lit(float(s.scoring_spend_today)))
    return pipeline_stats(listings, matches, s.notify_score_threshold).withColumns(
        {
            "threshold": F.lit(s.notify_score_threshold), "spent_today": spent, "spend_cap_per_day": F.lit(float(s.max_scoring_spend_usd_per_day)),
            "notified_today": sent_today(log, moment).scalar(), "notify_cap_per_day": F.lit(s.max_notifications_per_day), "paused": F.lit(s.is_paused),
        }
    )


def score_payload(batch: DataFrame) -> Column:
    """A listing as the scorer sees it: no id, its position in the batch as ``ref``."""
    return F.to_json(
        F.struct(
            "ref", "title", "company", F.col("suburb").alias("location"), "distance_km",
            F.concat_ws("/", "compensation", "work_mode", "commitment", "role_type").alias("signals"),
            F.col("duration_weeks").alias("stated_duration_weeks"), "description",
        ),
        {"ignoreNullFields": "false"},
    )
