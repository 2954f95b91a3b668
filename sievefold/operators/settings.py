"""Edits of the criteria, settings and state tables, checked before they are made.

Every function takes a table and gives the next one; bounds are those of the interface,
which for keyword terms and weights are narrower or wider than the tables' own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .budget import next_midnight
from .merge import insert_absent, update_where

# Column to (least, most, whole numbers only).
SETTINGS_BOUNDS = {"notify_score_threshold": (0, 100, True), "max_notifications_per_day": (0, 200, True), "max_scoring_spend_usd_per_day": (0, 50, False), "max_scoring_spend_usd_per_cycle": (0, 50, False)}
FILTER_BOUNDS = {"radius_km": (1, 500, True), "min_duration_weeks": (0, 104, True), "max_listing_age_days": (1, 365, True)}
TERM_LENGTH = (1, 80)
WEIGHT_BOUNDS = (0.5, 2.0)
KINDS, CATEGORIES, SCOPES = ("include", "exclude", "exclude_work_rights"), ("domain", "structural"), ("text", "title")
STATUSES = ("new", "notified", "saved", "applied", "dismissed")
ERROR_LENGTH = 500


def load_settings(settings: DataFrame) -> Row:
    """The one row of settings; without it, nothing may be spent or sent."""
    found = settings.where("id = 1").limit(1).collect()
    return found[0] if found else Row(id=1, is_paused=False, notify_score_threshold=70, max_notifications_per_day=0, scoring_spend_today=0.0, max_scoring_spend_usd_per_day=0.0, max_scoring_spend_usd_per_cycle=0.0, scoring_spend_reset_at=None)


def load_sources(sources: DataFrame) -> list[Row]:
    """The boards' states by name: a handful of rows."""
    return sources.orderBy("name").collect()


def seed_keywords(keywords: DataFrame, filters: DataFrame, terms: DataFrame) -> DataFrame:
    """Adds the terms (any columns of ``keywords`` but filter_id) to every active filter;
    those that a filter has already stay as they are.  ``terms`` is a literal list."""
    new = filters.where("is_active").select(F.col("id").alias("filter_id")).crossJoin(F.broadcast(terms))
    return insert_absent(keywords, new, ["filter_id", "term", "kind"])


def _checked(patch: dict, bounds: dict[str, tuple]) -> dict[str, Column]:
    out = {}
    for name, value in patch.items():
        if value in (None, ""):  # left blank in a form
            continue
        if name not in bounds:
            raise ValueError(f"{name} can't be edited")
        low, high, whole = bounds[name]
        number = float(value)
        if not low <= number <= high or whole and number != int(number):
            raise ValueError(f"{name} must be {'a whole number ' if whole else ''}from {low} to {high}")
        out[name] = F.lit(int(number) if whole else number)
    return out


def _cast_like(df: DataFrame, values: dict[str, Column]) -> dict[str, Column]:
    kinds = dict(df.dtypes)
    return {k: v.cast(kinds[k]) for k, v in values.items()}


def update_settings(settings: DataFrame, **patch) -> DataFrame:
    enabled = patch.pop("scoring_enabled", None)
    values = _checked(patch, SETTINGS_BOUNDS)
    if enabled is not None:
        values["scoring_enabled"] = F.lit(bool(enabled))
    return update_where(settings, F.col("id") == 1, **_cast_like(settings, values)) if values else settings


def set_paused(settings: DataFrame, paused: bool) -> DataFrame:
    return update_where(settings, F.col("id") == 1, is_paused=F.lit(paused))


def update_filter(filters: DataFrame, filter_id: str, **patch) -> DataFrame:
    values = _checked(patch, FILTER_BOUNDS)
    return update_where(filters, F.col("id") == filter_id, **_cast_like(filters, values)) if values else filters


def set_match_status(matches: DataFrame, match_id, status: str) -> DataFrame:
    """Any status may be set, ``new`` too, which queues the match again."""
    if status not in STATUSES:
        raise ValueError(f"unknown status {status!r}")
    return update_where(matches, F.col("id") == match_id, status=F.lit(status))


def set_keyword_active(keywords: DataFrame, keyword_id, active: bool) -> DataFrame:
    return update_where(keywords, F.col("id") == keyword_id, is_active=F.lit(active))


def add_keyword(keywords: DataFrame, row: dict) -> DataFrame:
    """Adds an active term of weight 1; a term of the same filter and kind in any case
    stays as it is."""
    term = str(row.get("term", "")).strip()
    full = {"category": "domain", "match_scope": "text", "whole_word": False, "case_sensitive": False, **row, "term": term, "weight": 1.0, "is_active": True}
    if not TERM_LENGTH[0] <= len(term) <= TERM_LENGTH[1]:
        raise ValueError("a term has 1 to 80 characters")
    for name, allowed in (("kind", KINDS), ("category", CATEGORIES), ("match_scope", SCOPES)):
        if full.get(name) not in allowed:
            raise ValueError(f"{name} must be one of {', '.join(allowed)}")
    spark = keywords.sparkSession
    new = spark.range(1).select(*(F.lit(full.get(f.name)).cast(f.dataType).alias(f.name) for f in keywords.schema.fields))
    low = lambda df: df.withColumn("_low", F.lower("term"))
    return insert_absent(low(keywords), low(new), ["filter_id", "_low", "kind"]).drop("_low")


def set_preference_weight(preferences: DataFrame, preference_id, weight: float) -> DataFrame:
    if not WEIGHT_BOUNDS[0] <= weight <= WEIGHT_BOUNDS[1]:
        raise ValueError("a weight lies from 0.5 to 2")
    return update_where(preferences, F.col("id") == preference_id, **_cast_like(preferences, {"weight": F.lit(weight)}))


def set_source_enabled(sources: DataFrame, name: str, enabled: bool) -> DataFrame:
    return update_where(sources, F.col("name") == name, enabled=F.lit(enabled))


def record_spend(settings: DataFrame, usd: float, now: Column) -> DataFrame:
    """Adds to the day's spend at six decimals; past its reset the day starts anew."""
    if usd <= 0:
        return settings
    over = now >= F.col("scoring_spend_reset_at")
    total = F.round(F.when(over, F.lit(0.0)).otherwise(F.col("scoring_spend_today").cast("double")) + F.lit(usd), 6)
    new = {"scoring_spend_today": total, "scoring_spend_reset_at": F.when(over, next_midnight(now)).otherwise(F.col("scoring_spend_reset_at"))}
    return update_where(settings, F.col("id") == 1, **_cast_like(settings, new))


def notification_rows(sent: DataFrame, now: Column) -> DataFrame:
    """Log rows of attempts (match_id, channel, chat_id, message_id, payload, error): sent
    or failed, errors cut to ERROR_LENGTH characters.  Append them to the log."""
    failed = F.col("error").isNotNull()
    return sent.select(
        F.expr("uuid()").alias("id"), "match_id", "channel", "chat_id", "message_id", "payload",
        F.when(failed, "failed").otherwise("sent").alias("status"), F.substring("error", 1, ERROR_LENGTH).alias("error"), now.alias("sent_at"),
    )


def sent_today(log: DataFrame, now: Column) -> DataFrame:
    """One row: notifications sent since midnight UTC."""
    return log.where((F.col("status") == "sent") & (F.col("sent_at") >= F.date_trunc("day", now))).agg(F.count(F.lit(1)).alias("sent_today"))
