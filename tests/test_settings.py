"""Checked edits of settings, criteria and state."""

import pytest
from pyspark.sql import functions as F

from sievefold.functions import render
from sievefold.operators import settings as S
from sievefold.schemas import APP_SETTINGS


@pytest.fixture(scope="module")
def settings(spark):
    row = {"id": 1, "is_paused": False, "notify_score_threshold": 70, "max_notifications_per_day": 25, "scoring_enabled": False, "scoring_batch_size": 8}
    base = spark.createDataFrame([tuple(row.values())], "id int, is_paused boolean, notify_score_threshold int, max_notifications_per_day int, scoring_enabled boolean, scoring_batch_size int")
    full = base.select("*", F.lit(0.5).alias("max_scoring_spend_usd_per_cycle"), F.lit(2.0).alias("max_scoring_spend_usd_per_day"), F.lit(1.25).alias("scoring_spend_today"), F.lit("2026-01-02").alias("scoring_spend_reset_at"), F.lit("2026-01-01").alias("updated_at"))
    kinds = {c.strip().split()[0]: c.strip().split()[1] for c in APP_SETTINGS.replace("\n", " ").replace("(8,4)", "(8;4)").replace("(10,6)", "(10;6)").split(",")}
    return full.select(*(F.col(k).cast(v.replace(";", ",")).alias(k) for k, v in kinds.items()))


def test_settings(settings):
    assert S.update_settings(settings, notify_score_threshold=80, max_notifications_per_day="").first().notify_score_threshold == 80
    assert S.set_paused(settings, True).first().is_paused
    assert S.update_settings(settings, scoring_enabled=True).first().scoring_enabled
    for bad in ({"notify_score_threshold": 101}, {"notify_score_threshold": 1.5}, {"max_scoring_spend_usd_per_day": 51}, {"id": 2}):
        with pytest.raises(ValueError):
            S.update_settings(settings, **bad)


def test_spend(settings):
    at = lambda t: F.lit(t).cast("timestamp")
    same = S.record_spend(settings, 0.25, at("2026-01-01 10:00:00")).first()
    assert float(same.scoring_spend_today) == 1.5 and same.scoring_spend_reset_at.day == 2
    new = S.record_spend(settings, 0.25, at("2026-01-02 10:00:00")).first()
    assert float(new.scoring_spend_today) == 0.25 and new.scoring_spend_reset_at.day == 3


def test_keywords(spark):
    kw = spark.createDataFrame([("f", "IT", "include", "domain", "text", True, True, 1.0, True)], "filter_id string, term string, kind string, category string, match_scope string, whole_word boolean, case_sensitive boolean, weight double, is_active boolean")
    assert S.add_keyword(kw, {"filter_id": "f", "term": " SOC ", "kind": "include"}).count() == 2
    assert S.add_keyword(kw, {"filter_id": "f", "term": "it", "kind": "include"}).count() == 1
    for bad in ({"term": " ", "kind": "include"}, {"term": "x", "kind": "other"}, {"term": "x" * 81, "kind": "include"}):
        with pytest.raises(ValueError):
            S.add_keyword(kw, {"filter_id": "f", **bad})


def test_states(spark):
    m = spark.createDataFrame([(1, "saved")], "id int, status string")
    assert S.set_match_status(m, 1, "new").first().status == "new"
    with pytest.raises(ValueError):
        S.set_match_status(m, 1, "gone")
    p = spark.createDataFrame([(1, 1.0)], "id int, weight double")
    assert S.set_preference_weight(p, 1, 2).first().weight == 2
    with pytest.raises(ValueError):
        S.set_preference_weight(p, 1, 2.1)
    f = spark.createDataFrame([("a", 50, 6, 30)], "id string, radius_km int, min_duration_weeks int, max_listing_age_days int")
    assert S.update_filter(f, "a", radius_km="70").first().radius_km == 70
    assert not S.set_source_enabled(spark.createDataFrame([("b", True)], "name string, enabled boolean"), "b", False).first().enabled


def test_log(spark):
    now = F.lit("2026-01-01 10:00:00").cast("timestamp")
    sent = spark.createDataFrame([("m", "chat", "c", 5, "hi", None), ("n", "chat", "c", None, "hi", "e" * 900)], "match_id string, channel string, chat_id string, message_id long, payload string, error string")
    log = S.notification_rows(sent, now)
    assert {(r.status, len(r.error or "")) for r in log.collect()} == {("sent", 0), ("failed", 500)}
    assert S.sent_today(log, now).first().sent_today == 1


def test_messages(spark):
    row = spark.range(1).select(render.history_line(F.lit(90), F.lit("A & B"), F.lit(None).cast("string"), F.lit("saved")).alias("y")).first().y
    assert row == "⭐ <b>90</b> A &amp; B"
    names = ["listings_total", "listings_passed", "duplicates", "scored", "awaiting_score", "threshold", "above_threshold", "notified", "notify_cap", *(f"n_{s}" for s in S.STATUSES)]
    s = {n: F.lit(i) for i, n in enumerate(names)} | {"paused": F.lit(True), "spent": F.lit(1.5), "spend_cap": F.lit(2)}
    text = spark.range(1).select(render.stats_message(s).alias("y")).first().y
    assert text.startswith("<b>Pipeline</b> — ⏸ paused\n\nListings   0 stored") and "Spend      $1.5000 of $2.00 today" in text
