"""Scoring runs within a budget, whole micro-batch cycles, keyboards and messages."""

import json

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from sievefold.criteria import small_criteria
from sievefold.functions import render
from sievefold.operators.prefilter import prefilter
from sievefold.operators.store import store
from sievefold.operators.tables import Tables
from sievefold.plans import scoring
from sievefold.sources.board_source import BoardSource
from sievefold.streaming import polls
from sievefold.streaming.cycle import Cycle, failure_rows, start

NOW = "2001-08-01 00:00:00"
LISTING = "id long, source string, source_id string, url string, title string, company string, description string, location_raw string, latitude double, longitude double, salary_min double, salary_max double, salary_is_predicted boolean, posted_date timestamp, provider_matched_term string, hint_commitment string, hint_work_mode string, hint_role_type string"
SETTINGS = "id int, is_paused boolean, scoring_enabled boolean, notify_score_threshold int, max_notifications_per_day int, scoring_spend_today double, max_scoring_spend_usd_per_day double, max_scoring_spend_usd_per_cycle double, scoring_spend_reset_at timestamp"


def listings(spark, n, start_at=0):
    blank = {c.split()[0]: None for c in LISTING.split(", ")}
    rows = [Row(**(blank | dict(id=i, source="s", source_id=str(i), url=f"http://a.b/{i}", title=f"Cyber Security Intern {i}", company=f"c{i}", description="On site", location_raw="Melbourne VIC 3000"))) for i in range(start_at, start_at + n)]
    return spark.createDataFrame(rows, LISTING)


def queue(spark, n):
    """The first n of 45 listings, judged once for all tests."""
    if "judged" not in _kept:
        _kept["judged"] = store(prefilter(listings(spark, 45), small_criteria(), NOW))
    return _kept["judged"].where(F.col("id") < n)


_kept = {}


def test_run_ends_at_its_budget(spark):
    scorer = scoring.priced(scoring.rule_scorer, lambda n: n / 16)
    done = scoring.run(queue(spark, 45), scorer, 45 / 16, 8 / 16)
    assert (done.queued, done.batches, done.failed, done.usd, done.ended) == (45, 6, 0, 45 / 16, "done") and done.scored.count() == 45
    # batches of 8 cost a half each: after the third the budget of 1.25 is spent
    done = scoring.run(queue(spark, 45), scorer, 1.25, 8 / 16)
    assert (done.batches, done.usd, done.ended, done.scored.count()) == (3, 1.5, "budget", 24)
    # a bound above the price costs further waves, never more batches
    done = scoring.run(queue(spark, 45), scorer, 1.25, 1.0)
    assert (done.batches, done.usd, done.ended) == (3, 1.5, "budget")
    assert scoring.run(queue(spark, 9), scorer, 0.0, 1.0).ended == "budget"
    assert scoring.run(queue(spark, 9), scorer, 9.0, 1.0, stopped=lambda: True).ended == "stopped"
    none = scoring.run(queue(spark, 3).where("false"), scorer, 9.0, 1.0)
    assert (none.queued, none.batches, none.ended, none.scored.count()) == (0, 0, "done", 0)


def test_failed_batches_leave_the_others(spark):
    def failing(batch, payloads):
        if batch == 1:
            raise scoring.ScorerError("bad request", 400, usd=0.25)
        got = scoring.rule_scorer(batch, payloads)
        return [*got[:-1], (99, 50, "made up", "x")] if batch == 2 else got, 0.5

    def first_is_plain(batch, payloads):
        got = failing(batch, payloads)
        return got if isinstance(got, tuple) else (got, 0.5)

    done = scoring.run(queue(spark, 24), first_is_plain, 9.0, 1.0)
    assert (done.failed, done.usd, done.ended) == (1, 1.25, "done")
    assert {(r.batch, r.n) for r in done.scored.groupBy("batch").agg(F.count("*").alias("n")).collect()} == {(0, 8), (2, 7)}


def test_account_error_ends_the_run(spark):
    def broke(batch, payloads):
        raise RuntimeError("credit balance is too low")

    done = scoring.run(queue(spark, 40), broke, 1.0, 1.0)
    assert (done.batches, done.failed, done.ended, done.scored.count()) == (1, 1, "account", 0)


@pytest.mark.parametrize(
    ("error", "calls", "waits"),
    [
        (scoring.ScorerError("slow down", 429), 4, [2, 4, 8]), (ConnectionError("lost"), 4, [2, 4, 8]), (scoring.ScorerError("oops", 503), 4, [2, 4, 6]),
        (scoring.ScorerError("bad request", 400), 1, []), (scoring.IncompleteBatch("expected 2 scores, got 1"), 4, [0.5, 0.5, 0.5]),
    ],
)
def test_waits_between_attempts(error, calls, waits):
    seen, slept = [], []

    def failing(batch, payloads):
        seen.append(batch)
        raise error

    with pytest.raises(type(error)):
        scoring.with_retry(failing, sleep=slept.append)(0, [(1, "x")])
    assert len(seen) == calls and slept == waits


def test_leaked_reasoning_is_tried_again():
    answers = [[(1, 5, 'fits.}, {"ref": 2', "x")], [(1, 5, "fits", "x")]]
    assert scoring.with_retry(lambda b, p: answers.pop(0), sleep=lambda s: None)(0, [(1, "x")]) == [(1, 5, "fits", "x")]


def cycle(spark, tmp_path, **changes):
    tables = Tables(spark, f"file://{tmp_path}/tables")
    row = dict(id=1, is_paused=False, scoring_enabled=True, notify_score_threshold=50, max_notifications_per_day=5, scoring_spend_today=0.0, max_scoring_spend_usd_per_day=1.0, max_scoring_spend_usd_per_cycle=1.0)
    with tables.commit() as tx:
        tx.replace("settings", spark.createDataFrame([Row(**row)], SETTINGS.rsplit(", ", 1)[0]).withColumn("scoring_spend_reset_at", F.lit("2001-08-02").cast("timestamp")))
    sent = []

    def sender(text, keyboard):
        sent.append((text, json.loads(keyboard)))
        return str(len(sent))

    parts = dict(tables=tables, criteria=small_criteria, now=lambda: NOW, order=["id"], scorer=scoring.priced(scoring.rule_scorer, lambda n: n / 64), dearest=8 / 64, sender=sender, buckets=4)
    return Cycle(**(parts | changes)), sent


def test_cycles_of_a_stream(spark, tmp_path):
    c, sent = cycle(spark, tmp_path)
    run_on = lambda: start(spark.readStream.schema(LISTING).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), c, f"{tmp_path}/check").awaitTermination(240)
    # the second file repeats three URLs and a vacancy
    listings(spark, 10).coalesce(1).write.parquet(f"{tmp_path}/in")
    run_on()
    assert c.failures == [] and c.tables.read("listings").count() == 10 and sent == []  # notifying comes before scoring
    again = listings(spark, 4, 7).union(listings(spark, 1).withColumns({"id": F.lit(99).cast("long"), "url": F.lit("http://c.d/x")}))
    again.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run_on()
    assert c.failures == [] and c.tables.read("listings").count() == 12
    scored = {r.listing_id: r.match_status for r in c.tables.read("matches").collect()}
    assert set(scored) == set(range(11)) and sorted(scored.values()).count("notified") == 5
    assert len(sent) == 5 and all(k[0][0]["callback_data"].startswith("a:") for _, k in sent)
    assert {(r.status, r.channel) for r in c.tables.read("notification_log").collect()} == {("sent", "chat")}
    assert c.tables.read("settings").first().scoring_spend_today == 11 / 64  # the repeated vacancy is a duplicate
    run_on()  # nothing new: no cycle
    assert len(sent) == 5


def test_failed_steps_wait_for_the_next_cycle(spark, tmp_path):
    def broken(batch, payloads):
        raise RuntimeError("no answer")

    c, sent = cycle(spark, tmp_path, scorer=broken)
    c.run(listings(spark, 3), 0, "s")
    assert [(e, s) for e, s, _ in c.failures] == [(0, "score")] and c.tables.read("listings").count() == 3 and not c.tables.has("matches")
    assert [tuple(r)[:2] for r in failure_rows(spark, c).collect()] == [(0, "score")]
    c.scorer = scoring.priced(scoring.rule_scorer, lambda n: 0.0)
    c.run(listings(spark, 3), 0, "s")  # the same batch once more changes no listing
    assert c.tables.read("matches").count() == 3 and c.tables.manifest()["streams"] == {"s": 0}

    def down(text, keyboard):
        raise ConnectionError("down")

    c.sender = down
    c.notify()
    assert {r.error for r in c.tables.read("notification_log").collect()} == {"down"} and {r.match_status for r in c.tables.read("matches").collect()} == {"new"}


def test_paused_cycle_only_ingests(spark, tmp_path):
    c, sent = cycle(spark, tmp_path)
    with c.tables.commit() as tx:
        tx.replace("settings", c.tables.read("settings").withColumn("is_paused", F.lit(True)))
    c.run(listings(spark, 2), 0, "s")
    assert c.failures == [] and not c.tables.has("matches") and sent == []


def test_cycles_leave_nothing_behind(spark, tmp_path):
    """Neither stored tables nor manifests grow with the number of cycles."""
    import sievefold.operators.store as stores

    c, _ = cycle(spark, tmp_path)
    for epoch in range(2):
        before = set(stores._stored)
        c.run(listings(spark, 4, 4 * epoch), epoch, "s")
        assert set(stores._stored) == before and len(c.tables.numbers()) == 2
    assert c.failures == [] and c.tables.read("matches").count() == 8


def test_polled_cycle(spark, tmp_path):
    """From due sources to matches: one source fails, the other's listings go all the way."""
    spark.dataSource.register(BoardSource)
    c, _ = cycle(spark, tmp_path)
    jobs = [{"id": str(i), "redirect_url": f"https://x.example/{i}", "title": "Cyber Security Intern", "company": {"display_name": f"c{i}"}, "location": {"display_name": "Melbourne VIC 3000"}} for i in range(3)]
    for k in small_criteria().of("include"):
        (tmp_path / f"{k.term}-1.json").write_text(json.dumps({"results": jobs}))  # every term finds the same
    blank = "enabled boolean, poll_interval_minutes int, max_calls_per_day int, calls_today int, quota_reset_at timestamp, last_polled_at timestamp, last_success_at timestamp, last_error string, consecutive_failures int"
    rows = spark.createDataFrame([("a", True, 60, 50, 0), ("b", True, 60, 50, 0)], "name string, enabled boolean, poll_interval_minutes int, max_calls_per_day int, calls_today int")
    missing = [x.split() for x in blank.split(", ")][4:]
    with c.tables.commit() as tx:
        tx.replace("sources", rows.withColumns({n: F.lit("2001-08-01").cast("timestamp") if n == "quota_reset_at" else F.lit(0 if t == "int" else None).cast(t) for n, t in missing}))
    boards = {"a": polls.Board("board_a", {"transport": "sievefold.sources.board_source:from_files", "answers": str(tmp_path), "pause": "0"}), "b": polls.Board("board_a", {"transport": "no.such:thing"})}
    said = c.poll(boards, 0)
    assert said["a"] == "polled" and said["b"].startswith("failed") and c.failures == []
    assert sorted(r.url for r in c.tables.read("listings").collect()) == [f"https://x.example/{i}" for i in range(3)]
    best = max(small_criteria().of("include"), key=lambda k: k.weight).term
    assert {r.provider_matched_term for r in c.tables.read("listings").collect()} == {best}
    state = {r.name: r for r in c.tables.read("sources").collect()}
    assert (state["a"].consecutive_failures, state["b"].consecutive_failures) == (0, 1) and state["a"].calls_today > 0
    assert c.poll(boards, 1)["a"].startswith("not due") and c.tables.read("matches").count() == 3


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_keyboards(spark):
    words = lambda c: [[b["text"] for b in row] for row in json.loads(one(spark, c))]
    assert words(render.match_keyboard(F.lit("7"))) == [["✅ Applied", "⭐ Save", "🗑 Dismiss"]]
    assert words(render.keyboard_after(F.lit("saved"), F.lit("7"))) == [["✅ Applied", "🗑 Dismiss"]]
    assert one(spark, render.keyboard_after(F.lit("applied"), F.lit("7"))) is None


def test_decision_line(spark):
    settled = one(spark, render.with_decision(F.lit("card\nline"), F.lit("saved")))
    assert settled == "card\nline\n\n⭐ Saved for later"
    assert one(spark, render.with_decision(F.lit(settled), F.lit("dismissed"))) == "card\nline\n\n🗑 Dismissed"
    assert one(spark, render.with_decision(F.lit("card"), F.lit("eaten"))) is None


def test_filters_message(spark):
    weights = F.array(*(F.struct(F.lit(a).alias("axis"), F.lit(v).alias("value"), F.lit(w).alias("weight")) for a, v, w in (("commitment", "part_time", 1.3), ("work_mode", "hybrid", 1.0))))
    f = dict(name=F.lit("A & B"), center_label=F.lit("Here"), radius_km=F.lit(50), threshold=F.lit(70), include=F.array(F.lit("x"), F.lit("y")), exclude=F.array().cast("array<string>"), preferences=weights)
    lines = one(spark, render.filters_message(f)).split("\n")
    assert lines[:3] == ["<b>A &amp; B</b>", "50 km around Here", "Notify at fit ≥ 70"]
    assert lines[4:6] == ["<b>Include</b> (2)", "x, y"] and lines[7:9] == ["<b>Exclude</b> (0)", "  none"]
    assert lines[10:12] == ["<b>Preference weights</b>", "  commitment=part-time ×1.30"]
