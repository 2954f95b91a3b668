"""Decisions told twice and out of order, late events, lengths in UTF-16 units, costs of retries."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sievefold.functions import render
from sievefold.operators.budget import TRANSITIONS
from sievefold.plans import matches, scoring
from sievefold.streaming import decisions

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def plain_history(updates):
    """By TRANSITIONS, one update after the other, in the order of their numbers."""
    out = {}
    for match in {m for _, m, _ in updates}:
        status, accepted, by = "new", [], None
        for u, s in sorted({(u, s) for u, m, s in updates if m == match}):
            if s in TRANSITIONS[status]:
                status, by = s, u
                accepted.append(s)
        if accepted:
            out[match] = (status, by, accepted)
    return out


def random_updates(n, seed):
    r = random.Random(seed)
    return [(u, f"m{r.randrange(12)}", r.choice(["notified", "saved", "applied", "dismissed"])) for u in range(n)]


def test_histories(spark):
    updates = random_updates(80, 1)
    told = updates + updates[:20]
    random.Random(2).shuffle(told)
    got = {r.match_id: (r.match_status, r.decided_by, r.accepted) for r in decisions.histories(spark.createDataFrame(told, "update_id long, match_id string, status string")).collect()}
    assert got == plain_history(updates)
    for match, (status, by, accepted) in got.items():
        first = {s: min((u for u, m, x in updates if m == match and x == s), default=None) for s in decisions.DECIDED}
        assert decisions.accepted_from(first) == sorted((first[s], s) for s in accepted) and (by, status) == decisions.accepted_from(first)[-1]


def test_stream_of_decisions_in_any_order(spark, tmp_path):
    """Three streams over the same updates, repeated and shuffled in their own ways."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    updates = random_updates(40, 3)
    ids = {f"m{k}": f"{k:08d}-0000-0000-0000-000000000000" for k in range(12)}
    code = {"saved": "s", "applied": "a", "dismissed": "d"}
    updates = [(u, m, s) for u, m, s in updates if s in code]
    want = {ids[m]: v for m, v in plain_history(updates).items()}
    for way in range(2):
        told = updates + updates[::3]
        random.Random(way).shuffle(told)
        rows = [(u, datetime(2026, 1, 1), f"{code[s]}:{ids[m]}") for u, m, s in told] + [(999, datetime(2026, 1, 1), "x:unknown"), (998, datetime(2026, 1, 1), None)]
        got = {}

        def run():
            stream = decisions.decoded(spark.readStream.schema(decisions.UPDATE).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in{way}"))
            sink = decisions.history_stream(stream).writeStream.outputMode("update").foreachBatch(lambda b, _: [got.__setitem__(r.match_id, (r.match_status, r.decided_by, r.accepted)) for r in b.collect()])  # noqa: B023
            sink.option("checkpointLocation", f"{tmp_path}/check{way}").trigger(availableNow=True).start().awaitTermination(120)

        for part in (rows[:20], rows[20:]):
            spark.createDataFrame(part, decisions.UPDATE).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in{way}")
            run()
        assert got == want


def test_decisions_move_matches(spark):
    found = spark.createDataFrame([(1, 10, "new"), (2, 20, "saved"), (3, 30, "applied"), (4, 40, "new")], "match_id long, listing_id long, match_status string")
    changed = spark.createDataFrame([("1", "saved", 5, ["saved"]), ("2", "applied", 6, ["applied"]), ("3", "saved", 7, ["saved"]), ("9", "saved", 8, ["saved"])], decisions.HISTORY)
    assert sorted(map(tuple, decisions.decide(found, changed).collect())) == [(10, "saved"), (20, "applied")]
    told = decisions.decoded(spark.createDataFrame([(1, None, "a:7"), (2, None, "a:"), (3, None, "z:7")], "update_id long, at timestamp, callback string"))
    assert [(r.update_id, r.match_id, r.status) for r in told.collect()] == [(1, "7", "applied")]


def test_late_and_repeated_events(spark, tmp_path):
    at = lambda minutes: datetime(2026, 1, 1) + timedelta(minutes=minutes)
    parts = [
        [("a", at(0), 1), ("b", at(1), 2), ("a", at(2), 3)],  # a is repeated in a batch
        [("a", at(5), 4), ("c", at(30), 5)],  # and in another
        [("d", at(200), 6)],  # moves the watermark to 140 minutes
        [("e", at(100), 7), ("f", at(150), 8), ("a", at(201), 9)],  # e is too late; a is forgotten and counts again
    ]
    seen, state = [], []
    for part in parts:
        spark.createDataFrame(part, "k string, at timestamp, n int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = decisions.told_once(spark.readStream.schema("k string, at timestamp, n int").parquet(f"{tmp_path}/in"), ["k"], "at")
        query = stream.writeStream.foreachBatch(lambda b, _: seen.extend(r.n for r in b.collect())).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        query.awaitTermination(60)
        state.append(query.lastProgress.stateOperators[0].numRowsTotal)
    assert sorted(seen) == [1, 2, 5, 6, 8, 9] or sorted(seen) == [2, 3, 5, 6, 8, 9]  # of one batch's repetitions any one stays
    assert state[-1] <= 3  # d, f and a: what lies within an hour of the newest


def test_lengths_are_utf16_units(spark):
    js = lambda t: len(t.encode("utf-16-le")) // 2
    for t in ("", "abc", "a😀b", "😀" * 5, "é"):
        assert one(spark, render.units(F.lit(t))) == js(t)
        for n in range(1, 8):
            got = one(spark, render.take_units(F.lit(t), F.lit(n)))
            assert t.startswith(got) and js(got) <= n and (got == t or js(got + t[len(got)]) > n)


@pytest.mark.parametrize(
    ("text", "limit", "want"),
    [("hello wide world", 10, "hello wide…"), ("hello you world", 12, "hello you…"), ("  ab  ", 3, "ab"), ("abcdefgh", 4, "abcd…"), ("a bcdefgh", 5, "a bcd…"), ("😀😀😀😀", 5, "😀😀…"), ("😀😀😀 b😀", 9, "😀😀😀…"), ("ab cd", 5, "ab cd")],
)
def test_truncate(spark, text, limit, want):
    assert one(spark, render.truncate(F.lit(text), limit)) == want


def test_a_card_full_of_pictures_fits(spark):
    long = {"title": "😀" * 900, "company": "🏢" * 700, "reasoning": "🎉 " * 3000, "suburb": "🏙" * 50, "category": "🔐", "compensation": "paid", "work_mode": "remote", "commitment": "part_time", "url": "https://x.example/" + "a" * 300, "posted": "2026-08-19T13:26:32+00:00"}
    numbers = {"fit_score": F.lit(99), "base_score": F.lit(90), "multiplier": F.lit(1.3).cast("decimal(4,2)"), "distance_km": F.lit(3.2), "duration_weeks": F.lit(12)}
    card = one(spark, render.match_card({k: F.lit(v) for k, v in long.items()} | numbers))
    n = len(card.encode("utf-16-le")) // 2
    assert n <= 4096 and card.endswith("→</a>") and "🎉" in card
    short = one(spark, render.match_card({k: F.lit(v) for k, v in (long | {"title": "😀" * 2100}).items()} | numbers))
    assert "🎉" not in short  # no room is left for the reasoning


def test_failed_attempts_cost(spark):
    def flaky(fail, usd=0.5):
        calls = []

        def call(batch, payloads):
            calls.append(batch)
            if len(calls) <= fail:
                raise scoring.ScorerError("slow down", 429, usd=0.25)
            return ([(1, 50, "fits", "x")] if len(calls) > fail + 1 else []), usd

        return call

    # two failures at a quarter, one incomplete answer and a whole one at a half
    got, usd = scoring.with_priced_retry(flaky(2), sleep=lambda s: None)(0, [(1, "x")])
    assert (len(got), usd) == (1, 1.5)
    with pytest.raises(scoring.ScorerError) as e:
        scoring.with_priced_retry(flaky(9), sleep=lambda s: None)(0, [(1, "x")])
    assert e.value.usd == 1.0


def test_stats_in_one_aggregate(spark):
    listings = spark.createDataFrame([(1, "passed", None), (2, "passed", 1), (3, "rejected", None), (4, "passed", None)], "id long, status string, duplicate_of long")
    found = spark.createDataFrame([(1, "new", 90), (2, "saved", 95), (3, "new", 99), (9, "new", 99)], "listing_id long, match_status string, fit_score int")
    r = matches.pipeline_stats(listings, found, 70).first()
    assert (r.listings_total, r.listings_passed, r.duplicates, r.scored, r.above_threshold, r.awaiting_score, r.n_new, r.n_saved) == (4, 3, 1, 4, 2, 1, 3, 1)
    empty = matches.pipeline_stats(listings.where("false"), found.where("false"), 70).first()
    assert tuple(empty) == (0,) * 11
