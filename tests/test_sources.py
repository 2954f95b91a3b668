"""Boards as a data source, polls, and the state that polls add up to."""

import json
import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sievefold.criteria import small_criteria
from sievefold.operators.budget import record_poll
from sievefold.sources.board_source import BoardSource, BoardStreamReader, answers_of, calls_made
from sievefold.streaming import polls, source_state

FILES = "sievefold.sources.board_source:from_files"


def answer(n, start_at=0):
    return json.dumps({"results": [{"id": str(i), "redirect_url": f"https://x.example/{i}", "title": f"Cyber {i}"} for i in range(start_at, start_at + n)]})


def board(tmp_path, files, **more):
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    (tmp_path / "log").mkdir(exist_ok=True)
    return {"transport": FILES, "answers": str(tmp_path), "log": str(tmp_path / "log"), "pause": "0", **{k: str(v) for k, v in more.items()}}


def asked(tmp_path):
    return Counter(f.name.rsplit(".", 1)[0] for f in (tmp_path / "log").iterdir())


@pytest.fixture
def registered(spark):
    spark.dataSource.register(BoardSource)
    return spark


def test_batch_of_searches(registered, tmp_path):
    options = board(tmp_path, {"a-1.json": answer(50), "a-2.json": answer(3, 50), "b-1.json": answer(2, 100), "c-1.json": "<html>", "d-1.status": "429", "d-1.json": "slow down"}, terms=json.dumps(["a", "b", "c", "d", "e"]), pages=3, max_calls=11)
    calls = registered.read.format("board").options(**options).load()
    rows = sorted(map(tuple, calls.select("term", "page", "status", F.col("body").isNotNull(), "error").collect()))
    # of the 11 calls, e is allotted none and d two; b is short, c has another shape
    assert rows == [("a", 1, 200, True, None), ("a", 2, 200, True, None), ("b", 1, 200, True, None), ("c", 1, 200, False, None), ("c", 2, 200, True, None), ("d", 1, 429, False, None)]
    assert sum(asked(tmp_path).values()) == 6
    found = answers_of(calls, "board_a").collect()
    assert len(found) == 55 and Counter(r.provider_matched_term for r in found) == {"a": 53, "b": 2}
    told = calls_made(calls).first()
    assert (told.calls, told.limited, told.error) == (6, True, None)
    assert registered.read.format("board").options(**(options | {"max_calls": "0"})).load().count() == 0


def test_errors_are_rows(registered, tmp_path):
    options = board(tmp_path, {"a-1.status": "403", "a-1.json": "Just a moment", "b-1.json": answer(1)}, terms='["a", "b"]', max_calls=9)
    told = calls_made(registered.read.format("board").options(**options).load()).first()
    assert (told.calls, told.error) == (2, "403: bot challenge")
    options |= {"transport": "sievefold.sources.board_source:none"}
    with pytest.raises(Exception, match="none"):
        registered.read.format("board").options(**options).load().collect()


#: What the tests' clock shows, in a file: the reader lives in a process of its own.
CLOCK = "/tmp/sievefold-test-clock"


def clock():
    with open(CLOCK) as f:
        return float(f.read())


def set_clock(day, seconds=0):
    with open(CLOCK, "w") as f:
        f.write(str((datetime(2026, 1, day) - datetime(1970, 1, 1)).total_seconds() + seconds))


def test_stream_of_searches_over_restarts(registered, tmp_path):
    terms = [f"t{i}" for i in range(7)]
    options = board(tmp_path, {f"{t}-1.json": answer(2, 10 * i) for i, t in enumerate(terms)}, terms=json.dumps(terms), max_calls=5, per_batch=2, every=3600, clock="tests.test_sources:clock")
    seen = []

    def run():
        stream = registered.readStream.format("board").options(**options).load().writeStream
        sink = stream.foreachBatch(lambda batch, epoch: seen.append((epoch, sorted(r.term for r in batch.collect()))))
        sink.option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination(60)

    set_clock(1)
    for _ in range(5):  # every run is a new query over the old checkpoint
        run()
    assert [t for _, t in seen] == [["t0", "t1"], ["t2", "t3"], ["t4"]]  # five calls a day
    set_clock(2)
    run()
    assert [t for _, t in seen[3:]] == [["t5", "t6"]]  # the round goes on where it was
    assert asked(tmp_path) == {f"{t}-1": 1 for t in terms}
    for _ in range(3):  # an hour has passed since it began, and two of five calls are made
        run()
    assert [t for _, t in seen[4:]] == [["t0", "t1"], ["t2"]] and asked(tmp_path)["t0-1"] == 2


def test_a_failed_batch_is_asked_again_within_the_budget(registered, tmp_path):
    options = board(tmp_path, {f"{t}-1.json": answer(1) for t in "abc"}, terms='["a", "b", "c"]', max_calls=3, per_batch=2, every=3600)
    done = []

    def run(fail):
        def sink(batch, epoch):
            terms = sorted(r.term for r in batch.collect())
            if fail:
                raise RuntimeError("lost")
            done.append((epoch, terms))

        query = registered.readStream.format("board").options(**options).load().writeStream.foreachBatch(sink)
        query = query.option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        try:
            query.awaitTermination(60)
        except Exception:  # noqa: BLE001 - the sink's
            assert fail

    run(True)
    run(False)
    run(False)
    run(False)
    assert done == [(0, ["a", "b"]), (1, ["c"])]
    assert asked(tmp_path) == {"a-1": 2, "b-1": 2, "c-1": 1}


def test_offsets():
    r = BoardStreamReader({"terms": '["a", "b"]', "pages": "2", "max_calls": "9", "per_batch": "3", "every": "10"})
    now = [1000.0]
    r.clock = lambda: now[0]
    first = r.latestOffset()
    parts = r.partitions(r.initialOffset(), first)
    assert (first["asked"], [(p.position, p.first, p.last) for p in parts]) == (3, [(0, 1, 2), (1, 1, 1)])
    second = r.latestOffset()
    assert [(p.position, p.first, p.last) for p in r.partitions(first, second)] == [(1, 2, 2)] and second["calls"] == 4
    assert r.latestOffset() == second and r.partitions(second, second) == []  # the round is over
    now[0] += 10
    third = r.latestOffset()
    assert (third["round"], third["asked"], third["calls"]) == (2, 3, 7) and len(r.partitions(second, third)) == 2
    fourth = BoardStreamReader({"terms": "[]", "max_calls": "9"})
    assert fourth.latestOffset() == fourth.initialOffset()


SOURCE = "name string, enabled boolean, poll_interval_minutes int, max_calls_per_day int, calls_today int, quota_reset_at timestamp, last_polled_at timestamp, last_success_at timestamp, last_error string, consecutive_failures int"


def source_rows(spark, *rows):
    at = lambda d, h=0: datetime(2026, 1, d, h)
    base = dict(enabled=True, poll_interval_minutes=60, max_calls_per_day=9, calls_today=8, quota_reset_at=at(3), last_polled_at=None, last_success_at=at(1), last_error="old", consecutive_failures=2)
    return spark.createDataFrame([tuple((base | r)[c.split()[0]] for c in SOURCE.split(", ")) for r in rows], SOURCE)


def test_poll_isolates_a_failing_source(registered, tmp_path):
    spark, criteria = registered, small_criteria()
    (good, bad) = (tmp_path / "good", tmp_path / "bad")
    good.mkdir(), bad.mkdir()
    terms = [k.term for k in sorted(criteria.of("include"), key=lambda k: -k.weight)]
    rows = source_rows(spark, dict(name="bad"), dict(name="good", quota_reset_at=datetime(2026, 1, 1)), dict(name="late", last_polled_at=datetime(2026, 1, 2, 11, 30)), dict(name="off", enabled=False), dict(name="other"), dict(name="spent", calls_today=9), dict(name="keyless"))
    boards = {n: polls.Board("board_a", board(good, {f"{terms[0]}-1.json": answer(2)})) for n in ("good", "late", "off", "spent")}
    boards |= {"bad": polls.Board("board_a", board(bad, {f"{t}-1.status": "500" for t in terms})), "keyless": polls.Board("board_a", {}, configured=False)}
    got = polls.poll(spark, rows, boards, criteria, "2026-01-02 12:00:00")
    assert got.said == {"bad": "failed: 500: {}", "good": "polled", "late": "not due for 30m", "off": "disabled", "other": "no adapter", "spent": "daily quota spent (9/9), resets 2026-01-03T00:00:00.000Z", "keyless": "credentials missing"}
    assert sorted(r.url for r in got.listings.collect()) == ["https://x.example/0", "https://x.example/1"]
    state = {r.name: r for r in got.sources.collect()}
    n = min(9, len(terms))  # the new day's whole quota
    assert (state["good"].calls_today, state["good"].consecutive_failures, state["good"].last_error, state["good"].quota_reset_at) == (n, 0, None, datetime(2026, 1, 3))
    assert (state["bad"].calls_today, state["bad"].consecutive_failures, state["bad"].last_error, state["bad"].last_success_at) == (9, 3, "500: {}", datetime(2026, 1, 1))
    assert state["bad"].last_polled_at == datetime(2026, 1, 2, 12) and state["other"].calls_today == 8
    # soon afterwards nobody has both quota and patience
    again = polls.poll(spark, got.sources, boards, criteria, "2026-01-02 12:15:00")
    assert again.listings is None and again.said["late"] == "not due for 15m" and again.said["good"][:7] in ("not due", "daily q")
    assert polls.poll(spark, rows, boards, criteria, "2026-01-02 12:00:00", stopped=lambda: True).said == {}


def poll_log(n=160, seed=2):
    r, at, rows = random.Random(seed), datetime(2026, 1, 1, 20), []
    for _ in range(n):
        at += timedelta(minutes=r.choice([1, 30, 200, 700]))
        ok = r.random() < 0.6
        rows.append((r.choice("abc"), at, r.randrange(9), ok, None if ok else r.choice(["x", "y"])))
    return rows


def plain_fold(rows):
    states = {}
    for name, at, calls, ok, error in rows:
        states[name] = source_state.fold(states.get(name), at, calls, ok, error)
    return states


def test_record_poll_is_the_same_fold(spark):
    rows, table = poll_log(12), source_rows(spark, *(dict(name=n, calls_today=0, quota_reset_at=datetime(2026, 1, 1), last_success_at=None, last_error=None, consecutive_failures=0) for n in "abc"))
    for name, at, calls, ok, error in rows:
        table = record_poll(table, spark.createDataFrame([(name, calls, ok, error)], polls.OUTCOME), F.lit(str(at)).cast("timestamp"))
    got = {r.name: (r.last_polled_at, r.calls_today, r.quota_reset_at, r.last_success_at, r.last_error, r.consecutive_failures) for r in table.collect()}
    assert {n: got[n] for n in plain_fold(rows)} == plain_fold(rows)


def test_folded_and_histories(spark):
    rows = poll_log()
    log = spark.createDataFrame(rows, source_state.POLL).repartition(3)
    assert {r.name: tuple(r)[1:] for r in source_state.folded(log).collect()} == plain_fold(rows)
    got = {(r.name, r.at): tuple(r)[1:] for r in source_state.histories(log).collect()}
    assert got == {(row[0], row[1]): plain_fold(rows[: i + 1])[row[0]] for i, row in enumerate(rows)}
    assert source_state.folded(log.where("false")).collect() == []


def test_states_of_a_stream(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows, got = poll_log(40), {}

    def run():
        stream = spark.readStream.schema(source_state.POLL).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        sink = source_state.states(stream).writeStream.outputMode("update").foreachBatch(lambda b, _: [got.__setitem__(r.name, tuple(r)[1:]) for r in b.collect()])
        sink.option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination(120)

    for part in (rows[:25], rows[25:]):  # the second after a restart
        spark.createDataFrame(part, source_state.POLL).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run()
    want = plain_fold(rows)
    end = max(r[1] for r in rows) - timedelta(minutes=10)
    for name, state in want.items():
        at, calls, reset, *rest = state
        if reset <= end:  # the timer has ended the source's day, once for every midnight
            calls = 0
        assert got[name][1] == calls and got[name][3:] == tuple(rest) and got[name][0] == at
        assert got[name][2] >= reset
