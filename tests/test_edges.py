"""Null keys, null buckets, unknown values, replays, and scoring against brute force."""

from pyspark.sql import Row
from pyspark.sql import functions as F

from sievefold.criteria import seed_criteria
from sievefold.operators import budget, dedupe, merge, prefilter
from sievefold.plans import scoring
from sievefold.streaming import ingest

LISTING = "id long, source string, source_id string, url string, title string, company string, description string, location_raw string, latitude double, longitude double, salary_min double, salary_max double, salary_is_predicted boolean, posted_date timestamp, provider_matched_term string, hint_commitment string, hint_work_mode string, hint_role_type string"


def listing(spark, *rows):
    return spark.createDataFrame([Row(**({n.split()[0]: None for n in LISTING.split(", ")} | r)) for r in rows], LISTING)


def test_running_total_keeps_null_buckets(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "a", 7), (3, "b", 11)], "id int, b string, v int")
    got = {x.id: x.t for x in budget.running_total(df, F.col("v"), [F.col("b")], [F.col("id")], "t").collect()}
    assert got == {1: 5, 2: 12, 3: 23}


def test_unknown_axis_value_weighs_one(spark):
    rows = [dict(id=i, title="Cyber Security Intern", company="c", url="http://a.b/1", hint_work_mode=mode) for i, mode in enumerate(["remote", "on the moon", None])]
    got = {x.id: x for x in prefilter.prefilter(listing(spark, *rows), seed_criteria(), "2001-08-01 00:00:00").collect()}
    assert all(x.preference_multiplier is not None for x in got.values())
    assert got[1].work_mode == "on the moon" and got[1].preference_multiplier == got[2].preference_multiplier


def test_upsert_keeps_rows_with_null_keys(spark):
    old = spark.createDataFrame([(1, "a"), (None, "b")], "k int, v string")
    new = spark.createDataFrame([(1, "c"), (None, "d")], "k int, v string")
    assert sorted((x.k or 0, x.v) for x in merge.upsert(old, new, "k").collect()) == [(0, "b"), (0, "d"), (1, "c")]


def test_insert_absent_takes_the_smallest(spark):
    old, new = (spark.createDataFrame(r, "k int, v string") for r in ([(1, "a")], [(1, "z"), (2, "y"), (2, "x")]))
    assert sorted(tuple(x) for x in merge.insert_absent(old, new, ["k"]).collect()) == [(1, "a"), (2, "x")]


def test_null_fingerprints_have_no_duplicates(spark):
    df = spark.createDataFrame([(i, None if i < 3 else "f", None, None, "Here", "2001-01-01") for i in range(5)], "id long, content_fingerprint string, latitude double, longitude double, location_suburb string, first_seen_at string")
    assert {x.id: x.duplicate_of for x in dedupe.near_duplicates(df).collect()} == {0: None, 1: None, 2: None, 3: None, 4: 3}


def test_replayed_batch_changes_nothing(spark, tmp_path):
    t = merge.Snapshots(spark, str(tmp_path / "t"))
    assert t.current() is None
    for batch, n in (("q-0", 1), ("q-1", 2), ("q-0", 1), ("r-0", 3)):
        t.write(spark.range(n), batch=batch)
    assert t.read().count() == 3 and t.current() == "snapshot-r-0"
    t.write(spark.range(9), batch="q-1")
    assert t.read().count() == 3


def test_fresh_checkpoint_keeps_all_rows(spark, tmp_path):
    table, source = merge.Snapshots(spark, str(tmp_path / "t")), str(tmp_path / "in")
    for i in (1, 2):
        listing(spark, dict(id=i, title=f"Cyber {i}", company="c", url=f"http://a.b/{i}", source="s", source_id=str(i))).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(LISTING).parquet(source)
        ingest.start(stream, table, seed_criteria, lambda: "2001-08-01 00:00:00", ["id"], str(tmp_path / f"check{i}")).awaitTermination()
        assert table.read().count() == i


def test_scores_are_the_scorers(spark):
    words = {"cyber": 30, "security": 20, "intern": 15, "support": 10, "data entry": 5}
    titles = ["Cyber intern", "Data entry", "Nothing", "IT support and security"]
    rows = [dict(id=i, title=titles[i % 4], company="c", url="http://a.b/1", description=f"d{i}") for i in range(19)]
    x = prefilter.prefilter(listing(spark, *rows), seed_criteria(), "2001-08-01 00:00:00")
    batched = budget.in_batches(x, [F.floor(F.col("id") / 8)], [F.col("id")]).withColumn("base_score", F.lit(0))
    got = {r.id: r for r in scoring.score(batched, scoring.rule_scorer).collect()}
    assert len(got) == 19
    for i, r in got.items():
        # signals are part of what a scorer sees
        text = " ".join(map(str, (r.title, r.company, r.description, r.compensation, r.work_mode, r.commitment, r.role_type))).lower()
        want = min(100, 20 + sum(p for w, p in words.items() if w in text))
        assert (r.batch, r.ref, r.base_score) == (i // 8, i % 8 + 1, want)
        assert r.fit_score == min(100, int(want * float(r.preference_multiplier) + 0.5))


def test_retry_ends_at_account_errors():
    calls = []

    def failing(message):
        def call(batch, payloads):
            calls.append(message)
            raise RuntimeError(message)

        return call

    for message, n in (("credit balance is too low", 1), ("timeout", 4)):
        calls.clear()
        try:
            scoring.with_retry(failing(message), sleep=lambda s: None)(0, [(1, "x")])
        except RuntimeError as e:
            assert str(e) == message
        assert len(calls) == n


def test_hot_fingerprint_is_spread_over_tasks(spark):
    """A third of all rows have one fingerprint and place; a task of the fold gets steps only."""
    n, seen = 30_000, spark.sparkContext.accumulator(0)
    i = F.col("id")
    df = spark.range(n).select(
        "id", F.when(i % 3 == 0, "hot").otherwise(F.concat(F.lit("f"), i % 500)).alias("content_fingerprint"), F.when(i % 2 == 0, (i % 7) * 0.02).alias("latitude"), F.when(i % 2 == 0, F.lit(0.0)).alias("longitude"),
        F.concat(F.lit("P"), i % 5).alias("location_suburb"), F.timestamp_seconds(1_000_000 - i % 1000).alias("first_seen_at"),
    )
    fold = dedupe.fold_steps

    def counted(ids, places, radius_km):
        seen.add(len(ids))
        return fold(ids, places, radius_km)

    dedupe.fold_steps = counted
    try:
        got = {r.id: r.duplicate_of for r in dedupe.near_duplicates(df).collect()}
    finally:
        dedupe.fold_steps = fold
    want, clusters = {}, {}
    for r in sorted(df.collect(), key=lambda r: (r.first_seen_at, r.id)):
        own, place = clusters.setdefault(r.content_fingerprint, []), (r.latitude, r.longitude, r.location_suburb.lower())
        hit = next((c for c in own if any(dedupe.same_vacancy(p, place, 5.0) for p in c[1])), None)
        if hit is None:
            own.append((r.id, {place: None}))
        else:
            hit[1][place] = None
        want[r.id] = hit[0] if hit else None
    assert got == want
    assert seen.value < n / 2  # steps of all rounds; most fingerprints have few rows


def test_fold_finds_later_steps(spark):
    """B founds a cluster; C is near both and joins A's, so the next B joins A's as well, and
    brings D with it, which was near no row of A's cluster."""
    km = 1 / 111.195
    at = {"A": 0.0, "C": 4 * km, "B": 8 * km, "D": 12 * km}
    rows = [(k, "f", at[p], 0.0, None, f"2026-01-{k:02}") for k, p in enumerate("ABCBDD", 1)]
    df = spark.createDataFrame(rows, "id long, content_fingerprint string, latitude double, longitude double, location_suburb string, first_seen_at string")
    assert {r.id: r.duplicate_of for r in dedupe.near_duplicates(df).collect()} == {1: None, 2: None, 3: 1, 4: 1, 5: 1, 6: 1}
