"""Searches within a call budget, robots files by origin, write-backs, and loading of criteria."""

import json

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from sievefold.criteria import keyword_rows, load_criteria, multiplier_of, preference_rows, seed_criteria, small_criteria
from sievefold.operators import careers, dedupe, settings
from sievefold.plans import ingest, matches, report, scoring
from sievefold.sources import boards, search
from sievefold.sources.listing_view import NOW


def page(n, rows="results"):
    return 200, json.dumps({rows: [{"id": str(i), "redirect_url": f"https://x.example/{i}", "title": "t"} for i in range(n)]})


def test_search_reads_on_while_pages_are_full():
    asked, waits = [], []

    def board(term, at):
        asked.append((term, at))
        return page(50 if at == 1 and term == "a" else 3)

    got = search.gather(board, ["a", "b"], "results", 10, pages=3, sleep=waits.append)
    assert asked == [("a", 1), ("a", 2), ("b", 1)] and (got.calls, got.ended, len(waits)) == (3, "done", 1)


def test_search_ends_at_budget_and_rate_limit():
    got = search.gather(lambda term, at: page(1), ["a", "b", "c"], "results", 2)
    assert (got.calls, got.ended, got.unasked) == (2, "budget", 1)
    got = search.gather(lambda term, at: page(1) if term == "a" else (429, "slow down"), ["a", "b", "c"], "results", 9)
    assert (got.calls, got.ended, len(got.payloads)) == (2, "limited", 1)
    assert search.gather(lambda term, at: page(1), ["a"], "results", 0).calls == 0


@pytest.mark.parametrize("body, says", [("<title>Just a moment...</title>", "bot challenge"), ("bad key", "bad key")])
def test_search_errors(body, says):
    with pytest.raises(RuntimeError, match=says):
        search.gather(lambda term, at: (403, body), ["a"], "jobs", 3)


def test_search_passes_over_other_shapes():
    bodies = iter(["<html>", "[1]", '{"results": 3}'])
    got = search.gather(lambda term, at: (200, next(bodies)), ["a", "b", "c"], "results", 9)
    assert (got.calls, got.payloads) == (3, [])


def test_search_source_names_its_terms(spark):
    criteria = small_criteria()
    source = search.SearchSource("board_a", lambda term, at: page(2) if term != "IT" else page(0))
    got = source.fetch(spark, criteria, 4).collect()
    plan = [r.term for r in boards.keyword_plan(keyword_rows(spark, criteria)).collect()]
    assert {r.provider_matched_term for r in got} == {t for t in plan[:4] if t != "IT"} and source.last.ended == "budget"


def test_payloads_with_holes(spark):
    bodies = [None, "", "[", "{}", '{"results": null}', '{"results": [null]}', '{"results": [{"title": "no url"}]}', '{"results": [{"title": "a &amp;lt; b", "redirect_url": "u", "extra": 1}]}']
    df = spark.createDataFrame([(b,) for b in bodies], "body string")
    got = boards.board_a(boards.parse_payload(df, "body", boards.BOARD_A)).collect()
    assert [(r.url, r.title, r.salary_is_predicted) for r in got] == [("u", "a &lt; b", False)]
    jobs = '{"jobs": [{"title": "<b>x</b> <> y", "link": "u", "salary": "$1,234.5", "company": "  ", "type": "Contract, full", "updated": "nope"}]}'
    got = boards.board_b(boards.parse_payload(spark.createDataFrame([(jobs,)], "body string"), "body", boards.BOARD_B)).collect()
    assert [(r.title, r.salary_min, r.company, r.hint_commitment, r.posted_date) for r in got] == [("x <> y", 1234.5, None, "contract", None)]


def test_robots_by_origin(spark):
    text = "User-agent: *\nDisallow: /private\nAllow: /private/open\n"
    files = [("https://a.example", 200, text), ("https://b.example", 404, "Not found"), ("https://c.example", 503, text), ("https://d.example", None, None), ("https://e.example", 200, "")]
    robots = careers.robots_by_origin(spark.createDataFrame(files, "origin string, status int, body string"), "sievefold")
    urls = ["https://A.example/private/x", "https://a.example/private/open", "https://a.example", "https://b.example/private", "https://c.example/", "https://d.example/", "https://e.example/private", "https://f.example/", "http://localhost/", None]
    got = {r.url: r.refusal for r in careers.read_verdict(spark.createDataFrame([(u,) for u in urls], "url string"), robots).collect()}
    unread = "robots.txt could not be read, so fetching is not permitted"
    assert [got[u] for u in urls[:8]] == ["robots.txt disallows /private/x", None, None, None, unread, unread, None, unread]
    assert got["http://localhost/"] == "private or loopback address" and got[None] == "not a valid absolute URL"


def test_marks_are_written_back(spark):
    stored = spark.createDataFrame([(1, "a", None), (2, "b", 1), (3, "c", 1), (4, "d", None), (5, "e", 2)], "id int, t string, duplicate_of int")
    new = spark.createDataFrame([(1, None), (2, 1), (3, None), (4, 1)], "id int, duplicate_of int")
    out = dedupe.apply_marks(stored, new)
    assert {r.id: (r.t, r.duplicate_of, r.changed) for r in out.collect()} == {1: ("a", None, False), 2: ("b", 1, False), 3: ("c", None, True), 4: ("d", 1, True), 5: ("e", 2, False)}
    assert tuple(dedupe.dedupe_summary(out).first()) == (5, 3, 2)
    again = dedupe.apply_marks(out.drop("changed"), new)
    assert again.where("changed").isEmpty() and dedupe.dedupe_summary(out.limit(0)).first().examined == 0


def test_rescoring_keeps_the_decision(spark):
    kind = "match_id int, listing_id int, base_score int, fit_score int, match_status string"
    old = spark.createDataFrame([(10, 1, 50, 55, "saved"), (11, 2, 60, 66, "new")], kind)
    new = spark.createDataFrame([(90, 1, 70, 77, "x"), (91, 3, 20, 22, "x")], kind).drop("match_status")
    assert sorted(map(tuple, scoring.upsert_matches(old, new).collect())) == [(10, 1, 70, 77, "saved"), (11, 2, 60, 66, "new"), (91, 3, 20, 22, "new")]
    costs = scoring.run_costs(spark.createDataFrame([(0, 5), (0, 7), (1, 2)], "batch int, c int"), F.col("c"))
    assert sorted(map(tuple, costs.collect())) == [(0, 2, 12), (1, 1, 2)]


def test_criteria_from_tables(spark):
    want = seed_criteria()
    fields = {k: v for k, v in vars(want.filter).items()}
    filters = spark.createDataFrame([Row(id="f", is_active=True, **fields), Row(id="g", is_active=False, **fields)], _ddl(fields))
    words = keyword_rows(spark, want).withColumn("filter_id", F.lit("f"))
    other = words.withColumn("filter_id", F.lit("g")).withColumn("term", F.lit("never"))
    prefs = preference_rows(spark, want).withColumn("filter_id", F.lit("f"))
    got = load_criteria(filters, words.unionByName(other), prefs)
    assert got.keywords == want.keywords and vars(got.filter) == fields and sorted(got.preferences) == sorted(want.preferences)
    with pytest.raises(ValueError):
        load_criteria(filters.where("NOT is_active"), words, prefs)


def _ddl(fields):
    kinds = {bool: "boolean", int: "int", float: "double", str: "string", type(None): "int"}
    return "id string, is_active boolean, " + ", ".join(f"{k} {kinds[type(v)]}" for k, v in fields.items())


def test_settings_and_sources(spark):
    kind = "id int, is_paused boolean, notify_score_threshold int, max_notifications_per_day int, max_scoring_spend_usd_per_day double, scoring_spend_today double, scoring_spend_reset_at string"
    row = lambda reset: spark.createDataFrame([(1, True, 60, 9, 2.0, 1.5, reset)], kind).withColumn("scoring_spend_reset_at", F.col("scoring_spend_reset_at").cast("timestamp"))
    listings = spark.createDataFrame([(1, "passed", None), (2, "passed", 1), (3, "rejected", None)], "id int, status string, duplicate_of int")
    found = spark.createDataFrame([(1, 65, "new")], "listing_id int, fit_score int, match_status string")
    log = spark.createDataFrame([("sent", "2001-08-01 00:00:00"), ("failed", "2001-08-01 01:00:00"), ("sent", "2001-07-31 23:59:59")], "status string, sent_at string").withColumn("sent_at", F.col("sent_at").cast("timestamp"))
    s = matches.full_stats(listings, found, row("2001-08-02"), log, NOW).first()
    assert (s.threshold, s.above_threshold, s.spent_today, s.notified_today, s.notify_cap_per_day, s.paused, s.awaiting_score) == (60, 1, 1.5, 1, 9, True, 0)
    assert matches.full_stats(listings, found, row("2001-08-01"), log, NOW).first().spent_today == 0
    none = matches.full_stats(listings, found, row("2001-08-02").limit(0), log, NOW).first()
    assert (none.threshold, none.above_threshold, none.spent_today, none.spend_cap_per_day, none.paused) == (70, 0, 0, 0, False)
    names = settings.load_sources(spark.createDataFrame([("b",), ("a",)], "name string"))
    assert [r.name for r in names] == ["a", "b"]


def test_seeding_twice_changes_nothing(spark):
    filters = spark.createDataFrame([("f", True), ("g", False), ("h", True)], "id string, is_active boolean")
    have = spark.createDataFrame([("f", "x", "include", 2.0)], "filter_id string, term string, kind string, weight double")
    terms = spark.createDataFrame([("x", "include", 1.0), ("x", "exclude", 1.0)], "term string, kind string, weight double")
    once = settings.seed_keywords(have, filters, terms)
    assert sorted(map(tuple, once.collect())) == [("f", "x", "exclude", 1.0), ("f", "x", "include", 2.0), ("h", "x", "exclude", 1.0), ("h", "x", "include", 1.0)]
    assert settings.seed_keywords(once, filters, terms).count() == 4


def test_order_of_a_dry_run(spark):
    rows = [(1, "rejected", 1.4), (2, "passed", 1.0), (3, "passed", 1.2), (4, "passed", 1.2), (5, "rejected", None)]
    df = spark.createDataFrame(rows, "id int, status string, preference_multiplier double")
    assert [r.id for r in ingest.dry_run(df).orderBy("position").collect()] == [3, 4, 2, 1, 5]
    assert [r.id for r in report.top_by_multiplier(df, 2).collect()] == [3, 4]


def test_newest_without_date_last(spark):
    df = spark.createDataFrame([(1, None), (2, "2001-01-01"), (3, "2001-01-02")], "id int, posted_date string")
    assert [r.id for r in report.newest(df, 3).collect()] == [3, 2, 1]


def test_reevaluation_keeps_a_sniffed_commitment(spark):
    from test_edges import listing

    from sievefold.operators.prefilter import prefilter

    row = dict(id=1, title="Cyber Security Intern", company="c", description="Part-time role.", location_raw="Werribee VIC 3030", latitude=-37.9, longitude=144.6, posted_date=None)
    stored = prefilter(listing(spark, row), small_criteria(), NOW)
    same = ingest.reevaluate(stored, small_criteria(), NOW).first()
    assert not same.changed and same.commitment == "part_time"
    edited = ingest.reevaluate(stored.withColumn("description", F.lit("A role.")), small_criteria().with_filter(radius_km=1), NOW).first()
    assert edited.changed and edited.status == "rejected" and edited.commitment == "part_time"


def test_loose_acronyms(spark):
    df = spark.createDataFrame([("IT", False, True), ("IT", True, True), ("Cyber", False, True), ("SOC", False, False)], "term string, case_sensitive boolean, is_active boolean")
    assert [r.term for r in report.loose_acronyms(df).collect()] == ["IT"] and report.loose_acronyms(keyword_rows(spark, seed_criteria())).isEmpty()


@pytest.mark.parametrize("minutes, says", [(0, "just now"), (59, "59m ago"), (60, "1h ago"), (1439, "23h ago"), (1440, "1d ago"), (None, "never")])
def test_ago(spark, minutes, says):
    now = F.lit(NOW).cast("timestamp")
    then = F.lit(None).cast("timestamp") if minutes is None else now - F.make_interval(mins=F.lit(minutes))
    assert spark.range(1).select(report.ago(then, now)).first()[0] == says


def test_bars(spark):
    got = spark.createDataFrame([(0, 0), (1, 2), (2, 2)], "n int, t int").select(report.bar(F.col("n"), F.col("t"), 4)).collect()
    assert [r[0] for r in got] == ["░░░░", "██░░", "████"]


def test_unknown_preference_weighs_one():
    assert multiplier_of(("x", "x", "x", "x"), ())[0] == 1
