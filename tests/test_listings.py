"""Literal vectors and properties of the listing engine."""

import json
import random
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from sievefold.criteria import Criteria, multiplier_of, seed_criteria, small_criteria
from sievefold.functions import geo, render, signals
from sievefold.functions import text as T
from sievefold.functions.urls import canonical_url, dedupe_hash, link_host
from sievefold.operators import budget, careers
from sievefold.operators.dedupe import near_duplicates, same_vacancy
from sievefold.operators.merge import Snapshots, compare_and_set, delete_where, insert_absent, update_where, upsert
from sievefold.operators.prefilter import fit_score, prefilter

LISTING = "id int, title string, company string, description string, location_raw string, latitude double, longitude double, salary_min double, salary_is_predicted boolean, posted_date timestamp, provider_matched_term string, hint_commitment string, hint_work_mode string, hint_role_type string"
NOW = "2026-08-23 12:00:00"


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("https://example.com/job/1?utm_source=api&utm_medium=x", "https://example.com/job/1"),
        ("https://WWW.Example.com/job/1", "https://example.com/job/1"),
        ("http://example.com/job/1", "https://example.com/job/1"),
        ("https://example.com/job/1#apply", "https://example.com/job/1"),
        ("https://example.com/job/1?b=2&a=1", "https://example.com/job/1?a=1&b=2"),
        ("https://example.com/job/?a=1", "https://example.com/job?a=1"),
        ("https://example.com", "https://example.com/"),
        ("  NOT A URL  ", "not a url"),
        ("https://example.com/?a=1", "https://example.com/?a=1"),
        ("https://example.com/j//", "https://example.com/j/"),
        ("https://example.com:443/j?a", "https://example.com/j?a="),
        ("https://example.com:8443/j?q=c%2B%2B+dev&a=b=c", "https://example.com:8443/j?a=b%3Dc&q=c%2B%2B+dev"),
        ("https://example.com/j?q=100%&x=%zz%41", "https://example.com/j?q=100%25&x=%25zzA"),
        ("https://example.com/j?caf%C3%A9=ü~*-._!", "https://example.com/j?caf%C3%A9=%C3%BC%7E*-._%21"),
        ("https://example.com/j?utm%5Fterm=1&re%66=2&b=1&b=0", "https://example.com/j?b=1&b=0"),
        ("https://example.com/a b/\"c\"<d>`{e}?x=1", "https://example.com/a%20b/%22c%22%3Cd%3E%60%7Be%7D?x=1"),
        ("https://example.com/é%20%2F+ü!$&'(),:;=@~[]|", "https://example.com/%C3%A9%20%2F+%C3%BC!$&'(),:;=@~[]|"),
        ("https://example.com/a\\b", "https://example.com/a/b"),
        ("https://example.com/a/./b/../c/", "https://example.com/a/c"),
        ("https://example.com/a/b/..", "https://example.com/a"),
        ("https://example.com/../../a%2e/%2E%2e/x", "https://example.com/x"),
        ("https://example.com/..", "https://example.com/"),
    ],
)
def test_canonical_url(spark, raw, want):
    assert one(spark, canonical_url, raw) == want


def test_url_helpers(spark):
    assert one(spark, dedupe_hash, "http://a.b/x") == one(spark, dedupe_hash, "https://www.a.b/x#y")
    assert one(spark, link_host, "https://www.board.example.au/d") == "board.example.au"
    assert one(spark, link_host, "not a url") == "the listing"


def test_fingerprint(spark):
    same = lambda a, b: one(spark, T.fingerprint_text, a) == one(spark, T.fingerprint_text, b)
    assert same("Cyber Security Analyst - URGENT", "Cyber Security Analyst (job)")
    assert same("IT  Support/Officer", "it support officer")
    assert one(spark, T.fingerprint_text, None) == ""


@pytest.mark.parametrize(("text", "want"), [("a 12 week role", 12), ("8-12 week", 8), ("3 month", 13), ("10 day", 1), ("Semester", 16), ("5 day week", 1), ("none", None), ("6–8 months", 26)])
def test_duration(spark, text, want):
    assert one(spark, signals.duration_weeks, text) == want


@pytest.mark.parametrize(
    ("text", "mode", "commitment", "role"),
    [
        ("Two days in the office, three days working from home.", "hybrid", "unknown", "job"),
        ("on-site role, part-time", "onsite", "part_time", "job"),
        ("remote internship", "remote", "unknown", "internship"),
        ("Internal Communications Officer", "unknown", "unknown", "job"),
        ("remote and onsite, casual", "hybrid", "casual", "job"),
    ],
)
def test_signals(spark, text, mode, commitment, role):
    got = [one(spark, f, text) for f in (signals.work_mode, signals.commitment, signals.role_type)]
    assert got == [mode, commitment, role]


@pytest.mark.parametrize(("text", "salary", "predicted", "want"), [("Great", 38.5, False, "paid"), ("Great", 55000.0, True, "unknown"), ("Unpaid placement. No salary", 1.0, False, "unpaid"), ("Great", None, None, "unknown")])
def test_compensation(spark, text, salary, predicted, want):
    df = spark.createDataFrame([(text, salary, predicted)], "t string, s double, p boolean")
    assert df.select(signals.compensation(F.col("t"), F.col("s"), F.col("p")).alias("y")).first().y == want


@pytest.mark.parametrize(
    ("raw", "suburb", "method", "state"),
    [
        ("Werribee VIC 3030", "Werribee", "postcode", "VIC"),
        ("VIC 3029", "Hoppers Crossing", "postcode", "VIC"),
        ("Point Cook VIC 3030", "Werribee", "postcode", "VIC"),
        ("Footscray, Maribyrnong, Victoria", "Footscray", "suburb", "VIC"),
        ("CBD & Inner Suburbs", "Melbourne", "alias", "VIC"),
        ("Nowhereville, Victoria", "Nowhereville", "unresolved", "VIC"),
        (None, None, "unresolved", None),
        ("", None, "unresolved", None),
    ],
)
def test_locations(spark, raw, suburb, method, state):
    df = spark.createDataFrame([(raw, None, None)], "r string, a double, b double")
    p = df.select(geo.resolve_location("r", "a", "b").alias("p")).first().p
    assert (p.suburb, p.method, p.state) == (suburb, method, state)


@pytest.mark.parametrize(("raw", "want"), [("Melbourne, FL", False), ("Werribee 3030", True), ("Melbourne 32901", False), (None, False), ("Australian Capital Territory", True)])
def test_local_signal(spark, raw, want):
    assert one(spark, geo.has_local_signal, raw) is want


def test_distance():
    assert 63 < geo.haversine(-37.8136, 144.9631, -38.1499, 144.3617) < 67


def test_multiplier():
    p = seed_criteria().preferences
    assert str(multiplier_of(("unknown", "onsite", "full_time", "unknown"), p)[0]) == "1.10"  # decimal rounding would give 1.11
    assert str(multiplier_of(("unpaid", "onsite", "part_time", "internship"), p)[0]) == "1.35"
    assert str(multiplier_of(("unknown",) * 4, ())[0]) == "1.00"


def test_seed_sizes():
    c = seed_criteria()
    assert [len(c.of(k)) for k in ("include", "exclude", "exclude_work_rights")] == [56, 66, 14]


def test_fit_score(spark):
    df = spark.createDataFrame([(90, 1.5, 100), (45, 1.35, 61), (0, 0.75, 0)], "b int, m double, want int")
    assert all(r.got == r.want for r in df.select("want", fit_score(F.col("b"), F.col("m")).alias("got")).collect())


def listing(i, title, description="", location="Melbourne VIC 3000", **more):
    row = dict(id=i, title=title, company="Acme", description=description, location_raw=location, latitude=None, longitude=None, salary_min=None, salary_is_predicted=False, posted_date=None, provider_matched_term=None, hint_commitment=None, hint_work_mode=None, hint_role_type=None)
    row.update(more)
    return tuple(row[c.split()[0]] for c in LISTING.split(", "))


@pytest.fixture(scope="module")
def judged(spark):
    rows = [
        listing(1, "Cyber Security Internship", "12 weeks unpaid on-site part-time"),
        listing(2, "Security Guard", "cyber security of the site"),
        listing(3, "SOC Analyst - Cyber Security", location="Sydney NSW 2000"),
        listing(4, "Cyber Security Graduate Program"),
        listing(5, "IT Work Experience Placement", "2 weeks"),
        listing(6, "Barista", "it is a nice place"),
        listing(7, "Analyst, Technology Risk", provider_matched_term="Cyber Security"),
        listing(8, "Analyst, Technology Risk", provider_matched_term="Internship"),
        listing(9, "Cleaner", "IT support"),
        listing(10, "IT Support Officer", "nurses and cleaner staff"),
        listing(11, "Cyber-Security Lead", location="Springfield, FL"),
        listing(12, "IT SUPPORT", None, None),
    ]
    return {r.id: r for r in prefilter(spark.createDataFrame(rows, LISTING), small_criteria(), NOW).collect()}


@pytest.mark.parametrize(
    ("i", "keys"),
    [(1, []), (2, ["excluded_keyword"]), (3, ["out_of_radius"]), (4, ["work_rights"]), (5, ["too_short"]), (6, ["no_domain_keyword_match"]), (7, []), (8, ["no_domain_keyword_match"]), (9, ["excluded_keyword"]), (10, []), (11, ["non_australian_location"]), (12, ["non_australian_location"])],
)
def test_prefilter(judged, i, keys):
    r = judged[i]
    assert [x.split(":")[0] for x in r.reasons] == keys
    assert r.status == ("passed" if not keys else "rejected")


def test_prefilter_details(judged):
    r = judged[1]
    assert (r.compensation, r.work_mode, r.commitment, r.role_type, r.duration_weeks, str(r.preference_multiplier)) == ("unpaid", "onsite", "part_time", "internship", 12, "1.35")
    assert judged[7].keyword_match_source == "provider" and judged[7].matched_keywords == ["Cyber Security"]
    assert judged[3].reasons[0].startswith("out_of_radius: 713.")


def test_no_keywords_rejects(spark):
    got = prefilter(spark.createDataFrame([listing(1, "Cyber")], LISTING), Criteria(), NOW).first()
    assert got.reasons == ["no_domain_keyword_match"] and str(got.preference_multiplier) == "1.00"


DUP = "id string, content_fingerprint string, latitude double, longitude double, location_suburb string, first_seen_at timestamp"


def dups(spark, rows):
    df = spark.createDataFrame(rows, "id string, content_fingerprint string, latitude double, longitude double, location_suburb string, t string").withColumn("first_seen_at", F.col("t").cast("timestamp"))
    return {r.id: r.duplicate_of for r in near_duplicates(df).collect()}


def test_near_duplicates(spark):
    km = 1 / 111.195
    got = dups(spark, [("a", "f", 0.0, 0.0, None, "2026-01-01"), ("c", "f", 8 * km, 0.0, None, "2026-01-02"), ("b", "f", 4 * km, 0.0, None, "2026-01-03"), ("d", "g", None, None, "Werribee", "2026-01-01"), ("e", "g", None, None, "werribee", "2026-01-02"), ("x", "h", None, None, None, "2026-01-01"), ("y", "h", None, None, None, "2026-01-02"), ("z", None, 0.0, 0.0, None, "2026-01-02")])
    assert got == {"a": None, "c": None, "b": "a", "d": None, "e": "d", "x": None, "y": None, "z": None}


def test_near_duplicates_like_naive_fold(spark):
    r = random.Random(4)
    rows = [(f"{i:03}", r.choice("fg"), *((None, None) if r.random() < 0.3 else (r.randint(0, 6) * 0.02, 0.0)), r.choice(["A", "b", None, ""]), f"2026-01-{i % 28 + 1:02}") for i in range(200)]
    want = {}
    for fp in "fg":
        clusters = []
        for x in sorted((x for x in rows if x[1] == fp), key=lambda x: (x[5], x[0])):
            place = (x[2], x[3], x[4].lower() if x[4] else x[4])
            hit = next((c for c in clusters if any(same_vacancy(p, place, 5.0) for p in c[1])), None)
            if hit:
                hit[1].append(place)
            else:
                clusters.append((x[0], [place]))
            want[x[0]] = hit[0] if hit else None
    r.shuffle(rows)
    assert dups(spark, rows) == want


def test_merges(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, v string, s string")
    new = spark.createDataFrame([(2, "B", "z"), (3, "C", "z")], "k int, v string, s string")
    merged = upsert(old, new, "k", keep=("s",))
    want = [(1, "a", "x"), (2, "B", "y"), (3, "C", "z")]
    assert sorted(map(tuple, merged.collect())) == want
    assert sorted(map(tuple, upsert(merged, new, "k", keep=("s",)).collect())) == want
    assert sorted(map(tuple, insert_absent(old, new, ["k"]).collect())) == [(1, "a", "x"), (2, "b", "y"), (3, "C", "z")]
    assert sorted(map(tuple, compare_and_set(old, new, "k", "s", "y", "done").collect())) == [(1, "a", "x"), (2, "b", "done")]
    assert delete_where(old, F.col("k") == 1).count() == 1
    assert update_where(old, F.col("k") == 1, v=F.lit("q")).where("v = 'q'").count() == 1


def test_snapshots(spark, tmp_path):
    t = Snapshots(spark, f"file://{tmp_path}/t")
    assert t.current() is None
    t.write(spark.range(3), "0")
    t.write(spark.range(5), "1")
    t.write(spark.range(9), "1")  # the same batch again changes nothing
    assert t.read().count() == 5


def test_budget(spark):
    df = spark.createDataFrame([(i, 1.0 + i % 3) for i in range(50)], "id int, m double")
    got = budget.in_batches(df, [budget.Desc(F.col("m"))], [F.desc("m"), F.col("id")], 8).orderBy("rn").collect()
    assert [r.rn for r in got] == list(range(1, 51)) and [r.id for r in got] == [i for m in (2, 1, 0) for i in range(50) if i % 3 == m]
    b = spark.createDataFrame([(i, 10) for i in range(9)], "batch long, cost int")
    ran = budget.within_budget(b, 35).agg(F.count("*").alias("n"), F.sum("cost").alias("c")).first()
    assert (ran.n, ran.c) == (4, 40)  # over by one batch at most


@pytest.mark.parametrize(("spent", "past", "want"), [(0.0, False, 0.5), (1.8, False, 0.2), (2.0, False, 0.0), (2.4, False, 0.0), (2.0, True, 0.5)])
def test_allowance(spark, spent, past, want):
    now = F.lit("2026-01-02 00:00:00").cast("timestamp")
    reset = F.lit("2026-01-01 00:00:00" if past else "2026-01-03 00:00:00").cast("timestamp")
    got = spark.range(1).select(budget.spend_allowance(F.lit(0.5), F.lit(2.0), F.lit(spent), reset, now).cast("double").alias("y")).first().y
    assert got == pytest.approx(want)


def test_buckets_and_failures(spark):
    s = spark.createDataFrame([(x,) for x in (100, 80, 79, 70, 69, 50, 49, 25, 24, 0)], "s int")
    assert [r.b for r in s.select(budget.score_bucket(F.col("s")).alias("b")).collect()] == ["80-100"] * 2 + ["70-79"] * 2 + ["50-69"] * 2 + ["25-49"] * 2 + ["0-24"] * 2
    fail = lambda m: one(spark, budget.account_level_failure, m)
    assert all(map(fail, ("401 authentication_error", "credit balance is too low"))) and not any(map(fail, ("529 overloaded_error", "500 x", "429 x", "fetch failed")))
    assert one(spark, budget.leaked_json, "fit somewhat.}, {") and not one(spark, budget.leaked_json, "a {set}")


@pytest.mark.parametrize("url", ["https://au.linkedin.com/x", "http://127.0.0.1:8080/", "http://172.16.5.5/", "http://internal.local/", "", "ftp://a.b/", "//example.com"])
def test_denied(spark, url):
    assert one(spark, careers.blocked_reason, url)


@pytest.mark.parametrize("url", ["https://seekers.com.au/careers", "https://myindeed.com/careers"])
def test_not_denied(spark, url):
    assert one(spark, careers.blocked_reason, url) is None


def test_robots(spark):
    rules, delay = careers.robots_rules("User-agent: *\nDisallow: /careers\nAllow: /careers/jobs\nDisallow: /*.pdf$\nCrawl-delay: 2\n", "x")
    allow = lambda p: one(spark, lambda c: careers.robots_allow(c, rules), p)
    assert delay == 2 and allow("/careers/jobs/1") and not allow("/careers/other") and not allow("/a.pdf") and allow("/a.pdfx")
    assert careers.robots_rules("User-agent: a\nUser-agent: b\nDisallow: /\n", "Bee b/1")[0] == [(False, "/")]


def test_postings(spark):
    html = '<script type="application/ld+json">{"@graph": [{"@type": ["JobPosting"], "title": "R&amp;D Intern", "url": "/j/1", "jobLocation": {"address": {"addressLocality": "Footscray", "addressRegion": "VIC", "postalCode": "3011", "addressCountry": "AU"}}, "baseSalary": {"currency": "AUD", "value": {"minValue": 30, "maxValue": "35"}}, "datePosted": "2026-09-01", "description": "&lt;p&gt;Hi&lt;/p&gt;"}]}</script><script type="application/ld+json">{bad</script>'
    r = careers.extract_postings(spark.createDataFrame([(1, html, "https://a.example/x"), (2, None, None)], "page_id int, html string, url string")).collect()
    assert len(r) == 1
    assert (r[0].title, r[0].url, r[0].location_raw, r[0].salary_min, r[0].salary_max, r[0].salary_currency, r[0].description) == ("R&D Intern", "https://a.example/j/1", "Footscray, VIC, 3011, AU", 30.0, 35.0, "AUD", "Hi")


def _page(*postings):
    return "".join(f'<script type="application/ld+json">{json.dumps({"@type": "JobPosting", "title": f"t{i}"} | p)}</script>' for i, p in enumerate(postings))


def test_posting_fields():
    rows = careers.postings_of(
        _page(
            {"baseSalary": {"currency": "AUD", "value": 90000}, "datePosted": "2026-09-01T10:00:00+10:00", "jobLocation": [{"address": "12 High St"}, {"address": "elsewhere"}], "hiringOrganization": "Acme"},
            {"baseSalary": {"value": {"value": "35", "currency": "NZD"}}, "datePosted": "yesterday", "jobLocationType": "TELECOMMUTE", "hiringOrganization": {"legalName": "Acme Pty"}},
            {"baseSalary": "lots", "jobLocation": {"address": {"addressCountry": {"name": "Australia"}, "postalCode": 3000}}, "employmentType": ["INTERN", "PART_TIME"]},
        ),
        "https://a.example/x",
    )
    fields = [(r[2], r[5], r[6], r[7], r[8], r[9], r[10]) for r in rows]
    assert fields == [
        ("Acme", "12 High St", datetime(2026, 9, 1, tzinfo=UTC), None, 90000.0, 90000.0, "AUD"),
        ("Acme Pty", "Remote", None, None, 35.0, 35.0, "NZD"),
        (None, "3000, Australia", None, "INTERN", None, None, None),
    ]


def test_hostile_postings(spark):
    """Bad links, dates and numbers are fields without value, too deep blocks are skipped."""
    huge = 10**400
    html = _page({"url": "http://[bad", "baseSalary": {"value": huge}, "datePosted": "0001-01-01T00:00:00+10:00"}, {"datePosted": "9999-12-31", "url": huge}, {"datePosted": "2026-09-01"})
    deep = '<script type="application/ld+json">' + "[" * 100_000 + "]" * 100_000 + "</script>"
    r = careers.extract_postings(spark.createDataFrame([(1, deep + html, "https://a.example/x")], "page_id int, html string, url string")).orderBy("position").collect()
    assert [x.title for x in r] == ["t0", "t1", "t2"] and r[0].url is None and r[0].salary_min is None
    assert [x.posted_date is None for x in r] == [True, True, False]


def test_request_cost(spark):
    cost = budget.request_cost_usd(F.lit(1_000_000), F.lit(100_000), F.lit(None).cast("int"), F.lit(2_000_000))
    assert abs(spark.range(1).select(cost.alias("c")).first().c - 3.4) < 1e-9


def test_html_to_text(spark):
    assert one(spark, T.html_to_text, "<ul><li>One</li><li>Two</li></ul>") == "- One\n- Two"
    assert one(spark, T.html_to_text, "<script>evil()</script><p>R&amp;D team</p>") == "R&D team"
    assert one(spark, T.html_to_text, "a&#233;b&#8364;") == "aéb€"


def test_rendering(spark):
    assert one(spark, render.escape_html, 'R&D <b> "q"') == 'R&amp;D &lt;b&gt; "q"'
    assert one(spark, render.posted_text, "2026-08-19T13:26:32+00:00") == "19 Aug 2026"
    assert one(spark, render.posted_text, "soon") == "soon"
    assert one(spark, lambda c: render.truncate(c, 10), "hello wide world") == "hello wide…"
    assert one(spark, lambda c: render.truncate(c, 12), "hello you world") == "hello you…"
    ex = lambda b, m: spark.range(1).select(render.score_explanation(F.lit(b), F.lit(m)).alias("y")).first().y
    assert ex(88, 1.2) == "88 resume match × 1.20 preference = 106, capped at 100"
    assert "capped" not in ex(71, 1.3)
    uid = "00000000-0000-4000-8000-000000000001"
    assert one(spark, render.decode_callback, f"a:{uid}").decision == "applied"
    assert [one(spark, render.decode_callback, x) for x in (f"applied:{uid}", "a:no", f"z:{uid}")] == [None] * 3


def test_stream_equals_batch(spark, tmp_path):
    from sievefold.plans.ingest import prepare
    from sievefold.streaming.ingest import start

    rows = [listing(i, "Cyber Security Intern" if i % 2 else "Barista") for i in range(20)]
    df = spark.createDataFrame(rows, LISTING).withColumn("url", F.concat(F.lit("https://a.example/j/"), (F.col("id") % 15).cast("string")))
    for part in range(3):
        df.where(F.col("id") % 3 == part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    table = Snapshots(spark, f"file://{tmp_path}/t")
    q = start(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), table, small_criteria, lambda: NOW, ["id"], f"{tmp_path}/c")
    q.awaitTermination(120)
    streamed = {(r.url_canonical, r.prefilter_status) for r in table.read().collect()}
    batch = {(r.url_canonical, r.prefilter_status) for r in prepare(df, small_criteria(), NOW, ["id"]).collect()}
    assert {u for u, _ in streamed} == {u for u, _ in batch} and table.read().count() == 15


def listing_tables(spark, path, n):
    """The tables behind the listing view, with n orders."""
    orders = spark.range(1, n + 1).select(F.col("id").alias("o_orderkey"), (F.col("id") % 9).alias("o_custkey"), F.lit(100.0).alias("o_totalprice"), F.lit("2001-07-20").cast("timestamp").alias("o_orderdate"), F.lit("1-URGENT").alias("o_orderpriority"))
    orders.write.parquet(f"{path}/orders.parquet")
    spark.range(9).select(F.col("id").alias("c_custkey"), F.concat(F.lit("Customer "), "id").alias("c_name")).write.parquet(f"{path}/customer.parquet")
    return str(path)


def test_scored_batches_hold_the_whole_work_queue(spark, tmp_path):
    from sievefold import queries as q

    sf = listing_tables(spark, tmp_path, 3000)
    todo = [r for r in q.judged(spark, sf).collect() if r.status == "passed" and r.id % 10 != 7 and r.id % 3 == 0]
    assert len(todo) > 20 and any(r.id % 50 for r in todo)
    want = []
    for k, r in enumerate(sorted(todo, key=lambda r: (-r.preference_multiplier, r.id))):
        seen = " | ".join(str(r[c]) for c in ("title", "company", "suburb", "compensation", "work_mode", "commitment", "role_type", "description")).lower()
        score = min(100, 20 + sum(p for t, p in {"cyber": 30, "security": 20, "intern": 15, "support": 10, "data entry": 5}.items() if t in seen))
        want.append((r.id, k // 8, k % 8 + 1, score, min(100, int(score * float(r.preference_multiplier) + 0.5))))
    assert sorted(map(tuple, q.scored_batches(spark, sf).collect())) == sorted(want)
