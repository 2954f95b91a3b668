"""The listing engine's registered queries, with their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import oracles as o
from .criteria import keyword_rows, seed_criteria, small_criteria
from .functions import geo, render, signals
from .functions.text import content_fingerprint, html_to_text, listing_text
from .functions.urls import canonical_url, link_host
from .operators import budget, careers, settings
from .operators.dedupe import apply_marks, dedupe_summary, first_wins, near_duplicates
from .operators.merge import compare_and_set, delete_where, update_where, upsert
from .operators.store import store
from .operators.prefilter import fit_score, prefilter, reason_key
from .plans import matches, report, scoring
from .plans.ingest import dry_run, ingest_summary, merge_listings, prepare, reevaluate, reprocess
from .schemas import BOARD_A, BOARD_B
from .sources import boards
from .streaming import decisions, source_state
from .streaming.polls import remaining_calls
from .sources.listing_view import NOW, listings, listings_sql, spread, sql_text

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, Callable[[], str]] = {}
ONE_LINE = " | "


def query(oracle: Callable[[], str] | None = None):
    def register(f):
        _QUERIES[f.__name__] = f
        if oracle:
            _ORACLES[f.__name__] = oracle
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: f() for k, f in _ORACLES.items()}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefilter(listings(spark, sf_dir), seed_criteria(), NOW)


def _pf(select: str) -> Callable[[], str]:
    return lambda: f"WITH {o.located()}, {o.prefiltered(seed_criteria())} {select}"


@query(lambda: f"SELECT page_id, {o.canonical('url')} AS url_canonical, sha256({o.canonical('url')}) AS dedupe_hash FROM pages")
def url_canonical(spark, sf_dir):
    x = table(spark, sf_dir, "pages").select("page_id", canonical_url("url").alias("url_canonical"))
    return x.withColumn("dedupe_hash", F.sha2("url_canonical", 256))


@query(lambda: f"SELECT p_partkey, {o.fingerprint('p_name', 'p_brand')} AS fingerprint FROM part")
def content_fingerprints(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", content_fingerprint("p_name", "p_brand").alias("fingerprint"))


@query(lambda: f"WITH {o.located()} SELECT id, suburb, state, location_method, {o.distance(-37.8136, 144.9631)} AS distance_km, {o.LOCAL} AS local_signal FROM l4")
def geo_resolve(spark, sf_dir):
    x = listings(spark, sf_dir).withColumn("p", geo.resolve_location("location_raw", "latitude", "longitude"))
    return x.select("id", "p.suburb", "p.state", F.col("p.method").alias("location_method"), geo.distance_from(-37.8136, 144.9631, F.col("p.lat"), F.col("p.lng")).alias("distance_km"), geo.has_local_signal("location_raw").alias("local_signal"))


@query(lambda: f"WITH base AS ({o.listings_sql()}), t AS (SELECT *, {o.TEXT} FROM base) SELECT id, {o.signals_sql()} FROM t")
def listing_signals(spark, sf_dir):
    text = listing_text()
    return listings(spark, sf_dir).select(
        "id", signals.compensation(text, F.col("salary_min"), F.col("salary_is_predicted")).alias("compensation"), signals.work_mode(text).alias("work_mode"),
        F.coalesce("hint_commitment", signals.commitment(text)).alias("commitment"), signals.role_type(text).alias("role_type"), signals.duration_weeks(text).alias("duration_weeks"),
    )


@query(_pf("SELECT id, status, array_to_string(reasons, ' | ') AS reasons, array_to_string(matched_keywords, ' | ') AS matched_keywords, keyword_match_source, distance_km, suburb, state, compensation, work_mode, commitment, role_type, duration_weeks, preference_multiplier FROM pf"))
def prefilter_listings(spark, sf_dir):
    x = judged(spark, sf_dir)
    return x.select("id", "status", F.array_join("reasons", ONE_LINE).alias("reasons"), F.array_join("matched_keywords", ONE_LINE).alias("matched_keywords"), "keyword_match_source", "distance_km", "suburb", "state", "compensation", "work_mode", "commitment", "role_type", "duration_weeks", "preference_multiplier")


def _strict():
    """Criteria whose unknown places are rejected and whose durations have an upper bound."""
    return small_criteria().with_filter(keep_unknown_location=False, min_duration_weeks=3, max_duration_weeks=12)


@query(lambda: f"WITH {o.located()}, {o.prefiltered(_strict())} SELECT id, status, array_to_string(reasons, ' | ') AS reasons FROM pf")
def prefilter_strict(spark, sf_dir):
    return prefilter(listings(spark, sf_dir), _strict(), NOW).select("id", "status", F.array_join("reasons", ONE_LINE).alias("reasons"))


@query(_pf("SELECT reason, count(*) AS n FROM (SELECT trim(split_part(unnest(reasons), ':', 1)) AS reason FROM pf) GROUP BY reason"))
def reason_tally(spark, sf_dir):
    # explode_outer: a plain explode would push a filter on the reasons below their computation
    return judged(spark, sf_dir).select(F.explode_outer("reasons").alias("r")).where("r IS NOT NULL").groupBy(reason_key(F.col("r")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


# --- deduplication, merges, re-evaluation --------------------------------------------


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judged listings as stored rows, with their fingerprint and first sight."""
    x = judged(spark, sf_dir)
    first = F.col("posted_date") + F.make_interval(days=(F.col("id") % 7).cast("int"))
    return x.withColumns({"content_fingerprint": content_fingerprint("title", "company"), "first_seen_at": first, "location_suburb": F.col("suburb")})


_STORED = f"stored AS (SELECT *, {o.fingerprint('title', 'company')} AS content_fingerprint, posted_date + to_days((id % 7)::INT) AS first_seen_at FROM pf)"


@query(lambda: "SELECT doc_id, sha256(text) AS h FROM documents QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1")
def exact_dedupe_first(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return first_wins(docs, ["h"], ["doc_id"])


@query(lambda: f"WITH {o.located()}, {o.prefiltered(seed_criteria())}, {_STORED} SELECT count(*) AS repeated FROM (SELECT content_fingerprint FROM stored GROUP BY 1 HAVING count(*) > 1)")
def fingerprint_groups(spark, sf_dir):
    return stored(spark, sf_dir).groupBy("content_fingerprint").agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.count(F.lit(1)).alias("repeated"))


def _near_sql() -> str:
    """The greedy fold as a recursion over the members of each fingerprint in order."""
    h = "pow(sin(radians(m.b_lat - m.a_lat) / 2), 2) + pow(sin(radians(m.b_lng - m.a_lng) / 2), 2) * cos(radians(m.a_lat)) * cos(radians(m.b_lat))"
    km = f"{2 * geo.EARTH_RADIUS_KM} * asin(sqrt({h}))"
    return f"""WITH RECURSIVE {o.located()}, {o.prefiltered(seed_criteria())}, {_STORED},
members AS MATERIALIZED (SELECT id, content_fingerprint AS fp, latitude AS lat, longitude AS lng, lower(suburb) AS place, row_number() OVER (PARTITION BY content_fingerprint ORDER BY first_seen_at, id) AS k FROM stored),
near AS MATERIALIZED (SELECT fp, k, j FROM (SELECT a.fp, a.k, b.k AS j, a.lat AS a_lat, a.lng AS a_lng, b.lat AS b_lat, b.lng AS b_lng, a.place AS a_place, b.place AS b_place FROM members a JOIN members b ON a.fp = b.fp AND b.k < a.k) m
  WHERE CASE WHEN a_lat IS NOT NULL AND b_lat IS NOT NULL THEN {km} <= 5 ELSE a_place <> '' AND a_place = b_place END),
links AS MATERIALIZED (SELECT fp, k, list(j) AS js FROM near GROUP BY fp, k),
step AS (SELECT fp, 1::BIGINT AS k, [1::BIGINT] AS heads FROM members WHERE k = 1
  UNION ALL SELECT s.fp, m.k, list_append(s.heads, coalesce(list_min([s.heads[j] for j in l.js]), m.k)) FROM step s JOIN members m ON m.fp = s.fp AND m.k = s.k + 1 LEFT JOIN links l ON l.fp = m.fp AND l.k = m.k)
SELECT m.id, CASE WHEN s.heads[m.k] <> m.k THEN c.id END AS duplicate_of FROM members m JOIN step s ON s.fp = m.fp AND s.k = m.k JOIN members c ON c.fp = m.fp AND c.k = s.heads[m.k]"""


@query(_near_sql)
def near_duplicate_listings(spark, sf_dir):
    return near_duplicates(stored(spark, sf_dir))


@query(lambda: f"SELECT count(*) AS examined, count(duplicate_of) AS duplicates, count(*) FILTER (duplicate_of IS DISTINCT FROM CASE WHEN id % 10 = 7 THEN id - 7 END) AS changed FROM ({_near_sql()})")
def dedupe_counters(spark, sf_dir):
    x = store(stored(spark, sf_dir)).withColumn("duplicate_of", F.when(F.col("id") % 10 == 7, F.col("id") - 7))
    return dedupe_summary(apply_marks(x, near_duplicates(x)))


EARLIER = "2001-07-01 00:00:00"


@query(_pf(f""", d AS (SELECT *, sha256({o.canonical('url')}) AS dedupe_hash FROM pf),
old AS (SELECT * FROM d WHERE source = 'board_a' QUALIFY row_number() OVER (PARTITION BY dedupe_hash ORDER BY id) = 1),
new AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY dedupe_hash ORDER BY id DESC) = 1)
SELECT dedupe_hash, coalesce(old.id, new.id) AS id, coalesce(new.title, old.title) AS title, coalesce(new.status, old.status) AS prefilter_status, CASE WHEN old.id IS NULL THEN '{NOW}' ELSE '{EARLIER}' END AS first_seen, CASE WHEN new.id IS NULL THEN '{EARLIER}' ELSE '{NOW}' END AS last_seen FROM old FULL JOIN new USING (dedupe_hash)"""))
def ingest_merge(spark, sf_dir):
    """A cycle over both boards merged into what an earlier one had stored of the first."""
    x = listings(spark, sf_dir)
    before = prepare(x.where("source = 'board_a'"), seed_criteria(), EARLIER, ["id"])
    after = merge_listings(before, prepare(x, seed_criteria(), NOW, [F.desc("id")]))
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return after.select("dedupe_hash", "id", "title", "prefilter_status", shown("first_seen_at").alias("first_seen"), shown("last_seen_at").alias("last_seen"))


@query(lambda: "WITH n AS (SELECT o_orderkey AS id, o_totalprice AS price, 'new' AS status FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 2 = 1), e AS (SELECT o_orderkey AS id, 1.0::DOUBLE AS price, 'old' AS status FROM orders WHERE o_orderkey % 2 = 0) SELECT coalesce(e.id, n.id) AS id, CASE WHEN n.id IS NOT NULL THEN n.price ELSE e.price END AS price, CASE WHEN e.id IS NOT NULL THEN e.status ELSE n.status END AS status FROM e FULL JOIN n ON e.id = n.id")
def upsert_merge(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    old = orders.where("id % 2 = 0").select("id", F.lit(1.0).alias("price"), F.lit("old").alias("status"))
    new = orders.where("id % 3 = 0 OR id % 2 = 1").withColumn("status", F.lit("new"))
    return upsert(old, new, "id", keep=("status",))


@query(lambda: "SELECT o_orderkey AS id, 'a' AS source FROM orders UNION ALL SELECT l_orderkey, 'b' FROM lineitem")
def union_sources(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit("a").alias("source"))
    return boards.union_all(a, table(spark, sf_dir, "lineitem").select(F.lit("b").alias("source"), F.col("l_orderkey").alias("id")))


@query(lambda: "SELECT o_orderkey AS id FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 30)")
def id_difference(spark, sf_dir):
    done = table(spark, sf_dir, "lineitem").where("l_quantity > 30").select(F.col("l_orderkey").alias("id"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")).join(done, "id", "left_anti")


def _flips_sql() -> str:
    return f"""WITH {o.located()}, {o.prefiltered(seed_criteria(), 'pa')}, {o.prefiltered(small_criteria().with_filter(radius_km=70, max_listing_age_days=3000), 'pb')}
SELECT CASE WHEN pa.status = pb.status THEN 'unchanged' WHEN pb.status = 'passed' THEN 'to_passed' ELSE 'to_rejected' END AS flip, count(*) AS n FROM pa JOIN pb USING (id) GROUP BY 1"""


@query(_flips_sql)
def reprocess_flips(spark, sf_dir):
    return reprocess(listings(spark, sf_dir), seed_criteria(), small_criteria().with_filter(radius_km=70, max_listing_age_days=3000), NOW)


_VERDICT = lambda t: f"({t}.status, {t}.reasons, {t}.matched_keywords, {t}.preference_multiplier)"


@query(lambda: _flips_sql().split("\nSELECT ")[0] + f"\nSELECT id, pb.status AS status, {_VERDICT('pa')} IS DISTINCT FROM {_VERDICT('pb')} AS changed FROM pa JOIN pb USING (id)")
def reprocess_changes(spark, sf_dir):
    edited = small_criteria().with_filter(radius_km=70, max_listing_age_days=3000)
    return reevaluate(store(judged(spark, sf_dir)), edited, NOW).select("id", "status", "changed")


@query(_pf("SELECT id, status, preference_multiplier, row_number() OVER (ORDER BY status <> 'passed', preference_multiplier DESC, id) AS position FROM pf"))
def demo_order(spark, sf_dir):
    return dry_run(store(judged(spark, sf_dir))).select("id", "status", "preference_multiplier", "position")


@query(_pf("SELECT id, preference_multiplier FROM pf WHERE status = 'passed' ORDER BY preference_multiplier DESC, id LIMIT 20"))
def top_by_multiplier(spark, sf_dir):
    return report.top_by_multiplier(judged(spark, sf_dir), 20).select("id", "preference_multiplier")


@query(_pf("SELECT keyword_match_source AS source, count(*) AS n FROM pf WHERE status = 'passed' GROUP BY 1"))
def match_source_tally(spark, sf_dir):
    return judged(spark, sf_dir).where("status = 'passed'").groupBy(F.col("keyword_match_source").alias("source")).agg(F.count(F.lit(1)).alias("n"))


@query(_pf("SELECT axis, value, count(*) AS n FROM (UNPIVOT (SELECT compensation, work_mode, commitment, role_type FROM pf WHERE status = 'passed') ON compensation, work_mode, commitment, role_type INTO NAME axis VALUE value) GROUP BY 1, 2"))
def axis_distribution(spark, sf_dir):
    return report.axis_distribution(judged(spark, sf_dir).where("status = 'passed'"))


@query(lambda: f"WITH {o.located()}, {o.prefiltered(seed_criteria())}, {_STORED} SELECT count(*) AS fetched, count(*) FILTER (status = 'passed') AS passed, count(*) FILTER (status = 'rejected') AS rejected, count(*) - count(DISTINCT {o.canonical('url')}) AS in_batch_duplicates, count(*) FILTER (duration_weeks IS NOT NULL) AS duration_stated, count(*) FILTER (salary_min > 0 AND NOT salary_is_predicted) AS salary_stated FROM stored")
def ingest_stats(spark, sf_dir):
    return ingest_summary(stored(spark, sf_dir))


# --- matches -------------------------------------------------------------------------

THRESHOLD = 70


def match_rows(judged_: DataFrame) -> DataFrame:
    """A match of every judged listing, with every status."""
    status = F.element_at(F.array(*map(F.lit, report.STATUSES)), (F.col("id") * 31 % 5 + 1).cast("int"))
    return judged_.select(
        F.col("id").alias("match_id"), F.col("id").alias("listing_id"), "base_score", fit_score(F.col("base_score"), F.col("preference_multiplier")).alias("fit_score"),
        status.alias("match_status"), (F.col("posted_date") + F.make_interval(days=(F.col("id") % 11).cast("int"))).alias("updated_at"),
    )


#: Listings that have no match yet, where a query asks for such.
_MATCHED = "id % 3 <> 0"


def both(spark: SparkSession, sf_dir: str, matched: str = "true") -> tuple[DataFrame, DataFrame]:
    """Matches of the listings for which ``matched`` holds, and all listings, judged once."""
    x = store(judged(spark, sf_dir))
    return match_rows(x.where(matched)), x.drop("base_score").withColumn("duplicate_of", F.when(F.col("id") % 10 == 7, F.col("id") - 7))


def _matches_sql(select: str, matched: str = "true") -> Callable[[], str]:
    return lambda: f"""WITH {o.located()}, {o.prefiltered(seed_criteria())},
l AS (SELECT * EXCLUDE (base_score), CASE WHEN id % 10 = 7 THEN id - 7 END AS duplicate_of FROM pf),
m AS (SELECT id AS match_id, id AS listing_id, base_score, {o.fit()} AS fit_score, ['new','notified','saved','applied','dismissed'][id * 31 % 5 + 1] AS match_status, posted_date + to_days((id % 11)::INT) AS updated_at FROM pf WHERE {matched}),
j AS (SELECT m.*, l.* EXCLUDE (id) FROM m JOIN l ON m.listing_id = l.id) {select}"""


_RANK = "fit_score DESC, base_score DESC, match_id"


@query(_matches_sql("SELECT match_id, fit_score, preference_multiplier FROM j"))
def fit_scores(spark, sf_dir):
    m, l = both(spark, sf_dir)
    return matches.with_listing(m, l).select("match_id", "fit_score", "preference_multiplier")


@query(_matches_sql("SELECT b.bucket, count(m.match_id)::BIGINT AS n FROM (VALUES ('80-100'), ('70-79'), ('50-69'), ('25-49'), ('0-24')) b(bucket) LEFT JOIN m ON b.bucket = CASE WHEN fit_score >= 80 THEN '80-100' WHEN fit_score >= 70 THEN '70-79' WHEN fit_score >= 50 THEN '50-69' WHEN fit_score >= 25 THEN '25-49' ELSE '0-24' END GROUP BY 1"))
def score_histogram(spark, sf_dir):
    return report.score_histogram(match_rows(judged(spark, sf_dir)))


@query(_matches_sql("SELECT s.status, count(m.match_id)::BIGINT AS n FROM (VALUES ('new'), ('notified'), ('saved'), ('applied'), ('dismissed')) s(status) LEFT JOIN m ON m.match_status = s.status GROUP BY 1"))
def match_status_counts(spark, sf_dir):
    return report.status_counts(match_rows(judged(spark, sf_dir)).withColumnRenamed("match_status", "status"))


@query(_matches_sql("SELECT id, preference_multiplier FROM l WHERE status = 'passed' AND duplicate_of IS NULL AND NOT EXISTS (SELECT 1 FROM m WHERE listing_id = l.id)", _MATCHED))
def work_queue(spark, sf_dir):
    m, l = both(spark, sf_dir, _MATCHED)
    return matches.work_queue(l, m).select("id", "preference_multiplier")


_COST = "1500 + id % 7 * 100"


@query(_matches_sql(f"""
, q AS (SELECT id, {_COST} AS cost, row_number() OVER (ORDER BY preference_multiplier DESC, id) AS rn FROM l WHERE duplicate_of IS NULL AND keyword_match_source <> 'none' AND NOT EXISTS (SELECT 1 FROM m WHERE listing_id = l.id)),
b AS (SELECT (rn - 1) // 8 AS batch, count(*) AS rows, sum(cost)::BIGINT AS cost FROM q GROUP BY 1),
c AS (SELECT *, coalesce(sum(cost) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS spent_before FROM b) SELECT * FROM c WHERE spent_before < 500000""", _MATCHED))
def budget_batches(spark, sf_dir):
    m, l = both(spark, sf_dir, _MATCHED)
    todo = l.where("duplicate_of IS NULL AND keyword_match_source <> 'none'").join(m.select(F.col("listing_id").alias("id")), "id", "left_anti")
    return matches.score_batches(todo, F.expr(_COST), 500_000)


@query(_matches_sql(f"SELECT match_id, fit_score, rank, rank <= 13 AS send FROM (SELECT *, row_number() OVER (ORDER BY {_RANK}) AS rank FROM j WHERE match_status = 'new' AND fit_score >= {THRESHOLD} AND duplicate_of IS NULL) WHERE rank <= 100"))
def notify_queue(spark, sf_dir):
    m, l = both(spark, sf_dir)
    return matches.notify_queue(m, l, THRESHOLD, sent_today=12, cap=25).select("match_id", "fit_score", "rank", "send")


STATS_NOW = "2024-01-30 12:00:00"
_SETTINGS = "id int, is_paused boolean, notify_score_threshold int, max_notifications_per_day int, max_scoring_spend_usd_per_day double, scoring_spend_today double, scoring_spend_reset_at timestamp"


@query(_matches_sql(f"""SELECT (SELECT count(*) FROM l) AS listings_total, (SELECT count(*) FROM l WHERE status = 'passed') AS listings_passed, (SELECT count(*) FROM l WHERE duplicate_of IS NOT NULL) AS duplicates,
 (SELECT count(*) FROM m) AS scored, (SELECT count(*) FROM j WHERE fit_score >= {THRESHOLD} AND duplicate_of IS NULL) AS above_threshold,
 greatest(0, (SELECT count(*) FROM l WHERE status = 'passed' AND duplicate_of IS NULL) - (SELECT count(*) FROM j WHERE status = 'passed' AND duplicate_of IS NULL)) AS awaiting_score,
 {THRESHOLD} AS threshold, 1.25::DOUBLE AS spent_today, 2.0::DOUBLE AS spend_cap_per_day, (SELECT count(*) FROM events WHERE event_type <> 'error' AND ts >= '2024-01-30') AS notified_today, 25 AS notify_cap_per_day, false AS paused,
 """ + ", ".join(f"(SELECT count(*) FROM m WHERE match_status = '{s}') AS n_{s}" for s in report.STATUSES), _MATCHED))
def pipeline_stats(spark, sf_dir):
    m, l = both(spark, sf_dir, _MATCHED)
    row = spark.createDataFrame([(1, False, THRESHOLD, 25, 2.0, 1.25, None)], _SETTINGS).withColumn("scoring_spend_reset_at", F.lit("2024-01-31").cast("timestamp"))
    log = table(spark, sf_dir, "events").select(F.when(F.col("event_type") == "error", "failed").otherwise("sent").alias("status"), F.col("ts").alias("sent_at"))
    return matches.full_stats(l, m, row, log, STATS_NOW)


_PAGE = "match_status IN ('new', 'notified') AND fit_score >= 20 AND (title ILIKE '%cyber%' OR company ILIKE '%cyber%')"


@query(_matches_sql(f"SELECT match_id, fit_score, title, (SELECT count(*) FROM j WHERE {_PAGE}) AS total FROM j WHERE {_PAGE} ORDER BY {_RANK} LIMIT 10 OFFSET 10"))
def match_list_page(spark, sf_dir):
    m, l = both(spark, sf_dir)
    page, total = matches.match_page(m, l, min_score=20, search="(cyber)", page=2, per_page=10)
    return page.select("match_id", "fit_score", "title").withColumn("total", total.scalar())


@query(_matches_sql("SELECT match_id, fit_score, (SELECT count(*) FROM j WHERE match_status = 'saved') AS total FROM j WHERE match_status = 'saved' ORDER BY updated_at DESC, match_id LIMIT 10"))
def saved_matches(spark, sf_dir):
    m, l = both(spark, sf_dir)
    total = m.agg(F.count_if(F.col("match_status") == "saved").alias("total"))
    return matches.latest_decisions(m, l, ("saved",), 10).select("match_id", "fit_score").withColumn("total", total.scalar())


@query(_matches_sql(f"SELECT coalesce(m.match_id, pf.id + 1000000000) AS match_id, pf.id AS listing_id, 100 - pf.base_score AS base_score, {o.fit('(100 - pf.base_score)', 'pf.preference_multiplier')} AS fit_score, coalesce(m.match_status, 'new') AS match_status FROM pf LEFT JOIN m ON m.listing_id = pf.id", _MATCHED))
def match_upsert(spark, sf_dir):
    """Every listing scored again: decisions on earlier matches stay, first matches are new."""
    m, l = both(spark, sf_dir, _MATCHED)
    old = F.col("id") * 37 % 101  # the view's score
    again = match_rows(l.withColumn("base_score", (100 - old).cast("int"))).withColumn("match_id", F.col("listing_id") + 1_000_000_000)
    return scoring.upsert_matches(m, again).select("match_id", "listing_id", "base_score", "fit_score", "match_status")


@query(_matches_sql("SELECT match_id, match_status, updated_at FROM j WHERE match_status IN ('saved', 'applied', 'dismissed') ORDER BY updated_at DESC, match_id LIMIT 20"))
def decision_history(spark, sf_dir):
    m, l = both(spark, sf_dir)
    return matches.latest_decisions(m, l).select("match_id", "match_status", F.col("updated_at").cast("timestamp_ntz").alias("updated_at"))


@query(_matches_sql(f"SELECT match_id, fit_score FROM j WHERE match_status IN ('new', 'notified') AND duplicate_of IS NULL ORDER BY {_RANK} LIMIT 5"))
def top_matches(spark, sf_dir):
    m, l = both(spark, sf_dir)
    return matches.top_matches(m, l).select("match_id", "fit_score")


@query(_pf("SELECT trim(split_part(r, ':', 1)) AS reason, count(*) AS n FROM (SELECT unnest(reasons) AS r FROM (SELECT * FROM pf WHERE status = 'rejected' ORDER BY posted_date DESC, id LIMIT 1000)) GROUP BY 1"))
def rejection_sample(spark, sf_dir):
    return report.rejection_breakdown(judged(spark, sf_dir), 1000, [F.desc("posted_date"), F.col("id")])


@query(_pf("SELECT trim(split_part(r, ':', 1)) AS reason, count(*) AS n, (SELECT count(*) FROM pf WHERE status = 'rejected') AS total FROM (SELECT unnest(reasons) AS r FROM pf WHERE status = 'rejected') GROUP BY 1"))
def rejection_breakdown(spark, sf_dir):
    x = store(judged(spark, sf_dir))
    return report.rejection_breakdown(x).withColumn("total", report.rejected_total(x).scalar())


@query(_matches_sql("SELECT count(*) FILTER (fit_score >= 70) AS notifiable FROM m"))
def notifiable(spark, sf_dir):
    return report.notifiable_buckets(report.score_histogram(match_rows(judged(spark, sf_dir))))


@query(_matches_sql("""SELECT match_id, CASE WHEN floor(base_score * preference_multiplier::DOUBLE + 0.5) > 100 THEN base_score || ' resume match × ' || preference_multiplier || ' preference = ' || floor(base_score * preference_multiplier::DOUBLE + 0.5)::BIGINT || ', capped at 100' ELSE base_score || ' resume match × ' || preference_multiplier || ' preference' END AS explanation,
 array_to_string(list_filter([CASE WHEN suburb <> '' THEN suburb END, floor(distance_km + 0.5)::BIGINT || ' km away'], lambda x: x IS NOT NULL), ' · ') AS place,
 array_to_string(list_filter([CASE WHEN compensation <> 'unknown' THEN compensation END, CASE work_mode WHEN 'unknown' THEN NULL WHEN 'onsite' THEN 'on-site' ELSE work_mode END,
  CASE commitment WHEN 'unknown' THEN NULL WHEN 'full_time' THEN 'full-time' WHEN 'part_time' THEN 'part-time' ELSE commitment END, '~' || duration_weeks || ' weeks'], lambda x: x IS NOT NULL), ' · ') AS facts,
 strftime(posted_date, '%-d %b %Y') AS posted FROM j"""))
def card_lines(spark, sf_dir):
    m, l = both(spark, sf_dir)
    x = matches.with_listing(m, l)
    return x.select(
        "match_id", render.score_explanation(F.col("base_score"), F.col("preference_multiplier")).alias("explanation"), render.place_line(F.col("suburb"), F.col("distance_km")).alias("place"),
        render.facts_line(F.lit(None).cast("string"), F.col("compensation"), F.col("work_mode"), F.col("commitment"), weeks=F.col("duration_weeks")).alias("facts"),
        render.posted_text(F.col("posted_date").cast("string")).alias("posted"),
    )


# --- writes, failures, times -----------------------------------------------------------


@query(lambda: "WITH ids AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 40) SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_orderkey IN (SELECT l_orderkey FROM ids) THEN 'notified' ELSE o_orderstatus END AS status FROM orders")
def compared_and_set(spark, sf_dir):
    """Orders with a large line move on, if they are still open."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    ids = table(spark, sf_dir, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("o_orderkey"))
    return compare_and_set(orders, ids, "o_orderkey", "status", "O", "notified")


@query(lambda: "SELECT p_partkey, CASE WHEN p_size > 25 THEN upper(p_name) ELSE p_name END AS p_name, CASE WHEN p_size > 25 THEN true ELSE p_partkey % 2 = 0 END AS loud FROM part WHERE NOT coalesce(p_type = 'ECONOMY' AND p_size < 10, false)")
def bulk_writes(spark, sf_dir):
    """One predicate's update and another's delete."""
    x = table(spark, sf_dir, "part").withColumn("loud", F.col("p_partkey") % 2 == 0)
    x = update_where(x, F.col("p_size") > 25, p_name=F.upper("p_name"), loud=F.lit(True))
    return delete_where(x, (F.col("p_type") == "ECONOMY") & (F.col("p_size") < 10)).select("p_partkey", "p_name", "loud")


@query(lambda: f"SELECT event_id AS match_id, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'sent' END AS status, CASE WHEN event_type = 'error' THEN left(repeat('no answer ', (event_id % 90)::INT), {settings.ERROR_LENGTH}) END AS error FROM events")
def notification_log(spark, sf_dir):
    """The log rows of attempts to send, some failed with long errors."""
    failed = F.col("event_type") == "error"
    none = F.lit(None).cast("string")
    tried = table(spark, sf_dir, "events").select(F.col("event_id").alias("match_id"), F.lit("chat").alias("channel"), none.alias("chat_id"), none.alias("message_id"), none.alias("payload"), F.when(failed, F.repeat(F.lit("no answer "), (F.col("event_id") % 90).cast("int"))).alias("error"))
    return settings.notification_rows(tried, F.lit(NOW).cast("timestamp")).select("match_id", "status", "error")


_MESSAGES = ("401 authentication_error", "Your credit balance is TOO LOW", "529 overloaded", "request 500 failed", "code 14030", "insufficient_quota")


@query(lambda: f"SELECT event_id, event_type <> 'view' AND event_id % {len(_MESSAGES)} IN (0, 1, 4, 5) AS final FROM events")
def failure_classes(spark, sf_dir):
    """Which errors no retry mends; views have none."""
    message = F.when(F.col("event_type") != "view", F.element_at(F.array(*map(F.lit, _MESSAGES)), (F.col("event_id") % len(_MESSAGES) + 1).cast("int")))
    return table(spark, sf_dir, "events").select("event_id", budget.account_level_failure(message).alias("final"))


@query(lambda: "WITH g AS (SELECT l_orderkey AS batch, count(*) FILTER (l_orderkey % 5 <> 0 OR l_linenumber <> 1) AS got, count(*) AS want, count(*) FILTER (l_linenumber = 6 AND l_orderkey % 2 = 0) AS leaks FROM lineitem GROUP BY 1) SELECT batch, got = want AND leaks = 0 AS valid FROM g")
def batch_validity(spark, sf_dir):
    """Batches of scores: some lack one, some hold output that ran on."""
    sent = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("batch"), "l_linenumber")
    told = F.when((F.col("l_linenumber") == 6) & (F.col("batch") % 2 == 0), 'fits.}, {"ref": 2').otherwise("fits")
    got = sent.where("batch % 5 <> 0 OR l_linenumber <> 1").withColumn("reasoning", told)
    return budget.batch_is_valid(got, sent)


_AGO_AT = "2024-01-31 00:00:00"


@query(lambda: f"""SELECT event_id, CASE WHEN event_type = 'error' THEN 'never' WHEN m < 1 THEN 'just now' WHEN m < 60 THEN m || 'm ago' WHEN m < 1440 THEN m // 60 || 'h ago' ELSE m // 1440 || 'd ago' END AS ago
 FROM (SELECT *, (epoch_us(TIMESTAMP '{_AGO_AT}') - epoch_us(ts)) // 60000000 AS m FROM events)""")
def relative_times(spark, sf_dir):
    then = F.when(F.col("event_type") != "error", F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select("event_id", report.ago(then, F.lit(_AGO_AT).cast("timestamp")).alias("ago"))


@query(lambda: "SELECT page_id, regexp_replace(lower(regexp_extract(url, '://([^/?#:]*)', 1)), '^www\\.', '') AS host FROM pages")
def link_hosts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", link_host("url").alias("host"))


# --- sources, state, pages -----------------------------------------------------------

_BROKEN, _NO_URL, _NO_TITLE, _NO_DATE = "id % 17 = 0", "id % 13 = 1", "id % 11 = 2", "id % 19 = 3"
_SALARIES = ("$35 - $45 an hour", "$90,000.50", "", "negotiable", None)
_TYPES = ("Part-time", "Casual work", "Temporary", "Full-time", "Other", None)


def _picked(values: tuple) -> str:
    cases = " ".join(f"WHEN {i} THEN {sql_text(v)}" for i, v in enumerate(values))
    return f"CASE id % {len(values)} {cases} END"


def payloads(spark: SparkSession, sf_dir: str, board: str) -> DataFrame:
    """A board's listings as the payloads it would send, some of them broken or incomplete."""
    x = listings(spark, sf_dir).where(F.col("source") == board)
    at = F.date_format("posted_date", "yyyy-MM-dd'T'HH:mm:ss")
    url, title = F.when(~F.expr(_NO_URL), F.col("url")), F.when(~F.expr(_NO_TITLE), F.col("title")).otherwise("")
    if board == "board_a":
        job = F.struct(
            F.col("source_id").alias("id"), F.concat(at, F.lit("Z")).alias("created"), F.when(title != "", F.concat(title, F.lit(" &amp; more&nbsp;&nbsp;&lt;x&gt; "))).otherwise(title).alias("title"),
            F.concat("description", F.lit(" &quot;as  is&quot; &#39;now&#39;")).alias("description"), url.alias("redirect_url"), F.struct(F.col("company").alias("display_name")).alias("company"),
            F.struct(F.when(F.col("id") % 7 < 4, F.col("location_raw")).alias("display_name"), F.array(F.lit("Australia"), F.col("location_raw")).alias("area")).alias("location"),
            "latitude", "longitude", "salary_min", F.when(F.col("salary_is_predicted"), "1").otherwise("0").alias("salary_is_predicted"), F.col("hint_commitment").alias("contract_time"),
        )
        body = F.struct(F.lit(1).alias("count"), F.array(job).alias("results"))
    else:
        job = F.struct(
            F.col("source_id").alias("id"), F.when(title != "", F.concat(F.lit("<b>"), title, F.lit("</b><br/> <>"))).otherwise(title).alias("title"), F.col("location_raw").alias("location"),
            F.concat(F.lit("<p class='x'>"), F.col("description"), F.lit("</p>\n\tok ")).alias("snippet"), F.expr(_picked(_SALARIES)).alias("salary"), F.expr(_picked(_TYPES)).alias("type"),
            url.alias("link"), F.concat(F.lit("  "), F.col("company"), F.lit(" ")).alias("company"), F.when(F.expr(_NO_DATE), "soon").otherwise(F.concat(at, F.lit(".1234567"))).alias("updated"),
        )
        body = F.struct(F.lit(1).alias("totalCount"), F.array(job).alias("jobs"))
    sent = F.when(F.expr(_BROKEN), '{"count": 1, "results": [{"id": ').otherwise(F.to_json(body))
    # stored as received texts are: inlined, the texts' making would be part of every inferred filter
    return store(x.select(sent.alias("body"), F.col("provider_matched_term").alias("term")))


def _board_sql(select: str, board: str) -> Callable[[], str]:
    return lambda: f"WITH base AS (SELECT * FROM ({listings_sql()}) WHERE source = '{board}'), b AS (SELECT * FROM base WHERE NOT ({_BROKEN}) AND NOT ({_NO_URL}) AND NOT ({_NO_TITLE})) {select}"


@query(_board_sql("""SELECT source_id, url, regexp_replace(title || ' & more  <x>', '[ \\t]{2,}', ' ', 'g') AS title, company, regexp_replace(description, '[ \\t]{2,}', ' ', 'g') || ' "as is" ' || chr(39) || 'now' || chr(39) AS description, location_raw, latitude, longitude, salary_min, salary_is_predicted,
 epoch(posted_date)::BIGINT AS posted, hint_commitment, provider_matched_term FROM b""", "board_a"))
def board_a_listings(spark, sf_dir):
    x = boards.board_a(boards.parse_payload(payloads(spark, sf_dir, "board_a"), "body", BOARD_A), F.col("term"))
    return x.select("source_id", "url", "title", "company", "description", "location_raw", "latitude", "longitude", "salary_min", "salary_is_predicted", F.unix_seconds("posted_date").alias("posted"), "hint_commitment", "provider_matched_term")


_POSTED_B = f"CASE WHEN NOT ({_NO_DATE}) THEN strftime(posted_date, '%Y-%m-%d %H:%M:%S') END"


@query(_board_sql(f"""SELECT source_id, url, regexp_replace(title, '\\s+', ' ', 'g') || ' <>' AS title, company, regexp_replace(description, '\\s+', ' ', 'g') || ' ok' AS description, location_raw,
 CASE id % 5 WHEN 0 THEN 35.0 WHEN 1 THEN 90000.5 END::DOUBLE AS salary_min, {_POSTED_B} AS posted, CASE id % 6 WHEN 0 THEN 'part_time' WHEN 1 THEN 'casual' WHEN 2 THEN 'contract' WHEN 3 THEN 'full_time' END AS hint_commitment FROM b""", "board_b"))
def board_b_listings(spark, sf_dir):
    x = boards.board_b(boards.parse_payload(payloads(spark, sf_dir, "board_b"), "body", BOARD_B), F.col("term"))
    return x.select("source_id", "url", "title", "company", "description", "location_raw", "salary_min", F.date_format("posted_date", "yyyy-MM-dd HH:mm:ss").alias("posted"), "hint_commitment")


@query(_board_sql(f"SELECT id, {_POSTED_B} AS posted FROM b ORDER BY posted DESC NULLS LAST, id LIMIT 50", "board_b"))
def newest_listings(spark, sf_dir):
    x = boards.board_b(boards.parse_payload(payloads(spark, sf_dir, "board_b"), "body", BOARD_B)).withColumn("id", F.col("source_id").cast("long"))
    return report.newest(x, 50).select("id", F.date_format("posted_date", "yyyy-MM-dd HH:mm:ss").alias("posted"))


@query(lambda: "SELECT user_id, arg_max(event_type, {'ts': ts, 'id': event_id}) AS event_type FROM events GROUP BY user_id")
def latest_decision(spark, sf_dir):
    return budget.latest_decision(table(spark, sf_dir, "events"), "user_id", "event_type", ["ts", "event_id"])


@query(lambda: "WITH x AS (SELECT *, sum((value <= 50)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events) SELECT event_id, sum((value > 50)::INT) OVER (PARTITION BY user_id, run ORDER BY ts, event_id)::BIGINT AS streak FROM x")
def failure_streaks(spark, sf_dir):
    return budget.failure_streaks(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("value") > 50).select("event_id", "streak")


@query(lambda: "SELECT event_id, row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id) <= 2 AS within_quota FROM events")
def daily_quota(spark, sf_dir):
    day = F.date_trunc("day", F.col("ts"))
    rank = F.row_number().over(Window.partitionBy("user_id", day).orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").select("event_id", (rank <= 2).alias("within_quota"))


def polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as polls of sources: each user is one, errors are failures."""
    failed = F.col("event_type") == "error"
    return table(spark, sf_dir, "events").select(
        "event_id", F.concat(F.lit("source "), F.col("user_id").cast("string")).alias("name"), F.col("ts").cast("timestamp").alias("at"), (F.col("event_id") % 9).alias("calls"), (~failed).alias("ok"),
        F.when(failed, F.concat(F.lit("error "), F.col("event_id").cast("string"))).alias("error"),
    )


_POLLS = """p AS (SELECT event_id, 'source ' || user_id AS name, ts AS "at", event_id % 9 AS calls, event_type <> 'error' AS ok, CASE WHEN event_type = 'error' THEN 'error ' || event_id END AS error FROM events)"""
_HISTORY = f"""{_POLLS}, r AS (SELECT *, sum(ok::INT) OVER (PARTITION BY name ORDER BY "at") AS run FROM p),
h AS (SELECT event_id, name, "at", sum(calls) OVER (PARTITION BY name, date_trunc('day', "at") ORDER BY "at")::BIGINT AS calls_today, date_trunc('day', "at") + INTERVAL 1 DAY AS quota_reset_at,
 max(CASE WHEN ok THEN "at" END) OVER (PARTITION BY name ORDER BY "at") AS last_success_at, error AS last_error, sum((NOT ok)::INT) OVER (PARTITION BY name, run ORDER BY "at")::BIGINT AS consecutive_failures FROM r)"""
_SHOWN = ("at", "quota_reset_at", "last_success_at")
_SHOWN_SQL = ", ".join(f"""strftime("{c}", '%Y-%m-%d %H:%M:%S.%f') AS "{c}\"""" for c in _SHOWN)


def _shown_times(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") for c in _SHOWN})


@query(lambda: f"WITH {_HISTORY} SELECT * REPLACE ({_SHOWN_SQL}) FROM h")
def source_histories(spark, sf_dir):
    """What every source's polls had added up to, after each of them."""
    return _shown_times(source_state.histories(polls(spark, sf_dir)))


@query(lambda: f"WITH {_HISTORY} SELECT * EXCLUDE (event_id) REPLACE ({_SHOWN_SQL}) FROM h QUALIFY row_number() OVER (PARTITION BY name ORDER BY \"at\" DESC) = 1")
def source_states(spark, sf_dir):
    """The sources' states at the end of the log."""
    return _shown_times(source_state.folded(polls(spark, sf_dir).drop("event_id")))


#: When sources are asked whether they are due, and their settings as expressions of their number.
_DUE_AT = "2024-01-30 23:00:00"
_EVERY, _MOST, _ENABLED = "(user_id % 5 + 1) * 240", "user_id % 30 + 1", "user_id % 7 <> 0"


@query(lambda: f"""WITH {_HISTORY}, s AS (SELECT *, split_part(name, ' ', 2)::BIGINT AS user_id FROM h WHERE "at" <= TIMESTAMP '{_DUE_AT}' QUALIFY row_number() OVER (PARTITION BY name ORDER BY "at" DESC) = 1),
x AS (SELECT *, {_EVERY} AS every, {_MOST} AS most, epoch_us(TIMESTAMP '{_DUE_AT}') - epoch_us("at") AS waited FROM s)
SELECT name, CASE WHEN NOT ({_ENABLED}) THEN 'disabled' WHEN TIMESTAMP '{_DUE_AT}' < quota_reset_at AND calls_today >= most THEN 'daily quota spent (' || calls_today || '/' || most || '), resets ' || strftime(quota_reset_at, '%Y-%m-%dT%H:%M:%S.000Z')
 WHEN waited < every * 60000000 THEN 'not due for ' || ceil(every - waited / 60000000.0)::BIGINT || 'm' ELSE 'due' END AS due,
 CASE WHEN TIMESTAMP '{_DUE_AT}' >= quota_reset_at THEN most ELSE greatest(0, most - calls_today) END AS remaining FROM x""")
def source_due(spark, sf_dir):
    """Which sources are due at a moment, by the state that their polls have added up to."""
    now = F.lit(_DUE_AT).cast("timestamp")
    states = source_state.folded(polls(spark, sf_dir).drop("event_id").where(F.col("at") <= now))
    rows = states.withColumn("user_id", F.split_part("name", F.lit(" "), F.lit(2)).cast("long")).withColumns(
        {"poll_interval_minutes": F.expr(_EVERY), "max_calls_per_day": F.expr(_MOST), "enabled": F.expr(_ENABLED), "last_polled_at": F.col("at")}
    )
    return rows.select("name", budget.source_due(now).alias("due"), remaining_calls(now).alias("remaining"))


_KIND = "CASE p_partkey % 4 WHEN 0 THEN 'exclude' WHEN 1 THEN 'exclude_work_rights' ELSE 'include' END"
_TERMS = f"SELECT p_partkey AS ordinal, p_name AS term, {_KIND} AS kind, (p_size % 5 * 0.25 + 0.5)::DECIMAL(4,2) AS weight, p_partkey % 11 <> 0 AS is_active FROM part"


def part_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts' names as a criteria set's terms."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ordinal"), F.col("p_name").alias("term"), F.expr(_KIND).alias("kind"), F.expr("CAST(p_size % 5 * 0.25 + 0.5 AS DECIMAL(4,2))").alias("weight"), (F.col("p_partkey") % 11 != 0).alias("is_active"))


@query(lambda: f"SELECT ordinal, term, weight, row_number() OVER (ORDER BY weight DESC, ordinal) AS position FROM ({_TERMS}) WHERE kind = 'include' AND is_active")
def keyword_plan(spark, sf_dir):
    """In which order terms are asked for; weights are few, so each is numbered by itself."""
    asked = boards.asked_terms(part_keywords(spark, sf_dir))
    return budget.running_total(asked, F.lit(1), [budget.Desc(F.col("weight")), F.floor(F.col("ordinal") / 10_000)], [F.col("ordinal")], "position").select("ordinal", "term", "weight", "position")


@query(lambda: f"SELECT kind, count(*) AS n FROM ({_TERMS}) WHERE is_active GROUP BY kind")
def filter_summary(spark, sf_dir):
    return report.keyword_counts(part_keywords(spark, sf_dir))


_WEIGHT = "(n_nationkey % 4 * 0.25 + 0.75)"


@query(lambda: f"SELECT 'region ' || n_regionkey AS dimension, n_name AS value, {_WEIGHT}::DOUBLE AS weight FROM nation WHERE n_nationkey % 3 <> 0 AND {_WEIGHT} <> 1")
def preference_weights(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select(F.concat(F.lit("region "), F.col("n_regionkey").cast("string")).alias("dimension"), F.col("n_name").alias("value"), F.expr(f"CAST({_WEIGHT} AS DOUBLE)").alias("weight"), (F.col("n_nationkey") % 3 != 0).alias("is_active"))
    return report.preference_summary(rows)


@query(lambda: "SELECT l_orderkey, round(sum((l_partkey * 2.0 + l_suppkey * 10.0 + CASE WHEN l_linenumber % 2 = 0 THEN l_quantity * 2.5 ELSE 0 END + l_linenumber * 0.2) / 1000000.0), 7) AS usd FROM lineitem GROUP BY l_orderkey")
def request_costs(spark, sf_dir):
    """What requests cost by their tokens, summed per run; some write nothing to the cache."""
    x = table(spark, sf_dir, "lineitem")
    written = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity"))
    return x.groupBy("l_orderkey").agg(F.round(F.sum(budget.request_cost_usd(F.col("l_partkey"), F.col("l_suppkey"), written, F.col("l_linenumber"))), 7).alias("usd"))


def _plan_rows() -> str:
    return ", ".join(f"({i}, {sql_text(k.term)}, '{k.kind}', {k.weight}::DECIMAL(4,2))" for i, k in enumerate(seed_criteria().keywords))


def _seed_sql() -> str:
    first = sql_text(seed_criteria().of("include")[0].term)
    return f"""SELECT n_nationkey AS filter_id, {first} AS term, 'include' AS kind, 1.5::DECIMAL(4,2) AS weight FROM nation
UNION ALL SELECT n_nationkey, term, kind, weight FROM nation CROSS JOIN (VALUES {_plan_rows()}) v(i, term, kind, weight) WHERE n_regionkey = 1 AND NOT (term = {first} AND kind = 'include')"""


@query(_seed_sql)
def keyword_seed(spark, sf_dir):
    """The seed's terms for every active filter, of which each has one term already."""
    filters = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), (F.col("n_regionkey") == 1).alias("is_active"))
    have = filters.select(F.col("id").alias("filter_id"), F.lit(seed_criteria().of("include")[0].term).alias("term"), F.lit("include").alias("kind"), F.lit("1.5").cast("decimal(4,2)").alias("weight"))
    return settings.seed_keywords(have, filters, keyword_rows(spark, seed_criteria()).select("term", "kind", "weight"))


@query(lambda: "SELECT 'orders' AS name, count(*) AS rows, count(*) >= 1 AS ok FROM orders UNION ALL SELECT 'pages', count(*), count(*) >= 1000000000 FROM pages UNION ALL SELECT 'acronyms match their case', count(*), count(*) = 0 FROM (VALUES " + ", ".join(f"({sql_text(k.term)}, {k.case_sensitive})" for k in seed_criteria().keywords) + ") v(term, case_sensitive) WHERE regexp_full_match(term, '[A-Z0-9]{2,6}') AND NOT case_sensitive")
def health_check(spark, sf_dir):
    rows = report.health([("orders", table(spark, sf_dir, "orders"), 1), ("pages", table(spark, sf_dir, "pages"), 1_000_000_000)])
    loose = report.loose_acronyms(keyword_rows(spark, seed_criteria())).agg(F.count(F.lit(1)).alias("rows"))
    return rows.unionByName(loose.select(F.lit("acronyms match their case").alias("name"), "rows", (F.col("rows") == 0).alias("ok")))


#: Presses per match: the events of a user, some told twice.
_STATUS = "CASE event_type WHEN 'click' THEN 'saved' WHEN 'purchase' THEN 'applied' WHEN 'error' THEN 'dismissed' ELSE 'notified' END"


@query(lambda: f"""WITH u AS (SELECT user_id::VARCHAR || '-' || (event_id % 37) AS match_id, event_id AS update_id, {_STATUS} AS status FROM events),
r AS (SELECT *, CASE status WHEN 'notified' THEN 1 WHEN 'saved' THEN 2 ELSE 3 END AS rank FROM u),
a AS (SELECT *, coalesce(max(rank) OVER (PARTITION BY match_id ORDER BY update_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reached FROM r)
SELECT match_id, arg_max(status, update_id) AS match_status, max(update_id) AS decided_by, string_agg(status, ' ' ORDER BY update_id) AS accepted FROM a WHERE rank > reached GROUP BY match_id""")
def decision_log(spark, sf_dir):
    """What decisions told twice and out of order come to, by the moves that are allowed."""
    x = table(spark, sf_dir, "events").select(F.concat(F.col("user_id").cast("string"), F.lit("-"), (F.col("event_id") % 37).cast("string")).alias("match_id"), F.col("event_id").alias("update_id"), F.expr(_STATUS).alias("status"))
    told = x.unionByName(x.where("update_id % 5 = 0"))
    return decisions.histories(told).withColumn("accepted", F.array_join("accepted", " "))


_DENY = ("casino-win.example.net", "example.org")


@query(lambda: f"""SELECT page_id, CASE {' '.join(f"WHEN host = '{d}' OR ends_with(host, '.{d}') THEN '{d} is a job board'" for d in _DENY)} END AS reason FROM (SELECT page_id, lower(regexp_extract(url, '://([^/?#:]*)', 1)) AS host FROM pages)""")
def host_denylist(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", careers.blocked_reason(F.col("url"), _DENY).alias("reason"))


_ROBOTS = "User-agent: *\nDisallow: /en/\nAllow: /en/1\nDisallow: /*.html$\nAllow: /de\n\nUser-agent: other\nDisallow: /\n"


@query(lambda: """SELECT page_id, CASE WHEN regexp_matches(p, '^/.*\\.html$') THEN false WHEN starts_with(p, '/en/1') THEN true WHEN starts_with(p, '/en/') THEN false ELSE true END AS allowed
 FROM (SELECT page_id, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS p FROM pages)""")
def robots_allow(spark, sf_dir):
    rules, _ = careers.robots_rules(_ROBOTS, "sievefold")
    path = F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1)
    return table(spark, sf_dir, "pages").select("page_id", careers.robots_allow(path, rules).alias("allowed"))


_SITE = "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)"


@query(lambda: f"""SELECT page_id, CASE WHEN n % 4 > 1 THEN 'robots.txt could not be read, so fetching is not permitted' WHEN n % 4 = 0 AND NOT allowed THEN 'robots.txt disallows ' || p END AS refusal
 FROM (SELECT page_id, n, p, CASE WHEN regexp_matches(p, '^/.*\\.html$') THEN false WHEN starts_with(p, '/en/1') THEN true WHEN starts_with(p, '/en/') THEN false ELSE true END AS allowed
 FROM (SELECT page_id, length(regexp_extract(url, '{_SITE}', 1)) AS n, coalesce(nullif(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), ''), '/') AS p FROM pages))""")
def page_refusals(spark, sf_dir):
    """Robots files of all origins: read, missing, failing or never answered by the length
    of the origin's name."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    n = F.length("origin") % 4
    found = pages.select(F.lower(F.regexp_extract("url", _SITE, 1)).alias("origin")).distinct().where(n < 3)
    found = found.select("origin", F.when(n == 0, 200).when(n == 1, 404).otherwise(503).alias("status"), F.lit(_ROBOTS).alias("body"))
    return careers.read_verdict(pages, careers.robots_by_origin(found, "sievefold")).select("page_id", "refusal")


def _fetched_pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The pages as fetched: some fail, some are missing, some redirect to a board, and each
    declares page_id % 3 postings; and the robots files of their origins."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    i = F.col("page_id")
    post = lambda k: F.concat(F.lit('{"@type":"JobPosting","title":"Job '), i.cast("string"), F.lit(f'-{k}"}}'))
    declared = F.array_join(F.slice(F.array(post(1), post(2)), 1, (i % 3).cast("int")), ",")
    html = F.concat(F.coalesce("html", F.lit("")), F.lit('<script type="application/ld+json">['), declared, F.lit("]</script>"))
    landed = F.when(i % 7 == 0, "https://au.linkedin.com/x").when(i % 7 == 1, F.concat("url", F.lit("#top")))
    pages = pages.select("page_id", "url", html.alias("html"), F.when(i % 5 == 0, 404).otherwise(200).alias("status"), F.when(i % 11 == 0, "timed out").alias("error"), landed.alias("landed_url"))
    site = F.lower(F.regexp_extract("url", _SITE, 1))
    found = pages.select(site.alias("origin")).distinct().where(F.length("origin") % 4 < 3)
    n = F.length("origin") % 4
    body = F.concat(F.lit(_ROBOTS.replace("\n\nUser-agent: other", "\nCrawl-delay: 2.5\n\nUser-agent: other")))
    robots = found.select(F.upper("origin").alias("origin"), F.when(n == 0, 200).when(n == 1, 404).otherwise(503).alias("status"), body.alias("body"))
    return pages, robots


@query(lambda: f"""WITH p AS (SELECT page_id, length(regexp_extract(url, '{_SITE}', 1)) % 4 AS n, coalesce(nullif(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), ''), '/') AS path FROM pages),
a AS (SELECT *, CASE WHEN regexp_matches(path, '^/.*\\.html$') THEN false WHEN starts_with(path, '/en/1') THEN true WHEN starts_with(path, '/en/') THEN false ELSE true END AS allowed FROM p),
r AS (SELECT *, CASE WHEN n > 1 THEN 'robots.txt could not be read, so fetching is not permitted' WHEN n = 0 AND NOT allowed THEN 'robots.txt disallows ' || path END AS refusal FROM a),
o AS (SELECT *, CASE WHEN refusal IS NOT NULL THEN refusal WHEN page_id % 11 = 0 THEN 'timed out' WHEN page_id % 5 = 0 THEN 'HTTP 404' WHEN page_id % 7 = 0 THEN 'redirected to a blocked host: linkedin.com is a job board' END AS reason FROM r)
SELECT page_id, reason, CASE WHEN refusal IS NULL AND page_id % 11 <> 0 THEN CASE WHEN page_id % 5 = 0 THEN 404 ELSE 200 END END AS status, CASE WHEN n = 0 THEN 2.5::DOUBLE END AS crawl_delay,
 CASE WHEN reason IS NULL THEN page_id % 3 ELSE 0 END AS n_postings, CASE WHEN reason IS NULL THEN page_id % 3 = 0 END AS needs_rendering FROM o""")
def career_pages(spark, sf_dir):
    """Guard, robots, fetch outcome, redirects and extraction as one plan."""
    pages, robots = _fetched_pages(spark, sf_dir)
    read = store(careers.read_pages(pages, careers.robots_by_origin(robots, "sievefold")))
    return careers.page_outcomes(read, careers.extract_postings(read.where("reason IS NULL")))


def _tops() -> tuple[list[int], list[int]]:
    return [10, 127, 192, 172, 169, 8, 203, 0], [168, 16, 31, 254, 0, 32]


_WAYS = 16


def _guarded(x: DataFrame) -> DataFrame:
    """(page_id, url): the hosts of pages, boards and addresses, each in one of 16 notations."""
    i, way = F.col("page_id"), F.col("page_id") % _WAYS
    step = F.floor(i / _WAYS)
    host = F.lower(F.regexp_extract("url", "://([^/?#:]*)", 1))
    pick = lambda values, n: F.get(F.array(*map(F.lit, values)), n.cast("int"))
    board = pick(careers.BLOCKED_DOMAINS, step % len(careers.BLOCKED_DOMAINS))
    tops, seconds = _tops()
    bytes_ = [b.cast("long") for b in (pick(tops, step % len(tops)), pick(seconds, step % len(seconds)), i % 256, i * 7 % 256)]
    whole = bytes_[0] * F.lit(1 << 24) + bytes_[1] * F.lit(1 << 16) + bytes_[2] * 256 + bytes_[3]
    text = lambda c, base=10: F.conv(c.cast("string"), 10, base)
    coded = lambda c: F.concat(F.lit("%"), F.hex(F.ascii(c)))
    wide = F.translate(board, "".join(map(chr, range(0x61, 0x7B))) + ".", "".join(map(chr, range(0xFF41, 0xFF5B))) + "\u3002")
    urls = [
        F.concat(F.lit("https://"), host, F.lit("/x")),
        F.concat(F.lit("https://"), F.substring(host, F.lit(1), F.length(host) - 1), coded(F.right(host, F.lit(1))), F.lit("/")),
        F.concat(F.lit("http://"), host, F.lit("."), coded(board), F.substring(board, 2, 99), F.lit("?q")),
        F.concat(F.lit("https://www."), wide, F.lit("/")),
        F.concat(F.lit("http://"), text(whole), F.lit("/")),
        F.concat(F.lit("http://0x"), text(whole, 16), F.lit(":80/")),
        F.concat(F.lit("http://"), F.concat_ws(".", *(F.concat(F.lit("0"), text(b, 8)) for b in bytes_)), F.lit("/")),
        F.concat(F.lit("http://"), text(bytes_[0]), F.lit("."), text(bytes_[1] * F.lit(1 << 16) + bytes_[2] * 256 + bytes_[3]), F.lit("./")),
        F.concat(F.lit("http://"), text(whole + F.lit(1 << 32)), F.lit("/")),
        F.concat(F.lit("https://"), F.upper(board), F.lit("./")),
        F.concat(F.lit("https://"), host, F.lit(":x@"), board, F.lit("/")),
        F.concat(F.lit(" https://"), F.substring(board, 1, 2), F.lit("\t\n"), F.substring(board, 3, 99), F.lit("/")),
        F.concat(F.lit("https://"), host, F.lit("^x/")),
        F.concat(F.lit("ftp://"), host),
        F.concat(F.lit("https:\\\\"), board, F.lit("\\x")),
        F.concat(F.lit("https://"), host, F.lit(":99999/")),
    ]
    out = F.lit(None).cast("string")
    for k, u in enumerate(urls):
        out = F.when(way == k, u).otherwise(out)
    return x.select("page_id", out.alias("url"))


def _guard_sql() -> str:
    pick = lambda values, n: "[" + ", ".join(sql_text(v) if isinstance(v, str) else str(v) for v in values) + f"][{n} % {len(values)} + 1]"
    tops, seconds = _tops()
    return f"""SELECT page_id, CASE WHEN way IN (2, 3, 9, 10, 11, 14) THEN replace(board, 'au.indeed', 'indeed') || ' is a job board' WHEN way IN (8, 12, 15) THEN 'not a valid absolute URL' WHEN way = 13 THEN 'unsupported scheme "ftp:"'
 WHEN way IN (4, 5, 6, 7) AND (a IN (10, 127) OR (a = 192 AND b = 168) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 169 AND b = 254) OR (a = 0 AND b = 0 AND page_id % 256 = 0)) THEN 'private or loopback address' END AS reason
 FROM (SELECT page_id, page_id % {_WAYS} AS way, {pick(careers.BLOCKED_DOMAINS, f'(page_id // {_WAYS})')} AS board, {pick(tops, f'(page_id // {_WAYS})')} AS a, {pick(seconds, f'(page_id // {_WAYS})')} AS b FROM pages)"""


@query(_guard_sql)
def host_guard(spark, sf_dir):
    """The whole guard over hosts in other notations; the oracle knows each by its making."""
    return _guarded(table(spark, sf_dir, "pages")).select("page_id", careers.blocked_reason(F.col("url")).alias("reason"))


def _html_sql() -> str:
    x = "html"
    decode = lambda x: f"replace(replace(replace(replace(replace(replace({x}, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' ')"
    x = decode(x)
    for pattern, to in (("(?is)<script\\b[^>]*>.*?</script>", "' '"), ("(?is)<style\\b[^>]*>.*?</style>", "' '"), ("(?i)<br\\s*/?>", "chr(10)"), ("(?i)</(?:p|div|li|h[1-6]|tr)>", "chr(10)"), ("(?i)<li\\b[^>]*>", "'- '"), ("<[^>]+>", "' '")):
        x = f"regexp_replace({x}, '{pattern}', {to}, 'g')"
    x = decode(x)
    for pattern, to in (("[ \\t\\x{a0}]+", "' '"), ("\\n{3,}", "chr(10) || chr(10)"), ("(?m)^[ \\t]+|[ \\t]+$", "''")):
        x = f"regexp_replace({x}, '{pattern}', {to}, 'g')"
    return f"SELECT page_id, regexp_replace({x}, '^\\s+|\\s+$', '', 'g') AS text FROM pages"


@query(_html_sql)
def html_to_text_pages(spark, sf_dir):
    return spread(table(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", html_to_text("html").alias("text"))


def jsonld_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that declare every turn of a conversation as a posting, in one of three shapes."""
    key = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    said = table(spark, sf_dir, "conversations").select("conv_id", key.alias("page_id"), F.col("text").alias("t"))
    post = F.to_json(F.struct(F.lit("JobPosting").alias("@type"), F.col("t").alias("title"), F.concat(F.lit("/jobs/"), F.col("page_id")).alias("url")))
    body = F.when(F.col("conv_id") % 3 == 0, post).when(F.col("conv_id") % 3 == 1, F.concat(F.lit('{"@graph":['), post, F.lit(","), post, F.lit("]}"))).otherwise(F.lit("{broken"))
    return said.select("page_id", F.concat(F.lit('<script type="application/ld+json">'), body, F.lit("</script>")).alias("html"), F.lit("https://careers.example.com/x").alias("url"))


@query(lambda: "SELECT conv_id || '-' || turn AS page_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS title, 'https://careers.example.com/jobs/' || conv_id || '-' || turn AS url FROM conversations WHERE conv_id % 3 <> 2 AND regexp_matches(text, '\\S')")
def jsonld_postings(spark, sf_dir):
    return careers.extract_postings(jsonld_pages(spark, sf_dir)).select("page_id", "title", "url")


def _posting_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that declare every order as a posting, in the shapes that sites use for company,
    place, salary and date."""
    x = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    way, null = F.col("o_orderkey") % 4, F.lit(None).cast("string")
    js = lambda c: F.to_json(F.struct(c.alias("x"))).substr(F.lit(6), F.length(F.to_json(F.struct(c.alias("x")))) - 6)
    name, day, price = js(F.col("c_name")), js(F.date_format("o_orderdate", "yyyy-MM-dd")), F.format_string("%.2f", "o_totalprice")
    put = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    company = F.when(way == 0, put('"hiringOrganization":', name)).when(way == 1, put('"hiringOrganization":{"name":', name, "}")).when(way == 2, put('"hiringOrganization":{"legalName":', name, "}"))
    street = js(F.concat(F.lit(" "), F.col("o_orderkey").cast("string"), F.lit(" High St ")))
    place = F.when(way == 0, put('"jobLocation":{"address":', name, "}")).when(way == 1, put('"jobLocation":[{"address":{"streetAddress":', street, ',"postalCode":3000,"addressCountry":{"name":"AU"}}}]')).when(way == 2, '"jobLocationType":"TELECOMMUTE"')
    pay = F.when(way == 0, put('"baseSalary":', price)).when(way == 1, put('"baseSalary":{"currency":"AUD","value":{"minValue":"', price, '","maxValue":', price, "}}")).when(way == 2, put('"baseSalary":{"value":', price, ',"currency":"USD"}')).otherwise('"baseSalary":{"value":{"value":"negotiable"}}')
    date = F.when(way == 0, put('"datePosted":', day)).when(way == 1, put('"datePosted":"', F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), '+10:00"')).when(way == 2, '"datePosted":"soon"').otherwise(null)
    fields = F.array_join(F.array(F.lit('"@type":["Thing","JobPosting"]'), put('"name":', js(F.col("o_orderpriority"))), company, place, pay, date, F.when(way == 1, '"employmentType":["FULL_TIME","PART_TIME"]')), ",")
    html = put('<html><script nonce="x" type="application/ld+json">{"item":{', fields, "}}</script>")
    return x.select(F.col("o_orderkey").alias("page_id"), html.alias("html"), F.lit("https://careers.example.com/x").alias("url"))


@query(lambda: """WITH x AS (SELECT *, o_orderkey % 4 AS way FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT o_orderkey AS page_id, o_orderpriority AS title, CASE WHEN way < 3 THEN c_name END AS company, CASE way WHEN 0 THEN c_name WHEN 1 THEN o_orderkey || ' High St, 3000, AU' WHEN 2 THEN 'Remote' END AS location_raw,
 CASE way WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(o_orderdate - INTERVAL 10 HOUR, '%Y-%m-%d %H:%M:%S') END AS posted,
 CASE way WHEN 1 THEN o_totalprice WHEN 2 THEN o_totalprice END AS salary_min, CASE way WHEN 1 THEN o_totalprice WHEN 2 THEN o_totalprice END AS salary_max, CASE way WHEN 1 THEN 'AUD' WHEN 2 THEN 'USD' END AS salary_currency, CASE WHEN way = 1 THEN 'FULL_TIME' END AS employment_type FROM x""")
def posting_details(spark, sf_dir):
    """Company, place, date and salary of postings in several shapes."""
    x = careers.extract_postings(_posting_pages(spark, sf_dir))
    return x.select("page_id", "title", "company", "location_raw", F.date_format("posted_date", "yyyy-MM-dd HH:mm:ss").alias("posted"), "salary_min", "salary_max", "salary_currency", "employment_type")


def _report_sql() -> str:
    passed = "FROM l WHERE status = 'passed'"
    rows = [
        "SELECT 'listings' AS section, status AS name, count(*) AS n FROM l GROUP BY status",
        f"SELECT 'axis ' || axis, value, count(*) FROM (UNPIVOT (SELECT compensation, work_mode, commitment, role_type {passed}) ON compensation, work_mode, commitment, role_type INTO NAME axis VALUE value) GROUP BY ALL",
        f"SELECT 'stated', 'duration', count(duration_weeks) {passed}",
        f"SELECT 'stated', 'salary', count(*) FILTER (salary_min > 0 AND NOT salary_is_predicted) {passed}",
        "SELECT 'score', b.bucket, count(s.id) FROM (VALUES ('80-100'), ('70-79'), ('50-69'), ('25-49'), ('0-24')) b(bucket) LEFT JOIN (SELECT listing_id AS id, CASE WHEN fit_score >= 80 THEN '80-100' WHEN fit_score >= 70 THEN '70-79' WHEN fit_score >= 50 THEN '50-69' WHEN fit_score >= 25 THEN '25-49' ELSE '0-24' END AS bucket FROM j WHERE duplicate_of IS NULL) s ON s.bucket = b.bucket GROUP BY b.bucket",
        "SELECT 'rejected for', trim(split_part(r, ':', 1)), count(*) FROM (SELECT unnest(reasons) AS r FROM l WHERE status = 'rejected') GROUP BY ALL",
    ]
    return ", u AS (" + " UNION ALL ".join(rows) + "), t AS (SELECT *, sum(n) OVER (PARTITION BY section) AS total FROM u) SELECT section, name, n, CASE WHEN section = 'stated' THEN NULL ELSE repeat('█', floor(n * 28 / greatest(total, 1) + 0.5)::INT) || repeat('░', 28 - floor(n * 28 / greatest(total, 1) + 0.5)::INT) END AS bar FROM t"


@query(lambda: _matches_sql(_report_sql(), _MATCHED)())
def text_report(spark, sf_dir):
    """The whole report, as lines of its sections."""
    m, l = both(spark, sf_dir, _MATCHED)
    return report.assembled(l, m)


_POINTS = " + ".join(f"CASE WHEN contains(seen, '{t}') THEN {p} ELSE 0 END" for t, p in scoring.POINTS.items())


@query(_matches_sql(f"""
, q AS (SELECT *, row_number() OVER (ORDER BY preference_multiplier DESC, id) - 1 AS k, lower(concat_ws(chr(10), title, company, suburb, compensation, work_mode, commitment, role_type, description)) AS seen FROM l WHERE status = 'passed' AND duplicate_of IS NULL AND NOT EXISTS (SELECT 1 FROM m WHERE listing_id = l.id)),
s AS (SELECT *, least(100, 20 + {_POINTS})::INT AS base_score FROM q) SELECT id, k // 8 AS batch, (k % 8 + 1)::INT AS ref, base_score, {o.fit()} AS fit_score FROM s""", _MATCHED))
def scored_batches(spark, sf_dir):
    """The whole work queue scored by the stand-in scorer in batches of eight."""
    m, l = both(spark, sf_dir, _MATCHED)
    batched = budget.in_batches(matches.work_queue(l, m), [budget.Desc(F.col("preference_multiplier")), F.floor(F.col("id") / 100_000)], [F.desc("preference_multiplier"), F.col("id")])
    return scoring.score(batched, scoring.rule_scorer).select("id", "batch", "ref", "base_score", "fit_score")


_USD = 1 / 1024  # what the stand-in's listings cost; a power of two, so sums are exact


@query(_matches_sql(f"""
, q AS (SELECT *, row_number() OVER (ORDER BY preference_multiplier DESC, id) - 1 AS k, lower(concat_ws(chr(10), title, company, suburb, compensation, work_mode, commitment, role_type, description)) AS seen FROM l WHERE status = 'passed' AND duplicate_of IS NULL AND NOT EXISTS (SELECT 1 FROM m WHERE listing_id = l.id)),
s AS (SELECT *, least(100, 20 + {_POINTS})::INT AS base_score FROM q WHERE k // 8 * 8 * {_USD!r} < 2)
SELECT listing_id, base_score, fit_score, match_status FROM m UNION ALL SELECT id, base_score, {o.fit()}, 'new' FROM s""", _MATCHED))
def scoring_run(spark, sf_dir):
    """The matches after a run over the work queue within a cycle's budget of two dollars."""
    m, l = both(spark, sf_dir, _MATCHED)
    done = scoring.run(matches.work_queue(l, m), scoring.priced(scoring.rule_scorer, lambda n: n * _USD), 2.0, 8 * _USD)
    return scoring.upsert_matches(m, done.scored.withColumn("listing_id", F.col("id"))).select("listing_id", "base_score", "fit_score", "match_status")
