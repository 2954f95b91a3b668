"""A deterministic listing table over orders and customers, in Spark and in SQL.

The driver's tables hold no listings, so every text column picks from a short list by
``key * prime % length``; the lengths are pairwise coprime, so all combinations occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "2001-08-01 00:00:00"
TITLES = ("Cyber Security Intern", "IT Support Officer", "Security Guard", "Data Entry Clerk", "Senior DevOps Engineer", "Registered Nurse", "Help Desk Analyst - URGENT", "Graduate Program 2002", "Marketing Assistant", "Junior  Developer (job)", "SOC Analyst", "Analyst, Technology Risk", "it Trainee")
DESCRIPTIONS = (
    "A 12 week unpaid placement in the office.", None, "Paid internship, 8-12 weeks, fully remote with salary and superannuation.", "Casual role, hybrid, 3 months.", "Part-time, 5 day week, on-site.",
    "Full time position. Must be an Australian Citizen.", "Semester long university placement; work from home.", "Cyber-Security team with Splunk and AWS.", "We value editing and monitoring; it is fun.",
    "Fixed term contract role, 40 hours, per hour rate.", "Volunteer one day a week, office based.", "Nothing stated here.", "Work experience for students, 2 weeks.", "Flexible working arrangement, 24 months, 0.6 FTE.",
    "Cleaner wanted. Patrol duties.", "Baseline Clearance and visa sponsorship are discussed.", "Information technology helpdesk, 10 days, telecommute.",
)
LOCATIONS = ("Werribee VIC 3030", "Footscray, Maribyrnong, Victoria", "CBD & Inner Suburbs", "Melbourne, FL", "Nowhereville, Victoria", None, "Sydney NSW 2000", "Geelong", "Point Cook VIC 3030", "London", "Docklands, Melbourne", "Richmond", "Northern Suburbs", "Remote Australia", "Melbourne 32901", "Box Hill VIC 3128", "Hobart TAS", "St. Kilda", "Perth | WA")
TERMS = ("Cyber Security", None, "Internship", "IT Support", None, "Data Entry", "Work Experience")
HINTS = (None, "full_time", None, None, "part_time", None, None, None, None, None, None)
#: column: (values, multiplier of the key)
LISTS = {"title": (TITLES, 7919), "description": (DESCRIPTIONS, 104729), "location_raw": (LOCATIONS, 1299709), "provider_matched_term": (TERMS, 15485863), "hint_commitment": (HINTS, 32452843)}


def spread(df: DataFrame) -> DataFrame:
    """Tables of fewer files than there are cores are dealt out before per-row work."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *df.columns[:1]) if len(df.inputFiles()) < cores else df


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spread(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority"))
    names = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name")
    k = F.col("o_orderkey")
    pick = lambda values, prime: F.element_at(F.array(*map(F.lit, values)), (F.pmod(k * prime, F.lit(len(values))) + 1).cast("int"))
    even = k % 2 == 0
    offset: Column = (k % 97 - 48) * 0.01
    return orders.join(names, orders.o_custkey == names.c_custkey).select(
        k.alias("id"),
        F.when(even, "board_a").otherwise("board_b").alias("source"),
        k.cast("string").alias("source_id"),
        F.concat(F.lit("http://www.Example.com/job/"), (k % 9000).cast("string"), F.lit("/?utm_source=x&b=2&a=1#top")).alias("url"),
        *(pick(v, p).alias(c) for c, (v, p) in LISTS.items()),
        F.lit(None).cast("string").alias("hint_work_mode"),
        F.lit(None).cast("string").alias("hint_role_type"),
        F.col("c_name").alias("company"),
        F.when(even, F.lit(-37.8136) + offset).alias("latitude"),
        F.when(even, F.lit(144.9631) + offset).alias("longitude"),
        F.col("o_totalprice").alias("salary_min"),
        F.col("o_orderpriority").startswith("1").alias("salary_is_predicted"),
        F.col("o_orderdate").cast("timestamp").alias("posted_date"),
        (k * 37 % 101).cast("int").alias("base_score"),
    )


def sql_text(v: str | None) -> str:
    return "NULL" if v is None else "'" + v.replace("'", "''") + "'"


def listings_sql() -> str:
    """The same table as a SELECT for DuckDB."""
    pick = lambda values, prime: f"[{', '.join(map(sql_text, values))}][(o_orderkey * {prime}) % {len(values)} + 1]"
    columns = ",\n ".join(f"{pick(v, p)} AS {c}" for c, (v, p) in LISTS.items())
    return f"""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'board_a' ELSE 'board_b' END AS source, o_orderkey::VARCHAR AS source_id,
 'http://www.Example.com/job/' || (o_orderkey % 9000) || '/?utm_source=x&b=2&a=1#top' AS url,
 {columns},
 c_name AS company,
 CASE WHEN o_orderkey % 2 = 0 THEN -37.8136::DOUBLE + (o_orderkey % 97 - 48) * 0.01::DOUBLE END AS latitude,
 CASE WHEN o_orderkey % 2 = 0 THEN 144.9631::DOUBLE + (o_orderkey % 97 - 48) * 0.01::DOUBLE END AS longitude,
 o_totalprice AS salary_min, starts_with(o_orderpriority, '1') AS salary_is_predicted, o_orderdate AS posted_date, (o_orderkey * 37 % 101)::INT AS base_score
 FROM orders JOIN customer ON o_custkey = c_custkey"""
