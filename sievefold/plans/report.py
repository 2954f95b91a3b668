"""Reports over judged listings and matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..criteria import AXES
from ..operators.budget import BUCKETS, score_bucket
from ..operators.prefilter import reason_key

STATUSES = ("new", "notified", "saved", "applied", "dismissed")


def domain(spark: SparkSession, column: str, values: tuple[str, ...]) -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], f"{column} string")


def zero_filled(counted: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    """(column, n) for every value of a fixed domain, 0 where nothing was counted."""
    return domain(counted.sparkSession, column, values).join(counted, column, "left").select(column, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def count_by(df: DataFrame, column: str, key: Column) -> DataFrame:
    return df.groupBy(key.alias(column)).agg(F.count(F.lit(1)).alias("n"))


def status_counts(matches: DataFrame) -> DataFrame:
    return zero_filled(count_by(matches, "status", F.col("status")), "status", STATUSES)


def score_histogram(matches: DataFrame, score: str = "fit_score") -> DataFrame:
    return zero_filled(count_by(matches, "bucket", score_bucket(F.col(score))), "bucket", BUCKETS)


def notifiable_buckets(histogram: DataFrame) -> DataFrame:
    """Matches in the two upper buckets, whatever the threshold is."""
    return histogram.where(F.col("bucket").isin("80-100", "70-79")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("notifiable"))


def axis_distribution(passed: DataFrame) -> DataFrame:
    return passed.select(*AXES).unpivot([], list(AXES), "axis", "value").groupBy("axis", "value").agg(F.count(F.lit(1)).alias("n"))


def rejection_breakdown(judged: DataFrame, sample: int | None = None, order: list | None = None) -> DataFrame:
    """(reason, n) of rejected listings; all of them, or the newest ``sample``."""
    rejected = judged.where("status = 'rejected'")
    if sample is not None:
        rejected = rejected.orderBy(*order).limit(sample)
    return rejected.select(F.explode_outer("reasons").alias("r")).where("r IS NOT NULL").groupBy(reason_key(F.col("r")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def rejected_total(judged: DataFrame) -> DataFrame:
    return judged.agg(F.count_if(F.col("status") == "rejected").alias("total"))


def top_by_multiplier(judged: DataFrame, n: int) -> DataFrame:
    """The n passed listings with the highest multiplier."""
    return judged.where("status = 'passed'").orderBy(F.desc("preference_multiplier"), "id").limit(n)


def newest(listings: DataFrame, n: int) -> DataFrame:
    """The n latest postings; those without a date come last."""
    return listings.orderBy(F.desc_nulls_last("posted_date"), "id").limit(n)


def preference_summary(preferences: DataFrame) -> DataFrame:
    """(dimension, value, weight) of the preferences that weigh anything but 1."""
    return preferences.where("is_active AND weight <> 1").select("dimension", "value", "weight")


def loose_acronyms(keywords: DataFrame) -> DataFrame:
    """Active initialisms that would match any case, so that IT would match "it"."""
    return keywords.where(F.col("is_active") & F.col("term").rlike("^[A-Z0-9]{2,6}$") & ~F.col("case_sensitive"))


def keyword_counts(keywords: DataFrame) -> DataFrame:
    return count_by(keywords.where("is_active"), "kind", F.col("kind"))


def health(checks: list[tuple[str, DataFrame, int]]) -> DataFrame:
    """(name, rows, ok) of tables that must hold a least number of rows."""
    out = None
    for name, df, least in checks:
        row = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows", (F.col("rows") >= least).alias("ok"))
        out = row if out is None else out.unionByName(row)
    return out


def ago(then: Column, now: Column) -> Column:
    """Relative time: just now, minutes, hours or days."""
    minutes = F.floor((F.unix_micros(now) - F.unix_micros(then)) / 60_000_000)
    text = lambda n, unit: F.concat(n.cast("string"), F.lit(unit))
    return F.when(then.isNull(), "never").when(minutes < 1, "just now").when(minutes < 60, text(minutes, "m ago")).when(minutes < 1440, text(F.floor(minutes / 60), "h ago")).otherwise(text(F.floor(minutes / 1440), "d ago"))


def bar(n: Column, total: Column, width: int = 28) -> Column:
    """Text bar of a share."""
    filled = F.when(total > 0, F.floor(n * width / total + 0.5)).otherwise(F.lit(0)).cast("int")
    return F.concat(F.repeat(F.lit("█"), filled), F.repeat(F.lit("░"), F.lit(width) - filled))


def assembled(listings: DataFrame, matches: DataFrame) -> DataFrame:
    """The report as rows (section, name, n, bar): listings by status, the passed ones by each
    axis and by what they state, scores of canonical listings, and why others were rejected.
    A bar is a line's share of its section."""
    passed = listings.where("status = 'passed'")
    scored = matches.join(listings.where("duplicate_of IS NULL").select(F.col("id").alias("listing_id")), "listing_id")
    real_pay = (F.col("salary_min") > 0) & ~F.col("salary_is_predicted")
    stated = passed.agg(F.count("duration_weeks").alias("duration"), F.count_if(real_pay).alias("salary")).unpivot([], ["duration", "salary"], "name", "n")
    line = lambda df, section, name: df.select((section if isinstance(section, Column) else F.lit(section)).alias("section"), F.col(name).alias("name"), "n")
    rows = (
        line(count_by(listings, "name", F.col("status")), "listings", "name")
        .union(line(axis_distribution(passed), F.concat(F.lit("axis "), F.col("axis")), "value"))
        .union(line(stated, "stated", "name"))
        .union(line(score_histogram(scored), "score", "bucket"))
        .union(line(rejection_breakdown(listings), "rejected for", "reason"))
    )
    # a few lines per section from here on
    total = F.sum("n").over(Window.partitionBy("section"))
    return rows.withColumn("bar", F.when(F.col("section") != "stated", bar(F.col("n"), total)))
