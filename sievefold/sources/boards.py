"""Provider payloads to normalised listings."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..criteria import Criteria
from ..functions.text import decode_entities, js_trim, map_commitment, map_contract_time, parse_salary_floor, safe_date, strip_html, to_bool
from ..schemas import BOARD_A, BOARD_B


class Source(Protocol):
    """Where listings come from: anything that gives a DataFrame of normalised rows."""

    name: str

    def fetch(self, spark: SparkSession, criteria: Criteria, max_calls: int) -> DataFrame: ...


def _null() -> Column:
    return F.lit(None).cast("string")


def _usable(df: DataFrame) -> DataFrame:
    return df.where("url IS NOT NULL AND url <> '' AND title IS NOT NULL AND title <> ''")


def read_payload(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole-file JSON; fields that are missing are null, and broken files empty rows."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path, multiLine=True)


def parse_payload(df: DataFrame, column: str, schema: str) -> DataFrame:
    """Payload texts of a column, parsed beside the other columns; broken ones are empty."""
    return df.withColumn("_p", F.from_json(column, schema)).select("*", "_p.*").drop("_p", column)


def _term(term: str | Column | None) -> Column:
    return (term if isinstance(term, Column) else F.lit(term)).cast("string").alias("provider_matched_term")


def board_a(payload: DataFrame, term: str | Column | None = None) -> DataFrame:
    """Normalised listings of payloads; ``term`` is what was asked for, a column if it differs."""
    j = F.col("j")
    rows = payload.withColumn("j", F.explode("results"))
    return _usable(
        rows.select(
            F.lit("board_a").alias("source"), j["id"].alias("source_id"), j["redirect_url"].alias("url"), decode_entities(j["title"]).alias("title"),
            j["company"]["display_name"].alias("company"), F.when(j["description"] != "", decode_entities(j["description"])).alias("description"),
            F.coalesce(j["location"]["display_name"], F.try_element_at(j["location"]["area"], F.lit(-1))).alias("location_raw"),
            j["latitude"].alias("latitude"), j["longitude"].alias("longitude"), j["salary_min"].alias("salary_min"), j["salary_max"].alias("salary_max"),
            to_bool(j["salary_is_predicted"]).alias("salary_is_predicted"), safe_date(j["created"]).alias("posted_date"), _term(term),
            map_contract_time(j["contract_time"]).alias("hint_commitment"), _null().alias("hint_work_mode"), _null().alias("hint_role_type"), F.to_json(j).alias("raw_json"),
        )
    )


def board_b(payload: DataFrame, term: str | Column | None = None) -> DataFrame:
    """Normalised listings of payloads, as in ``board_a``."""
    j = F.col("j")
    rows = payload.withColumn("j", F.explode("jobs"))
    nothing = F.lit(None).cast("double")
    return _usable(
        rows.select(
            F.lit("board_b").alias("source"), j["id"].alias("source_id"), j["link"].alias("url"), strip_html(j["title"]).alias("title"),
            F.nullif(js_trim(j["company"]), F.lit("")).alias("company"), F.when(j["snippet"] != "", strip_html(j["snippet"])).alias("description"),
            j["location"].alias("location_raw"), nothing.alias("latitude"), nothing.alias("longitude"), parse_salary_floor(j["salary"]).alias("salary_min"), nothing.alias("salary_max"),
            F.lit(False).alias("salary_is_predicted"), safe_date(j["updated"]).alias("posted_date"), _term(term),
            map_commitment(j["type"]).alias("hint_commitment"), _null().alias("hint_work_mode"), _null().alias("hint_role_type"), F.to_json(j).alias("raw_json"),
        )
    )


def union_all(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


class FileSource:
    """A board's payloads from files: same schema and normaliser as live, no calls."""

    def __init__(self, name: str, path: str):
        self.name, self.path = name, path

    def fetch(self, spark: SparkSession, criteria: Criteria, max_calls: int = 0) -> DataFrame:
        schema, normalise = (BOARD_A, board_a) if self.name == "board_a" else (BOARD_B, board_b)
        return normalise(read_payload(spark, self.path, schema))


def asked_terms(keywords: DataFrame) -> DataFrame:
    return keywords.where("is_active AND kind = 'include'")


def keyword_plan(keywords: DataFrame, limit: int | None = None) -> DataFrame:
    """Include terms in the order in which they are asked for: weight, then as listed."""
    plan = asked_terms(keywords).orderBy(F.desc("weight"), "ordinal")
    return plan if limit is None else plan.limit(limit)
