"""One poll of all sources: who is due is asked, what comes back is ingested, and every
outcome is recorded.  A failing source is recorded and the others go on."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..criteria import Criteria, keyword_rows
from ..functions.urls import dedupe_hash
from ..operators.budget import record_poll, source_due
from ..operators.dedupe import first_wins
from ..operators.settings import load_sources
from ..operators.store import store
from ..sources.board_source import BoardSource, answers_of, calls_made
from ..sources.boards import keyword_plan

OUTCOME = "name string, calls int, ok boolean, error string"


@dataclass
class Board:
    """Options of a board's data source, and the shape of its answers (board_a or board_b).
    ``configured`` is false while its credentials are missing."""

    shape: str
    options: dict[str, str]
    configured: bool = True


@dataclass
class Poll:
    """Listings of a poll (None without any), the sources after it, and what became of each:
    polled, failed, or why it wasn't asked."""

    listings: DataFrame | None
    sources: DataFrame
    said: dict[str, str] = field(default_factory=dict)


def remaining_calls(now: Column) -> Column:
    """What the day's quota still allows; past its reset the day starts anew."""
    today = F.when(now >= F.col("quota_reset_at"), F.lit(0)).otherwise(F.col("calls_today"))
    return F.greatest(F.lit(0), F.col("max_calls_per_day") - today)


def ask(spark: SparkSession, board: Board, criteria: Criteria, max_calls: int) -> DataFrame:
    """The calls of one poll of a board, stored: they are made once."""
    spark.dataSource.register(BoardSource)
    terms = [r.term for r in keyword_plan(keyword_rows(spark, criteria)).collect()]
    options = board.options | {"terms": json.dumps(terms), "max_calls": str(max_calls)}
    return store(spark.read.format("board").options(**options).load())


def first_found(found: list[DataFrame], terms: DataFrame) -> DataFrame:
    """The listings of a poll, of each URL the one that the weightiest term found; ids are made
    of the URL, so that a listing keeps its own over polls."""
    all_ = reduce(DataFrame.unionByName, found).withColumn("_hash", dedupe_hash("url"))
    place = F.broadcast(terms.select(F.col("term").alias("provider_matched_term"), F.col("ordinal").alias("_at"), F.col("weight").alias("_weight")))
    first = first_wins(all_.join(place, "provider_matched_term", "left"), ["_hash"], [F.desc_nulls_last("_weight"), "_at", "source", "raw_json"])
    return first.withColumn("id", F.xxhash64("_hash")).drop("_hash", "_at", "_weight")


def poll(spark: SparkSession, sources: DataFrame, boards: dict[str, Board], criteria: Criteria, now: str, stopped: Callable[[], bool] = lambda: False, force: bool = False) -> Poll:
    """Asks every source that is due, in order of their names, within its day's quota.

    The sources are a handful, so the loop is the driver's; each one's calls are tasks.  The
    calls that a failed source did make count against its quota.  ``force`` asks those that
    aren't due too."""
    at = F.lit(now).cast("timestamp")
    said, outcomes, found = {}, [], []
    for s in load_sources(sources.withColumns({"_due": source_due(at), "_left": remaining_calls(at)})):
        if stopped():
            break
        board = boards.get(s.name)
        if board is None or not board.configured:
            said[s.name] = "no adapter" if board is None else "credentials missing"
            continue
        if s._due != "due" and not force:
            said[s.name] = s._due
            continue
        made = 0
        try:
            calls = ask(spark, board, criteria, s._left)
            told = calls_made(calls).first()
            made = told.calls
            if told.error is not None:
                raise RuntimeError(told.error)
            found.append(answers_of(calls, board.shape).withColumn("source", F.lit(s.name)))
            outcomes.append((s.name, made, True, None))
            said[s.name] = "polled, rate limited" if told.limited else "polled"
        except Exception as e:  # noqa: BLE001 - a source is foreign code
            error = str(e) or type(e).__name__
            outcomes.append((s.name, made, False, error))
            said[s.name] = f"failed: {error}"
    after = record_poll(sources, spark.createDataFrame(outcomes, OUTCOME), at) if outcomes else sources
    terms = keyword_rows(spark, criteria).where("kind = 'include'").dropDuplicates(["term"])
    return Poll(first_found(found, terms) if found else None, after, said)


__all__ = ["Board", "Poll", "ask", "poll", "remaining_calls"]
