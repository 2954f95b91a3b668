"""Decisions on matches as a stream, and events that are told more than once.

What is pressed under a message arrives as updates (update_id, at, callback): numbered in
order, but told again after a lost confirmation, and not always in order.  Each match keeps
the smallest update of every status, so neither repetition nor order matters: an update is
*accepted* if no update before it, in the order of their numbers, gave a status from which
its own can't be reached (``budget.TRANSITIONS``).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.render import decode_callback
from ..operators.budget import TRANSITIONS

UPDATE = "update_id long, at timestamp, callback string"
#: Statuses that a decision can give, and a match's history: what was accepted, in order.
DECIDED = tuple(s for s in TRANSITIONS if s != "new")
HISTORY = "match_id string, match_status string, decided_by long, accepted array<string>"


def decoded(updates: DataFrame) -> DataFrame:
    """(update_id, at, match_id, status) of the updates whose callback means something."""
    d = decode_callback(F.col("callback"))
    return updates.select("update_id", "at", d["match_id"].alias("match_id"), d["decision"].alias("status")).where("match_id IS NOT NULL")


def _blockers(status: str) -> list[str]:
    """Statuses after which ``status`` can't come any more."""
    return [s for s in DECIDED if s != status and status not in TRANSITIONS[s]]


def accepted_from(first: dict[str, int | None]) -> list[tuple[int, str]]:
    """The accepted updates of a match, in order, from the smallest one of each status."""
    known = {s: u for s, u in first.items() if u is not None}
    return sorted((u, s) for s, u in known.items() if not any(known.get(b, u) < u for b in _blockers(s)))


def histories(decisions: DataFrame) -> DataFrame:
    """HISTORY of a table of decisions (match_id, update_id, status): a minimum per match and
    status, merged before the shuffle, so no match's decisions meet anywhere."""
    first = decisions.groupBy("match_id").agg(*(F.min(F.when(F.col("status") == s, F.col("update_id"))).alias(s) for s in DECIDED))

    def kept(s: str) -> Column:
        blocked = reduce(lambda a, b: a | F.coalesce(F.col(b) < F.col(s), F.lit(False)), _blockers(s), F.lit(False))
        return F.when(F.col(s).isNotNull() & ~blocked, F.struct(F.col(s).alias("u"), F.lit(s).alias("s")))

    told = first.withColumn("a", F.array_sort(F.array_compact(F.array(*map(kept, DECIDED))))).where(F.size("a") > 0)
    return told.select("match_id", F.element_at("a", -1)["s"].alias("match_status"), F.element_at("a", -1)["u"].alias("decided_by"), F.col("a.s").alias("accepted"))


class Decisions(StatefulProcessor):
    """State: the smallest update of each status, a few numbers per match that was decided on."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", ", ".join(f"{s} long" for s in DECIDED))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.first.get() if self.first.exists() else (None,) * len(DECIDED)
        first = {s: None if u is None or u != u else int(u) for s, u in zip(DECIDED, held, strict=True)}
        before = dict(first)
        for part in rows:
            for u, s in zip(part["update_id"].tolist(), part["status"].tolist(), strict=True):
                if s in first and (first[s] is None or u < first[s]):
                    first[s] = u
        if first == before:
            return  # told before
        self.first.update(tuple(first[s] for s in DECIDED))
        found = accepted_from(first)
        yield pd.DataFrame([(key[0], found[-1][1], found[-1][0], [s for _, s in found])], columns=["match_id", "match_status", "decided_by", "accepted"])

    def close(self) -> None:
        pass


def history_stream(decisions: DataFrame) -> DataFrame:
    """The stream of histories (HISTORY) of matches that new updates change.  Needs the
    RocksDB state store."""
    return decisions.groupBy("match_id").transformWithStateInPandas(statefulProcessor=Decisions(), outputStructType=HISTORY, outputMode="Update", timeMode="None")


def decide(matches: DataFrame, changed: DataFrame) -> DataFrame:
    """(listing_id, match_status, updated_at) of the matches that histories move on, to be merged.
    A status that can't be reached from the stored one is left: the dashboard had the last word."""
    moves = [(a, b) for a, after in TRANSITIONS.items() for b in after]
    x = matches.select(F.col("match_id").cast("string").alias("match_id"), "listing_id", F.col("match_status").alias("_was")).join(changed, "match_id")
    legal = reduce(lambda a, b: a | b, ((F.col("_was") == a) & (F.col("match_status") == b) for a, b in moves))
    return x.where(legal).select("listing_id", "match_status")


def told_once(events: DataFrame, key: list[str], at: str, late: str = "1 hour") -> DataFrame:
    """A stream without repetitions: of the rows of a key within ``late`` of event time one
    stays, and rows later than that behind the newest are dropped.

    State is one entry per key whose event time is within ``late`` of the newest row's, twice
    that at most before it is cleared; it doesn't grow with the stream's age."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(key)
