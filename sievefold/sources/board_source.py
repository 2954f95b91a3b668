"""Boards as a Spark data source, for batches and streams of searches.

``spark.dataSource.register(BoardSource)``, then format ``board``.  A row is a call: the
term and page that were asked, and what came back.  Options:

    transport   module:function that gives a ``Transport`` for the options
    terms       JSON list of terms, the most important first
    rows        the list of an answer that holds its listings (results)
    pages       pages asked of a term at most (1)
    max_calls   calls that a batch, or a stream's day, may make
    per_batch   calls of a micro-batch at most (max_calls)
    every       seconds from one round over the terms to the next (3600)
    pause       seconds between two calls of a task (1.2)
    clock       module:function that gives the time in seconds, for tests

Each term is a partition: tasks ask different terms at the same time, one page after the
other until one is short.  The budget is held by the plan, not by the tasks: calls are
allotted to terms in order before they are made, so it is never exceeded; what a short page
saves isn't given to other terms.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from ..schemas import BOARD_A, BOARD_B
from .boards import board_a, board_b, parse_payload
from .search import PAUSE_SECONDS, PER_PAGE, RATE_LIMITED, Transport, answer_rows

CALL = "term string, position int, page int, status int, body string, error string"


@dataclass
class Asked(InputPartition):
    """Pages of one term."""

    position: int
    first: int
    last: int

    def __post_init__(self) -> None:
        super().__init__(self.position)


def _named(path: str) -> Callable:
    module, _, name = path.partition(":")
    return getattr(importlib.import_module(module), name)


class _Plan:
    """A round's calls in order: every page of the first term, then of the second."""

    def __init__(self, options: dict[str, str]):
        self.options = dict(options)
        self.terms: list[str] = json.loads(options.get("terms", "[]"))
        self.pages = int(options.get("pages", 1))
        self.max_calls = int(options.get("max_calls", 0))
        self.pause = float(options.get("pause", PAUSE_SECONDS))
        self.rows = options.get("rows", "results")

    @property
    def size(self) -> int:
        return len(self.terms) * self.pages

    def partitions(self, start: int, end: int) -> list[Asked]:
        """The calls from ``start`` up to ``end``, by term."""
        out = []
        for position in range(start // self.pages, -(-end // self.pages)):
            first, last = max(start, position * self.pages), min(end, (position + 1) * self.pages)
            out.append(Asked(position, first % self.pages + 1, (last - 1) % self.pages + 1))
        return out

    def ask(self, part: Asked) -> Iterator[tuple]:
        """Ends with a short page, the rate limit, or an error of the board."""
        transport: Transport = _named(self.options["transport"])(self.options)
        term = self.terms[part.position]
        for page in range(part.first, part.last + 1):
            if page > part.first:
                time.sleep(self.pause)
            try:
                status, body = transport(term, page)
            except Exception as e:  # noqa: BLE001 - the transport is foreign code
                yield term, part.position, page, None, None, str(e) or type(e).__name__
                return
            if status == RATE_LIMITED:
                yield term, part.position, page, status, None, None
                return
            try:
                found = answer_rows(status, body, self.rows)
            except RuntimeError as e:
                yield term, part.position, page, status, None, str(e)
                return
            yield term, part.position, page, status, body if found is not None else None, None
            if found is not None and len(found) < PER_PAGE:
                return


class BoardReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.plan = _Plan(options)

    def partitions(self) -> Sequence[InputPartition]:
        return self.plan.partitions(0, min(self.plan.size, self.plan.max_calls)) or [Asked(-1, 1, 0)]

    def read(self, partition: Asked) -> Iterator[tuple]:
        return self.plan.ask(partition) if partition.position >= 0 else iter(())


class BoardStreamReader(DataSourceStreamReader):
    """Offsets say which round it is, how many of its calls are allotted, and how many were
    on the day.  They are in the stream's checkpoint before the calls are made, so a
    restart asks for a micro-batch again only if it didn't end, and its calls were counted
    then.  A round goes on the next day where the budget ended it."""

    def __init__(self, options: dict[str, str]):
        self.plan = _Plan(options)
        self.per_batch = int(options.get("per_batch", max(1, self.plan.max_calls)))
        self.every = float(options.get("every", 3600))
        self.clock: Callable[[], float] = _named(options["clock"]) if "clock" in options else time.time
        self.at: dict | None = None

    def _day(self) -> str:
        return datetime.fromtimestamp(self.clock(), UTC).date().isoformat()

    def initialOffset(self) -> dict:
        return {"round": 0, "asked": 0, "began": 0, "day": self._day(), "calls": 0}

    def latestOffset(self) -> dict:
        at = dict(self.at or self.initialOffset())
        now, day = self.clock(), self._day()
        spent = at["calls"] if at["day"] == day else 0
        if at["asked"] >= self.plan.size or at["round"] == 0:
            if at["round"] and now - at["began"] < self.every:
                return at
            at |= {"round": at["round"] + 1, "asked": 0, "began": int(now)}
        more = min(self.plan.max_calls - spent, self.per_batch, self.plan.size - at["asked"])
        if more <= 0:
            return dict(self.at or self.initialOffset())
        self.at = at | {"asked": at["asked"] + more, "day": day, "calls": spent + more}
        return dict(self.at)

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        self.at = dict(end)  # also how a restarted stream learns where it was
        return self.plan.partitions(start["asked"] if start["round"] == end["round"] else 0, end["asked"])

    def read(self, partition: Asked) -> Iterator[tuple]:
        return self.plan.ask(partition)

    def commit(self, end: dict) -> None:
        pass


class BoardSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "board"

    def schema(self) -> str:
        return CALL

    def reader(self, schema: StructType) -> BoardReader:
        return BoardReader(self.options)

    def streamReader(self, schema: StructType) -> BoardStreamReader:
        return BoardStreamReader(self.options)


def answers_of(calls: DataFrame, board: str) -> DataFrame:
    """The listings in a board's answers, as ``sources.boards`` normalises them."""
    schema, normalise = (BOARD_A, board_a) if board == "board_a" else (BOARD_B, board_b)
    told = calls.where(F.col("body").isNotNull()).select("term", "body")
    return normalise(parse_payload(told, "body", schema), F.col("term"))


def calls_made(calls: DataFrame) -> DataFrame:
    """One row: how many calls were made, whether the board limited the rate, and an error if
    it or the transport failed."""
    return calls.agg(F.count(F.lit(1)).alias("calls"), F.coalesce(F.bool_or(F.col("status") == RATE_LIMITED), F.lit(False)).alias("limited"), F.min_by("error", "position").alias("error"))


def from_files(options: dict[str, str]) -> Transport:
    """A stand-in for a board: the answers under ``answers`` in the options, one file a term and
    page on this machine.  A missing one is an empty answer, and ``term-page.status`` gives
    another status.  Every call leaves a file under ``log``, if it is given."""

    def ask(term: str, page: int) -> tuple[int, str]:
        root, name = Path(options["answers"]), f"{term}-{page}"
        if "log" in options:
            (Path(options["log"]) / f"{name}.{time.time_ns()}").touch()
        status, body = root / f"{name}.status", root / f"{name}.json"
        return int(status.read_text()) if status.exists() else 200, body.read_text() if body.exists() else "{}"

    return ask
