"""Keyword searches against a board's interface, within a budget of calls.

The transport is foreign: anything that answers (term, page) with a status and a body.
Its answers are a few small pages a cycle, so the loop runs on the driver; what it
gathers becomes a DataFrame of payload texts, read like those of files.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..criteria import Criteria, keyword_rows
from ..schemas import BOARD_A, BOARD_B
from .boards import board_a, board_b, keyword_plan, parse_payload

PER_PAGE = 50
PAUSE_SECONDS = 1.2
RATE_LIMITED = 429
# What a bot challenge's page says.
CHALLENGE = ("Just a moment", "cf_chl_opt", "challenge-platform")


class Transport(Protocol):
    def __call__(self, term: str, page: int) -> tuple[int, str]: ...


@dataclass
class Gathered:
    """Payloads by term, the calls made, and why the cycle ended: done, budget or limited."""

    payloads: list[tuple[str, str]] = field(default_factory=list)
    calls: int = 0
    ended: str = "done"
    unasked: int = 0


def answer_rows(status: int, body: str, rows: str) -> list | None:
    """The rows of an answer, None if it has another shape; errors of the board raise."""
    if status >= 400:
        what = "bot challenge" if any(mark in body for mark in CHALLENGE) else body[:300]
        raise RuntimeError(f"{status}: {what}")
    try:
        found = json.loads(body).get(rows, [])
    except (ValueError, AttributeError):
        return None
    return found if isinstance(found, list) else None


def gather(transport: Transport, terms: list[str], rows: str, max_calls: int, pages: int = 1, sleep: Callable[[float], None] = time.sleep) -> Gathered:
    """Asks for each term in turn, page after page until one is short.

    Ends without error when the calls are used up or the board limits the rate; terms come
    by falling weight, so what was not asked is what matters least.  A payload of another
    shape is passed over."""
    out = Gathered()
    for at, term in enumerate(terms):
        for page in range(1, pages + 1):
            if out.calls >= max_calls:
                out.ended, out.unasked = "budget", len(terms) - at
                return out
            status, body = transport(term, page)
            out.calls += 1
            if status == RATE_LIMITED:
                out.ended = "limited"
                return out
            found = answer_rows(status, body, rows)
            if found is None:
                continue
            out.payloads.append((term, body))
            if len(found) < PER_PAGE:
                break
            sleep(PAUSE_SECONDS)
    return out


class SearchSource:
    """A board that is asked for every include term of the criteria."""

    def __init__(self, name: str, transport: Transport, pages: int = 1, sleep: Callable[[float], None] = time.sleep):
        self.name, self.transport, self.pages, self.sleep = name, transport, pages, sleep
        self.last = Gathered()

    def fetch(self, spark: SparkSession, criteria: Criteria, max_calls: int) -> DataFrame:
        rows, schema, normalise = ("results", BOARD_A, board_a) if self.name == "board_a" else ("jobs", BOARD_B, board_b)
        terms = [r.term for r in keyword_plan(keyword_rows(spark, criteria)).collect()]
        self.last = gather(self.transport, terms, rows, max_calls, self.pages, self.sleep)
        payloads = spark.createDataFrame(self.last.payloads, "term string, body string")
        return normalise(parse_payload(payloads, "body", schema), F.col("term"))
