"""The external batch scorer: a protocol, its distributed application, and a stand-in."""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.budget import ACCOUNT_LEVEL, BATCH, LEAKED, Desc, in_batches, leaked_json
from ..operators.merge import upsert
from ..operators.prefilter import fit_score
from ..operators.store import store
from .matches import score_payload

SCORES = "batch long, ref int, base_score int, reasoning string, category string"


class Scorer(Protocol):
    """Scores one batch of payloads (JSON texts by ref); returns (ref, score, reasoning, category)."""

    def __call__(self, batch: int, payloads: list[tuple[int, str]]) -> list[tuple[int, int, str, str]]: ...


POINTS = {"cyber": 30, "security": 20, "intern": 15, "support": 10, "data entry": 5}


def rule_scorer(batch: int, payloads: list[tuple[int, str]]) -> list[tuple[int, int, str, str]]:
    """Deterministic stand-in: points for terms of the field."""
    out = []
    for ref, text in payloads:
        low = text.lower()
        out.append((ref, min(100, 20 + sum(p for t, p in POINTS.items() if t in low)), "Rule based. Counts the field's terms.", "rules"))
    return out


class ScorerError(RuntimeError):
    """What a scorer may raise: the status of its service, and what the call cost."""

    def __init__(self, message: str, status: int | None = None, usd: float = 0.0):
        super().__init__(message)
        self.status, self.usd = status, usd


class IncompleteBatch(ScorerError):
    """Scores are missing, or one entry's reasoning ran on into the next entries."""


def checked(got: list[tuple[int, int, str, str]], sent: int) -> list[tuple[int, int, str, str]]:
    if len(got) != sent:
        raise IncompleteBatch(f"expected {sent} scores, got {len(got)}")
    leaks = [r[0] for r in got if re.search(LEAKED, r[2] or "")]
    if leaks:
        raise IncompleteBatch(f"the reasoning of ref {leaks[0]} holds other entries")
    return got


def pause(error: Exception, attempt: int) -> float | None:
    """Seconds to wait before trying again, None if no retry mends the error: refused
    requests and account errors are final, rate limits and lost connections wait longer
    each time, and so do failing services."""
    status = getattr(error, "status", None)
    if isinstance(error, IncompleteBatch):
        return 0.5
    if re.search(ACCOUNT_LEVEL, str(error)):
        return None
    if status == 429 or isinstance(error, ConnectionError | TimeoutError):
        return 2.0 * 2 ** (attempt - 1)
    if status is None or status >= 500:
        return 2.0 * attempt
    return None


def with_retry(scorer: Scorer, attempts: int = 4, sleep: Callable[[float], None] = time.sleep) -> Scorer:
    """Tries a batch again after passing errors and incomplete results."""

    def call(batch: int, payloads: list[tuple[int, str]]) -> list[tuple[int, int, str, str]]:
        for attempt in range(1, attempts + 1):
            try:
                return checked(scorer(batch, payloads), len(payloads))
            except Exception as e:  # noqa: BLE001 - the scorer is foreign code
                wait = pause(e, attempt)
                if wait is None or attempt == attempts:
                    raise
            sleep(wait)
        raise AssertionError("unreachable")

    return call


def score(batched: DataFrame, scorer: Scorer) -> DataFrame:
    """Scores of listings with (batch, ref), one scorer call per batch, joined back by
    (batch, ref); results whose reasoning holds leaked output are left out."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ref")
        got = scorer(int(key[0]), list(zip(pdf["ref"].tolist(), pdf["payload"].tolist(), strict=True)))
        return pd.DataFrame([(key[0], *r) for r in got], columns=["batch", "ref", "base_score", "reasoning", "category"])

    scores = batched.select("batch", "ref", score_payload(batched).alias("payload")).groupBy("batch").applyInPandas(run, SCORES)
    out = batched.drop("base_score").join(scores.where(~leaked_json(F.col("reasoning"))), ["batch", "ref"])
    return out.withColumn("fit_score", fit_score(F.col("base_score"), F.col("preference_multiplier")))


#: What a re-score leaves as it is: the match's id and the decision.
KEPT = ("match_id", "match_status", "created_at")


def upsert_matches(matches: DataFrame, scored: DataFrame) -> DataFrame:
    """The next matches: scored listings get new scores, and a first match is new."""
    return upsert(matches, scored.withColumn("match_status", F.lit("new")), "listing_id", keep=KEPT)


def run_costs(scored: DataFrame, cost: Column) -> DataFrame:
    """(batch, n_scored, cost) of a run; its sum is what ``settings.record_spend`` adds."""
    return scored.groupBy("batch").agg(F.count(F.lit(1)).alias("n_scored"), F.sum(cost).alias("cost"))


class PricedScorer(Protocol):
    """A scorer that also tells what the batch cost, retries included."""

    def __call__(self, batch: int, payloads: list[tuple[int, str]]) -> tuple[list[tuple[int, int, str, str]], float]: ...


def priced(scorer: Scorer, usd: Callable[[int], float]) -> PricedScorer:
    """A scorer whose batches cost what ``usd`` says of their number of rows."""
    return lambda batch, payloads: (scorer(batch, payloads), usd(len(payloads)))


def with_priced_retry(scorer: PricedScorer, attempts: int = 4, sleep: Callable[[float], None] = time.sleep) -> PricedScorer:
    """As ``with_retry``, for a scorer that tells its costs: what failed attempts cost is part
    of the batch's cost, or of the error's ``usd`` if none succeeds."""

    def call(batch: int, payloads: list[tuple[int, str]]) -> tuple[list[tuple[int, int, str, str]], float]:
        spent = 0.0
        for attempt in range(1, attempts + 1):
            try:
                got, usd = scorer(batch, payloads)
                spent += usd
                return checked(got, len(payloads)), spent
            except Exception as e:  # noqa: BLE001 - the scorer is foreign code
                spent += float(getattr(e, "usd", 0.0))
                wait = pause(e, attempt)
                if wait is None or attempt == attempts:
                    e.usd = spent
                    raise
            sleep(wait)
        raise AssertionError("unreachable")

    return call


@dataclass
class Run:
    """What a scoring run did.  ``scored`` holds the scored listings with their batch and
    ref; ``ended`` is done, budget, account or stopped."""

    scored: DataFrame
    queued: int
    batches: int
    failed: int
    usd: float
    ended: str


ANSWERS = SCORES + ", usd double, error string"


def _answers(batched: DataFrame, scorer: PricedScorer) -> DataFrame:
    """Scores of each batch, and a row with ref 0 for its cost or error."""

    def ask(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, batch = pdf.sort_values("ref"), int(key[0])
        refs, got, usd, error = set(pdf["ref"].tolist()), [], 0.0, None
        try:
            got, usd = scorer(batch, list(zip(pdf["ref"].tolist(), pdf["payload"].tolist(), strict=True)))
        except Exception as e:  # noqa: BLE001 - one batch's failure is no failure of the run
            usd, error = float(getattr(e, "usd", 0.0)), str(e) or type(e).__name__
        known = {r[0]: r for r in reversed(got) if r[0] in refs}  # a ref made up or repeated scores nothing
        rows = [(batch, *r, None, None) for r in known.values()] + [(batch, 0, None, None, None, usd, error)]
        return pd.DataFrame(rows, columns=["batch", "ref", "base_score", "reasoning", "category", "usd", "error"]).astype({"base_score": "Int32"})

    return batched.select("batch", "ref", score_payload(batched).alias("payload")).groupBy("batch").applyInPandas(ask, ANSWERS)


def run(queue: DataFrame, scorer: PricedScorer, budget: float, dearest: float, size: int = BATCH, stopped: Callable[[], bool] = lambda: False) -> Run:
    """Scores a queue in batches by falling multiplier until the budget is spent.

    Costs are known only after a batch, so batches run in waves of as many as the rest of
    the budget pays at the price of the ``dearest`` possible batch: they run side by side,
    and the budget is exceeded by one batch at most.  A failed batch is counted and its
    listings stay in the queue; an account error ends the run after its wave, and
    ``stopped`` is asked before each.  Answers are stored wave by wave, so that a lost
    executor doesn't pay for a batch again once its wave is stored."""
    if budget < 0 or dearest <= 0:
        raise ValueError("a budget is not negative, and the dearest batch costs something")
    order = [Desc(F.col("preference_multiplier")), F.floor(F.col("id") / 100_000)]
    batched = store(in_batches(queue.drop("base_score", "fit_score", "reasoning", "category"), order, [F.desc("preference_multiplier"), F.col("id")], size))
    queued, batches = batched.agg(F.count(F.lit(1)), F.coalesce(F.max("batch") + 1, F.lit(0))).first()
    usd, done, failed, ended, waves = 0.0, 0, 0, "done", []
    while done < batches:
        if stopped():
            ended = "stopped"
        elif usd >= budget:
            ended = "budget"
        if ended != "done":
            break
        n = min(batches - done, max(1, int(min((budget - usd) / dearest, batches))))
        wave = store(_answers(batched.where(F.col("batch").between(done, done + n - 1)), scorer))
        told = wave.where("ref = 0").agg(F.sum("usd"), F.count("error"), F.count_if(F.col("error").rlike(ACCOUNT_LEVEL))).first()
        waves.append(wave)
        usd, failed, done = usd + told[0], failed + told[1], done + n
        if told[2]:
            ended = "account"
            break
    empty = queue.sparkSession.createDataFrame([], ANSWERS)
    answers = reduce(DataFrame.unionByName, waves, empty).where("ref > 0").drop("usd", "error")
    scored = batched.join(answers, ["batch", "ref"]).withColumn("fit_score", fit_score(F.col("base_score"), F.col("preference_multiplier")))
    return Run(scored, queued, done, failed, usd, ended)


__all__ = ["Run", "Scorer", "ScorerError", "priced", "rule_scorer", "run", "run_costs", "score", "upsert_matches", "with_priced_retry", "with_retry"]
