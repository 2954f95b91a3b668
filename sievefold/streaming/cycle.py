"""The whole cycle of a micro-batch: ingest with near duplicates, notifications, scoring.

Ingest decides over the batch: it is one commit, and if it fails, the stream repeats it.
The later steps work on the tables, not on the batch, so a failure of one is recorded, the
others go on, and the next cycle makes up for it.  Merges rewrite what a batch touches, and
what a step stores on its way is removed when it ends.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..criteria import Criteria
from ..functions import render
from ..operators.budget import spend_allowance
from ..operators.settings import load_settings, notification_rows, record_spend, sent_today
from ..operators.store import scratch
from ..operators.tables import BUCKETS, Tables
from ..plans import matches as m
from ..plans import scoring
from ..plans.incremental import LISTINGS, merge_batch
from ..plans.ingest import prepare
from . import polls
from .ingest import query_id

MATCH = "match_id long, listing_id long, base_score int, fit_score long, preference_multiplier decimal(4,2), reasoning string, category string, match_status string, created_at timestamp, updated_at timestamp"
LOG = "id string, match_id long, channel string, chat_id string, message_id string, payload string, status string, error string, sent_at timestamp"
MATCHES, SETTINGS, NOTIFICATIONS, SOURCES = "matches", "settings", "notification_log", "sources"
STEPS = ("notify", "score")


class Sender(Protocol):
    """Sends a message with its keyboard and returns the message's id."""

    def __call__(self, text: str, keyboard: str) -> str: ...


@dataclass
class Cycle:
    """Tables and foreign parts of a cycle.  ``dearest`` bounds what one batch of scores
    costs; ``stopped`` is asked before each step and between the waves of scoring."""

    tables: Tables
    criteria: Callable[[], Criteria]
    now: Callable[[], str]
    order: list[str]
    scorer: scoring.PricedScorer
    dearest: float
    sender: Sender
    channel: str = "chat"
    chat_id: str = ""
    #: Buckets of the tables that the cycle makes.
    buckets: int = BUCKETS
    stopped: Callable[[], bool] = lambda: False
    #: (epoch, step, error) of steps that failed
    failures: list[tuple[int, str, str]] = field(default_factory=list)

    @property
    def spark(self) -> SparkSession:
        return self.tables.spark

    def table(self, name: str, schema: str) -> DataFrame:
        return self.tables.read(name) if self.tables.has(name) else self.spark.createDataFrame([], schema)

    def ingest(self, batch: DataFrame, stream: str, epoch: int) -> dict[str, int] | None:
        """Counts of the near-duplicate pass; None if the epoch was ingested before."""
        with self.tables.commit(stream, epoch) as tx:
            if tx is None:
                return None
            prepared = prepare(batch, self.criteria(), self.now(), self.order).withColumn("duplicate_of", F.lit(None).cast(dict(batch.dtypes)["id"]))
            return merge_batch(tx, prepared, self.buckets)

    def judged(self) -> DataFrame:
        return self.tables.read(LISTINGS).withColumnsRenamed({"prefilter_status": "status", "location_suburb": "suburb"})

    def notify(self) -> None:
        """At most the candidates of ``notify_queue`` are sent, one by one.  The attempts are
        logged and the sent ones marked in one commit after that: a death before it sends
        twice, never not."""
        s, at = load_settings(self.tables.read(SETTINGS)), F.lit(self.now()).cast("timestamp")
        log, found = self.table(NOTIFICATIONS, LOG), self.table(MATCHES, MATCH)
        if s.is_paused:
            return
        due = m.notify_queue(found, self.judged().drop("preference_multiplier"), s.notify_score_threshold, sent_today(log, at).first()[0], s.max_notifications_per_day)
        columns = {c: F.col(c) for c in ("fit_score", "title", "company", "suburb", "distance_km", "category", "compensation", "work_mode", "commitment", "duration_weeks", "base_score", "url", "reasoning")}
        card = render.match_card(columns | {"multiplier": F.col("preference_multiplier"), "posted": F.col("posted_date").cast("string")})
        attempts = []
        for r in due.where("send").orderBy("rank").select("match_id", "listing_id", card.alias("text"), render.match_keyboard(F.col("match_id").cast("string")).alias("keyboard")).collect():
            if self.stopped():
                break
            try:
                attempts.append((r.match_id, r.listing_id, self.channel, self.chat_id, self.sender(r.text, r.keyboard), r.text, None))
            except Exception as e:  # noqa: BLE001 - the transport is foreign code
                attempts.append((r.match_id, r.listing_id, self.channel, self.chat_id, None, r.text, str(e) or type(e).__name__))
        if not attempts:
            return
        tried = self.spark.createDataFrame(attempts, "match_id long, listing_id long, channel string, chat_id string, message_id string, payload string, error string")
        with self.tables.commit() as tx:
            tx.append(NOTIFICATIONS, notification_rows(tried, at))
            sent = tried.where("error IS NULL").select("listing_id")
            # only what is still new, whatever was decided meanwhile
            fresh = tx.rows_of(MATCHES, sent, "listing_id").where("match_status = 'new'")
            tx.merge(MATCHES, fresh.select("listing_id", F.lit("notified").alias("match_status")), "listing_id")

    def score(self) -> None:
        """The spend is committed before the matches: scores that were paid for and lost are
        paid for again, but never forgotten."""
        settings, at = self.tables.read(SETTINGS), F.lit(self.now()).cast("timestamp")
        s, found = load_settings(settings), self.table(MATCHES, MATCH)
        if s.is_paused or not s.scoring_enabled:
            return
        money = (F.lit(float(x)) for x in (s.max_scoring_spend_usd_per_cycle, s.max_scoring_spend_usd_per_day, s.scoring_spend_today))
        allowance = self.spark.range(1).select(spend_allowance(*money, F.lit(s.scoring_spend_reset_at), at)).first()[0]
        done = scoring.run(m.work_queue(self.judged(), found), self.scorer, float(allowance), self.dearest, stopped=self.stopped)
        if done.usd > 0:
            with self.tables.commit() as tx:
                tx.replace(SETTINGS, record_spend(settings, done.usd, at))
        if not done.scored.isEmpty():
            new = done.scored.withColumns({"listing_id": F.col("id"), "match_id": F.col("id"), "created_at": at, "updated_at": at, "match_status": F.lit("new")})
            with self.tables.commit() as tx:
                tx.merge(MATCHES, new.select(*found.columns), "listing_id", scoring.KEPT, self.buckets)
        if done.failed:
            raise RuntimeError(f"{done.failed} of {done.batches} batches failed; the run ended: {done.ended}")

    def run(self, batch: DataFrame, epoch: int, stream: str) -> None:
        with scratch():
            self.ingest(batch, stream, epoch)
        self.follow(epoch)

    def follow(self, epoch: int) -> None:
        """The steps after ingest.  Old files are removed at the end."""
        for step in STEPS:
            if self.stopped():
                return
            if step == "notify" and not self.tables.has(LISTINGS):
                return  # nothing was ever found
            try:
                with scratch():
                    getattr(self, step)()
            except Exception as e:  # noqa: BLE001 - a failed step waits for the next cycle
                self.failures.append((epoch, step, str(e) or type(e).__name__))
        self.tables.vacuum()

    def poll(self, boards: dict[str, polls.Board], epoch: int, stream: str = "polls") -> dict[str, str]:
        """A cycle over what a poll of the due sources finds; says what became of each source.

        Polls are recorded before their listings are ingested: calls that were made are never
        forgotten, listings lost in between are found by the next poll."""
        with scratch():
            done = polls.poll(self.spark, self.tables.read(SOURCES), boards, self.criteria(), self.now(), self.stopped)
            with self.tables.commit() as tx:
                tx.replace(SOURCES, done.sources)
            if done.listings is not None:
                self.ingest(done.listings, stream, epoch)
        self.follow(epoch)
        return done.said


def start(stream: DataFrame, cycle: Cycle, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Runs a cycle on each micro-batch: on what is there, or continuously ``every`` so
    often.  Limit a batch with the source's ``maxFilesPerTrigger``; the budgets of calls,
    spend and notifications limit what a cycle does beyond it."""
    sink = stream.writeStream.foreachBatch(lambda batch, epoch: cycle.run(batch, epoch, query_id(cycle.spark, checkpoint)))
    sink = sink.option("checkpointLocation", checkpoint)
    return (sink.trigger(processingTime=every) if every else sink.trigger(availableNow=True)).start()


def failure_rows(spark: SparkSession, cycle: Cycle) -> DataFrame:
    return spark.createDataFrame(cycle.failures, "epoch long, step string, error string")


__all__ = ["Cycle", "Sender", "failure_rows", "start"]
