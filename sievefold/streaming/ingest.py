"""Continuous ingest: micro-batches of listings merged into the snapshot table.

Criteria are read again for every batch, and a batch that is repeated after a failure
finds its own snapshot, so the result equals one batch over all input.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..criteria import Criteria
from ..operators.merge import Snapshots
from ..plans.ingest import merge_listings, prepare


def query_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a stream's checkpoint gives it; another one for a fresh checkpoint."""
    return json.loads("".join(r[0] for r in spark.read.text(f"{checkpoint.rstrip('/')}/metadata").collect()))["id"]


def merge_batch(table: Snapshots, criteria: Callable[[], Criteria], now: Callable[[], str], order: list[str], checkpoint: str) -> Callable[[DataFrame, int], None]:
    """Batches are told apart by the stream's id and their number."""

    def run(batch: DataFrame, epoch: int) -> None:
        prepared = prepare(batch, criteria(), now(), order)
        has = table.current() is not None
        table.write(merge_listings(table.read(), prepared) if has else prepared, batch=f"{query_id(table.spark, checkpoint)}-{epoch}")

    return run


def start(stream: DataFrame, table: Snapshots, criteria: Callable[[], Criteria], now: Callable[[], str], order: list[str], checkpoint: str) -> StreamingQuery:
    """Starts on what is there and stops when it is read; run it again for what is new."""
    sink = stream.writeStream.foreachBatch(merge_batch(table, criteria, now, order, checkpoint))
    return sink.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
