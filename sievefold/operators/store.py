"""Tables that are computed once and read several times, such as judged listings."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_stored: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a temporary folder on a single machine only."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.match(r"local(\[.*\])?$", spark.conf.get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir must name a folder that all nodes share")
        where = "file://" + tempfile.mkdtemp(prefix="sievefold-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def store(df: DataFrame) -> DataFrame:
    """``df`` as Parquet in the shared folder, until it is dropped or the driver's Python ends."""
    path = f"{shared_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _stored[path] = df.sparkSession
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


#: Rows of a few numbers that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def small(stored: DataFrame) -> DataFrame:
    """A stored table with the broadcast hint, if it holds BROADCAST_ROWS rows at most."""
    return F.broadcast(stored) if stored.count() <= BROADCAST_ROWS else stored


def drop(*stored: DataFrame) -> None:
    """Removes the files of stored tables that nothing reads any more."""
    for df in stored:
        _delete(df._stored_at)


@contextmanager
def scratch() -> Iterator[None]:
    """What is stored inside is dropped at the end: for work whose results are written
    elsewhere, such as a stream's micro-batch."""
    before = set(_stored)
    try:
        yield
    finally:
        for path in set(_stored) - before:
            _delete(path)


def _delete(path: str) -> None:
    spark = _stored.pop(path, None)
    if spark is None:
        return
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001 - the session may be gone at interpreter exit
        pass


@atexit.register
def _drop_all() -> None:
    for path in list(_stored):
        _delete(path)
