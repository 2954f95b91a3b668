"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import atexit
import math
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters outside blank and \x09-\x0D (Java and RE2 syntax).
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.
    Where that is unset a temporary one is made, on a single machine only."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.conf.get("spark.master", "")
        if not re.match(r"local(\[.*\])?$", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all nodes of {master or 'the cluster'} share")
        where = "file://" + tempfile.mkdtemp(prefix="sievefold-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


#: Rows and bytes of an Arrow batch between the JVM and Python; Spark's own defaults let
#: batches of long texts grow to 64 MB, several of which are held at once.
ARROW_ROWS, ARROW_BYTES = 2000, 4 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, after limiting the session's Arrow batches if they are as Spark sets them."""
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    if conf.get("spark.sql.execution.arrow.maxBytesPerBatch", "64m") in ("64m", "64MB", "67108864b", "67108864"):
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    return df


_made: dict[str, SparkSession] = {}


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage: a lost executor costs a re-read of the files, not a
    recomputation.  The files go by ``discard``, or when the driver's Python ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sievefold-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._sievefold_path = path
    return out


def discard(*stored: DataFrame) -> None:
    """Remove the files of stored tables that nothing reads any more."""
    for df in stored:
        _drop(df._sievefold_path)


def made() -> set[str]:
    return set(_made)


def discard_since(before: set[str], *keep: DataFrame) -> None:
    """Remove all tables stored since ``before`` (of ``made()``) but ``keep``."""
    for path in set(_made) - before - {df._sievefold_path for df in keep}:
        _drop(path)


def _drop(path: str) -> None:
    spark = _made.pop(path, None)
    if spark is None:
        return
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001 - the session may be gone at interpreter exit
        pass


@atexit.register
def _drop_all() -> None:
    for path in list(_made):
        _drop(path)


def crc_mod(col: str | Column, n: int) -> Column:
    """crc32 of the value as text, modulo n."""
    return F.crc32(F.col(col).cast("string").cast("binary") if isinstance(col, str) else col.cast("string").cast("binary")) % n


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def n_groups(rows: int, per_group: int) -> int:
    return max(1, math.ceil(rows / per_group))


#: Rows of a few numbers that may be broadcast; more are joined by a shuffle.  The driver
#: holds a broadcast table several times over while it is built and sent.
BROADCAST_ROWS = 200_000


def checked_broadcast(stored: DataFrame) -> DataFrame:
    """A stored table with the broadcast hint if it holds BROADCAST_ROWS rows at most."""
    return F.broadcast(stored) if stored.count() <= BROADCAST_ROWS else stored


#: Bits of a key filter: for each key, and all in all.
KEY_BITS, FILTER_BITS = 16, 1 << 25


def key_filter(keys: DataFrame, key: str) -> tuple[DataFrame, Column]:
    """One row of bits for the hashes in column ``key`` of a stored table, and the condition
    by which ``left_semi`` with it keeps the rows that have one of these hashes, and a few
    others.  It holds FILTER_BITS at most, whatever the number of keys: beyond that more of
    the others pass.  What passes is to be joined with the keys."""
    n = max(1, keys.count())
    size = min(FILTER_BITS, 1 << max(12, (KEY_BITS * n - 1).bit_length()))
    at = F.col(key).bitwiseAND(F.lit(size - 1))
    word, bit = F.shiftright(at, 6), at.bitwiseAND(F.lit(63)).cast("int")
    each = keys.select(word.alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("b"))
    each = each.union(keys.sparkSession.range(size >> 6).select("id", F.lit(0).cast("long")))
    words = each.groupBy("w").agg(F.bit_or("b").alias("b"))
    bits = words.agg(F.transform(F.sort_array(F.collect_list(F.struct("w", "b"))), lambda x: x["b"]).alias("_bits"))
    return F.broadcast(materialize(bits)), F.bit_get(F.get("_bits", word.cast("int")), bit) == 1


def without_keys(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``rows`` but those of the hashes in ``keys`` (a stored table).  However many keys there
    are, only rows that may have one are shuffled."""
    if keys.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(keys), key, "left_anti")
    bits, may_have = key_filter(keys, key)
    return rows.join(bits, may_have, "left_anti").union(rows.join(bits, may_have, "left_semi").join(keys, key, "left_anti").select(*rows.columns))


#: A key is hot if it holds more than one in so many rows; so there are fewer hot keys than this.
HOT = 1000


def join_unique(left: DataFrame, right: DataFrame, keys: list[str], rows: int, per_key: str | None = None) -> DataFrame:
    """``left`` (of ``rows`` rows, stored) with the columns of ``right`` (stored, a row per
    key), null where there is none.

    No key's rows meet in one task: the hot keys' rows of ``right``, fewer than HOT for
    each value of what isn't counted, are broadcast, and of other keys a task gets one in
    HOT rows at most.  ``per_key`` is the column of ``right`` that counts the rows of its
    key in ``left``; without it they are counted.  Null keys are never joined."""
    some = F.lit(True)
    for k in keys:
        some &= F.col(k).isNotNull()
    if per_key is None:
        counts = left.where(some).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") * HOT > rows)
        hot = materialize(counts.select(*keys))
        warm = right.join(F.broadcast(hot), keys)
    else:
        is_hot = F.col(per_key) * HOT > rows
        warm, right = right.where(is_hot), right.where(~is_hot)
        hot = warm.select(*keys)
    met = left.join(F.broadcast(hot), keys, "left_semi").join(F.broadcast(warm), keys, "left")
    rest = left.where(some).join(F.broadcast(hot), keys, "left_anti").join(right, keys, "left")
    more = [c for c in right.columns if c not in keys]
    kinds = dict(right.dtypes)
    alone = left.where(~some).select("*", *(F.lit(None).cast(kinds[c]).alias(c) for c in more))
    return met.unionByName(rest).unionByName(alone)


def hash_share(rows: int, n: int, key: Column) -> Column:
    """A condition that about ``4 * n`` of ``rows`` meet (all, if there are fewer), by a
    hash of ``key``: what follows it, such as a top-n on the driver, sees a bounded number
    of rows whatever the table's size and number of partitions."""
    share = min(1.0, 4 * n / max(1, rows))
    return F.lit(True) if share >= 1 else F.pmod(F.xxhash64(key), F.lit(1 << 40)) < int(share * (1 << 40))
