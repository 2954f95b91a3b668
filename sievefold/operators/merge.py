"""Writes as whole-table merges.  There is no table format here with row updates, so a
write makes a new snapshot from the old one and the changes, by one join."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .dedupe import first_wins


def upsert(existing: DataFrame, incoming: DataFrame, key: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Existing rows replaced column by column by incoming ones of equal key, new keys
    added.  Columns in ``keep``, and those that ``incoming`` lacks, stay as they were.
    ``incoming`` must hold a key once; its rows with a null key are added as they are."""
    old, new = existing.withColumn("_is", F.lit(True)).alias("o"), incoming.withColumn("_is", F.lit(True)).alias("n")
    known, there = F.col("o._is").isNotNull(), F.col("n._is").isNotNull()
    out = []
    for c in existing.columns:
        if c == key:
            out.append(F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c))
        elif c not in incoming.columns:
            out.append(F.col(f"o.{c}").alias(c))
        elif c in keep:
            out.append(F.when(known, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c))
        else:
            out.append(F.when(there, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
    return old.join(new, F.col(f"o.{key}") == F.col(f"n.{key}"), "full").select(*out)


def insert_absent(existing: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Insert that does nothing on conflict; of new rows with equal keys the smallest stays."""
    fresh = first_wins(new, key, [c for c in new.columns if c not in key] or key).join(existing.select(*key), key, "left_anti")
    return existing.unionByName(fresh.select(*existing.columns))


def update_where(df: DataFrame, condition: Column, **values: Column) -> DataFrame:
    """Bulk update; a null condition changes nothing."""
    hit = F.coalesce(condition, F.lit(False))
    return df.select(*(F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in df.columns))


def delete_where(df: DataFrame, condition: Column) -> DataFrame:
    return df.where(~F.coalesce(condition, F.lit(False)))


def compare_and_set(df: DataFrame, ids: DataFrame, key: str, column: str, expected: str, value: str) -> DataFrame:
    """Sets ``column`` on the listed keys where it still holds the expected value."""
    marked = ids.select(key).distinct().withColumn("_hit", F.lit(True))
    x = df.join(marked, key, "left")
    return x.withColumn(column, F.when(F.col("_hit") & (F.col(column) == expected), value).otherwise(F.col(column))).select(*df.columns)


class Snapshots:
    """A table as snapshot folders and numbered pointers; the highest number is current.

    A snapshot is written whole before its pointer appears, and pointers are only added, so
    readers see the old or the new table at any moment.  A batch id that has a pointer is
    not written again and changes nothing.  There must be one writer."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _pointers(self) -> list[str]:
        """Names ``number.snapshot`` in order."""
        where = self._path(f"{self.root}/_pointers")
        return sorted(x.getPath().getName() for x in self._fs.listStatus(where)) if self._fs.exists(where) else []

    def current(self) -> str | None:
        found = self._pointers()
        return found[-1].split(".", 1)[1] if found else None

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{self.current()}")

    def write(self, df: DataFrame, batch: str | None = None) -> str:
        name = f"snapshot-{batch if batch is not None else uuid.uuid4().hex}"
        found = self._pointers()
        if name in (x.split(".", 1)[1] for x in found):
            return name
        if not self._fs.exists(self._path(f"{self.root}/{name}/_SUCCESS")):
            df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        number = int(found[-1].split(".", 1)[0]) + 1 if found else 0
        if not self._fs.mkdirs(self._path(f"{self.root}/_pointers/{number:012d}.{name}")):
            raise OSError(f"no pointer to {name} could be made")
        return name
