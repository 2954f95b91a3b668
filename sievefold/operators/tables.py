"""Tables in hash buckets that advance together.

There is no table format with row updates here, so a table is a set of buckets by the hash
of its key, each a few Parquet files, and a *manifest* says which files are current.  A
merge rewrites the buckets that its rows fall into and no others.  A commit may change
several tables; its new files are all written before the manifest, one small JSON file with
the next number, appears, so readers see all of it or nothing, and a writer that dies leaves
files that no manifest names.  There must be one writer.

A stream's micro-batches are told apart by the stream's id and their number: the manifest
keeps the last number of every stream, and a batch that is repeated changes nothing.
"""

from __future__ import annotations

import copy
import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .merge import upsert
from .store import drop, store

BUCKETS = 64
#: Appended parts of one size class that are put together into one of the next.
PARTS = 8
_BUCKET = "_bucket"


class Tables:
    """Named tables under a folder that all nodes share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # --- manifests ---------------------------------------------------------------------

    def numbers(self) -> list[int]:
        """Of the commits that are kept, in order."""
        where = self._path(f"{self.root}/_commits")
        if not self._fs.exists(where):
            return []
        names = (x.getPath().getName() for x in self._fs.listStatus(where))
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def manifest(self, number: int | None = None) -> dict:
        found = self.numbers()
        if not found:
            return {"number": -1, "streams": {}, "tables": {}}
        at = self._path(f"{self.root}/_commits/{found[-1] if number is None else number:012d}.json")
        data = self._fs.open(at)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(data, "UTF-8"))
        finally:
            data.close()

    def _publish(self, manifest: dict) -> None:
        final = self._path(f"{self.root}/_commits/{manifest['number']:012d}.json")
        part = self._path(f"{self.root}/_commits/.{uuid.uuid4().hex}")
        out = self._fs.create(part, False)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        if self._fs.exists(final) or not self._fs.rename(part, final):
            raise OSError(f"commit {manifest['number']} exists already: there is another writer")

    # --- reading -----------------------------------------------------------------------

    def has(self, name: str) -> bool:
        return name in self.manifest()["tables"]

    def read(self, name: str, number: int | None = None) -> DataFrame:
        return self._read(self.manifest(number)["tables"][name])

    def _read(self, entry: dict, buckets: list[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(json.loads(entry["schema"]))
        if "files" in entry:
            paths = [p for b, p in entry["files"].items() if buckets is None or int(b) in buckets]
        else:
            paths = [p for p, _ in entry["parts"]]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{p}" for p in paths))

    # --- writing -----------------------------------------------------------------------

    @contextmanager
    def commit(self, stream: str | None = None, epoch: int | None = None) -> Iterator[Commit | None]:
        """One commit; None if the stream's epoch has been committed before.  Nothing is
        published if the block raises or changes no table."""
        manifest = self.manifest()
        if stream is not None and manifest["streams"].get(stream, -1) >= epoch:
            yield None
            return
        tx = Commit(self, manifest)
        yield tx
        if tx.changed or stream is not None:
            tx.manifest["number"] = manifest["number"] + 1
            if stream is not None:
                tx.manifest["streams"][stream] = epoch
            self._publish(tx.manifest)

    def vacuum(self, keep: int = 2) -> int:
        """Removes all manifests but the last ``keep``, and the files that none of these
        names; returns how many folders went.  Not while a commit is being written."""
        found = self.numbers()
        for n in found[:-keep]:
            self._fs.delete(self._path(f"{self.root}/_commits/{n:012d}.json"), False)
        used = {p for n in found[-keep:] for t in self.manifest(n)["tables"].values() for p in (t["files"].values() if "files" in t else (p for p, _ in t["parts"]))}
        gone = 0
        for table in self._folders(""):
            for write in self._folders(table):
                mine = [p for p in used if p == write or p.startswith(f"{write}/")]
                for p in [write] if not mine else [b for b in self._folders(write) if write not in used and b not in used]:
                    self._fs.delete(self._path(f"{self.root}/{p}"), True)
                    gone += 1
        return gone

    def _folders(self, at: str) -> list[str]:
        where = self._path(f"{self.root}/{at}" if at else self.root)
        names = [x.getPath().getName() for x in self._fs.listStatus(where) if x.isDirectory()] if self._fs.exists(where) else []
        return [f"{at}/{n}" if at else n for n in names if n != "_commits"]


class Commit:
    """Changes that are published together.  Reads see the changes made so far."""

    def __init__(self, tables: Tables, manifest: dict):
        self.tables, self.manifest, self.changed = tables, copy.deepcopy(manifest), False
        #: Rows written so far, by table.
        self.written: dict[str, int] = {}

    def has(self, name: str) -> bool:
        return name in self.manifest["tables"]

    def read(self, name: str) -> DataFrame:
        return self.tables._read(self.manifest["tables"][name])

    def _bucket(self, df: DataFrame, entry: dict) -> Column:
        """By the hash of the bucket's columns; a row without them goes by all of its own."""
        by = entry["by"]
        none = F.lit(True)
        for c in by:
            none &= F.col(c).isNull()
        return F.pmod(F.when(none, F.xxhash64(*df.columns)).otherwise(F.xxhash64(*by)), F.lit(entry["buckets"])).cast("int")

    def touched(self, name: str, rows: DataFrame) -> list[int]:
        """The buckets that rows with the bucket's columns fall into: a bounded number."""
        return sorted(r[0] for r in rows.select(self._bucket(rows, self.manifest["tables"][name])).distinct().collect())

    def read_buckets(self, name: str, buckets: list[int]) -> DataFrame:
        return self.tables._read(self.manifest["tables"][name], buckets)

    def create(self, name: str, schema: StructType, by: list[str], buckets: int = BUCKETS) -> None:
        """An empty table in buckets by the hash of ``by``.  Choose as many as make a bucket
        one task's work: a bucket is written whole."""
        self.manifest["tables"][name] = {"schema": schema.json(), "by": by, "buckets": buckets, "files": {}}
        self.changed = True

    def put(self, name: str, rows: DataFrame, buckets: list[int]) -> None:
        """Replaces the content of ``buckets`` by ``rows``, which must fall into these."""
        entry = self.manifest["tables"][name]
        where = f"{name}/{uuid.uuid4().hex}"
        columns = StructType.fromJson(json.loads(entry["schema"])).names
        rows = rows.select(*columns)
        out = rows.withColumn(_BUCKET, self._bucket(rows, entry)).repartition(max(1, len(buckets)), _BUCKET)
        out.write.partitionBy(_BUCKET).parquet(f"{self.tables.root}/{where}")
        made = {p.rsplit("=", 1)[1]: p for p in self.tables._folders(where)}
        if not set(made) <= set(map(str, buckets)):
            raise ValueError(f"rows of {name} fall into other buckets than {buckets}")
        for b in map(str, buckets):
            entry["files"].pop(b, None)
        entry["files"] |= made
        self.written[name] = self.written.get(name, 0) + (self.read_buckets(name, buckets).count() if made else 0)
        self.changed = True

    def merge(self, name: str, incoming: DataFrame, key: str, keep: tuple[str, ...] = (), buckets: int = BUCKETS) -> None:
        """Upserts rows by ``key`` (see ``merge.upsert``) into a table that is bucketed by it,
        which is made if there is none.  ``incoming`` must hold a key once."""
        incoming = store(incoming)
        if not self.has(name):
            self.create(name, incoming.schema, [key], buckets)
        if self.manifest["tables"][name]["by"] != [key]:
            raise ValueError(f"{name} isn't bucketed by {key}")
        entry = self.manifest["tables"][name]
        mine = self._widened(incoming, entry)
        into = self.touched(name, mine)
        if into:
            self.put(name, upsert(self.read_buckets(name, into), incoming, key, keep), into)
        drop(incoming)

    def _widened(self, rows: DataFrame, entry: dict) -> DataFrame:
        """With nulls for what the rows lack, as ``upsert`` adds them."""
        fields = StructType.fromJson(json.loads(entry["schema"])).fields
        return rows.select(*(F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in fields))

    def rows_of(self, name: str, keys: DataFrame, key: str) -> DataFrame:
        """The rows whose key is among ``keys`` (a column of that name), of a table bucketed
        by it, from the buckets that these fall into."""
        found = self.read_buckets(name, self.touched(name, self._widened(keys, self.manifest["tables"][name])))
        return found.join(keys.select(key).distinct(), key, "left_semi")

    def replace(self, name: str, rows: DataFrame) -> None:
        """A whole small table, such as settings."""
        where = f"{name}/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.tables.root}/{where}")
        self.manifest["tables"][name] = {"schema": rows.schema.json(), "parts": [[where, 0]]}
        self.changed = True

    def append(self, name: str, rows: DataFrame) -> None:
        """Adds rows to a log.  Of its parts PARTS of one size class become one of the next,
        so a row is written as often as the logarithm of the number of appends."""
        where = f"{name}/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.tables.root}/{where}")
        entry = self.manifest["tables"].setdefault(name, {"schema": rows.schema.json(), "parts": []})
        entry["parts"].append([where, 0])
        level = 0
        while len(same := [p for p in entry["parts"] if p[1] == level]) >= PARTS:
            where = f"{name}/{uuid.uuid4().hex}"
            self.tables._read(entry | {"parts": same}).coalesce(max(1, len(same) // 4)).write.parquet(f"{self.tables.root}/{where}")
            entry["parts"] = [p for p in entry["parts"] if p not in same] + [[where, level + 1]]
            level += 1
        self.changed = True


__all__ = ["BUCKETS", "Commit", "Tables"]
