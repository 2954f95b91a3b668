"""Tables in buckets: merges, replays, crashes, retention, and work that follows the batch."""

import random
from datetime import datetime

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from sievefold.operators.dedupe import near_duplicates
from sievefold.operators.tables import PARTS, Tables
from sievefold.plans.incremental import LISTINGS, PLACES, merge_batch


def frame(spark, rows, schema="k long, v string, s string"):
    return spark.createDataFrame(rows, schema)


def files(path):
    return sorted(str(p.relative_to(path)) for p in path.rglob("*.parquet"))


def test_merge_rewrites_touched_buckets_only(spark, tmp_path):
    t = Tables(spark, f"file://{tmp_path}/t")
    assert not t.has("a") and t.numbers() == []
    with t.commit() as tx:
        tx.merge("a", frame(spark, [(i, f"v{i}", "old") for i in range(400)]), "k", keep=("s",), buckets=16)
    before = files(tmp_path)
    with t.commit() as tx:
        tx.merge("a", frame(spark, [(7, "new", "new"), (1000, "more", "new")]), "k", keep=("s",))
        assert tx.written["a"] < 120  # two buckets of 16
    assert set(before) < set(files(tmp_path)) and len(files(tmp_path)) - len(before) <= 2
    got = {r.k: (r.v, r.s) for r in t.read("a").collect()}
    assert got == {i: (f"v{i}", "old") for i in range(400)} | {7: ("new", "old"), 1000: ("more", "new")}
    assert t.read("a", 0).count() == 400  # readers of the earlier commit see what they saw


def test_null_keys_are_added(spark, tmp_path):
    t = Tables(spark, str(tmp_path / "t"))
    for _ in range(2):
        with t.commit() as tx:
            tx.merge("a", frame(spark, [(None, "x", None), (None, "y", None), (1, "z", None)]), "k", buckets=4)
    assert sorted(r.v for r in t.read("a").collect()) == ["x", "x", "y", "y", "z"]


def test_one_commit_over_several_tables(spark, tmp_path):
    t = Tables(spark, str(tmp_path / "t"))
    with t.commit("s", 0) as tx:
        tx.merge("a", frame(spark, [(1, "x", None)]), "k")
        tx.append("log", frame(spark, [(1, "m", None)]))
        tx.replace("settings", frame(spark, [(1, "on", None)]))
        assert tx.read("a").count() == 1 and not t.has("a")  # not yet for others
    with pytest.raises(RuntimeError), t.commit("s", 1) as tx:
        tx.merge("a", frame(spark, [(1, "lost", None), (2, "lost", None)]), "k")
        tx.replace("settings", frame(spark, [(1, "off", None)]))
        raise RuntimeError("the writer dies between two writes")
    assert t.numbers() == [0] and [r.v for r in t.read("a").collect()] == ["x"] and t.read("settings").first().v == "on"
    for epoch in (0, 1, 1, 0):
        with t.commit("s", epoch) as tx:
            if tx is not None:
                tx.append("log", frame(spark, [(2, f"e{epoch}", None)]))
    assert t.numbers() == [0, 1] and sorted(r.v for r in t.read("log").collect()) == ["e1", "m"]
    with t.commit("other", 0) as tx:
        assert tx is not None
    with t.commit() as tx:
        pass  # changes nothing
    assert t.numbers() == [0, 1, 2]


def test_vacuum(spark, tmp_path):
    t = Tables(spark, str(tmp_path / "t"))
    for i in range(6):
        with t.commit() as tx:
            tx.merge("a", frame(spark, [(i, str(i), None), (i + 100, "x", None)]), "k", buckets=8)
            tx.replace("b", frame(spark, [(i, "x", None)]))
    with pytest.raises(RuntimeError), t.commit() as tx:
        tx.replace("b", frame(spark, [(9, "lost", None)]))
        raise RuntimeError
    n = len(files(tmp_path))
    assert t.vacuum(keep=2) > 0 and t.numbers() == [4, 5] and len(files(tmp_path)) < n
    assert t.read("a").count() == 12 and t.read("a", 4).count() == 10 and t.read("b").first().k == 5
    assert t.vacuum(keep=2) == 0
    with pytest.raises(OSError, match="another writer"):
        t._publish(t.manifest())


def test_log_parts_are_put_together(spark, tmp_path):
    t = Tables(spark, str(tmp_path / "t"))
    for i in range(PARTS * 2 + 3):
        with t.commit() as tx:
            tx.append("log", frame(spark, [(i, "x", None)]).coalesce(1))
    assert sorted(p[1] for p in t.manifest()["tables"]["log"]["parts"]) == [0, 0, 0, 1, 1]
    assert sorted(r.k for r in t.read("log").collect()) == list(range(PARTS * 2 + 3))


LISTING = "id long, dedupe_hash string, content_fingerprint string, first_seen_at timestamp, created_at timestamp, latitude double, longitude double, location_suburb string, duplicate_of long, title string"


def listing(i, fp, lat, suburb, day):
    at = datetime(2026, 1, day)
    return Row(id=i, dedupe_hash=f"h{i}", content_fingerprint=fp, first_seen_at=at, created_at=at, latitude=lat, longitude=None if lat is None else 0.0, location_suburb=suburb, duplicate_of=None, title=f"t{i}")


def test_ten_batches_equal_the_whole(spark, tmp_path):
    r, t, rows = random.Random(6), Tables(spark, str(tmp_path / "t")), {}
    make = lambda i, day: listing(i, r.choice([f"f{k}" for k in range(60)] + ["hot"] * 6 + [None]), r.choice([None, *(k * 0.02 for k in range(6))]), r.choice(["A", "b", None]), day)
    written, examined = [], []
    for batch in range(10):
        n = 300 if batch == 0 else 6
        new = [make(batch * 1000 + k, batch + 1) for k in range(n)]
        if batch:  # some are seen again, with another title or place
            new += [make(i, batch + 1) for i in r.sample(sorted(rows), 4)]
        for x in new:
            old = rows.get(x.id)
            rows[x.id] = Row(**(x.asDict() | ({} if old is None else {"first_seen_at": old.first_seen_at, "created_at": old.created_at})))
        with t.commit("s", batch) as tx:
            examined.append(merge_batch(tx, spark.createDataFrame(new, LISTING))["examined"])
            written.append(sum(tx.written.values()))
        if batch in (0, 4, 9):
            got = {x.id: x.duplicate_of for x in t.read(LISTINGS).collect()}
            want = {x.id: x.duplicate_of for x in near_duplicates(spark.createDataFrame(list(rows.values()), LISTING)).collect()}
            assert got == want
            assert {x.id: x.duplicate_of for x in t.read(PLACES).collect()} == {i: v for i, v in want.items() if rows[i].content_fingerprint}
            t.vacuum()
    assert len(rows) == 354
    # hot is touched by most batches, the other sixty by few
    assert max(examined[1:]) < 0.5 * len(rows) and max(written[1:]) < 0.9 * written[0]


def test_a_listing_that_changes_its_fingerprint(spark, tmp_path):
    t = Tables(spark, str(tmp_path / "t"))

    def marks(*rows):
        with t.commit() as tx:
            merge_batch(tx, spark.createDataFrame(list(rows), LISTING))
        return {x.id: x.duplicate_of for x in t.read(LISTINGS).collect()}

    assert marks(listing(1, "f", None, "A", 1), listing(2, "f", None, "a", 2), listing(3, "f", None, "A", 3)) == {1: None, 2: 1, 3: 1}
    assert marks(listing(1, "g", None, "A", 4)) == {1: None, 2: None, 3: 2}
    assert marks(listing(3, None, None, "A", 5)) == {1: None, 2: None, 3: None}
    assert marks(listing(4, "g", None, "A", 6), listing(3, "g", None, "A", 6)) == {1: None, 2: None, 3: 1, 4: 1}
    assert t.read(LISTINGS).where(F.col("id") == 3).first().first_seen_at == datetime(2026, 1, 3)
