"""What must stay bounded, or local, however many classes and keys a table has."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from sievefold.llm import _spark, jaccard


def texts(n, seed=3):
    """Near copies in twos, and a text that a repeated id has twice."""
    r = random.Random(seed)
    base = [[f"w{r.randrange(9000)}" for _ in range(60)] for _ in range(n // 2)]
    rows = [(2 * i + k, " ".join([*t, f"x{i}"][k:])) for i, t in enumerate(base) for k in (0, 1)]
    return [*rows, rows[0], (None, rows[4][1])]


@pytest.mark.parametrize("bits", [1 << 25, 64])
def test_key_filter(spark, monkeypatch, bits):
    """All keys pass, and if there are bits enough few others do."""
    monkeypatch.setattr(_spark, "FILTER_BITS", bits)
    rows = spark.range(20_000).select("id", F.xxhash64("id").alias("h"))
    keys = _spark.materialize(rows.where("id % 10 = 0").select("h"))
    row, may_have = _spark.key_filter(keys, "h")
    assert row.select(F.size("_bits")).first()[0] * 64 <= bits
    got = {x.id for x in rows.join(row, may_have, "left_semi").collect()}
    assert got >= set(range(0, 20_000, 10)) and (bits == 64 or len(got) < 4_000)


@pytest.mark.parametrize("limit", [0, 1000])
def test_without_keys(spark, monkeypatch, limit):
    monkeypatch.setattr(_spark, "BROADCAST_ROWS", limit)
    rows = spark.range(900).select(F.xxhash64("id").alias("h"), "id")
    keys = _spark.materialize(rows.where("id % 7 = 0").select("h"))
    assert sorted(x.id for x in _spark.without_keys(rows, keys, "h").collect()) == [i for i in range(900) if i % 7]


def test_texts_are_picked_without_a_table_of_classes(spark):
    """The driver sends bits of bounded number, and texts are in no shuffle."""
    docs = spark.createDataFrame(texts(40), "doc_id long, text string")
    sets = _spark.materialize(jaccard.shingle_table(docs, 3, 90, 0.2, "doc_id", "text"))
    chosen = _spark.materialize(jaccard.classes_of(sets).select("node", "sig", "sig2", "h", "n", F.lit(1).cast("long").alias("cell")))
    found = jaccard._second_bands(docs, chosen, 3, 90, 0.2, "doc_id", "text")
    assert found.count() == 40 == found.select("node").distinct().count()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = jaccard._second_bands(docs, chosen, 3, 90, 0.2, "doc_id", "text")._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" not in plan and plan.index("SortMergeJoin") < plan.index("MapInArrow") < plan.index("BroadcastNestedLoopJoin")


def test_same_rows_whether_tables_are_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame(texts(60), "doc_id long, text string")
    kept = lambda: sorted(map(tuple, corpus_pipeline.near_duplicates(spark, docs, "").collect()), key=str)
    want = kept()
    monkeypatch.setattr(_spark, "BROADCAST_ROWS", 0)
    assert kept() == want and len(want) == 30
