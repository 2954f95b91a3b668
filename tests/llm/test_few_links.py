"""Components of few links in many partitions take no rounds; of many links, rounds."""

from __future__ import annotations

import random

import pytest

from sievefold.llm import components
from sievefold.llm._spark import made


@pytest.fixture
def many_partitions(spark):
    put = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in put}
    for k, v in put.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def links_of(seed, n, k):
    r = random.Random(seed)
    names = r.sample(range(-(1 << 40), 1 << 40), n)
    pairs = [(names[i], names[i - 1]) for i in range(1, n) if i % k]  # chains of k, in the order of chance
    return r.sample(pairs, len(pairs))


def expected(pairs):
    root: dict[int, int] = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_few_links_in_many_partitions_take_no_rounds(spark, monkeypatch, many_partitions):
    pairs = links_of(1, 600, 60)
    stored = []
    real = components.materialize
    monkeypatch.setattr(components, "materialize", lambda df: stored.append(1) or real(df))
    left = made()
    found = components.components(spark.createDataFrame(pairs, "a long, b long").repartition(16))
    assert {x.node: x.component for x in found.collect()} == expected(pairs)
    assert len(stored) == 2
    assert len(made() - left) == 1  # what it read on its way is gone


def test_more_links_than_a_task_joins_take_rounds(spark, monkeypatch, many_partitions):
    pairs = links_of(2, 200, 20)
    monkeypatch.setattr(components, "JOINED", 20)
    stored = []
    real = components.materialize
    monkeypatch.setattr(components, "materialize", lambda df: stored.append(1) or real(df))
    found = components.components(spark.createDataFrame(pairs, "a long, b long").repartition(16))
    assert {x.node: x.component for x in found.collect()} == expected(pairs)
    assert len(stored) > 1
