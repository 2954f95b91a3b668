"""Rounds of connected components."""

import random

import pytest
from sievefold.llm import _spark, components


def test_a_chain_takes_few_rounds(spark, monkeypatch):
    """Each task joins the links that it holds, so rounds don't follow a chain's length."""
    stored = []
    keep = _spark.materialize
    monkeypatch.setattr(components, "materialize", lambda df: stored.append(1) or keep(df))
    order = list(range(3000))
    random.Random(8).shuffle(order)
    links = spark.createDataFrame(list(zip(order, order[1:], strict=False)), "a long, b long")
    got = {(x.node, x.component) for x in components.components(links).collect()}
    assert got == {(i, 0) for i in range(3000)} and len(stored) <= 3


@pytest.mark.parametrize("joined", [1, 7, 200_000])
def test_components_whatever_a_task_joins_at_once(spark, monkeypatch, joined):
    monkeypatch.setattr(components, "JOINED", joined)
    links = [(i, i + 1) for i in range(40) if i % 9] + [(100 + i, 100) for i in range(1, 30)] + [(7, 7), (None, 5)]
    got = {x.node: x.component for x in components.components(spark.createDataFrame(links, "a long, b long").repartition(3)).collect()}
    want = {i: max((i - 1) // 9 * 9 + 1, 0) for i in range(1, 41)} | {i: 100 for i in range(100, 130)}
    assert got == want
