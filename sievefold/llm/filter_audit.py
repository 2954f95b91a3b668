"""Filter interaction audit by executing a trie of filter permutations.

Every order of the filters is a path in a trie whose nodes are the documents that the
filters so far leave.  What survives a prefix doesn't depend on its order, so nodes of
equal sets of filters are one state: 2**n states and n * 2**(n-1) edges carry all n!
orders.

1. One pass over the texts gives a row of a few flags per document, which is stored.
2. States are visited depth-first.  A state's survivors are the persisted DataFrame of its
   parent without the rows that one more filter fails; a state that another order has
   reached before is not executed again.  Only the survivors on the way down are
   persisted at any time, n at most.
3. At every state one aggregation counts, per part, what each remaining filter really
   removes there.  The states' counts are stored: a few rows per part.
4. The orders are read off the edges: step k of an order is the edge from the state of its
   first k - 1 filters.
"""

from __future__ import annotations

import json
from itertools import permutations
from math import factorial

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import discard_since, join_unique, made, materialize

FILTERS = "ABCDE"
_SEPARATOR = r"[\x20\x09-\x0D]+"
_EDGE = "part string, state int, filter string, n long, removed long, good_lost long, toxic_lost long"


def text_failures(text: Column) -> dict[str, Column]:
    """The failure conditions of a text by itself; a null text is empty."""
    t = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(t, _SEPARATOR), lambda w: w != "")
    # in an array of one, so that the words are split once
    count = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("k")))[0]
    capitals = F.length(t) - F.length(F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "_words": count,
        "A": F.col("_words.n") < 50,
        "B": F.col("_words.k").cast("long") * 100 < F.col("_words.n").cast("long") * 65,
        "C": capitals.cast("long") * 100 > F.length(t).cast("long") * 5,
        "D": t.rlike(r"[#$%&*|]"),
    }


def failure_rows(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(part, A to E, good, toxic): for every document which filters it fails, and its
    labels.  Stored; a few bytes per document."""
    given = docs.select(F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    judged = text_failures(F.col("text"))
    x = given.withColumn("_words", judged.pop("_words")).withColumns(judged)
    x = materialize(x.select("part", "id", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("h"), *judged))
    n = x.count()
    copies = materialize(x.groupBy("h").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies")))
    repeated = F.coalesce(F.col("id") > F.col("first_id"), F.lit(False))
    x = materialize(join_unique(x, copies, ["h"], n, "copies").withColumn("E", repeated).drop("h", "first_id", "copies"))
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    marks = materialize(marks.where("good OR toxic"))
    sure = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return materialize(join_unique(x, marks, ["id"], n).select("part", *FILTERS, sure("good"), sure("toxic")))


def _bit(f: str) -> int:
    return 1 << FILTERS.index(f)


def _edges(survivors: DataFrame, state: int) -> DataFrame:
    """What each remaining filter removes from a state's survivors, per part."""
    rest = [f for f in FILTERS if not state & _bit(f)]
    counts = [F.count_if(F.col(f) & c).alias(f"{f}_{name}") for f in rest for name, c in (("removed", F.lit(True)), ("good_lost", F.col("good")), ("toxic_lost", F.col("toxic")))]
    seen = survivors.groupBy("part").agg(F.count(F.lit(1)).alias("n"), *counts)
    edge = lambda f: F.struct(F.lit(f).alias("filter"), *(F.col(f"{f}_{c}").alias(c) for c in ("removed", "good_lost", "toxic_lost")))
    out = seen.select("part", F.lit(state).alias("state"), "n", F.explode(F.array(*map(edge, rest))).alias("e"))
    return out.select("part", "state", "e.filter", "n", "e.removed", "e.good_lost", "e.toxic_lost")


def execute(rows: DataFrame) -> DataFrame:
    """The edges of the trie (part, state, filter, n, removed, good_lost, toxic_lost): of the
    ``n`` documents that the filters in ``state`` (a sum of bits) leave, what one more removes.
    States that leave nothing of a part have no row for it."""
    stored: list[str] = []
    known: set[int] = set()

    def visit(state: int, survivors: DataFrame) -> None:
        known.add(state)
        stored.append(materialize(_edges(survivors, state))._sievefold_path)
        for f in FILTERS:
            after = state | _bit(f)
            if after in known or after == _bit(FILTERS[-1]) * 2 - 1:  # reached by another order, or the end
                continue
            left = survivors.where(~F.col(f)).persist(StorageLevel.MEMORY_AND_DISK)
            try:
                visit(after, left)
            finally:
                left.unpersist()

    visit(0, rows)
    return rows.sparkSession.read.schema(_EDGE).parquet(*stored)


def orders() -> list[dict]:
    """All orders step by step: the state before the step and the filter that it applies."""
    out = []
    for order in permutations(FILTERS):
        state = 0
        for step, f in enumerate(order, 1):
            out.append({"filter_order": "".join(order), "step": step, "state": state, "filter": f})
            state |= _bit(f)
    return out


def audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """A row per part, order of the filters and step: (part, filter_order, step, kept,
    removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    Null texts are empty; null and empty parts are one.  A row without id copies nothing
    and is copied by nothing; rows of one id and text don't copy each other.  Labels of an
    id are joined: it is good (toxic) if any of its labels says so; null labels say
    nothing.  Repeated rows all count.  Without documents the result is empty.  Other
    columns are not read.
    """
    before = made()
    edges = materialize(execute(failure_rows(docs, labels, doc_id, text, part)))
    discard_since(before, edges)
    n = len(FILTERS)
    full = (1 << n) - 1
    size = F.bit_count(F.col("state")).cast("int")
    # so many orders have this edge
    ways = F.get(F.lit([factorial(k) * factorial(n - 1 - k) for k in range(n)]), size)
    at = lambda state: F.coalesce(F.max(F.when(F.col("state") == state, F.col("removed"))), F.lit(0))
    own = F.lit(0)
    for f in FILTERS:
        own = F.when(F.col("filter") == f, F.lit(full & ~_bit(f))).otherwise(own)
    whole = edges.groupBy("part", "filter").agg(at(F.lit(0)).alias("fails"), at(own).alias("unique_fails"), F.sum(F.col("removed") * ways).alias("shapley"))
    steps = F.from_json(F.lit(json.dumps(orders())), "array<struct<filter_order: string, step: int, state: int, filter: string>>")
    grid = edges.where("state = 0").select("part").distinct().select("part", F.inline(steps))
    x = grid.join(edges, ["part", "state", "filter"], "left").join(whole, ["part", "filter"])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return x.select(
        "part", "filter_order", "step", (zero("n") - zero("removed")).alias("kept"), zero("removed").alias("removed"), (F.col("fails") - zero("removed")).alias("redundant"), "unique_fails",
        zero("good_lost").alias("good_lost"), zero("toxic_lost").alias("toxic_lost"), "shapley",
    )


def oracle() -> str:
    """The same counts from the documents' patterns of failures, without states."""
    steps = ", ".join(f"('{o['filter_order']}', {o['step']}, {o['state']}, {_bit(o['filter'])})" for o in orders())
    return f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
f AS (SELECT d.doc_id, part, (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT
  + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
  + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS fails FROM d),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
p AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, fails),
s AS (SELECT * FROM (VALUES {steps}) v(filter_order, step, state, bit)),
r AS (SELECT part, filter_order, step, bit,
  coalesce(sum(n) FILTER (fails & (state | bit) = 0), 0)::BIGINT AS kept,
  coalesce(sum(n) FILTER (fails & state = 0 AND fails & bit > 0), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (fails & state > 0 AND fails & bit > 0), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (fails = bit), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (fails & state = 0 AND fails & bit > 0), 0)::BIGINT AS good_lost,
  coalesce(sum(toxic) FILTER (fails & state = 0 AND fails & bit > 0), 0)::BIGINT AS toxic_lost FROM p, s GROUP BY ALL)
SELECT * EXCLUDE (bit), sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley FROM r"""
