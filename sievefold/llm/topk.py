"""Exact top-k search by exhaustive term-at-a-time accumulation.

A term is a dimension.  Candidates of a block are held as postings: for each term the
rows with a non-zero weight, and these weights.  A query scatters weight times posting
into a dense score array over the block's rows, term by term; the k best are selected
by partition, and the blocks' lists are merged by a window over k rows a block.

Queries and candidates are cut into bounded blocks; every pair of blocks is one group,
so the work spreads over tasks whatever the sizes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import materialize, n_groups

K = 10
SCALE = 1024
QUERY_BLOCK = 2048
CANDIDATE_BLOCK = 32_768
MIN_TASKS = 12
#: Sums stay exact in int64 while |q|_1 * max|v| is below this.
_EXACT = 1 << 62


def quantize(vector: Column) -> Column:
    """floor(SCALE * x) of every component, x as double; null where the vector is null
    or holds a null or non-finite component."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf)))
    return F.when(vector.isNotNull() & ~F.coalesce(bad, F.lit(True)), F.transform(wide, lambda x: F.floor(x * SCALE)))


def top_of_block(q_ids: np.ndarray, queries: list[np.ndarray], c_ids: np.ndarray, candidates: list[np.ndarray], k: int) -> tuple[list, list, list]:
    """The k best rows of one block of candidates for each query: (query, row, score)."""
    order = np.argsort(c_ids, kind="stable")
    c_ids = c_ids[order]
    size = np.array([len(candidates[i]) for i in order])
    flat = np.concatenate([candidates[i] for i in order]) if len(order) else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(order)), size)
    term = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    some = flat != 0
    by_term = np.argsort(term[some], kind="stable")
    term, row, weight = term[some][by_term], row[some][by_term], flat[some][by_term]
    n_terms = int(term.max()) + 1 if len(term) else 0
    edge = np.searchsorted(term, np.arange(n_terms + 1))
    biggest = int(np.abs(weight).max()) if len(weight) else 0
    full = [edge[t + 1] - edge[t] == len(c_ids) for t in range(n_terms)]
    out_q, out_row, out_score = [], [], []
    for q_id, q in zip(q_ids.tolist(), queries, strict=True):
        exact = int(np.abs(q.astype(object)).sum()) * biggest < _EXACT if len(q) else True
        scores = np.zeros(len(c_ids), np.int64 if exact else object)
        for t in np.flatnonzero(q[:n_terms]).tolist():
            a, b = edge[t], edge[t + 1]
            add = (weight[a:b] if exact else weight[a:b].astype(object)) * (q[t] if exact else int(q[t]))
            if full[t]:
                scores += add
            else:
                scores[row[a:b]] += add
        own = np.flatnonzero(c_ids != q_id)
        s = scores[own]
        if len(s) > k:
            # all rows above the k-th score, then the smallest ids among its equals
            cut = np.partition(s, len(s) - k)[len(s) - k] if exact else sorted(s)[-k]
            above = np.flatnonzero(s > cut)
            level = np.flatnonzero(s == cut)[: k - len(above)]
            pick = np.concatenate([above, level])
        else:
            pick = np.arange(len(s))
        out_q += [q_id] * len(pick)
        out_row += c_ids[own[pick]].tolist()
        out_score += [max(-(1 << 63), min((1 << 63) - 1, int(x))) for x in s[pick].tolist()]
    return out_q, out_row, out_score


def top_k(vectors: DataFrame, queries: Column, k: int = K, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of every row
    for which ``queries`` holds against every other row, ties to the smaller vec_id.

    Rows with a null id take no part, nor do null vectors and those with null or
    non-finite components.  Vectors of different lengths score over the terms they share;
    an empty vector scores 0.  A repeated id is one row for each of its vectors, a query's
    own id never among its results.  Scores beyond a long stop at its ends.  An empty
    table, or one without queries, gives an empty result.
    """
    rows = materialize(vectors.select(F.col(vec_id).cast("long").alias("id"), F.coalesce(queries, F.lit(False)).alias("is_query"), quantize(F.col(embedding)).alias("v")).where("id IS NOT NULL AND v IS NOT NULL"))
    n, asked = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("is_query").cast("long")), F.lit(0))).first()
    q_blocks, c_blocks = n_groups(asked, QUERY_BLOCK), max(MIN_TASKS, n_groups(n, CANDIDATE_BLOCK))
    h = F.xxhash64("id", "v")
    left = rows.where("is_query").select("id", "v", F.pmod(h, F.lit(q_blocks)).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1))).alias("cb"))
    right = rows.select("id", "v", F.pmod(h, F.lit(c_blocks)).cast("int").alias("cb"), F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("qb"))

    def run(key: tuple, q: pa.Table, c: pa.Table) -> pa.Table:
        def split(t: pa.Table) -> list[np.ndarray]:
            lists = t.column("v").combine_chunks()
            if isinstance(lists, pa.ChunkedArray):
                lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], pa.list_(pa.int64()))
            to = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            return np.split(lists.flatten().to_numpy(), to[:-1]) if len(to) else []

        found = top_of_block(q.column("id").to_numpy(), split(q), c.column("id").to_numpy(), split(c), k)
        return pa.table([pa.array(x, pa.int64()) for x in found], names=["query_id", "vec_id", "score"])

    best = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def oracle(k: int = K) -> str:
    return f"""
WITH v AS (SELECT vec_id, [floor({SCALE} * x::DOUBLE)::BIGINT for x in embedding] AS w FROM embeddings
  WHERE embedding IS NOT NULL AND NOT coalesce(list_bool_or([x IS NULL OR NOT isfinite(x) for x in embedding]), false)),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum([a[1] * a[2] for a in [[q.w[i], c.w[i]] for i in range(1, len(q.w) + 1)]])::BIGINT AS score
  FROM v q, v c WHERE q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= {k}"""
