"""Exact top-k search by inner product over vectors sorted by length.

The axes are turned so that the first ones carry most of the length (eigenvectors of the summed outer
products). Within a task, vectors go by in order of falling length. A pair's product is first summed
over the leading turned axes; by Cauchy-Schwarz the rest is at most the product of the two residual
lengths. Pairs whose bound stays under the query's k-th score so far are skipped, the others are
scored with whole numbers. The longest vectors of all set the first k-th scores.

Queries and vectors meet in blocks: the pair (vector part, query block) is the key of an equi-join, so
no task holds all queries or all vectors.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from shiftledger.llm.common import stored, tasks

STEP = 512
QUERY_BLOCK = 4096
SEEDS = 256
FIRST_AXES = 16
_EXACT = float(1 << 53)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width))
    if len(values) == len(column) * width:
        out[:] = values.reshape(len(column), width)
    else:
        out[np.arange(width)[None, :] < lengths[:, None]] = values
    return out


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact also where doubles are not."""
    most = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(q.shape[1], 1)
    if most < _EXACT:
        return q @ x.T
    whole = [[int(v) for v in row] for row in x]
    return np.array([[sum(int(a) * b for a, b in zip(r, w)) for w in whole] for r in q], object)


def _merge(scores, ids, more, new_ids, k):
    """The k best of two lists per query; equal scores go to the smaller id."""
    scores = np.concatenate([scores, more], 1)
    ids = np.concatenate([ids, np.broadcast_to(new_ids, more.shape)], 1)
    order = np.lexsort((ids, -scores.astype(float)), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def best_of_block(q_ids, q, floors, x_ids, x, axes, k):
    """(query id, vector id, score) of each query's k best in one part, by the method above."""
    lengths = np.sqrt((x * x).sum(1))
    order = np.lexsort((x_ids, -lengths))
    x_ids, x = x_ids[order], x[order]
    r = min(FIRST_AXES, axes.shape[1])
    turned_q, turned_x = q @ axes, x @ axes
    rest_q = np.sqrt((turned_q[:, r:] ** 2).sum(1))
    rest_x = np.sqrt((turned_x[:, r:] ** 2).sum(1))
    length_q, length_x = np.sqrt((q * q).sum(1)), lengths[order]
    # Slack for rounding in the turned products.
    slack = 1e-9 * (1 + length_q * length_x.max(initial=0))
    scores = np.full((len(q), k), -np.inf)
    ids = np.full((len(q), k), np.iinfo(np.int64).max)
    for at in range(0, len(x), STEP):
        end = min(at + STEP, len(x))
        floor = np.maximum(floors, scores[:, -1].astype(float))
        live = np.flatnonzero(length_q * length_x[at] + slack >= floor)
        if not len(live):
            # Lengths only fall: no later vector can enter either.
            break
        bound = turned_q[live, :r] @ turned_x[at:end, :r].T + np.outer(
            rest_q[live], rest_x[at:end]
        )
        open_pairs = bound + slack[live, None] >= floor[live, None]
        open_pairs &= q_ids[live, None] != x_ids[None, at:end]
        rows = np.flatnonzero(open_pairs.any(1))
        cols = np.flatnonzero(open_pairs.any(0))
        if not len(rows):
            continue
        exact = _products(q[live[rows]], x[at:end][cols])
        exact = np.where(open_pairs[np.ix_(rows, cols)], exact, -np.inf)
        who = live[rows]
        if exact.dtype == object and scores.dtype != object:
            scores = scores.astype(object)
        scores[who], ids[who] = _merge(scores[who], ids[who], exact, x_ids[at:end][cols], k)
    found = ids != np.iinfo(np.int64).max
    row, col = np.nonzero(found)
    return q_ids[row], ids[row, col], [int(s) for s in scores[row, col]]


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id and ``v``: floor(256 x) of every component, as doubles.

    Rows without an id or a vector, or with a missing or non-finite component, take no part. Rows that share
    an id are candidates and queries each for itself. Other columns are left aside.
    """
    bad = F.exists(
        "embedding",
        lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))),
    )
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("double"))
    whole = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad)
    return whole.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def main_axes(vectors: DataFrame, width: int) -> np.ndarray:
    """Eigenvectors of the sum of outer products, longest first. Each task sends one square matrix."""

    def sums(batches):
        total = np.zeros((width, width))
        for b in batches:
            x = _matrix(b.column("v"), width)
            total += x.T @ x
        yield pa.RecordBatch.from_pydict({"g": [total.ravel().tolist()]})

    per_task = vectors.select("v").mapInArrow(sums, "g array<double>")
    cell = per_task.select(F.posexplode("g").alias("i", "g")).groupBy("i").agg(F.sum("g").alias("g"))
    gram = np.zeros(width * width)
    for row in cell.collect():
        gram[row["i"]] = row["g"]
    if not np.isfinite(gram).all() or not width:
        return np.eye(width)
    return np.linalg.eigh(gram.reshape(width, width))[1][:, ::-1].copy()


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest inner products among all other ids.

    Both frames hold ``vec_id`` and ``v`` as of ``whole_vectors``. Shorter vectors count as filled up
    with zeros. Equal scores go to the smaller vec_id. Vectors that share an id are listed each; queries that
    share an id have one list, of the best of all their scores. No vectors or no queries give no rows.
    """
    spark = vectors.sparkSession
    vectors = stored(vectors, "vectors")
    shape = vectors.agg(F.max(F.size("v")).alias("width"), F.count("*").alias("n")).first()
    width = max(shape["width"] or 0, 1)
    queries = stored(queries, "queries")
    blocks = max(1, math.ceil(queries.count() / QUERY_BLOCK))
    parts = max(1, min(tasks(spark), math.ceil((shape["n"] or 0) / (4 * STEP))))
    axes = main_axes(vectors, width)
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    seeds = vectors.orderBy(length.desc(), "vec_id").limit(SEEDS).collect()
    seed_ids = np.array([r["vec_id"] for r in seeds], np.int64)
    seed_x = np.zeros((len(seeds), width))
    for i, r in enumerate(seeds):
        seed_x[i, : len(r["v"])] = r["v"]

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        if left.num_rows and right.num_rows:
            x_ids = left.column("vec_id").to_numpy()
            q_ids = right.column("vec_id").to_numpy()
            x, q = _matrix(left.column("v"), width), _matrix(right.column("v"), width)
            # The k-th best among the longest vectors: no lower score can be in the result.
            floors = np.full(len(q), -np.inf)
            if len(seed_ids) > k:
                s = np.where(q_ids[:, None] == seed_ids[None, :], -np.inf, q @ seed_x.T)
                kth = np.sort(s, 1)[:, -k]
                floors = kth - 1e-9 * (1 + np.abs(kth))
            a, b, c = best_of_block(q_ids, q, floors, x_ids, x, axes, k)
            out = {"query_id": a, "vec_id": b, "score": c}
        return pa.table(
            {n: pa.array(v, pa.int64()) for n, v in out.items()},
        )

    each_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    each_part = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    of = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    left = vectors.select("*", of(parts).alias("part"), each_block.alias("block"))
    right = queries.select("*", each_part.alias("part"), of(blocks).alias("block"))
    found = (
        left.groupBy("part", "block")
        .cogroup(right.groupBy("part", "block"))
        .applyInArrow(search, "query_id long, vec_id long, score long")
    )
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
