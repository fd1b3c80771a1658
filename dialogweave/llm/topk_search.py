"""Exact top-k inner product search by elimination with a pivot table.

Every vector carries its distances to a few pivots. For a query q and a vector x,
|d(q,p) - d(x,p)| bounds d(q,x) from below for every pivot p; the greatest of these bounds
bounds the inner product (|q|^2 + |x|^2 - d^2) / 2 from above. Candidates are evaluated in
order of this bound, the likeliest first and then all whose bound reaches the k-th best score
found, a block of queries at a time as one matrix product.

Queries and vectors are cut into blocks; a task handles one block of queries against one group
of vectors and returns at most k rows a query, so nothing is gathered whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK = 4096
VECTOR_BLOCK = 8192
#: Queries whose bounds are computed in one go.
TOGETHER = 64
EXACT = float(1 << 52)


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Pivots far from each other: each the vector farthest from those before it."""
    if not len(sample):
        return sample
    first = int(np.argmax((sample * sample).sum(axis=1)))
    chosen, far = [first], ((sample - sample[first]) ** 2).sum(axis=1)
    while len(chosen) < min(count, len(sample)):
        following = int(np.argmax(far))
        if far[following] <= 0:
            break
        chosen.append(following)
        far = np.minimum(far, ((sample - sample[following]) ** 2).sum(axis=1))
    return sample[chosen]


def _distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squares = (vectors * vectors).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None, :]
    return np.sqrt(np.maximum(squares - 2.0 * vectors @ pivots.T, 0.0))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def _bounds(points: np.ndarray, far: np.ndarray, norms: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Upper bounds of the inner products of points and vectors, from their distances to the
    pivots. Rounding may only raise a bound, so that nothing is left out by it."""
    apart = np.zeros((len(points), len(norms)))
    for p in range(near.shape[1]):
        np.maximum(apart, np.abs(far[:, p, None] - near[None, :, p]), out=apart)
    above = (points * points).sum(axis=1)[:, None] + norms[None, :]
    return (above - apart * apart) / 2 + 1e-6 * (above + 1)


def _top(k: int, pivots: np.ndarray):
    width = pivots.shape[1]

    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        first_found: list[tuple] = []
        done: list[tuple] = []
        if queries.num_rows and vectors.num_rows:
            qs, xs = _matrix(queries.column("q"), width), _matrix(vectors.column("q"), width)
            ids, names = queries.column("id").to_numpy(), vectors.column("id").to_numpy()
            largest = float(max(np.abs(qs).max(initial=0), np.abs(xs).max(initial=0)))
            # Integer inner products; in floating point only where that is exact.
            small = largest * largest * width < EXACT
            floats = xs.astype(float)
            norms = (floats * floats).sum(axis=1)
            near = _distances(floats, pivots)
            for first in range(0, len(qs), TOGETHER):
                some = slice(first, first + TOGETHER)
                points = qs[some].astype(float)
                bound = _bounds(points, _distances(points, pivots), norms, near)
                bound[ids[some][:, None] == names[None, :]] = -np.inf
                now = min(4 * k, len(names))
                likely = np.argpartition(-bound, now - 1, axis=1)[:, :now]
                # The likeliest first: their k-th score is what the others' bounds have to reach.
                for i, query in enumerate(qs[some]):
                    open_ = likely[i][bound[i, likely[i]] > -np.inf]
                    scores = (floats[open_] @ points[i]).astype(np.int64) if small else xs[open_] @ query
                    keep = _best(scores, names[open_], k)
                    first_found.append((ids[first + i], open_[keep], scores[keep]))
                    bound[i, open_] = -np.inf
                    if len(keep) == k:
                        bound[i, bound[i] < scores[keep][-1]] = -np.inf
                left = bound > -np.inf
                columns = np.flatnonzero(left.any(axis=0))
                product = points @ floats[columns].T if small and len(columns) else None
                for i, query in enumerate(qs[some]):
                    name, at, found = first_found.pop(0)
                    more = np.flatnonzero(left[i, columns])
                    if len(more):
                        scores = product[i, more].astype(np.int64) if small else xs[columns[more]] @ query
                        if len(found) == k:
                            more, scores = more[scores >= found[-1]], scores[scores >= found[-1]]
                        at, found = np.concatenate([at, columns[more]]), np.concatenate([found, scores])
                        keep = _best(found, names[at], k)
                        at, found = at[keep], found[keep]
                    done.append((np.full(len(at), name), names[at], found))
        columns = [pa.array(np.concatenate(c), pa.int64()) for c in zip(*done)] or [pa.array([], pa.int64())] * 3
        return pa.table(columns, names=["query_id", "vec_id", "score"])

    return run


def quantized(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component; NULL where a component is NULL or not finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(finite, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")))


def top_inner_products(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    scale: int = 64,
    pivots: int = 16,
    pivot_sample: int = 4096,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``is_query``, the k highest integer
    inner products with the other rows, ties to the smaller id.

    Rows with NULL id, a NULL or empty vector, or NULL or non-finite components take no part.
    A query meets vectors of its own length only. Rows that repeat an id count as one if their
    vectors are equal; else each answers and is answered by itself, but not by its own id.
    Components beyond the range of long are cut off at its ends. Only the id, the vector and
    what ``is_query`` names are read.

    Pivots come from ``pivot_sample`` vectors at most, the least by a hash of the id; they
    decide how much is eliminated, never the result.
    """
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"), quantized(F.col(vector_col), scale).alias("q"), is_query.alias("asks")
    ).where("id is not null and size(q) > 0")
    rows = rows.distinct()
    lengths = [r["n"] for r in rows.select(F.size("q").alias("n")).distinct().collect()]
    schema = "query_id long, vec_id long, score long"
    found = vectors.sparkSession.createDataFrame([], schema)
    for width in lengths:
        same = rows.where(F.size("q") == width)
        sample = same.orderBy(F.xxhash64("id"), "id").limit(pivot_sample).select("q").toPandas()["q"]
        chosen = choose_pivots(np.array(sample.tolist(), float).reshape(-1, width), pivots)
        counts = same.agg(F.count("*").alias("n"), F.count_if("asks").alias("asks")).first()
        query_blocks = max(1, -(-counts["asks"] // QUERY_BLOCK))
        vector_blocks = max(1, -(-counts["n"] // VECTOR_BLOCK))
        asked = same.where("asks").select(
            "id", "q",
            F.pmod(F.xxhash64("id"), F.lit(query_blocks)).alias("i"),
            F.explode(F.sequence(F.lit(0).cast("long"), F.lit(vector_blocks - 1).cast("long"))).alias("j"),
        )
        given = same.select(
            "id", "q",
            F.explode(F.sequence(F.lit(0).cast("long"), F.lit(query_blocks - 1).cast("long"))).alias("i"),
            F.pmod(F.xxhash64("id"), F.lit(vector_blocks)).alias("j"),
        )
        pairs = asked.groupBy("i", "j").cogroup(given.groupBy("i", "j"))
        found = found.union(pairs.applyInArrow(_top(k, chosen), schema))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
