"""Exact top-k inner products with bounds from segment statistics.

A vector is cut into 1, 2, 4, … segments, each known by its mean and its deviation. For two vectors, the squared distance is at least the
sum over segments of length * ((difference of means)^2 + (difference of deviations)^2), which bounds their inner product from
above: |q|^2 + |c|^2 - 2 * product = squared distance. The bounds go from coarse to fine; only candidates whose bound reaches the query's
tenth best product so far get the next one, and the survivors their exact product.

Queries and candidates meet in cells of a grid of blocks of bounded size. A cell returns the best of its block for each query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialise
from .groups import whole_groups

CANDIDATES, QUERIES = 65_536, 16_384    # rows of a block at most, on average
CELLS, LEAST = 64, 1_024                # a smaller table is cut into so many blocks, of so many candidates at least
AT_ONCE = 128
SEED_LEVEL = 2
FINEST = 32


def quantised(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component, null unless all components are finite numbers."""
    whole = F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, whole)


def _levels(vectors: np.ndarray) -> list[np.ndarray]:
    """Features of each level; the product of two vectors' features of a level bounds their inner product from above."""
    dim = vectors.shape[1]
    out, n = [], 1
    while n <= min(FINEST, dim):
        edges = np.linspace(0, dim, n + 1).astype(int)[:-1]
        length = np.diff(np.append(edges, dim)).astype(float)
        total = np.add.reduceat(vectors, edges, axis=1)
        square = np.add.reduceat(vectors * vectors, edges, axis=1)
        deviation = np.sqrt(np.maximum(square - total * total / length, 0))
        out.append(np.concatenate([total / np.sqrt(length), deviation], axis=1))
        n *= 2
    return out


def best_in_block(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row of the query, ids, products) of the k best vectors of a block for each query; ties go to smaller ids, a query's own id is left out."""
    order = np.argsort(ids, kind="stable")
    vectors, ids = vectors[order], ids[order]
    exact_in_floats = max(np.abs(queries).max(initial=0), np.abs(vectors).max(initial=0)) ** 2 * max(1, vectors.shape[1]) < 2**53
    plain, plain_queries = vectors.astype(float), queries.astype(float)
    exact = (plain, plain_queries) if exact_in_floats else (vectors, queries)
    fine, fine_queries = _levels(plain), _levels(plain_queries)
    level = min(SEED_LEVEL, len(fine) - 1) if fine else -1
    for at in range(0, len(queries), AT_ONCE):
        bounds = fine_queries[level][at:at + AT_ONCE] @ fine[level].T if fine else np.zeros((len(queries[at:at + AT_ONCE]), len(ids)))
        for row, bound in enumerate(bounds, at):
            slack = 1e-9 * (1 + np.abs(bound).max(initial=0))
            own = ids == query_ids[row]
            bound[own] = -np.inf
            n = int(len(ids) - own.sum())
            if n == 0:
                continue
            take = min(k, n)
            seed = np.argpartition(-bound, take - 1)[:take] if take < len(ids) else np.flatnonzero(~own)
            reach = (exact[0][seed] @ exact[1][row]).min() - slack
            left = np.flatnonzero((bound >= reach) & ~own)
            for finer, finer_queries in zip(fine[level + 1:], fine_queries[level + 1:]):
                if len(left) <= 4 * k:
                    break
                left = left[finer[left] @ finer_queries[row] >= reach]
            products = (exact[0][left] @ exact[1][row]).astype(np.int64)
            best = np.lexsort((ids[left], -products))[:k]
            yield row, ids[left][best], products[best]


def _search_batches(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for table, bounds in whole_groups(batches, ["dim", "block", "query_block"]):
        dims, asks = table.column("dim").to_numpy(), table.column("asks").to_numpy(zero_copy_only=False)
        ids = table.column("vec_id").to_numpy()
        values = table.column("vector")
        for start, end in zip(bounds[:-1], bounds[1:]):
            rows = values.slice(start, end - start).combine_chunks()
            matrix = rows.flatten().to_numpy(zero_copy_only=False).reshape(end - start, dims[start])
            ask, own_ids = asks[start:end], ids[start:end]
            out = list(best_in_block(matrix[ask], own_ids[ask], matrix[~ask], own_ids[~ask], k))
            if out:
                asked = own_ids[ask]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat([asked[r] for r, _, _ in out], [len(i) for _, i, _ in out]), pa.int64()),
                    pa.array(np.concatenate([i for _, i, _ in out]), pa.int64()), pa.array(np.concatenate([s for _, _, s in out]), pa.int64())],
                    ["query_id", "vec_id", "score"])


def top_products(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (query_id, rank, vec_id, score) with each query's k highest integer inner products, ties to the smaller id.

    ``is_query`` is a condition on a column named ``vec_id``. Candidates are all other rows with as many components as the query. Vectors that are null or have null or non-finite components take
    no part, nor do rows without an id; of rows with one id, the one with the smallest vector does. With fewer candidates than k all are returned,
    with none, or an empty table, no rows. Other columns are ignored. Products beyond 64 bits are not supported.
    """
    rows = materialise(vectors.select(F.col(id_col).alias("vec_id"), quantised(F.col(vector_col), scale).alias("vector")).where(
        "vec_id is not null and vector is not null").groupBy("vec_id").agg(F.min("vector").alias("vector")).withColumn("asks", is_query), "vectors")
    n = rows.agg(F.count(F.lit(1)).alias("all"), F.count(F.when(F.col("asks"), 1)).alias("asks")).first()
    blocks = max(-(-n["all"] // CANDIDATES), min(CELLS, -(-n["all"] // LEAST)), 1)
    query_blocks = max(1, -(-n["asks"] // QUERIES))
    block, query_block = (F.pmod(F.xxhash64(F.lit(what), "vec_id"), F.lit(m)).cast("int") for what, m in (("c", blocks), ("q", query_blocks)))

    def every(m: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(m - 1)))

    dim = F.size("vector").alias("dim")
    candidates = rows.select("vec_id", "vector", dim, F.lit(False).alias("asks"), block.alias("block"), every(query_blocks).alias("query_block"))
    queries = rows.where("asks").select("vec_id", "vector", dim, F.lit(True).alias("asks"), every(blocks).alias("block"), query_block.alias("query_block"))
    cell = ["dim", "block", "query_block"]
    found = candidates.unionByName(queries).repartition(blocks * query_blocks, *cell).sortWithinPartitions(*cell).mapInArrow(
        lambda batches: _search_batches(batches, k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
