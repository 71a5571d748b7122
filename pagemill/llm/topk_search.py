"""Exact top-k search: matrix products of query tiles and shards, partial selection, tree merging."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, batch, stored

#: Bytes of query vectors that are sent to all shards in one pass; more queries take more passes.
PASS_BYTES = 16 << 20
#: Rows of a tile's two sides.
QUERY_TILE, SHARD_TILE = 512, 4096
#: Sums of products below this are exact in double precision.
EXACT = 1 << 53
_NONE = np.iinfo(np.int64).min + 1


def quantized(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v array<double>): each component floor(scale * x), x as double; rows without id or with null or non-finite components are left out."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    odd = F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = v.where(F.col("vec_id").isNotNull() & F.col("e").isNotNull()).where(~odd)
    # from 2 ** 53 on a double is a whole number, and may be none that a long can hold
    whole = lambda y: F.when(F.abs(y) < float(EXACT), F.floor(y).cast("double")).otherwise(y)
    v = v.select("vec_id", F.transform("e", lambda x: whole(x * scale)).alias("v"))
    return v.where(~F.exists("v", lambda x: F.abs(x) == float("inf")))


def _product(q: np.ndarray, shard: np.ndarray) -> np.ndarray:
    """Exact inner products as longs: in double precision where no sum can reach 2 ** 53, else in whole numbers of any size."""
    if q.size == 0 or shard.size == 0 or q.shape[1] * np.abs(q).max() * np.abs(shard).max() < EXACT:
        return (q @ shard.T).astype(np.int64)
    exact = np.vectorize(int, otypes=[object])
    product = exact(q) @ exact(shard).T
    if max(abs(product.max()), abs(product.min())) >= 1 << 63:
        raise OverflowError("an inner product doesn't fit in 64 bits")
    return product.astype(np.int64)


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Columns of each row's k best by (score descending, id); partial selection first, ties at the edge kept whole."""
    n = score.shape[1]
    if n > 4 * k:
        edge = np.partition(score, n - k, axis=1)[:, n - k : n - k + 1]
        rows, columns = np.nonzero(score >= edge)
    else:
        rows, columns = np.nonzero(score > _NONE)
    order = np.lexsort((ids[columns], -score[rows, columns], rows))
    rows, columns = rows[order], columns[order]
    rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
    ok = (rank < k) & (score[rows, columns] > _NONE)
    return rows[ok], columns[ok]


def _partial(batches, queries: list[tuple[int, np.ndarray, np.ndarray]], k: int):
    """A shard's k best for each query: (query_id, vec_id, score, part), merged tile after tile."""
    import pyspark

    schema = arrow_schema("query_id long, vec_id long, score long, part int")
    part = pyspark.TaskContext.get().partitionId()
    tops = [(np.full((len(ids), k), _NONE), np.full((len(ids), k), np.iinfo(np.int64).max)) for _, ids, _ in queries]
    for b in batches:
        ids = b.column(0).to_numpy()
        v = b.column(1)
        sizes = np.diff(v.offsets.to_numpy())
        flat = v.flatten().to_numpy()
        at = np.r_[0, np.cumsum(sizes)]
        for (dim, qids, q), (score, vec) in zip(queries, tops, strict=True):
            mine = np.flatnonzero(sizes == dim)
            for s in range(0, len(mine), SHARD_TILE):
                rows = mine[s : s + SHARD_TILE]
                shard = flat[(at[rows][:, None] + np.arange(dim)).reshape(-1)].reshape(len(rows), dim)
                for t in range(0, len(qids), QUERY_TILE):
                    tile = slice(t, t + QUERY_TILE)
                    product = _product(q[tile], shard)
                    product[qids[tile, None] == ids[rows][None, :]] = _NONE
                    r, c = _best(product, ids[rows], k)
                    width = np.full((len(product), k), _NONE), np.full((len(product), k), np.iinfo(np.int64).max)
                    place = np.arange(len(r)) - np.searchsorted(r, r)
                    width[0][r, place], width[1][r, place] = product[r, c], ids[rows][c]
                    both = np.concatenate([score[tile], width[0]], 1), np.concatenate([vec[tile], width[1]], 1)
                    order = np.lexsort((both[1], -both[0]), axis=1)[:, :k]
                    score[tile], vec[tile] = np.take_along_axis(both[0], order, 1), np.take_along_axis(both[1], order, 1)
    for (_, qids, _), (score, vec) in zip(queries, tops, strict=True):
        for t in range(0, len(qids), QUERY_TILE):
            r, c = np.nonzero(score[t : t + QUERY_TILE] > _NONE)
            r += t
            yield batch(schema, qids[r], vec[r, c], score[r, c], np.full(len(r), part, np.int32))


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): of each query its k largest inner products, ties to the smaller vec_id.

    Both sides are (vec_id, v array<double>) with whole numbers; products are
    exact, and one beyond 64 bits is an error. All rows of a query's vec_id are
    its own and no candidates; of several query rows of a vec_id the one of the
    smallest vector asks. Vectors of different lengths aren't compared; a query
    without candidates has no rows. Repeated candidate rows each count. Empty
    tables give an empty result; other columns are not looked at.
    """
    queries = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    candidates = candidates.select("vec_id", "v")
    size = queries.agg(F.sum(F.size("v") * 8 + 16)).first()[0] or 0
    passes = max(1, -(-2 * size // PASS_BYTES)) if size > PASS_BYTES else 1
    found = None
    spark = queries.sparkSession
    for i in range(passes):
        part = queries if passes == 1 else queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == i)
        by: dict[int, list] = {}
        for r in part.orderBy("vec_id").collect():
            by.setdefault(len(r.v), []).append(r)
        sent = spark.sparkContext.broadcast([(dim, np.array([r.vec_id for r in x], np.int64), np.array([r.v for r in x], np.float64).reshape(len(x), dim)) for dim, x in by.items()])
        best = candidates.mapInArrow(lambda it, sent=sent: _partial(it, sent.value, k), "query_id long, vec_id long, score long, part int")
        if passes > 1:  # a pass ends before the next one's queries are sent
            best = stored(_ranked(best, k, ["query_id"]).drop("rank"), "pass")
            sent.unpersist()
        found = best if found is None else found.union(best)
    # the tree: lists of up to 32 shards are merged, then those
    found = _ranked(found, k, ["query_id", F.floor(F.col("part") / 32)])
    return _ranked(found, k, ["query_id"]).select("query_id", "rank", "vec_id", "score")


def _ranked(found: DataFrame, k: int, by: list) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
