"""Exact cosine search: blocks of queries against all vectors, partial top-k in every task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tessera.operators.lexical import DIGITS
from tessera.session import ship

#: Query vectors sent to every task at once; more queries are searched block by block.
BLOCK = 4096


def unit(v: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; zero rows stay zero, so their cosine is 0."""
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, n, out=np.zeros_like(v), where=n > 0)


def search(queries: DataFrame, vectors: DataFrame, k: int, dim: int, scope: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank) for queries (query_id, embedding) and vectors (chunk_id, embedding).

    A missing vector counts as zeros. Each task keeps k rows per query, so k rows per query and task are shuffled.
    ``scope`` (query_id, file_stem) is applied before any hit is dropped; a query without a row there has no hits. Chunk ids are ``stem#line`` then.
    """
    spark = queries.sparkSession
    ship(spark)
    zero = F.array_repeat(F.lit(0.0).cast("float"), dim)
    n = queries.count()
    source = vectors.select(F.col("chunk_id").cast("string"), F.coalesce("embedding", zero).alias("e"))
    if scope is not None:
        source = source.withColumn("file_stem", F.substring_index("chunk_id", "#", 1))
    out = None
    for block in range(-(-n // BLOCK) or 1):
        part = F.pmod(F.xxhash64(F.col("query_id").cast("long")), F.lit(max(1, -(-n // BLOCK)))) == block
        own = queries.filter(part)
        rows = own.select("query_id", F.coalesce("embedding", zero).alias("e")).collect()
        ids = np.array([r.query_id for r in rows], np.int64)
        held = spark.sparkContext.broadcast((ids, unit(np.array([r.e for r in rows], float).reshape(-1, dim))))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            ids, q = held.value
            best_s, best_c = np.zeros((len(ids), 0)), np.zeros((len(ids), 0), object)
            for b in batches:
                e = unit(b.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim))
                names = np.array(b.column(0).to_pylist(), object)
                seen = np.ones((len(ids), len(names)), bool)
                if b.num_columns > 2:
                    lists = b.column(2)
                    which, row = lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(names)), np.diff(np.asarray(lists.offsets)))
                    row, which = row[np.isin(which, ids)], which[np.isin(which, ids)]
                    order = np.argsort(ids)
                    seen[:] = False
                    seen[order[np.searchsorted(ids, which, sorter=order)], row] = True
                for lo in range(0, len(names), 2048):
                    s = np.where(seen[:, lo : lo + 2048], np.round(q @ e[lo : lo + 2048].T, DIGITS), -np.inf)
                    best_s = np.concatenate([best_s, s], 1)
                    best_c = np.concatenate([best_c, np.broadcast_to(names[lo : lo + 2048], s.shape)], 1)
                    order = np.stack([np.lexsort((c, -v))[:k] for c, v in zip(best_c, best_s, strict=True)]) if len(ids) else np.zeros((0, 0), int)
                    best_s, best_c = np.take_along_axis(best_s, order, 1), np.take_along_axis(best_c, order, 1)
            m = best_s.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, m)), pa.array(best_c.ravel().tolist(), pa.string()), pa.array(best_s.ravel())], names=["query_id", "chunk_id", "score"])

        searched = source
        if scope is not None:
            # a file's queries of this block, of which there are about BLOCK at most
            inside = scope.filter(part).groupBy("file_stem").agg(F.collect_set(F.col("query_id").cast("long")).alias("inside"))
            searched = source.join(inside, "file_stem").select("chunk_id", "e", "inside")
        found = searched.mapInArrow(run, "query_id long, chunk_id string, score double").filter(F.col("score") > float("-inf"))
        out = found if out is None else out.unionAll(found)
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return out.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def pairs(queries: DataFrame, vectors: DataFrame, within: DataFrame, dim: int) -> DataFrame:
    """(query_id, file_stem, chunk_id, score) for all vectors of the files that a query names (query_id, file_stem). A missing vector counts as zeros. Chunk ids are ``stem#line``."""
    zero = F.array_repeat(F.lit(0.0).cast("float"), dim)
    v = vectors.select("chunk_id", F.coalesce("embedding", zero).alias("e"), F.substring_index("chunk_id", "#", 1).alias("file_stem"))
    q = queries.select("query_id", F.coalesce("embedding", zero).alias("q")).join(within, "query_id")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    size = lambda a: F.sqrt(dot(a, a))
    cosine = F.coalesce(F.try_divide(dot("q", "e"), size("q") * size("e")), F.lit(0.0))
    return q.join(v, "file_stem").select("query_id", "file_stem", "chunk_id", F.round(cosine, DIGITS).alias("score"))
