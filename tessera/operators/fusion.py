"""Rank fusion, section pools, reranking order and confidence cuts, keyed by query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

RRF_K = 60
DIGITS = 12


def rrf(dense: DataFrame, lexical: DataFrame, k: int | Column = RRF_K, w_dense: float | Column = 1.0, w_lexical: float | Column = 1.0, key: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Weighted reciprocal ranks of two lists (query_id, chunk_id, rank).

    Ties: what the dense list has first, by its rank, then by the lexical rank.
    """
    by = [*key, "chunk_id"]
    both = dense.select(*by, F.col("rank").alias("d")).join(lexical.select(*by, F.col("rank").alias("b")), by, "full")
    score = F.coalesce(w_dense / (k + F.col("d")), F.lit(0.0)) + F.coalesce(w_lexical / (k + F.col("b")), F.lit(0.0))
    order = Window.partitionBy(*key).orderBy(F.desc(F.round("rrf_score", DIGITS)), F.col("d").asc_nulls_last(), F.col("b").asc_nulls_last())
    return both.withColumn("rrf_score", score).withColumn("rank", F.row_number().over(order)).select(*by, "rrf_score", "rank")


def section_pool(hits: DataFrame, limit: int, key: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """All hits of the first ``limit`` distinct parents (file and parent, or the hit itself where it has none)."""
    own = F.coalesce("parent_id", "chunk_id")
    rows = hits.withColumn("own_parent", own).withColumn("first", F.min("rank").over(Window.partitionBy(*key, "file_stem", "own_parent")))
    order = F.dense_rank().over(Window.partitionBy(*key).orderBy("first"))
    return rows.withColumn("place", order).filter(F.col("place") <= limit).drop("own_parent", "first", "place")


def one_per_parent(hits: DataFrame, key: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """The best child of each parent, with all children's texts in rank order as ``anchors``. Hits without a parent count as one parent."""
    return hits.groupBy(*key, "parent_id").agg(F.min("rank").alias("rank"), F.min_by("chunk_id", "rank").alias("chunk_id"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("anchors"))


def with_parent(children: DataFrame, parents: DataFrame) -> DataFrame:
    """The parent's text at each child; parents that no child names are dropped before the join."""
    wanted = children.select(F.col("parent_id").alias("chunk_id")).distinct()
    return children.join(parents.join(wanted, "chunk_id", "left_semi").select(F.col("chunk_id").alias("parent_id"), F.col("text").alias("parent_text")), "parent_id", "left")


def rerank_document(stem: Column, path: Column, parent: Column, child: Column, most: int = 2000, lead: int = 200, probe: int = 80) -> Column:
    """Text for a reranker: title line and the parent, a long one cut to a window that begins ``lead`` characters before the child."""
    at = F.locate(F.substring(child, 1, probe), parent) if isinstance(child, str) else F.instr(parent, F.substring(child, F.lit(1), F.lit(probe)))
    start = F.greatest(F.lit(1), F.when(at > 0, at - lead).otherwise(1))
    body = F.when(F.length(parent) <= most, parent).otherwise(F.substring(parent, start, F.lit(most)))
    return F.concat(stem, F.lit(" — "), path, F.lit("\n"), body)


def reranked(hits: DataFrame, scores: DataFrame, top_n: int) -> DataFrame:
    """By the reranker's score, or, for a query with any score missing, by the fused order (whose score then stands in). Rows: query_id, chunk_id, rrf_score, rank."""
    w = Window.partitionBy("query_id")
    rows = hits.join(scores, ["query_id", "chunk_id"], "left").withColumn("whole", F.count("rerank_score").over(w) == F.count("*").over(w))
    value = F.when(F.col("whole"), F.col("rerank_score")).otherwise(F.col("rrf_score"))
    rows = rows.withColumn("final_score", value).withColumn("place", F.row_number().over(w.orderBy(F.when(F.col("whole"), -F.col("final_score")), "rank")))
    return rows.filter(F.col("place") <= top_n).select("query_id", "chunk_id", "final_score", "place")


def confident(results: DataFrame, absolute: float, relative: float) -> DataFrame:
    """The top result and those with a score of at least both floors. Rows: query_id, rank, score."""
    top = F.first("score").over(Window.partitionBy("query_id").orderBy("rank"))
    return results.withColumn("top", top).filter((F.col("rank") == 1) | (F.col("score") >= F.greatest(F.lit(absolute), relative * F.col("top")))).drop("top")


def budgets(lengths: Column, total: int, floor: int, cap: int) -> Column:
    """Characters for each source in rank order: each takes up to ``cap``, and leaves ``floor`` (or its length, if less) for every later one."""
    need = lambda n: F.least(n, F.lit(floor))
    later = F.aggregate(lengths, F.lit(0).cast("bigint"), lambda a, n: a + need(n))

    def step(state, n):
        rest = state["later"] - need(n)
        own = F.greatest(F.least(n, F.lit(cap), state["free"] - rest), F.lit(0)).cast("int")
        return F.struct(rest.alias("later"), (state["free"] - own).alias("free"), F.concat(state["out"], F.array(own)).alias("out"))

    start = F.struct(later.alias("later"), F.lit(total).cast("bigint").alias("free"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(lengths, start, step)["out"]


def sweep(pairs: DataFrame, configs: DataFrame, top: int, pool: int) -> DataFrame:
    """(alpha, k, query_id, rank, in_pool, place, reranked) for every setting (alpha, k) and query that has hits.

    Pairs: (query_id, chunk_id, dense rank ``d``, lexical rank ``b``, parent_id, score, gold), each once: what is looked up or scored for a pair is so for all settings, which only order the pairs anew.
    ``rank`` is that of the first gold hit among the ``top``; the ``pool`` holds that many hits, of which the first of each parent stays, and these count as they stand (``place``) and in order of score (``reranked``; ties: as they stand).
    Each of the three is null where there is no gold hit. A hit without a parent is its own.
    """
    a, k, gold = F.col("alpha"), F.col("k"), F.col("gold")
    own = Window.partitionBy("alpha", "k", "query_id")
    fused = F.coalesce(2 * a / (k + F.col("d")), F.lit(0.0)) + F.coalesce(2 * (1 - a) / (k + F.col("b")), F.lit(0.0))
    rows = pairs.join(configs).withColumn("s", F.round(fused, DIGITS))
    ranked = rows.withColumn("rank", F.row_number().over(own.orderBy(F.desc("s"), F.col("d").asc_nulls_last(), F.col("b").asc_nulls_last()))).filter(F.col("rank") <= max(top, pool))
    inside = F.col("rank") <= pool
    first = F.row_number().over(Window.partitionBy("alpha", "k", "query_id", F.coalesce("parent_id", "chunk_id")).orderBy("rank"))
    rows = ranked.withColumn("leads", inside & (first == 1))
    place = F.sum(F.col("leads").cast("int")).over(own.orderBy("rank"))
    reranked = F.row_number().over(own.orderBy(F.desc("leads"), F.desc("score"), "rank"))
    rows = rows.withColumn("place", place).withColumn("reranked", reranked)
    lead = F.col("leads") & gold
    return rows.groupBy("alpha", "k", "query_id").agg(
        F.min(F.when(gold & (F.col("rank") <= top), F.col("rank"))).alias("rank"), F.bool_or(inside & gold).alias("in_pool"), F.min(F.when(lead, F.col("place"))).alias("place"), F.min(F.when(lead, F.col("reranked"))).alias("reranked")
    )
