"""Range partitioning by sampled splitters, weighted by size. DataFrame functions only."""

from __future__ import annotations

import bisect
import itertools

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.session import settle

#: Ranges a shard's worth of bytes is cut into, and records drawn for each range.
RANGES_PER_SHARD, DRAWS = 8, 32

#: A range is overfull at this many times its fair share of bytes, its largest record apart.
OVERFULL = 2.0


def _splitters(spark, bounds: list) -> Column:
    return F.from_json(F.lit("[" + ",".join(f'{{"k":{"null" if k is None else k},"tie":{t}}}' for k, t in bounds) + "]"), "array<struct<k:bigint,tie:bigint>>")


def _order(x: tuple) -> tuple:
    """Null keys first, as Spark orders them."""
    return (x[0] is not None, x[0] or 0, x[1])


def _place(rows: DataFrame, bounds: list) -> DataFrame:
    """``part``: how many splitters are at or below the record."""
    record = F.struct("k", "tie")
    return rows.withColumn("part", F.size(F.filter(_splitters(rows.sparkSession, bounds), lambda b: b <= record)) if bounds else F.lit(0))


def _draw(rows: DataFrame, expected: int, total: int, salt: int) -> list:
    """Keys of about ``expected`` records, drawn with chances in proportion to size; sorted. The draw is by hash, so it can be repeated."""
    chance = F.col("size") * F.lit(float(expected) / max(total, 1))
    at = F.pmod(F.xxhash64("tie", F.lit(salt)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return sorted(((r.k, r.tie) for r in rows.filter(at < chance).select("k", "tie").collect()), key=_order)


def _cuts(drawn: list, bounds: list, wanted: dict[int, int]) -> list:
    """For each overfull range (ascending) as many quantiles of what was drawn from it as are wanted."""
    out, at = [], 0
    for p, n in wanted.items():
        upto = len(drawn) if p == len(bounds) else bisect.bisect_left(drawn, _order(bounds[p]), key=_order)
        own, at = drawn[at:upto], upto
        out += [own[(i + 1) * len(own) // (n + 1)] for i in range(n) if own]
    return out


def shard(docs: DataFrame, shards: int = 40, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Deal rows to ``shards`` runs of near equal bytes in key order.

    A record's size is its text's UTF-8 bytes plus 16 (null: 16). Splitters from a size-weighted sample cut the keys into
    ranges; overfull ranges are cut again by a fresh sample of their own, until none is left. Ranges' exact bytes give each its place, and running
    sums inside a range each record's: a record goes to the shard that holds the middle of its bytes, so a shard
    is off its fair share by one record at most. ``slot`` counts a shard's records in that order.

    A null key comes first. Rows with one key are ordered by a tie number of their own, so a key that very many rows
    share is cut like any other range. Repeated rows are all placed; an empty table gives no rows.
    """
    rows = settle(
        docs.select(
            F.col(key).cast("long").alias("k"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
            F.crc32(F.coalesce(F.col(text), F.lit(""))).alias("text_crc32"),
            F.xxhash64(F.monotonically_increasing_id()).alias("tie"),
        )
    )
    total = rows.agg(F.sum("size")).first()[0] or 0
    ranges = shards * RANGES_PER_SHARD
    drawn = _draw(rows, ranges * DRAWS, total, 0)
    bounds = [drawn[i * len(drawn) // ranges] for i in range(1, ranges) if drawn]
    for again in itertools.count(1):
        bounds = sorted(set(bounds), key=_order)
        placed = _place(rows, bounds)
        filled = {r.part: (r.size, r.n, r.top) for r in placed.groupBy("part").agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.max("size").alias("top")).collect()}
        over = {p: size for p, (size, _, top) in sorted(filled.items()) if size - top > OVERFULL * total / ranges}
        if not over:
            break
        inside = sum(over.values())
        extra = _draw(placed.filter(F.col("part").isin(list(over))), DRAWS * (1 + inside * ranges // total), inside, again)
        bounds = bounds + _cuts(extra, bounds, {p: max(1, round(size * ranges / total) - 1) for p, size in over.items()})
    start = []
    begun = counted = 0
    for p in range(len(bounds) + 1):
        start.append((p, begun, counted))
        begun, counted = begun + filled.get(p, (0, 0, 0))[0], counted + filled.get(p, (0, 0, 0))[1]
    starts = F.from_json(F.lit("[" + ",".join(f'{{"b":{b},"n":{n}}}' for _, b, n in start) + "]"), "array<struct<b:bigint,n:bigint>>")[F.col("part")]
    order = Window.partitionBy("part").orderBy("k", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    middle = starts["b"] + F.sum("size").over(order) - F.col("size") + F.expr("size div 2")
    ordered = settle(
        placed.select(
            "k", "size", "text_crc32",
            F.least(F.lit(shards - 1), F.floor(middle.cast("decimal(38,0)") * shards / F.lit(max(total, 1)))).cast("int").alias("shard"),
            (starts["n"] + F.count("*").over(order) - 1).alias("at"),
        )
    )
    first = ordered.groupBy("shard").agg(F.min("at").alias("first"))  # a row per shard
    return ordered.join(F.broadcast(first), "shard").select(F.col("k").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("at") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
