"""Exact histogram of encoded lengths, and what suffix sums over it answer for every context limit."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tessera.llm.tokenize import WIDE_MEMO, library_encoder
from tessera.session import settle, ship

#: Lengths summed in one window; blocks of lengths are summed in a second, much shorter one.
BLOCK = 1024

#: Context limits that the query asks for besides the lengths that occur.
LIMITS = tuple(1 << k for k in range(7, 21))


def lengths(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """``n_tokens`` of every row; null and empty texts have 0."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = library_encoder(tokenizer, WIDE_MEMO)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(encode(x.as_py())) // 4 for x in b.column(0)], pa.int64())], names=["n_tokens"])

    return docs.select(F.col(text).alias("t")).mapInArrow(run, "n_tokens long")


def length_table(counted: DataFrame, limits: DataFrame | None = None) -> DataFrame:
    """From rows with ``n_tokens``: one row per length that occurs or that ``limits`` (``context_limit``) asks for.

    n_docs of that length (0 for a limit that is no document's length); docs_at_least and tokens_at_least of that length or longer (suffix sums);
    tokens_truncated, the total when each text is cut at that length; docs_whole and share_at_most, the documents that fit whole. Null lengths and limits are
    passed over. An empty table gives no rows, for limits neither.
    """
    found = counted.filter("n_tokens IS NOT NULL").groupBy("n_tokens").agg(F.count("*").alias("n_docs"))
    if limits is not None:
        asked = limits.select(F.col("context_limit").cast("long").alias("n_tokens"), F.lit(0).cast("long").alias("n_docs")).filter("n_tokens IS NOT NULL")
        found = found.unionAll(asked).groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))
    hist = settle(found.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)))
    part = hist.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)  # a row per block of lengths
    whole = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    part = part.select("block", F.coalesce(F.sum("d").over(later), F.lit(0)).alias("d_after"), F.coalesce(F.sum("t").over(later), F.lit(0)).alias("t_after"), F.sum("d").over(whole).alias("d_all"), F.sum("t").over(whole).alias("t_all"))
    own = Window.partitionBy("block").orderBy(F.desc("n_tokens"))
    rows = hist.join(part.filter("d_all > 0"), "block").withColumns(
        {
            "docs_at_least": F.col("d_after") + F.sum("n_docs").over(own),
            "tokens_at_least": F.col("t_after") + F.sum(F.col("n_docs") * F.col("n_tokens")).over(own),
        }
    )
    fits = F.col("d_all") - (F.col("docs_at_least") - F.col("n_docs"))
    cut = F.col("t_all") - F.col("tokens_at_least") + F.col("docs_at_least") * F.col("n_tokens")
    return rows.select("n_tokens", "n_docs", "docs_at_least", "tokens_at_least", cut.alias("tokens_truncated"), fits.alias("docs_whole"), (fits / F.col("d_all")).alias("share_at_most"))


def at_limits(counted: DataFrame, limits: DataFrame) -> DataFrame:
    """For each distinct limit (``context_limit``): documents that fit, documents cut, tokens kept. The limits take part in the suffix sums as lengths without documents."""
    asked = limits.select(F.col("context_limit").cast("long").alias("context_limit"))
    rows = length_table(counted, limits).withColumnRenamed("n_tokens", "context_limit").join(asked, "context_limit", "left_semi")
    return rows.select("context_limit", "docs_whole", (F.col("docs_at_least") - F.col("n_docs")).alias("docs_cut"), F.col("tokens_truncated").alias("tokens_kept"))


def quantiles(table: DataFrame, at: list[float]) -> DataFrame:
    """The smallest length that at least that share of all documents does not exceed."""
    parts = [table.filter(F.col("share_at_most") >= q).agg(F.min("n_tokens").alias("n_tokens")).select(F.lit(float(q)).alias("q"), "n_tokens") for q in at]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def token_counts(docs: DataFrame, tokenizer: str, limits: tuple[int, ...] = LIMITS) -> DataFrame:
    """``length_table`` of the documents' encoded lengths and of ``limits``. A null or empty text has no tokens; an empty table gives no rows."""
    asked = docs.sparkSession.createDataFrame([(x,) for x in limits], "context_limit long")
    return length_table(lengths(docs, tokenizer), asked)
