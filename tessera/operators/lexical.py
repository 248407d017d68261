"""BM25: index statistics and batch search, keyed by query."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.functions.text import tokens
from tessera.session import settle, ship, sized

K1, B, FLOOR = 1.5, 0.75, 0.25

#: Scores are compared at this many digits, so that sums in another order are still ties.
DIGITS = 9


def is_noise(path: Column) -> Column:
    """Form templates and bare appendix labels. Fixed values of the corpus' own headings."""
    marks = ("Mẫu biên bản", "Mẫu Biên bản", "Mẫu giấy", "Mẫu Giấy", "(Quy định)")
    out = path.rlike(r"^Phụ lục\s+\S+$")
    for m in marks:
        out = out | path.contains(m)
    return out


@dataclass
class Index:
    """chunks (chunk_id, t, dl) with the tokens in the row, terms (term, df, idf), totals (n, avgdl; one row for each scope) and texts (chunk_id, text) in lower case."""

    chunks: DataFrame
    terms: DataFrame
    totals: DataFrame
    texts: DataFrame
    key: tuple[str, ...] = ()

    @property
    def postings(self) -> DataFrame:
        """(term, chunk_id, tf, dl) of all terms; searches count those of their own terms only."""
        return _counted(self.chunks.select(*self.key, "chunk_id", "dl", F.explode("t").alias("term")), self.key)

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        return search(queries, self, k)

    def search_within(self, queries: DataFrame, scope: DataFrame, k: int) -> DataFrame:
        return search(queries, self, k, scope)

    def scores_within(self, queries: DataFrame, scope: DataFrame) -> DataFrame:
        """(query_id, file_stem, chunk_id, score) of the chunks of the files that a query names (query_id, file_stem), as far as they are positive."""
        return scores(queries, self, scope).filter(F.col("score") > 0).withColumn("file_stem", F.substring_index("chunk_id", "#", 1))


def _counted(rows: DataFrame, key: tuple[str, ...]) -> DataFrame:
    return rows.groupBy(*key, "chunk_id", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


#: The bytes of ``TOKEN_ENDS``; none is part of a longer character.
_ENDS = np.zeros(256, bool)
_ENDS[list(b" \t\n\v\f\r,;!()[]{}<>\"'\\|")] = True

#: Bytes of text cut into words at once; a longer text is a piece of its own.
PIECE_BYTES = 1 << 22


def pieces(batch: pa.RecordBatch, text: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, pa.Array]]:
    """Rows of a batch with ``tokens`` of their lower-cased texts: (rows, where each row's begin and one more for the end, the tokens in a row). A null text has none."""
    column = batch.column(text)
    if column.null_count:
        column = pc.fill_null(column, "")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    _, where, data = column.buffers()
    at = np.frombuffer(where, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + PIECE_BYTES, side="right")) - 1)
        own, begin = data[at[i] : at[j]], at[i : j + 1] - at[i]
        inside = ~_ENDS[own]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        new = begin[:-1][begin[:-1] < begin[1:]]
        first[new] = inside[new]
        starts = np.flatnonzero(first)
        before = np.cumsum(inside) - inside
        offsets = np.append(before[starts], np.count_nonzero(inside)).astype(np.int64)
        words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(own[inside]))
        yield batch.slice(i, j - i), np.searchsorted(starts, begin), words.cast(pa.string())
        i = j


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a scope, where there is one, and text) to (scope, term, df, tokens): chunks that hold a term; without a term, the chunks and their tokens."""
    for b in batches:
        for rows, where, words in pieces(b, "text"):
            n = np.diff(where)
            codes = words.dictionary_encode()
            width = max(1, len(codes.dictionary))
            held = np.sort(np.repeat(np.arange(len(n)) * width, n) + codes.indices.to_numpy(zero_copy_only=False))
            held = held[np.diff(held, prepend=-1) > 0]
            scopes = rows.column(0).dictionary_encode(null_encoding="encode") if rows.num_columns > 1 else None
            scope = scopes.indices.to_numpy(zero_copy_only=False).astype(np.int64) if scopes is not None else np.zeros(len(n), np.int64)
            some, df = np.unique(scope[held // width] * width + held % width, return_counts=True)
            groups, chunks = np.unique(scope, return_counts=True)
            term = pa.concat_arrays([codes.dictionary.take(pa.array(some % width)), pa.nulls(len(groups), pa.string())])
            tokens_of = np.bincount(scope, n, minlength=len(chunks)).astype(np.int64)[groups]
            columns = {"term": term, "df": pa.array(np.append(df, chunks).astype(np.int64)), "tokens": pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(tokens_of)])}
            own = {rows.schema.names[0]: scopes.dictionary.take(pa.array(np.append(some // width, groups)))} if scopes is not None else {}
            yield pa.RecordBatch.from_pydict(own | columns)


def build(chunks: DataFrame, scope: str | None = None) -> Index:
    """Index of rows (chunk_id, indexed), a row for each chunk. What is shuffled is at most a count for each term and piece of text, never a row for each term and chunk.

    ``scope`` names a column within whose values all statistics are counted (and which is then part of every key).
    """
    key = (scope,) if scope else ()
    t = chunks.select(*key, "chunk_id", tokens(F.col("indexed")).alias("t")).withColumn("dl", F.size("t"))
    texts = chunks.filter("indexed IS NOT NULL").select(*key, "chunk_id", F.lower("indexed").alias("text"))
    ship(chunks.sparkSession)
    # one pass for both: rows without a term count chunks and tokens
    own = "".join(f"`{c}` {dict(chunks.dtypes)[c]}, " for c in key)
    counted = texts.select(*key, "text").mapInArrow(_frequencies, f"{own}term string, df long, tokens long")
    df = settle(counted.groupBy(*key, "term").agg(F.sum("df").alias("df"), F.sum("tokens").alias("tokens")))
    totals = df.filter("term IS NULL").select(*key, F.col("df").alias("n"), (F.col("tokens") / F.col("df")).alias("avgdl"))
    if not scope:  # one row, also of no chunks
        totals = totals.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), F.max("avgdl").alias("avgdl"))
    df = df.filter("term IS NOT NULL").drop("tokens")
    raw = (df.join(totals, scope) if scope else df.join(F.broadcast(totals))).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.groupBy(*key).agg(F.avg("raw").alias("mean"))
    terms = (raw.join(mean, scope) if scope else raw.join(F.broadcast(mean))).select(*key, "term", "df", F.when(F.col("raw") < 0, FLOOR * F.col("mean")).otherwise(F.col("raw")).alias("idf"))
    return Index(t, terms, totals, texts, key)


def scores(queries: DataFrame, index: Index, scope: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, score): sum over query tokens with repetition. Tokens that no query has are dropped in the scan, before anything is counted by chunk or shuffled.

    With ``scope`` (query_id, file_stem) only the chunks of a query's own files are scored; chunk ids are ``stem#line`` then. Term weights stay those of the whole index.
    For searches over a corpus that is asked again and again see ``kept``.
    """
    key = index.key
    q = queries.select(*key, "query_id", F.explode(tokens(F.col("query"))).alias("term")).groupBy(*key, "query_id", "term").agg(F.count("*").alias("qtf"))
    wanted = sized(q.join(index.terms, [*key, "term"]))
    asked = sized(q.select(*key, "term").distinct())
    chunks = index.chunks
    if scope is not None:
        stems = sized(scope.select("file_stem").distinct())
        chunks = chunks.withColumn("file_stem", F.substring_index("chunk_id", "#", 1)).join(stems, "file_stem", "left_semi")
    postings = _counted(chunks.select(*key, "chunk_id", "dl", F.explode("t").alias("term")).join(asked, [*key, "term"], "left_semi"), key)
    if scope is not None:
        own = scope.select("query_id", "file_stem").distinct()
        postings = postings.withColumn("file_stem", F.substring_index("chunk_id", "#", 1)).join(own, "file_stem").drop("file_stem")
        rows = postings.join(wanted, [*key, "query_id", "term"])
    else:
        rows = postings.join(wanted, [*key, "term"])
    rows = rows.join(index.totals, list(key)) if key else rows.join(F.broadcast(index.totals))
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return rows.groupBy(*key, "query_id", "chunk_id").agg(F.sum(part).alias("score"))


def top(scored: DataFrame, k: int, *key: str) -> DataFrame:
    """``rank`` 1 to k per query by score, ties by chunk id."""
    by = Window.partitionBy(*(key or ("query_id",))).orderBy(F.desc(F.round("score", DIGITS)), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def search(queries: DataFrame, index: Index, k: int, scope: DataFrame | None = None) -> DataFrame:
    """Top ``k`` chunks with a positive score, of a query's own files (query_id, file_stem) where there is a ``scope``."""
    return top(scores(queries, index, scope).filter(F.col("score") > 0), k)
