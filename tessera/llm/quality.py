"""Quality classifier: regularised quadratic discriminant over transformed statistics of a text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tessera.llm.blocks import BLOCK_BYTES, blocks, utf8, word_table, words
from tessera.session import settle, ship

#: Pseudo-counts that draw the rates of short texts to the usual ones.
PRIOR = 30.0

#: Shares of the pooled covariance and of its diagonal in each class covariance.
POOL, DIAGONAL = 0.10, 0.05

#: Rows of this remainder of crc32(doc_id as text) mod 5 are held out of the fit.
FOLDS, HELD_OUT = 5, 0

THRESHOLD = 0.3

FEATURES = ["upper", "digit", "stop", "mark", "symbol", "pipe", "bang", "other", "space", "line", "word_length", "distinct", "top", "tail", "size"]

# Usual rates by byte (or by word for the last ones), to which short texts are drawn.
_USUAL = {"upper": 0.02, "digit": 0.002, "stop": 0.015, "mark": 0.01, "symbol": 0.002, "pipe": 0.001, "bang": 0.001, "other": 0.05, "space": 0.17, "line": 0.003}


def _classes() -> dict[str, np.ndarray]:
    """Byte classes; ``upper`` also counts the second bytes of Latin-1 capitals after 0xC3, see ``statistics``."""
    of = lambda s: np.isin(np.arange(256), [ord(c) for c in s])
    return {
        "upper": of("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "digit": of("0123456789"), "stop": of(".?"), "mark": of(",;:'\"()-"), "symbol": of("#$%&*+/<=>@[\\]^_`{}~"),
        "pipe": of("|"), "bang": of("!"), "other": np.arange(256) >= 128, "space": of(" \t"), "line": of("\n\r"),
    }


def statistics(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text; logs of rates, so that ratios count."""
    n = len(at) - 1
    size = np.diff(at).astype(float)
    out = np.zeros((n, len(FEATURES)))
    for k, (name, hit) in enumerate(_classes().items()):
        where = np.flatnonzero(hit[data])
        if name == "upper":
            lead = np.flatnonzero(data[:-1] == 0xC3) if len(data) else np.zeros(0, int)
            where = np.sort(np.concatenate([where, lead[(data[lead + 1] >= 0x80) & (data[lead + 1] <= 0x9E)]]))
        count = np.diff(np.searchsorted(where, at))
        out[:, k] = np.log((count + PRIOR * _USUAL[name]) / (size + PRIOR) + 1e-4)
    h, row, first = words(data, at, word_table("space"))
    w = np.diff(first)
    out[:, 10] = np.log((size + PRIOR * 6.0) / (w + PRIOR))
    if len(h):
        order = np.lexsort((h, row))
        hs, rs = h[order], row[order]
        new = np.ones(len(hs), bool)
        new[1:] = (hs[1:] != hs[:-1]) | (rs[1:] != rs[:-1])
        starts = np.flatnonzero(new)
        runs = np.diff(np.append(starts, len(hs)))
        distinct = np.bincount(rs[starts], minlength=n)
        top = np.zeros(n)
        np.maximum.at(top, rs[starts], runs)
        once = np.bincount(rs[starts][runs == 1], minlength=n)
    else:
        distinct = once = np.zeros(n)
        top = np.zeros(n)
    # Vocabulary grows as a power of the length; what is left is the deviation from it.
    out[:, 11] = np.log((distinct + PRIOR) / ((w + PRIOR) ** 0.9))
    out[:, 12] = np.log((top + PRIOR * 0.05) / (w + PRIOR))
    out[:, 13] = np.log((once + PRIOR) / (distinct + PRIOR))
    out[:, 14] = np.log(size + PRIOR)
    return out


def features(docs: DataFrame, keep: list[Column], text: str = "text") -> DataFrame:
    """``keep`` columns (given names of their own) and the feature array of each row's whole text; null counts as empty."""
    ship(docs.sparkSession)
    source = docs.select(*keep, F.col(text).alias("text_to_score"))
    kept = [f for f in source.schema.fields if f.name != "text_to_score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = utf8(b.column(len(kept)))
            parts = [statistics(data[at[i] : at[j]], at[i : j + 1] - at[i]) for i, j in blocks(at)]
            flat = np.concatenate(parts).ravel() if parts else np.zeros(0)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, len(FEATURES), dtype=np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], lists], names=[*(f.name for f in kept), "x"])

    return source.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", x array<double>")


@dataclass
class Discriminant:
    """Class means, Cholesky factors of class covariances (inverted once) and log prior odds."""

    mean: list[np.ndarray]
    whiten: list[np.ndarray]
    log_det: list[float]
    log_prior: list[float]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Chance of class 1."""
        density = []
        for k in (0, 1):
            z = (x - self.mean[k]) @ self.whiten[k].T
            density.append(self.log_prior[k] - 0.5 * self.log_det[k] - 0.5 * np.einsum("ij,ij->i", z, z))
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def fit(sums: list[tuple[float, np.ndarray, np.ndarray]], pool: float = POOL, diagonal: float = DIAGONAL) -> Discriminant:
    """From (n, sum of x, sum of x x') of classes 0 and 1. A class without rows takes the other's moments and a prior of one row."""
    d = len(FEATURES)
    n = [max(s[0], 0.0) for s in sums]
    if not sum(n):
        n, sums = [1.0, 1.0], [(1.0, np.zeros(d), np.eye(d))] * 2
    moments = []
    for k in (0, 1):
        c, s, q = sums[k] if n[k] else sums[1 - k]
        mean = s / c
        moments.append((mean, q / c - np.outer(mean, mean)))
    pooled = (n[0] * moments[0][1] + n[1] * moments[1][1]) / sum(n)
    whiten, log_det = [], []
    for k in (0, 1):
        own = (1 - pool) * moments[k][1] + pool * pooled
        own = (1 - diagonal) * own + diagonal * np.diag(np.diag(pooled)) + 1e-6 * np.eye(d)
        factor = np.linalg.cholesky(own)
        whiten.append(np.linalg.inv(factor))
        log_det.append(2 * float(np.log(np.diag(factor)).sum()))
    share = [np.log((n[k] + 1) / (sum(n) + 2)) for k in (0, 1)]
    return Discriminant([m[0] for m in moments], whiten, log_det, share)


def moments(labelled: DataFrame) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """(n, sum of x, sum of x x') of classes 0 and 1 from rows of ``label`` and ``x``: summed per task, then over tasks; a few hundred numbers reach the driver."""
    d = len(FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
        for b in batches:
            y = b.column(0).to_numpy(zero_copy_only=False)
            x = b.column(1).flatten().to_numpy().reshape(-1, d)
            for k in (0, 1):
                own = x[y == k]
                n[k] += len(own)
                s[k] += own.sum(0)
                q[k] += own.T @ own
        flat = np.concatenate([n, s.ravel(), q.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat)], names=["i", "v"])

    got = {r.i: r.v for r in labelled.select("label", "x").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()}
    flat = np.array([got.get(i, 0.0) for i in range(2 + 2 * d + 2 * d * d)])
    n, s, q = flat[:2], flat[2 : 2 + 2 * d].reshape(2, d), flat[2 + 2 * d :].reshape(2, d, d)
    return [(n[k], s[k], q[k]) for k in (0, 1)]


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def train(rows: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality") -> Discriminant:
    """Fit on all labelled rows outside the held-out fold. ``rows`` has the key as ``doc_id`` and the features; only these reach the model.

    Null keys and labels are passed over, a key with several labels counts with its largest.
    """
    known = labels.groupBy(F.col(key).cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label")).filter("doc_id IS NOT NULL AND label IN (0, 1)").filter(~held_out(F.col("doc_id")))
    return fit(moments(rows.select("doc_id", "x").join(known, "doc_id")))


def score(rows: DataFrame, model: Discriminant) -> DataFrame:
    """Adds ``score`` (0 to 1) and ``predicted`` in the place of the feature array, which must be the last column."""
    kept = rows.schema.fields[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(len(kept)).flatten().to_numpy().reshape(-1, len(FEATURES))
            p = model.score(x)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], names=[*(f.name for f in kept), "score", "predicted"])

    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", score double, predicted int")


def document_features(docs: DataFrame) -> DataFrame:
    """doc_id, held_out and features of every row, written once: the fit and the scores both start from here."""
    return settle(features(docs, [F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out")]))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Null and empty texts are scored by the usual rates; equal texts get equal scores; a null doc_id is never held out. An
    empty table gives no rows; without labels every score is 0.5.
    """
    rows = document_features(docs)
    return score(rows, train(rows, labels))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text is predicted good. Texts are scored and rows dropped in one pass.

    Null and empty texts are judged by the usual rates and equal texts alike, so repeated rows stay or go together; a null doc_id may stay. Without labels every score is 0.5
    and all rows stay. An empty table stays empty.
    """
    model = train(document_features(docs), labels)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = utf8(b.column(place))
            for i, j in blocks(at, 8 * BLOCK_BYTES):
                part = at[i : j + 1] - at[i]
                own = data[at[i] : at[j]]
                x = np.concatenate([statistics(own[part[k] : part[m]], part[k : m + 1] - part[k]) for k, m in blocks(part)])
                yield b.slice(i, j - i).filter(pa.array(model.score(x) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
