"""Periodic runs of words, by maximal pairs over the LCP-interval tree of each text.

A run of period q and length L is the maximal pair of its words from the start on and from q words later on: equal for L - q words and neither to be extended. So the tree
is walked from the bottom: an interval of depth l joins its children, each a set of places in classes by the word to their left, and a place of one child and a place of another
with another word to the left are a maximal pair of length l. Those at a distance q of at most l / 3 (the run then has four periods) are runs as they stand; a class is searched only
inside that distance, and the smaller child is always laid into the larger one. A multiple of the period gives the same stretch, of which the smallest distance is kept.

Suffixes are ranked by doubling, all texts of a block at once; a place whose next words stand nowhere else in its text drops out, and so do all that share fewer than
``LEAST_LENGTH - 1`` words with another. What is in one task at a time is one text.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tessera.llm.blocks import blocks, mix, number, utf8, word_table, words
from tessera.session import ship

#: A run has so many words at least, and so many periods.
LEAST_LENGTH, PERIODS = 6, 4

#: Words are taken as they are written: no letter is lower-cased.
_AS_WRITTEN = (np.arange(256, dtype=np.uint8), word_table("space")[1])

RUNS = "array<struct<start:long,length:long,period:long>>"


def _ranked(code: np.ndarray, end: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... words, and the places whose first four words stand elsewhere too, in suffix order.

    ``code`` numbers words so that those of two texts differ, ``end`` is where the text of each place ends. A rank is the number of smaller suffixes, so only the
    places of a tie are ranked anew.
    """
    n = len(code)
    rank = np.zeros(n, np.int64)
    order = np.argsort(code, kind="stable")
    new = np.ones(n, bool)
    new[1:] = code[order[1:]] != code[order[:-1]]
    heads = np.flatnonzero(new)
    rank[order] = np.repeat(heads, np.diff(np.append(heads, n)))
    levels, wide, tied, kept = [rank], 1, _tied(order, heads, n), None
    while True:
        if wide == 4:
            kept = tied
        if not len(tied):
            break
        after = tied + wide
        inside = after < end[tied]
        second = np.where(inside, rank[np.minimum(after, n - 1)], -1)
        turn = np.lexsort((second, rank[tied]))
        tied, second = tied[turn], second[turn]
        first = rank[tied]
        group, sub = np.ones(len(tied), bool), np.ones(len(tied), bool)
        group[1:] = first[1:] != first[:-1]
        sub[1:] = group[1:] | (second[1:] != second[:-1])
        at = np.arange(len(tied))
        rank = rank.copy()
        rank[tied] = first + np.maximum.accumulate(np.where(sub, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))
        wide *= 2
        levels.append(rank)
        tied = _tied(tied, np.flatnonzero(sub), len(tied))
    if kept is None:
        return levels, np.zeros(0, np.int64)
    return levels, kept[np.argsort(rank[kept], kind="stable")]


def _tied(order: np.ndarray, heads: np.ndarray, n: int) -> np.ndarray:
    size = np.diff(np.append(heads, n))
    return order[np.repeat(size > 1, size)]


def _shared(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Words that the suffixes at a and b have in common at their beginning."""
    out, last = np.zeros(len(a), np.int64), len(levels[0]) - 1
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + out, b + out
        same = (x < end[a]) & (y < end[b]) & (levels[k][np.minimum(x, last)] == levels[k][np.minimum(y, last)])
        out[same] += 1 << k
    return out


def _pairs(one: dict[int, list[int]], other: dict[int, list[int]], depth: int, found: dict[tuple[int, int], int]) -> dict[int, list[int]]:
    """Notes the maximal pairs between two children of an interval and joins them."""
    if sum(map(len, one.values())) < sum(map(len, other.values())):
        one, other = other, one
    most = depth // (PERIODS - 1)
    for left, places in other.items():
        for x in places:
            for word, there in one.items():
                if word != left:
                    for k in range(bisect_left(there, x - most), bisect_right(there, x + most)):
                        y = there[k]
                        q, run = abs(x - y), (min(x, y), depth + abs(x - y))
                        if run not in found or q < found[run]:
                            found[run] = q
    for left, places in other.items():
        if left in one:
            mine = one[left]
            for x in places:
                insort(mine, x)
        else:
            one[left] = places
    return one


def _walk(places: list[int], common: list[int], left: list[int], found: dict[tuple[int, int], int]) -> None:
    """The intervals over some neighbours in suffix order, from the bottom; ``common[k]`` is what places k - 1 and k share."""
    open_: list[tuple[int, dict[int, list[int]]]] = []
    now = {left[0]: [places[0]]}
    for k in range(1, len(places)):
        depth = common[k]
        while open_ and open_[-1][0] > depth:
            d, had = open_.pop()
            now = _pairs(had, now, d, found)
        if open_ and open_[-1][0] == depth:
            now = _pairs(open_.pop()[1], now, depth, found)
        open_.append((depth, now))
        now = {left[k]: [places[k]]}
    while open_:
        d, had = open_.pop()
        now = _pairs(had, now, d, found)


def runs_of(h: np.ndarray, first: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
    """(start, length, period) of all runs of each text that has any, by start and period. ``h`` are the word hashes of all texts in a row, ``first`` is where each text's begin."""
    if not len(h):
        return {}
    size = np.diff(first)
    text, end = np.repeat(np.arange(len(size)), size), np.repeat(first[1:], size)
    code = mix(h + text.astype(np.uint64) * number(7000))
    levels, places = _ranked(code, end)
    if not len(places):
        return {}
    common = np.zeros(len(places), np.int64)
    common[1:] = _shared(levels, places[:-1], places[1:], end)
    left = np.where(places > first[text[places]], levels[0][places - 1], -1)
    least = LEAST_LENGTH - 1
    cuts = np.append(np.flatnonzero(common < least), len(places))
    all_places, all_common, all_left = places.tolist(), common.tolist(), left.tolist()
    found: dict[tuple[int, int], int] = {}
    for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if e - s > 1:
            _walk(all_places[s:e], all_common[s:e], all_left[s:e], found)
    out: dict[int, list[tuple[int, int, int]]] = {}
    for (start, length), q in found.items():
        t = int(text[start])
        out.setdefault(t, []).append((start - int(first[t]), length, q))
    return {t: sorted(runs, key=lambda r: (r[0], r[2])) for t, runs in out.items()}


def _collapsed(text: bytes, runs: list[tuple[int, int, int]]) -> bytes:
    """The words of a text, joined by one space, without those that repeat in a run."""
    w = text.split()
    if not runs:
        return b" ".join(w)
    gone = np.zeros(len(w) + 1, np.int64)
    for start, length, q in runs:
        gone[start + q] += 1
        gone[start + length] -= 1
    return b" ".join([x for x, k in zip(w, np.cumsum(gone).tolist(), strict=False) if not k])


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, runs (start, length and period in words, by start, then period) and collapsed, the text's words without the repeats of any run.

    A word is what stands between ASCII white space, as written; a run is a longest stretch of words with smallest period q, ``LEAST_LENGTH`` words and ``PERIODS`` periods at least. A word goes if any
    run has it after that run's first period. Null, empty and white-space texts have no runs and collapse to an empty text. Repeated rows give a row each, a null
    doc_id is handed on, an empty table gives no rows; other columns are not looked at. Words are compared by 64-bit hashes.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = utf8(b.column(1))
            for i, j in blocks(at):
                part, where = data[at[i] : at[j]], at[i : j + 1] - at[i]
                h, _, first = words(part, where, _AS_WRITTEN)
                found, raw = runs_of(h, first), part.tobytes()
                runs = [[{"start": s, "length": n, "period": q} for s, n, q in found.get(k, ())] for k in range(j - i)]
                texts = [_collapsed(raw[where[k] : where[k + 1]], found.get(k, [])) for k in range(j - i)]
                kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(runs, kind), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "runs", "collapsed"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("t")).mapInArrow(run, f"doc_id long, runs {RUNS}, collapsed string")


def with_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text), every tenth text made periodic from some word on, so that there is something to find.

    With h the CRC-32 of the decimal doc_id (of nothing where it is null) and g = floor(h / 10): where h % 10 = 0, each of n words from a = g % n on becomes
    word a + (i - a) % p of the text, p = 1 + floor((n - a) / (3 + g % 8)); words are then joined by one space. Other texts stay as they are.
    """
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", h.alias("h"))
    rows = rows.withColumn("w", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))))
    g = F.floor(F.col("h") / 10)
    rows = rows.withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, g % F.col("n")))
    rows = rows.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + g % 8)))

    def moved(word: Column, i: Column) -> Column:
        return F.when(i < F.col("a"), word).otherwise(F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))

    return rows.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(F.transform("w", moved), " ")).otherwise(F.col("text")).alias("text"))


def summary(found: DataFrame) -> DataFrame:
    """Of each row of ``periodic_runs``: n_runs, the longest run (of equal ones the first, then that of the smallest period; null without runs) with its exponent in thousandths, and digests of the runs and the collapsed text."""
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("x"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length = -F.col("x.less")
    return out.select("doc_id", "n_runs", F.col("x.start").alias("start"), length.alias("length"), F.col("x.period").alias("period"), F.floor(1000 * length / F.col("x.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
