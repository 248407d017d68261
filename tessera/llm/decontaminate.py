"""Benchmark decontamination: rare n-gram seeds lead from training passages to test items, Smith-Waterman alignment scores them.

An alignment of ``LEAST_SCORE`` or more of an item of n words has at least n / 2 - 1 matched words whose next matched word follows with one error at most. So it holds at least
so many of the item's n - 1 seeds: two words, next to each other or with one between, in the item as in the document. All seeds are counted over the corpus;
of each item only the rarest are searched, about two thirds, so that at least a third of the n / 2 - 1 are among them wherever the commonest stand. A run of words
that many items and documents share leads nowhere unless the document holds rarer seeds of the item as well.

The test items (in blocks of ``BLOCK_WORDS`` words) are sent to all tasks. Where a document holds enough of an item's rare seeds within the words that an alignment can span, these words are a
passage of that item. A passage without enough of the item's words to reach ``LEAST_SCORE`` is left out; all others are aligned, and a pair is reported if its score reaches ``LEAST_SCORE`` of a full
match. Every bound is a necessary condition, so no pair that scores enough is lost. Items of fewer than ``LEAST_WORDS`` words are found only as they stand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.llm.blocks import blocks, mix, number, utf8, word_table, words
from tessera.session import settle, ship

#: Items of fewer words have no seeds; their whole sequence is one.
LEAST_WORDS = 3

# Alignment of words: a match, another word in its place, a word too many or too few.
MATCH, MISMATCH, GAP = 2, -1, -1
LEAST_SCORE = 0.5

#: Words of test items held by a task at once; more are taken in blocks of items, each a pass over the corpus.
BLOCK_WORDS = 2_000_000

#: Cells of one batch of alignments, and seeds in documents times items looked at together.
CELLS = 1 << 20
SEED_PAIRS = 1 << 20


def _words_of(column) -> tuple[np.ndarray, np.ndarray]:
    data, at = utf8(column)
    h, _, first = words(data, at, word_table("plain"))
    return h, first


def _table(wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes, and a bit table that passes few others."""
    size = 1 << max(16, int(len(wanted)).bit_length() + 4)
    bits = np.zeros(size, bool)
    bits[(wanted & np.uint64(size - 1)).astype(np.int64)] = True
    return wanted, bits


def _hits(g: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Where in ``g`` wanted hashes stand."""
    wanted, bits = table
    if not len(wanted) or not len(g):
        return np.zeros(0, np.int64)
    near = np.flatnonzero(bits[(g & np.uint64(len(bits) - 1)).astype(np.int64)])
    at = np.minimum(np.searchsorted(wanted, g[near]), len(wanted) - 1)
    return near[wanted[at] == g[near]]


def item_words(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """item_id and its word hashes. Items without words go."""
    ship(items.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, first = _words_of(b.column(1))
            words_ = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), words_], names=["item_id", "item_words"])

    source = items.select(F.col(key).cast("long").alias("item_id"), F.col(text).alias("t")).filter("item_id IS NOT NULL")
    return source.mapInArrow(run, "item_id long, item_words array<long>").filter("size(item_words) > 0")


def _runs(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, place) of each run of ``k`` < ``LEAST_WORDS`` words."""
    n = np.maximum(np.diff(first) - k + 1, 0)
    at = _spread(first[:-1], n)
    g = np.full(len(at), number(9000 + k))
    for i in range(k):
        g += h[at + i] * number(9010 + i)
    return mix(g), np.repeat(np.arange(len(n)), n), at


def _seeds(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, place) of each two words of a text that are next to each other or have one between; the place is that of the first."""
    one, two = h * number(9020), h * number(9021)
    parts = []
    for apart in (1, 2):
        n = np.maximum(np.diff(first) - apart, 0)
        at = _spread(first[:-1], n)
        parts.append((mix(one[at] + two[at + apart]), np.repeat(np.arange(len(n)), n), at))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _all_seeds(h: np.ndarray, first: np.ndarray, short: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seeds of documents, and runs of the sizes ``short``."""
    parts = [_seeds(h, first), *(_runs(h, first, k) for k in short)]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


Items = dict[str, np.ndarray]


def _items_of(block: pa.Table) -> Items:
    """A block of items: ids, word hashes, where each item's begin, and all seeds: hash, item, place."""
    column = block.column("item_words").combine_chunks()
    at = np.asarray(column.offsets).astype(np.int64)
    h = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    first = at - at[0]
    size = np.diff(first)
    g, item, place = _seeds(h, first)
    long = size[item] >= LEAST_WORDS
    g, item, place = g[long], item[long], place[long]
    for k in range(1, LEAST_WORDS):
        whole = _runs(h, first, k)
        some = size[whole[1]] == k
        g, item, place = (np.concatenate([x, y[some]]) for x, y in zip((g, item, place), whole, strict=True))
    return {"ids": block.column("item_id").to_numpy(), "words": h, "first": first, "seed": g, "item": item, "place": place - first[item]}


def _rarest(items: Items, runs: np.ndarray, often: np.ndarray) -> Items:
    """The items with the seeds that are to be searched: ``runs`` (sorted hashes), for each the items and places that have it, and how many places each item ``need``s.

    ``often`` says how often each of ``runs`` stands in the corpus. Of n - 1 places an alignment holds n / 2 - 1 or more, ``t``; so of all but the t - need commonest it holds ``need``.
    """
    size = np.diff(items["first"])
    t = np.maximum((size + 1) // 2 - 1, 1)
    need = np.maximum(t // 3, 1)
    g, item, place = items["seed"], items["item"], items["place"]
    # Places by how often their seeds stand in the corpus, commonest first.
    slot = items["first"][item] + place
    weight = np.bincount(slot, often[np.searchsorted(runs, g)], minlength=len(items["words"]))
    owner = np.repeat(np.arange(len(size)), size)
    has = np.bincount(slot, minlength=len(owner)) > 0
    order = np.lexsort((-weight, ~has, owner))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order)) - items["first"][owner[order]]
    keep = rank[slot] >= (t - need)[item]
    g, item, place = g[keep], item[keep], place[keep]
    order = np.argsort(g, kind="stable")
    runs, begin = np.unique(g[order], return_index=True)
    return {"ids": items["ids"], "words": items["words"], "first": items["first"], "runs": runs, "begin": np.append(begin, len(g)), "item": item[order], "place": place[order], "need": need}


def _part(known: Items, p: int, parts: int) -> Items:
    """The seeds of every ``parts``-th item."""
    keep = known["item"] % parts == p
    before = np.concatenate([[0], np.cumsum(keep)])
    return known | {"begin": before[known["begin"]], "item": known["item"][keep], "place": known["place"][keep]}


def _spread(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """begin[k], begin[k] + 1, ... (n[k] of them) for each k."""
    return np.arange(n.sum()) + np.repeat(begin - (np.cumsum(n) - n), n)


def _candidates(run: np.ndarray, pos: np.ndarray, doc: np.ndarray, h: np.ndarray, first: np.ndarray, known: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc, item, from, to): the words of documents that an alignment of ``LEAST_SCORE`` can cover, if they hold enough of the item's rare seeds and of its words.

    Such an alignment has at most as many words too many as the item has words. So all its seeds stand within twice the item's length, and it begins no more
    than (place + length) words before one of them. Places that overlap are one.
    """
    n = known["begin"][run + 1] - known["begin"][run]
    at = _spread(known["begin"][run], n)
    item, place, doc, pos = known["item"][at], known["place"][at], np.repeat(doc, n), np.repeat(pos, n)
    order = np.lexsort((pos, item, doc))
    item, place, doc, pos = item[order], place[order], doc[order], pos[order]
    size = known["first"][item + 1] - known["first"][item]
    # Words of the document with a seed of an item, and those of them that stand close enough to as many as are needed.
    other = np.ones(len(doc), bool)
    other[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (pos[1:] != pos[:-1])
    u = np.flatnonzero(other)
    need = known["need"][item[u]]
    last = np.minimum(np.arange(len(u)) + need - 1, len(u) - 1)
    enough = (np.arange(len(u)) + need <= len(u)) & (doc[u[last]] == doc[u]) & (item[u[last]] == item[u]) & (pos[u[last]] - pos[u] <= 2 * size[u])
    over = np.zeros(len(u) + 1, np.int64)
    np.add.at(over, np.flatnonzero(enough), 1)
    np.add.at(over, last[enough] + 1, -1)
    held = np.cumsum(over)[:-1][np.cumsum(other) - 1] > 0 if len(u) else other
    item, place, doc, pos, size = item[held], place[held], doc[held], pos[held], size[held]
    zero = pos - place
    lo, hi = np.maximum(zero - size, first[doc]), np.minimum(zero + 2 * size, first[doc + 1])
    order = np.lexsort((lo, item, doc))
    doc, item, lo, hi = doc[order], item[order], lo[order], hi[order]
    # An interval may reach beyond a later one only by its place, so the furthest end so far decides.
    reach = hi.copy()
    same = (doc[1:] == doc[:-1]) & (item[1:] == item[:-1])
    group = np.concatenate([[0], np.cumsum(~same)]) if len(doc) else np.zeros(0, np.int64)
    far = np.int64(h.size + 1)
    reach = np.maximum.accumulate(reach + group * far) - group * far
    new = np.ones(len(doc), bool)
    new[1:] = ~same | (lo[1:] > reach[:-1])
    s = np.flatnonzero(new)
    doc, item, lo, hi = doc[s], item[s], lo[s], reach[np.append(s[1:], len(new)) - 1] if len(s) else hi
    keep = np.zeros(len(s), bool)
    cost = np.cumsum(hi - lo)
    i = 0
    while i < len(s):
        j = max(i + 1, int(np.searchsorted(cost, cost[i] + SEED_PAIRS)))
        keep[i:j] = _enough(item[i:j], lo[i:j], hi[i:j], h, known)
        i = j
    return doc[keep], item[keep], lo[keep], hi[keep]


def _enough(item: np.ndarray, lo: np.ndarray, hi: np.ndarray, h: np.ndarray, known: dict[str, np.ndarray]) -> np.ndarray:
    """Whether the words of a passage that stand in the item as well could reach ``LEAST_SCORE`` if all of them matched."""
    size = known["first"][item + 1] - known["first"][item]
    salt = mix(np.arange(1, len(item) + 1, dtype=np.uint64))
    there = np.unique(h[_spread(lo, hi - lo)] ^ np.repeat(salt, hi - lo))
    asked = known["words"][_spread(known["first"][item], size)] ^ np.repeat(salt, size)
    found = there[np.minimum(np.searchsorted(there, asked), len(there) - 1)] == asked
    held = np.add.reduceat(found.astype(np.int64), np.cumsum(size) - size)
    return held >= LEAST_SCORE * size


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman score of one pair, and the passage's aligned words [from, to). See ``_align_batch``."""
    return tuple(int(x[0]) for x in _align_batch([item], [passage]))


def _align_batch(items: list[np.ndarray], passages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Local alignment of many pairs side by side: a row of the table per item word, all passage words at once.

    Gaps along the row are a running maximum. Each cell carries where its alignment began.
    """
    n, rows, cols = len(items), max(map(len, items)), max(map(len, passages))
    a, b = np.zeros((n, rows), np.uint64), np.zeros((n, cols), np.uint64)
    la, lb = np.array([len(x) for x in items]), np.array([len(x) for x in passages])
    for k in range(n):
        a[k, : la[k]], b[k, : lb[k]] = items[k], passages[k]
    inside = np.arange(cols) < lb[:, None]
    slope = -GAP * np.arange(cols + 1)
    # A cell is score * big + (big - 1 - start): the larger one has the better score, then the earlier start.
    big = np.int64(1 << 32)  # scores and starts of up to 2**31 words
    begin = big - 1 - np.arange(cols + 1, dtype=np.int64)
    h = np.broadcast_to(begin, (n, cols + 1)).copy()
    best, where = np.full(n, big - 1), np.zeros(n, np.int64)
    for r in range(rows):
        same = (b == a[:, r : r + 1]) & inside
        up = h + GAP * big
        diagonal = h[:, :-1] + np.where(same, MATCH, MISMATCH) * big
        new = np.maximum(up, begin)
        np.maximum(new[:, 1:], diagonal, out=new[:, 1:])
        new = np.maximum.accumulate(new + slope * big, axis=1) - slope * big
        new = np.maximum(new, begin)
        live = (r < la)[:, None]
        h = np.where(live, new, h)
        masked = np.where(inside & live, h[:, 1:], 0)
        at = masked.argmax(1)
        top = masked[np.arange(n), at]
        better = top // big > best // big
        best, where = np.where(better, top, best), np.where(better, at + 1, where)
    return best // big, big - 1 - best % big, where


def _often(docs: DataFrame, runs: np.ndarray, short: list[int]) -> np.ndarray:
    """How often each of the seeds ``runs`` (sorted) stands in the documents (doc_id, text, text_key)."""
    held = docs.sparkSession.sparkContext.broadcast(runs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(held.value)
        count = np.zeros(len(table[0]), np.int64)
        for b in batches:
            data, at = utf8(b.column(0))
            for i, j in blocks(at):
                h, _, first = words(data[at[i] : at[j]], at[i : j + 1] - at[i], word_table("plain"))
                g, _, _ = _all_seeds(h, first, short)
                count += np.bincount(np.searchsorted(table[0], g[_hits(g, table)]), minlength=len(count))
        seen = np.flatnonzero(count)
        for k in range(0, len(seen), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(seen[k : k + (1 << 16)]), pa.array(count[seen[k : k + (1 << 16)]])], names=["k", "c"])

    total = docs.select("text").mapInArrow(run, "k long, c long").groupBy("k").agg(F.sum("c").alias("c")).toArrow()  # two for each word of a block at most
    out = np.zeros(len(runs), np.int64)
    out[total.column("k").to_numpy()] = total.column("c").to_numpy()
    return out


def _aligned(docs: DataFrame, known, short: list[int]) -> DataFrame:
    """Documents (doc_id, text, text_key) aligned with a block of items: a row per passage whose score reaches ``LEAST_SCORE``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = known.value
        table = _table(items["runs"])
        for b in batches:
            data, at = utf8(b.column(1))
            for i, j in blocks(at):
                h, _, first = words(data[at[i] : at[j]], at[i : j + 1] - at[i], word_table("plain"))
                g, doc, pos = _all_seeds(h, first, short)
                hit = _hits(g, table)
                hit = hit[np.argsort(doc[hit], kind="stable")]
                doc, pos, seed = doc[hit], pos[hit], np.searchsorted(table[0], g[hit])
                for some, held in _shares(doc, seed, items):
                    d, item, lo, hi = _candidates(seed[some], pos[some], doc[some], h, first, held)
                    if not len(d):
                        continue
                    score, begin, end = _align_all([items["words"][items["first"][x] : items["first"][x + 1]] for x in item], [h[x:y] for x, y in zip(lo, hi, strict=True)])
                    share = score / (MATCH * (items["first"][item + 1] - items["first"][item]))
                    good = np.flatnonzero(share >= LEAST_SCORE)
                    d, start = d[good], (lo - first[d])[good]
                    ids = pa.array(d + i)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(ids), b.column(2).take(ids), pa.array(items["ids"][item[good]]), pa.array(share[good]), pa.array(start + begin[good]), pa.array(start + end[good])], names=["doc_id", "text_key", "item_id", "score", "first_word", "end_word"])

    return docs.mapInArrow(run, "doc_id long, text_key string, item_id long, score double, first_word long, end_word long")


def _shares(doc: np.ndarray, seed: np.ndarray, items: Items) -> Iterator[tuple[slice, Items]]:
    """Seeds of whole documents that lead to about ``SEED_PAIRS`` items in all; a document that has more is taken with a part of the items at a time."""
    cost = np.concatenate([[0], np.cumsum(items["begin"][seed + 1] - items["begin"][seed])])
    ends = np.append(np.flatnonzero(np.diff(doc)) + 1, len(doc)) if len(doc) else doc
    k = 0
    while k < len(doc):
        m = int(ends[max(np.searchsorted(cost[ends], cost[k] + SEED_PAIRS, side="right") - 1, np.searchsorted(ends, k, side="right"))])
        parts = -(-int(cost[m] - cost[k]) // SEED_PAIRS)
        for p in range(parts):
            yield slice(k, m), items if parts == 1 else _part(items, p, parts)
        k = m


def _align_all(items: list[np.ndarray], passages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``_align_batch`` of any number of pairs, those of like size together."""
    n, size = len(items), np.array([len(p) for p in passages])
    score, lo, hi = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    order = np.argsort(size, kind="stable")
    k = 0
    while k < n:
        m = k + 1
        while m < n and (m - k + 1) * (size[order[m]] + 1) <= CELLS // 16:
            m += 1
        some = order[k:m]
        score[some], lo[some], hi[some] = _align_batch([items[x] for x in some], [passages[x] for x in some])
        k = m
    return score, lo, hi


def matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The best alignment of each document (doc_id, text_key) and item whose score reaches ``LEAST_SCORE``.

    text_key is the MD5 of the text (null: empty). Repeated rows of a document are one. Null items and items without words match nothing; nor do null or
    empty texts. With an empty table on either side there are no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.md5(F.coalesce("text", F.lit(""))).alias("text_key"))
    known = settle(item_words(items))
    size = known.agg(F.sum(F.size("item_words")).alias("n")).first().n or 0
    parts = -(-size // BLOCK_WORDS)
    out = None
    for p in range(parts):
        block = known.filter(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == p) if parts > 1 else known
        held = _items_of(block.toArrow())  # at most BLOCK_WORDS words
        if not len(held["ids"]):
            continue
        size = np.diff(held["first"])
        short = [k for k in range(1, LEAST_WORDS) if (size == k).any()]
        runs = np.unique(held["seed"])
        held = _rarest(held, runs, _often(rows, runs, short))
        got = _aligned(rows, spark.sparkContext.broadcast(held), short)
        out = got if out is None else out.unionAll(got)
    if out is None:
        return spark.createDataFrame([], "doc_id long, text_key string, item_id long, score double, first_word long, end_word long")
    best = F.max_by(F.struct("score", "first_word", "end_word"), F.struct("score", -F.col("first_word"))).alias("best")
    return out.groupBy("doc_id", "text_key", "item_id").agg(best).select("doc_id", "text_key", "item_id", "best.score", "best.first_word", "best.end_word")


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) of every contaminated document, with the alignment's score (1: a full copy) and its words [first_word, end_word).

    Of equal alignments the first counts; rows that share a doc_id are one document, a null doc_id is one too. Null, empty and wordless texts and items match nothing, an
    empty table on either side gives no rows; other columns are not looked at.
    """
    best = F.max_by(F.struct("score", "first_word", "end_word"), F.struct("score", -F.col("first_word"))).alias("best")
    return matches(docs, items).groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.score", "best.first_word", "best.end_word")


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text matches no item.

    Each row is judged by its own text, whatever doc_id it has or shares; null and empty texts stay, repeated rows stay or go together. Without items all rows stay.
    """
    bad = matches(docs, items).select(F.col("doc_id").alias("bad_doc_id"), F.col("text_key").alias("bad_text_key")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["bad_doc_id"]) & (F.md5(F.coalesce(docs["text"], F.lit(""))) == bad["bad_text_key"]), "left_anti")
