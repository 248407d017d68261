"""Similarity join on word n-grams: count-vector R-trees over the texts that agree in a group of n-grams.

The hashes of a text's n-grams are dealt into ``DIMS`` groups; the group counts are a point. No more n-grams can be common to two texts than the sum of the
smaller counts, and for two boxes of points than the sum of the smaller upper corners, so two R-trees are joined from their roots down: pairs of boxes that can't hold a link are
left, and pairs of points that remain are verified on the full sets.

Points of random texts differ by little in every one of many coordinates, where boxes leave nothing out; so a tree over a whole corpus would compare all pairs. Which points
share trees is settled by finer groups, exactly: texts that may link differ by at most D of their n-grams, so of G > D groups one at least is the same in both, and
(size class, group, digest of its n-grams) is a cell that both lie in. G is chosen so that more than D groups of a text have n-grams; a text for which
this fails is also laid into the cells of its empty groups. No link is lost.

Equal sets are one node. In a turn each node is verified against one hub, that of its cells' hubs whose cells it shares most; where nodes of different components still share
a cell they are dealt to tiles of bounded size (see ``neardup``), and the trees are built and joined there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.llm.blocks import blocks, mix, number, utf8
from tessera.llm.neardup import FEW, SPREAD, TILE, confirmed, distinct_sets, elements, forests, full_sets, groups_of, linked, lists, numbers, only, set_key_of, spread, tiles_of, wanted_rows
from tessera.session import settle, ship

WORDS = 4
PERCENT = 85

#: Coordinates of a point, and children of a box.
DIMS, FAN = 64, 8

#: Pairs of boxes looked at together.
PAIRS = 1 << 15

#: The smallest set that can link with another one (6 of 7 n-grams in common), how much wider the next size class is, and classes (sizes up to 10^9).
LEAST, WIDER, CLASSES = 6, 1.6, 48


def _apart(a: int, b: int) -> int:
    """The most elements that are in one only of two linked sets of these sizes."""
    return (100 - PERCENT) * (a + b) // (100 + PERCENT)


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Where size classes begin (one more entry for the end), and the groups of each."""
    bounds, groups = [LEAST], []
    for _ in range(CLASSES):
        bounds.append(int(bounds[-1] * WIDER))
        top = bounds[-1] - 1
        most = _apart(top, top * 100 // PERCENT)
        g = most + 1
        while g * (1 - np.exp(-top / g)) - np.sqrt(g * np.exp(-top / g)) < most + 1:
            g += 1 + g // 64
        groups.append(g)
    return np.array(bounds, np.int64), np.array(groups, np.int64)


BOUNDS, GROUPS = _classes()


def cell_keys(e: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): the cells of sets of distinct element hashes, ``where`` is where each set's begin.

    A set lies in the cells of its own size class, and in those of the next lower one if a linked set may be of it.
    """
    n = np.diff(where)
    own = np.searchsorted(BOUNDS, n, side="right") - 1
    rows, keys = [], []
    for lower in (0, 1):
        c = own - lower
        some = np.flatnonzero((c >= 0) & ((n * PERCENT + 99) // 100 < BOUNDS[np.maximum(own, 0)] if lower else n >= LEAST))
        if not len(some):
            continue
        c, size = c[some], n[some]
        g = GROUPS[c]
        base = np.cumsum(g) - g
        at = np.repeat(where[:-1][some] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        h = mix(e[at] + np.repeat(c, size).astype(np.uint64) * number(8000))
        slot = np.repeat(base, size) + ((h >> np.uint64(32)) % np.repeat(g, size).astype(np.uint64)).astype(np.int64)
        total = np.zeros(int(g.sum()), np.uint64)
        np.add.at(total, slot, mix(h))
        held = np.bincount(slot, minlength=len(total)) > 0
        owner = np.repeat(np.arange(len(some)), g)
        empty = g - np.bincount(owner[held], minlength=len(some))
        partner = BOUNDS[c + 1] - 1 if lower else size * 100 // PERCENT
        short = g - empty <= (100 - PERCENT) * (size + partner) // (100 + PERCENT)
        take = np.flatnonzero(held | short[owner])
        name = np.arange(len(total)) - base[owner]
        label = (c[owner[take]].astype(np.uint64) << np.uint64(40)) + name[take].astype(np.uint64)
        rows.append(some[owner[take]])
        keys.append(mix(total[take] + mix(label * number(8001) + number(8002))))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(rows), np.concatenate(keys)


def points(e: np.ndarray, where: np.ndarray) -> np.ndarray:
    """The group counts of sets of element hashes."""
    n = len(where) - 1
    at = np.repeat(np.arange(n), np.diff(where)) * DIMS + (mix(e ^ number(8003)) >> np.uint64(58)).astype(np.int64)
    return np.bincount(at, minlength=n * DIMS).reshape(n, DIMS).astype(np.uint32)


def _sets(data: np.ndarray, at: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    sets = distinct_sets(*elements(data, at, WORDS))
    return sets, np.concatenate([np.zeros(0, np.uint64), *sets]), np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)


def sizes(docs: DataFrame) -> DataFrame:
    """Of rows (doc_id, text): doc_id, the size of its set and a 128-bit key of the set (null for an empty one)."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = utf8(b.column(1))
            for i, j in blocks(at):
                sets, _, where = _sets(data[at[i] : at[j]], at[i : j + 1] - at[i])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(np.diff(where)), pa.array([set_key_of(s) for s in sets], pa.binary())], names=["doc_id", "n_shingles", "set_key"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, set_key binary")


def _cells(rows: DataFrame, table: Broadcast | None) -> DataFrame:
    """(key, node) for each cell of the wanted documents (doc_id, text, h)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (wanted_rows(b, table) for b in batches):
            data, at = utf8(b.column(1))
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for i, j in blocks(at):
                _, e, where = _sets(data[at[i] : at[j]], at[i : j + 1] - at[i])
                row, key = cell_keys(e, where)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids[i:j][row])], names=["key", "node"])

    return rows.mapInArrow(run, "key long, node long")


def _points(rows: DataFrame, table: Broadcast | None) -> DataFrame:
    """(node, set_key, n, counts) of the wanted documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (wanted_rows(b, table) for b in batches):
            data, at = utf8(b.column(1))
            for i, j in blocks(at):
                sets, e, where = _sets(data[at[i] : at[j]], at[i : j + 1] - at[i])
                counts = pa.array([c.tobytes() for c in points(e, where)], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array([set_key_of(s) for s in sets], pa.binary()), pa.array(np.diff(where)), counts], names=["node", "set_key", "n", "counts"])

    return rows.mapInArrow(run, "node long, set_key binary, n long, counts binary")


def _shared(rows: DataFrame, table: Broadcast | None) -> DataFrame:
    """(node, shared): the cells of each wanted document that another one has too. Cells are shuffled once; where those of one key meet, each is picked or left."""
    of_key = Window.partitionBy("key")
    cells = _cells(rows, table).select("key", "node", F.min("node").over(of_key).alias("lo"), F.max("node").over(of_key).alias("hi")).filter("lo < hi")
    return cells.groupBy("node").agg(F.collect_set("key").alias("shared"))  # a document's own cells


def _key_table(shared: DataFrame) -> Broadcast | None:
    """The bit table (see ``only``) of the documents that share a cell; None if there are too many, and all texts are cut again."""
    nodes = shared.select(F.col("node").alias("doc_id"))
    return only(nodes, nodes)[1]


def _members(placed: DataFrame) -> DataFrame:
    return placed.select(F.explode("shared").alias("band"), "node", "root", "n")


def _fits(a: str, b: str) -> Column:
    return (100 * F.col(a) >= PERCENT * F.col(b)) & (100 * F.col(b) >= PERCENT * F.col(a))


def _stars(placed: DataFrame, turn: int) -> DataFrame:
    """At most one pair (node, hub) a node: of its cells' hubs with another root, the one that it shares most cells with. Other turns have other hubs."""
    members = _members(placed)
    near = F.col("node").bitwiseXOR(F.lit(int(number(8100 + turn)) >> 1 if turn else 0))
    hubs = members.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min_by(F.struct("node", "root", "n"), near).alias("hub")).filter("lo < hi")
    hubs = hubs.select("band", F.col("hub.node").alias("hub"), F.col("hub.root").alias("hub_root"), F.col("hub.n").alias("hub_n"))
    tried = members.join(hubs, "band").filter((F.col("root") != F.col("hub_root")) & _fits("n", "hub_n"))
    return tried.groupBy("node", "hub").agg(F.count("*").alias("k")).groupBy("node").agg(F.max_by("hub", F.struct("k", -F.col("hub"))).alias("hub"))


def _near(pairs: DataFrame, placed: DataFrame) -> DataFrame:
    """The pairs (node, hub) whose points allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            one, other = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint32).reshape(-1, DIMS) for c in ("counts", "hub_counts"))
            n = b.column("n").to_numpy() + b.column("hub_n").to_numpy()
            yield b.select(["node", "hub"]).filter(pa.array((100 + PERCENT) * np.minimum(one, other).sum(axis=1) >= PERCENT * n))

    of_hub = placed.select(F.col("node").alias("hub"), F.col("n").alias("hub_n"), F.col("counts").alias("hub_counts"))
    both = pairs.join(placed.select("node", "n", "counts"), "node").join(of_hub, "hub")
    return both.select("node", "hub", "n", "hub_n", "counts", "hub_counts").mapInArrow(run, "node long, hub long")


class _Tree:
    """An R-tree over points (band, counts, n, root), packed: sorted by band, then in slabs of the coordinates that differ most. Levels from the points up."""

    def __init__(self, band: np.ndarray, counts: np.ndarray, n: np.ndarray, root: np.ndarray, height: int):
        spread_most = np.argsort(counts.var(axis=0))[::-1][:2] if len(counts) else np.zeros(2, np.int64)
        slab = lambda x: np.argsort(np.argsort(x, kind="stable"), kind="stable") // (FAN * FAN)
        self.order = np.lexsort((counts[:, spread_most[1]], slab(counts[:, spread_most[0]]), band))
        low = {"band": band[self.order], "root": root[self.order], "n": n[self.order]}
        high = {"band": low["band"], "root": low["root"], "counts": counts[self.order].astype(np.int64)}
        self.levels = [(low, high)]
        for _ in range(height):
            cut = np.arange(0, len(low["n"]), FAN)
            low = {k: np.minimum.reduceat(v, cut) for k, v in low.items()}
            high = {k: np.maximum.reduceat(v, cut, axis=0) for k, v in high.items()}
            self.levels.append((low, high))


def _may_link(one: tuple, p: np.ndarray, other: tuple, q: np.ndarray) -> np.ndarray:
    """Whether boxes p and q may hold linked points: bands in common, different roots, and smaller counts that sum up to enough."""
    (low, high), (low2, high2) = one, other
    ok = (low["band"][p] <= high2["band"][q]) & (low2["band"][q] <= high["band"][p])
    ok &= ~((low["root"][p] == high["root"][p]) & (low2["root"][q] == high2["root"][q]) & (low["root"][p] == low2["root"][q]))
    at = np.flatnonzero(ok)
    for k in range(0, len(at), PAIRS):
        s = at[k : k + PAIRS]
        both = np.minimum(high["counts"][p[s]], high2["counts"][q[s]]).sum(axis=1)
        ok[s] = (100 + PERCENT) * both >= PERCENT * (low["n"][p[s]] + low2["n"][q[s]])
    return ok


def joined_trees(a: dict[str, np.ndarray], b: dict[str, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of points of a and b (of two points of a where b is None) with the same band, different roots, fitting sizes and counts that allow a link."""
    height, size = 0, max(len(a["n"]), len(b["n"]) if b else 0)
    while size > FAN:
        size, height = -(-size // FAN), height + 1
    one = _Tree(a["band"], a["counts"], a["n"], a["root"], height)
    other = _Tree(b["band"], b["counts"], b["n"], b["root"], height) if b else one
    top, top2 = len(one.levels[-1][0]["n"]), len(other.levels[-1][0]["n"])
    p, q = np.repeat(np.arange(top), top2), np.tile(np.arange(top2), top)
    for level in range(height, -1, -1):
        if b is None:
            p, q = p[p <= q], q[p <= q]
        ok = _may_link(one.levels[level], p, other.levels[level], q)
        p, q = p[ok], q[ok]
        if level:
            step = np.arange(FAN * FAN)
            p, q = (p[:, None] * FAN + step // FAN).ravel(), (q[:, None] * FAN + step % FAN).ravel()
            inside = (p < len(one.levels[level - 1][0]["n"])) & (q < len(other.levels[level - 1][0]["n"]))
            p, q = p[inside], q[inside]
    i, j = one.order[p], other.order[q]
    x, y = a["n"][i], (b or a)["n"][j]
    ok = (100 * x >= PERCENT * y) & (100 * y >= PERCENT * x)
    return i[ok], j[ok]


def candidates(tiles: DataFrame) -> DataFrame:
    """(tile, node, root, partners): nodes of a tile with another root whose points allow a link with the node; each pair is in one row's partners."""

    def run(t: pa.Table) -> pa.Table:
        side, node, root, n = (numbers(t[c]) for c in ("side", "node", "root", "n"))
        bands, at = lists(t["bands"])
        counts = np.frombuffer(b"".join(t["counts"].to_pylist()), np.uint32).reshape(-1, DIMS)
        row = np.repeat(np.arange(len(node)), np.diff(at))

        def part(s: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
            some = np.flatnonzero(side[row] == s)
            r = row[some]
            return r, {"band": bands[some], "counts": counts[r], "n": n[r], "root": root[r]}

        rows, a = part(0)
        rows2, b = part(1) if side.any() else (rows, None)
        i, j = joined_trees(a, b)
        pairs = np.stack([node[rows[i]], node[rows2[j]]], 1)
        used, place = np.unique(pairs, return_inverse=True)
        pairs = np.unique(np.sort(place.reshape(-1, 2), axis=1), axis=0)
        offsets = np.searchsorted(pairs[:, 0], np.arange(len(used) + 1)).astype(np.int32)
        roots = dict(zip(node.tolist(), root.tolist(), strict=True))
        columns = [pa.array(np.full(len(used), t["tile"][0].as_py(), np.int64)), pa.array(used), pa.array([roots[u] for u in used.tolist()], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(used[pairs[:, 1]]))]
        return pa.Table.from_arrays(columns, names=["tile", "node", "root", "partners"])

    ship(tiles.sparkSession)
    return tiles.groupBy("tile").applyInArrow(run, "tile long, node long, root long, partners array<long>")


def _tiles(placed: DataFrame, roots: DataFrame, groups: DataFrame) -> DataFrame:
    """(tile, side, node, bands, root, n, counts): small pools whose smallest root is the same share tiles, so that nodes with many cells in common meet in few."""
    pools = groups.filter("NOT own").groupBy("lo").agg(F.ceil(F.sum("c") / (8 * TILE)).alias("homes"))
    home = F.xxhash64("lo", F.pmod(F.xxhash64("band"), F.coalesce("homes", F.lit(1))))
    dealt = tiles_of(_members(placed), roots, groups.join(pools, "lo", "left"), home)
    return dealt.groupBy("tile", "side", "node").agg(F.collect_list("band").alias("bands")).join(placed.select("node", "root", "n", "counts"), "node")  # a node's own cells at most


def _sets_of(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The full sets of some documents (doc_id), which are cut from their texts for each step, so that no step shuffles those of others."""
    return settle(full_sets(rows, settle(ids.distinct()), WORDS))


def similarity_join(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (smallest doc_id that links lead to, itself included).

    A set is the distinct runs of ``WORDS`` words of a text, A-Z lower-cased; fewer words are one run. Texts link where 100 * common >= ``PERCENT`` * all. Null, empty and
    wordless texts have an empty set and link with nothing. Rows that share a doc_id but not the text are each placed by their own set; a null doc_id can't name a
    component: such a row belongs to that of the rows with an equal set, or to none. An empty table gives no rows; other columns are not looked at.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    feats = settle(sizes(rows))
    nodes = settle(feats.filter("set_key IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n")))
    wanted = nodes.filter(F.col("n") >= LEAST).select(F.col("node").alias("doc_id"))
    texts, table = only(rows.filter("doc_id IS NOT NULL"), wanted)
    shared = settle(_shared(texts, table))
    marked = _points(texts, _key_table(shared)).join(nodes.select("node", "set_key"), ["node", "set_key"], "left_semi").dropDuplicates(["node", "set_key"])
    placed = settle(marked.drop("set_key").join(shared, "node").select("node", F.col("node").alias("root"), "n", "counts", "shared"))
    most, turn = 0, 0
    while True:
        pairs = settle(_near(_stars(placed, turn), placed))
        new = settle(confirmed(pairs, _sets_of(rows, pairs.select(F.explode(F.array("node", "hub")).alias("doc_id"))), PERCENT))
        found = new.count()
        if found:
            placed = linked(placed, new)
        roots, groups = groups_of(_members(placed))
        if not found or FEW * found <= most or spread(groups) <= SPREAD:
            break
        most, turn = max(most, found), turn + 1
    tried = settle(candidates(_tiles(placed, roots, groups)))
    more = settle(forests(tried, _sets_of(rows, tried.select(F.col("node").alias("doc_id"))), PERCENT))
    if not more.isEmpty():
        placed = linked(placed, more)
    root = placed.groupBy("node").agg(F.min("root").alias("root"))
    class_root = nodes.select("set_key", "node").join(root, "node", "left").select("set_key", F.coalesce("root", "node").alias("component_id"))
    out = feats.join(class_root, "set_key", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
