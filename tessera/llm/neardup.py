"""Near-duplicate documents: fast similarity sketches, banding, exact verification, connected components.

A document's set is its distinct runs of ``WORDS`` words. The sketch throws every element into a hashed bin, round after
round, until each of ``BINS`` bins is filled; after ``BINS`` rounds, round ``BINS + b`` throws all elements into bin b, so every bin
is filled at last. A bin holds the smallest hash of the round that filled it first, and two sets agree in a bin with a chance equal to their Jaccard similarity,
with the concentration that independent bins would have. Bands of ``ROWS`` bins are the candidates' keys; every link is then
confirmed on the full sets.

Work and skew: equal sets are one node, so copies cost nothing. In a turn every node is confirmed against at most one hub, the one of its
bands' hubs whose sketch agrees best with its own (stars, linear in the nodes). What then shares a band and
has different roots is compared in tiles: members of a band are dealt to parts of bounded size, every two parts that may
hold different roots meet in one task, and a task hands on a spanning forest of the true links, never pairs. Where tiles would cost many times the
members, turns with other hubs come first, as long as they link many. No limit is set on members.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from tessera.llm.blocks import blocks, grams, mix, number, utf8, word_table, words
from tessera.session import settle, ship

WORDS = 5
PERCENT = 75
BINS, ROWS = 128, 4
BANDS = BINS // ROWS

#: Signature columns: 4 bits of each bin, 16 bins in a long.
SIGNS = BINS // 16
SIGN_NAMES = [f"s{k}" for k in range(SIGNS)]

#: Bins in whose 4 bits two sets of similarity 0.75 disagree: 30 expected, deviation 4.8. Six deviations above lie under 1e-9 of such pairs.
MOST_DISAGREE = 59

#: Members, and elements of their sets, in a part of a band's members: a task compares two parts at once.
TILE, TILE_ELEMENTS = 1024, 1 << 21

#: Rows in tiles for each member that are cheap enough to end the turns of hubs, which also end when one finds fewer links than a ``FEW``-th of the best turn's.
SPREAD, FEW = 4, 20

#: Bits of the table of wanted ids (1 MB).
BITS = 1 << 23

_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def sketches(e: np.ndarray, where: np.ndarray, bins: int = BINS) -> np.ndarray:
    """(documents, bins) sketches of element hashes; ``where`` is where each document's begin. Documents without elements stay empty.

    A filled bin has the number of its round in the top 12 bits and the smallest hash below. ``bins`` is a power of two, 1024 at most.
    """
    n = len(where) - 1
    out = np.full(n * bins, _EMPTY, np.uint64)
    doc = np.repeat(np.arange(n), np.diff(where))
    for turn in range(2 * bins):
        if not len(e):
            break
        h = mix(e ^ number(turn))
        at = doc * bins + ((h & np.uint64(bins - 1)).astype(np.int64) if turn < bins else turn - bins)
        mark = np.uint64(turn) << np.uint64(52)
        free = out[at] >= mark  # filled in this round or not at all
        np.minimum.at(out, at[free], h[free] >> np.uint64(12) | mark)
        if turn % 4 == 3 or turn >= bins:
            full = (out.reshape(n, bins) != _EMPTY).all(1)
            left = ~full[doc]
            if not left.all():
                e, doc = e[left], doc[left]
    return out.reshape(n, bins)


def _signature(sketch: np.ndarray) -> np.ndarray:
    """4 bits of each bin, 16 bins in a long."""
    bits = (mix(sketch) & np.uint64(15)).reshape(len(sketch), -1, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4))
    return np.bitwise_or.reduce(bits, axis=2).view(np.int64)


def distinct_sets(e: np.ndarray, where: np.ndarray) -> list[np.ndarray]:
    return [np.unique(e[where[i] : where[i + 1]]) for i in range(len(where) - 1)]


def set_key_of(s: np.ndarray) -> bytes | None:
    return hashlib.sha256(s.tobytes()).digest()[:16] if len(s) else None


def elements(data: np.ndarray, at: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``k`` words of each text, and where each text's begin."""
    h, _, first = words(data, at, word_table("space"))
    return grams(h, first, k, short=True)


def _text_key(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def features(docs: DataFrame) -> DataFrame:
    """For rows of (doc_id, text, text_key): the id and the key again, set size, a 128-bit key of the set, signature and band keys (null for an empty set)."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = utf8(b.column(1))
            for i, j in blocks(at):
                e, where = elements(data[at[i] : at[j]], at[i : j + 1] - at[i])
                sets = distinct_sets(e, where)
                size = np.array([len(s) for s in sets], np.int64)
                none = size == 0
                keys = [set_key_of(s) for s in sets]
                sketch = sketches(e, where)
                sign = _signature(sketch)
                band = sketch.reshape(-1, BANDS, ROWS) * np.array([number(3000 + k) for k in range(ROWS)])
                band = mix(band.sum(2, dtype=np.uint64) + np.array([number(4000 + k) for k in range(BANDS)])).view(np.int64)
                offsets = pa.array(np.arange(0, (j - i) * BANDS + 1, BANDS, dtype=np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(band.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(2).slice(i, j - i), pa.array(size), pa.array(keys, pa.binary()), *(pa.array(sign[:, k].copy(), mask=none) for k in range(SIGNS)), lists], names=["doc_id", "text_key", "n_shingles", "set_key", *SIGN_NAMES, "bands"])

    return docs.mapInArrow(run, "doc_id long, text_key string, n_shingles long, set_key binary, " + ", ".join(f"{s} long" for s in SIGN_NAMES) + ", bands array<long>")


def only(docs: DataFrame, wanted: DataFrame) -> tuple[DataFrame, Broadcast | None]:
    """``docs`` with a hash ``h`` of the id, and a bit table of fixed size (``BITS`` bits) of the wanted ids' hashes, with which tasks pass over most other texts.

    Beyond an eighth of the bits the wanted rows are picked by a join instead.
    """
    hashed = lambda c: F.pmod(F.xxhash64(c), F.lit(BITS))
    if wanted.count() > BITS // 8:
        return docs.join(wanted, "doc_id", "left_semi").withColumn("h", hashed("doc_id")), None
    at = wanted.select((hashed("doc_id") + 1).alias("b"))
    parts = at.groupBy(F.bitmap_bucket_number("b").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("bits")).collect()  # 4 KB each, BITS in all
    table = np.zeros(BITS // 8, np.uint8)
    for r in parts:
        table[(r.k - 1) * 4096 : r.k * 4096] = np.frombuffer(bytes(r.bits), np.uint8)
    return docs.withColumn("h", hashed("doc_id")), docs.sparkSession.sparkContext.broadcast(table)


def wanted_rows(b: pa.RecordBatch, table: Broadcast | None) -> pa.RecordBatch:
    """Rows of (doc_id, text, h) whose bit is set."""
    if table is None:
        return b
    h = b.column(2).to_numpy(zero_copy_only=False)
    return b.filter(pa.array((table.value[h >> 3] >> (h & 7).astype(np.uint8) & 1).astype(bool)))


def full_sets(docs: DataFrame, wanted: DataFrame, k: int = WORDS) -> DataFrame:
    """node and the sorted 64-bit hashes of its whole set, once for each set, for at least the wanted doc_ids."""
    ship(docs.sparkSession)
    rows, table = only(docs, wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (wanted_rows(b, table) for b in batches):
            data, at = utf8(b.column(1))
            for i, j in blocks(at):
                sets = distinct_sets(*elements(data[at[i] : at[j]], at[i : j + 1] - at[i], k))
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                keys = pa.array([set_key_of(s) for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), keys, pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets).view(np.int64)))], names=["doc_id", "set_key", "elements"])

    found = rows.mapInArrow(run, "doc_id long, set_key binary, elements array<long>")
    return found.groupBy(F.col("doc_id").alias("node"), "set_key").agg(F.first("elements").alias("elements")).drop("set_key")


def _disagree(a: str, b: str) -> Column:
    """Bins whose 4 bits differ, of the signature columns with these prefixes."""
    parts = []
    for k in range(SIGNS):
        x = F.col(f"{a}s{k}").bitwiseXOR(F.col(f"{b}s{k}"))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        parts.append(F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111))))
    return reduce(lambda p, q: p + q, parts)


def _members(placed: DataFrame, *more: str) -> DataFrame:
    """A row for each node and each of its bands that another node has too."""
    return placed.select(F.explode("shared").alias("band"), "node", "root", "n", *SIGN_NAMES, *more)


def _stars(placed: DataFrame, turn: int) -> DataFrame:
    """At most one pair (node, hub) a node: of its bands' hubs with another root, the one whose sketch agrees best, if it agrees enough.

    A band's hub is the member nearest to a number by exclusive or, so other turns have other hubs.
    """
    members = _members(placed)
    near = F.col("node").bitwiseXOR(F.lit(int(number(5000 + turn)) >> 1 if turn else 0))
    hub = F.min_by(F.struct("node", "root", "n", *SIGN_NAMES), near).alias("hub")
    hubs = members.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), hub).filter("lo < hi")
    hubs = hubs.select("band", F.col("hub.node").alias("hub"), F.col("hub.root").alias("hub_root"), F.col("hub.n").alias("hub_n"), *(F.col(f"hub.{s}").alias(f"hub_{s}") for s in SIGN_NAMES))
    fits = (F.col("root") != F.col("hub_root")) & (100 * F.col("n") >= PERCENT * F.col("hub_n")) & (100 * F.col("hub_n") >= PERCENT * F.col("n"))
    tried = members.join(hubs, "band").withColumn("apart", _disagree("", "hub_"))
    return tried.filter(fits & (F.col("apart") <= MOST_DISAGREE)).groupBy("node").agg(F.min_by("hub", "apart").alias("hub"))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(u, v), u < v, of the pairs (node, hub) whose full sets reach the similarity of ``percent``."""
    of_hub = sets.select(F.col("node").alias("hub"), F.col("elements").alias("hub_elements"))
    both = F.size(F.array_intersect("elements", "hub_elements"))
    enough = (100 + percent) * both >= percent * (F.size("elements") + F.size("hub_elements"))
    found = pairs.join(sets, "node").join(of_hub, "hub").filter(enough)
    return found.select(F.least("node", "hub").alias("u"), F.greatest("node", "hub").alias("v"))


def groups_of(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For mixed bands of members (band, node, root, n): (band, root, own, g) of every root, and (band, own, g, lo, c, w, parts) of the groups that tiles are made of.

    A band's members of one root are a group of their own where they fill half a part; the band's other members are its pool. A group is to be
    cut into parts of about ``TILE`` members and ``TILE_ELEMENTS`` elements.
    """
    roots = members.groupBy("band", "root").agg(F.count("*").alias("c"), F.sum("n").alias("w"))
    roots = roots.withColumn("own", (F.col("c") > TILE // 2) | (F.col("w") > TILE_ELEMENTS // 2)).withColumn("g", F.when(F.col("own"), F.col("root")).otherwise(0))
    mixed = roots.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("band", "lo")
    roots = settle(roots.join(mixed, "band"))
    groups = roots.groupBy("band", "own", "g").agg(F.min("lo").alias("lo"), F.sum("c").alias("c"), F.sum("w").alias("w")).withColumn("parts", _share())
    return roots.select("band", "root", "own", "g"), settle(groups)


def _share() -> Column:
    return F.ceil(F.greatest(F.col("c") / TILE, F.col("w") / TILE_ELEMENTS)).cast("int")


def spread(groups: DataFrame) -> float:
    """Rows in tiles for each member. A part of the pool meets all parts of its band, another part those of other groups."""
    band = groups.groupBy("band").agg(F.sum("c").alias("c"), (F.sum("c") * F.sum("parts") - F.sum(F.when(F.col("own"), F.col("c") * F.col("parts")).otherwise(0))).alias("rows"))
    got = band.agg(F.sum("c").alias("c"), F.sum("rows").alias("rows")).first()
    return got.rows / got.c if got.c else 0.0


def tiles_of(members: DataFrame, roots: DataFrame, groups: DataFrame, home: Column | None = None) -> DataFrame:
    """(tile, side, band, node): members of mixed bands, dealt to tiles so that every two members of a band with different roots meet in a tile.

    Groups are cut into their parts by a hash. Two parts of different groups are the two sides of a tile,
    as are two parts of the pool; a part of the pool is a tile by itself too, and pools of one part share tiles (those of equal ``home``, a hash of columns of ``groups``, share one). So a
    band of many members with few roots costs its members times the parts of the other roots; a large group is not compared inside itself.
    """
    small = groups.filter("NOT own AND parts = 1").agg(F.sum("c").alias("c"), F.sum("w").alias("w")).select(_share()).first()[0] or 1
    home = F.xxhash64("band") if home is None else home
    groups = groups.withColumn("home", home)
    side = lambda s: groups.select("band", *(F.col(c).alias(f"{c}_{s}") for c in ("own", "g", "parts", "home")))
    pool = ~F.col("own_a") & ~F.col("own_b")
    met = side("a").join(side("b"), "band").filter(pool | (F.struct("own_a", "g_a") < F.struct("own_b", "g_b")))
    met = met.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("parts_a") - 1)))
    met = met.withColumn("j", F.explode(F.sequence(F.when(pool, F.col("i")).otherwise(0), F.col("parts_b") - 1)))
    tile = F.when(pool & (F.col("parts_a") == 1), F.pmod(F.col("home_a"), F.lit(small))).otherwise(F.xxhash64("band", "own_a", "g_a", "i", "own_b", "g_b", "j"))
    slot = lambda s, part, k: F.struct(F.col(f"own_{s}").alias("own"), F.col(f"g_{s}").alias("g"), F.col(part).alias("part"), F.lit(k).alias("side"))
    both = F.when(pool & (F.col("i") == F.col("j")), F.array(slot("a", "i", 0))).otherwise(F.array(slot("a", "i", 0), slot("b", "j", 1)))
    slots = met.select("band", tile.alias("tile"), F.explode(both).alias("x")).select("band", "tile", "x.*")
    group_of = roots.join(groups.select("band", "own", "g", "parts"), ["band", "own", "g"])
    part = F.pmod(F.xxhash64(F.when(F.col("own"), F.col("node")).otherwise(F.col("root"))), F.col("parts")).cast("int")
    dealt = members.select("band", "node", "root").join(group_of, ["band", "root"]).withColumn("part", part)
    return dealt.join(slots, ["band", "own", "g", "part"]).select("tile", "side", "band", "node")


def numbers(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy()


def lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a list column, and where each row's begin."""
    whole = column.combine_chunks()
    whole = pa.concat_arrays(whole.chunks) if isinstance(whole, pa.ChunkedArray) else whole
    at = np.concatenate([[0], np.cumsum(whole.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    return whole.flatten().to_numpy(), at


def candidates(tiles: DataFrame) -> DataFrame:
    """(tile, node, root, partners): nodes of a tile with another root, a first band shared with the node in this tile, and sizes and sketches that agree enough.

    Each pair is in one row's partners; a node that is only a partner has none itself.
    """
    schema = "tile long, node long, root long, partners array<long>"

    def run(t: pa.Table) -> pa.Table:
        side, band, node, root, n = (numbers(t[c]) for c in ("side", "band", "node", "root", "n"))
        bands = lists(t["bands"])[0].reshape(-1, BANDS)
        signs = np.stack([numbers(t[s]) for s in SIGN_NAMES], 1).view(np.uint64)
        two = side.any()
        a, b = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if two else (np.arange(len(side)),) * 2
        found = [np.zeros((0, 2), np.int64)]
        for lo in range(0, len(a), 256):
            x = a[lo : lo + 256]
            mask = (band[x, None] == band[b]) & (root[x, None] != root[b]) & (100 * n[x, None] >= PERCENT * n[b]) & (100 * n[b] >= PERCENT * n[x, None])
            i, j = np.nonzero(mask if two else mask & (x[:, None] < b))
            i, j = x[i], b[j]
            bits = signs[i] ^ signs[j]
            bits |= bits >> np.uint64(1)
            bits |= bits >> np.uint64(2)
            near = np.bitwise_count(bits & np.uint64(0x1111111111111111)).sum(1) <= MOST_DISAGREE
            i, j = i[near], j[near]
            first = (bands[i] == bands[j]).argmax(1)
            here = bands[i, first] == band[i]
            found.append(np.stack([i[here], j[here]], 1))
        pairs = np.concatenate(found)
        used, at = np.unique(node[pairs], return_inverse=True)
        pairs = np.unique(at.reshape(-1, 2), axis=0)
        offsets = np.searchsorted(pairs[:, 0], np.arange(len(used) + 1)).astype(np.int32)
        roots = dict(zip(node.tolist(), root.tolist(), strict=True))
        columns = [pa.array(np.full(len(used), t["tile"][0].as_py(), np.int64)), pa.array(used), pa.array([roots[u] for u in used.tolist()], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(used[pairs[:, 1]]))]
        return pa.Table.from_arrays(columns, names=["tile", "node", "root", "partners"])

    ship(tiles.sparkSession)
    return tiles.groupBy("tile").applyInArrow(run, schema)


def forests(found: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(u, v), u < v: of each tile's candidates, true links (similarity of ``percent``) that join all that its true links join."""

    def run(t: pa.Table) -> pa.Table:
        node, label = numbers(t["node"]), np.unique(numbers(t["root"]), return_inverse=True)[1]
        values, at = lists(t["elements"])
        partners, where = lists(t["partners"])
        code = np.unique(values, return_inverse=True)[1]
        size = np.diff(at)
        owner = np.repeat(np.arange(len(node)), size)
        mark = np.zeros(int(code.max(initial=0)) + 1, bool)
        out = []
        for i in range(len(node)):
            wanted = np.isin(node, partners[where[i] : where[i + 1]]) & (label != label[i])
            rows = np.flatnonzero(wanted)
            if not len(rows):
                continue
            own = code[at[i] : at[i + 1]]
            mark[own] = True
            if 4 * len(rows) > len(node):
                both = np.bincount(owner[mark[code]], minlength=len(node))[rows]
            else:
                both = np.array([np.count_nonzero(mark[code[at[r] : at[r + 1]]]) for r in rows])
            mark[own] = False
            for r in rows[(100 + percent) * both >= percent * (size[i] + size[rows])]:
                if label[r] != label[i]:
                    label[label == label[r]] = label[i]
                    out.append(sorted((int(node[i]), int(node[r]))))
        return pa.table({"u": pa.array([u for u, _ in out], pa.int64()), "v": pa.array([v for _, v in out], pa.int64())})

    ship(found.sparkSession)
    return found.join(sets, "node").groupBy("tile").applyInArrow(run, "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for all nodes of settled edges (u, v): root is the smallest node reachable.

    Each round gives every node the smallest of itself and its neighbours and contracts the edges to these; rounds end when no edge
    is left, after about the logarithm of the longest path. Nodes only ever move to a smaller one, so the smallest of all stays.
    """
    maps: list[DataFrame] = []
    while True:
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        label = settle(both.groupBy(F.col("u").alias("node")).agg(F.least(F.first("u"), F.min("v")).alias("root")))
        maps.append(label)
        to = lambda c: label.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))  # noqa: E731, B023
        moved = edges.join(to("u"), "u").join(to("v"), "v").select(F.least("u_root", "v_root").alias("u"), F.greatest("u_root", "v_root").alias("v")).filter("u < v").distinct()
        edges = settle(moved)
        if edges.isEmpty():
            break
    out = maps[0]
    for m in maps[1:]:
        out = out.join(m.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return settle(out) if len(maps) > 1 else out


def linked(placed: DataFrame, new: DataFrame) -> DataFrame:
    """``placed`` with the roots that new links between nodes lead to."""
    root_of = placed.select("node", "root")
    to = lambda c: root_of.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    edges = new.join(to("u"), "u").join(to("v"), "v").select(F.least("u_root", "v_root").alias("u"), F.greatest("u_root", "v_root").alias("v")).filter("u < v").distinct()
    moved = components(settle(edges)).select(F.col("node").alias("root"), F.col("root").alias("next"))
    return settle(placed.join(moved, "root", "left").withColumn("root", F.coalesce("next", "root")).drop("next"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept, set_key (which equal sets share) and text_key (which equal texts share).

    Null and empty texts have an empty set, link with nothing and are kept. Rows that share a doc_id but not the text are each
    placed by their own set. A null doc_id can't be a component's smallest: such a row belongs to the component of the rows with
    equal sets, where there is none its component_id is null and it is kept. An empty table gives no rows. Other columns of
    ``docs`` are not looked at.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    feats = settle(features(rows.withColumn("text_key", _text_key(F.col("text")))))
    # One node for each set, named by its smallest document.
    named = feats.filter("set_key IS NOT NULL AND doc_id IS NOT NULL")
    picked = F.min_by(F.struct(F.col("n_shingles").alias("n"), *SIGN_NAMES, "bands"), "doc_id").alias("x")
    nodes = settle(named.groupBy("set_key").agg(F.min("doc_id").alias("node"), picked).select("set_key", "node", "x.*"))
    bands = nodes.select("node", F.explode("bands").alias("band"))
    shared = bands.groupBy("band").agg(F.count("*").alias("k")).filter("k > 1").select("band")
    shared = bands.join(shared, "band").groupBy("node").agg(F.collect_set("band").alias("shared"))  # BANDS for each set at most
    alone = settle(nodes.join(shared, "node").select("node", F.col("node").alias("root"), "n", *SIGN_NAMES, "bands", F.array_intersect("bands", "shared").alias("shared")))
    sets = settle(full_sets(rows, alone.select(F.col("node").alias("doc_id"))))

    placed, most = alone, 0
    for turn in range(BINS):
        new = settle(confirmed(_stars(placed, turn), sets))
        found = new.count()
        if found:
            placed = linked(placed, new)
        roots, groups = groups_of(_members(placed))
        if not found or FEW * found <= most or spread(groups) <= SPREAD:
            break
        most = max(most, found)
    tiles = tiles_of(_members(placed), roots, groups).join(placed.select("node", "root", "n", "bands", *SIGN_NAMES), "node")
    more = settle(forests(settle(candidates(tiles)), sets))
    if not more.isEmpty():
        placed = linked(placed, more)
    root = placed.groupBy("node").agg(F.min("root").alias("root"))
    class_root = nodes.select("set_key", "node").join(root, "node", "left").select("set_key", F.coalesce("root", "node").alias("component_id"))
    out = feats.select("doc_id", "n_shingles", "set_key", "text_key").join(class_root, "set_key", "left")
    own = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), (own.isNull() | F.coalesce(F.col("doc_id") == own, F.lit(False))).alias("kept"), "set_key", "text_key")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns as they are, without near duplicates: of each component the row that names it stays.

    Exact repeats of a row (one doc_id and one text) are one document; of rows without a doc_id that share a set and no named
    row has it, the one with the smallest text digest stays.
    """
    found = near_duplicates(docs).filter("kept")
    nameless = F.col("doc_id").isNull() & F.col("set_key").isNotNull()
    group = F.when(nameless, F.col("set_key")).otherwise(F.unhex("text_key"))
    kept = settle(found.groupBy("doc_id", group.alias("g")).agg(F.min("text_key").alias("text_key"), F.count("*").alias("n")).select("doc_id", "text_key", "n"))

    def rows(wanted: DataFrame) -> DataFrame:
        w = wanted.select(F.col("doc_id").alias("kept_doc_id"), F.col("text_key").alias("kept_text_key"))
        return docs.join(w, docs["doc_id"].eqNullSafe(w["kept_doc_id"]) & (_text_key(docs["text"]) == w["kept_text_key"]), "left_semi")

    repeated = kept.filter("n > 1")
    once = rows(kept.filter("n = 1"))
    if repeated.isEmpty():
        return once
    return once.unionByName(rows(repeated).dropDuplicates(["doc_id", "text"]))
