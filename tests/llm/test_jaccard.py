import random
import re
from itertools import combinations

import numpy as np
import pytest

from tessera.llm import jaccard as J
from tessera.llm.neardup import full_sets
from tests.llm.fixtures import awkward, table, words


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(w)} if 0 < len(w) < J.WORDS else {" ".join(w[i : i + J.WORDS]) for i in range(len(w) - J.WORDS + 1)}


def linked(a, b):
    both = len(a & b)
    return bool(a and b) and 100 * both >= J.PERCENT * (len(a) + len(b) - both)


def expected(rows):
    """(doc_id, n, component) by comparing all rows."""
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in combinations(range(len(rows)), 2):
        (i, a), (j, b) = sets[x], sets[y]
        if linked(a, b) or (i is not None and i == j):
            parent[find(y)] = find(x)
    least = {}
    for x, (i, _) in enumerate(rows):
        if i is not None:
            least[find(x)] = min(least.get(find(x), i), i)
    return sorted(((i, len(s), least.get(find(x)) if s else i) for x, (i, s) in enumerate(sets)), key=str)


def near_copies(rng, n, size, most):
    """Copies of a text with up to ``most`` of its words replaced, so that many pairs lie about the threshold."""
    base = words(rng, size).split()
    out = []
    for k in range(n):
        w = list(base)
        for _ in range(rng.randint(0, most)):
            w[rng.randrange(size)] = f"new{k}{rng.randrange(10)}"
        out.append(" ".join(w[: size - rng.randint(0, most)]))
    return out


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def corpus(seed=2):
    rng = random.Random(seed)
    texts = [t for size, most in ((6, 1), (9, 1), (12, 1), (15, 1), (30, 2), (100, 4), (400, 9)) for t in near_copies(rng, 25, size, most)]
    line = words(rng, 60)
    texts += [f"{words(rng, 12)} {line} {words(rng, 12)}" for _ in range(40)]  # a passage in common, not enough to link
    return [(1000 + i, t) for i, t in enumerate(texts)] + awkward()


def test_rows_equal_comparing_all_pairs(spark):
    rows = corpus()
    assert got(J.similarity_join(table(spark, rows))) == expected(rows)


def test_tiles_and_joins_give_the_same(spark, monkeypatch):
    """No hubs, tiny tiles and no bit tables."""
    rows = corpus(3)
    monkeypatch.setattr("tessera.llm.neardup.TILE", 8)
    monkeypatch.setattr(J, "_stars", lambda placed, turn: placed.filter("false").select("node", J.F.col("node").alias("hub")))
    monkeypatch.setattr(J, "_key_table", lambda shared: None)
    assert got(J.similarity_join(table(spark, rows))) == expected(rows)


def test_linked_sets_share_a_cell():
    """Sets with as many different elements as a link allows, of all small sizes and some large ones, also where groups are empty."""
    rng = np.random.default_rng(1)
    for n in [*range(6, 90), 200, 371, 372, 1500]:
        for _ in range(6):
            pool = rng.integers(0, 1 << 63, 3 * n).astype(np.uint64)
            m = int(rng.integers(n, n * 100 // J.PERCENT + 1))
            apart = (100 - J.PERCENT) * (n + m) // (100 + J.PERCENT)
            common = (n + m - apart + 1) // 2
            if common > n:
                continue
            a, b = pool[:n], np.concatenate([pool[:common], pool[2 * n : 2 * n + m - common]])
            assert 100 * common >= J.PERCENT * (len(a) + len(b) - common)
            rows, keys = J.cell_keys(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
            assert set(keys[rows == 0].tolist()) & set(keys[rows == 1].tolist()), (n, m)


@pytest.mark.parametrize("two", [False, True])
def test_joined_trees_leave_out_only_what_the_sums_leave_out(two):
    rng = np.random.default_rng(4)

    base = rng.poisson(rng.integers(1, 5, (30, 1)), (30, J.DIMS))

    def some(k):
        counts = base[np.arange(k) % 30] + rng.binomial(1, 0.03, (k, J.DIMS))
        return {"band": rng.integers(0, 4, k), "counts": counts.astype(np.uint32), "n": counts.sum(1), "root": rng.integers(0, 30, k)}

    a, b = some(300), some(200) if two else None
    i, j = J.joined_trees(a, b)
    c = b or a
    want = set()
    for x in range(300):
        both = np.minimum(a["counts"][x].astype(int), c["counts"].astype(int)).sum(1)
        ok = (a["band"][x] == c["band"]) & (a["root"][x] != c["root"]) & ((100 + J.PERCENT) * both >= J.PERCENT * (a["n"][x] + c["n"]))
        ok &= (100 * a["n"][x] >= J.PERCENT * c["n"]) & (100 * c["n"] >= J.PERCENT * a["n"][x])
        want |= {(x, int(y)) if two else tuple(sorted((x, int(y)))) for y in np.flatnonzero(ok) if two or y != x}
    found = {(int(x), int(y)) if two else tuple(sorted((int(x), int(y)))) for x, y in zip(i, j, strict=True) if two or x != y}
    assert found == want and len(want) > 20


def test_many_texts_about_the_threshold(spark):
    """600 half-similar texts in the same cells: none linked, as none may be."""
    rng = random.Random(6)
    line = words(rng, 200)
    rows = [(i, f"{words(rng, 40)} {line} {words(rng, 40)}") for i in range(600)]
    assert {(r.doc_id, r.component_id) for r in J.similarity_join(table(spark, rows)).collect()} == {(i, i) for i in range(600)}


def test_sets_are_cut_only_where_points_allow_a_link(spark, monkeypatch):
    """Half-similar texts in the same cells have no sets cut and shuffled; two copies among them have."""
    asked = []
    monkeypatch.setattr(J, "full_sets", lambda docs, wanted, k: asked.append(sorted(r.doc_id for r in wanted.collect())) or full_sets(docs, wanted, k))
    rng = random.Random(8)
    line, near = words(rng, 200), words(rng, 90)
    rows = [(i, f"{words(rng, 40)} {line} {words(rng, 40)}") for i in range(60)] + [(100, near + " a"), (101, near + " b")]
    assert {r.doc_id: r.component_id for r in J.similarity_join(table(spark, rows)).collect()} == {i: i for i in range(60)} | {100: 100, 101: 100}
    assert asked[0] == [100, 101] and not any(asked[1:])


def test_empty_table(spark):
    assert J.similarity_join(table(spark, [])).count() == 0
