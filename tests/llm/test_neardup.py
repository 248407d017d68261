import random
import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tessera.llm import neardup
from tests.llm.fixtures import awkward, table

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def brute(rows):
    """set of each row, and root of each non-null id, by comparing all pairs."""
    def one(text):
        w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(LOWER))
        return frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [one(t) for _, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, _) in enumerate(rows):
        for b, (j, _) in enumerate(rows[:a]):
            if i is not None and j is not None and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                lo, hi = sorted((find(i), find(j)))
                parent[hi] = lo
    return sets, {i: find(i) for i in parent}


def test_components_equal_brute_force(spark):
    rows = awkward()
    sets, root = brute(rows)
    got = defaultdict(list)
    for r in neardup.near_duplicates(table(spark, rows)).collect():
        got[r.doc_id].append(r)
    assert sum(map(len, got.values())) == len(rows)
    for (i, _), s in zip(rows, sets, strict=True):
        assert any(r.n_shingles == len(s) for r in got[i])
        if i is not None:
            assert all(r.component_id == root[i] and r.kept == (root[i] == i) for r in got[i])
    nameless = {(r.n_shingles, r.component_id, r.kept) for r in got[None]}
    assert (0, None, True) in nameless and (len(sets[4]), 4, False) in nameless  # alone; a copy of document 4


def test_keep_one_keeps_columns_and_one_of_each_group(spark):
    rows = awkward()
    _, root = brute(rows)
    docs = table(spark, rows)
    out = neardup.keep_one(docs)
    assert out.columns == docs.columns
    ids = [r.doc_id for r in out.collect()]
    named = [i for i in ids if i is not None]
    assert sorted(named) == sorted({i for i in root if root[i] == i})
    assert ids.count(None) == 2  # the null text and the text of its own; the copies of document 4 are gone


def test_empty_table(spark):
    assert neardup.near_duplicates(table(spark, [])).count() == 0
    assert neardup.keep_one(table(spark, [])).count() == 0


@settings(max_examples=20, deadline=None)
@given(st.integers(1, 400), st.integers(0, 2**32))
def test_sketch_fills_and_estimates(n, seed):
    rng = np.random.default_rng(seed)
    common = rng.integers(0, 2**63, n, dtype=np.uint64)
    a, b = np.append(common, rng.integers(0, 2**63, n // 4, dtype=np.uint64)), np.append(common, rng.integers(0, 2**63, n // 4, dtype=np.uint64))
    s = neardup.sketches(np.concatenate([a, b, a[::-1]]), np.cumsum([0, len(a), len(b), len(a)]))
    assert (s != np.uint64(2**64 - 1)).all() and (s[0] == s[2]).all()
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((s[0] == s[1]).mean() - true) < 0.3


def test_empty_set_has_an_empty_sketch():
    assert (neardup.sketches(np.zeros(0, np.uint64), np.array([0, 0])) == np.uint64(2**64 - 1)).all()


def crowd(copies, others, seed=5, length=120):
    """(doc_id, text): near copies of one text, and texts that are about 0.5 to 0.75 similar to it and to each other."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(length)]
    rows = []
    for k in range(copies + others):
        w = list(base)
        edits = rng.randint(0, 3) if k < copies else rng.randint(4, 8)
        for at in rng.sample(range(0, length, 5), edits):
            w[at] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    rng.shuffle(rows)
    return rows


def dense_roots(rows):
    """Root of each id by comparing all sets at once."""
    ids = np.array([i for i, _ in rows])
    sets = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    code = {g: k for k, g in enumerate(sorted(set().union(*sets)))}
    m = np.zeros((len(rows), len(code)), np.float32)
    for r, s in enumerate(sets):
        m[r, [code[g] for g in s]] = 1
    both = np.rint(m @ m.T).astype(np.int64)
    size = both.diagonal()
    near = 175 * both >= 75 * (size[:, None] + size)
    label = ids.copy()
    while True:
        new = np.where(near, label, ids.max() + 1).min(1)
        if (new == label).all():
            return dict(zip(ids.tolist(), label.tolist(), strict=True)), near
        label = new


@pytest.mark.parametrize(("copies", "others", "tile", "elements", "spread"), [(1500, 700, 1024, 1 << 21, 4), (150, 90, 16, 1 << 21, 4), (150, 90, 1024, 1500, 0), (60, 200, 8, 1 << 21, 1e9)])
def test_one_crowd(spark, monkeypatch, copies, others, tile, elements, spread):
    """Near copies beside texts half as similar, as in one hot band: equal to comparing all pairs, in one tile or many, with few turns of hubs or many."""
    monkeypatch.setattr(neardup, "TILE", tile)
    monkeypatch.setattr(neardup, "TILE_ELEMENTS", elements)
    monkeypatch.setattr(neardup, "SPREAD", spread)
    rows = crowd(copies, others)
    root, near = dense_roots(rows)
    assert near.sum() > len(rows) and len(set(root.values())) > 5
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(docs).collect()} == root


def test_wanted_rows_by_a_join(spark, monkeypatch):
    """Beyond an eighth of the bit table the wanted rows are joined; components stay the same."""
    monkeypatch.setattr(neardup, "BITS", 1 << 16)
    docs = spark.createDataFrame(crowd(40, 20), "doc_id long, text string")
    few, table_ = neardup.only(docs, docs.select("doc_id").limit(10))
    assert table_ is not None and few.count() == 60
    monkeypatch.setattr(neardup, "BITS", 64)
    some = docs.select("doc_id").filter("doc_id < 30")
    joined, none = neardup.only(docs, some)
    assert none is None and joined.count() == 30
    root, _ = dense_roots(crowd(40, 20))
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(docs).collect()} == root
