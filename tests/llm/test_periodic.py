import hashlib
import random
import re
import zlib

import numpy as np

from tessera.llm import periodic as P
from tessera.llm.blocks import mix
from tessera.llm.queries import op12_periodic_runs
from tests.llm.fixtures import awkward, table


def plain(w):
    """All runs of a list by looking at every distance from every place."""
    out = {}
    for q in range(1, len(w)):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(P.LEAST_LENGTH, P.PERIODS * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def damaged(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    n, g = len(w), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def expected(doc_id, text):
    w = damaged(doc_id, text)
    runs = plain(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    top = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return (doc_id, len(runs), *top, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def key(row):
    return tuple((x is None, x if x is not None else 0) for x in row)


def test_runs_equal_looking_everywhere():
    rng = random.Random(1)
    for _ in range(400):
        docs = []
        for _ in range(rng.randint(1, 4)):
            n, k = rng.randint(0, 60), rng.choice([1, 2, 3, 8])
            w = [rng.randrange(k) for _ in range(n)]
            if n > 4 and rng.random() < 0.5:
                a = rng.randrange(n)
                p = 1 + rng.randrange(max(1, (n - a) // 3))
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            docs.append(w)
        h = mix(np.array([x for w in docs for x in w], np.uint64))
        got = P.runs_of(h, np.concatenate([[0], np.cumsum([len(w) for w in docs])]).astype(np.int64))
        assert [got.get(i, []) for i in range(len(docs))] == [plain(w) for w in docs]


def test_awkward_rows_equal_plain_version(spark):
    """Nulls, empty, white-space and very long texts, repeated rows, a null id, upper case and all kinds of white space; and periodic texts."""
    rng = random.Random(3)
    rows = awkward() + [(700 + k, "\t".join(rng.choice("ab") for _ in range(40))) for k in range(40)] + [(800, "Again again " * 30), (801, "x\x0b" * 500), (802, "y z " * 20)]
    got = [tuple(r) for r in P.summary(P.periodic_runs(P.with_runs(table(spark, rows)))).collect()]
    assert sorted(got, key=key) == sorted((expected(*r) for r in rows), key=key)


def test_one_word_for_ever(spark):
    row = P.periodic_runs(spark.createDataFrame([(1, "la " * 200_000)], "doc_id long, text string")).first()
    assert [tuple(r) for r in row.runs] == [(0, 200_000, 1)] and row.collapsed == "la"


def test_small_table_equals_plain_version(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    some = [d for d in docs if len(d[1] or "") < 2_500]
    want = {d[0]: expected(*d) for d in some}
    got = [tuple(r) for r in op12_periodic_runs(spark, sf).collect()]
    assert len(got) == len(docs) and sum(r[1] > 0 for r in got) >= 5
    assert all(r == want[r[0]] for r in got if r[0] in want)


def test_empty_table(spark):
    assert P.summary(P.periodic_runs(P.with_runs(table(spark, [])))).count() == 0
