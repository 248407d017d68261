import hashlib
import io
import random
import re
import zlib

import pytest

from tessera.llm import license_scan as L
from tessera.llm import quality, sharding, warc
from tests.llm.fixtures import awkward, table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def base(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at = [(k, label) for p, label in L.BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
    return len(w), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None), ",".join(sorted({x for _, x in at}))


TEXTS = [
    None, "", "CC BY cc by cc-by", "All rights reserved. General Public License, general public\nlicense", "cc byé cc by", "gnu general public license all rights reserved",
    "# SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause\ncode", "SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0", "SPDX-License-Identifier: MIT OR", "Licensed under the Apache License, Version 2.0.", "x " * 50_000 + "cc by",
]


def test_licence_rows(spark):
    rows = [*enumerate(TEXTS), *awkward()]
    got = sorted(map(tuple, L.scan_licences(table(spark, rows)).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()), key=str)
    assert got == sorted(((i, *base(t)) for i, t in rows), key=str)
    full = {r.doc_id: r for r in L.scan_licences(table(spark, list(enumerate(TEXTS)))).collect()}
    assert full[6].labels == "apache-2.0,bsd-3-clause,mit,terms-permissive" and full[6].terms == "apache-2.0 and bsd-3-clause"
    assert full[7].labels == "classpath-exception-2.0,gpl-2.0-only,terms-copyleft" and full[7].terms == "gpl-2.0-only with classpath-exception-2.0"
    assert full[8].labels == "unparsed" and full[9].labels == "apache,apache-2.0"
    assert full[0].score == full[1].score == 0 and all(0 <= r.score <= 1 for r in full.values())
    assert L.scan_licences(table(spark, [])).count() == 0


@pytest.mark.parametrize(
    ("text", "rpn"),
    [("MIT", ["mit"]), ("a or b and c with d", ["a", "b", "c", "d", "with", "and", "or"]), ("(a or b) and c", ["a", "b", "or", "c", "and"]), ("a and b or c", ["a", "b", "and", "c", "or"]), ("MIT some words after", ["mit"]), ("a or", None), ("(a", None), ("", None), ("and a", None), ("a )", ["a"])],
)
def test_shunting_yard(text, rpn):
    assert L.parse(text) == rpn


def test_evaluation():
    named, sets = L.evaluate(L.parse("MIT AND (Apache-2.0 OR GPL-2.0-only WITH Classpath-exception-2.0)"))
    assert named == {"mit", "apache-2.0", "gpl-2.0-only", "classpath-exception-2.0"}
    assert sets == [frozenset({"mit", "apache-2.0"}), frozenset({"mit", "gpl-2.0-only with classpath-exception-2.0"})]
    assert L.evaluate(L.parse("MIT WITH Apache-2.0")) is None and L.evaluate(L.parse("no-such-licence")) is None


def test_expressions_with_unknown_names(spark):
    lines = ["MIT OR GFDL-1.3-only", "MIT AND BSD-4-Clause", "MIT.", "(MIT OR Own-Terms) AND ISC.", "GPL-2.0-only WITH own-exception", "Own-Terms", "MIT OR */"]
    want = ["gfdl-1.3-only,mit,terms-permissive", "bsd-4-clause,mit,terms-permissive", "mit,terms-permissive", "isc,mit,terms-permissive,unknown", "gpl-2.0-only,terms-unclear,unknown", "unparsed", "unparsed"]
    got = {r.doc_id: r for r in L.scan_licences(table(spark, [(i, f"# SPDX-License-Identifier: {x}\ncode") for i, x in enumerate(lines)])).collect()}
    assert [got[i].labels for i in range(len(lines))] == want
    assert got[3].score > got[2].score == got[0].score == pytest.approx(0.9) and got[4].score == got[5].score == pytest.approx(0.2)
    assert [got[i].terms for i in range(len(lines))] == ["mit", "bsd-4-clause and mit", "mit", "isc and mit", "gpl-2.0-only with own-exception", "", ""]


def test_best_alternative_equals_trying_all():
    """The outcome is that of the freest of all sets of terms that satisfy an expression."""
    rng = random.Random(6)
    names = ["mit", "isc", "gpl-2.0-only", "mpl-2.0", "cc-by-nc-4.0", "own-terms"]
    rank = {"mit": 0, "isc": 0, "gpl-2.0-only": 1, "mpl-2.0": 1, "cc-by-nc-4.0": 2, "own-terms": 3}

    def expression(n):
        return rng.choice(names) if n < 2 else f"({expression(n // 2)} {rng.choice(['AND', 'OR'])} {expression(n - n // 2)})"

    for _ in range(200):
        rpn = L.parse(f"mit OR gpl-2.0-only AND {expression(rng.randint(1, 9))}" if rng.random() < 0.2 else expression(rng.randint(1, 9)))
        if (got := L.evaluate(rpn)) is None:
            continue
        best, terms = L.outcome(rpn)
        assert best == min(max(rank[t] for t in x) for x in got[1]) and frozenset(terms) in got[1]


def test_all_alternatives_are_kept():
    groups = [(f"LicenseRef-a{i}", f"LicenseRef-b{i}") for i in range(7)]
    named, sets = L.evaluate(L.parse(" AND ".join(f"({a} OR {b})" for a, b in groups)))
    assert len(named) == 14 and len(set(sets)) == 128 and all(len(s) == 7 for s in sets)
    many = " AND ".join(f"(LicenseRef-a{i} OR LicenseRef-b{i})" for i in range(40))
    assert len(L.identifiers(L.parse(many))) == 80


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert len(got) == docs.count()
    held = [(r.quality, got[r.doc_id].predicted) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(q == p for q, p in held) >= 0.97 * len(held)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) for i, r in got.items())


def test_quality_equals_a_plain_discriminant(spark):
    """Scores of the whole small table against a discriminant written out row by row."""
    import math

    import numpy as np
    import pyarrow as pa

    from tessera.llm.blocks import utf8

    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = {r.doc_id: r.score for r in quality.classify(docs, labels).collect()}
    x = {r.doc_id: quality.statistics(*utf8(pa.array([r.text or ""])))[0] for r in docs.collect()}
    known = {r.doc_id: r.quality for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 != 0 and r.doc_id in x}
    sets = [np.array([x[i] for i, y in known.items() if y == k]) for k in (0, 1)]
    means = [s.mean(0) for s in sets]
    own = [np.cov(s.T, bias=True) for s in sets]
    pooled = sum(len(s) * c for s, c in zip(sets, own, strict=True)) / len(known)
    shrunk = [(1 - quality.DIAGONAL) * ((1 - quality.POOL) * c + quality.POOL * pooled) + quality.DIAGONAL * np.diag(np.diag(pooled)) + 1e-6 * np.eye(len(pooled)) for c in own]
    for i, v in x.items():
        log = [math.log((len(s) + 1) / (len(known) + 2)) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * (v - m) @ np.linalg.solve(c, v - m) for s, c, m in zip(sets, shrunk, means, strict=True)]
        assert got[i] == pytest.approx(1 / (1 + math.exp(min(700, log[0] - log[1]))), abs=1e-6)


def test_quality_with_repeated_labels(spark):
    docs = table(spark, awkward())
    one = [(i, i % 2, 0) for i, _ in awkward() if i is not None]
    twice = spark.createDataFrame(one + [(i, 0, 0) for i, *_ in one], "doc_id long, quality int, toxic int")
    scores = lambda labels: sorted((str(r.doc_id), round(r.score, 9)) for r in quality.classify(docs, labels).collect())
    assert scores(twice) == scores(spark.createDataFrame(one, "doc_id long, quality int, toxic int"))


def test_quality_edges(spark):
    rows = awkward()
    labels = spark.createDataFrame([(i, i % 2, 0) for i, _ in rows if i is not None] + [(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    docs = table(spark, rows)
    got = quality.classify(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    scores = {r.doc_id: r.score for r in got}
    assert scores[300] == scores[301]
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in got)
    assert {r.score for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(table(spark, []), labels).count() == 0


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, 0, "x", b"y") for i, u, h in rows], "page_id long, url string, html string, payload_bytes int, record_id string, data binary")


def test_warc_round_trip(spark):
    big, other = "<p>ü" * 400, "z" * 200_000
    rows = [(1, "http://a/b c", big), (2, None, big), (3, "u", None), (4, "u", ""), (5, "u", "small"), (6, "u", "small"), (7, "u", other), (8, "u\nv", other), (8, "u", "row of the same id"), (None, "u", big), (None, None, "lonely" * 300)]
    got = sorted((tuple(r) for r in warc.archive_round_trip(pages(spark, rows)).collect()), key=str)
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        ids = [k for k, _, x in rows if x == h and k is not None]
        winner = max(ids, default=None) if len(raw) >= 1000 else i
        revisit = winner is not None and winner != i
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", winner if revisit else None))
    assert got == sorted(want, key=str)
    assert warc.archive_round_trip(pages(spark, [])).count() == 0


def test_warc_chunks_carry_digests(spark, tmp_path):
    recs = warc.page_records(pages(spark, [(1, "u", "abcdefghij" * 3), (2, "u", "")]))
    listed = warc.write_archives(warc.to_chunks(recs, 7), str(tmp_path), records_per_file=1)
    assert listed.agg({"records": "sum"}).first()[0] == 2
    rows = [r for r in warc.read_archives(listed, chunk=7).collect() if r.record_id == "<urn:x-page:1>"]
    whole = b"abcdefghij" * 3
    assert [r.chunk_no for r in rows] == [0, 1, 2, 3, 4] and b"".join(r.data for r in rows) == whole
    for r in rows:
        upto = whole[: r.chunk_offset + r.chunk_bytes]
        assert (r.payload_bytes, r.payload_digest, r.last) == (len(upto), hashlib.sha1(upto).hexdigest(), r.chunk_no == 4)


def test_warc_reader_refuses_damage():
    good = b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <a>\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
    assert list(warc.records_of(io.BytesIO(good), "p"))[0][9:12] == (4, hashlib.sha1(b"abcd").hexdigest(), True)
    for bad in (b"junk\r\n", good[:-6], good.replace(b"Content-Length", b"WARC-Payload-Digest: sha1:AAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAA\r\nContent-Length")):
        with pytest.raises(ValueError):
            list(warc.records_of(io.BytesIO(bad), "p"))


def shard_rows(spark, rows, shards=40):
    got = sharding.shard(table(spark, rows), shards).collect()
    want = sorted(((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows), key=str)
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in got), key=str) == want
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
        assert r.law == "bytes" and r.grown_shard is None
    for k, x in by.items():
        assert 0 <= k < shards and sorted(r.slot for r in x) == list(range(len(x)))
    total, most = sum(r["size"] for r in got), max((r["size"] for r in got), default=0)
    for k in range(shards):
        assert abs(sum(r["size"] for r in by.get(k, [])) - total / shards) <= most
    return got


def test_shards_are_near_equal(spark):
    shard_rows(spark, awkward())
    got = shard_rows(spark, [(k, "x" * (k % 50)) for k in range(3000)])
    assert [r.doc_id for r in sorted(got, key=lambda r: (r.shard, r.slot))] == list(range(3000))


def test_overfull_ranges_are_cut_until_none_is_left(spark, monkeypatch):
    """A first draw that misses half of the bytes is mended by as many rounds as it takes."""
    rows = [(k, "x" * (1 if k < 900 else 400)) for k in range(1000)]
    first = []
    draw = sharding._draw
    monkeypatch.setattr(sharding, "_draw", lambda rows, *a: first.append(1) or ([(k, 0) for k in range(0, 800, 3)] if len(first) == 1 else draw(rows, *a)[: 1 if len(first) < 6 else None]))
    got = shard_rows(spark, rows, 8)
    assert len(first) > 5 and {r.shard for r in got} == set(range(8))


def test_cuts_are_quantiles_of_each_range():
    bounds = [(10, 0), (20, 0), (30, 0)]
    drawn = [(k, 5) for k in (11, 12, 13, 31, 32, 33, 34)]
    assert sharding._cuts(drawn, bounds, {1: 1, 2: 2, 3: 3}) == [(12, 5), (32, 5), (33, 5), (34, 5)]


def test_shards_with_a_hot_key(spark):
    shard_rows(spark, [(7, "same")] * 2000 + [(None, None)] * 500 + [(k, "y" * (k % 9)) for k in range(500)], 10)
    assert sharding.shard(table(spark, [])).count() == 0
