import random
import re
import time

import numpy as np

import corpus_pipeline
from tessera.llm import decontaminate as D
from tests.llm.fixtures import DOCUMENTS, awkward, table, words


def plain(a, b):
    """Smith-Waterman score by the whole table."""
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (D.MATCH if x == y else D.MISMATCH), h[i - 1, j] + D.GAP, h[i, j - 1] + D.GAP)
    return int(h.max())


def test_alignment_equals_the_whole_table():
    rng = np.random.default_rng(0)
    items = [rng.integers(1, 6, rng.integers(1, 20)).astype(np.uint64) for _ in range(60)]
    passages = [rng.integers(1, 6, rng.integers(1, 40)).astype(np.uint64) for _ in range(60)]
    score, lo, hi = D._align_batch(items, passages)
    for k in range(60):
        assert score[k] == plain(items[k], passages[k])
        assert score[k] == 0 or plain(items[k], passages[k][lo[k] : hi[k]]) == score[k]


def corpus():
    rng = random.Random(5)
    items = [(k, words(rng, rng.randint(15, 60))) for k in range(20)] + [(50, None), (51, ""), (52, "two words"), (None, words(rng, 20))]
    docs, want = [(1000 + i, t) for i, t in enumerate(words(rng, 150) for _ in range(60))], set()
    for n, (k, t) in enumerate(items[:20]):
        w = t.split()
        for _ in range(len(w) // 8):
            w[rng.randrange(len(w))] = "edited"
        del w[len(w) // 2]
        for copy, x in enumerate((t, t.upper() if t.isascii() else t, " ".join(w))):
            docs.append((3 * n + copy, f"{words(rng, 40)}. {x}! {words(rng, 40)}"))
            want.add((3 * n + copy, k))
    docs += [(5000 + i, f"a {items[3][1]} b") for i in range(200)] + [(900, None), (None, ""), (None, items[7][1])]
    want |= {(5000 + i, 3) for i in range(200)} | {(None, 7)}
    return docs, items, want


def item_table(spark, items):
    return spark.createDataFrame([(k, t, 1) for k, t in items], "item_id long, text string, words int")


def test_copies_are_found_and_others_left_alone(spark):
    docs, items, want = corpus()
    got = D.contaminated(table(spark, docs), item_table(spark, items)).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    text = dict(docs)
    for r in got:
        if r.doc_id is not None and r.score == 1:
            w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text[r.doc_id])
            assert " ".join(w[r.first_word : r.end_word]).lower() == dict(items)[r.item_id].lower()
    kept = D.keep_clean(table(spark, docs), item_table(spark, items))
    assert kept.columns == table(spark, []).columns
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect())
    bad = {i for i, _ in want if i is not None}
    assert ids == sorted((i is None, i or 0) for i, t in docs if i not in bad and not (i is None and t))


def test_many_copies_of_heavily_edited_items(spark):
    """A thousand copies each that keep a quarter of an item's runs, and partial ones, as the whole table of each pair finds them."""
    rng = random.Random(8)
    items = [(k, words(rng, 40)) for k in range(3)]
    fourth = lambda w: ["changed" if i % 4 == 3 else x for i, x in enumerate(w)]
    part = lambda w: [f"other{i}" if i in (5, 15) else x for i, x in enumerate(w[:25])]
    third = lambda w: ["changed" if i % 3 == 2 else x for i, x in enumerate(w[:24])]
    docs = [(n * 10 + k, f"before{n} the text {' '.join(edit(t.split()))} after it {n}") for n in range(1000) for k, ((_, t), edit) in enumerate(zip(items, (fourth, part, third), strict=True))]
    seen = {}
    for i, t in docs[:3]:
        w = t.split()
        for k, item in items:
            score = plain(item.split(), w)
            if score >= D.LEAST_SCORE * D.MATCH * 40:
                seen[i, k] = score / (D.MATCH * 40)
    assert set(seen) == {(0, 0), (1, 1)} and max(seen.values()) < 0.65
    got = D.contaminated(table(spark, docs), item_table(spark, items)).collect()
    assert {(r.doc_id, r.item_id): r.score for r in got} == {(10 * n + i, k): s for n in range(1000) for (i, k), s in seen.items()}


def test_small_table_equals_aligning_all_pairs(spark):
    """Every document with every item, all words, without seeds or bounds."""
    sf = "/root/testdata/sf0.001"
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    code: dict = {}
    hashed = lambda t: np.array([code.setdefault(w, len(code) + 1) for w in split(t)], np.uint64)
    d, q = [(r.doc_id, hashed(r.text)) for r in docs.collect()], [(r.item_id, hashed(r.text)) for r in items.collect()]
    pairs = [(i, k, x, y) for i, x in d for k, y in q if len(x) and len(y) and 2 * np.isin(y, x).sum() >= len(y)]  # fewer words in common can't score half
    score, lo, hi = D._align_all([y for *_, y in pairs], [x for _, _, x, _ in pairs])
    want = {(i, k): (round(s / (D.MATCH * len(y)), 9), int(a), int(b)) for (i, k, _, y), s, a, b in zip(pairs, score, lo, hi, strict=True) if s >= D.LEAST_SCORE * D.MATCH * len(y)}
    got = {(r.doc_id, r.item_id): (round(r.score, 9), r.first_word, r.end_word) for r in D.contaminated(docs, items).collect()}
    assert set(got) == set(want) and len(want) >= 3
    assert all(got[p][0] == want[p][0] for p in want)


def test_equal_alignments_give_the_first(spark):
    """Two full copies in one text, a repeated item and a repeated document: one row for each pair, of the first copy."""
    item = "alpha beta gamma delta epsilon zeta"
    docs = [(1, f"x {item} y z {item.upper()} w"), (1, f"x {item} y z {item.upper()} w"), (2, "nothing here")]
    got = D.contaminated(table(spark, docs), item_table(spark, [(5, item), (5, item), (6, item)])).collect()
    assert sorted((r.doc_id, r.item_id, r.score, r.first_word, r.end_word) for r in got) == [(1, 5, 1.0, 1, 7), (1, 6, 1.0, 1, 7)]


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    docs, items, want = corpus()
    monkeypatch.setattr(D, "BLOCK_WORDS", 400)
    assert {(r.doc_id, r.item_id) for r in D.contaminated(table(spark, docs), item_table(spark, items)).collect()} == want


def test_empty_tables(spark):
    docs, items, _ = corpus()
    assert D.contaminated(table(spark, []), item_table(spark, items)).count() == 0
    assert D.contaminated(table(spark, docs), item_table(spark, [])).count() == 0
    assert D.keep_clean(table(spark, docs), item_table(spark, [])).count() == len(docs)


def test_pipeline_stages(spark, tmp_path):
    """Each stage hands on columns and rows as its operator decides; awkward rows pass through all of them."""
    docs, items, want = corpus()
    rows = [(i, t, "en", "s", 0) for i, t in docs + [(i if i is None else i + 20_000, t) for i, t in awkward()]]
    path = str(tmp_path)
    spark.createDataFrame(rows, DOCUMENTS).write.parquet(f"{path}/documents.parquet")
    item_table(spark, items).write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i, *_ in rows if i is not None], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    now = spark.read.parquet(f"{path}/documents.parquet")
    names = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, path)
        names.append((name, out.count()))
        if name != "encoding":
            assert out.columns == now.columns
            now = out
    assert names[0][1] == len(rows)  # all labels are good
    assert names[2][1] == names[3][1] < names[1][1] < names[0][1]
    assert not {i for i, _ in want if i is not None} & {r.doc_id for r in now.collect()}
    assert corpus_pipeline.run(spark, path).count() == names[3][1]


def test_edits_of_every_kind_and_rate_equal_aligning_all_pairs(spark):
    """Words replaced, put in, dropped and swapped at every rate: whatever scores half by the whole table is found, and nothing else."""
    rng = random.Random(11)
    items = [(k, words(rng, n)) for k, n in enumerate((3, 4, 5, 8, 13, 30, 30, 61))]
    edits = {
        "replace": lambda w, r: [f"x{rng.randrange(99)}" if rng.random() < r else x for x in w],
        "put in": lambda w, r: [y for x in w for y in ([x, f"x{rng.randrange(99)}"] if rng.random() < r else [x])],
        "drop": lambda w, r: [x for x in w if rng.random() >= r],
        "swap": lambda w, r: [w[min(i + 1, len(w) - 1)] if rng.random() < r else x for i, x in enumerate(w)],
        "regular": lambda w, r: [y for i, x in enumerate(w) for y in ([x, "new"] if i % max(1, round(1 / r)) == 0 else [x])],
        "all": lambda w, r: [y for x in w if rng.random() >= r / 3 for y in ([x, "new"] if rng.random() < r / 3 else ["other"] if rng.random() < r / 3 else [x])],
    }
    docs = []
    for k, t in items:
        for edit in edits.values():
            for rate in (0.1, 0.2, 0.25, 0.3, 0.34, 0.4, 0.5, 0.6, 0.75, 1.0):
                docs.append((len(docs), f"{words(rng, 9)} {' '.join(edit(t.split(), rate))} {words(rng, 9)}"))
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
    want = {(i, k) for i, d in docs for k, t in items if plain(split(t), split(d)) >= D.LEAST_SCORE * D.MATCH * len(split(t))}
    got = {(r.doc_id, r.item_id) for r in D.contaminated(table(spark, docs), item_table(spark, items)).collect()}
    assert got == want and 150 < len(want) < 450


def test_regular_edits_that_leave_no_three_words_in_a_row(spark):
    rng = random.Random(12)
    item = words(rng, 30)
    w = item.split()
    ways = {
        "a word put in after every one": [y for x in w for y in (x, "new")],
        "a word put in after every second": [y for i, x in enumerate(w) for y in ((x, "new") if i % 2 else (x,))],
        "every third word replaced": ["new" if i % 3 == 2 else x for i, x in enumerate(w)],
        "every third word dropped": [x for i, x in enumerate(w) if i % 3 != 2],
        "a word put in after every third": [y for i, x in enumerate(w) for y in ((x, "new") if i % 3 == 2 else (x,))],
        "every fourth word replaced": ["new" if i % 4 == 3 else x for i, x in enumerate(w)],
    }
    docs = [(n * 10 + k, f"before {n} {' '.join(x)} after {n}") for n in range(200) for k, x in enumerate(ways.values())]
    found = {r.doc_id: r.score for r in D.contaminated(table(spark, docs), item_table(spark, [(1, item)])).collect()}
    assert found == {i: plain(w, d.split()) / (D.MATCH * 30) for i, d in docs} and min(found.values()) < 0.52


def test_a_phrase_that_all_items_and_documents_share(spark):
    """2,000 questions and 2,000 texts that share nothing but their first eight words: no passage is looked at, so this is a matter of seconds; copies among them are found."""
    rng = random.Random(13)
    phrase = "which of the following statements best describes the"
    items = [(k, f"{phrase} {words(rng, 12)}") for k in range(2000)]
    docs = [(k, f"{phrase} {words(rng, 60)}") for k in range(2000)] + [(5000 + k, f"{words(rng, 10)} {items[k][1]}") for k in range(0, 2000, 100)]
    began = time.time()
    got = {(r.doc_id, r.item_id) for r in D.contaminated(table(spark, docs), item_table(spark, items)).collect()}
    assert got == {(5000 + k, k) for k in range(0, 2000, 100)}
    assert time.time() - began < 30


def test_parts_of_the_items_give_the_same(spark, monkeypatch):
    docs, items, want = corpus()
    monkeypatch.setattr(D, "SEED_PAIRS", 8)
    assert {(r.doc_id, r.item_id) for r in D.contaminated(table(spark, docs), item_table(spark, items)).collect()} == want
