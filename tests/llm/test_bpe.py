import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tessera.llm import bpe, token_counts, token_output
from tessera.llm.queries import WORD_BPE
from tessera.llm.tokenize import library_encoder
from tests.llm.fixtures import awkward, table


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORD_BPE)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="aAbeéÉ' sßİΣςŒ中́  \x1c١²½_-<|>!?\n\tthre'LL", max_size=40) | st.sampled_from(["<|endoftext|>", "x<|startoftext|> y", "İI ǅ ȺȾ", "don't we'LL 123 ½", "a\x7fb \x7f", "\x00 \x80"]))
def test_ids_and_decoding_equal_the_library(library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    own = bpe.tokenizer(WORD_BPE)
    assert own.encode(text).tolist() == ids
    assert np.frombuffer(library_encoder(WORD_BPE)(text), "<u4").tolist() == ids
    assert own.decode(np.array(ids, np.int64)) == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="aAbeéÉ sß\n  \t12½<|>!'LL", max_size=40) | st.sampled_from(["<|endoftext|>", "x<|endoftext|> y", "Hello  World's 12", " lead", "a\r\n\r\nb"]))
def test_every_tokenizer_file(name, text):
    """Files that normalise, split and decode in other ways take the library's own way for these, never the short one."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    library = Tokenizer.from_file(path)
    ids = library.encode(text, add_special_tokens=False).ids
    own = bpe.tokenizer(path)
    assert np.frombuffer(library_encoder(path)(text), "<u4").tolist() == ids
    assert own.encode(text).tolist() == ids
    assert own.decode(np.array(ids, np.int64)) == library.decode(ids, skip_special_tokens=False)


def test_unknown_models_are_refused(tmp_path):
    import json

    spec = json.load(open(WORD_BPE, encoding="utf-8"))
    for change in ({"byte_fallback": True}, {"unk_token": "a</w>"}):
        path = tmp_path / "t.json"
        path.write_text(json.dumps(spec | {"model": spec["model"] | change}))
        with pytest.raises(ValueError):
            bpe.PrefixBpe(str(path))


def test_long_pieces_and_memo_limits(library, monkeypatch):
    from tessera.llm import tokenize

    monkeypatch.setattr(tokenize, "MEMO_ENTRIES", 3)
    monkeypatch.setattr(bpe, "MEMO_PAIRS", 3)
    own = bpe.PrefixBpe(WORD_BPE)
    rng = random.Random(3)
    for n in (1, 200, 3000):
        text = "".join(rng.choice("thereinandoug") for _ in range(n)) + " $$$ %%% word word"
        assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_round_trip_rows(spark, library):
    rows = awkward()
    got = sorted(map(tuple, bpe.round_trip(table(spark, rows), WORD_BPE).collect()), key=str)
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.round_trip(table(spark, []), WORD_BPE).count() == 0


def test_encode_column(spark, library):
    out = bpe.encode(table(spark, [(1, "Hello world"), (2, None)]), WORD_BPE).collect()
    assert {r.doc_id: r.ids for r in out} == {1: library.encode("Hello world", add_special_tokens=False).ids, 2: []}


def test_token_files(spark, library):
    rows = awkward()
    got = token_output.token_files(table(spark, rows), WORD_BPE).orderBy("start").collect()
    assert len(got) == len(rows)
    ids = {}
    for i, t in rows:
        x = np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        ids.setdefault(i, []).append((len(x), zlib.crc32(x.tobytes())))
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in got if r.doc_id is not None) == sorted((i, *x) for i in ids if i is not None for x in ids[i])
    keys = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert keys == sorted(keys)
    start = 0
    for r in got:
        assert r.start == start
        start += r.n_tokens
    assert token_output.token_files(table(spark, []), WORD_BPE).count() == 0


def test_several_files_a_task_and_skewed_ranges(spark, library, tmp_path, monkeypatch):
    """One row repeated very often is spread over tasks; tasks close files early; the order over all files holds."""
    rows = [(5, "the same words")] * 600 + [(k, f"text {k}") for k in range(10)] + [(7, None)]
    docs = table(spark, rows)
    listed = token_output.write_token_files(docs, WORD_BPE, str(tmp_path / "a"), files=4)
    assert sum(r.n_docs > 100 for r in listed.collect()) >= 2
    # The limits reach the workers with the code that tests send, so small files are asked for through the writer itself.
    docs_in = {k: np.arange(k, dtype="<u4") for k in range(30)}
    parts, at = [], 0
    while at < 30:
        path = str(tmp_path / f"{at}.zst")
        with open(path, "wb") as out:
            w = token_output.FrameWriter(out, frame_ids=16)
            while at < 30 and w.ids < 40:
                w.add(at, docs_in[at].tobytes())
                at += 1
            w.close()
        parts.append((len(parts), path, len(w.keys), w.ids))
    assert len(parts) > 5
    manifest = spark.createDataFrame(parts, "file_no long, path string, n_docs long, n_ids long")
    got = token_output.read_token_files(manifest).orderBy("doc_id").collect()
    assert [(r.doc_id, r.start, r.n_tokens) for r in got] == [(k, k * (k - 1) // 2, k) for k in range(30)]


def test_frames_and_random_access(tmp_path):
    rng = np.random.default_rng(0)
    docs = {k: rng.integers(0, 50_000, n).astype("<u4") for k, n in enumerate([5, 0, 40, 1000, 3, 7])}
    path = str(tmp_path / "a.zst")
    with open(path, "wb") as out:
        w = token_output.FrameWriter(out, frame_ids=50)
        for k, x in docs.items():
            w.add(k, x.tobytes())
        w.close()
    for k, x in token_output.read_documents(path, {1, 3, 5}).items():
        assert (x == docs[k]).all()
    reader = token_output.FrameReader(token_output.opened(path))
    list(reader.parts(0))
    assert reader.held[0] == 0 and reader.frames > 20
    import zstandard

    with open(path, "rb") as f:  # a plain reader sees the ids alone
        assert zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read() == b"".join(x.tobytes() for x in docs.values())
    raw = bytearray(open(path, "rb").read())
    raw[int(reader.where[3]) + 10] ^= 255
    open(path, "wb").write(raw)
    with pytest.raises((ValueError, zstandard.ZstdError)):
        token_output.read_documents(path, {3})


def test_length_table(spark, library):
    rows = awkward()
    n = [len(library.encode(t or "", add_special_tokens=False).ids) for _, t in rows]
    got = {r.n_tokens: r for r in token_counts.token_counts(table(spark, rows), WORD_BPE).collect()}
    assert set(got) == set(n) | set(token_counts.LIMITS)
    for k, r in got.items():
        assert r.n_docs == n.count(k)
        assert r.docs_at_least == sum(x >= k for x in n) and r.tokens_at_least == sum(x for x in n if x >= k)
        assert r.tokens_truncated == sum(min(x, k) for x in n)
        assert r.docs_whole == sum(x <= k for x in n) and abs(r.share_at_most - r.docs_whole / len(n)) < 1e-12
    full = token_counts.token_counts(table(spark, rows), WORD_BPE)
    limits = [0, 1, 2, 50, 77, 77, 10_000, 10**7]
    counted = spark.createDataFrame([(x,) for x in n] + [(None,)], "n_tokens long")
    cut = token_counts.at_limits(counted, spark.createDataFrame([(x,) for x in [*limits, None]], "context_limit int")).collect()
    assert len(cut) == len(set(limits))
    for r in cut:
        m = r.context_limit
        assert (r.docs_whole, r.docs_cut, r.tokens_kept) == (sum(x <= m for x in n), sum(x > m for x in n), sum(min(x, m) for x in n))
    for r in token_counts.quantiles(full, [0.1, 0.5, 1.0]).collect():
        assert r.n_tokens == sorted(n)[max(0, -(-int(r.q * 1000) * len(n) // 1000) - 1)]
    assert token_counts.token_counts(table(spark, []), WORD_BPE).count() == 0
