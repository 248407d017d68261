import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tessera.llm import webp as W
from tests.llm.fixtures import awkward, table


def pictures(h, w, rng):
    few = rng.integers(0, 2**32, 7, dtype=np.uint32)
    ramp = ((np.arange(h)[:, None] * 3 + np.arange(w)) % 256).astype(np.uint32) * np.uint32(0x010203) | np.uint32(0xFF000000)
    return {"noise": rng.integers(0, 2**32, (h, w), dtype=np.uint32), "few": rng.choice(few, (h, w)), "two": rng.choice(few[:2], (h, w)), "one": np.full((h, w), few[0], np.uint32), "ramp": ramp}


@pytest.mark.parametrize("shape", [(1, 1), (1, 7), (5, 3), (17, 9), (40, 33)])
def test_every_part_of_the_format_round_trips(shape):
    rng = np.random.default_rng(shape[0])
    h, w = shape
    n = -(-h // 4) * -(-w // 4)
    modes = rng.integers(0, 14, n)
    cross = rng.integers(0, 2**24, n).astype(np.uint32) | np.uint32(0xFF000000)
    for name, p in pictures(h, w, rng).items():
        options = [{}, {"subtract_green": True}, {"modes": modes, "block": 2}, {"cross": cross, "block": 2}, {"cache_bits": 1}, {"cache_bits": 11}, {"match": True}, {"match": True, "cache_bits": 5, "subtract_green": True, "modes": modes, "cross": cross, "block": 2}]
        options += [{"palette": True}, {"palette": True, "match": True}] if name in ("few", "two", "one") else []
        for o in options:
            assert (W.decode(W.encode(p, **o)) == p).all(), (name, list(o))


@pytest.mark.parametrize("mode", range(14))
def test_predictors_by_hand(mode):
    left, top, right, corner = (10, 20, 30, 40), (50, 60, 70, 80), (1, 2, 3, 4), (9, 200, 31, 255)
    mean = lambda a, b: tuple((x + y) // 2 for x, y in zip(a, b, strict=True))
    clamp = lambda a: tuple(min(255, max(0, x)) for x in a)
    half = lambda m, c: m + int((m - c) / 2)
    want = {0: (255, 0, 0, 0), 1: left, 2: top, 3: right, 4: corner, 5: mean(mean(left, right), top), 6: mean(left, corner), 7: mean(left, top), 8: mean(corner, top), 9: mean(top, right), 10: mean(mean(left, corner), mean(top, right)), 12: clamp(a + b - c for a, b, c in zip(left, top, corner, strict=True)), 13: clamp(half(m, c) for m, c in zip(mean(left, top), corner, strict=True))}
    if mode in want:
        assert W.predict(mode, left, top, right, corner) == want[mode]
    else:
        assert W.predict(mode, left, top, right, corner) in (left, top)


def test_several_code_groups_are_read():
    """An image written by hand whose entropy image chooses between two groups of one-symbol codes."""
    bits = W.BitWriter()
    for v, n in ((7, 14), (3, 14), (0, 1), (0, 3), (0, 1), (0, 1), (1, 1), (0, 3)):  # 8 x 4 pixels, no transform, no cache, groups by blocks of 4
        bits.add(v, n)
    W._write_image(bits, np.array([0xFF000000, 0xFF000100], np.uint32), 2, False)
    for g in (10, 77):
        for s in (g, 1, 2, 255, 0):
            for v, n in ((1, 1), (0, 1), (1, 1), (s, 8)):
                bits.add(v, n)
    body = b"\x2f" + bits.add_all(np.zeros(0), np.zeros(0, np.int64))
    body += bytes(len(body) & 1)
    data = b"RIFF" + (12 + len(body)).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + body
    got = W.decode(data)
    assert (got[:, :4] == 0xFF010A02).all() and (got[:, 4:] == 0xFF014D02).all()


def repeats(rng, n):
    """Bytes with runs, repeated stretches and noise."""
    out = bytearray()
    while len(out) < n:
        kind = rng.integers(0, 4)
        if kind == 0:
            out += bytes(rng.integers(97, 123, rng.integers(1, 60), dtype=np.uint8))
        elif kind == 1:
            out += bytes([int(rng.integers(0, 256))]) * int(rng.integers(1, 400))
        elif out:
            at = int(rng.integers(0, len(out)))
            out += out[at : at + int(rng.integers(1, 300))]
    return bytes(out[:n])


@pytest.mark.parametrize("n", [1, 40, 576, 577, 5000, 60_000])
def test_back_references_of_texts(n, monkeypatch):
    """Both readers, the one token by token and the one that finds all tokens at once, give the bytes back; files get smaller."""
    rng = np.random.default_rng(n)
    for _ in range(6):
        raw = repeats(rng, n)
        media = W.to_media(raw)
        got = b"".join(i[:, :, 1].tobytes() for i in W.from_media(media))
        assert got[:n] == raw
        with monkeypatch.context() as m:
            m.setattr(W, "_references", None)
            m.setattr(W, "_read_image", lambda bits, w, h, main, read=W._read_image: read(bits, w, h, False) if not main else slowly(bits, w, h))
            assert b"".join(i[:, :, 1].tobytes() for i in W.from_media(media)) == got
        if n >= 5000:
            grey = np.frombuffer(raw[: n // 576 * 576], np.uint8).reshape(-1, 576).astype(np.uint32) * np.uint32(0x010101) | np.uint32(0xFF000000)
            assert len(W.encode(grey, subtract_green=True, match=True)) < len(W.encode(grey, subtract_green=True))


def slowly(bits, w, h):
    """The main image token by token, by the plain rules of the format."""
    assert not bits.read(1) and not bits.read(1)  # no cache, one group
    codes = [W._read_code(bits, s) for s in (256 + 24, 256, 256, 256, 40)]
    out = []
    while len(out) < w * h:
        s = codes[0].read(bits)
        if s < 256:
            r, b, a = (c.read(bits) for c in codes[1:4])
            out.append(a << 24 | r << 16 | s << 8 | b)
        else:
            length, d = W._value(s - 256, bits), W._value(codes[4].read(bits), bits)
            d = d - 120 if d > 120 else max(1, W.NEAR[d - 1][0] + W.NEAR[d - 1][1] * w)
            for _ in range(length):
                out.append(out[-d])
    return np.array(out, np.uint32)


def test_parts_are_chosen_by_content():
    rng = np.random.default_rng(3)
    text = rng.integers(97, 123, (4, 576), dtype=np.uint8)
    assert W._chosen(np.full((1, 576), 255, np.uint8)) == {"palette": True, "match": True}
    assert W._chosen(text) == {"subtract_green": True, "match": True}
    slope = np.arange(40 * 576).reshape(40, 576).astype(np.uint8)
    assert (W._chosen(slope)["modes"] == 1).all()
    rows = np.tile(rng.integers(0, 256, 576, dtype=np.uint8), (30, 1)) + np.arange(30, dtype=np.uint8)[:, None]
    assert (W._chosen(rows)["modes"] == 2).all()
    for g in (text, slope, rows, np.full((3, 576), 9, np.uint8), rng.integers(0, 5, (7, 576), dtype=np.uint8)):
        media = W.to_media(g.tobytes())
        assert (W.from_media(media)[0][:, :, 1] == g).all()


def test_uniform_predictors_equal_pixel_by_pixel(monkeypatch):
    rng = np.random.default_rng(4)
    for h, w in ((1, 1), (1, 9), (6, 1), (7, 5)):
        p = rng.integers(0, 2**32, h * w, dtype=np.uint32)
        for mode in (1, 2):
            blocks = -(-w // 4) * -(-h // 4)
            fast = W._predicted(p, w, h, np.full(blocks, mode), 2, True)
            assert (W._predicted(fast, w, h, np.full(blocks, mode), 2, False) == p).all()
            mixed = np.full(blocks + 1, mode)  # one more block, of another mode, that no pixel is in
            mixed[-1] = 0
            assert (W._predicted(p, w, h, mixed, 2, True) == fast).all()


def test_a_file_of_another_encoder():
    """The public one-pixel test image by which browsers' support for lossless WebP is probed."""
    import base64

    assert W.decode(base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA==")).tolist() == [[0]]


def test_near_pixels():
    assert len(W.NEAR) == 120 and W.NEAR[:6] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0)] and W.NEAR[-1] == (8, 7)


def test_damage_is_refused():
    good = W.encode(np.arange(100, dtype=np.uint32).reshape(10, 10))
    for bad in (b"", b"RIFX" + good[4:], good[:12] + b"VP8 " + good[16:], good[:30]):
        with pytest.raises((ValueError, IndexError)):
            W.decode(bad)


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000))
def test_bytes_round_trip(raw):
    back = b"".join(i[:, :, 1].tobytes() for i in W.from_media(W.to_media(raw)))
    assert back[: len(raw)] == raw and len(back) % W.TILE == 0 and len(back) > 0 and set(back[len(raw) :]) <= {W.PAD}


def test_media_column(spark, monkeypatch):
    rows = awkward()
    got = {}
    for r in W.media_column(table(spark, rows)).collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, t in rows:
        raw = (t or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        media = W.to_media(raw)
        assert any((r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest()) for r in got[i])
    assert sum(map(len, got.values())) == len(rows)
    assert got[300][0][1:] == got[301][0][1:]
    assert W.media_column(table(spark, [])).count() == 0
    monkeypatch.setattr(W, "ROWS", 2)
    assert b"".join(i[:, :, 1].tobytes() for i in W.from_media(W.to_media(b"q" * 5000)))[:5000] == b"q" * 5000
