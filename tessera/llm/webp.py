"""Lossless WebP: pixel arrays to files and back, and a media column that stores texts' bytes as images.

The reader takes all the format has: prefix codes (simple and coded), groups of codes chosen by an entropy image, back-references, the colour
cache, and the predictor, cross-colour, subtract-green and palette transforms. Images are (height, width) arrays of
ARGB as unsigned 32-bit integers.

Where a code group holds literals only, or green values and back-references, tokens are found side by side: a table look-up at every bit position says how far the
next token would be, so a token's place follows from that of the one before by one addition.

Texts are stored as grey images, and what helps is chosen by content, alike for equal texts: a palette with packed pixels for few values, a predictor where it
makes the values plainer, back-references for what stood before. Grey images leave nothing to cross-colour once green is subtracted, and a colour
takes no more bits than a cache index, so these two parts are read and written for other images only.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.session import ship

# Fixed values of the format: the order of the lengths of the code-length code; symbols of each kind.
_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
_LENGTHS, _DISTANCES = 24, 40
_HASH = 0x1E35A7BD
_PREDICTOR, _CROSS, _GREEN, _PALETTE = 0, 1, 2, 3

#: Near pixels (columns to the left, rows up) that the first 120 distance codes name: by distance, then by columns, those to the left first.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))

#: Bytes of a tile, rows of a stored image and pad byte of the media column.
TILE, ROWS, PAD = 576, 2048, 255


# Bits -----------------------------------------------------------------------------------------------------------------


class BitReader:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data + bytes(8), 8 * at

    def read(self, n: int) -> int:
        k = self.at >> 3
        out = int.from_bytes(self.data[k : k + 6], "little") >> (self.at & 7) & ((1 << n) - 1)
        self.at += n
        if self.at > 8 * (len(self.data) - 8):
            raise ValueError("the image ends too soon")
        return out


class BitWriter:
    """Values, lowest bit first."""

    def __init__(self):
        self.value, self.size = 0, 0

    def add(self, value: int, n: int) -> None:
        self.value |= value << self.size
        self.size += n

    def add_all(self, values: np.ndarray, sizes: np.ndarray) -> bytes:
        """What was added before and then these, as bytes."""
        lead = np.frombuffer(self.value.to_bytes((self.size + 7) // 8 + 4, "little"), np.uint8)
        ends = np.cumsum(sizes, dtype=np.int64) + self.size
        start = ends - sizes
        total = int(ends[-1]) if len(ends) else self.size
        out = np.zeros(total // 32 + 2, np.uint64)
        if len(values):
            word = start >> 5
            shifted = values.astype(np.uint64) << (start & 31).astype(np.uint64)
            first = np.flatnonzero(np.diff(word, prepend=-1))
            both = np.bitwise_or.reduceat(shifted, first)
            out[word[first]] = both & np.uint64(0xFFFFFFFF)
            out[word[first] + 1] |= both >> np.uint64(32)
        raw = out.astype("<u4").view(np.uint8)[: (total + 7) // 8].copy()
        n = (self.size + 7) // 8
        raw[:n] |= lead[:n]
        return raw.tobytes()


_reversals: dict[int, np.ndarray] = {}


def _reversal(bits: int) -> np.ndarray:
    """Every number of so many bits with its bits in the other order."""
    if bits not in _reversals:
        n, out = np.arange(1 << bits), np.zeros(1 << bits, np.int64)
        for k in range(bits):
            out |= (n >> k & 1) << (bits - 1 - k)
        _reversals[bits] = out
    return _reversals[bits]


class Code:
    """A canonical prefix code: from the next ``width`` bits to symbol and length by one look-up. One symbol takes no bits."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        if not len(used):
            used = np.zeros(1, np.int64)
        if len(used) == 1:
            self.width, self.symbol, self.size = 0, used.astype(np.int64), np.zeros(1, np.uint8)
            return
        order = used[np.argsort(lengths[used], kind="stable")]
        size = lengths[order].astype(np.int64)
        self.width = int(size[-1])
        spans = 1 << (self.width - size)
        if spans.sum() != 1 << self.width:
            raise ValueError("a prefix code is not complete")
        turn = _reversal(self.width)
        self.symbol, self.size = np.repeat(order, spans)[turn], np.repeat(size, spans).astype(np.uint8)[turn]

    def read(self, bits: BitReader) -> int:
        if not self.width:
            return int(self.symbol[0])
        k = bits.at >> 3
        i = int.from_bytes(bits.data[k : k + 4], "little") >> (bits.at & 7) & ((1 << self.width) - 1)
        bits.at += int(self.size[i])
        return int(self.symbol[i])


def _read_code(bits: BitReader, alphabet: int) -> Code:
    lengths = np.zeros(alphabet, np.int64)
    if bits.read(1):
        two = bits.read(1)
        lengths[bits.read(8 if bits.read(1) else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return Code(lengths)
    own = np.zeros(19, np.int64)
    for k in range(4 + bits.read(4)):
        own[_LENGTH_ORDER[k]] = bits.read(3)
    code = Code(own)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    at, last, found = 0, 8, {}
    symbol, size, mask = code.symbol.tolist(), code.size.tolist(), (1 << code.width) - 1
    # The lengths take at most 14 bits a symbol; they are read off one whole number.
    begin = bits.at
    ahead = int.from_bytes(bits.data[begin >> 3 : (begin >> 3) + alphabet * 14 // 8 + 8], "little") >> (begin & 7)
    used = 0
    while at < alphabet and left:
        left -= 1
        i = ahead & mask
        s, n = symbol[i], size[i]
        if s < 16:
            if s:
                found[at] = last = s
            at += 1
        else:
            extra = 2 if s == 16 else 3 if s == 17 else 7
            run = (11 if s == 18 else 3) + (ahead >> n & ((1 << extra) - 1))
            n += extra
            if at + run > alphabet:
                raise ValueError("a run of code lengths is too long")
            if s == 16:
                found.update((k, last) for k in range(at, at + run))
            at += run
        ahead >>= n
        used += n
    bits.read(0)
    bits.at = begin + used
    lengths[list(found)] = list(found.values())
    return Code(lengths)


# Reading --------------------------------------------------------------------------------------------------------------


def _value(code: int, bits: BitReader) -> int:
    """A length or distance from its prefix code and extra bits."""
    if code < 4:
        return code + 1
    extra = (code - 2) >> 1
    return ((2 + (code & 1)) << extra) + bits.read(extra) + 1


def _literals(bits: BitReader, codes: list[Code], n: int) -> np.ndarray:
    """``n`` pixels of a group without back-references and cache."""
    if not any(c.width for c in codes[:4]):
        g, r, b, a = (int(c.symbol[0]) for c in codes[:4])
        return np.full(n, a << 24 | r << 16 | g << 8 | b, np.uint32)
    first = bits.at >> 3
    raw = np.frombuffer(bits.data, np.uint8)[first : first + (n * sum(c.width for c in codes[:4]) + 7) // 8 + 8]
    window = raw.astype(np.int64)
    window[:-1] |= window[1:] << 8
    window[:-2] |= (window[2:] & 255) << 16
    spread = (window[:, None] >> np.arange(8)).ravel()
    last = len(spread) - 1
    live = [c for c in codes[:4] if c.width]
    place = np.arange(len(spread))
    jump = place
    for c in live:
        step = c.size[spread & ((1 << c.width) - 1)]
        jump = jump + (step if jump is place else step[jump])
        np.minimum(jump, last, out=jump)
    far, stride = jump, 8 if n > 64 else 1
    if stride > 1:
        for _ in range(3):
            far = far[far]
    anchors, at = [], bits.at - 8 * first
    step_to = memoryview(np.ascontiguousarray(far))
    for _ in range(-(-n // stride)):
        anchors.append(at)
        at = step_to[at]
    places = np.empty((len(anchors), stride), np.int64)
    places[:, 0] = anchors
    for k in range(1, stride):
        places[:, k] = jump[places[:, k - 1]]
    places = places.ravel()[:n]
    end = int(jump[places[-1]])
    if end >= last and end > 8 * (len(bits.data) - 8 - first):
        raise ValueError("the image ends too soon")
    out = np.zeros(n, np.uint32)
    for c, shift in zip(codes[:4], (8, 16, 0, 24), strict=True):
        if not c.width:
            out |= np.uint32(int(c.symbol[0]) << shift)
            continue
        look = spread[places] & ((1 << c.width) - 1)
        out |= c.symbol[look].astype(np.uint32) << np.uint32(shift)
        places = places + c.size[look]
    bits.at = 8 * first + end
    return out


def _prefixed(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of extra bits and smallest value of length or distance codes."""
    extra = np.maximum((code - 2) >> 1, 0)
    return extra, np.where(code < 4, code + 1, ((2 + (code & 1)) << extra) + 1)


def _references(bits: BitReader, codes: list[Code], n: int, w: int) -> np.ndarray:
    """``n`` pixels of a group of green values and back-references; the other channels have one value each."""
    first = bits.at >> 3
    raw = np.frombuffer(bits.data, np.uint8)[first:]
    window = raw.astype(np.int64)
    for k in (1, 2, 3):
        window[:-k] |= raw[k:].astype(np.int64) << (8 * k)
    spread = (window[:, None] >> np.arange(8)).ravel()
    last = len(spread) - 1
    green, far_code = codes[0], codes[4]
    look = (green.size + (np.uint8(64) * (green.symbol >= 256)).astype(np.uint8))[spread & ((1 << green.width) - 1)]
    jump = np.arange(len(spread)) + (look & 63)
    refs = np.flatnonzero(look & 64)
    # Of everything that would be a reference: its length, its distance and where it ends.
    at = np.minimum(jump[refs], last)
    extra, least = _prefixed(green.symbol[spread[refs] & ((1 << green.width) - 1)] - 256)
    length = least + (spread[at] & ((1 << extra) - 1))
    at = np.minimum(at + extra, last)
    i = spread[at] & ((1 << far_code.width) - 1)
    extra, least = _prefixed(far_code.symbol[i])
    at = np.minimum(at + far_code.size[i], last)
    distance = least + (spread[at] & ((1 << extra) - 1))
    jump[refs] = at + extra
    np.minimum(jump, last, out=jump)
    far = jump
    for _ in range(3):
        far = far[far]
    anchors, at = [], bits.at - 8 * first
    step_to = memoryview(np.ascontiguousarray(far))
    while at < last and len(anchors) <= n:
        anchors.append(at)
        at = step_to[at]
    places = np.empty((len(anchors), 8), np.int64)
    places[:, 0] = anchors
    for k in range(1, 8):
        places[:, k] = jump[places[:, k - 1]]
    places = places.ravel()
    is_ref = (look[places] & 64) > 0
    which = np.searchsorted(refs, places[is_ref])
    size = np.ones(len(places), np.int64)
    size[is_ref] = length[which]
    upto = np.cumsum(size)
    tokens = int(np.searchsorted(upto, n)) + 1
    if tokens > len(places) or upto[tokens - 1] != n or (end := int(jump[places[tokens - 1]])) > 8 * (len(bits.data) - 8 - first):
        raise ValueError("the image ends too soon or a back-reference leaves it")
    is_ref, start = is_ref[:tokens], (upto - size)[:tokens]
    out = np.zeros(n, np.uint8)
    out[start[~is_ref]] = green.symbol[spread[places[:tokens][~is_ref]] & ((1 << green.width) - 1)]
    which = which[: np.count_nonzero(is_ref)]
    for begin, m, d in zip(start[is_ref].tolist(), length[which].tolist(), distance[which].tolist(), strict=True):
        d = d - len(NEAR) if d > len(NEAR) else max(1, NEAR[d - 1][0] + NEAR[d - 1][1] * w)
        if d > begin:
            raise ValueError("a back-reference leaves the image")
        out[begin : begin + m] = out[begin - d : begin - d + m] if d >= m else np.resize(out[begin - d : begin], m)
    bits.at = 8 * first + end
    r, b, a = (int(c.symbol[0]) for c in codes[1:4])
    return out.astype(np.uint32) << np.uint32(8) | np.uint32(a << 24 | r << 16 | b)


def _read_image(bits: BitReader, w: int, h: int, main: bool) -> np.ndarray:
    """Pixels of an entropy-coded image; ``main`` ones may have several code groups."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("the colour cache is too large")
    groups, chosen, block = 1, None, 0
    if main and bits.read(1):
        block = bits.read(3) + 2
        bw = -(-w // (1 << block))
        picture = _read_image(bits, bw, -(-h // (1 << block)), False)
        chosen = (picture >> np.uint32(8) & np.uint32(0xFFFF)).astype(np.int64)
        groups = int(chosen.max()) + 1
    sizes = (256 + _LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, _DISTANCES)
    codes = [[_read_code(bits, s) for s in sizes] for _ in range(groups)]
    n = w * h
    if groups == 1 and not cache_bits and codes[0][0].symbol.max() < 256 and sum(c.width for c in codes[0][:4]) <= 24 and all(c.width <= 15 for c in codes[0]):
        return _literals(bits, codes[0], n)
    if main and groups == 1 and not cache_bits and codes[0][0].width and not any(c.width for c in codes[0][1:4]) and all(c.width <= 15 for c in codes[0]):
        return _references(bits, codes[0], n, w)
    out = [0] * n
    cache = [0] * (1 << cache_bits)
    fresh = at = 0  # pixels before ``fresh`` are in the cache
    while at < n:
        g = codes[chosen[(at // w >> block) * bw + (at % w >> block)]] if chosen is not None else codes[0]
        s = g[0].read(bits)
        if s < 256:
            r, b, a = g[1].read(bits), g[2].read(bits), g[3].read(bits)
            out[at] = a << 24 | r << 16 | s << 8 | b
            at += 1
        elif s < 256 + _LENGTHS:
            length = _value(s - 256, bits)
            d = _value(g[4].read(bits), bits)
            d = d - len(NEAR) if d > len(NEAR) else max(1, NEAR[d - 1][0] + NEAR[d - 1][1] * w)
            if d > at or at + length > n:
                raise ValueError("a back-reference leaves the image")
            for _ in range(length):
                out[at] = out[at - d]
                at += 1
        else:
            for k in range(fresh, at):
                cache[(_HASH * out[k] & 0xFFFFFFFF) >> (32 - cache_bits)] = out[k]
            fresh = at
            out[at] = cache[s - 256 - _LENGTHS]
            at += 1
    if bits.at > 8 * (len(bits.data) - 8):
        raise ValueError("the image ends too soon")
    return np.array(out, np.uint32)


def _mean(a: tuple, b: tuple) -> tuple:
    return tuple((x + y) >> 1 for x, y in zip(a, b, strict=True))


def predict(mode: int, left: tuple, top: tuple, right: tuple, corner: tuple) -> tuple:
    """A pixel's prediction from its neighbours (tuples of A, R, G, B): ``right`` is above and to the right, ``corner`` above and to the left."""
    match mode:
        case 1:
            return left
        case 2:
            return top
        case 3:
            return right
        case 4:
            return corner
        case 5:
            return _mean(_mean(left, right), top)
        case 6:
            return _mean(left, corner)
        case 7:
            return _mean(left, top)
        case 8:
            return _mean(corner, top)
        case 9:
            return _mean(top, right)
        case 10:
            return _mean(_mean(left, corner), _mean(top, right))
        case 11:
            to_left = sum(abs(t - c) for t, c in zip(top, corner, strict=True))
            to_top = sum(abs(x - c) for x, c in zip(left, corner, strict=True))
            return left if to_left < to_top else top
        case 12:
            return tuple(min(255, max(0, x + t - c)) for x, t, c in zip(left, top, corner, strict=True))
        case 13:
            half = [(m, m - c) for m, c in zip(_mean(left, top), corner, strict=True)]
            return tuple(min(255, max(0, m + (d // 2 if d >= 0 else -(-d // 2)))) for m, d in half)
        case _:
            return (255, 0, 0, 0)


def _neighbour_mode(x: int, y: int, mode: int) -> int:
    """The first pixel has no neighbour, the first row only left ones, the first column only upper ones."""
    return mode if x and y else 0 if not (x or y) else 1 if not y else 2


def _predicted(pixels: np.ndarray, w: int, h: int, modes: np.ndarray, block: int, forward: bool) -> np.ndarray:
    """The predictor transform, or its inverse. ``modes`` has a mode for each block; where all are the left or all the upper pixel, rows are worked on as a whole."""
    if (modes == modes[0]).all() and modes[0] in (1, 2):
        x = np.ascontiguousarray(pixels).view(np.uint8).reshape(h, w, 4)
        out = x.copy()
        along, across = (slice(None), slice(1, None)), (slice(1, None), slice(None) if modes[0] == 2 else slice(0, 1))
        if modes[0] == 2:
            along = (slice(0, 1), slice(1, None))
        if forward:
            out[0, 0] -= np.array([0, 0, 0, 255], np.uint8)
            out[along] -= x[along[0], :-1]
            out[across] -= x[:-1, across[1]]
        else:
            out[0, 0] += np.array([0, 0, 0, 255], np.uint8)
            if modes[0] == 1:
                out[:, 0] = np.cumsum(out[:, 0], axis=0, dtype=np.uint8)
                out = np.cumsum(out, axis=1, dtype=np.uint8)
            else:
                out[0] = np.cumsum(out[0], axis=0, dtype=np.uint8)
                out = np.cumsum(out, axis=0, dtype=np.uint8)
        return np.ascontiguousarray(out).view(np.uint32).ravel()
    bw = -(-w // (1 << block))
    source = pixels.view(np.uint8).reshape(-1, 4)[:, ::-1].tolist()
    done: list = list(source) if forward else [None] * len(source)
    out = [None] * len(source)
    for y in range(h):
        for x in range(w):
            i = y * w + x
            mode = _neighbour_mode(x, y, int(modes[(y >> block) * bw + (x >> block)]))
            near = [done[k] if k >= 0 else (255, 0, 0, 0) for k in (i - 1, i - w, i - w + 1, i - w - 1)]
            p = predict(mode, *near)
            if forward:
                out[i] = [(a - b) & 255 for a, b in zip(source[i], p, strict=True)]
            else:
                out[i] = done[i] = [(a + b) & 255 for a, b in zip(source[i], p, strict=True)]
    return np.ascontiguousarray(np.array(out, np.uint8)[:, ::-1]).view(np.uint32).ravel()


def _channels(pixels: np.ndarray) -> tuple[np.ndarray, ...]:
    return tuple((pixels >> np.uint32(s) & np.uint32(255)).astype(np.int32) for s in (24, 16, 8, 0))


def _joined(a: np.ndarray, r: np.ndarray, g: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a & 255).astype(np.uint32) << np.uint32(24)) | ((r & 255).astype(np.uint32) << np.uint32(16)) | ((g & 255).astype(np.uint32) << np.uint32(8)) | (b & 255).astype(np.uint32)


def _signed(x: np.ndarray) -> np.ndarray:
    return ((x + 128) & 255) - 128


def _crossed(pixels: np.ndarray, w: int, h: int, elements: np.ndarray, block: int, forward: bool) -> np.ndarray:
    """The cross-colour transform, or its inverse. ``elements`` has a pixel of multipliers for each block."""
    bw = -(-w // (1 << block))
    y, x = np.divmod(np.arange(w * h), w)
    _, red_blue, green_blue, green_red = (_signed(c) for c in _channels(elements[(y >> block) * bw + (x >> block)]))
    a, r, g, b = _channels(pixels)
    sign = -1 if forward else 1
    new = r + sign * (green_red * _signed(g) >> 5)
    b = b + sign * (green_blue * _signed(g) >> 5)
    b = b + sign * (red_blue * _signed((r if forward else new) & 255) >> 5)
    return _joined(a, new, g, b)


def _cumulated(table: np.ndarray) -> np.ndarray:
    return _joined(*(np.cumsum(c) for c in _channels(table)))


def _pack_bits(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def decode(data: bytes) -> np.ndarray:
    """Pixels of a lossless WebP file."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    at, end = 12, 8 + struct.unpack_from("<I", data, 4)[0]
    while data[at : at + 4] != b"VP8L":
        at += 8 + (struct.unpack_from("<I", data, at + 4)[0] + 1) // 2 * 2
        if at + 8 > end:
            raise ValueError("no lossless image in the file")
    (size,) = struct.unpack_from("<I", data, at + 4)
    body = data[at + 8 : at + 8 + size]
    if not body or body[0] != 0x2F:
        raise ValueError("the lossless image has no signature")
    bits = BitReader(body, 1)
    w, h = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    undo, width = [], w
    while bits.read(1):
        kind = bits.read(2)
        if kind in (_PREDICTOR, _CROSS):
            block = bits.read(3) + 2
            undo.append((kind, width, block, _read_image(bits, -(-width // (1 << block)), -(-h // (1 << block)), False)))
        elif kind == _PALETTE:
            n = bits.read(8) + 1
            undo.append((kind, width, _pack_bits(n), _cumulated(_read_image(bits, n, 1, False))))
            width = -(-width // (1 << _pack_bits(n)))
        else:
            undo.append((kind, width, 0, None))
    pixels = _read_image(bits, width, h, True)
    for kind, wide, block, extra in reversed(undo):
        if kind == _PREDICTOR:
            pixels = _predicted(pixels, wide, h, extra >> np.uint32(8) & np.uint32(15), block, False)
        elif kind == _CROSS:
            pixels = _crossed(pixels, wide, h, extra, block, False)
        elif kind == _GREEN:
            g = pixels >> np.uint32(8) & np.uint32(255)
            rb = ((pixels & np.uint32(0x00FF00FF)) + (g << np.uint32(16) | g)) & np.uint32(0x00FF00FF)
            pixels = (pixels & np.uint32(0xFF00FF00)) | rb
        else:
            step = 8 >> block
            packed = (pixels >> np.uint32(8) & np.uint32(255)).reshape(h, -1)
            index = (packed[:, :, None] >> (np.arange(1 << block, dtype=np.uint32) * np.uint32(step)) & np.uint32((1 << step) - 1)).reshape(h, -1)[:, :wide]
            pixels = np.append(extra, np.zeros(256 - len(extra), np.uint32))[index].ravel()
    return pixels.reshape(h, w)


# Writing --------------------------------------------------------------------------------------------------------------


def _code_lengths(counts: np.ndarray, most: int) -> np.ndarray:
    """Huffman lengths of at most ``most`` bits: small counts are raised until the tree is shallow enough. Ties go by order."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        out[used] = 1
        return out
    floor, m = 1, len(used)
    order = used[np.argsort(counts[used], kind="stable")]
    ascending = counts[order].tolist()
    while True:
        # Leaves and joined nodes are both in ascending order, so the two smallest are at the fronts.
        weight = [max(c, floor) for c in ascending]
        parent = [0] * (2 * m - 1)
        leaf, node = 0, m
        for new in range(m, 2 * m - 1):
            total = 0
            for _ in (0, 1):
                if leaf < m and (node >= new or weight[leaf] <= weight[node]):
                    k, leaf = leaf, leaf + 1
                else:
                    k, node = node, node + 1
                parent[k] = new
                total += weight[k]
            weight.append(total)
        depth = [0] * (2 * m - 1)
        for k in range(2 * m - 3, -1, -1):
            depth[k] = depth[parent[k]] + 1
        if max(depth[:m]) <= most:
            out[order] = depth[:m]
            return out
        floor *= 2


def _bit_patterns(lengths: np.ndarray) -> np.ndarray:
    """Each symbol's canonical code, first bit lowest."""
    out = np.zeros(len(lengths), np.int64)
    used = np.flatnonzero(lengths)
    if len(used) < 2:
        return out
    order = used[np.argsort(lengths[used], kind="stable")]
    size = lengths[order]
    most = int(size[-1])
    spans = 1 << (most - size)
    first = np.concatenate([[0], np.cumsum(spans)[:-1]])
    out[order] = _reversal(most)[first]
    return out


def _write_code(bits: BitWriter, lengths: np.ndarray) -> np.ndarray:
    """Write a code's lengths; returns what each symbol then takes (nothing, if there is only one)."""
    used = np.flatnonzero(lengths)
    if len(used) == 0:
        used = np.zeros(1, np.int64)
    if len(used) <= 2 and used[-1] < 256:
        bits.add(1, 1)
        bits.add(len(used) - 1, 1)
        bits.add(1, 1)
        for s in used:
            bits.add(int(s), 8)
        return np.where(lengths > 0, 1, 0) if len(used) == 2 else np.zeros(len(lengths), np.int64)
    tokens: list[tuple[int, int, int]] = []
    at = 0
    for s in used.tolist():
        gap = s - at
        while gap >= 11:
            n = min(gap, 138)
            tokens.append((18, n - 11, 7))
            gap -= n
        if gap >= 3:
            tokens.append((17, gap - 3, 3))
            gap = 0
        tokens += [(0, 0, 0)] * gap
        tokens.append((int(lengths[s]), 0, 0))
        at = s + 1
    own = _code_lengths(np.bincount([t[0] for t in tokens], minlength=19), 7)
    n = max(4, 1 + max(k for k, s in enumerate(_LENGTH_ORDER) if own[s]))
    bits.add(0, 1)
    bits.add(n - 4, 4)
    for s in _LENGTH_ORDER[:n]:
        bits.add(int(own[s]), 3)
    # The number of tokens, so that the zeros at the end need none.
    bits.add(1, 1)
    wide = max(1, (len(tokens) - 2).bit_length() + 1 >> 1)
    bits.add(wide - 1, 3)
    bits.add(len(tokens) - 2, 2 * wide)
    pattern, size = _bit_patterns(own).tolist(), own.tolist()
    alone = np.count_nonzero(own) == 1
    value = done = 0
    for s, extra, m in tokens:
        n = 0 if alone else size[s]
        value |= (pattern[s] | extra << n) << done
        done += n + m
    bits.add(value, done)
    return lengths if len(used) > 1 else np.zeros(len(lengths), np.int64)


def _prefix(value: int) -> tuple[int, int, int]:
    """Prefix code, extra bits and their number of a length or distance."""
    if value <= 4:
        return value - 1, 0, 0
    v = value - 1
    high = v.bit_length() - 1
    second = v >> (high - 1) & 1
    return 2 * high + second, v & ((1 << (high - 1)) - 1), high - 1


#: Values that a back-reference repeats at least, at most, and how far back at most.
LEAST_MATCH, MOST_MATCH, MOST_DISTANCE = 16, 4096, (1 << 20) - 512

#: Values that back-references must cover before they are worth codes of their own.
LEAST_COVERED = 64


def _matches(g: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, distance) of what stood before in a row of bytes, from the left; each is looked up at the first place of its first ``LEAST_MATCH`` bytes."""
    n = len(g) - LEAST_MATCH + 1
    if n < 2:
        return []
    words = np.ndarray((len(g) - 7,), "<u8", np.ascontiguousarray(g).tobytes(), 0, (1,))
    h = words[:n] * np.uint64(0x9E3779B97F4A7C15) + (words[8 : 8 + n] ^ words[:n] >> np.uint64(29)) * np.uint64(0xC2B2AE3D27D4EB4F)
    slot = (h >> np.uint64(64 - max(12, n.bit_length() + 1))).astype(np.int64)
    table = np.zeros(1 << max(12, n.bit_length() + 1), np.int64)
    place = np.arange(n)
    table[slot[::-1]] = place[::-1]
    before = table[slot]
    able = np.flatnonzero((before < place) & (h[before] == h) & (place - before <= MOST_DISTANCE))
    out, at, k = [], 0, 0
    while (k := k + int(np.searchsorted(able[k:], at))) < len(able):
        at = int(able[k])
        source, most, m, step = int(before[at]), min(MOST_MATCH, len(g) - at), 0, 64
        while m < most:
            step = min(step, most - m)
            differ = np.flatnonzero(g[source + m : source + m + step] != g[at + m : at + m + step])[:1]
            if len(differ):
                m += int(differ[0])
                break
            m, step = m + step, 2 * step
        if m >= LEAST_MATCH:
            out.append((at, m, at - source))
            at += m
        else:
            at += 1
    return out


def _prefixes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``_prefix`` of many values."""
    v = np.maximum(values - 1, 1)
    high = np.frexp(v.astype(float))[1] - 1
    small = values <= 4
    bits = np.where(small, 0, high - 1)
    return np.where(small, values - 1, 2 * high + (v >> np.maximum(high - 1, 0) & 1)), np.where(small, 0, v & ((1 << np.maximum(bits, 0)) - 1)), bits


def _write_matches(bits: BitWriter, pixels: np.ndarray, w: int, found: list[tuple[int, int, int]]) -> bytes:
    """The main image with these back-references, where only green varies."""
    g = (pixels >> np.uint32(8) & np.uint32(255)).astype(np.int64)
    near = {x + y * w: k + 1 for k, (x, y) in reversed(list(enumerate(NEAR))) if x + y * w > 0}
    start, length, distance = (np.array(x, np.int64) for x in zip(*((a, m, near.get(d, d + len(NEAR))) for a, m, d in found), strict=True))
    literal, head = np.ones(len(g), bool), np.zeros(len(g), bool)
    covered = np.zeros(len(g) + 1, np.int64)
    covered[start] += 1  # starts differ from each other, as do ends
    covered[start + length] -= 1
    literal[np.cumsum(covered[:-1]) > 0] = False
    head[start] = True
    place = np.flatnonzero(literal | head)
    is_ref = head[place]
    lc, lx, ln = _prefixes(length)
    dc, dx, dn = _prefixes(distance)
    symbol = g[place]
    symbol[is_ref] = 256 + lc
    one = int(pixels[0])
    counts = [np.bincount(symbol, minlength=256 + _LENGTHS), *(np.bincount([one >> k & 255], minlength=256) for k in (16, 0, 24)), np.bincount(dc, minlength=_DISTANCES)]
    lengths = [_code_lengths(c, 15) for c in counts]
    taken = [_write_code(bits, x) for x in lengths]
    green, far = _bit_patterns(lengths[0]), _bit_patterns(lengths[4])
    at = np.arange(len(place)) + np.cumsum(is_ref) - is_ref
    values, sizes = np.zeros(len(place) + len(start), np.uint64), np.zeros(len(place) + len(start), np.int64)
    values[at], sizes[at] = green[symbol], taken[0][symbol]
    values[at[is_ref]] |= lx.astype(np.uint64) << sizes[at[is_ref]].astype(np.uint64)
    sizes[at[is_ref]] += ln
    values[at[is_ref] + 1] = far[dc].astype(np.uint64) | dx.astype(np.uint64) << taken[4][dc].astype(np.uint64)
    sizes[at[is_ref] + 1] = taken[4][dc] + dn
    return bits.add_all(values, sizes)


def _tokens(pixels: list[int], w: int, cache_bits: int, match: bool) -> list[tuple]:
    """Literals, cache hits and back-references: ('lit', argb), ('hit', index), ('ref', length, distance code)."""
    near = {x + y * w: k + 1 for k, (x, y) in reversed(list(enumerate(NEAR))) if x + y * w > 0}
    seen: dict[tuple, int] = {}
    cache: list[int | None] = [None] * (1 << cache_bits)
    out, at = [], 0

    def passed(k: int) -> None:
        if k >= 2:
            seen[tuple(pixels[k - 2 : k + 1])] = k - 2
        if cache_bits:
            cache[(_HASH * pixels[k] & 0xFFFFFFFF) >> (32 - cache_bits)] = pixels[k]

    while at < len(pixels):
        start = seen.get(tuple(pixels[at : at + 3])) if match else None
        if start is not None and at + 3 <= len(pixels):
            n = 3
            while n < 4096 and at + n < len(pixels) and pixels[start + n] == pixels[at + n]:
                n += 1
            out.append(("ref", n, near.get(at - start, at - start + len(NEAR))))
        else:
            n, slot = 1, (_HASH * pixels[at] & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else 0
            out.append(("hit", slot) if cache_bits and cache[slot] == pixels[at] else ("lit", pixels[at]))
        for k in range(at, at + n):
            passed(k)
        at += n
    return out


def _write_image(bits: BitWriter, pixels: np.ndarray, w: int, main: bool, cache_bits: int = 0, match: bool = False) -> bytes | None:
    """An entropy-coded image of one code group. The main one ends the stream and comes back as bytes."""
    bits.add(1 if cache_bits else 0, 1)
    if cache_bits:
        bits.add(cache_bits, 4)
    if main:
        bits.add(0, 1)
    sizes = (256 + _LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, _DISTANCES)
    varied = int(np.bitwise_or.reduce(pixels ^ pixels[0])) if len(pixels) else 0
    if match and main and not cache_bits and not varied & 0xFFFF00FF:
        found = _matches((pixels >> np.uint32(8)).astype(np.uint8))
        if sum(m for _, m, _ in found) >= LEAST_COVERED:
            return _write_matches(bits, pixels, w, found)
        match = False
    if not cache_bits and not match:
        # A channel of one value is counted as that value once: its code takes no bits.
        symbols = [((pixels if varied >> s & 255 else pixels[:1]) >> np.uint32(s) & np.uint32(255)).astype(np.int64) for s in (8, 16, 0, 24)]
        counts = [np.bincount(x, minlength=n) for x, n in zip(symbols, sizes, strict=False)] + [np.zeros(_DISTANCES, np.int64)]
        lengths = [_code_lengths(c, 15) for c in counts]
        taken = [_write_code(bits, x) for x in lengths]
        live = [k for k in range(4) if taken[k].any()]
        values, widths = np.zeros((len(pixels), len(live)), np.int64), np.zeros((len(pixels), len(live)), np.int64)
        for j, k in enumerate(live):
            values[:, j], widths[:, j] = _bit_patterns(lengths[k])[symbols[k]], taken[k][symbols[k]]
        if main:
            return bits.add_all(values.ravel(), widths.ravel())
        for v, n in zip(values.ravel().tolist(), widths.ravel().tolist(), strict=True):
            bits.add(v, n)
        return None
    steps: list[list[tuple[int, int, int, int]]] = []  # (code, symbol, extra bits, their number)
    for t in _tokens(pixels.tolist(), w, cache_bits, match):
        if t[0] == "lit":
            steps.append([(0, t[1] >> 8 & 255, 0, 0), (1, t[1] >> 16 & 255, 0, 0), (2, t[1] & 255, 0, 0), (3, t[1] >> 24, 0, 0)])
        elif t[0] == "hit":
            steps.append([(0, 256 + _LENGTHS + t[1], 0, 0)])
        else:
            (a, x, m), (b, y, n) = _prefix(t[1]), _prefix(t[2])
            steps.append([(0, 256 + a, x, m), (4, b, y, n)])
    counts = [np.zeros(n, np.int64) for n in sizes]
    for code, s, _, _ in (x for step in steps for x in step):
        counts[code][s] += 1
    lengths = [_code_lengths(c, 15) for c in counts]
    taken = [_write_code(bits, x) for x in lengths]
    patterns = [_bit_patterns(x) for x in lengths]
    for code, s, extra, m in (x for step in steps for x in step):
        bits.add(int(patterns[code][s]), int(taken[code][s]))
        bits.add(extra, m)
    return bits.add_all(np.zeros(0), np.zeros(0, np.int64)) if main else None


def encode(pixels: np.ndarray, subtract_green: bool = False, modes: np.ndarray | None = None, cross: np.ndarray | None = None, block: int = 4, palette: bool = False, cache_bits: int = 0, match: bool = False) -> bytes:
    """A lossless WebP file of (height, width) ARGB pixels.

    ``modes`` (a predictor mode for each block of 2**block pixels a side) and ``cross`` (cross-colour multipliers as pixels) switch these transforms
    on, ``palette`` the colour table (at most 256 colours), ``cache_bits`` the colour cache, ``match`` back-references.
    """
    h, w = pixels.shape
    p = pixels.ravel().astype(np.uint32)
    bits = BitWriter()
    bits.add(w - 1, 14)
    bits.add(h - 1, 14)
    bits.add(int((p >> np.uint32(24) != 255).any()), 1)
    bits.add(0, 3)
    if palette:
        table, index = np.unique(p, return_inverse=True)
        bits.add(1 | _PALETTE << 1, 3)
        bits.add(len(table) - 1, 8)
        _write_image(bits, _joined(*(np.diff(c, prepend=0) for c in _channels(table))), len(table), False)
        pack = _pack_bits(len(table))
        wide = -(-w // (1 << pack))
        grid = np.zeros((h, wide << pack), np.uint32)
        grid[:, :w] = index.reshape(h, w)
        shifts = np.arange(1 << pack, dtype=np.uint32) * np.uint32(8 >> pack)
        p = (np.bitwise_or.reduce(grid.reshape(h, wide, -1) << shifts, axis=2) << np.uint32(8) | np.uint32(0xFF000000)).ravel()
        w = wide
    if modes is not None:
        bits.add(1 | _PREDICTOR << 1, 3)
        bits.add(block - 2, 3)
        _write_image(bits, modes.astype(np.uint32) << np.uint32(8) | np.uint32(0xFF000000), -(-w // (1 << block)), False)
        p = _predicted(p, w, h, modes, block, True)
    if cross is not None:
        bits.add(1 | _CROSS << 1, 3)
        bits.add(block - 2, 3)
        _write_image(bits, cross.astype(np.uint32), -(-w // (1 << block)), False)
        p = _crossed(p, w, h, cross, block, True)
    if subtract_green:
        bits.add(1 | _GREEN << 1, 3)
        g = p >> np.uint32(8) & np.uint32(255)
        p = (p & np.uint32(0xFF00FF00)) | ((p & np.uint32(0x00FF00FF)) + np.uint32(0x01000100) - (g << np.uint32(16) | g)) & np.uint32(0x00FF00FF)
    bits.add(0, 1)
    body = b"\x2f" + _write_image(bits, p, w, True, cache_bits, match)
    padded = body + bytes(len(body) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(padded)) + b"WEBPVP8L" + struct.pack("<I", len(body)) + padded


# The media column -----------------------------------------------------------------------------------------------------


def _bits_of(values: np.ndarray) -> float:
    """Bits that a prefix code takes for these bytes, nearly."""
    counts = np.bincount(values.ravel(), minlength=256).astype(float)
    counts = counts[counts > 0]
    return float((counts * np.log2(counts.sum() / counts)).sum())


#: Values up to which grey pixels are packed by a palette; part of its bits that a predictor must save.
FEW_VALUES, SAVING = 16, 0.1


def _chosen(grey: np.ndarray) -> dict:
    """How to encode a grey image: depends on its values alone."""
    if np.count_nonzero(np.bincount(grey.ravel(), minlength=256)) <= FEW_VALUES:
        return {"palette": True, "match": True}
    plain = _bits_of(grey)
    best, mode = (1 - SAVING) * plain - 64, 0
    for k, step in ((1, grey[:, 1:] - grey[:, :-1]), (2, grey[1:] - grey[:-1])):
        if step.size and (cost := _bits_of(step) * grey.size / step.size) < best:
            best, mode = cost, k
    out: dict = {"subtract_green": True, "match": True}
    if mode:
        block = 9
        out |= {"modes": np.full(-(-grey.shape[0] // (1 << block)) * -(-grey.shape[1] // (1 << block)), mode), "block": block}
    return out


def to_media(raw: bytes) -> bytes:
    """Bytes as grey images of ``TILE`` columns, one file after the other; padded to whole rows, one at least."""
    padded = raw + bytes([PAD]) * (-len(raw) % TILE if raw else TILE)
    grey = np.frombuffer(padded, np.uint8).reshape(-1, TILE)
    parts = [grey[k : k + ROWS] for k in range(0, len(grey), ROWS)]
    return b"".join(encode(g.astype(np.uint32) * np.uint32(0x010101) | np.uint32(0xFF000000), **_chosen(g)) for g in parts)


def from_media(media: bytes) -> list[np.ndarray]:
    """The images of a media value, each (rows, columns, 4) with channels R, G, B, A."""
    out, at = [], 0
    while at < len(media):
        size = 8 + struct.unpack_from("<I", media, at + 4)[0]
        pixels = decode(media[at : at + size])
        out.append(np.ascontiguousarray(pixels).view(np.uint8).reshape(*pixels.shape, 4)[:, :, [2, 1, 0, 3]])
        at += size
    return out


def describe(samples: np.ndarray) -> str:
    """Features of grey samples (rows, columns): shape, mean, mean step between columns, and a hash of which of 8 x 8 parts are lighter than all are on the whole. Whole numbers only."""
    rows, cols = samples.shape
    total = int(samples.sum(dtype=np.int64))
    step = int(np.abs(np.diff(samples.astype(np.int16), axis=1)).sum(dtype=np.int64))
    down = np.linspace(0, rows, 9).astype(int)[:-1] if rows >= 8 else np.arange(rows)
    sums = np.add.reduceat(np.add.reduceat(samples.astype(np.int64), np.linspace(0, cols, 9).astype(int)[:-1], axis=1), down, axis=0)
    area = np.diff(np.append(down, rows))[:, None] * (cols // 8)
    light = (sums * samples.size > total * area).ravel()
    return f"{cols}x{rows} mean={total * 100 // samples.size} step={step * 100 // samples.size} hash={int(''.join('1' if x else '0' for x in light), 2):016x}"


def media_column(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each whole text's UTF-8 bytes as lossless WebP, read back again: sizes, digests and features of what was read.

    A null or empty text is one row of pad bytes. A value depends on the text alone, so equal texts and repeated rows have equal
    values. An empty table gives no rows.
    """
    ship(docs.sparkSession)
    types = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = x.as_py() or b""
                media = to_media(raw)
                samples = np.concatenate([i[:, :, 1] for i in from_media(media)])
                back = samples.tobytes()
                rows.append((k, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), describe(samples)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types.values(), strict=True)], names=list(types))

    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("t"))
    return source.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
