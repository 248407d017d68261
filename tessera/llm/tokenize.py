"""Whole texts to token ids through a memo of their pieces.

A tokenizer file that normalises and splits as ``SHORT_WAY`` says never lets a token span two pieces of its split pattern, and its normaliser works
character by character on the letters that European texts use. So a text's ids are its pieces' ids in a row, and a
piece that was seen before costs one dictionary look-up. Texts with other characters, control characters or special tokens, and
all texts where the file says otherwise, take the long way through ``slow``.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from collections.abc import Callable

#: What the short way can't take: characters whose normal form, case or white-space class needs the library's own tables.
_UNUSUAL = re.compile("[^\t-\r -~\u0080-\u024f]|[\u0130\u023a\u023e]|<\\|")

#: Pieces in a generation of what a worker remembers, of two: some 100 bytes each.
MEMO_ENTRIES = 200_000

#: The same for jobs that do nothing but encode.
WIDE_MEMO = 400_000

# What a tokenizer file of the short way says of itself, and how its special tokens begin.
SHORT_WAY = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}
_SPECIAL = "<|"

#: The split pattern, spelled out for the characters of the short way.
_LETTER, _DIGIT, _SPACE = "a-zA-Z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be", "\t-\r \u0085\u00a0"
_pieces = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_DIGIT}]|[^{_SPACE}{_LETTER}{_DIGIT}]+").findall


def has_short_way(spec: dict) -> bool:
    """Whether a tokenizer file's own settings are those that the short way stands for."""
    same = all(spec.get(k) == v for k, v in SHORT_WAY.items()) and spec["model"]["type"] == "BPE" and not spec["model"].get("unk_token")
    return same and all(x["content"].startswith(_SPECIAL) and not (x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"]) for x in spec["added_tokens"])


def byte_letters() -> list[str]:
    """The printable character that stands for each byte (byte-level BPE's convention): printable Latin-1 stands for itself, the rest follows from U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


_LETTERS = str.maketrans({chr(b): x for b, x in enumerate(byte_letters())})


class Memo(dict):
    """Remembers what ``make`` gives, in two generations: at so many ``entries`` they become the old ones, and of these only what is asked for again is kept. Long keys pass by."""

    def __init__(self, make: Callable[[str], bytes], entries: int | None = None):
        super().__init__()
        self.make, self.entries = make, entries or MEMO_ENTRIES
        self.old: dict[str, bytes] = {}

    def __missing__(self, key: str) -> bytes:
        out = self.old.pop(key, None)
        if out is None:
            out = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.entries:
                self.old = dict(self)
                self.clear()
            self[key] = out
        return out


def packed(ids: list[int]) -> bytes:
    """ids as little-endian unsigned 32-bit integers."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class TextEncoder:
    """ids of whole texts as little-endian unsigned 32-bit integers.

    ``piece`` encodes one piece of the split in byte letters, ``slow`` any text. Without ``short`` all texts take the latter. ``entries`` are the memo's.
    """

    def __init__(self, piece: Callable[[str], list[int]], slow: Callable[[str], list[int]], short: bool = True, entries: int | None = None):
        self.slow, self.short = slow, short
        self.pieces = Memo(lambda p: packed(piece(p if p.isascii() else p.encode().decode("latin-1").translate(_LETTERS))), entries)

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.short or _UNUSUAL.search(text):
            return packed(self.slow(text))
        return b"".join(map(self.pieces.__getitem__, _pieces(text.lower())))


_library: dict[tuple[str, int | None], TextEncoder] = {}


def library_encoder(path: str, entries: int | None = None) -> TextEncoder:
    """The tokenizers library's ids for the tokenizer file at ``path``, with a memo of ``entries`` (``MEMO_ENTRIES``); one per worker process."""
    if (path, entries) not in _library:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            short = has_short_way(json.load(f))
        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        tokenize = t.model.tokenize
        _library[path, entries] = TextEncoder(lambda p: [x.id for x in tokenize(p)], lambda text: t.encode(text, add_special_tokens=False).ids, short, entries)
    return _library[path, entries]
