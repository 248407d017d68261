"""BPE by dynamic programming over prefixes.

For every prefix of a word there is exactly one token that can come last. An automaton over the vocabulary finds the
tokens that end at each position; a token is the last one of the prefix if it may follow the last token of what lies
before it, that is if merging the two tokens' symbols by rank gives these two tokens again. Back-pointers from the
end then spell out the ids, which are those that merging by rank gives.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.llm.tokenize import TextEncoder, byte_letters, has_short_way
from tessera.session import ship

#: Pair tests that a worker remembers; at the limit it starts anew.
MEMO_PAIRS = 400_000

#: Offset of a word's last symbol, which carries the end-of-word mark.
_END = 0x4000


class PrefixBpe:
    """Encoder and decoder of a tokenizer file with a BPE model over byte-level letters, with or without a word-end suffix.

    Files whose model asks for more (unknown or fallback tokens, drop-out, word-inner prefixes, merges that are passed over), or whose special tokens
    do more than stand for themselves, are refused.
    """

    def __init__(self, path: str):
        import ahocorasick
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        asked = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
        asked += [x["content"] for x in spec["added_tokens"] if x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"]]
        if model["type"] != "BPE" or asked or spec["post_processor"]:
            raise ValueError(f"not a plain BPE tokenizer: {asked or model['type']}")
        suffix = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.names = {i: s for s, i in self.vocab.items()} | {x["id"]: x["content"] for x in spec["added_tokens"]}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.splits = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.rank = {(self.vocab[a], self.vocab[b]): (i, self.vocab[a + b]) for i, (a, b) in enumerate(merges)}
        self.symbols: dict[int, list[int]] = {}
        self.automaton = ahocorasick.Automaton()
        known = set(byte_letters())
        for s, i in self.vocab.items():
            plain = s.removesuffix(suffix) if suffix and s != suffix else s
            if not plain or not known.issuperset(plain) or s in self.special:
                continue
            ends = plain != s
            key = plain[:-1] + chr(ord(plain[-1]) + _END) if ends else plain
            units = [self.vocab.get(c) for c in plain[:-1]] + [self.vocab.get(plain[-1] + suffix if ends else plain[-1])]
            if None in units:
                continue
            self.symbols[i] = units
            self.automaton.add_word(key, (i, len(key)))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.alone: dict[int, bool] = {}
        self.end = _END if suffix else 0
        self.joined = spec["decoder"] is None
        self.library = Tokenizer.from_file(path)
        self.text_ids = TextEncoder(self.piece, self.slow, has_short_way(spec))

    def merged(self, ids: list[int]) -> list[int]:
        """Merging by rank, the lowest rank and then the leftmost pair first."""
        ids, rank = list(ids), self.rank
        while True:
            best, at = (len(rank), 0), -1
            for k in range(len(ids) - 1):
                if (found := rank.get((ids[k], ids[k + 1]))) and found[0] < best[0]:
                    best, at = found, k
            if at < 0:
                return ids
            ids[at : at + 2] = [best[1]]

    def follows(self, a: int, b: int) -> bool:
        if len(self.pairs) >= MEMO_PAIRS:
            self.pairs.clear()
        found = self.pairs[a << 32 | b] = self.merged(self.symbols[a] + self.symbols[b]) == [a, b]
        return found

    def begins(self, a: int) -> bool:
        found = self.alone.get(a)
        if found is None:
            found = self.alone[a] = self.merged(self.symbols[a]) == [a]
        return found

    def piece(self, s: str) -> list[int]:
        """ids of one piece, given in byte letters."""
        n = len(s)
        last, back = [-1] * n, [-1] * n
        pairs = self.pairs
        for end, (token, size) in self.automaton.iter(s[:-1] + chr(ord(s[-1]) + self.end)):
            if last[end] < 0:
                before = end - size
                if before < 0:
                    if self.begins(token):
                        last[end] = token
                elif (p := last[before]) >= 0:
                    ok = pairs.get(p << 32 | token)
                    if ok or ok is None and self.follows(p, token):
                        last[end], back[end] = token, before
        out, at = [], n - 1
        while at >= 0:
            if last[at] < 0:
                raise ValueError("the vocabulary does not cover this piece")
            out.append(last[at])
            at = back[at]
        return out[::-1]

    def slow(self, text: str) -> list[int]:
        """Any text: special tokens cut out first, then the file's own normaliser and split."""
        out: list[int] = []
        for part in self.splits.split(text) if self.splits else [text]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                plain = self.library.normalizer.normalize_str(part) if self.library.normalizer else part
                for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(plain):
                    out += self.piece(piece)
        return out

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.text_ids(text), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        """Where the file names no decoder, tokens are joined by one space, as the library joins them then; else by the file's own."""
        if self.joined:
            return " ".join(map(self.names.__getitem__, ids.tolist()))
        return self.library.decode(ids.tolist(), skip_special_tokens=False)


_known: dict[str, PrefixBpe] = {}


def tokenizer(path: str) -> PrefixBpe:
    """One per worker process."""
    if path not in _known:
        _known[path] = PrefixBpe(path)
    return _known[path]


def encode(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``ids array<int>`` of each row's whole text.

    A null or empty text has no ids. Rows are independent: repeated rows give repeated results, an empty table none.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for b in batches:
            raw = [bpe.text_ids(x) for x in b.column(len(keep)).to_pylist()]
            at = np.concatenate([[0], np.cumsum([len(x) // 4 for x in raw])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(at), pa.array(np.frombuffer(b"".join(raw), "<i4")))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], ids], names=[*keep, "ids"])

    source = docs.select(*keep, F.col(text).alias("text_to_encode"))
    types = dict(docs.dtypes)
    return source.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in keep) + ", ids array<int>")


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, number of ids, SHA-256 of the ids and of the text decoded from them, for each row; ids are made, digested and dropped batch by batch.

    A null or empty text has no ids and decodes to the empty text. Rows are independent: null keys, repeated rows and very long texts give a row each, an
    empty table none; other columns are not looked at.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for x in b.column(1):
                raw = bpe.text_ids(x.as_py())
                n.append(len(raw) // 4)
                ids_sha.append(sha(raw))
                text_sha.append(sha(bpe.decode(np.frombuffer(raw, "<u4")).encode()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
