"""Token ids in files of independent zstandard frames with a seek table at the end.

A file is, in this order: data frames (each about ``FRAME_IDS`` ids as little-endian unsigned 32-bit integers, with a
content checksum), one skippable frame with the documents' keys and lengths, and the seek table of the public
zstd seekable format (a skippable frame: compressed size, decompressed size and 32-bit XXH64 of each frame; number
of frames, a flag byte and a magic number close the file). A reader finds a document's frames from the two tables
and decompresses only these.
"""

from __future__ import annotations

import itertools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from tessera.llm.files import new_folder, opened, task_number, written
from tessera.llm.tokenize import WIDE_MEMO, library_encoder
from tessera.session import settle, ship

FRAME_IDS = 1 << 18

#: Ids and documents after which a task closes its file and begins another.
FILE_IDS, FILE_DOCS = 1 << 28, 1 << 21
LEVEL = 1

# Fixed values of the zstd frame and seekable formats.
_SKIPPABLE_TABLE = 0x184D2A5E
_SKIPPABLE_INDEX = 0x184D2A50
_FOOTER_MAGIC = 0x8F92EAB1
_CHECKSUMS = 0x80

_MANIFEST = "file_no long, path string, n_docs long, n_ids long"

#: Files of one task are numbered from its own number times this.
_PARTS = 1 << 20


class FrameWriter:
    """Appends documents' ids to an open file; ``close`` adds the two tables."""

    def __init__(self, out, frame_ids: int = FRAME_IDS):
        self.out, self.most = out, 4 * frame_ids
        self.pack = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True)
        self.waiting: list[bytes] = []
        self.size = self.ids = 0
        self.entries: list[tuple[int, int, int]] = []
        self.keys: list[int | None] = []
        self.lengths: list[int] = []

    def add(self, key: int | None, ids: bytes) -> None:
        self.keys.append(key)
        self.lengths.append(len(ids) // 4)
        self.ids += len(ids) // 4
        for k in range(0, len(ids), self.most):
            part = ids[k : k + self.most]
            if self.size and self.size + len(part) > self.most:
                self.flush()
            self.waiting.append(part)
            self.size += len(part)

    def flush(self) -> None:
        if self.size:
            raw = b"".join(self.waiting)
            done = self.pack.compress(raw)
            self.out.write(done)
            self.entries.append((len(done), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self.waiting, self.size = [], 0

    def close(self) -> None:
        self.flush()
        known = np.array([k is not None for k in self.keys], np.uint8)
        keys = np.array([k or 0 for k in self.keys], "<i8")
        body = self.pack.compress(struct.pack("<Q", len(keys)) + known.tobytes() + keys.tobytes() + np.array(self.lengths, "<i8").tobytes())
        self.out.write(struct.pack("<II", _SKIPPABLE_INDEX, len(body)) + body)
        self.entries.append((len(body) + 8, 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF))
        table = b"".join(struct.pack("<III", *e) for e in self.entries) + struct.pack("<IBI", len(self.entries), _CHECKSUMS, _FOOTER_MAGIC)
        self.out.write(struct.pack("<II", _SKIPPABLE_TABLE, len(table)) + table)


class FrameReader:
    """Reads the tables of one file, then only the frames that are asked for."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        n, flags, magic = struct.unpack("<IBI", source.read_at(9, size - 9))
        if magic != _FOOTER_MAGIC:
            raise ValueError("no seek table at the end of the file")
        width = 12 if flags & _CHECKSUMS else 8
        table = np.frombuffer(source.read_at(n * width, size - 9 - n * width), "<u4").reshape(n, width // 4).astype(np.int64)
        self.sums = table[:, 2] if width == 12 else None
        self.where = np.concatenate([[0], np.cumsum(table[:, 0])])
        self.first = np.concatenate([[0], np.cumsum(table[:, 1])])
        at = int(self.where[n - 1])
        body = zstandard.ZstdDecompressor().decompress(source.read_at(int(table[n - 1, 0]) - 8, at + 8))
        (m,) = struct.unpack("<Q", body[:8])
        known = np.frombuffer(body, np.uint8, m, 8)
        keys = np.frombuffer(body, "<i8", m, 8 + m)
        self.keys = [int(k) if ok else None for k, ok in zip(keys, known, strict=True)]
        self.lengths = np.frombuffer(body, "<i8", m, 8 + 9 * m)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.frames = n - 1
        self.held: tuple[int, bytes] = (-1, b"")

    def frame(self, k: int) -> bytes:
        if self.held[0] != k:
            raw = zstandard.ZstdDecompressor().decompress(self.source.read_at(int(self.where[k + 1] - self.where[k]), int(self.where[k])))
            if self.sums is not None and xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.sums[k]:
                raise ValueError(f"frame {k} does not match its checksum")
            self.held = (k, raw)
        return self.held[1]

    def parts(self, doc: int) -> Iterator[bytes]:
        """A document's ids, frame by frame."""
        at, end = 4 * int(self.starts[doc]), 4 * int(self.starts[doc + 1])
        k = int(np.searchsorted(self.first, at, side="right")) - 1
        while at < end:
            stop = min(end, int(self.first[k + 1]))
            yield self.frame(k)[at - int(self.first[k]) : stop - int(self.first[k])]
            at, k = stop, k + 1


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, key: str = "doc_id", text: str = "text", end_id: int = 2, files: int | None = None) -> DataFrame:
    """Write every row's ids plus ``end_id`` in ascending key order; returns the settled list of files.

    Rows are dealt to tasks by ranges of (key, hash of the text, a number of its own), so that even one row that is repeated very often is spread; a task begins another
    file after ``FILE_IDS`` ids or ``FILE_DOCS`` documents. A null key comes first, a null text is empty, repeated rows are all written, rows of one key
    stand in the order of their texts' hashes.
    """
    spark = docs.sparkSession
    ship(spark)
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, number = library_encoder(tokenizer, WIDE_MEMO), task_number()
        end = struct.pack("<I", end_id)
        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return
        rows = (r for b in itertools.chain([first], batches) for r in zip(b.column(0), b.column(1), strict=True))
        row, part = next(rows, None), 0
        while row is not None:
            path = f"{folder}/ids-{number:06d}-{part:06d}.zst"
            with written(path) as out:
                writer = FrameWriter(out)
                while row is not None and writer.ids < FILE_IDS and len(writer.keys) < FILE_DOCS:
                    writer.add(row[0].as_py(), encode(row[1].as_py()) + end)
                    row = next(rows, None)
                writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([number * _PARTS + part]), pa.array([path]), pa.array([len(writer.keys)], pa.int64()), pa.array([writer.ids], pa.int64())], names=["file_no", "path", "n_docs", "n_ids"])
            part += 1

    rows = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"), F.monotonically_increasing_id().alias("own")).withColumn("h", F.xxhash64("t"))
    dealt = rows.repartitionByRange(files, "k", "h", "own").sortWithinPartitions("k", "h", "t").select("k", "t")
    return settle(dealt.mapInArrow(run, _MANIFEST))


def read_token_files(manifest: DataFrame, ids: bool = False) -> DataFrame:
    """One row per document, from the files: doc_id, start (ids before it in all files), n_tokens, CRC-32 of its ids; with ``ids`` the ids too.

    One task per file; a frame is decompressed once and checked.
    """
    spark = manifest.sparkSession
    ship(spark)
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    listed = manifest.select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with opened(path) as source:
                    reader = FrameReader(source)
                    n = len(reader.keys)
                    for lo in range(0, n, 4096):
                        docs = range(lo, min(n, lo + 4096))
                        sums, lists = [], []
                        for d in docs:
                            crc, whole = 0, []
                            for part in reader.parts(d):
                                crc = zlib.crc32(part, crc)
                                if ids:
                                    whole.append(part)
                            sums.append(crc)
                            lists.append(b"".join(whole))
                        columns = [pa.array(reader.keys[lo : docs.stop], pa.int64()), pa.array(start + reader.starts[lo : docs.stop]), pa.array(reader.lengths[lo : docs.stop].copy()), pa.array(sums, pa.int64())]
                        if ids:
                            at = np.concatenate([[0], np.cumsum([len(x) // 4 for x in lists])]).astype(np.int32)
                            columns.append(pa.ListArray.from_arrays(pa.array(at), pa.array(np.frombuffer(b"".join(lists), "<i4"))))
                        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * ids])

    many = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return listed.repartition(many).mapInArrow(run, schema)


def read_documents(path: str, wanted: set[int]) -> dict[int, np.ndarray]:
    """Random access to one file: only frames that hold a wanted document are decompressed."""
    with opened(path) as source:
        reader = FrameReader(source)
        return {k: np.frombuffer(b"".join(reader.parts(d)), "<u4") for d, k in enumerate(reader.keys) if k in wanted}


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write the files in a new shared folder and read them back.

    A null key comes first, a null or empty text has the end id alone, repeated rows and very long texts are all written whole; an empty table writes no file and
    gives no rows. Other columns are not looked at.
    """
    return read_token_files(write_token_files(docs, tokenizer, new_folder(docs.sparkSession, "token-files"), end_id=end_id))
