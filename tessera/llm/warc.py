"""WARC archives as chunked record tables.

A payload travels as rows of (record, chunk number, bytes); writer and reader hold one chunk at a time. The reader's rows
carry the payload's digest so far, so the last chunk of a record has the whole payload's.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm.files import new_folder, streamed, task_number, written
from tessera.session import settle, ship, sized

CHUNK = 1 << 16

#: Payloads of fewer bytes are always stored.
LEAST_SHARED = 1000

#: Records after which a task begins another archive.
RECORDS_PER_FILE = 50_000

# Fixed values of the WARC format.
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2000-01-01T00:00:00Z"

_CHUNKS = "record_id string, target_uri string, record_type string, refers_to string, content_type string, chunk_no long, chunk_offset long, chunk_bytes long, data binary, payload_bytes long, payload_digest string, last boolean, path string"


def page_records(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Each page's record: key, url, payload, its size and SHA-1, and whether it is stored or revisits another page.

    Of equal payloads of at least ``LEAST_SHARED`` bytes the one with the largest key is stored. A null page is an empty payload. A null key
    is never the largest, and where all keys are null each row is stored; rows that share the largest key are all stored.

    Who is stored is settled on digests alone. Payloads are moved only where so many differ that occur twice or more that their digests can't be sent to all tasks.
    """
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.length("payload").cast("long"), "payload_digest": F.sha1("payload"), "same": F.unhex(F.sha2("payload", 256))})
    winner = rows.filter(F.col("payload_bytes") >= LEAST_SHARED).groupBy("same").agg(F.max("page_id").alias("winner"), F.count("*").alias("n")).filter("n > 1").drop("n")
    other = F.col("winner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("winner"))
    return rows.join(sized(winner), "same", "left").select("page_id", "url", "payload", "payload_bytes", "payload_digest", F.when(other, F.col("winner")).alias("refers_to"))


def to_chunks(records: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row per chunk of a stored payload; a revisit and an empty payload are one chunk without bytes. A record's chunks are neighbours, in order."""
    n = F.when(F.col("refers_to").isNull(), F.greatest(F.ceil(F.col("payload_bytes") / chunk), F.lit(1))).otherwise(1)
    cut = F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), lambda i: F.when(F.col("refers_to").isNull(), F.substring(F.col("payload"), i * chunk + 1, F.lit(chunk))))
    return records.select("page_id", "url", "payload_bytes", "payload_digest", "refers_to", n.alias("n_chunks"), F.posexplode(cut).alias("chunk_no", "data"))


def _record_id(key: int | None, digest: str) -> str:
    return f"<urn:x-page:{key if key is not None else 'none-' + digest}>"


def _heads(key: int | None, url: str | None, size: int, digest: str, refers_to: int | None) -> bytes:
    stored = refers_to is None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if stored else 'revisit'}",
        f"WARC-Record-ID: {_record_id(key, digest)}",
        f"WARC-Date: {_DATE}",
        *([f"WARC-Target-URI: {re.sub(r'\s', lambda m: f'%{ord(m[0]):02X}', url)}"] if url else []),
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        *([] if stored else [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, digest)}"]),
        f"X-Payload-Length: {size}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(http) + (size if stored else 0)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def write_archives(chunks: DataFrame, folder: str, records_per_file: int = RECORDS_PER_FILE) -> DataFrame:
    """Stream chunk rows into gzip-by-record archives, a few per task; returns the settled list (path, records)."""
    ship(chunks.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (dict(zip(b.schema.names, r, strict=True)) for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        row, part = next(rows, None), 0
        while row is not None:
            path, n = f"{folder}/records-{task_number():06d}-{part:04d}.warc.gz", 0
            with written(path) as out:
                while row is not None and n < records_per_file:
                    member = zlib.compressobj(1, zlib.DEFLATED, 31)
                    out.write(member.compress(_heads(row["page_id"], row["url"], row["payload_bytes"], row["payload_digest"], row["refers_to"])))
                    for k in range(row["n_chunks"]):
                        if row is None or row["chunk_no"] != k:
                            raise ValueError("a record's chunks must be neighbours, in order")
                        if row["data"]:
                            out.write(member.compress(row["data"]))
                        row = next(rows, None)
                    out.write(member.compress(b"\r\n\r\n") + member.flush())
                    n += 1
            part += 1
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], names=["path", "records"])

    return settle(chunks.mapInArrow(run, "path string, records long"))


def records_of(source, path: str, chunk: int = CHUNK, data: bool = True) -> Iterator[tuple]:
    """The chunk rows of an open archive (a file object of decompressed bytes); a record's declared digest must match."""
    while line := source.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"{path}: no record where one should begin")
        head: dict[str, str] = {}
        while line := source.readline().rstrip(b"\r\n"):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head[name.strip().lower()] = value.strip()
        left = int(head["content-length"])
        kind = head.get("content-type", "")
        if kind.startswith("application/http"):
            while left > 0:
                line = source.readline()
                left -= len(line)
                if not line.strip():
                    break
        sha, at, number = hashlib.sha1(), 0, 0
        said = head.get("warc-payload-digest", "")
        declared = base64.b32decode(said[5:]).hex() if said.startswith("sha1:") else None
        common = (head.get("warc-record-id"), head.get("warc-target-uri"), head.get("warc-type"), head.get("warc-refers-to"), kind)
        if head.get("warc-type") == "revisit":
            _skip(source, left)
            yield (*common, 0, 0, 0, b"" if data else None, int(head.get("x-payload-length", -1)), declared, True, path)
            continue
        while True:
            part = source.read(min(chunk, left))
            if left and not part:
                raise ValueError(f"{path}: the archive ends inside a record")
            left -= len(part)
            sha.update(part)
            if not left and declared not in (None, sha.hexdigest()):
                raise ValueError(f"{path}: {common[0]} does not match its digest")
            yield (*common, number, at, len(part), part if data else None, at + len(part), sha.hexdigest(), not left, path)
            at, number = at + len(part), number + 1
            if not left:
                break


def _skip(source, n: int) -> None:
    while n > 0 and (part := source.read(min(CHUNK, n))):
        n -= len(part)


def read_archives(listed: DataFrame, chunk: int = CHUNK, data: bool = True, batch_bytes: int = 4 << 20) -> DataFrame:
    """The chunked record table of the archives in ``listed.path``, one task per few archives.

    ``payload_bytes`` and ``payload_digest`` hold for the payload up to and with the row's chunk; a revisit's are those its record declares.
    ``data=False`` leaves the bytes out.
    """
    ship(listed.sparkSession)
    types = [pa.string()] * 5 + [pa.int64()] * 3 + [pa.binary(), pa.int64(), pa.string(), pa.bool_(), pa.string()]
    names = [x.split()[0] for x in _CHUNKS.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path in (p for b in batches for p in b.column(0).to_pylist()):
            rows, held = [], 0
            with streamed(path) as raw, gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else raw as source:
                for row in records_of(source, path, chunk, data):
                    rows.append(row)
                    held += 500 + (row[7] if data else 0)
                    if held >= batch_bytes:
                        yield batch(rows)
                        rows, held = [], 0
            if rows:
                yield batch(rows)

    many = int(listed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return listed.select("path").repartition(many).mapInArrow(run, _CHUNKS)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages as WARC records, read the archives back, and return what the records say of each page.

    A null key comes back as null; see ``page_records`` for ties and nulls. An empty table writes nothing and gives no rows.
    """
    spark: SparkSession = pages.sparkSession
    listed = write_archives(to_chunks(page_records(pages)), new_folder(spark, "warc"))
    last = read_archives(listed, data=False).filter("last")
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^<urn:x-page:(-?[0-9]+)>$', 1) AS BIGINT)")
    return last.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))
