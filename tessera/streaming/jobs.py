"""Structured Streaming jobs: stages, audit log, duplicate gate, index refresh and a guard over text deltas."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tessera.functions.text import CJK
from tessera.operators.kept import Kept
from tessera.session import shared_dir, ship


def stream_of(spark: SparkSession, path: str) -> DataFrame:
    """A table's files as a stream, with the table's own schema. A stream's path must be a folder or a pattern; as a pattern, a table of one file will do too."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def run_to_end(stream: DataFrame, mode: str, each: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Run a stream over all that is there now; returns what it wrote, with the batch's number in ``batch_no``.

    Progress and output are kept in the shared folder; a batch that is repeated after a failure overwrites its own output.
    """
    spark = stream.sparkSession
    home = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        (each(batch, number) if each else batch).write.mode("overwrite").parquet(f"{home}/out/batch_no={number}")

    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{home}/progress").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch_no", T.IntegerType())])).parquet(f"{home}/out")


def newest(written: DataFrame, key: str) -> DataFrame:
    """The last update of each key."""
    values = [c for c in written.columns if c not in (key, "batch_no")]
    return written.groupBy(key).agg(F.max_by(F.struct(*values), "batch_no").alias("x")).select(key, "x.*")


def latest_stage(events: DataFrame) -> DataFrame:
    """Stage and progress of each document: the newest event's stage; an error keeps the progress that was reached. Rows: doc, stage, progress, ts, event_id.

    State is a row for each document for ever, since an event may come at any time: it grows with the documents, as the ledger does, not with the events.
    """
    at = F.struct("ts", "event_id")
    return events.groupBy("doc").agg(F.max_by("stage", at).alias("stage"), F.max_by("progress", F.when(F.col("stage") != "error", at)).alias("progress"))


def audit_state(log: DataFrame, delay: str = "1 day") -> DataFrame:
    """Latest snapshot of each entity from an append-only log; a repeated entry within ``delay`` counts once. Rows: entity, entry_id, at, after."""
    once = log.withWatermark("at", delay).dropDuplicatesWithinWatermark(["entry_id"])
    return once.groupBy("entity").agg(F.max_by("after", F.struct("at", "entry_id")).alias("state"), F.count("*").alias("entries"))


def derived_status(jobs: DataFrame, ledger: DataFrame) -> DataFrame:
    """Status of a document from its job (a stream) and the ledger (a table): a running job goes first, then an error, then whether it is published."""
    status = F.when(~F.col("stage").isin("done", "error"), F.col("stage")).when((F.col("stage") == "error") | (F.col("ingest_status") == "error"), "error").when(F.col("published"), "ready").otherwise("waiting")
    return jobs.join(ledger, "doc", "left").select("doc", "event_id", status.alias("status"))


def new_documents(arriving: DataFrame, ledger: DataFrame, at: str | None = None, delay: str = "1 day") -> DataFrame:
    """Arriving documents whose bytes neither the stream nor the ledger had: (sha256).

    A digest that comes again must not pass however late, so without ``at`` the state keeps every digest seen since the query's first start. With a time column ``at`` only those of
    the last ``delay`` are kept; what came before must by then be in the ledger.
    """
    once = arriving.withWatermark(at, delay).dropDuplicatesWithinWatermark(["sha256"]) if at else arriving.dropDuplicates(["sha256"])
    return once.join(ledger.select("sha256"), "sha256", "left_anti")


def keep_index(files: DataFrame, index: Kept, cut: Callable[[DataFrame], DataFrame], progress: str) -> None:
    """Bring a kept index up to date with all files that a stream has now, a version for each micro-batch; ``cut`` makes chunks (file_stem, chunk_id, indexed) of files.

    A file that comes again replaces what it was. Only its bucket is rewritten, weights move by the difference, and a micro-batch that is repeated after a failure changes nothing twice. ``progress`` is
    the stream's own folder; with it the stream goes on where it stopped. Of a file that comes twice in one micro-batch the rows are taken together, so writers keep
    versions of a file apart.
    """

    def apply(batch: DataFrame, number: int) -> None:
        index.replace(cut(batch), number)

    files.writeStream.foreachBatch(apply).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()


_FOREIGN = re.compile(CJK)
_ACCENT = re.compile("[À-ɏẠ-ỿ]")


def guard_text(held: str, delta: str, least: int = 6, share: float = 0.4) -> tuple[str, str, bool]:
    """One step of the guard: (text to pass on, text still held back, whether to stop). Output is held from the first foreign character on; it stops when that tail is plainly a translation."""
    text = held + delta
    m = _FOREIGN.search(text)
    if not m:
        return text, "", False
    tail = text[m.start() :]
    n = len(_FOREIGN.findall(tail))
    stop = n >= least and n >= share * len("".join(tail.split())) and not _ACCENT.search(tail)
    return text[: m.start()], tail, stop


def guard(deltas: DataFrame) -> DataFrame:
    """(conv_id, passed, stopped) after all deltas (conv_id, turn, text) so far; the state of a conversation is the text held back."""
    ship(deltas.sparkSession)

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held, passed, stopped = state.get if state.exists else ("", 0, False)
        rows = pd.concat(list(frames)).sort_values("turn", kind="stable")
        for text in rows["text"].fillna(""):
            if stopped:
                break
            out, held, stopped = guard_text(held, text)
            passed += len(out)
        state.update((held, passed, stopped))
        yield pd.DataFrame({"conv_id": [key[0]], "passed": [passed], "stopped": [stopped]})

    return deltas.groupBy("conv_id").applyInPandasWithState(step, "conv_id long, passed long, stopped boolean", "held string, passed long, stopped boolean", "update", "NoTimeout")
