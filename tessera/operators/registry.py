"""The formula registry as a state machine: ordered events of a record folded with a state of a few fields, in batch and as a stream.

Events: (document, seq, action, source_hash, fids, fid, revision, proposal). ``seq`` orders the events of a document.

- ``add``: the document's file now has ``source_hash`` and holds the formulas ``fids``. Records of the document with other bytes become stale; one that has these bytes
  is made (pending, revision 1) or, if it was stale, is pending again: the same bytes never bring an approval back.
- ``update``: a new ``proposal`` for record (``source_hash``, ``fid``), pending again; its approval is gone.
- ``approve``, ``reject``: only of a pending record. ``update`` and these are refused (a conflict) unless ``revision`` is the record's and it is not stale.
- ``patch``: the stored proposal is changed without a review, as by a restored file; the digest of an approval then no longer fits.
- ``invalidate``: the document is gone; its records become stale.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.session import ship

RECORD = "id string, document string, source_hash string, fid string"
STATE = "status string, revision long, proposal string, approved string, conflicts long"

State = tuple[str, int, str | None, str | None, int]

#: Before a record's first event.
NONE: State = ("", 0, None, None, 0)


def step(state: State, action: str, same: bool, listed: bool, revision: int | None, proposal: str | None) -> State:
    """The state after an event. ``same``: the event's bytes are the record's; ``listed``: an ``add`` has the record's formula."""
    status, now, own, approved, conflicts = state
    if action == "add" and same:
        if not listed:
            return state
        if status == "":
            return ("pending", 1, own, None, conflicts)
        return ("pending", now + 1, own, None, conflicts) if status == "stale" else state
    if status == "":
        return (*state[:4], conflicts + 1) if action in ("update", "approve", "reject") and same else state
    if action in ("add", "invalidate"):
        return state if status == "stale" else ("stale", now + 1, own, approved, conflicts)
    if not same:
        return state
    if action == "patch":
        return (status, now, proposal, approved, conflicts)
    if status == "stale" or revision != now or (action != "update" and status != "pending"):
        return (status, now, own, approved, conflicts + 1)
    if action == "update":
        return ("pending", now + 1, proposal, None, conflicts)
    return ("approved", now + 1, own, hashlib.sha256((own or "").encode()).hexdigest(), conflicts) if action == "approve" else ("rejected", now + 1, own, None, conflicts)


def by_record(events: DataFrame) -> DataFrame:
    """(record, seq, action, same, listed, revision, proposal): the events that concern each record that the batch's ``add`` events or other events name.

    A document's ``add`` and ``invalidate`` concern all its records. Of these only the changes matter: an event that says of the document what the one before it
    said of other bytes leaves a stale record stale.
    """
    record = F.sha2(F.concat_ws("\0", "document", "source_hash", "fid"), 256)
    named = events.filter("action = 'add'").select("document", "source_hash", F.explode("fids").alias("fid")).unionAll(events.filter("fid IS NOT NULL").select("document", "source_hash", "fid"))
    records = named.distinct().withColumn("id", F.substring(record, 1, 32))
    whole = events.filter("action IN ('add', 'invalidate')").select("document", "seq", "action", F.col("source_hash").alias("h"), "fids")
    of_document = records.join(whole, "document").select(
        "id", "document", "source_hash", "fid", "seq", "action", F.coalesce(F.col("h") == F.col("source_hash"), F.lit(False)).alias("same"),
        F.coalesce(F.array_contains("fids", F.col("fid")), F.lit(False)).alias("listed"), F.lit(None).cast("long").alias("revision"), F.lit(None).cast("string").alias("proposal"),
    )
    single = events.filter("action NOT IN ('add', 'invalidate') AND fid IS NOT NULL").withColumn("id", F.substring(record, 1, 32))
    own = single.select("id", "document", "source_hash", "fid", "seq", "action", F.lit(True).alias("same"), F.lit(True).alias("listed"), "revision", "proposal")
    return of_document.unionByName(own)


_FIELDS = ["seq", "action", "same", "listed", "revision", "proposal"]


def states(events: DataFrame) -> DataFrame:
    """(id, document, source_hash, fid, status, revision, proposal, approved, conflicts) after all events; records that were named but never added have no row.

    Events of a record pass in order through one task, which keeps a state of five fields, whatever their number.
    """
    rows = by_record(events)
    ship(events.sparkSession)
    schema = f"{RECORD}, {STATE}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, out = None, NONE, []
        for b in batches:
            for id_, document, h, fid, _, *event in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if now is None or id_ != now[0]:
                    if now:
                        out.append((*now, *state))
                    now, state = (id_, document, h, fid), NONE
                state = step(state, *event)
            if len(out) > 10_000:
                yield _batch(out)
                out = []
        if now:
            out.append((*now, *state))
        if out:
            yield _batch(out)

    ordered = rows.repartition("id").sortWithinPartitions("id", "seq").select("id", "document", "source_hash", "fid", *_FIELDS)
    return ordered.mapInArrow(run, schema).filter("status <> ''")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64() if c.split()[1] == "long" else pa.string() for c in f"{RECORD}, {STATE}".split(", ")]
    names = [c.split()[0] for c in f"{RECORD}, {STATE}".split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def stream_states(rows: DataFrame) -> DataFrame:
    """``states`` of a stream of ``by_record``'s rows: an update of each record that a micro-batch touches. Events come in order of ``seq`` from batch to batch; inside one they are sorted. State is five fields a record, for ever, as the registry itself."""
    ship(rows.sparkSession)

    def fold(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = tuple(state.get) if state.exists else NONE
        events = pd.concat(list(frames)).sort_values("seq", kind="stable")
        for e in events[["action", "same", "listed", "revision", "proposal"]].astype(object).itertuples(index=False, name=None):
            now = step(now, *(None if x is None or x != x else x for x in e))
        state.update(now)
        yield pd.DataFrame([(*key, *now)], columns=[c.split()[0] for c in f"{RECORD}, {STATE}".split(", ")])

    return rows.groupBy("id", "document", "source_hash", "fid").applyInPandasWithState(fold, f"{RECORD}, {STATE}", STATE, "update", "NoTimeout")


def current(found: DataFrame, sources: DataFrame) -> DataFrame:
    """``found`` with ``shown`` (the status, ``stale`` where the document's file (document, source_hash) has other bytes or is gone) and ``usable``: approved, fresh, and with the proposal that was approved."""
    rows = found.join(sources.select("document", F.col("source_hash").alias("now_hash")), "document", "left")
    fresh = F.coalesce(F.col("source_hash") == F.col("now_hash"), F.lit(False))
    usable = fresh & (F.col("status") == "approved") & F.coalesce(F.col("approved") == F.sha2(F.coalesce("proposal", F.lit("")), 256), F.lit(False))
    return rows.select(*found.columns, F.when(fresh, F.col("status")).otherwise("stale").alias("shown"), usable.alias("usable"))
