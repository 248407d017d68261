"""Conversations brought back to the form (system? (user assistant)+)? by the cheapest edits, found by weighted interval parsing.

The role pattern's places are 0 (nothing yet), 1 (after the system turn), 2 (after a user turn) and 3 (after an assistant turn). A nonterminal X(p, q) stands for the spans
of rows that can be repaired so as to lead from place p to place q; in Chomsky normal form its rules are X(p, r) -> X(p, q) X(q, r), and a row is a terminal that may be kept,
given another role or deleted. A span's cell has the least (cost, audit) of each nonterminal. Rows that are missing come in by the insertion closure: X(p, q) of the empty span, joined to
both sides of every terminal. Cells are filled from the bottom by span length, neighbours joined two by two; as the rules are closed under joining, every way
to split a span gives the same cell. The cheapest audits of a span have no other one as their beginning (it would lack an insertion, so be cheaper), so the least of joined audits joins least audits.

Rows are range-partitioned by conversation, turn, role and text, so a conversation of any length is spread over tasks. One that lies in one partition is repaired there; of
others each partition's piece gives its cells, the pieces' cells are joined, and each piece is then written by its own part of the audit. A digest of a
whole conversation is carried from piece to piece.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tessera.session import settle, ship

# What an edit costs, and a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5

START, SYSTEM, USER, ASSISTANT = range(4)

#: Where each role initial leads from each place.
STEPS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}

#: Nonterminals: all (p, q) where q can be reached from p.
NONTERMINALS = [(p, q) for p in range(4) for q in range(4) if p == q or (p, q) in {(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3), (3, 2)}]
RULES = [(NONTERMINALS.index((p, r)), NONTERMINALS.index((p, q)), NONTERMINALS.index((q, r))) for p, r in NONTERMINALS for q in range(4) if (p, q) in NONTERMINALS and (q, r) in NONTERMINALS]

Cell = tuple  # the least (cost, audit) of each nonterminal, or None


def join(one: Cell, other: Cell) -> Cell:
    """The cell of two neighbouring spans."""
    out: list = [None] * len(NONTERMINALS)
    for x, a, b in RULES:
        left, right = one[a], other[b]
        if left is None or right is None:
            continue
        got = (left[0] + right[0], left[1] + right[1])
        if out[x] is None or got < out[x]:
            out[x] = got
    return tuple(out)


def _insertions() -> Cell:
    """The empty span's cell: nothing, or as many inserted rows as lead from p to q."""
    once: dict = {(p, p): (0, "") for p in range(4)}
    for (p, role), q in STEPS.items():
        if role in "ua":
            once[p, q] = (INSERT, "I")
    cell = tuple(once.get(x) for x in NONTERMINALS)
    while (more := join(cell, cell)) != cell:
        cell = more
    return cell


EMPTY = _insertions()


@lru_cache(maxsize=64)
def terminal(kind: str) -> Cell:
    """A row's cell with insertions on both sides. ``kind``: the role's initial (``o``: another one), in capitals if the row is truncated; ``x``: it has to go."""
    found: dict = {(p, p): (DELETE, "D") for p in range(4)}
    more = TRUNCATED if kind.isupper() else 0
    for (p, role), q in STEPS.items():
        if kind != "x" and (role == kind.lower() or role in "ua"):
            edit = (more, "K") if role == kind.lower() else (more + REROLE, "R")
            found[p, q] = min(found.get((p, q), edit), edit)
    return join(join(EMPTY, tuple(found.get(x) for x in NONTERMINALS)), EMPTY)


@lru_cache(maxsize=100_000)
def _short(kinds: str) -> Cell:
    return terminal(kinds) if len(kinds) == 1 else join(_short(kinds[: len(kinds) // 2]), _short(kinds[len(kinds) // 2 :]))


def span(kinds: str) -> Cell:
    """The cell of a span of rows, from the bottom by span length: eight rows at once (remembered), then neighbours two by two."""
    cells = [_short(kinds[i : i + 8]) for i in range(0, len(kinds), 8)] or [EMPTY]
    while len(cells) > 1:
        cells = [join(*cells[i : i + 2]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
    return cells[0]


def best(cell: Cell) -> tuple[int, str]:
    """Cost and audit of a whole conversation."""
    return min(cell[NONTERMINALS.index((START, q))] for q in (START, ASSISTANT) if cell[NONTERMINALS.index((START, q))])


def written(rows: list[tuple[str, str]], audit: str, place: int = START) -> list[str]:
    """The repaired ``role:text`` lines of rows (role, text) by their audit, which begins at a place of the pattern."""
    out, k = [], 0
    for edit in audit:
        role = "assistant" if place == USER else "user"
        if edit == "D":
            k += 1
            continue
        if edit == "I":
            out.append(f"{role}:")
        else:
            out.append(f"{rows[k][0] if edit == 'K' else role}:{rows[k][1]}")
            role = rows[k][0] if edit == "K" else role
            k += 1
        place = STEPS[place, role[0]]
    return out


def _place_after(audit: str, kinds: str, place: int) -> int:
    k = 0
    for edit in audit:
        role = "a" if place == USER else "u"
        if edit != "I":
            role, k = (kinds[k].lower() if edit == "K" else role), k + 1
        if edit != "D":
            place = STEPS[place, role]
    return place


#: What is counted of a stretch of rows; turns and initials of its ends are kept, so that stretches can be joined.
COUNTS = ["distinct", "blank", "duplicate", "truncated", "illegal"]
_LEGAL = {"su", "ua", "au"}


class Stretch:
    """Rows of one conversation, added in order."""

    def __init__(self):
        self.kinds: list[str] = []
        self.rows: list[tuple[str, str]] = []
        self.count = dict.fromkeys(COUNTS, 0)
        self.low = self.high = self.head = self.tail = None

    def add(self, turn: int | None, role: str, text: str, blank: bool, truncated: bool, seen: bool) -> None:
        if turn is not None:
            self.count["distinct"] += turn != self.high
            self.low = turn if self.low is None else self.low
            self.high = turn
        initial = role[:1]
        if self.tail is None:
            self.head = initial
        else:
            self.count["illegal"] += self.tail + initial not in _LEGAL
        self.tail = initial
        fault = "blank" if blank else "duplicate" if seen else "truncated" if truncated else ""
        if fault:
            self.count[fault] += 1
        kind = initial if initial in ("s", "u", "a") else "o"
        self.kinds.append("x" if fault in ("blank", "duplicate") else kind.upper() if fault else kind)
        self.rows.append((role, text))


_REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_PIECE = f"conv string, piece int, kinds string, {', '.join(f'{c} long' for c in COUNTS)}, low long, high long, head string, tail string"


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with faults put in by c = CRC-32 of ``conv_id:turn`` modulo 20; nulls count as one space (turns and ids stay null).

    0: the row is dropped, 1: its text is emptied, 2: it loses its full stops, exclamation and question marks, 3: it stands twice, 4: it gets the role user.
    """
    space = F.lit(" ")
    c = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space)).cast("binary")) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), c.alias("c"))
    text = F.when(F.col("c") == 1, "").when(F.col("c") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("c") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("c") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.filter("c <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows by conversation, turn, role and text over range partitions, settled, with their place ``at`` and partition ``piece``. ``conv`` is the id as text, empty for null."""
    last = F.right(F.rtrim("text", F.lit(" \t\n\x0b\f\r")), F.lit(1))
    marked = rows.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"), "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    marked = marked.withColumn("last", last)
    keys = ["conv", "turn", "role", "text"]
    out = settle(marked.repartitionByRange(*keys).sortWithinPartitions(*keys))
    at = F.monotonically_increasing_id()  # partition and row of a settled table
    return out.select("conv", "turn", "role", "text", (F.col("last") == "").alias("blank"), (~F.col("last").isin(".", "!", "?")).alias("cut"), at.alias("at"), F.spark_partition_id().alias("piece"))


def _whole(rows: DataFrame) -> DataFrame:
    """The report and the repaired text of conversations that lie in one partition, in order."""
    ship(rows.sparkSession)
    schema = f"conv string, {_REPORT}, repaired string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        conv, now, seen = None, Stretch(), set()

        def done() -> None:
            cost, audit = best(span("".join(now.kinds)))
            gaps = 0 if now.low is None else now.high - now.low + 1 - now.count["distinct"]
            out.append((conv, gaps, *(now.count[c] for c in COUNTS[1:]), cost, audit, "\n".join(written(now.rows, audit))))

        for b in batches:
            for c, turn, role, text, blank, cut in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
                if c != conv:
                    if conv is not None:
                        done()
                    conv, now, seen = c, Stretch(), set()
                now.add(turn, role, text, blank, cut, (role, text) in seen)
                seen.add((role, text))
            if len(out) >= 1000:
                yield _batch(out, schema)
                out = []
        if conv is not None:
            done()
        if out:
            yield _batch(out, schema)

    return rows.select("conv", "turn", "role", "text", "blank", "cut").mapInArrow(run, schema)


_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}


def _arrow(schema: str) -> pa.Schema:
    return pa.schema([(c.split()[0], _ARROW[c.split()[1]]) for c in schema.split(", ")])


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = _arrow(schema)
    return pa.RecordBatch.from_arrays([pa.array(x, k.type) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)


def _pieces(rows: DataFrame) -> DataFrame:
    """What each piece of a conversation that lies in several partitions adds to it."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("at")
        now = Stretch()
        for turn, role, blank, cut, seen in zip(*(t[c].to_pylist() for c in ("turn", "role", "blank", "cut", "seen")), strict=True):
            now.add(turn, role, "", blank, cut, seen)
        return pa.Table.from_batches([_batch([(t["conv"][0].as_py(), t["piece"][0].as_py(), "".join(now.kinds), *(now.count[c] for c in COUNTS), now.low, now.high, now.head, now.tail)], _PIECE)])

    narrow = rows.select("conv", "piece", "at", "turn", "role", "blank", "cut", "seen")
    return narrow.groupBy("conv", "piece").applyInArrow(run, _PIECE)


def _cells(pieces: DataFrame) -> DataFrame:
    """(conv, piece, cell): the cell of each piece, a cost and an audit for each nonterminal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for conv, piece, kinds in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                cell = [x or (-1, "") for x in span(kinds)]
                yield pa.RecordBatch.from_arrays([pa.array([conv]), pa.array([piece], pa.int32()), pa.array([[c for c, _ in cell]], pa.list_(pa.int64())), pa.array([[a for _, a in cell]], pa.list_(pa.string()))], names=["conv", "piece", "costs", "audits"])

    return pieces.select("conv", "piece", "kinds").mapInArrow(run, "conv string, piece int, costs array<long>, audits array<string>")


def _joined(pieces: DataFrame) -> DataFrame:
    """(conv, report, parts): the cells of a conversation's pieces joined; parts has each piece's share of the audit and the place of the pattern that it begins at."""
    part = "array<struct<piece:int,audit:string,place:int>>"
    fields = _arrow(_REPORT)

    def run(t: pa.Table) -> pa.Table:
        rows = t.sort_by("piece").to_pylist()
        cells = [tuple(None if c < 0 else (c, a) for c, a in zip(r["costs"], r["audits"], strict=True)) for r in rows]
        while len(cells) > 1:
            cells = [join(*cells[i : i + 2]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
        cost, audit = best(cells[0])
        total = {c: sum(r[c] for r in rows) for c in COUNTS}
        turns = [r for r in rows if r["low"] is not None]
        for a, b in zip(rows, rows[1:], strict=False):
            total["illegal"] += a["tail"] + b["head"] not in _LEGAL
        total["distinct"] -= sum(a["high"] == b["low"] for a, b in zip(turns, turns[1:], strict=False))
        gaps = turns[-1]["high"] - turns[0]["low"] + 1 - total["distinct"] if turns else 0
        parts, place, k = [], START, 0
        for r in rows:
            n, end = len(r["kinds"]), k
            while n:
                n -= audit[end] != "I"
                end += 1
            if r is rows[-1]:
                end = len(audit)
            parts.append({"piece": r["piece"], "audit": audit[k:end], "place": place})
            place, k = _place_after(audit[k:end], r["kinds"], place), end
        report = pa.Table.from_batches([pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((gaps, *(total[c] for c in COUNTS[1:]), cost, audit), fields, strict=True)], schema=fields)])
        kind = pa.list_(pa.struct([("piece", pa.int32()), ("audit", pa.string()), ("place", pa.int32())]))
        return report.add_column(0, "conv", [[rows[0]["conv"]]]).append_column("parts", pa.array([parts], kind))

    return pieces.join(_cells(pieces), ["conv", "piece"]).groupBy("conv").applyInArrow(run, f"conv string, {_REPORT}, parts {part}")


def _written(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """(conv, piece, repaired): the repaired text of each piece; null where nothing is left of it."""
    schema = "conv string, piece int, repaired string"

    def run(t: pa.Table, p: pa.Table) -> pa.Table:
        t = t.sort_by("at")
        lines = written(list(zip(t["role"].to_pylist(), t["text"].to_pylist(), strict=True)), p["audit"][0].as_py(), p["place"][0].as_py())
        return pa.Table.from_batches([_batch([(p["conv"][0].as_py(), p["piece"][0].as_py(), "\n".join(lines) if lines else None)], schema)])

    both = rows.select("conv", "piece", "at", "role", "text").groupBy("conv", "piece").cogroup(parts.groupBy("conv", "piece"))
    return both.applyInArrow(run, schema)


def _digests(texts: DataFrame) -> DataFrame:
    """(conv, sha): SHA-256 of the pieces of each conversation, joined by line feeds. A digest goes from byte to byte, so the pieces pass through one task one after the other; none is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest, any_ = None, hashlib.sha256(), False
        for b in batches:
            for c, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if c != conv:
                    if conv is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([conv]), pa.array([digest.hexdigest()])], names=["conv", "sha"])
                    conv, digest, any_ = c, hashlib.sha256(), False
                if text.is_valid:
                    digest.update(b"\n" if any_ else b"")
                    digest.update(text.as_buffer())
                    any_ = True
        if conv is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv]), pa.array([digest.hexdigest()])], names=["conv", "sha"])

    return texts.repartition("conv").sortWithinPartitions("conv", "piece").select("conv", "repaired").mapInArrow(run, "conv string, sha string")


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of rows (conv_id, turn, role, text): a report of each conversation and its repaired text.

    The report has conv_id, gaps (turns missing between the first and the last), blank, duplicate, truncated (rows by their first fault), illegal (neighbours whose role initials are not su, ua or au), cost, audit
    (K keep, R give another role, D delete, I insert, in order; of the cheapest the least in ASCII) and repaired_sha256. The texts are (conv_id, piece, repaired), pieces in
    order, ``role:text`` lines joined by line feeds; a conversation in one partition is one piece, null pieces have nothing left.

    Rows go by turn, null turns first, rows of one turn by role and text; equal rows are repeats. Null roles and texts are one space; a null conv_id is a conversation of its own. Blank rows and
    rows whose role and text stood before have to go. An empty table gives no rows; other columns are not looked at.
    """
    ordered = _ordered(rows)
    ends = ordered.groupBy("piece").agg(F.min("conv").alias("a"), F.max("conv").alias("b"))  # conversations that a border may cut: two of each partition
    cut = ends.select("piece", F.explode(F.array_distinct(F.array("a", "b"))).alias("conv")).groupBy("conv").agg(F.count("*").alias("n")).filter("n > 1").select("conv")
    cut = F.broadcast(settle(cut))  # at most one for each border between partitions
    whole = _whole(ordered.join(cut, "conv", "left_anti"))
    parted = ordered.join(cut, "conv", "left_semi").withColumn("h", F.md5(F.concat_ws("\0", "role", "text")))
    first = parted.groupBy("conv", "h").agg(F.min("at").alias("first"))
    parted = settle(parted.join(first, ["conv", "h"]).withColumn("seen", F.col("at") > F.col("first")).drop("h", "first"))
    joined = settle(_joined(_pieces(parted)))
    parts = joined.select("conv", F.explode("parts").alias("p")).select("conv", "p.*")
    texts = settle(_written(parted, parts))
    of_cut = joined.drop("parts").join(_digests(texts), "conv")
    numbered = F.when(F.col("conv") != "", F.col("conv")).cast("long").alias("conv_id")
    report = whole.select(numbered, *_columns(), F.sha2("repaired", 256).alias("repaired_sha256")).unionAll(of_cut.select(numbered, *_columns(), F.col("sha").alias("repaired_sha256")))
    return report, whole.select(numbered, F.lit(0).alias("piece"), "repaired").unionAll(texts.select(numbered, "piece", "repaired"))


def _columns() -> list[Column]:
    return [F.col(c.split()[0]) for c in _REPORT.split(", ")]


def with_all(report: DataFrame, conversations: DataFrame) -> DataFrame:
    """``report`` with a row of zeros, an empty audit and the empty text's digest for conversations that it has none of."""
    ids = conversations.select(F.col("conv_id").cast("long").alias("original")).distinct()
    out = ids.join(report, ids["original"].eqNullSafe(report["conv_id"]), "left")
    empty = {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit(""), 256)}
    return out.select(F.col("original").alias("conv_id"), *(F.coalesce(c, empty.get(c, F.lit(0).cast("long"))).alias(c) for c in report.columns[1:]))
