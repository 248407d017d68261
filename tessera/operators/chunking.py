"""Markdown to sections, chunks and tables. Line work is done with array functions inside the row, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

HEADING = r"^#{1,6}\s+.+$"
MAX_CHARS, TABLE_ROWS, GROUP_ROWS = 4000, 15, 8


def chunk_id(stem: Column, path: Column, text: Column) -> Column:
    """16 hex digits that depend on file, section and text alone."""
    return F.substring(F.sha2(F.concat_ws("\u0000", stem, path, text), 256), 1, 16)


def sections(docs: DataFrame, stem: str = "file_stem", text: str = "text") -> DataFrame:
    """(file_stem, section_no, level, heading, body lines ``lines``) for each heading; what stands before the first goes."""
    lines = docs.select(F.col(stem).alias("file_stem"), F.split(text, "\n").alias("all"))
    heads = F.filter(F.sequence(F.lit(1), F.size("all")), lambda i: F.element_at("all", i).rlike(HEADING))
    cut = F.transform(
        "heads",
        lambda h, k: F.struct(
            F.element_at("all", h).alias("line"),
            F.slice("all", h + 1, F.coalesce(F.get(F.col("heads"), k + 1), F.size("all") + 1) - h - 1).alias("lines"),
        ),
    )
    rows = lines.withColumn("heads", heads).select("file_stem", F.posexplode(cut).alias("section_no", "s"))
    return rows.select("file_stem", (F.col("section_no") + 1).alias("section_no"), F.length(F.regexp_extract("s.line", "^(#+)", 1)).alias("level"), F.trim(F.regexp_replace("s.line", r"^#+\s+", "")).alias("heading"), F.col("s.lines").alias("lines"))


def with_paths(secs: DataFrame) -> DataFrame:
    """``section_path``: the heading and the last heading of each upper level that no still higher one has ended, joined by " > "."""
    before = Window.partitionBy("file_stem").orderBy("section_no")
    rows = secs
    for lv in range(1, 7):
        rows = rows.withColumn(f"l{lv}", F.last(F.when(F.col("level") == lv, F.struct("section_no", "heading")), ignorenulls=True).over(before))
    parts = []
    for lv in range(1, 7):
        newer = F.lit(False)
        for up in range(1, lv):
            newer = newer | F.coalesce(F.col(f"l{up}.section_no") > F.col(f"l{lv}.section_no"), F.lit(False))
        parts.append(F.when((F.col("level") > lv) & ~newer, F.col(f"l{lv}.heading")).when(F.col("level") == lv, F.col("heading")))
    return rows.withColumn("section_path", F.concat_ws(" > ", *parts)).drop(*(f"l{lv}" for lv in range(1, 7)))


def parent_text(heading: Column, lines: Column) -> Column:
    return F.concat(heading, F.lit("\n\n"), F.regexp_replace(F.array_join(lines, "\n"), r"^\s+|\s+$", ""))


def windows(text: Column, size: int = MAX_CHARS) -> Column:
    """A text without headings in pieces of at most ``size`` characters, each cut at its last space where it has one; array of strings.

    Where a cut falls depends on the one before, so an ordered fold carries the place; there are at most twice as many pieces as full windows.
    """
    t = text

    def step(state, _):
        at = state["at"]
        piece = F.substring(t, at, F.lit(size))
        more = at + size <= F.length(t)
        stop = F.when(more & piece.contains(" "), F.length(piece) - F.length(F.substring_index(piece, " ", -1)) - 1).otherwise(F.length(piece))
        stop = F.when(stop > 0, stop).otherwise(F.length(piece))
        cut = F.trim(F.substring(piece, F.lit(1), stop))
        return F.when(at > F.length(t), state).otherwise(F.struct((at + stop).cast("int").alias("at"), F.concat(state["parts"], F.array(cut)).alias("parts")))

    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<string>").alias("parts"))
    turns = F.sequence(F.lit(1), F.ceil(F.length(t) / size * 2).cast("int") + 1)
    return F.filter(F.aggregate(turns, start, step)["parts"], lambda p: p != "")


def blocks(lines: Column) -> Column:
    """Runs of table lines and of other lines, ended by blank lines; array of (kind, text).

    A run that is one ``$...$`` alone is a formula.
    """
    blank = lambda x: F.trim(x) == ""
    kind = lambda x: F.when(blank(x), "blank").when(F.trim(x).startswith("|"), "table").otherwise("text")
    starts = F.filter(F.sequence(F.lit(1), F.size(lines)), lambda i: ~blank(F.element_at(lines, i)) & ((i == 1) | (kind(F.element_at(lines, F.greatest(i - 1, F.lit(1)))) != kind(F.element_at(lines, i)))))
    ends = F.filter(F.sequence(F.lit(1), F.size(lines)), lambda i: ~blank(F.element_at(lines, i)) & ((i == F.size(lines)) | (kind(F.element_at(lines, F.least(i + 1, F.size(lines)))) != kind(F.element_at(lines, i)))))
    runs = F.zip_with(starts, ends, lambda s, e: F.slice(lines, s, e - s + 1))
    joined = lambda r: F.trim(F.array_join(r, "\n"))
    named = F.transform(runs, lambda r: F.struct(F.when(F.trim(F.get(r, F.lit(0))).startswith("|"), "table").when(joined(r).rlike(r"(?s)^\$[^$]+\$$|^\$\$[^$]+\$\$$"), "formula").otherwise("paragraph").alias("kind"), joined(r).alias("text")))
    return F.when(F.size(lines) > 0, named).otherwise(F.array().cast("array<struct<kind:string,text:string>>"))


def table_groups(rows: DataFrame, most: int = TABLE_ROWS, group: int = GROUP_ROWS) -> DataFrame:
    """Data rows (table_id, row_no from 1, text, header) of long tables in groups, each with the header repeated and the last roman-numeral row before it.

    Short tables are one group.
    """
    w = Window.partitionBy("table_id")
    roman = F.when(F.col("text").rlike(r"^\|\s*[IVX]+\s*\|"), F.struct("row_no", "text"))
    known = rows.withColumn("n", F.count("*").over(w)).withColumn("roman", F.last(roman, ignorenulls=True).over(w.orderBy("row_no").rowsBetween(Window.unboundedPreceding, -1)))
    known = known.withColumn("group_no", F.when(F.col("n") > most, F.floor((F.col("row_no") - 1) / group)).otherwise(0).cast("int"))
    made = known.groupBy("table_id", "group_no").agg(F.first("header").alias("header"), F.min_by("roman", "row_no").alias("roman"), F.array_sort(F.collect_list(F.struct("row_no", "text"))).alias("rows"))
    lead = F.when((F.col("group_no") > 0) & ~F.get("rows", F.lit(0))["text"].rlike(r"^\|\s*[IVX]+\s*\|"), F.col("roman.text"))
    return made.select("table_id", "group_no", F.concat_ws("\n", "header", lead, F.array_join(F.col("rows.text"), "\n")).alias("text"))


def overlapping(text: Column, size: int = 1800, step: int = 1200) -> Column:
    """Windows of ``size`` characters every ``step``."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(step)), lambda i: F.substring(text, i + 1, F.lit(size)))


def runs_of(flags: DataFrame, most: int) -> DataFrame:
    """(doc, flag, first, last): runs of equal flags over consecutive pages, cut to at most ``most`` pages. Rows: doc, page, flag."""
    w = Window.partitionBy("doc").orderBy("page")
    change = (F.lag("flag").over(w).eqNullSafe(F.col("flag")) & (F.lag("page").over(w) == F.col("page") - 1)).cast("int")
    rows = flags.withColumn("run", F.sum(1 - F.coalesce(change, F.lit(0))).over(w))
    whole = rows.groupBy("doc", "run", "flag").agg(F.min("page").alias("lo"), F.max("page").alias("hi"))
    return whole.select("doc", "flag", F.explode(F.sequence("lo", "hi", F.lit(most).cast("bigint"))).alias("first"), "hi").select("doc", "flag", "first", F.least(F.col("first") + most - 1, "hi").alias("last"))


def nearest_heading(sections_: DataFrame, anchors: DataFrame) -> DataFrame:
    """The last numbered line of a section before an anchor: (section_id, anchor, heading). Rows: (section_id, text) and (section_id, anchor)."""
    found = anchors.join(sections_, "section_id").withColumn("at", F.instr("text", F.col("anchor"))).filter("at > 0")
    before = F.substring("text", F.lit(1), F.col("at") - 1)
    heads = F.regexp_extract_all(before, F.lit(r"(?m)^(\d+(?:\.\d+)*\.?\s.*)$"), 1)
    return found.select("section_id", "anchor", F.try_element_at(heads, F.lit(-1)).alias("heading"))
