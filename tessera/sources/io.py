"""Files and tables in and out: Markdown folders, question sets, reports, imports, index replacement."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.session import settle, ship

#: Declared, never inferred: ``id`` is missing in some sets.
ITEMS = "id string, question string, category string, expected array<struct<file_stem:string,section_path:string>>"
REPORT = "files array<struct<file:string,formula_detail:array<struct<fid:string,kind:string,latex:string,ok:boolean,section:string>>>>"


def _file_name():
    """A file's own name; the metadata column has it with escapes."""
    return F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))


def read_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """(file_stem, text) of a folder's Markdown files, one row per file."""
    rows = spark.read.option("pathGlobFilter", "*.md").text(folder, wholetext=True)
    return rows.select(F.regexp_replace(_file_name(), r"\.md$", "").alias("file_stem"), F.col("value").alias("text"))


def read_items(spark: SparkSession, path: str, category: str | None = None, limit: int | None = None) -> DataFrame:
    """Questions of a JSON-lines set, blank lines skipped; optionally of a category, the first ``limit`` by id."""
    rows = spark.read.schema(ITEMS).json(path).filter("question IS NOT NULL")
    rows = rows.filter(F.col("category") == category) if category else rows
    return rows.orderBy("id").limit(limit) if limit else rows


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """(file, fid, kind, latex, ok, section) of a nested extraction report; a file without formulas keeps a row."""
    files = spark.read.schema(REPORT).option("multiLine", True).json(path).select(F.explode("files").alias("f"))
    return files.select("f.file", F.explode_outer("f.formula_detail").alias("d")).select("file", "d.*")


def import_plan(spark: SparkSession, folder: str, ledger: DataFrame) -> DataFrame:
    """(name, ext, size_bytes, sha256, action) for a folder of source files: insert, replace (other bytes), update type (same bytes, other type) or skip.

    Ledger rows: name, sha256, doc_type; the type is told from the name.
    """
    from tessera.operators.ledger import classify

    files = spark.read.format("binaryFile").load(folder).select(_file_name().alias("name"), F.length("content").cast("bigint").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))
    files = files.withColumns({"ext": F.lower(F.regexp_extract("name", r"(\.[^.]*)$", 1)), "new_type": classify(F.col("name"), F.lit(""))["doc_type"]})
    rows = files.join(ledger.select("name", F.col("sha256").alias("old"), "doc_type"), "name", "left")
    action = F.when(F.col("old").isNull(), "insert").when(F.col("old") != F.col("sha256"), "replace").when(F.col("doc_type") != F.col("new_type"), "update type").otherwise("skip")
    return rows.select("name", "ext", "size_bytes", "sha256", action.alias("action"))


def write_files(rows: DataFrame, folder: str) -> DataFrame:
    """Write rows (name, text) to files of that name in a folder, each by one task; returns the settled list (name, size_bytes). A file is there whole or not at all; null texts are empty files.

    Names are basenames; the folder may be of any kind that pyarrow knows.
    """
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        for b in batches:
            sizes = []
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not name or "/" in name or name in (".", ".."):
                    raise ValueError(f"{name!r} is no file name")
                system.create_dir(base, recursive=True)
                raw, part = (text or "").encode(), f"{base}/.{name}.{uuid.uuid4().hex}"
                with system.open_output_stream(part) as out:
                    out.write(raw)
                system.move(part, f"{base}/{name}")
                sizes.append(len(raw))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64())], names=["name", "size_bytes"])

    return settle(rows.select("name", "text").mapInArrow(run, "name string, size_bytes long"))


#: Settings in a sweep's report.
BEST = 10


def sweep_report(rows: DataFrame, decision: DataFrame) -> str:
    """A sweep as Markdown: the best settings, a grid of each measure, and the decision. Rows of ``selection.summary``, some dozens, and the row of ``selection.decide``."""
    from tessera.operators.selection import order

    found, won = rows.orderBy(*order()).collect(), decision.first()
    line = lambda cells: "| " + " | ".join(map(str, cells)) + " |"
    out = ["# Sweep", "", "## Best settings", "", line(["#", "alpha", "k", "recall@5", "MRR"]), line(["---"] * 5)]
    out += [line([n, f"{r.alpha:.1f}", r.k, f"{r.recall:.3f}", f"{r.mrr:.3f}"]) for n, r in enumerate(found[:BEST], 1)]
    ks, alphas, at = sorted({r.k for r in found}), sorted({r.alpha for r in found}), {(r.alpha, r.k): r for r in found}
    for title, value in (("recall@5", "recall"), ("MRR", "mrr")):
        out += ["", f"## {title} by alpha and k", "", line(["alpha", *ks]), line(["---"] * (len(ks) + 1))]
        out += [line([f"{a:.1f}", *(f"{at[a, k][value]:.3f}" if (a, k) in at else "-" for k in ks)]) for a in alphas]
    out += ["", "## Decision", "", f"- Setting: alpha {won.alpha:.1f}, k {won.k}", f"- Change: {'yes' if won.change else 'no'}", f"- Reason: {won.reason}", ""]
    return "\n".join(out)


def write_sweep(rows: DataFrame, folder: str, value: str) -> None:
    """A sweep's rows as CSV, its questions as JSON lines, and the alpha by k grid of a value. ``sweep_report`` has it in Markdown."""
    flat = rows.select(*(c for c, t in rows.dtypes if not t.startswith("array")))
    flat.write.mode("overwrite").option("header", True).csv(f"{folder}/rows")
    rows.write.mode("overwrite").json(f"{folder}/questions")
    rows.groupBy("alpha").pivot("k").agg(F.first(value)).orderBy("alpha").write.mode("overwrite").option("header", True).csv(f"{folder}/grid")


def write_records(records: DataFrame, folder: str) -> None:
    """Score records, a folder per model."""
    records.write.mode("overwrite").partitionBy("model").json(folder)


def replace_by_file(old: DataFrame, new: DataFrame) -> DataFrame:
    """An index in which all chunks of the touched files are the new ones."""
    return old.join(new.select("file_stem").distinct(), "file_stem", "left_anti").unionByName(new)


def index_missing(old: DataFrame, arriving: DataFrame, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """The index with the files it lacked (all arriving ones, if forced), and (files_indexed, files_skipped, chunks_added, total)."""
    known = old.select("file_stem").distinct()
    added = arriving if force else arriving.join(known, "file_stem", "left_anti")
    out = replace_by_file(old, added)
    n = arriving.agg(F.count_distinct("file_stem").alias("files"))
    did = added.agg(F.count_distinct("file_stem").alias("files_indexed"), F.count("*").alias("chunks_added"))
    stats = did.join(n).join(out.agg(F.count("*").alias("total"))).select("files_indexed", (F.col("files") - F.col("files_indexed")).alias("files_skipped"), "chunks_added", "total")
    return out, stats


def scan_children(chunks: DataFrame, stems: DataFrame | None = None) -> DataFrame:
    """All children, optionally of some files."""
    kids = chunks.filter("NOT is_parent")
    return kids if stems is None else kids.join(stems, "file_stem", "left_semi")
