"""Extraction reports, formula inventories and benchmark summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def totals(details: DataFrame) -> DataFrame:
    """Per file and over all (file null): equations, converted ones and their share, images; legacy files do not count. Rows: file, kind, ok, legacy."""
    eq, ok = F.col("kind") == "equation", F.col("ok")
    return details.filter("NOT legacy").rollup("file").agg(
        F.count("*").alias("n"), F.sum(eq.cast("int")).alias("equations"), F.sum((eq & ok).cast("int")).alias("converted"), F.sum((F.col("kind") == "image").cast("int")).alias("images"),
        F.round(F.sum((eq & ok).cast("int")) / F.nullif(F.sum(eq.cast("int")), F.lit(0)), 4).alias("rate"),
    )


def merged(report: DataFrame, entry: DataFrame) -> DataFrame:
    """A report with one file's rows replaced."""
    return report.join(entry.select("file").distinct(), "file", "left_anti").unionByName(entry)


def audit(inventory: DataFrame, registered: DataFrame) -> DataFrame:
    """Per file: formulas, those that have a calculator, their share. Rows (file, fid), (file, fid)."""
    rows = inventory.join(registered.select("file", "fid").distinct().withColumn("has", F.lit(1)), ["file", "fid"], "left")
    return rows.groupBy("file").agg(F.count("*").alias("n"), F.count("has").alias("covered"), F.avg(F.coalesce("has", F.lit(0))).alias("share"))


def suspicions(formulas: DataFrame) -> DataFrame:
    """``flags`` of each equation: empty numerator, denominator or right side; null flags stand for none. Rows: fid, latex."""
    t = F.regexp_replace("latex", r"\s+", "")
    found = F.array_compact(F.array(F.when(t.rlike(r"\\frac\{\}"), "numerator"), F.when(t.rlike(r"\\frac\{[^{}]*\}\{\}"), "denominator"), F.when(t.rlike("=$"), "right side")))
    return formulas.filter(F.col("latex").contains("=")).select("fid", found.alias("flags"), t.alias("plain"))


def numeric_summary(rows: DataFrame, absolute: float, relative: float) -> DataFrame:
    """Per mode: selection rate, useful answers, false refusals and unsafe numbers. A number is right within the larger of both tolerances. Rows: mode, answerable, answered, value, wanted."""
    right = F.abs(F.col("value") - F.col("wanted")) <= F.greatest(F.lit(absolute), F.abs("wanted") * relative)
    ok = F.col("answered") & F.coalesce(right, F.lit(False))
    return rows.groupBy("mode").agg(
        F.avg(F.col("answered").cast("int")).alias("selection_rate"), F.sum((F.col("answerable") & ok).cast("int")).alias("useful"),
        F.sum((F.col("answerable") & ~F.col("answered")).cast("int")).alias("false_refusals"), F.sum((F.col("answered") & ~ok).cast("int")).alias("unsafe"),
    )


def definition_errors(formulas: DataFrame, variables: DataFrame, units: list[str]) -> DataFrame:
    """(formula, error): no variables, repeated or ill-formed keys, unknown units, bounds in the wrong order. Rows (formula), (formula, key, unit, low, high)."""
    none = formulas.join(variables, "formula", "left_anti").select("formula", F.lit("no variables").alias("error"))
    twice = variables.groupBy("formula", "key").count().filter("count > 1").select("formula", F.lit("repeated key").alias("error"))
    checks = [(~F.col("key").rlike("^[a-z][a-z0-9_]*$"), "ill-formed key"), (~F.col("unit").isin(*units), "unknown unit"), (F.col("low") > F.col("high"), "bounds")]
    rows = variables.select("formula", F.explode(F.array_compact(F.array(*(F.when(c, e) for c, e in checks)))).alias("error"))
    return none.unionAll(twice).unionAll(rows).distinct()


def bound_status(cards: DataFrame, approvals: DataFrame) -> DataFrame:
    """``status`` of a formula card: ready, clarify (no approval) or blocked (file, revision or card differs from what was approved). Rows (card_id, file_hash, revision, body), (card_id, file_hash, revision, card_hash)."""
    own = cards.withColumn("card_hash", F.sha2(F.col("body"), 256))
    a = approvals.select("card_id", *(F.col(c).alias(f"a_{c}") for c in ("file_hash", "revision", "card_hash")))
    same = (F.col("file_hash") == F.col("a_file_hash")) & (F.col("revision") == F.col("a_revision")) & (F.col("card_hash") == F.col("a_card_hash"))
    return own.join(a, "card_id", "left").select("card_id", F.when(F.col("a_card_hash").isNull(), "clarify").when(same, "ready").otherwise("blocked").alias("status"))


def drafts(details: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Draft candidates of extracted formulas with an equals sign: the reviewed title if there is one, the text around the formula (700 characters before, 1200 after) and warnings. Rows (file_hash, fid, latex, text), (file_hash, fid, title)."""
    at = F.instr("text", F.col("latex"))
    around = F.when(at > 0, F.substring("text", F.greatest(at - 700, F.lit(1)), F.least(at - 1, F.lit(700)) + F.length("latex") + 1200))
    rows = details.filter(F.col("latex").contains("=")).join(reviewed, ["file_hash", "fid"], "left")
    warn = F.array_compact(F.array(F.when(F.col("title").isNull(), "not reviewed"), F.when(at == 0, "not in the text")))
    return rows.select("file_hash", "fid", F.coalesce("title", F.lit("")).alias("title"), around.alias("context"), F.array_join(warn, ",").alias("warnings"))
