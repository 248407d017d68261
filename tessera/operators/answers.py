"""Scoring of answers against required facts, and reports by group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.functions.text import REFUSAL, UNITS, latex_text, measurement_number, measurement_text
from tessera.session import settle


def normal_form(kind: Column, text: Column) -> Column:
    """A fact's or an answer's form for comparing facts of a kind."""
    return F.when(kind.isin("number", "unit"), measurement_number(text)).when(kind == "formula", latex_text(text)).otherwise(measurement_text(text))


def fact_present(facts: DataFrame, answers: DataFrame) -> DataFrame:
    """``present`` for each fact (question_id, fact_no, kind, text, aliases): its text or an alias stands in the answer. Each answer is normalised once per kind."""
    kinds = facts.select("question_id", "kind").distinct()
    forms = kinds.join(answers, "question_id").select("question_id", "kind", normal_form(F.col("kind"), F.col("answer")).alias("a"))
    names = facts.select("question_id", "fact_no", "kind", F.explode(F.concat(F.array("text"), F.coalesce("aliases", F.array()))).alias("name")).filter("name <> ''")
    hit = names.withColumn("n", normal_form(F.col("kind"), F.col("name"))).join(forms, ["question_id", "kind"], "left")
    found = hit.groupBy("question_id", "fact_no").agg(F.max(F.coalesce(F.col("a").contains(F.col("n")), F.lit(False))).alias("present"))
    return facts.select("question_id", "fact_no").join(found, ["question_id", "fact_no"], "left").select("question_id", "fact_no", F.coalesce("present", F.lit(False)).alias("present"))


def coverage(present: DataFrame, questions: DataFrame) -> DataFrame:
    """Share of a question's facts that are present; 1 for a question without facts."""
    got = present.groupBy("question_id").agg(F.avg(F.col("present").cast("double")).alias("covered"))
    return questions.select("question_id").join(got, "question_id", "left").select("question_id", F.coalesce("covered", F.lit(1.0)).alias("coverage"))


def refused(answer: Column) -> Column:
    return measurement_text(answer).contains(REFUSAL)


CLAIM = r"(?i)([±+-]?\d[\d.,]*(?:\s\d{3})*\s*(?:" + "|".join(UNITS) + "))"


def unsupported_claims(answer: Column, context: Column) -> Column:
    """Numbers with units of an answer that its context lacks; array in canonical form. A number alone in a table cell supports the claim."""
    held = measurement_number(context)
    claims = F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(CLAIM), 1), measurement_number))
    digits = lambda c: F.regexp_extract(c, r"^(\d+(?:\.\d+)?)", 1)
    return F.filter(claims, lambda c: ~held.contains(c) & ~held.contains(F.concat(F.lit("|"), digits(c), F.lit("|"))))


def report(records: DataFrame) -> DataFrame:
    """Per category and over all (category null): coverage, refusal accuracy among questions that must be refused, wrong refusals among the rest, and the share of answers with unsupported claims."""
    must = F.col("must_refuse")
    return records.rollup("category").agg(
        F.count("*").alias("n"),
        F.avg(F.when(~must, F.col("coverage"))).alias("coverage"),
        F.avg(F.when(must, F.col("refused").cast("double"))).alias("refusal_accuracy"),
        F.sum((~must & F.col("refused")).cast("int")).alias("wrong_refusals"),
        F.avg(F.when(~F.col("refused"), (F.col("n_unsupported") > 0).cast("double"))).alias("hallucination_rate"),
    )


def side_by_side(records: DataFrame, models: list[str], value: str) -> DataFrame:
    """A column per model of a mean per category, and the last model's difference to the first."""
    wide = records.groupBy("category").pivot("model", models).agg(F.avg(value))
    return wide.withColumn("delta", F.col(models[-1]) - F.col(models[0]))


def latency(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Mean, median, p95 (the element at index min(n - 1, int(0.95 n)) in order) and largest value per key; missing values don't count.

    Equal values are counted first, then sorted into ranges over all keys. Counts by range say in which range an element is, and only such ranges are numbered.
    """
    r = rows.select(F.col(key).alias("k"), F.col(value).alias("v"))
    whole = r.groupBy("k").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.max("v").alias("largest"))
    at = {"low": F.floor((F.col("n") - 1) / 2), "high": F.floor(F.col("n") / 2), "p95": F.least(F.col("n") - 1, F.floor(F.col("n") * 0.95))}
    wanted = whole.filter("n > 0").select("k", F.explode(F.array(*(F.struct(F.lit(name).alias("which"), x.cast("bigint").alias("at")) for name, x in at.items()))).alias("x")).select(F.col("k").alias("wk"), "x.*")
    counted = r.filter("v IS NOT NULL").groupBy("k", "v").agg(F.count("*").alias("c"))
    ranged = settle(counted.repartitionByRange("k", "v").withColumn("part", F.spark_partition_id()))
    by_part = Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per key and range
    parts = ranged.groupBy("k", "part").agg(F.sum("c").alias("c")).withColumn("before", F.coalesce(F.sum("c").over(by_part), F.lit(0)))
    reached = (F.col("before") <= F.col("at")) & (F.col("at") < F.col("before") + F.col("c"))
    there = wanted.join(parts, F.col("wk").eqNullSafe(F.col("k"))).filter(reached).select("wk", "part", "which", (F.col("at") - F.col("before")).alias("at"))
    inside = Window.partitionBy("k", "part").orderBy("v")
    held = there.select(F.col("wk").alias("hk"), F.col("part").alias("hp")).distinct()
    near = ranged.join(held, F.col("k").eqNullSafe(F.col("hk")) & (F.col("part") == F.col("hp")), "left_semi").withColumn("upto", F.sum("c").over(inside))
    found = near.withColumnRenamed("part", "np").join(there, F.col("k").eqNullSafe(F.col("wk")) & (F.col("np") == F.col("part")) & (F.col("at") < F.col("upto"))).groupBy("wk").pivot("which", list(at)).agg(F.min("v"))
    out = whole.join(found, F.col("k").eqNullSafe(F.col("wk")), "left")
    return out.select(F.col("k").alias(key), "mean", ((F.col("low") + F.col("high")) / 2).alias("p50"), "p95", "largest")


def stability(runs: DataFrame) -> DataFrame:
    """Per strategy and group, with all subtotals: runs, share passed, ids that always pass, ids whose runs differ. Rows: strategy, grp, id, passed."""
    ids = runs.groupBy("strategy", "grp", "id").agg(F.count("*").alias("n"), F.sum(F.col("passed").cast("int")).alias("ok"), F.bool_and("passed").alias("always"), (F.count_distinct("passed") > 1).alias("unstable"))
    return ids.cube("strategy", "grp").agg(F.sum("n").alias("runs"), (F.sum("ok") / F.sum("n")).alias("pass_rate"), F.sum(F.col("always").cast("int")).alias("always_pass"), F.sum(F.col("unstable").cast("int")).alias("unstable_ids"))


def gate(old: DataFrame, new: DataFrame) -> DataFrame:
    """Per file: block if fewer formulas are converted than before, or a smaller share of them."""
    o = old.select("file", F.col("converted").alias("old_converted"), F.col("rate").alias("old_rate"))
    rows = new.join(o, "file", "left")
    return rows.select("file", F.when(F.col("converted") < F.col("old_converted"), "fewer converted").when(F.col("rate") < F.col("old_rate"), "lower rate").alias("reason"))


# What stands where a formula could not be read, and the commands that letters must not follow.
SENTINEL = "[công thức không đọc được]"
_GREEK = "varepsilon|vartheta|varsigma|epsilon|upsilon|Upsilon|varrho|lambda|varphi|Lambda|alpha|gamma|delta|theta|kappa|varpi|sigma|omega|Gamma|Delta|Theta|Sigma|Omega|beta|zeta|iota|eta|rho|tau|phi|chi|psi|Phi|Psi|mu|nu|xi|pi|Xi|Pi"


def _braces(latex: Column) -> Column:
    """Unescaped braces in order: array of (at, depth after it)."""
    plain = F.regexp_replace(latex, r"(?s)\\.", "  ")
    found = F.filter(F.transform(F.split(plain, ""), lambda c, i: F.struct(i.alias("at"), F.when(c == "{", 1).when(c == "}", -1).otherwise(0).alias("d"))), lambda x: x["d"] != 0)

    def step(s: Column, x: Column) -> Column:
        depth = s["depth"] + x["d"]
        return F.struct(depth.alias("depth"), F.concat(s["out"], F.array(F.struct(x["at"].alias("at"), depth.alias("depth")))).alias("out"))

    return F.aggregate(found, F.struct(F.lit(0).alias("depth"), F.array().cast("array<struct<at:int,depth:int>>").alias("out")), step)["out"]


def _empty_fraction(latex: Column, braces: Column) -> Column:
    """Whether a ``\\frac`` has a numerator or a denominator without anything in it."""
    parts = F.split(latex, r"\\frac(?![a-zA-Z])", -1)
    ends = F.slice(F.transform(parts, lambda p, i: F.aggregate(F.slice(parts, F.lit(1), i + 1), F.lit(0), lambda n, x: n + F.length(x) + 5)), F.lit(1), F.size(parts) - 1)

    def close(at: Column) -> Column:
        """Place of the brace that closes the group which begins at ``at``; null if none begins there or it never ends."""
        depth = F.get(F.transform(F.filter(braces, lambda b: b["at"] == at), lambda b: b["depth"]), F.lit(0))
        later = F.filter(braces, lambda b: (b["at"] > at) & (b["depth"] < depth))
        return F.when(F.substring(latex, at + 1, F.lit(1)) == "{", F.get(F.transform(later, lambda b: b["at"]), F.lit(0)))

    empty = lambda lo, hi: F.coalesce(F.substring(latex, lo + 2, hi - lo - 1).rlike(r"^\s*$"), F.lit(False))
    groups = F.transform(ends, lambda e: F.struct(e.alias("a"), close(e).alias("b")))
    groups = F.transform(groups, lambda g: F.struct(g["a"].alias("a"), g["b"].alias("b"), close(g["b"] + 1).alias("c")))
    return F.exists(groups, lambda g: empty(g["a"], g["b"]) | empty(g["b"] + 1, g["c"]))


def latex_problem(formulas: DataFrame, latex: str) -> DataFrame:
    """``formulas`` with ``problem`` of a column of bare LaTeX: the first rule that it breaks, or null.

    dollar; extra closing brace (with ``place``, its number of characters before it), open braces; left and right; glued command; bare brace as a delimiter; empty fraction. Escaped characters are
    no braces; depth is followed from brace to brace.
    """
    t = F.col(latex)
    rows = formulas.withColumn("_braces", _braces(t))
    low = F.get(F.filter("_braces", lambda b: b["depth"] < 0), F.lit(0))
    last = F.coalesce(F.try_element_at("_braces", F.lit(-1))["depth"], F.lit(0))
    sides = F.regexp_count(t, F.lit(r"\\left(?![a-zA-Z])")) != F.regexp_count(t, F.lit(r"\\right(?![a-zA-Z])"))
    problem = F.when(F.contains(t, F.lit("$")), "dollar").when(low.isNotNull(), "extra closing brace").when(last != 0, "open braces").when(sides, "left and right")
    problem = problem.when(t.rlike(rf"\\({_GREEK})[A-Za-z]"), "glued command").when(t.rlike(r"\\(?:left|right)[{}]"), "bare brace").when(_empty_fraction(t, F.col("_braces")), "empty fraction")
    rows = rows.withColumn("problem", problem)
    return rows.withColumn("place", F.when(F.col("problem") == "extra closing brace", low["at"])).drop("_braces")


def fidelity(markdown: DataFrame, formulas: DataFrame, totals: DataFrame) -> DataFrame:
    """(doc, problem, n) of an extraction: Markdown lines (doc, text), formulas (doc, latex) and what the report says (doc, found, converted, rates, a map).

    ``rate`` of each kind below 1; ``lost`` formulas, found but not converted; ``spans``, by how many the formulas in the Markdown (``$..$`` within a line) differ from those converted;
    ``unread`` marks left in the Markdown; and each formula's own problem. A document without Markdown or formulas has none of them.
    """
    spans = F.regexp_count("text", F.lit(r"\$[^$\n]+\$"))
    text = markdown.groupBy("doc").agg(F.sum(spans).alias("spans"), F.sum(F.contains("text", F.lit(SENTINEL)).cast("int")).alias("unread"))
    rows = totals.join(text, "doc", "full").select(
        "doc", F.size(F.filter(F.map_values("rates"), lambda r: F.abs(r - 1) > 1e-9)).alias("rate"), F.when(F.col("found") != F.col("converted"), F.abs(F.col("found") - F.col("converted"))).alias("lost"),
        F.when(F.col("converted").isNotNull(), F.abs(F.coalesce("spans", F.lit(0)) - F.col("converted"))).alias("spans"), "unread",
    )
    whole = rows.unpivot("doc", [F.col(c).cast("long").alias(c) for c in ("rate", "lost", "spans", "unread")], "problem", "n").filter("n > 0")
    own = latex_problem(formulas, "latex").filter("problem IS NOT NULL").groupBy("doc", "problem").agg(F.count("*").alias("n"))
    return whole.unionByName(own)


def score_records(questions: DataFrame, facts: DataFrame) -> DataFrame:
    """One record per question: coverage of its facts, refusal, and unsupported claims. Rows (question_id, category, must_refuse, answer, context), (question_id, fact_no, kind, text, aliases)."""
    covered = coverage(fact_present(facts, questions.select("question_id", "answer")), questions)
    own = questions.select("question_id", "category", "must_refuse", refused(F.col("answer")).alias("refused"), F.size(unsupported_claims(F.col("answer"), F.col("context"))).alias("n_unsupported"))
    return own.join(covered, "question_id")


def inconsistent_gold(facts: DataFrame, gold: DataFrame) -> DataFrame:
    """Facts that their own gold answer lacks. Gold: (question_id, answer)."""
    return fact_present(facts, gold).filter("NOT present").select("question_id", "fact_no")
