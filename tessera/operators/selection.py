"""Choosing a fusion setting from a sweep, and comparing search modes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.session import settle

BASE_ALPHA, BASE_K = 0.5, 60


def summary(ranks: DataFrame) -> DataFrame:
    """One row per setting from first ranks (alpha, k, split, query_id, rank): recall at 5 of each split and of both, MRR, number of questions and the ids missed at 5."""
    hit = F.coalesce((F.col("rank") <= 5).cast("double"), F.lit(0.0))
    return ranks.groupBy("alpha", "k").agg(
        F.count("*").alias("n"),
        F.avg(F.when(F.col("split") == "tune", hit)).alias("tune_recall"),
        F.avg(F.when(F.col("split") == "holdout", hit)).alias("holdout_recall"),
        F.avg(hit).alias("recall"),
        F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias("mrr"),
        F.array_sort(F.collect_set(F.when(hit == 0, F.col("query_id")))).alias("misses"),
    )


def order() -> list[Column]:
    """Best first: recall, MRR, then nearness to the present setting."""
    return [F.desc(F.round("recall", 9)), F.desc(F.round("mrr", 9)), F.round(F.abs(F.col("alpha") - BASE_ALPHA), 6), F.abs(F.col("k") - BASE_K), F.col("alpha"), F.col("k")]


def plateau(rows: DataFrame) -> DataFrame:
    """``flat``: no neighbour (alpha a step away at the same k, or the next k at the same alpha) loses more than one question against the setting."""
    at_k, at_alpha = Window.partitionBy("k").orderBy("alpha"), Window.partitionBy("alpha").orderBy("k")
    near = [f("recall").over(w) for w in (at_k, at_alpha) for f in (F.lag, F.lead)]
    ok = F.lit(True)
    for x in near:
        ok = ok & F.coalesce(F.round((F.col("recall") - x) * F.col("n")) <= 1, F.lit(True))
    return rows.withColumn("flat", ok)


def decide(rows: DataFrame, gate: float = 0.85) -> DataFrame:
    """One row: the setting to use, whether it is a change, and why. Rows of ``summary``; all are few.

    Settings below the gate on the tuning questions or below the present one on the held-out ones are out. The best of the rest that is flat or present itself
    challenges; it wins with two questions more, or with equal recall and 0.02 more MRR, and never if it misses a question that the present one has.
    """
    base = rows.filter((F.abs(F.col("alpha") - BASE_ALPHA) < 1e-9) & (F.col("k") == BASE_K)).select(F.col("recall").alias("b_recall"), F.col("mrr").alias("b_mrr"), F.col("holdout_recall").alias("b_holdout"), F.col("misses").alias("b_misses"))
    own = (F.abs(F.col("alpha") - BASE_ALPHA) < 1e-9) & (F.col("k") == BASE_K)
    fit = plateau(rows).join(F.broadcast(base)).filter((F.col("tune_recall") >= gate) & (F.col("holdout_recall") >= F.col("b_holdout")))
    first = fit.filter(own | F.col("flat")).orderBy(*order()).limit(1)
    gain = F.round((F.col("recall") - F.col("b_recall")) * F.col("n"))
    worse = F.size(F.array_except("misses", "b_misses")) > 0
    change = ~own & ~worse & ((gain >= 2) | ((F.col("recall") == F.col("b_recall")) & (F.col("mrr") - F.col("b_mrr") >= 0.02 - 1e-9)))
    why = F.when(own, "the present setting is first").when(worse, "misses a question that the present setting has").when(change, "better").otherwise("not better by enough")
    won = first.select(F.when(change, F.col("alpha")).otherwise(BASE_ALPHA).alias("alpha"), F.when(change, F.col("k")).otherwise(BASE_K).alias("k"), change.alias("change"), why.alias("reason"))
    none = rows.limit(1).select(F.lit(BASE_ALPHA).alias("alpha"), F.lit(BASE_K).alias("k"), F.lit(False).alias("change"), F.lit("no setting passes the gates").alias("reason"))
    return won.withColumn("p", F.lit(0)).unionAll(none.withColumn("p", F.lit(1))).orderBy("p").limit(1).drop("p")


def rank_formulas(questions: DataFrame, variables: DataFrame, least: float, most: int) -> DataFrame:
    """Formulas whose variables a question names: mean share of a variable's label words in the question, then the title's share, then the number of variables.

    Questions (query_id, words array), variables (formula, title array, label array), one row per variable. Formulas with the same titles and labels score alike, and so do questions of the same words: each kind is scored once against each kind, of
    which only the ``most`` first formulas can have a place. A mean of ``least`` needs a label with that share, so formulas are found by such labels; with a ``least`` of 0, by any word.
    """
    share = lambda words, hit: F.coalesce(F.size(F.array_intersect(words, hit)) / F.nullif(F.size(words), F.lit(0)), F.lit(0.0))
    sets = questions.select("query_id", F.array_sort(F.array_distinct("words")).alias("words"))
    asked = settle(sets.select("words").distinct().withColumn("asked", F.monotonically_increasing_id()))
    key = asked.select("asked", F.explode("words").alias("w"))
    own = variables.groupBy("formula").agg(F.array_sort(F.collect_list(F.struct("label", "title"))).alias("rows"))
    first = Window.partitionBy("rows").orderBy("formula")
    own = settle(own.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= most))
    kinds = settle(own.select("rows").distinct().withColumn("kind", F.monotonically_increasing_id()))
    labels = kinds.select("kind", F.explode("rows").alias("r")).select("kind", "r.label", "r.title")
    if least > 0:
        near = labels.select("label").distinct().select("label", F.explode(F.array_distinct("label")).alias("w")).join(key, "w").groupBy("label", "asked").agg(F.count("*").alias("n"))
        near = near.filter(F.col("n") / F.size("label") >= least - 1e-9).select("label", "asked")
        touched = near.join(labels.select("kind", "label").distinct(), "label").select("asked", "kind").distinct()
    else:
        touched = labels.select("kind", F.explode(F.array_union("label", "title")).alias("w")).distinct().join(key, "w").select("asked", "kind").distinct()
    whole = touched.join(asked, "asked").join(kinds, "kind").withColumn("hit", F.transform("rows", lambda r: F.struct(share(r["label"], F.col("words")).alias("c"), share(r["title"], F.col("words")).alias("t"))))
    mean = F.aggregate("hit", F.lit(0.0), lambda s, x: s + x["c"]) / F.size("hit")
    scored = whole.select("asked", "kind", mean.alias("coverage"), F.array_max("hit.t").alias("title"), F.size("hit").cast("bigint").alias("n")).filter(F.col("coverage") >= least)
    order = (F.desc(F.round("coverage", 9)), F.desc(F.round("title", 9)), F.desc("n"))
    best = scored.withColumn("nth", F.rank().over(Window.partitionBy("asked").orderBy(*order))).filter(F.col("nth") <= most).drop("nth")
    placed = best.join(kinds, "kind").join(own.select("rows", "formula"), "rows").withColumn("place", F.row_number().over(Window.partitionBy("asked").orderBy(*order, "formula"))).filter(F.col("place") <= most)
    return sets.join(asked, "words").join(placed.select("asked", "formula", "coverage", "title", "n", "place"), "asked").select("query_id", "formula", "coverage", "title", "n", "place")


def citation_correctness(facts: DataFrame, passages: DataFrame, cited: DataFrame) -> DataFrame:
    """Per question: facts in a passage of their own source (lenient), and in one that the answer cites (strict); 1 for a question without facts to check.

    Facts present in the answer (question_id, fact_no, text, file_stem, section_path), passages (question_id, pos, file_stem, section_path, text), cited (question_id, pos).
    """
    from tessera.functions.text import measurement_text

    p = passages.select("question_id", "file_stem", "pos", F.col("section_path").alias("have"), measurement_text(F.col("text")).alias("t"))
    hit = facts.withColumn("f", measurement_text(F.col("text"))).drop("text").join(p, ["question_id", "file_stem"]).filter(F.startswith("have", "section_path") & F.col("t").contains(F.col("f")))
    marks = hit.join(cited.withColumn("c", F.lit(1)), ["question_id", "pos"], "left").groupBy("question_id", "fact_no").agg(F.max("c").alias("c"))
    rows = facts.select("question_id", "fact_no").join(marks.withColumn("g", F.lit(1)), ["question_id", "fact_no"], "left")
    return rows.groupBy("question_id").agg(F.count("*").alias("n"), F.avg(F.coalesce("g", F.lit(0))).alias("lenient"), F.avg(F.coalesce("c", F.lit(0))).alias("strict"))
