"""Retrieval metrics over many queries and configurations at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tessera.session import sized

KS = (1, 3, 5, 10)


def first_ranks(hits: DataFrame, expected: DataFrame, queries: DataFrame, key: tuple[str, ...] = ()) -> DataFrame:
    """``rank`` of the first hit that matches an expected (file, path prefix), null where none does; one row per query."""
    same = hits.join(expected.select("query_id", "file_stem", F.col("section_path").alias("wanted")), ["query_id", "file_stem"]).filter(F.startswith("section_path", "wanted"))
    best = same.groupBy(*key, "query_id").agg(F.min("rank").alias("rank"))
    every = queries.select("query_id") if not key else queries.select("query_id").crossJoin(sized(hits.select(*key).distinct()))
    return every.join(best, [*key, "query_id"], "left")


def _heads(text: Column) -> Column:
    """A text and all that stands before a space or a full stop of it: "3.1 b" has "3.1 b", "3.1" and "3"."""
    ends = F.filter(F.sequence(F.lit(1), F.length(text)), lambda i: F.substring(text, i, F.lit(1)).isin(" ", "."))
    return F.when(F.length(text) > 0, F.array_union(F.array(text), F.transform(ends, lambda i: F.substring(text, F.lit(1), i - 1)))).otherwise(F.array(text))


def _numbered(text: Column, want: Column) -> Column:
    """Whether a line of the text, past marks of headings, begins with ``want`` and then a full stop or white space."""
    lines = F.transform(F.split(F.concat(text, F.lit("\0")), "\n"), lambda x: F.regexp_replace(x, "^[#\\s]+", ""))
    last = F.size(lines) - 1
    whole = F.transform(lines, lambda x, i: F.when(i < last, F.concat(x, F.lit("\n"))).otherwise(x))
    return F.exists(whole, lambda x: F.startswith(x, want) & F.substring(x, F.length(want) + 1, F.lit(1)).rlike("^[.\\s]"))


def gold_hits(questions: DataFrame, gold: DataFrame, hits: DataFrame) -> DataFrame:
    """Of each question: hit_topn, hit_shown, hit_loose and first_rank.

    questions (query_id, type), gold (query_id, gold_no, file_stem, section), hits (query_id, rank, file_stem, path, shown, parent_text). A hit has a gold section if a part of its path (parts
    stand between ``>``) is that section or begins with it and a space or a full stop: "3" has "3.1" but not "31". So a path is told apart into its beginnings, and gold is joined by equality. The shown view
    takes hits that were shown, the loose one also a hit whose parent text has a heading line of that number. A question of type ``multi_version`` needs all its gold, others any of it; one without
    gold has no hit. ``first_rank`` is the rank of the first hit with any gold section.
    """
    paths = hits.select("query_id", "rank", "file_stem", "shown", "parent_text", F.transform(F.split(F.coalesce("path", F.lit("")), ">"), lambda p: F.trim(p)).alias("parts"))
    heads = paths.select("query_id", "file_stem", "rank", "shown", F.explode(F.array_distinct(F.flatten(F.transform("parts", _heads)))).alias("section"))
    by_path = heads.join(gold, ["query_id", "file_stem", "section"]).select("query_id", "gold_no", "rank", "shown", F.lit(True).alias("exact"))
    by_text = paths.join(gold, ["query_id", "file_stem"]).filter(_numbered(F.col("parent_text"), F.col("section"))).select("query_id", "gold_no", "rank", "shown", F.lit(False).alias("exact"))
    found = by_path.unionAll(by_text).groupBy("query_id", "gold_no").agg(F.bool_or("exact").alias("topn"), F.bool_or(F.col("exact") & F.col("shown")).alias("shown"), F.lit(True).alias("loose"), F.min(F.when(F.col("exact"), F.col("rank"))).alias("rank"))
    each = gold.select("query_id", "gold_no").join(found, ["query_id", "gold_no"], "left").groupBy("query_id").agg(
        *(f(F.coalesce(v, F.lit(False))).alias(f"{name}_{v}") for v in ("topn", "shown", "loose") for name, f in (("any", F.bool_or), ("all", F.bool_and))), F.min("rank").alias("first_rank"),
    )
    pick = lambda v: F.coalesce(F.when(F.col("type") == "multi_version", F.col(f"all_{v}")).otherwise(F.col(f"any_{v}")), F.lit(False)).alias(f"hit_{v}")
    return questions.join(each, "query_id", "left").select(*questions.columns, *map(pick, ("topn", "shown", "loose")), "first_rank")


def gold_rates(found: DataFrame) -> DataFrame:
    """Number, share of hits in the three views and mean reciprocal of the first rank: in all, by type and by group (the other key is null), in one pass."""
    share = lambda c: F.avg(F.col(c).cast("int")).alias(c)
    rows = found.groupingSets([[], ["type"], ["group"]], "type", "group")
    return rows.agg(F.count("*").alias("n"), *map(share, ("hit_topn", "hit_shown", "hit_loose")), F.avg(F.coalesce(1 / F.col("first_rank"), F.lit(0.0))).alias("mrr"))


def metric_columns(ks: tuple[int, ...] = KS) -> list[Column]:
    """n, found, miss, recall, nDCG at each k, MRR and mean rank. Queries without a hit count as 0; the mean rank is null if none has one."""
    r = F.col("rank")
    out = [F.count("*").alias("n"), F.count("rank").alias("found"), (F.count("*") - F.count("rank")).alias("miss")]
    for k in ks:
        out.append(F.avg(F.when(r <= k, 1.0).otherwise(0.0)).alias(f"recall_{k}"))
        out.append(F.avg(F.when(r <= k, 1 / F.log2(r + 1)).otherwise(0.0)).alias(f"ndcg_{k}"))
    return [*out, F.avg(F.coalesce(1 / r, F.lit(0.0))).alias("mrr"), F.avg("rank").alias("mean_rank")]


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))
