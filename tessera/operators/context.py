"""From ranked sections to the context, the quotes and the source list of an answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.session import sized


def document_title(lines: Column, stop: str, most: int = 5, chars: int = 140) -> Column:
    """Up to ``most`` non-blank lines after the code line (the first), up to a closing line, cut at ``chars`` characters."""
    rest = F.filter(F.slice(lines, F.lit(2), F.greatest(F.size(lines), F.lit(1))), lambda x: F.trim(x) != "")
    end = F.array_position(F.transform(rest, lambda x: x.rlike(stop)), True)
    kept = F.when(end > 0, F.slice(rest, F.lit(1), F.greatest(end - 1, F.lit(0)).cast("int"))).otherwise(rest)
    return F.substring(F.array_join(F.transform(F.slice(kept, 1, most), lambda x: F.trim(x)), " "), 1, chars)


def anchor_blocks(sections: DataFrame, anchors: DataFrame) -> DataFrame:
    """(section_id, block_no, text): blocks (runs of non-blank lines) that an anchor's text touches. Rows (section_id, text), (section_id, anchor).

    Blocks and anchors overlap as character ranges of one section.
    """
    parts = sections.select("section_id", "text", F.posexplode(F.split("text", r"\n\s*\n")).alias("block_no", "block"))
    w = Window.partitionBy("section_id").orderBy("block_no").rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumn("lo", F.coalesce(F.sum(F.length("block") + 2).over(w), F.lit(0)) + 1).withColumn("hi", F.col("lo") + F.length("block"))
    at = anchors.join(sections, "section_id").select("section_id", F.instr("text", F.col("anchor")).alias("a"), F.length("anchor").alias("n")).filter("a > 0")
    hit = placed.join(at, "section_id").filter((F.col("a") < F.col("hi")) & (F.col("a") + F.col("n") > F.col("lo")))
    return hit.select("section_id", "block_no", F.col("block").alias("text")).distinct()


def quotes(blocks: DataFrame) -> DataFrame:
    """A section's touched blocks in order, with a gap mark between blocks that are not neighbours."""
    w = Window.partitionBy("section_id").orderBy("block_no")
    lead = F.when(F.lag("block_no").over(w) + 1 < F.col("block_no"), "…\n\n").otherwise("")
    rows = blocks.withColumn("t", F.concat(lead, "text"))
    return rows.groupBy("section_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_no", "t"))), lambda x: x["t"]), "\n\n").alias("quote"))


def contexts(results: DataFrame) -> DataFrame:
    """(query_id, context, n_sources): results in rank order under numbered headers, with a list of the documents first where there are two or more. Rows: query_id, rank, file_stem, title, section_path, page, text."""
    page = F.when(F.col("page").isNotNull(), F.concat(F.lit(", trang "), F.col("page").cast("string"))).otherwise("")
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), "title", F.lit(" — "), "section_path", page, F.lit("\n"), "text")
    g = results.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))).alias("x"), F.array_sort(F.collect_set("title")).alias("titles"), F.count("*").alias("n_sources"))
    preface = F.when(F.size("titles") >= 2, F.concat(F.lit("Tài liệu: "), F.array_join("titles", "; "), F.lit("\n\n"))).otherwise("")
    return g.select("query_id", F.concat(preface, F.array_join(F.transform("x", lambda b: b["b"]), "\n\n---\n\n")).alias("context"), "n_sources")


def source_rows(results: DataFrame, chars: int = 220) -> DataFrame:
    """The sources table of each answer: index, file, path, snippet and rounded score. Rows: query_id, rank, file_stem, section_path, text, score."""
    i = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return results.select("query_id", i.alias("index"), "file_stem", "section_path", F.substring(F.trim(F.regexp_replace("text", r"\s+", " ")), 1, chars).alias("snippet"), F.round("score", 4).alias("score"))


def restored_formulas(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """Answers with each formula written as in the source, where exactly one spelling there has its key (the formula without spaces, braces and sizing commands). Rows (query_id, answer), (query_id, text)."""
    span = F.lit(r"(\$[^$]+\$)")
    key = lambda c: F.regexp_replace(c, r"[\s{}$]|\\left(?![a-z])|\\right(?![a-z])|\\,|\;", "")
    mine = answers.select("query_id", F.explode(F.array_distinct(F.regexp_extract_all("answer", span, 1))).alias("f")).withColumn("k", key(F.col("f")))
    theirs = sources.select("query_id", F.explode(F.regexp_extract_all("text", span, 1)).alias("s")).withColumn("k", key(F.col("s"))).groupBy("query_id", "k").agg(F.count_distinct("s").alias("n"), F.min("s").alias("s")).filter("n = 1")
    swaps = mine.join(theirs, ["query_id", "k"]).filter("f <> s").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("f", "s"))).alias("x"))
    rows = answers.join(swaps, "query_id", "left")
    return rows.select("query_id", F.aggregate(F.coalesce("x", F.array().cast("array<struct<f:string,s:string>>")), F.col("answer"), lambda t, p: F.replace(t, p["f"], p["s"])).alias("answer"))


def pick_source(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """For an answer without marks: its best source that shares a number with it, else the best that shares two words or more. Rows (query_id, answer), (query_id, pos, score, text)."""
    from tessera.functions.text import word_tokens

    numbers = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(r"(\d+(?:[.,]\d+)?)"), 1))
    long_ = lambda c: F.filter(F.array_distinct(word_tokens(c)), lambda w: F.length(w) > 3)
    rows = answers.filter(~F.col("answer").rlike(r"\[\d+\]")).join(sources, "query_id")
    tier = F.when(F.size(F.array_intersect(numbers(F.col("answer")), numbers(F.col("text")))) > 0, 2).when(F.size(F.array_intersect(long_(F.col("answer")), long_(F.col("text")))) >= 2, 1).otherwise(0)
    return rows.withColumn("tier", tier).filter("tier > 0").groupBy("query_id").agg(F.max_by("pos", F.struct("tier", "score", -F.col("pos"))).alias("pos"))


def out_of_scope(queries: DataFrame, names: DataFrame, generic: list[str]) -> DataFrame:
    """Queries whose object (the words after "kiểm định" without generic ones) no known name holds word for word. Rows (query_id, query), (name)."""
    words = F.filter(F.split(F.regexp_extract(F.lower("query"), r"(?U)kiểm định\s+(.+?)[?.!]*$", 1), r"\s+"), lambda w: (w != "") & ~w.isin(*generic))
    asked = queries.select("query_id", F.array_sort(F.array_distinct(words)).alias("w")).filter("size(w) > 0")
    # queries that ask for the same words are looked up once, among the names that hold the one of them that fewest names hold
    sets = asked.select("w").distinct()
    known = names.select(F.array_distinct(F.split(F.lower("name"), r"\s+")).alias("words")).distinct()
    held = known.select("words", F.explode("words").alias("x"))
    counts = held.groupBy("x").agg(F.count("*").alias("n"))
    rarest = sets.select("w", F.explode("w").alias("x")).join(counts, "x", "left").groupBy("w").agg(F.min_by("x", F.struct(F.coalesce("n", F.lit(0)), "x")).alias("x"))
    found = sized(rarest.join(held, "x").filter(F.size(F.array_except("w", "words")) == 0).select("w").distinct())
    return asked.join(found, "w", "left_anti").select("query_id")


def names_device(queries: DataFrame, aliases: DataFrame) -> DataFrame:
    """(query_id, number): queries with a word that aliases of only one procedure hold. Rows (query_id, query), (alias, number)."""
    words = aliases.select("number", F.explode(F.split(F.lower("alias"), " ")).alias("w")).filter("w <> ''").distinct()
    own = words.groupBy("w").agg(F.count("*").alias("n"), F.min("number").alias("number")).filter("n = 1").select("w", "number")
    return queries.select("query_id", F.explode(F.array_distinct(F.split(F.lower("query"), r"[\s?.,!]+"))).alias("w")).join(own, "w").select("query_id", "number").distinct()
