"""Evidence, citations and several documents per answer; all keyed by query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.functions.text import word_tokens
from tessera.session import sized

_NUMBER = r"(\d+(?:[.,]\d+)?)"


def groups(hits: DataFrame) -> DataFrame:
    """Documents of each query in the order of their first hit: (query_id, file_stem, first, positions, place)."""
    g = hits.groupBy("query_id", "file_stem").agg(F.min("rank").alias("first"), F.array_sort(F.collect_list("rank")).alias("positions"))
    return g.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("first")))


def select_documents(grouped: DataFrame, named: DataFrame, most: int, least: int) -> DataFrame:
    """Documents to answer from: a query that names exactly one gets none here, two or more only those, none all; at most ``most``, and none if fewer than ``least`` are left."""
    n = named.groupBy("query_id").agg(F.count("*").alias("n_named"))
    rows = grouped.join(n, "query_id", "left").join(named.withColumn("is_named", F.lit(True)), ["query_id", "file_stem"], "left")
    count = F.coalesce("n_named", F.lit(0))
    rows = rows.filter((count == 0) | ((count >= 2) & F.coalesce("is_named", F.lit(False))))
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("query_id").orderBy("place"))).filter(F.col("k") <= most)
    return rows.withColumn("left", F.count("*").over(Window.partitionBy("query_id"))).filter(F.col("left") >= least).select("query_id", "file_stem", "k")


def uncovered(answers: DataFrame, grouped: DataFrame) -> DataFrame:
    """Documents that no affirmative sentence of the answer cites. Answers: (query_id, answer) with ``[n]`` marks on hit positions."""
    s = answers.select("query_id", F.explode(F.split("answer", r"(?<=[.!?])\s+|\n")).alias("s")).filter(~F.lower("s").rlike("không (nêu|có|tìm thấy)"))
    cited = s.select("query_id", F.explode(F.regexp_extract_all("s", F.lit(r"\[(\d+)\]"), 1)).alias("c")).select("query_id", F.col("c").cast("int").alias("pos")).distinct()
    have = grouped.select("query_id", "file_stem", F.explode("positions").alias("pos")).join(cited, ["query_id", "pos"]).select("query_id", "file_stem")
    return grouped.join(have, ["query_id", "file_stem"], "left_anti").select("query_id", "file_stem")


def merge_identical(entries: DataFrame) -> DataFrame:
    """Documents whose texts have the same numbers (as a multiset) are one entry: (query_id, signature, files, text of the first)."""
    sign = F.array_join(F.array_sort(F.regexp_extract_all("text", F.lit(_NUMBER), 1)), " ")
    return entries.withColumn("signature", sign).groupBy("query_id", "signature").agg(F.array_join(F.array_sort(F.collect_list("file_stem")), ",").alias("files"), F.min_by("text", "file_stem").alias("text"))


def followups(hits: DataFrame, least: float, most: int) -> DataFrame:
    """Documents whose best score reaches ``least``, the best ``most`` of them."""
    best = hits.groupBy("query_id", "file_stem").agg(F.max("score").alias("best")).filter(F.col("best") >= least)
    return best.withColumn("k", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("best", 9)), "file_stem"))).filter(F.col("k") <= most)


def unknown_codes(queries: DataFrame, sources: DataFrame) -> DataFrame:
    """(query_id, code): codes a query names that none of its sources holds. Rows (query_id, query), (query_id, text)."""
    pattern = F.lit(r"(?<!\d)(\d\.\d{3})(?!\d)")
    asked = queries.select("query_id", F.explode(F.array_distinct(F.regexp_extract_all("query", pattern, 1))).alias("code"))
    held = sources.select("query_id", F.explode(F.regexp_extract_all("text", pattern, 1)).alias("code")).distinct()
    return asked.join(held, ["query_id", "code"], "left_anti")


def interleave(candidates: DataFrame, per_source: int, cap: int) -> DataFrame:
    """Candidates (query_id, file_order, source_order, n, anchored, item): ``per_source`` of each source, anchored first; then one of each in turn across sources, then documents; up to ``cap``."""
    k = F.row_number().over(Window.partitionBy("query_id", "file_order", "source_order").orderBy(F.desc("anchored"), "n"))
    rows = candidates.withColumn("k", k).filter(F.col("k") <= per_source)
    in_file = F.row_number().over(Window.partitionBy("query_id", "file_order").orderBy("k", "source_order"))
    rows = rows.withColumn("turn", in_file)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("turn", "file_order"))).filter(F.col("place") <= cap)


def pick_quotes(scored: DataFrame, floor: float, relative: float, per_file: int) -> DataFrame:
    """Quotes of each document by score, from both floors up, without one whose text an earlier pick contains; ``per_file`` at most. Rows: query_id, file_stem, score, text.

    Rows are a query's hits, which the search has bounded; those above the floors are folded in order, since any of them may be contained in an earlier one.
    """
    best = F.max("score").over(Window.partitionBy("query_id"))
    rows = scored.withColumn("best", best).filter(F.col("score") >= F.greatest(F.lit(floor), relative * F.col("best")))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("k"), "text")))

    def take(picked: Column, x: Column) -> Column:
        known = F.exists(picked, lambda p: p.contains(x["text"]))
        return F.when((F.size(picked) >= per_file) | known, picked).otherwise(F.concat(picked, F.array(x["text"])))

    picked = rows.groupBy("query_id", "file_stem").agg(listed.alias("x")).select("query_id", "file_stem", F.aggregate("x", F.array().cast("array<string>"), take).alias("p"))
    return picked.select("query_id", "file_stem", F.posexplode("p").alias("place", "text"))


def _run_together(texts: DataFrame, name: str) -> DataFrame:
    """(query_id, name): the words of a query's texts (query_id, rank, text) in order of rank, without anything between them. A query's texts are what its search gave."""
    words = F.array_join(word_tokens(F.col("text")), "")
    listed = texts.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.coalesce(words, F.lit("")).alias("w")))).alias("x"))
    return listed.select("query_id", F.array_join(F.col("x.w"), "").alias(name))


def grounded(questions: DataFrame, quotes: DataFrame, sources: DataFrame, share: float, absent_share: float, stop: list[str]) -> DataFrame:
    """(query_id, covered, status): whether quotations are about what was asked.

    ``unknown code``: the question names a code that none of its sources has; ``no keywords``: it has none but stop words, which passes; ``too few``: less than ``share`` of its keywords stand in the
    quotes; ``absent word``: a keyword is in no source at all and the quotes hold less than ``absent_share``; else ``grounded``. A keyword is looked up in run-together text, so one that a source
    writes apart or as part of a longer word is found. Rows: questions (query_id, question), quotes and sources (query_id, rank, text). A question without quotes or sources is covered by none.
    """
    keys = F.array_except(F.array_distinct(word_tokens(F.coalesce("question", F.lit("")))), F.transform(F.array(*map(F.lit, stop)), F.lower) if stop else F.array().cast("array<string>"))
    unknown = unknown_codes(questions.select("query_id", F.col("question").alias("query")), sources).select("query_id", F.lit(True).alias("unknown")).distinct()
    rows = questions.select("query_id", keys.alias("keys")).join(_run_together(quotes, "quoted"), "query_id", "left").join(_run_together(sources, "corpus"), "query_id", "left").join(unknown, "query_id", "left")
    held = lambda c: F.filter("keys", lambda w: F.contains(F.coalesce(F.col(c), F.lit("")), w))
    rows = rows.withColumn("covered", F.coalesce(F.try_divide(F.size(held("quoted")), F.size("keys")), F.lit(0.0)))
    absent = F.size(held("corpus")) < F.size("keys")
    status = F.when(F.col("unknown"), "unknown code").when(F.size("keys") == 0, "no keywords").when(F.col("covered") < share, "too few").when(absent & (F.col("covered") < absent_share), "absent word").otherwise("grounded")
    return rows.select("query_id", "covered", status.alias("status"))


# A number, the units that make it a claim, and a value with its tolerance.
_PLAIN = r"\d+(?:\.\d+)?"
_UNITS = r"(?:mm/min|mm/s|r/min|mbar|bar|MPa|kPa|Pa|mm|cm|mL|ml|min|phút|giờ|giây|tháng|năm|ngày|oC|°C|℃|kg|%|[hsLm])"
_WITH_UNIT = rf"(?<![\w.]){_PLAIN}\s*{_UNITS}(?![A-Za-zÀ-ỹ])"
_TOLERANCE = rf"{_PLAIN}\s*±\s*{_PLAIN}"


def number_text(text: Column) -> Column:
    """A text with one way to write numbers: marks of LaTeX gone, a decimal point for a comma, groups of thousands joined."""
    t = F.replace(F.replace(F.replace(text, F.lit("\\pm"), F.lit("±")), F.lit("\\%"), F.lit("%")), F.lit("\\times"), F.lit("×"))
    t = F.translate(F.regexp_replace(t, r"\\(?:left|right|text|mathrm|,|;|!)", ""), "${}", "")
    return F.regexp_replace(F.regexp_replace(t, r"(?<=\d),(?=\d)", "."), r"(?<=\d) (?=\d{3}(?!\d))", "")


def canonical(number: Column) -> Column:
    """``01`` as ``1``, ``2.50`` as ``2.5``."""
    return F.regexp_replace(F.regexp_replace(number, r"^0+(?=\d)", ""), r"\.0*$|(\.\d*?)0+$", "$1")


def spans(text: Column, pattern: str) -> Column:
    """All places of a pattern: array of (lo, hi, text), ``hi`` past the end, from 0."""
    found, rest = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<lo:int,hi:int,text:string>>").alias("out"))

    def step(s: Column, p: Column) -> Column:
        lo = s["at"] + p["rest"]
        hi = lo + F.length(p["found"])
        return F.struct(hi.alias("at"), F.concat(s["out"], F.array(F.struct(lo.alias("lo"), hi.alias("hi"), p["found"].alias("text")))).alias("out"))

    return F.aggregate(F.arrays_zip(found.alias("found"), F.slice(rest, F.lit(1), F.size(found)).alias("rest")), start, step)["out"]


def unsupported_numbers(answers: DataFrame, contexts: DataFrame) -> DataFrame:
    """What an answer states in numbers and its context doesn't: (query_id, claims, an array in order of first use, tolerances first).

    ``a ± b`` must stand in the context with both numbers together; a number with a unit must stand there as a number, unless it lies inside one of the answer's ``a ± b``. Numbers are compared in
    canonical form; citation marks, section numbers and codes are no claims. Rows (query_id, answer), (query_id, context); a missing context supports nothing.
    """
    read = read_numbers(answers.select(F.col("answer").alias("text")).unionAll(contexts.select("context")))
    said, given = read.select(F.col("text").alias("answer"), "said"), read.select(F.col("text").alias("context"), "given")
    rows = answers.join(contexts, "query_id", "left").join(said, "answer", "left").join(given, "context", "left")
    return rows.select("query_id", unsupported(F.col("said"), F.col("given")).alias("claims"))


def read_numbers(texts: DataFrame) -> DataFrame:
    """(text, said, given) of the different texts that are not null: what each claims in numbers as an answer, and the numbers and pairs that it supports as a context. A text is read once, however many rows have it."""
    of = lambda pattern, c: F.regexp_extract_all(c, F.lit(f"({pattern})"), F.lit(1))
    pair = lambda c: F.concat_ws("±", F.transform(F.split(c, r"\s*±\s*"), canonical))
    rows = texts.filter("text IS NOT NULL").select("text").distinct().select("text", number_text(F.regexp_replace("text", r"\[\d+\]", "")).alias("body"), number_text(F.col("text")).alias("ctx"))
    rows = rows.select("text", "ctx", spans(F.col("body"), _TOLERANCE).alias("pm"), spans(F.col("body"), _WITH_UNIT).alias("nu"))
    plain = lambda m: F.trim(F.regexp_replace(m["text"], r"\s+", " "))
    alone = F.filter("nu", lambda m: ~F.exists("pm", lambda p: (p["lo"] <= m["lo"]) & (m["lo"] < p["hi"])))
    pairs = F.transform("pm", lambda m: F.struct(plain(m).alias("text"), pair(m["text"]).alias("number")))
    numbers = F.transform(alone, lambda m: F.struct(plain(m).alias("text"), canonical(F.regexp_extract(m["text"], _PLAIN, 0)).alias("number")))
    said = F.struct(pairs.alias("pairs"), numbers.alias("numbers"))
    given = F.struct(F.transform(of(_TOLERANCE, F.col("ctx")), pair).alias("pairs"), F.transform(of(rf"(?<![\d.]){_PLAIN}", F.col("ctx")), canonical).alias("numbers"))
    return sized(rows.select("text", said.alias("said"), given.alias("given")))


def unsupported(said: Column, given: Column) -> Column:
    """The claims of ``said`` that ``given`` (null: nothing) doesn't support, tolerances first; null where nothing was said."""
    bad = lambda kind: F.filter(said[kind], lambda m: ~F.coalesce(F.array_contains(given[kind], m["number"]), F.lit(False)))
    return F.array_distinct(F.transform(F.concat(bad("pairs"), bad("numbers")), lambda m: m["text"]))


def clean_citations(answer: Column, n_sources: Column) -> Column:
    """(text, refs): the answer's own source block cut off, marks of sources that don't exist removed, marks in the order of first use."""
    body = F.trim(F.regexp_replace(answer, r"(?s)\n+\s*(Nguồn|Sources?):.*$", ""))
    refs = F.transform(F.regexp_extract_all(body, F.lit(r"\[(\d+)\]"), 1), lambda r: r.cast("int"))
    bad = F.filter(F.array_distinct(refs), lambda r: (r < 1) | (r > n_sources))
    text = F.aggregate(bad, body, lambda t, r: F.replace(t, F.concat(F.lit("["), r.cast("string"), F.lit("]")), F.lit("")))
    return F.struct(text.alias("text"), F.filter(F.array_distinct(refs), lambda r: (r >= 1) & (r <= n_sources)).alias("refs"))


def ambiguous_devices(queries: DataFrame, catalog: DataFrame) -> DataFrame:
    """(query_id, prefix, n_types): the longest shared name prefix of two words or more that a query holds, where two types or more begin with it and it is at least half of each name; not if the query holds a whole name. Runs of the query have the lengths that the catalogue's prefixes and names have. Rows (query_id, query), (type, name)."""
    w = F.split(F.lower("name"), " ")
    prefixes = F.transform(F.sequence(F.lit(1), F.size("w")), lambda k: F.array_join(F.slice("w", F.lit(1), k), " "))
    named = catalog.withColumn("w", w)
    p = named.select("type", F.size("w").alias("n"), F.explode(prefixes).alias("prefix")).withColumn("k", F.size(F.split("prefix", " "))).filter((F.col("k") >= 2) & (2 * F.col("k") >= F.col("n")))
    shared = p.groupBy("prefix", "k").agg(F.count_distinct("type").alias("n_types")).filter("n_types >= 2")
    sizes = named.agg(F.collect_set(F.when(F.col("name").isNotNull(), F.size("w"))).alias("sizes"))
    each = lambda n: F.sequence(F.least(n, F.greatest(F.lit(2), F.ceil(n / 2).cast("int"))), n)
    lengths = F.broadcast(sizes.select(F.array_distinct(F.flatten(F.transform("sizes", each))).alias("lengths")))  # one row
    fitting = F.filter("lengths", lambda k: k <= F.size("qw"))
    runs = F.array_distinct(F.flatten(F.transform(fitting, lambda k: F.transform(F.sequence(F.lit(1), F.size("qw") - k + 1), lambda i: F.array_join(F.slice("qw", i, k), " ")))))
    q = queries.withColumn("qw", F.split(F.lower("query"), " ")).crossJoin(lengths).select("query_id", F.explode(runs).alias("prefix"))
    best = q.join(shared, "prefix").groupBy("query_id").agg(F.max_by(F.struct("prefix", "n_types"), F.struct("k", "prefix")).alias("x"))
    whole = q.join(named.select(F.lower("name").alias("prefix")).distinct(), "prefix", "left_semi").select("query_id").distinct()
    return best.join(whole, "query_id", "left_anti").select("query_id", "x.prefix", "x.n_types")


def history_pairs(turns: DataFrame, last: int, cut: int) -> DataFrame:
    """The last ``last`` (user, assistant) pairs of each conversation. Turns are paired by place; a pair counts only if its roles are these two; answers are cut at ``cut`` characters."""
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    rows = turns.withColumn("n", n).withColumn("pair", F.floor(F.col("n") / 2))
    two = rows.groupBy("conv_id", "pair").agg(F.max(F.when((F.col("n") % 2 == 0) & (F.col("role") == "user"), F.col("text"))).alias("question"), F.max(F.when((F.col("n") % 2 == 1) & (F.col("role") == "assistant"), F.col("text"))).alias("answer"))
    kept = two.filter("question IS NOT NULL AND answer IS NOT NULL").withColumn("k", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("pair")))).filter(F.col("k") <= last)
    return kept.select("conv_id", "pair", "question", F.substring("answer", 1, cut).alias("answer"))


def new_numbers(old: Column, rewritten: Column) -> Column:
    """Numbers that a rewritten query adds."""
    of = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(_NUMBER), 1))
    return F.size(F.array_except(of(rewritten), of(old)))


def is_empty_answer(answer: Column, most: int = 120) -> Column:
    """A short answer that only says that nothing is stated."""
    return (F.length(F.trim(answer)) <= most) & F.lower(answer).rlike("không (nêu|quy định|đề cập)")


def with_source_block(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """Answers with a final block of the sources they cite, in the order of first use. Rows (query_id, answer), (query_id, pos, title, section_path)."""
    refs = answers.select("query_id", F.posexplode(F.array_distinct(F.transform(F.regexp_extract_all("answer", F.lit(r"\[(\d+)\]"), 1), lambda r: r.cast("int")))).alias("n", "pos"))
    lines = refs.join(sources, ["query_id", "pos"]).select("query_id", "n", F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("] "), F.concat_ws(", ", "title", F.nullif("section_path", F.lit("")))).alias("line"))
    block = lines.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("block"))
    return answers.join(block, "query_id", "left").select("query_id", F.when(F.col("block").isNull(), F.col("answer")).otherwise(F.concat("answer", F.lit("\n\nNguồn:\n"), "block")).alias("answer"))


def select_cards(questions: DataFrame, aliases: DataFrame) -> DataFrame:
    """The one formula card that a question names, or null (clarify) where it names none or several.

    Aliases are found as runs of words, of as many words as aliases have; a run inside a longer run of another card does not count. Rows (query_id, query), (card, alias).
    """
    named = aliases.select("card", word_tokens(F.col("alias")).alias("aw")).filter("size(aw) > 0")
    lengths = F.broadcast(named.agg(F.collect_set(F.size("aw")).alias("lengths")))  # one row
    at = lambda k: F.transform(F.sequence(F.lit(1), F.size("w") - k + 1), lambda i: F.struct(i.alias("lo"), (i + k - 1).alias("hi"), F.array_join(F.slice("w", i, k), " ").alias("run")))
    runs = F.flatten(F.transform(F.filter("lengths", lambda k: k <= F.size("w")), at))
    spans = questions.select("query_id", word_tokens(F.col("query")).alias("w")).crossJoin(lengths).select("query_id", F.explode(runs).alias("s")).select("query_id", "s.*")
    found = spans.join(named.select("card", F.array_join("aw", " ").alias("run")).distinct(), "run")
    outer = found.select("query_id", F.col("card").alias("o_card"), F.col("lo").alias("o_lo"), F.col("hi").alias("o_hi"))
    inside = (F.col("o_lo") <= F.col("lo")) & (F.col("hi") <= F.col("o_hi")) & (F.col("o_hi") - F.col("o_lo") > F.col("hi") - F.col("lo")) & (F.col("o_card") != F.col("card"))
    a, b = found.alias("a"), outer.alias("b")
    kept = a.join(b, (F.col("a.query_id") == F.col("b.query_id")) & inside, "left_anti").groupBy("query_id").agg(F.count_distinct("card").alias("n"), F.min("card").alias("card"))
    return questions.select("query_id").join(kept, "query_id", "left").select("query_id", F.when(F.col("n") == 1, F.col("card")).alias("card"))
