"""Queries of files, sweeps and decisions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.operators import fusion, metrics, selection as S
from tessera.operators.kept import Kept
from tessera.plans.registry import query
from tessera.plans.retrieval_queries import BM25, CHUNKS, FUSED, GOLD, SWEEP, TOKENS, _sweep, bm25, chunks, expected, nearest, questions, with_place
from tessera.session import settle, shared_dir, table
from tessera.sources import io


def _folder(spark, kind):
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


_SUMMARY = f"""WITH {SWEEP}, every AS (SELECT c.alpha, c.k, i.item_id AS query_id, b.rank FROM configs c CROSS JOIN benchmark i LEFT JOIN best b ON b.alpha = c.alpha AND b.k = c.k AND b.query_id = i.item_id),
hits AS (SELECT *, CASE WHEN rank <= 5 THEN 1.0::DOUBLE ELSE 0 END AS hit FROM every),
s AS (SELECT alpha, k, count(*) AS n, avg(hit) AS recall, avg(coalesce(1.0::DOUBLE / rank, 0)) AS mrr, avg(hit) FILTER (query_id % 2 = 0) AS tune, avg(hit) FILTER (query_id % 2 = 1) AS holdout, coalesce(list(query_id) FILTER (hit = 0), []) AS misses FROM hits GROUP BY 1, 2)"""


def summary(spark, sf_dir):
    split = F.when(F.col("query_id") % 2 == 0, "tune").otherwise("holdout")
    return S.summary(_sweep(spark, sf_dir).withColumn("split", split))


@query(f"{_SUMMARY} SELECT round(alpha, 1) AS alpha, k, round(recall, 9) AS recall, round(mrr, 9) AS mrr FROM s ORDER BY round(recall, 9) DESC, round(mrr, 9) DESC, round(abs(alpha - 0.5), 6), abs(k - 60), alpha, k LIMIT 10")
def e9_best_settings(spark, sf_dir):
    rows = summary(spark, sf_dir).orderBy(*S.order()).limit(10)
    return rows.select(F.round("alpha", 1).alias("alpha"), "k", F.round("recall", 9).alias("recall"), F.round("mrr", 9).alias("mrr"))


@query(f"""{_SUMMARY},
p AS (SELECT *, abs(alpha - 0.5) < 1e-9 AND k = 60 AS own, coalesce(round((recall - lag(recall) OVER (PARTITION BY k ORDER BY alpha)) * n) <= 1, true) AND coalesce(round((recall - lead(recall) OVER (PARTITION BY k ORDER BY alpha)) * n) <= 1, true)
  AND coalesce(round((recall - lag(recall) OVER (PARTITION BY alpha ORDER BY k)) * n) <= 1, true) AND coalesce(round((recall - lead(recall) OVER (PARTITION BY alpha ORDER BY k)) * n) <= 1, true) AS flat FROM s),
base AS (SELECT recall AS b_recall, mrr AS b_mrr, holdout AS b_holdout, misses AS b_misses FROM p WHERE own),
fit AS (SELECT * FROM p, base WHERE tune >= 0.5 AND holdout >= b_holdout AND (own OR flat) ORDER BY round(recall, 9) DESC, round(mrr, 9) DESC, round(abs(alpha - 0.5), 6), abs(k - 60), alpha, k LIMIT 1),
d AS (SELECT *, len(list_filter(misses, lambda x: NOT list_contains(b_misses, x))) > 0 AS worse, round((recall - b_recall) * n) >= 2 OR (recall = b_recall AND mrr - b_mrr >= 0.02 - 1e-9) AS more FROM fit),
o AS (SELECT CASE WHEN NOT own AND NOT worse AND more THEN alpha ELSE 0.5 END AS alpha, CASE WHEN NOT own AND NOT worse AND more THEN k ELSE 60 END AS k, NOT own AND NOT worse AND more AS change,
  CASE WHEN own THEN 'the present setting is first' WHEN worse THEN 'misses a question that the present setting has' WHEN more THEN 'better' ELSE 'not better by enough' END AS reason, 0 AS o FROM d UNION ALL SELECT 0.5, 60, false, 'no setting passes the gates', 1)
SELECT round(alpha, 1) AS alpha, k, change, reason FROM o ORDER BY o LIMIT 1""")
def e10_decision(spark, sf_dir):
    return S.decide(summary(spark, sf_dir), 0.5).withColumn("alpha", F.round("alpha", 1))


@query(f"""WITH {BM25}, {GOLD}, first_gold AS (SELECT query_id, min(file_stem) AS file_stem FROM gold GROUP BY 1), r AS (SELECT g.query_id, g.file_stem, min(b.rank) AS rank FROM first_gold g LEFT JOIN (SELECT bm.query_id, file_stem, rank FROM bm JOIN chunks USING (chunk_id)) b ON b.query_id = g.query_id AND b.file_stem = g.file_stem GROUP BY 1, 2)
SELECT file_stem, count(*) AS n, round(avg(CASE WHEN rank <= 5 THEN 1.0::DOUBLE ELSE 0 END), 9) AS recall_5 FROM r GROUP BY 1""")
def e4_recall_by_file(spark, sf_dir):
    first = expected(spark, sf_dir).groupBy("query_id").agg(F.min("file_stem").alias("file_stem")).withColumn("section_path", F.lit("p"))
    ranks = metrics.first_ranks(with_place(spark, sf_dir, bm25(spark, sf_dir)), first, first.select("query_id"))
    return ranks.join(first, "query_id").groupBy("file_stem").agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("rank") <= 5, 1.0).otherwise(0.0)), 9).alias("recall_5"))


@query(f"""WITH {FUSED}, {GOLD}, u AS (SELECT 'dense' AS mode, query_id, chunk_id, rank FROM dn UNION ALL SELECT 'hybrid', query_id, chunk_id, rank FROM fused),
m AS (SELECT mode, u.query_id, min(rank) AS rank FROM u JOIN chunks USING (chunk_id) JOIN gold g ON g.query_id = u.query_id AND g.file_stem = chunks.file_stem GROUP BY 1, 2),
e AS (SELECT v.mode, item_id, rank FROM (VALUES ('dense'), ('hybrid')) v(mode) CROSS JOIN benchmark LEFT JOIN m ON m.mode = v.mode AND query_id = item_id),
p AS (SELECT e.mode, n AS k, avg(CASE WHEN rank <= n THEN 1.0::DOUBLE ELSE 0 END) AS r FROM e, (VALUES (1), (5), (10)) t(n) GROUP BY 1, 2)
SELECT k, round(max(r) FILTER (mode = 'dense'), 9) AS dense, round(max(r) FILTER (mode = 'hybrid'), 9) AS hybrid, round(max(r) FILTER (mode = 'hybrid') - max(r) FILTER (mode = 'dense'), 9) AS delta, max(r) FILTER (mode = 'hybrid') >= 0.85 AS goal FROM p GROUP BY 1""")
def e5_e6_modes_and_goal(spark, sf_dir):
    d = nearest(spark, sf_dir)
    both = d.select(F.lit("dense").alias("mode"), "query_id", "chunk_id", "rank").unionAll(fusion.rrf(d, bm25(spark, sf_dir)).select(F.lit("hybrid"), "query_id", "chunk_id", "rank"))
    ranks = metrics.first_ranks(with_place(spark, sf_dir, both), expected(spark, sf_dir), questions(spark, sf_dir), ("mode",))
    at = ranks.select("mode", "rank", F.explode(F.array(F.lit(1), F.lit(5), F.lit(10))).alias("k"))
    p = at.groupBy("k").pivot("mode", ["dense", "hybrid"]).agg(F.avg(F.when(F.col("rank") <= F.col("k"), 1.0).otherwise(0.0)))
    return p.select("k", F.round("dense", 9).alias("dense"), F.round("hybrid", 9).alias("hybrid"), F.round(F.col("hybrid") - F.col("dense"), 9).alias("delta"), (F.col("hybrid") >= 0.85).alias("goal"))


@query("SELECT CAST(item_id AS VARCHAR) AS id, text AS question, 'c' || (item_id % 3) AS category, 1 + item_id % 2 AS n_expected FROM benchmark WHERE item_id % 3 = 1")
def s2_question_set(spark, sf_dir):
    path = _folder(spark, "items")
    one = lambda p: F.struct(F.lit("f").alias("file_stem"), F.lit(p).alias("section_path"))
    k = F.col("item_id")
    rows = table(spark, sf_dir, "benchmark").select(k.cast("string").alias("id"), F.col("text").alias("question"), F.concat(F.lit("c"), (k % 3).cast("string")).alias("category"), F.when(k % 2 == 1, F.array(one("a"), one("b"))).otherwise(F.array(one("a"))).alias("expected"))
    rows.write.json(path)
    return io.read_items(spark, path, "c1").select("id", "question", "category", F.size("expected").cast("bigint").alias("n_expected"))


@query("SELECT s_suppkey AS file, l_partkey AS fid, l_quantity > 25 AS ok FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey")
def s3_nested_report(spark, sf_dir):
    """A report per supplier, each a JSON file with the list of its lines."""
    path = _folder(spark, "report")
    d = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.collect_list(F.struct(F.col("l_partkey").cast("string").alias("fid"), (F.col("l_quantity") > 25).alias("ok"))).alias("formula_detail"))
    one = F.struct(F.col("s_suppkey").cast("string").alias("file"), F.coalesce("formula_detail", F.array()).alias("formula_detail"))
    reports = table(spark, sf_dir, "supplier").join(d, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    io.write_files(reports.select(F.concat(F.col("s_suppkey").cast("string"), F.lit(".json")).alias("name"), F.to_json(F.struct(F.array(one).alias("files"))).alias("text")), path)
    rows = io.read_report(spark, path)
    return rows.select(F.col("file").cast("bigint").alias("file"), F.col("fid").cast("bigint").alias("fid"), "ok")


@query("SELECT 'QTKD ' || item_id || ' +%' AS file_stem, text FROM benchmark WHERE item_id % 4 <> 3")
def s1_markdown_folder(spark, sf_dir):
    """Passages as a folder of Markdown files among others, read again."""
    path = _folder(spark, "markdown")
    k = F.col("item_id")
    name = F.concat(F.lit("QTKD "), k.cast("string"), F.lit(" +%"), F.when(k % 4 == 3, ".txt").otherwise(".md"))
    io.write_files(table(spark, sf_dir, "benchmark").select(name.alias("name"), "text"), path)
    return io.read_markdown(spark, path)


@query("""SELECT CASE item_id % 3 WHEN 0 THEN 'QTKD ' || item_id || '.docx' WHEN 1 THEN 'phieu do ' || item_id || '.PDF' ELSE 'khac ' || item_id || '.md' END AS name, CASE item_id % 3 WHEN 0 THEN '.docx' WHEN 1 THEN '.pdf' ELSE '.md' END AS ext,
  strlen(text) AS size_bytes, sha256(text) AS sha256, CASE item_id % 4 WHEN 0 THEN 'insert' WHEN 1 THEN 'replace' WHEN 2 THEN 'update type' ELSE 'skip' END AS action FROM benchmark""")
def s4_import_plan(spark, sf_dir):
    """A file for each passage; the ledger lacks every fourth, has other bytes or another type for others."""
    path = _folder(spark, "import")
    k = F.col("item_id")
    name = F.when(k % 3 == 0, F.concat(F.lit("QTKD "), k.cast("string"), F.lit(".docx"))).when(k % 3 == 1, F.concat(F.lit("phieu do "), k.cast("string"), F.lit(".PDF"))).otherwise(F.concat(F.lit("khac "), k.cast("string"), F.lit(".md")))
    kind = F.when(k % 3 == 0, "qtkd").when(k % 3 == 1, "phieu_do").otherwise("khac")
    files = table(spark, sf_dir, "benchmark").withColumn("name", name)
    ledger = files.filter(k % 4 > 0).select("name", F.when(k % 4 == 1, "other").otherwise(F.sha2("text", 256)).alias("sha256"), F.when(k % 4 == 2, "danh_muc").otherwise(kind).alias("doc_type"))
    io.write_files(files.select("name", "text"), path)
    return io.import_plan(spark, path, ledger)


@query(f"{_SUMMARY} SELECT round(alpha, 1) AS alpha, k, round(recall, 6) AS recall FROM s")
def s5_sweep_files(spark, sf_dir):
    """The sweep's files, and of these the grid, read again."""
    path = _folder(spark, "sweep")
    rows = settle(summary(spark, sf_dir).withColumns({"alpha": F.round("alpha", 1), "recall": F.round("recall", 6)}))
    io.write_sweep(rows, path, "recall")
    report = spark.createDataFrame([("results.md", io.sweep_report(rows, S.decide(rows)))], "name string, text string")
    io.write_files(report, path)
    grid = spark.read.option("header", True).csv(f"{path}/grid")
    ks = [c for c in grid.columns if c != "alpha"]
    return grid.unpivot("alpha", ks, "k", "recall").select(F.col("alpha").cast("double").alias("alpha"), F.col("k").cast("int").alias("k"), F.col("recall").cast("double").alias("recall"))


@query("SELECT o_orderstatus AS model, count(*) AS n, round(sum(o_totalprice), 4) AS total FROM orders GROUP BY 1")
def s6_records_by_model(spark, sf_dir):
    path = _folder(spark, "records")
    io.write_records(table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("model"), "o_orderkey", "o_totalprice"), path)
    back = spark.read.schema("o_orderkey long, o_totalprice double, model string").json(path)
    return back.groupBy("model").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 4).alias("total"))


@query(f"""WITH {CHUNKS}, kept AS (SELECT file_stem, chunk_id, CASE WHEN doc_id % 3 = 0 THEN 'second ' || text ELSE text END AS text FROM chunks WHERE doc_id % 3 = 1 OR (doc_id % 3 = 0 AND line < 3))
SELECT file_stem, count(*) AS n, CAST(sum(len({TOKENS.format("text")})) AS BIGINT) AS tokens, CAST(sum(len(list_distinct({TOKENS.format("text")}))) AS BIGINT) AS postings FROM kept GROUP BY 1""")
def s7_replace_by_file(spark, sf_dir):
    """An index of all chunks in which every third file is then replaced by three chunks of new text, and every third is taken out."""
    now = chunks(spark, sf_dir).withColumn("indexed", F.col("text"))
    index = Kept(spark, _folder(spark, "kept"))
    index.replace(now, 0)
    new = now.filter("doc_id % 3 = 0 AND line < 3").withColumn("indexed", F.concat(F.lit("second "), "text"))
    index.replace(new, 1, gone=now.filter("doc_id % 3 = 2").select("file_stem"))
    size = index.chunks.groupBy("file_stem").agg(F.count("*").alias("n"), F.sum("dl").alias("tokens"))
    own = index.postings.groupBy("file_stem").agg(F.count("*").alias("postings"))
    return size.join(own, "file_stem", "left").select("file_stem", "n", "tokens", F.coalesce("postings", F.lit(0)).cast("bigint").alias("postings"))


@query(f"WITH {CHUNKS} SELECT count(DISTINCT file_stem) FILTER (doc_id % 4 = 1) AS files_indexed, count(DISTINCT file_stem) FILTER (doc_id % 4 = 0) AS files_skipped, count(*) FILTER (doc_id % 4 = 1) AS chunks_added, count(*) FILTER (doc_id % 4 <> 2 AND doc_id % 4 <> 3) AS total FROM chunks")
def s8_index_missing(spark, sf_dir):
    now = chunks(spark, sf_dir).select("file_stem", "chunk_id", "doc_id")
    return io.index_missing(now.filter("doc_id % 4 = 0"), now.filter("doc_id % 4 IN (0, 1)"))[1]


@query(f"WITH {CHUNKS} SELECT chunk_id FROM chunks WHERE line > 0 AND doc_id % 5 = 2")
def s9_scan_children(spark, sf_dir):
    now = chunks(spark, sf_dir).withColumn("is_parent", F.col("line") == 0)
    return io.scan_children(now, now.filter("doc_id % 5 = 2").select("file_stem").distinct()).select("chunk_id")


@query("""WITH v AS (SELECT p_partkey AS formula, string_split(lower(p_type), ' ') AS title, string_split(lower(p_name), ' ') AS label FROM part UNION ALL SELECT p_partkey, string_split(lower(p_type), ' '), string_split(lower(p_brand), ' ') FROM part),
q AS (SELECT p_partkey AS query_id, list_distinct(string_split(lower(p_name || ' ' || p_type || ' ' || p_brand), ' ')) AS words FROM part WHERE p_partkey % 50 = 0),
s AS (SELECT query_id, formula, avg(len(list_intersect(label, words)) / len(label)) AS coverage, max(len(list_intersect(title, words)) / len(title)) AS title, count(*) AS n FROM q, v GROUP BY 1, 2)
SELECT query_id, formula, round(coverage, 9) AS coverage, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(coverage, 9) DESC, round(title, 9) DESC, n DESC, formula) AS place FROM s WHERE coverage >= 0.6) WHERE place <= 3""")
def r24_rank_formulas(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    words = lambda c: F.array_distinct(F.split(F.lower(c), " "))
    v = part.select(F.col("p_partkey").alias("formula"), words("p_type").alias("title"), F.explode(F.array(words("p_name"), words("p_brand"))).alias("label"))
    q = part.filter("p_partkey % 50 = 0").select(F.col("p_partkey").alias("query_id"), words(F.concat_ws(" ", "p_name", "p_type", "p_brand")).alias("words"))
    return S.rank_formulas(q, v, 0.6, 3).select("query_id", "formula", F.round("coverage", 9).alias("coverage"), "place")


@query("""SELECT o_orderkey AS question_id, 2 AS n, CASE o_orderkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0.0 END::DOUBLE AS lenient, CASE o_orderkey % 3 WHEN 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS strict FROM orders""")
def e12_citation_correctness(spark, sf_dir):
    k = F.col("question_id")
    q = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("question_id"))
    row = lambda **x: F.struct(*(F.lit(v).alias(n) for n, v in x.items()))
    facts = q.select("question_id", F.inline(F.array(row(fact_no=1, text="0,15 bar", file_stem="f", section_path="4"), row(fact_no=2, text="áp suất", file_stem="f", section_path="5"))))
    ps = F.when(k % 3 == 0, F.array(row(pos=1, file_stem="f", section_path="4 > 1", text="sai số 0.15bar"), row(pos=2, file_stem="f", section_path="5", text="Áp suất"))).when(k % 3 == 1, F.array(row(pos=1, file_stem="g", section_path="4", text="0,15 bar"), row(pos=2, file_stem="f", section_path="5", text="áp suất"))).otherwise(F.array(row(pos=1, file_stem="f", section_path="9", text="0,15 bar áp suất")))
    cited = q.select("question_id", F.lit(1).alias("pos"))
    return S.citation_correctness(facts, q.select("question_id", F.inline(ps)), cited)
