"""Queries of contexts, quotes, reports and inventories."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import context as C, reports as R
from tessera.plans.evidence_queries import _HITS, hits
from tessera.plans.registry import query
from tessera.session import table


@query("SELECT o_orderkey, substr(o_orderpriority || ' đo ' || o_orderstatus, 1, 12) AS title FROM orders")
def l16_document_title(spark, sf_dir):
    lines = F.array(F.lit("QTKĐ 1.061"), F.lit(" "), F.concat(F.lit(" "), "o_orderpriority"), F.concat(F.lit("đo "), "o_orderstatus"), F.lit("HÀ NỘI"), F.lit("x"))
    return table(spark, sf_dir, "orders").select("o_orderkey", C.document_title(lines, "^HÀ NỘI", 5, 12).alias("title"))


@query("SELECT p_partkey AS section_id, p_name || chr(10) || chr(10) || p_type || CASE WHEN p_partkey % 2 = 0 THEN chr(10) || chr(10) || '…' || chr(10) || chr(10) || 'cuối ' || p_brand ELSE '' END AS quote FROM part")
def c12_r21_quotes(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    sec = part.select(F.col("p_partkey").alias("section_id"), F.concat_ws("\n\n", F.lit("đầu đề"), "p_name", "p_type", F.lit("khác hẳn"), F.concat(F.lit("cuối "), "p_brand")).alias("text"))
    anchors = part.select(F.col("p_partkey").alias("section_id"), F.explode(F.array_compact(F.array(F.concat_ws("\n\n", "p_name", "p_type"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("cuối "), "p_brand"))))).alias("anchor"))
    return C.quotes(C.anchor_blocks(sec, anchors))


@query(f"""WITH {_HITS}, r AS (SELECT query_id, rank, d.lang AS title, section_path, CASE WHEN rank % 2 = 0 THEN rank END AS page, h.text FROM hits h JOIN chunks c USING (chunk_id) JOIN documents d ON d.doc_id = c.doc_id WHERE rank <= 4)
SELECT query_id, md5(CASE WHEN count(DISTINCT title) >= 2 THEN 'Tài liệu: ' || array_to_string(list_sort(list(DISTINCT title)), '; ') || chr(10) || chr(10) ELSE '' END || string_agg('[' || rank || '] ' || title || ' — ' || section_path || CASE WHEN page IS NOT NULL THEN ', trang ' || page ELSE '' END || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank)) AS context, count(*) AS n_sources FROM r GROUP BY 1""".replace("h.text FROM hits h", "h.text FROM (SELECT query_id, rank, chunk_id, text FROM hits) h"))
def r20_contexts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.concat_ws("_", "source", F.col("doc_id").cast("string")).alias("file_stem"), F.col("lang").alias("title"))
    rows = hits(spark, sf_dir).filter("rank <= 4").join(docs, "file_stem").withColumn("page", F.when(F.col("rank") % 2 == 0, F.col("rank")))
    return C.contexts(rows).select("query_id", F.md5("context").alias("context"), "n_sources")


@query(f"""WITH {_HITS} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS index, hits.file_stem, section_path, substr(trim(regexp_replace(hits.text, '\\s+', ' ', 'g')), 1, 220) AS snippet, round(score, 4) AS score FROM hits JOIN chunks USING (chunk_id)""")
def r25_source_rows(spark, sf_dir):
    return C.source_rows(hits(spark, sf_dir))


@query("SELECT p_partkey AS query_id, CASE WHEN p_partkey % 3 = 0 THEN 'là $P_{a}=' || p_size || '$ và $x=1$' WHEN p_partkey % 3 = 1 THEN 'là $\\left( P_a \\right) = ' || p_size || '$ và $x=1$' ELSE 'là $P_a = ' || p_size || '$ và $x=1$' END AS answer FROM part")
def n11_restored_formulas(spark, sf_dir):
    k = F.col("p_partkey") % 3
    n = F.col("p_size").cast("string")
    part = table(spark, sf_dir, "part")
    a = part.select(F.col("p_partkey").alias("query_id"), F.when(k == 1, F.concat(F.lit("là $(P_{a})="), n, F.lit("$ và $x=1$"))).otherwise(F.concat(F.lit("là $P_a = "), n, F.lit("$ và $x=1$"))).alias("answer"))
    s = F.when(k == 0, F.concat(F.lit("a $P_{a}="), n, F.lit("$ b"))).when(k == 1, F.concat(F.lit("a $\\left( P_a \\right) = "), n, F.lit("$ b"))).otherwise(F.concat(F.lit("a $P_{a}="), n, F.lit("$ b $P _a= "), n, F.lit("$")))
    return C.restored_formulas(a, part.select(F.col("p_partkey").alias("query_id"), s.alias("text")))


@query("""WITH s AS (SELECT l_orderkey AS query_id, l_linenumber AS pos, max(l_extendedprice) AS score, CAST(max(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY 1, 2)
SELECT query_id, arg_max(pos, (CASE WHEN q % 2 = 0 THEN 2 ELSE 1 END, score, -pos)) AS pos FROM s WHERE q % 3 <> 0 GROUP BY 1""")
def m15_pick_source(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("pos")).agg(F.max("l_extendedprice").alias("score"), F.max("l_quantity").cast("bigint").alias("q"))
    text = F.when(F.col("q") % 3 == 0, "khác hẳn").when(F.col("q") % 2 == 0, "giá trị 77").otherwise("nhiệt kế chính xác")
    a = s.select("query_id").distinct().select("query_id", F.lit("nhiệt lượng chính là 77").alias("answer"))
    return C.pick_source(a.withColumn("answer", F.lit("nhiệt trị chính thức của mẫu: chính, nhiệt 77, kiểu xác suất giá")), s.select("query_id", "pos", "score", F.when(F.col("q") % 3 == 0, "khác hẳn").when(F.col("q") % 2 == 0, "giá trị 77").otherwise("nhiệt kế chính xác").alias("text")))


@query("""SELECT p_partkey AS query_id FROM part WHERE p_partkey % 2 = 1""")
def m18_out_of_scope(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    q = part.select(F.col("p_partkey").alias("query_id"), F.concat(F.lit("Cách kiểm định thiết bị "), "p_name", F.when(F.col("p_partkey") % 2 == 1, " vũ trụ").otherwise(""), F.lit("?")).alias("query"))
    return C.out_of_scope(q, part.select(F.col("p_name").alias("name")), ["thiết", "bị"])


@query("""WITH w AS (SELECT DISTINCT p_size AS number, unnest(string_split(lower(p_name || ' m' || p_partkey % 700), ' ')) AS w FROM part), o AS (SELECT w, min(number) AS number FROM w GROUP BY 1 HAVING count(*) = 1)
SELECT DISTINCT o_orderkey AS query_id, number FROM orders JOIN o ON w = 'm' || (o_orderkey % 900)""")
def m3_names_device(spark, sf_dir):
    a = table(spark, sf_dir, "part").select(F.col("p_size").alias("number"), F.concat(F.col("p_name"), F.lit(" m"), (F.col("p_partkey") % 700).cast("string")).alias("alias"))
    q = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"), F.concat(F.lit("Hỏi M"), (F.col("o_orderkey") % 900).cast("string"), F.lit("?")).alias("query"))
    return C.names_device(q, a)


@query("""SELECT l_suppkey AS file, count(*) AS n, sum((l_returnflag = 'A')::INT)::BIGINT AS equations, sum((l_returnflag = 'A' AND l_quantity > 10)::INT)::BIGINT AS converted, sum((l_returnflag = 'R')::INT)::BIGINT AS images, round(sum((l_returnflag = 'A' AND l_quantity > 10)::INT) / nullif(sum((l_returnflag = 'A')::INT), 0), 4) AS rate FROM lineitem WHERE l_suppkey % 5 <> 0 GROUP BY ROLLUP (l_suppkey)""")
def e22_extraction_totals(spark, sf_dir):
    kind = F.when(F.col("l_returnflag") == "A", "equation").when(F.col("l_returnflag") == "R", "image").otherwise("other")
    return R.totals(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("file"), kind.alias("kind"), (F.col("l_quantity") > 10).alias("ok"), (F.col("l_suppkey") % 5 == 0).alias("legacy")))


@query("SELECT l_suppkey AS file, count(*) FILTER (l_suppkey % 4 <> 0 OR l_linenumber < 3) AS n, sum(CASE WHEN l_suppkey % 4 = 0 AND l_linenumber < 3 THEN 2 WHEN l_suppkey % 4 <> 0 THEN 1 END)::BIGINT AS versions FROM lineitem GROUP BY 1")
def e23_merged_report(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("file"), "l_linenumber")
    entry = rows.filter("file % 4 = 0 AND l_linenumber < 3").withColumn("version", F.lit(2))
    return R.merged(rows.withColumn("version", F.lit(1)), entry).groupBy("file").agg(F.count("*").alias("n"), F.sum("version").alias("versions"))


@query("""WITH i AS (SELECT DISTINCT l_suppkey AS file, l_partkey AS fid FROM lineitem) SELECT file, count(*) AS n, count(*) FILTER (fid % 3 = 0) AS covered, round(avg((fid % 3 = 0)::INT), 9) AS share FROM i GROUP BY 1""")
def e26_coverage_audit(spark, sf_dir):
    i = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("file"), F.col("l_partkey").alias("fid")).distinct()
    return R.audit(i, i.filter("fid % 3 = 0")).withColumn("share", F.round("share", 9))


@query("""SELECT p_partkey AS fid, CASE p_partkey % 4 WHEN 0 THEN 'numerator' WHEN 1 THEN 'denominator' WHEN 2 THEN 'right side' END AS flags FROM part WHERE p_partkey % 5 <> 4""".replace("CASE p_partkey", "coalesce(CASE p_partkey").replace("'right side' END", "'right side' END, '')"))
def e27_suspicions(spark, sf_dir):
    k = F.col("p_partkey")
    latex = F.when(k % 5 == 4, "a + b").when(k % 4 == 0, r"x = \frac{ }{b}").when(k % 4 == 1, r"x = \frac{a}{ }").when(k % 4 == 2, "x = ").otherwise(r"x = \frac{a}{b}")
    return R.suspicions(table(spark, sf_dir, "part").select(k.alias("fid"), latex.alias("latex"))).select("fid", F.array_join("flags", ",").alias("flags"))


@query("""WITH r AS (SELECT l_returnflag AS mode, l_linenumber <> 1 AS answerable, l_linenumber <> 2 AS answered, l_quantity + CASE WHEN l_linenumber = 3 THEN 1 ELSE 0 END AS value, l_quantity AS wanted FROM lineitem)
SELECT mode, round(avg(answered::INT), 9) AS selection_rate, sum((answerable AND answered AND abs(value - wanted) <= greatest(0.01, wanted * 0.05))::INT)::BIGINT AS useful, sum((answerable AND NOT answered)::INT)::BIGINT AS false_refusals, sum((answered AND abs(value - wanted) > greatest(0.01, wanted * 0.05))::INT)::BIGINT AS unsafe FROM r GROUP BY 1""")
def e21_numeric_summary(spark, sf_dir):
    n, q = F.col("l_linenumber"), F.col("l_quantity")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("mode"), (n != 1).alias("answerable"), (n != 2).alias("answered"), (q + F.when(n == 3, 1).otherwise(0)).alias("value"), q.alias("wanted"))
    return R.numeric_summary(rows, 0.01, 0.05).withColumn("selection_rate", F.round("selection_rate", 9))


@query("""WITH v AS (SELECT l_orderkey AS formula, CASE WHEN l_linenumber = 7 THEN '7x' ELSE 'k' || l_linenumber END AS key, CASE WHEN l_linenumber = 6 THEN 'foo' ELSE 'bar' END AS unit, l_linenumber = 5 AS bad FROM lineitem)
SELECT o_orderkey AS formula, 'no variables' AS error FROM orders WHERE o_orderkey NOT IN (SELECT formula FROM v) UNION SELECT formula, 'repeated key' FROM v GROUP BY formula, key HAVING count(*) > 1 UNION SELECT formula, 'ill-formed key' FROM v WHERE key = '7x' UNION SELECT formula, 'unknown unit' FROM v WHERE unit = 'foo' UNION SELECT formula, 'bounds' FROM v WHERE bad""")
def u6_definition_errors(spark, sf_dir):
    n = F.col("l_linenumber")
    v = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("formula"), F.when(n == 7, "7x").otherwise(F.concat(F.lit("k"), n.cast("string"))).alias("key"), F.when(n == 6, "foo").otherwise("bar").alias("unit"), F.when(n == 5, 2).otherwise(0).alias("low"), F.lit(1).alias("high"))
    return R.definition_errors(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("formula")), v, ["bar"])


@query("SELECT o_orderkey AS card_id, CASE o_orderkey % 4 WHEN 0 THEN 'clarify' WHEN 1 THEN 'ready' ELSE 'blocked' END AS status FROM orders")
def u9_bound_status(spark, sf_dir):
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders")
    cards = o.select(k.alias("card_id"), F.col("o_orderstatus").alias("file_hash"), F.lit(1).alias("revision"), F.col("o_orderpriority").alias("body"))
    appr = o.filter(k % 4 != 0).select(k.alias("card_id"), F.col("o_orderstatus").alias("file_hash"), F.when(k % 4 == 2, 2).otherwise(1).alias("revision"), F.sha2(F.when(k % 4 == 3, F.lit("else")).otherwise(F.col("o_orderpriority")), 256).alias("card_hash"))
    return R.bound_status(cards, appr)


@query("SELECT 'h' || p_size AS file_hash, p_partkey AS fid, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE '' END AS title, CASE WHEN p_partkey % 5 <> 1 THEN 'trước x = ' || p_name || ' sau' END AS context, concat_ws(',', CASE WHEN p_partkey % 2 = 1 THEN 'not reviewed' END, CASE WHEN p_partkey % 5 = 1 THEN 'not in the text' END) AS warnings FROM part WHERE p_partkey % 3 <> 0")
def u10_drafts(spark, sf_dir):
    k = F.col("p_partkey")
    part = table(spark, sf_dir, "part").withColumn("file_hash", F.concat(F.lit("h"), F.col("p_size").cast("string")))
    latex = F.concat(F.lit("x "), F.when(k % 3 == 0, "+").otherwise("="), F.lit(" "), "p_name")
    d = part.select("file_hash", k.alias("fid"), latex.alias("latex"), F.when(k % 5 == 1, "không").otherwise(F.concat(F.lit("trước "), latex, F.lit(" sau"))).alias("text"))
    return R.drafts(d, part.filter(k % 2 == 0).select("file_hash", k.alias("fid"), F.col("p_type").alias("title")))
