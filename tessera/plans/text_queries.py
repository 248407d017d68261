"""Queries of the text functions, over document lines and over measurements spelled out from line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.functions import text as T
from tessera.plans.registry import query
from tessera.session import table

#: A measurement for each line item: a value with comma, a unit and, by line number, a tolerance or a range.
_MEASURED = """measured AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) AS q,
    CASE l_linenumber % 3
      WHEN 0 THEN '(' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || ' ÷ ' || CAST(CAST(l_quantity AS BIGINT) + 10 AS VARCHAR) || ') bar'
      WHEN 1 THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || ',5 mm ± 0,' || CAST(l_linenumber AS VARCHAR) || ' mm'
      ELSE '1 ' || CAST(100 + CAST(l_quantity AS BIGINT) AS VARCHAR) || ' kPa' END AS txt
  FROM lineitem)"""


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity").cast("bigint")
    s = q.cast("string")
    n = F.col("l_linenumber").cast("string")
    txt = (
        F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("("), s, F.lit(" ÷ "), (q + 10).cast("string"), F.lit(") bar")))
        .when(F.col("l_linenumber") % 3 == 1, F.concat(s, F.lit(",5 mm ± 0,"), n, F.lit(" mm")))
        .otherwise(F.concat(F.lit("1 "), (q + 100).cast("string"), F.lit(" kPa")))
    )
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", q.alias("q"), txt.alias("txt"))


@query("SELECT doc_id, md5(trim(regexp_replace(strip_accents(replace(lower(text), 'ß', 'ss')), '\\s+', ' ', 'g'))) AS folded FROM documents")
def n1_fold(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.fold(F.col("text"))).alias("folded"))


@query("""SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS digest FROM (
  SELECT doc_id, list_filter(string_split_regex(lower(text), '[\\s,;!()\\[\\]{}<>"''\\\\|]+'), lambda x: x <> '') AS t FROM documents)""")
def n2_lexical_tokens(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("digest"))


@query("SELECT doc_id, len(t) AS n_words, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS t FROM documents)")
def n3_word_tokens(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("doc_id", T.word_tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("bigint").alias("n_words"), F.md5(F.array_join("t", " ")).alias("digest"))


@query("SELECT doc_id, md5(concat_ws(' ', nullif(source, ''), nullif(CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END, ''), nullif(text, ''))) AS digest FROM documents")
def n4_index_text(spark, sf_dir):
    path = F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.index_text(F.col("source"), path, F.col("text"))).alias("digest"))


_UNIT_SQL = "|".join(T.UNITS)


@query(f"""WITH {_MEASURED}, glued AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(txt), '(\\d),(\\d)', '\\1.\\2', 'g'), '(\\d)\\s+(\\d\\d\\d)\\b', '\\1\\2', 'g'), '(\\d)\\s+({_UNIT_SQL})', '\\1\\2', 'g'), '\\s+', ' ', 'g')) AS norm FROM measured)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, norm, regexp_replace(regexp_replace(norm, '\\s+', '', 'g'), '^[±+-]+', '') AS hard FROM glued""")
def n5_measurement_text(spark, sf_dir):
    return measured(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", T.measurement_text(F.col("txt")).alias("norm"), T.measurement_number(F.col("txt")).alias("hard"))


@query("""SELECT p_partkey, replace(replace(regexp_replace(formula, '\\s+', '', 'g'), '{', ''), '}', '') AS latex FROM (
  SELECT p_partkey, '\\Delta P_{' || p_size || '} = \\frac{' || p_type || '}{' || p_name || '}' AS formula FROM part)""")
def n6_latex_text(spark, sf_dir):
    f = F.concat(F.lit("$ \\Delta P_{"), F.col("p_size").cast("string"), F.lit("} = \\frac{"), F.col("p_type"), F.lit("}{"), F.col("p_name"), F.lit("} $"))
    return table(spark, sf_dir, "part").select("p_partkey", T.latex_text(f).alias("latex"))


@query("""SELECT o_orderkey, CASE o_orderkey % 5
    WHEN 0 THEN CAST(a || '.' || b AS DOUBLE) WHEN 1 THEN CAST(a AS DOUBLE) * 1000 + CAST(c AS DOUBLE)
    WHEN 2 THEN -CAST('0.' || c AS DOUBLE) WHEN 3 THEN NULL ELSE CAST('0.' || c AS DOUBLE) END AS value
  FROM (SELECT o_orderkey, CAST(1 + o_orderkey % 999 AS VARCHAR) AS a, CAST(o_orderkey % 100 AS VARCHAR) AS b, lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') AS c FROM orders)""")
def n7_parse_number(spark, sf_dir):
    k = F.col("o_orderkey")
    a, b, c = (1 + k % 999).cast("string"), (k % 100).cast("string"), F.lpad((k % 1000).cast("string"), 3, "0")
    spelled = (
        F.when(k % 5 == 0, F.concat_ws(",", a, b))
        .when(k % 5 == 1, F.concat_ws(" ", a, c))
        .when(k % 5 == 2, F.concat(F.lit("− 0,"), c))
        .when(k % 5 == 3, F.concat_ws(",", a, b, c))
        .otherwise(F.concat(F.lit("0."), c))
    )
    spelled = F.regexp_replace(spelled, "− ", "−")
    return table(spark, sf_dir, "orders").select("o_orderkey", T.parse_number(spelled).alias("value"))


@query(f"""WITH {_MEASURED} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE l_linenumber % 3 WHEN 0 THEN 'range' WHEN 1 THEN '±' ELSE '=' END AS rel_op,
  CASE l_linenumber % 3 WHEN 0 THEN CAST(q AS DOUBLE) WHEN 1 THEN q + 0.5 ELSE CAST(1100 + q AS DOUBLE) END AS value_min,
  CASE l_linenumber % 3 WHEN 0 THEN CAST(q + 10 AS DOUBLE) WHEN 1 THEN q + 0.5 ELSE CAST(1100 + q AS DOUBLE) END AS value_max,
  CASE l_linenumber % 3 WHEN 1 THEN CAST('0.' || l_linenumber AS DOUBLE) END AS tolerance,
  CASE l_linenumber % 3 WHEN 0 THEN 'bar' WHEN 1 THEN 'mm' ELSE 'kPa' END AS unit,
  CASE l_linenumber % 3 WHEN 2 THEN 1 ELSE 2 END AS n_numbers FROM measured""")
def n8_parse_quantity(spark, sf_dir):
    rows = measured(spark, sf_dir).withColumn("x", T.parse_quantity(F.col("txt")))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "x.rel_op", "x.value_min", "x.value_max", "x.tolerance", "x.unit", F.size(T.numbers_in(F.col("txt"))).alias("n_numbers"))


@query("SELECT o_orderkey, 'sai số của ' || o_orderpriority AS query FROM orders")
def n9_without_codes(spark, sf_dir):
    coded = F.concat(F.lit("QTKĐ 1."), F.lpad((F.col("o_orderkey") % 1000).cast("string"), 3, "0"), F.lit(" sai số của "), F.col("o_orderpriority"))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.without_codes(coded).alias("query"))


@query("SELECT p_partkey, 'x ' || '$' || p_name || '$' || ' y ' || '$$' || p_type || '$$' AS fixed FROM part")
def n10_math_marks(spark, sf_dir):
    raw = F.concat(F.lit("x \\( "), F.col("p_name"), F.lit(" \\) y \\["), F.col("p_type"), F.lit("\\]"))
    return table(spark, sf_dir, "part").select("p_partkey", T.math_marks(raw).alias("fixed"))


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN 'đo ' || c_name ELSE c_name || ' a b' END AS text, c_custkey % 3 = 2 AS needs_regen, c_custkey % 3 > 0 AS fixed, false AS empty FROM customer""")
def n12_foreign_script(spark, sf_dir):
    k = F.col("c_custkey") % 3
    raw = F.when(k == 0, F.col("c_name")).when(k == 1, F.concat(F.lit("đo "), F.col("c_name"), F.lit(" 测量结果显示压力合格"))).otherwise(F.concat(F.col("c_name"), F.lit(" a 测 b")))
    return table(spark, sf_dir, "customer").select("c_custkey", T.strip_cjk(raw).alias("x")).select("c_custkey", "x.text", "x.needs_regen", "x.fixed", "x.empty")


@query("""WITH lex AS (SELECT p_partkey AS ord, strip_accents(lower(p_name)) AS trig, p_type AS extra FROM part UNION ALL SELECT 1000000000 + p_partkey, lower(p_brand || ' ' || string_split(p_type, ' ')[1]), 'size ' || p_size FROM part),
q AS (SELECT p_partkey, p_name || ' for ' || p_brand || ' ' || p_type AS query FROM part)
SELECT p_partkey, query || coalesce(' ' || string_agg(extra, ' ' ORDER BY ord), '') AS expanded FROM q LEFT JOIN lex ON contains(strip_accents(lower(query)), trig) GROUP BY p_partkey, query""")
def n13_expand_query(spark, sf_dir):
    from tessera.operators.scope import expand_queries

    part = table(spark, sf_dir, "part")
    queries = part.select(F.col("p_partkey").alias("query_id"), F.concat(F.col("p_name"), F.lit(" for "), F.col("p_brand"), F.lit(" "), F.col("p_type")).alias("query"))
    own = part.select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("trigger"), F.col("p_type").alias("extra"))
    kind = part.select((1000000000 + F.col("p_partkey")).alias("ord"), F.concat_ws(" ", "p_brand", F.substring_index("p_type", " ", 1)).alias("trigger"), F.concat(F.lit("size "), F.col("p_size").cast("string")).alias("extra"))
    return expand_queries(queries, own.unionAll(kind)).select(F.col("query_id").alias("p_partkey"), "expanded")


@query("""SELECT conv_id, turn, CASE WHEN turn % 2 = 1 THEN 'Không tìm thấy thông tin' ELSE text END AS text FROM conversations""")
def n14_refusal_cut(spark, sf_dir):
    raw = F.when(F.col("turn") % 2 == 1, F.concat(F.lit("Không tìm thấy thông tin"), F.lit(". "), F.col("text"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.after_refusal_cut(raw).alias("text"))


@query("SELECT p_partkey, '$' || 'P_{' || p_size || '}$ và $' || 'm^{2}$' AS text, 2 AS n FROM part")
def n15_sub_sup(spark, sf_dir):
    raw = F.concat(F.lit("P<sub>"), F.col("p_size").cast("string"), F.lit("</sub> và m<sup>2</sup>"))
    return table(spark, sf_dir, "part").select("p_partkey", T.sub_sup(raw).alias("x")).select("p_partkey", "x.text", "x.n")
