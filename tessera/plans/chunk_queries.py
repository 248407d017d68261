"""Chunking and table queries over documents spelled out as Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.operators import chunking as C
from tessera.operators import lexical
from tessera.plans.registry import query
from tessera.plans.retrieval_queries import CHUNKS
from tessera.session import table


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as Markdown: by their place, lines become headings of two levels, table rows, blank lines or stay."""
    mark = F.transform(
        F.split("text", "\n"),
        lambda x, i: F.when(i % 12 == 0, F.concat(F.lit("# "), x)).when(i % 12 == 6, F.concat(F.lit("## "), x)).when(i % 12 == 3, "").when((i % 12 == 4) | (i % 12 == 5), F.concat(F.lit("| "), x, F.lit(" | b |"))).otherwise(x),
    )
    return table(spark, sf_dir, "documents").select(F.concat_ws("_", "source", F.col("doc_id").cast("string")).alias("file_stem"), F.array_join(mark, "\n").alias("text"))


_MD = """line AS (SELECT source || '_' || doc_id AS file_stem, i, CASE i % 12 WHEN 0 THEN '# ' || x WHEN 6 THEN '## ' || x WHEN 3 THEN '' WHEN 4 THEN '| ' || x || ' | b |' WHEN 5 THEN '| ' || x || ' | b |' ELSE x END AS x
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents)),
numbered AS (SELECT *, sum(CASE WHEN regexp_matches(x, '^#{1,6}\\s+.+$') THEN 1 ELSE 0 END) OVER (PARTITION BY file_stem ORDER BY i) AS section_no FROM line),
sec AS (SELECT file_stem, CAST(section_no AS INTEGER) AS section_no, max(CASE WHEN x LIKE '## %' AND regexp_matches(x, '^#{1,6}\\s+.+$') THEN 2 WHEN regexp_matches(x, '^#{1,6}\\s+.+$') THEN 1 END) AS level,
  max(CASE WHEN regexp_matches(x, '^#{1,6}\\s+.+$') THEN trim(regexp_replace(x, '^#+\\s+', '')) END) AS heading, count(*) - 1 AS n_lines, coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (NOT regexp_matches(x, '^#{1,6}\\s+.+$')), '') AS body FROM numbered WHERE section_no > 0 GROUP BY 1, 2),
pathed AS (SELECT *, CASE WHEN level = 2 AND up IS NOT NULL THEN up || ' > ' || heading ELSE heading END AS section_path FROM (SELECT *, last_value(CASE WHEN level = 1 THEN heading END IGNORE NULLS) OVER (PARTITION BY file_stem ORDER BY section_no) AS up FROM sec))"""


@query(f"WITH {_MD} SELECT file_stem, section_no, level, heading, n_lines, md5(heading || chr(10) || chr(10) || regexp_replace(body, '^\\s+|\\s+$', '', 'g')) AS parent FROM sec")
def c1_sections(spark, sf_dir):
    s = C.sections(markdown(spark, sf_dir))
    return s.select("file_stem", "section_no", "level", "heading", F.size("lines").cast("bigint").alias("n_lines"), F.md5(C.parent_text(F.col("heading"), F.col("lines"))).alias("parent"))


@query(f"WITH {_MD} SELECT file_stem, section_no, section_path FROM pathed")
def c2_section_paths(spark, sf_dir):
    return C.with_paths(C.sections(markdown(spark, sf_dir))).select("file_stem", "section_no", "section_path")


@query("""WITH RECURSIVE t AS (SELECT doc_id, text AS t FROM documents),
w AS (SELECT doc_id, t, 1 AS pos, 0 AS k, '' AS part FROM t UNION ALL
  SELECT doc_id, t, pos + stop, k + 1, trim(substr(piece, 1, stop)) FROM (SELECT *, CASE WHEN s > 0 THEN s ELSE length(piece) END AS stop FROM (SELECT *, CASE WHEN pos + 4000 <= length(t) AND contains(piece, ' ') THEN length(piece) - instr(reverse(piece), ' ') ELSE length(piece) END AS s FROM (SELECT *, substr(t, pos, 4000) AS piece FROM w WHERE pos <= length(t)))))
SELECT doc_id, k AS part_no, length(part) AS n_chars, md5(part) AS digest FROM w WHERE k > 0 AND part <> ''""")
def c3_windows(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(C.windows(F.col("text"))).alias("k", "part"))
    return rows.select("doc_id", (F.col("k") + 1).alias("part_no"), F.length("part").cast("bigint").alias("n_chars"), F.md5("part").alias("digest"))


@query(f"""WITH {_MD}, body AS (SELECT file_stem, section_no, i, x, CASE WHEN trim(x) = '' THEN 'blank' WHEN starts_with(trim(x), '|') THEN 'table' ELSE 'paragraph' END AS kind FROM numbered WHERE section_no > 0 AND NOT regexp_matches(x, '^#{{1,6}}\\s+.+$')),
isl AS (SELECT *, sum(CASE WHEN kind = prev THEN 0 ELSE 1 END) OVER (PARTITION BY file_stem, section_no ORDER BY i) AS island FROM (SELECT *, lag(kind) OVER (PARTITION BY file_stem, section_no ORDER BY i) AS prev FROM body))
SELECT file_stem, CAST(section_no AS INTEGER) AS section_no, row_number() OVER (PARTITION BY file_stem, section_no ORDER BY island) AS block_no, kind, digest FROM (SELECT file_stem, section_no, island, kind, md5(trim(string_agg(x, chr(10) ORDER BY i))) AS digest FROM isl WHERE kind <> 'blank' GROUP BY 1, 2, 3, 4)""")
def c4_blocks(spark, sf_dir):
    rows = C.sections(markdown(spark, sf_dir)).select("file_stem", "section_no", F.posexplode(C.blocks(F.col("lines"))).alias("k", "b"))
    return rows.select("file_stem", "section_no", (F.col("k") + 1).alias("block_no"), "b.kind", F.md5("b.text").alias("digest"))


@query("""WITH r AS (SELECT l_suppkey AS table_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS row_no, l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R'),
t AS (SELECT *, row_no % 5 = 1 AS roman, CASE WHEN row_no % 5 = 1 THEN '| II | nhóm ' || l_linenumber || ' |' ELSE '| ' || l_orderkey || ' | ' || l_linenumber || ' |' END AS text, count(*) OVER (PARTITION BY table_id) AS n FROM r),
g AS (SELECT *, CASE WHEN n > 15 THEN CAST((row_no - 1) // 8 AS INTEGER) ELSE 0 END AS group_no, last_value(CASE WHEN roman THEN text END IGNORE NULLS) OVER (PARTITION BY table_id ORDER BY row_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above FROM t)
SELECT table_id, group_no, md5('| a | b |' || chr(10) || '|---|---|' || chr(10) || CASE WHEN group_no > 0 AND NOT arg_min(roman, row_no) AND arg_min(above, row_no) IS NOT NULL THEN arg_min(above, row_no) || chr(10) ELSE '' END || string_agg(text, chr(10) ORDER BY row_no)) AS digest FROM g GROUP BY 1, 2""")
def c5_table_groups(spark, sf_dir):
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").withColumn("row_no", F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")))
    text = F.when(F.col("row_no") % 5 == 1, F.concat(F.lit("| II | nhóm "), F.col("l_linenumber").cast("string"), F.lit(" |"))).otherwise(F.concat(F.lit("| "), F.col("l_orderkey").cast("string"), F.lit(" | "), F.col("l_linenumber").cast("string"), F.lit(" |")))
    rows = rows.select(F.col("l_suppkey").alias("table_id"), "row_no", text.alias("text"), F.lit("| a | b |\n|---|---|").alias("header"))
    return C.table_groups(rows).select("table_id", "group_no", F.md5("text").alias("digest"))


@query(f"WITH {CHUNKS} SELECT chunk_id AS place, substr(sha256(concat(file_stem, chr(0), section_path, chr(0), text)), 1, 16) AS id FROM chunks")
def c6_chunk_ids(spark, sf_dir):
    from tessera.plans.retrieval_queries import chunks

    return chunks(spark, sf_dir).select(F.col("chunk_id").alias("place"), C.chunk_id(F.col("file_stem"), F.col("section_path"), F.col("text")).alias("id"))


@query(f"WITH {CHUNKS} SELECT md5(text) AS id, min(chunk_id) AS first_place FROM chunks GROUP BY 1")
def c7_idempotent_points(spark, sf_dir):
    from tessera.plans.retrieval_queries import chunks

    return chunks(spark, sf_dir).groupBy(F.md5("text").alias("id")).agg(F.min("chunk_id").alias("first_place"))


@query(f"""WITH {_MD}, body AS (SELECT file_stem, section_no, i, x, CASE WHEN trim(x) = '' THEN 'blank' WHEN starts_with(trim(x), '|') THEN 'table' ELSE 'paragraph' END AS kind FROM numbered WHERE section_no > 0 AND NOT regexp_matches(x, '^#{{1,6}}\\s+.+$')),
isl AS (SELECT *, CASE WHEN kind = lag(kind) OVER (PARTITION BY file_stem, section_no ORDER BY i) THEN 0 ELSE 1 END AS starts FROM body)
SELECT file_stem, coalesce(sum(starts) FILTER (kind = 'paragraph'), 0)::BIGINT AS paragraph, coalesce(sum(starts) FILTER (kind = 'table'), 0)::BIGINT AS "table", (SELECT count(*) FROM sec WHERE sec.file_stem = isl.file_stem) AS parents FROM isl WHERE kind <> 'blank' GROUP BY 1""")
def c8_chunk_counts(spark, sf_dir):
    secs = C.sections(markdown(spark, sf_dir))
    kids = secs.select("file_stem", F.explode(C.blocks(F.col("lines"))).alias("b")).groupBy("file_stem").pivot("b.kind", ["paragraph", "table"]).count().na.fill(0)
    return kids.join(secs.groupBy("file_stem").agg(F.count("*").alias("parents")), "file_stem")


@query("""SELECT doc_id, k AS window_no, md5(source || ': ' || substr(text, CAST(k * 1200 + 1 AS BIGINT), 1800)) AS digest FROM documents, range(0, 1000) r(k) WHERE k * 1200 <= greatest(length(text) - 1, 0)""")
def c9_overlapping_windows(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", F.posexplode(C.overlapping(F.col("text"))).alias("window_no", "w"))
    return rows.select("doc_id", F.col("window_no").cast("bigint").alias("window_no"), F.md5(F.concat("source", F.lit(": "), "w")).alias("digest"))


@query("""SELECT p_partkey, p_partkey % 4 IN (1, 2) AS noise FROM part""")
def c10_noise_paths(spark, sf_dir):
    k = F.col("p_partkey") % 4
    path = F.when(k == 0, F.concat(F.lit("Phụ lục A > "), "p_name")).when(k == 1, F.concat(F.lit("Phụ lục "), F.col("p_size").cast("string"))).when(k == 2, F.concat(F.lit("Mẫu biên bản "), "p_name")).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", lexical.is_noise(path).alias("noise"))


@query("""WITH p AS (SELECT o_custkey AS doc, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS page, o_orderstatus AS flag FROM orders),
r AS (SELECT *, page - row_number() OVER (PARTITION BY doc, flag ORDER BY page) AS run FROM p),
w AS (SELECT doc, flag, min(page) AS lo, max(page) AS hi FROM r GROUP BY doc, flag, run)
SELECT doc, flag, lo + 2 * k AS first, least(lo + 2 * k + 1, hi) AS last FROM w, range(0, 1000) t(k) WHERE lo + 2 * k <= hi""")
def c13_page_runs(spark, sf_dir):
    from pyspark.sql import Window

    pages = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).cast("bigint").alias("page"), F.col("o_orderstatus").alias("flag"))
    return C.runs_of(pages, 2)


@query("""WITH s AS (SELECT p_partkey AS section_id, p_name, p_type FROM part)
SELECT section_id, p_type AS anchor, CASE WHEN section_id % 3 = 0 THEN NULL ELSE '1.' || (section_id % 3) || ' ' || p_name END AS heading FROM s""")
def c11_nearest_heading(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    k = F.col("p_partkey") % 3
    head = lambda i: F.concat(F.lit(f"1.{i} "), F.col("p_name"), F.lit("\n"))
    text = F.concat(F.when(k >= 1, head(1)).otherwise(""), F.lit("x\n"), F.when(k == 2, head(2)).otherwise(""), F.lit("y "), F.col("p_type"), F.lit("\n2.1 after\n"))
    return C.nearest_heading(part.select(F.col("p_partkey").alias("section_id"), text.alias("text")), part.select(F.col("p_partkey").alias("section_id"), F.col("p_type").alias("anchor")))
