"""Ledger queries: documents as uploads, orders as versions of procedures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.operators import ledger as L
from tessera.plans.registry import query
from tessera.session import table


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("file_id"), F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("bigint").alias("size_bytes"), F.col("n_chars").alias("uploaded_at"))


@query("""WITH u AS (SELECT doc_id AS file_id, sha256(text) AS sha256, n_chars AS uploaded_at FROM documents), led AS (SELECT sha256 FROM u WHERE file_id % 10 = 3 AND file_id % 20 <> 3)
SELECT sha256, arg_min(file_id, (uploaded_at, file_id)) AS file_id FROM u WHERE sha256 NOT IN (SELECT sha256 FROM led) GROUP BY 1""")
def l1_new_uploads(spark, sf_dir):
    u = uploads(spark, sf_dir)
    led = u.filter("file_id % 10 = 3").select("sha256", F.when(F.col("file_id") % 20 == 3, "error").otherwise("done").alias("ingest_status"))
    return L.new_uploads(u, led).select("sha256", "file_id")


@query("""SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN 'extension' WHEN doc_id % 7 = 0 THEN 'empty' WHEN strlen(text) > 5000 THEN 'too large' END AS reason FROM documents""")
def l2_upload_gate(spark, sf_dir):
    k = F.col("doc_id")
    name = F.concat(F.col("source"), F.when(k % 5 == 4, ".exe").when(k % 5 == 3, ".PDF").otherwise(".md"))
    size = F.when(k % 7 == 0, 0).otherwise(F.octet_length("text"))
    return table(spark, sf_dir, "documents").select("doc_id", L.reject_reason(name, size, 5000).alias("reason"))


@query("""WITH s AS (SELECT p_partkey, regexp_replace(p_name || ' (' || p_brand || ')', '[^\\p{L}\\p{N}._-]', '_', 'g') AS stem FROM part)
SELECT p_partkey, CASE WHEN n > 1 THEN stem || '_' || n ELSE stem END AS stem FROM (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY p_partkey) AS n FROM s)""")
def l3_safe_stems(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", L.safe_stem(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))).alias("stem"))
    return L.numbered_stems(rows, "p_partkey")


@query("""SELECT o_orderkey, ['qtkd', 'ho_so_kiem_dinh', 'phieu_do', 'khac', 'danh_muc', 'ho_so_kiem_dinh', 'khac', 'qtkd'][1 + o_orderkey % 8] AS doc_type, CAST([0.98, 0.93, 0.90, 0.20, 0.85, 0.90, 0.20, 0.98][1 + o_orderkey % 8] AS DOUBLE) AS confidence FROM orders""")
def l4_classify(spark, sf_dir):
    names = ["QTKD_1.061_2021.docx", "AP-BBKD-QTKD 3.pdf", "phieu do 4.md", "ghi chú.txt", "Biểu 4 danh mục.docx", "bang QTKD.xlsx", "so lieu.xls", "Danh muc QTKD 9.001.docx"]
    name = F.get(F.array(*map(F.lit, names)), (F.col("o_orderkey") % 8).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", L.classify(name, F.col("o_orderpriority")).alias("x")).select("o_orderkey", "x.doc_type", "x.confidence")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE '1.' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') END AS number, CASE WHEN o_orderkey % 4 <> 0 THEN year(o_orderdate)::INTEGER END AS year,
  CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN o_orderpriority || ' đo' ELSE o_orderpriority || ' đo ' || o_orderstatus END AS title, CASE WHEN o_orderkey % 4 = 0 THEN 'khac' ELSE 'qtkd' END AS promoted FROM orders""")
def l5_l6_procedure_header(spark, sf_dir):
    k = F.col("o_orderkey")
    code = F.concat(F.lit("  QTKĐ 1."), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit(" : "), F.year("o_orderdate").cast("string"))
    text = F.concat_ws("\n", F.lit("BỘ"), F.when(k % 4 == 0, "không mã").otherwise(code), F.lit(""), "o_orderpriority", F.lit(" đo "), F.when(k % 4 == 1, "Hà Nội - 2021").otherwise(F.lit(" ")), F.col("o_orderstatus"))
    h = table(spark, sf_dir, "orders").select("o_orderkey", L.procedure_header(text).alias("h"))
    return h.select("o_orderkey", "h.number", "h.year", "h.title", F.when(F.col("h").isNotNull(), "qtkd").otherwise("khac").alias("promoted"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name || '_V2' END AS edition FROM part")
def l7_edition(spark, sf_dir):
    stem = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("QTKD_1.062_2021_ "), "p_name", F.lit("_V2 _"))).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", L.edition(stem).alias("edition"))


@query("""WITH a AS (SELECT p_partkey AS ord, p_brand || '-' || p_partkey AS device, lower(p_name) AS alias FROM part UNION ALL SELECT p_partkey, p_brand || '-' || p_partkey, lower(string_split(p_name, ' ')[1]) FROM part), first AS (SELECT alias, min(ord) AS ord, arg_min(device, ord) AS device FROM a GROUP BY 1)
SELECT t.p_partkey AS id, arg_max(device, (length(alias), -ord)) AS device FROM part t LEFT JOIN first ON contains(lower(t.p_name || ' ' || t.p_type), alias) GROUP BY 1""")
def l8_infer_device(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    devices = part.select(F.col("p_partkey").alias("ord"), F.concat("p_brand", F.lit("-"), F.col("p_partkey").cast("string")).alias("device"), F.explode(F.array("p_name", F.substring_index("p_name", " ", 1))).alias("alias"))
    return L.infer_device(part.select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("title")), devices)


@query("""WITH a AS (SELECT lower(p_name) AS alias, min(p_partkey) AS ord, arg_min(p_brand || '-' || p_partkey, p_partkey) AS device FROM part WHERE p_partkey % 2 = 0 GROUP BY 1),
t AS (SELECT p_partkey AS id, lower(p_name || ' ' || p_type) AS title, p_size AS number FROM part), m AS (SELECT p_size AS number, min(p_brand || '-' || p_partkey) AS by_number FROM part WHERE p_size % 3 <> 0 GROUP BY 1),
h AS (SELECT id, arg_max(device, (length(alias), -ord)) AS device FROM t JOIN a ON contains(title, alias) GROUP BY 1)
SELECT id, coalesce(device, by_number) AS device FROM t LEFT JOIN h USING (id) LEFT JOIN m USING (number)""")
def l8_device_by_number(spark, sf_dir):
    """Names of every other part are aliases; other titles go by their size, a third of which is in no map."""
    part = table(spark, sf_dir, "part").withColumn("device", F.concat("p_brand", F.lit("-"), F.col("p_partkey").cast("string")))
    devices = part.filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("ord"), "device", F.col("p_name").alias("alias"))
    titles = part.select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("title"), F.col("p_size").alias("number"))
    return L.infer_device(titles, devices, part.filter("p_size % 3 <> 0").select(F.col("p_size").alias("number"), "device"))


def versions(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("number"), k.alias("document_id"), F.when(k % 6 != 0, F.year("o_orderdate")).alias("year"), (k * 7919 % 100003).alias("processed_at"))


_VERSIONS = """v AS (SELECT o_custkey AS number, o_orderkey AS document_id, CASE WHEN o_orderkey % 6 <> 0 THEN year(o_orderdate) END AS year, o_orderkey * 7919 % 100003 AS p FROM orders),
s AS (SELECT *, row_number() OVER (PARTITION BY number ORDER BY p, document_id) AS k FROM v)"""
_FOLD = f"""WITH RECURSIVE {_VERSIONS}, f AS (SELECT number, k, document_id, year FROM s WHERE k = 1 UNION ALL
  SELECT s.number, s.k, CASE WHEN f.year > s.year THEN f.document_id ELSE s.document_id END, CASE WHEN f.year > s.year THEN f.year ELSE s.year END FROM f JOIN s ON s.number = f.number AND s.k = f.k + 1),
held AS (SELECT number, arg_max(document_id, k) AS document_id FROM f GROUP BY 1)"""


@query(f"{_FOLD} SELECT v.document_id, v.number, CASE WHEN v.document_id = held.document_id THEN 'current' ELSE 'superseded' END AS status FROM v JOIN held USING (number)")
def l9_current_versions(spark, sf_dir):
    return L.supersede(versions(spark, sf_dir))


@query(f"{_FOLD} SELECT number, arg_max(document_id, (coalesce(year, -1), p, document_id)) AS document_id FROM v WHERE document_id % 3 <> 0 AND number IN (SELECT number FROM held WHERE document_id % 3 = 0) GROUP BY 1")
def l10_successors(spark, sf_dir):
    v = versions(spark, sf_dir)
    return L.successors(v, v.filter("document_id % 3 = 0").select("document_id"))


@query("SELECT o_custkey AS number, max('QTKD_' || o_custkey || '_' || year(o_orderdate)) AS stem FROM orders GROUP BY 1")
def l11_latest_stem(spark, sf_dir):
    stem = F.concat_ws("_", F.lit("QTKD"), F.col("o_custkey").cast("string"), F.year("o_orderdate").cast("string"))
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("number")).agg(F.max(stem).alias("stem"))


@query("SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') THEN 'update' ELSE 'create' END AS action FROM customer")
def l12_procedure_plan(spark, sf_dir):
    have = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return L.plan(have, table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey")


@query("""SELECT alias, array_to_string(list_sort(list_distinct(list(number))), ',') AS numbers FROM (SELECT p_size AS number, lower(trim(p_name)) AS alias FROM part UNION ALL SELECT p_size, lower(p_type) FROM part UNION ALL SELECT p_size, lower(p_brand) FROM part) GROUP BY 1""")
def l13_alias_numbers(spark, sf_dir):
    d = table(spark, sf_dir, "part").select(F.col("p_size").alias("number"), F.col("p_name").alias("name"), F.array("p_type", F.concat(F.lit(" "), "p_brand")).alias("aliases"))
    return L.alias_numbers(d).select("alias", F.array_join(F.col("numbers").cast("array<string>"), ",").alias("numbers"))


@query("""SELECT o_orderkey, c_name AS stem, n_name AS device FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")
def l14_number_maps(spark, sf_dir):
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", F.col("c_name").alias("stem"), F.col("n_name").alias("device"))


@query("SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 3 = 0 THEN s_acctbal + 1 ELSE s_acctbal END AS s_acctbal FROM supplier UNION ALL SELECT s_suppkey + 1000000, s_name, s_acctbal FROM supplier WHERE s_suppkey % 5 = 0")
def l15_reference_upsert(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    new = s.filter("s_suppkey % 3 = 0").withColumn("s_acctbal", F.col("s_acctbal") + 1).unionAll(s.filter("s_suppkey % 5 = 0").withColumn("s_suppkey", F.col("s_suppkey") + 1000000))
    return L.upsert(s, new, ["s_suppkey"])


_TOC = """l AS (SELECT l_orderkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k, l_linenumber, l_partkey, CAST(l_quantity AS BIGINT) AS q FROM lineitem)"""


def _toc_lines(spark, sf_dir):
    from pyspark.sql import Window

    l = table(spark, sf_dir, "lineitem").select("l_orderkey", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")).alias("k"), F.col("l_quantity").cast("bigint").alias("q"))  # noqa: E741
    entry = F.concat(F.col("k").cast("string"), F.lit(" mục "), (F.col("k") * 2).cast("string"), F.lit("x ..... "), F.col("q").cast("string"))
    head = l.groupBy("l_orderkey").agg(F.lit(0).alias("pos")).select(F.col("l_orderkey").alias("doc"), "pos", F.lit("MỤC LỤC").alias("text"))
    return head.unionAll(l.select(F.col("l_orderkey").alias("doc"), F.col("k").alias("pos"), entry.alias("text")))


@query(f"WITH {_TOC} SELECT doc, CAST(k AS VARCHAR) AS number, 'mục ' || (k * 2) || 'x' AS title, CAST(q AS INTEGER) AS page FROM l")
def l17_toc(spark, sf_dir):
    return L.toc(_toc_lines(spark, sf_dir), "Mục lục")


@query(f"WITH {_TOC} SELECT doc, k || '.' || (1 + q % 3) AS number, CAST(q AS INTEGER) AS page, false AS exact FROM l UNION ALL SELECT doc, CAST(k AS VARCHAR), CAST(q AS INTEGER), true FROM l")
def l18_page_of_section(spark, sf_dir):
    contents = L.toc(_toc_lines(spark, sf_dir), "Mục lục")
    wanted = contents.select("doc", F.explode(F.array(F.col("number"), F.concat_ws(".", "number", (1 + F.col("page") % 3).cast("string")))).alias("number"))
    return L.page_of(wanted, contents)


@query(f"""WITH {_TOC}, w AS (SELECT doc, CAST(k AS VARCHAR) AS number, CASE q % 3 WHEN 0 THEN 'MỤC ' || (k * 2) || 'X và thêm' WHEN 1 THEN p_name ELSE '' END AS title, 'mục ' || (k * 2) || 'x' AS there, CAST(q AS INTEGER) AS page FROM l JOIN part ON p_partkey = 1 + q),
f AS (SELECT *, lower(strip_accents(title)) AS a, lower(strip_accents(there)) AS b FROM w)
SELECT doc, number, title, CASE WHEN a = '' OR contains(a, left(b, 12)) OR contains(b, left(a, 12)) THEN page END AS page, a = '' OR contains(a, left(b, 12)) OR contains(b, left(a, 12)) AS exact FROM f""")
def l18_page_by_title(spark, sf_dir):
    """Sections under the title of the contents, under another one or under none."""
    contents = L.toc(_toc_lines(spark, sf_dir), "Mục lục")
    other = table(spark, sf_dir, "part").select((F.col("p_partkey") - 1).cast("int").alias("page"), "p_name")
    title = F.when(F.col("page") % 3 == 0, F.concat(F.upper("title"), F.lit(" và thêm"))).when(F.col("page") % 3 == 1, F.col("p_name")).otherwise("")
    wanted = contents.join(other, "page").select("doc", "number", title.alias("title"))
    return L.page_of(wanted, contents)


@query("""SELECT o_orderkey AS doc, '2.' || lpad(CAST(o_custkey % 1000 AS VARCHAR), 3, '0') AS new, '1.' || lpad(CAST(o_custkey % 1000 AS VARCHAR), 3, '0') AS old FROM orders WHERE o_orderkey % 3 = 0""")
def l19_replacements(spark, sf_dir):
    k = F.col("o_orderkey")
    code = lambda lead: F.concat(F.lit(lead), F.lpad((F.col("o_custkey") % 1000).cast("string"), 3, "0"))
    text = F.concat(F.lit("mở đầu 9.999 8.888\n\n"), F.when(k % 3 == 0, F.concat(code("2."), F.lit(" thay thế "), code("1."))).when(k % 3 == 1, F.concat(F.lit("thay thế "), code("1."))).otherwise("không"))
    return L.replacements(table(spark, sf_dir, "orders").select(k.alias("doc"), text.alias("text")))


@query("""SELECT o_orderkey AS document_id, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.1f KB', b / 1024.0) ELSE printf('%.1f MB', b / 1048576.0) END AS size, strftime(o_orderdate, '%d/%m/%Y') AS day,
  CASE WHEN o_orderkey % 9 = 0 THEN 'embed' WHEN o_orderkey % 7 = 0 THEN 'error' ELSE 'ready' END AS status FROM (SELECT *, CAST(floor(o_totalprice * 10) AS BIGINT) AS b FROM orders)""")
def s10_listing(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    led = o.select(k.alias("document_id"), F.floor(F.col("o_totalprice") * 10).cast("bigint").alias("size_bytes"), F.col("o_orderdate").alias("uploaded_at"), F.when(k % 7 == 0, "error").otherwise("done").alias("ingest_status"))
    jobs = o.filter(k % 3 == 0).select(k.alias("document_id"), F.when(k % 9 == 0, "embed").otherwise("done").alias("stage"))
    return L.listing(led, jobs)


@query("SELECT o_orderkey, strftime(DATE '1899-12-30' + CAST(40000 + o_orderkey % 5000 AS INTEGER), '%d/%m/%Y') AS day, replace(regexp_replace(CAST(CAST(o_orderkey % 100 AS DOUBLE) / 4 AS VARCHAR), '\\.0$', ''), '.', ',') AS txt FROM orders")
def s11_serial_dates(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(L.serial_date(40000 + k % 5000), "dd/MM/yyyy").alias("day"), L.short_number((k % 100).cast("double") / 4).alias("txt"))


@query("""SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS title, len(regexp_extract_all(html, '<p>')) AS n_paragraphs, len(regexp_extract_all(html, '<a href=')) AS n_links FROM pages""")
def s12_markup_counts(spark, sf_dir):
    from tessera.sources.markup import to_sections

    return to_sections(table(spark, sf_dir, "pages")).select("page_id", "title", F.size("paragraphs").cast("bigint").alias("n_paragraphs"), F.size("links").cast("bigint").alias("n_links"))


_TEXT = """trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace({}, '<[^>]*>', '', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\\s+', ' ', 'g'))"""


@query(f"""WITH p AS (SELECT page_id, regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) AS head, regexp_replace(regexp_extract(html, '(?s)</h1>(.*?)(</article>|<footer|$)', 1), '<br[^>]*>', ' ', 'g') AS body FROM pages WHERE html LIKE '%<h1>%'),
t AS (SELECT page_id, {_TEXT.format("head")} AS heading, list_filter(list_transform(string_split_regex(body, '</?p>'), lambda x: {_TEXT.format("x")}), lambda x: x <> '') AS paragraphs FROM p)
SELECT page_id, 1 AS section_no, 1 AS level, heading, array_to_string(paragraphs, chr(10)) AS body FROM t
WHERE NOT (heading = '' OR regexp_matches(heading, '^[-–] |[.;]$') OR (len(heading) > 80 AND contains(heading, '. ')) OR regexp_matches(heading, '^(Hình|Bảng)\\s+\\d'))""")
def s12_markup_sections(spark, sf_dir):
    """Pages as Markdown, cut into sections as any other document is."""
    from tessera.operators.chunking import sections
    from tessera.sources.markup import to_markdown

    found = sections(to_markdown(table(spark, sf_dir, "pages")), "page_id")
    return found.select(F.col("file_stem").alias("page_id"), "section_no", "level", "heading", F.array_join(F.filter("lines", lambda x: F.trim(x) != ""), "\n").alias("body"))


@query("""WITH n AS (SELECT *, row_number() OVER w AS row_no, first_value(l_returnflag) OVER w AS flag FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice))
SELECT l_orderkey AS doc, row_no, unnest([0, 1, 2, 3, 4]) AS col_no, unnest(['State', 'Line', 'Goods - Part', 'Goods - State', 'Goods - State']) AS label,
  unnest([flag, CAST(l_linenumber AS VARCHAR), l_partkey || ' / ' || l_linestatus, CASE WHEN row_no % 2 = 1 THEN l_returnflag ELSE l_returnflag || '|' END, CASE WHEN row_no % 2 = 1 THEN l_returnflag ELSE l_linestatus END]) AS value FROM n""")
def s12_markup_tables(spark, sf_dir):
    """An order's lines as a table of markup whose header has two tiers, whose first cell spans all rows, and every other line of which has a cell over two columns; its cells from the Markdown."""
    from pyspark.sql import Window

    from tessera.operators import tables as T
    from tessera.sources.markup import to_markdown

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", F.col("l_partkey").cast("string").alias("part"), F.row_number().over(w).alias("row_no"))
    cell = lambda *x: F.concat(F.lit("<td>"), *x, F.lit("</td>"))
    wide = F.concat(F.lit('<td colspan="2">'), "l_returnflag", F.lit("</td>"))
    row = F.concat(cell(F.col("l_linenumber").cast("string")), cell("part", F.lit("<br>"), "l_linestatus"), F.when(F.col("row_no") % 2 == 1, wide).otherwise(F.concat(cell("l_returnflag", F.lit("|")), cell("l_linestatus"))), F.lit("</tr>"))
    # a page holds one order
    orders = line.groupBy("l_orderkey").agg(F.min_by("l_returnflag", "row_no").alias("flag"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("row_no", row.alias("row")))).alias("rows"))
    head = "</td></tr><h2>Lines</h2><table><tr><th rowspan=2>State<th rowspan=2>Line<th colspan=3>Goods</tr><tr><th>Part<th colspan=2>State</tr><tr><td rowspan="
    body = F.concat(F.lit(head), F.col("n").cast("string"), F.lit(">"), "flag", F.lit("</td>"), F.array_join(F.transform("rows", lambda x: x["row"]), "<tr>"), F.lit("</table>"))
    found = T.cells(T.tables(to_markdown(orders.select(F.col("l_orderkey").alias("page_id"), body.alias("html"))).withColumnRenamed("page_id", "doc")))
    return found.select("doc", "row_no", "col_no", "label", "value")


@query("""WITH d AS (SELECT p_partkey, '1.' || lpad(CAST(p_partkey % 1000 AS VARCHAR), 3, '0') AS code, 'QTKD_1.' || lpad(CAST(p_partkey % 1000 AS VARCHAR), 3, '0') || '_' || p_partkey AS file_stem, p_name, p_type FROM part),
q AS (SELECT p_partkey AS query_id, code FROM d WHERE p_partkey % 3 <> 0)
SELECT query_id, file_stem, 'Phụ lục D' AS section, '# Phụ lục D' || chr(10) || chr(10) || CASE WHEN d.p_partkey % 2 = 0 THEN '# (Quy định)' || chr(10) || chr(10) ELSE '' END || p_name || chr(10) || chr(10) || p_type AS text
FROM q JOIN d USING (code) WHERE d.p_partkey % 5 <> 0""")
def l20_appendix_topics(spark, sf_dir):
    """Every part is a document with appendices and asks for one; those of every third ask for an unknown document as well, every fifth document has no such appendix."""
    k = F.col("p_partkey")
    code = F.concat(F.lit("1."), F.lpad((k % 1000).cast("string"), 3, "0"))
    part = table(spark, sf_dir, "part")
    head = F.when(k % 5 == 0, "# Phụ lục E").otherwise("# Phụ lục D")
    kind = F.when(k % 2 == 0, "\n\n# (Quy định)\n\n").otherwise("\n\n")
    text = F.concat(F.lit("# Phụ lục A\n\nMẫu\n\n"), head, kind, F.col("p_name"), F.lit("\n"), F.col("p_type"), F.lit("\n\nD.1 Sai số\n\n# Phụ lục F\n"), F.col("p_name"))
    docs = part.select(F.concat(F.lit("QTKD_"), code, F.lit("_"), k.cast("string")).alias("file_stem"), text.alias("text"))
    q = part.select(k.alias("query_id"), F.concat(F.lit("Phụ lục D của QTKĐ "), code, F.when(k % 3 == 0, " và QTKĐ 9.999").otherwise(""), F.lit(" có nội dung gì?")).alias("query"))
    return L.appendix_topics(q, docs)
