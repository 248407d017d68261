"""Units, formulas and record views: orders as records, line items as measurement points, parts as procedures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.operators import formulas, records as R, registry
from tessera.plans.registry import query
from tessera.plans.text_queries import _MEASURED, measured
from tessera.session import table

#: Code, aliases, category, factor and offset to SI.
UNITS = [("bar", ["Bar"], "pressure", 1e5, 0.0), ("kPa", ["kpa"], "pressure", 1e3, 0.0), ("MPa", ["mpa"], "pressure", 1e6, 0.0), ("mm", [], "length", 1e-3, 0.0), ("°C", ["oC"], "temperature", 1.0, 273.15)]
_UNITS = "units(name, code, category, factor, off) AS (VALUES " + ", ".join(f"('{n}', '{c}', '{k}', {f!r}::DOUBLE, {o!r}::DOUBLE)" for c, a, k, f, o in UNITS for n in [c, *a]) + ")"
_NAMES = [n for c, a, *_ in UNITS for n in [c, *a]]


def units(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(UNITS, "code string, aliases array<string>, category string, factor double, offset double")


_NAME_SQL = "[" + ", ".join(f"'{n}'" for n in [*_NAMES, "none"]) + "]"
_pick = lambda k: F.get(F.array(*map(F.lit, [*_NAMES, "none"])), k.cast("int"))


@query(f"WITH {_UNITS} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(factor * l_quantity + off, 6) AS si FROM (SELECT *, {_NAME_SQL}[1 + l_partkey % {len(_NAMES) + 1}] AS u FROM lineitem) LEFT JOIN units ON u = name")
def u1_to_si(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").alias("value"), _pick(F.col("l_partkey") % (len(_NAMES) + 1)).alias("unit"))
    return R.to_si(rows, units(spark)).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("si", 6).alias("si"))


@query(f"""WITH {_UNITS}, r AS (SELECT o_orderkey, o_totalprice AS value, {_NAME_SQL}[1 + o_orderkey % {len(_NAMES) + 1}] AS s, {_NAME_SQL}[1 + o_custkey % {len(_NAMES) + 1}] AS t FROM orders)
SELECT o_orderkey, CASE WHEN a.code IS NULL OR b.code IS NULL THEN 'unknown unit' WHEN a.category <> b.category THEN 'other category' ELSE 'ok' END AS status, CASE WHEN a.category = b.category THEN round((a.factor * value + a.off - b.off) / b.factor, 6) END AS result FROM r LEFT JOIN units a ON s = a.name LEFT JOIN units b ON t = b.name""")
def u2_convert(spark, sf_dir):
    n = len(_NAMES) + 1
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("value"), _pick(F.col("o_orderkey") % n).alias("source"), _pick(F.col("o_custkey") % n).alias("target"))
    return R.convert(rows, units(spark)).select("o_orderkey", "status", F.round("result", 6).alias("result"))


@query(f"""WITH {_MEASURED}, m AS (SELECT l_orderkey AS id, CASE l_linenumber % 3 WHEN 0 THEN CAST(q + 10 AS DOUBLE) END AS a, CASE WHEN l_linenumber % 3 = 1 THEN q + 0.5 END AS b, CASE WHEN l_linenumber % 3 = 1 THEN CAST('0.' || l_linenumber AS DOUBLE) END AS c, CASE WHEN l_linenumber % 3 = 2 THEN CAST(100 + q AS DOUBLE) END AS d FROM measured)
SELECT id, code, count(*) AS n, round(sum(number), 6) AS total FROM (SELECT id, 'mm' AS code, b AS number FROM m WHERE b IS NOT NULL UNION ALL SELECT id, 'mm', c FROM m WHERE c IS NOT NULL UNION ALL SELECT id, 'kPa', d FROM m WHERE d IS NOT NULL) GROUP BY 1, 2""")
def u3_mentions(spark, sf_dir):
    rows = measured(spark, sf_dir).select(F.col("l_orderkey").alias("id"), F.col("txt").alias("text"))
    return R.mentions(rows, units(spark)).groupBy("id", "code").agg(F.count("*").alias("n"), F.round(F.sum("number"), 6).alias("total"))


#: Six kinds of formula; a part's own number stands in each.
_EXPRESSIONS = ["p * (1 - d) * (1 + t) / {}", "sqrt(p ** 2 + q ** 2) + {}", "mean(xs) * {} - q", "max(p, q, {}) - abs(q - {})", "slope(xs, ys) / (q - {})", "rss(xs) + q ** 0.5 * {}"]
_VARIABLES = [["p", "d", "t"], ["p", "q"], ["xs", "q"], ["p", "q"], ["xs", "ys", "q"], ["xs", "q"]]
_VALUES_SQL = "[l_extendedprice * 1000 * (1 - l_discount) * (1 + l_tax) / z, sqrt((l_extendedprice * 1000) ** 2 + l_quantity ** 2) + z, (l_quantity + l_linenumber + 2) / 3.0::DOUBLE * z - l_quantity, greatest(l_extendedprice * 1000, l_quantity, z) - abs(l_quantity - z), CASE WHEN l_quantity = z THEN NULL ELSE 2.0::DOUBLE / (l_quantity - z) END, NULL]"


@query(f"""WITH c AS (SELECT l.*, CAST(p_size AS DOUBLE) AS z, CAST(p_partkey % 6 AS INTEGER) AS kind, l_partkey % 100 = 99 AS gone, l_partkey % 100 = 98 AS odd FROM lineitem l JOIN part ON p_partkey = l_partkey),
s AS (SELECT *, {_VALUES_SQL}[kind + 1] AS v, CASE WHEN gone THEN 'unknown formula' WHEN odd THEN 'unreadable' WHEN l_linenumber = 7 OR (l_linenumber = 6 AND l_orderkey % 2 = 0) THEN 'missing or extra input'
  WHEN kind IN (0, 1, 3) AND l_orderkey % 11 = 0 THEN 'unit' WHEN kind IN (2, 4, 5) AND l_orderkey % 11 = 1 THEN 'items' WHEN kind IN (0, 1, 3) AND l_orderkey % 11 = 2 THEN 'number' WHEN kind = 0 AND l_discount > 0.09 THEN 'bounds'
  WHEN kind <> 0 AND l_quantity >= 50 THEN 'bounds' WHEN l_partkey % 5 = 0 AND l_suppkey % 3 = 0 THEN 'unconfirmed' END AS fault FROM c)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(fault, CASE WHEN v IS NULL THEN 'no value' ELSE 'ok' END) AS status, CASE WHEN fault IS NULL THEN floor(v * 1000) / 1000 END AS value FROM s""")
def u4_formula_batch(spark, sf_dir):
    """A formula for each part, of six kinds; each line item asks for its part's. Prices come in kPa for a variable in Pa, some in another category; quantities of 50 are just outside."""
    part, l = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")  # noqa: E741
    null = lambda t: F.lit(None).cast(t)

    def variable(name: str):
        series = name in ("xs", "ys")
        high, open_ = {"q": (F.lit(50.0), True), "d": (F.lit(0.09), False)}.get(name, (null("double"), False))
        unit = {"p": "Pa", "q": "mm"}.get(name, "1")
        return F.struct(F.lit(name).alias("key"), F.lit(unit).alias("unit"), F.lit("series" if series else "scalar").alias("kind"), F.lit(0.0).alias("min"), high.alias("max"), F.lit(False).alias("exclusive_min"), F.lit(open_).alias("exclusive_max"), (F.lit(3) if series else null("int")).alias("min_items"), null("int").alias("max_items"))

    kind, k = F.col("p_partkey") % 6, F.col("p_partkey")
    text = F.get(F.array(*map(F.lit, _EXPRESSIONS)), kind.cast("int"))
    text = F.when(k % 100 == 98, F.lit("p +* 2")).otherwise(F.replace(text, F.lit("{}"), F.col("p_size").cast("string")))
    conditions = F.when(k % 5 == 0, F.array(F.lit("level"))).otherwise(F.array().cast("array<string>"))
    defined = part.filter(k % 100 != 99).select(k.alias("formula"), text.alias("expression"), conditions.alias("conditions"), F.get(F.array(*(F.array(*map(variable, v)) for v in _VARIABLES)), kind.cast("int")).alias("variables"))
    n, o = F.col("l_linenumber"), F.col("l_orderkey") % 11
    value = lambda unit, *x: F.struct(F.array(*(c.cast("double") for c in x)).alias("values"), F.lit(unit).alias("unit") if isinstance(unit, str) else unit.alias("unit"))
    price = value(F.when(o == 0, "mm").otherwise("kPa"), F.when(o == 2, null("double")).otherwise(F.col("l_extendedprice")))
    xs, two = value("1", F.col("l_quantity"), n, F.lit(2)), value("1", F.col("l_quantity"), n)
    xs = F.when(o == 1, two).otherwise(xs)
    ramp = lambda a: value("1", F.lit(a), F.lit(2 * a), F.lit(3 * a))
    given = {"p": price, "q": value("mm", F.col("l_quantity")), "d": value("1", F.col("l_discount")), "t": value("1", F.col("l_tax")), "xs": xs, "ys": ramp(2)}
    slope = F.when(o == 1, two).otherwise(ramp(1))
    own = F.col("l_partkey") % 6

    def inputs(j: int):
        names = _VARIABLES[j]
        pairs = [F.struct(F.lit(v).alias("key"), (slope if j == 4 and v == "xs" else given[v]).alias("value")) for v in names]
        return F.array(*pairs)

    every = F.get(F.array(*map(inputs, range(6))), own.cast("int"))
    some = F.when(n == 7, F.slice(every, 1, F.size(every) - 1)).when((n == 6) & (F.col("l_orderkey") % 2 == 0), F.concat(every, F.array(F.struct(F.lit("z").alias("key"), given["q"].alias("value"))))).otherwise(every)
    cases = l.join(part.select("p_partkey"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_partkey").alias("formula"), F.map_from_entries(some).alias("inputs"), F.when(F.col("l_suppkey") % 3 != 0, F.array(F.lit("level"))).alias("confirmed"))
    measures = spark.createDataFrame([("Pa", "pressure", 1.0), ("kPa", "pressure", 1000.0), ("mm", "length", 0.001), ("1", "number", 1.0)], "code string, category string, factor double")
    return formulas.evaluate(cases, defined, measures).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "status", (F.floor(F.col("value") * 1000) / 1000).alias("value"))


@query("SELECT l_suppkey, round(avg(l_extendedprice), 6) AS mean, round(sqrt(sum(l_extendedprice * l_extendedprice)), 4) AS rss, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, max(l_extendedprice) AS largest, min(l_extendedprice) AS smallest FROM lineitem GROUP BY 1")
def u5_series(spark, sf_dir):
    s = R.series(table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y")), "l_suppkey")
    return s.select("l_suppkey", F.round("mean", 6).alias("mean"), F.round("rss", 4).alias("rss"), F.round("slope", 6).alias("slope"), "largest", "smallest")


_REGISTRY_EVENTS = """e AS (SELECT o_custkey AS document, o_orderkey AS seq, m, CASE WHEN m < 3 THEN 'add' WHEN m < 5 THEN 'update' WHEN m < 8 THEN 'approve' WHEN m = 8 THEN 'reject' WHEN o_orderkey % 2 = 0 THEN 'patch' ELSE 'invalidate' END AS action,
  CASE WHEN m = 2 THEN 'b' ELSE 'a' END AS h, CASE WHEN m = 1 THEN ['f0'] ELSE ['f0', 'f1'] END AS fids, 'f' || o_orderkey // 2 % 2 AS fid, 1 + o_orderkey // 4 % 3 AS rev, o_orderpriority AS proposal FROM (SELECT *, (o_orderkey * 7 + o_custkey) % 10 AS m FROM orders))"""


@query(f"""WITH RECURSIVE {_REGISTRY_EVENTS},
rec AS (SELECT DISTINCT document, h, unnest(fids) AS fid FROM e WHERE action = 'add' UNION SELECT document, h, fid FROM e WHERE action IN ('update', 'approve', 'reject', 'patch')),
ev AS (SELECT *, row_number() OVER (PARTITION BY document, h, fid ORDER BY seq) AS k FROM (
  SELECT r.document, r.h, r.fid, seq, action, action = 'add' AND e.h = r.h AS same, list_contains(fids, r.fid) AS listed, NULL AS rev, NULL AS proposal FROM rec r JOIN e ON e.document = r.document AND action IN ('add', 'invalidate')
  UNION ALL SELECT document, h, fid, seq, action, true, true, rev, proposal FROM e WHERE action NOT IN ('add', 'invalidate'))),
s AS (SELECT document, h, fid, 0::BIGINT AS k, '' AS status, 0::BIGINT AS revision, NULL::VARCHAR AS proposal, NULL::VARCHAR AS approved, 0::BIGINT AS conflicts FROM rec
  UNION ALL SELECT document, h, fid, k, CASE kind WHEN 'keep' THEN status WHEN 'patch' THEN status WHEN 'conflict' THEN status WHEN 'stale' THEN 'stale' WHEN 'approve' THEN 'approved' WHEN 'reject' THEN 'rejected' ELSE 'pending' END,
    CASE WHEN kind IN ('keep', 'patch', 'conflict') THEN revision ELSE revision + 1 END, CASE WHEN kind IN ('patch', 'update') THEN new_proposal ELSE proposal END,
    CASE WHEN kind = 'approve' THEN coalesce(proposal, '') WHEN kind IN ('keep', 'patch', 'conflict', 'stale') THEN approved END, conflicts + (kind = 'conflict')::INT
  FROM (SELECT s.document, s.h, s.fid, ev.k, status, revision, s.proposal, approved, conflicts, ev.proposal AS new_proposal,
    CASE WHEN action = 'add' AND same THEN CASE WHEN NOT listed THEN 'keep' WHEN status = '' THEN 'new' WHEN status = 'stale' THEN 'again' ELSE 'keep' END
      WHEN status = '' THEN CASE WHEN action IN ('update', 'approve', 'reject') THEN 'conflict' ELSE 'keep' END
      WHEN action IN ('add', 'invalidate') THEN CASE WHEN status = 'stale' THEN 'keep' ELSE 'stale' END
      WHEN action = 'patch' THEN 'patch' WHEN status = 'stale' OR rev <> revision OR (action <> 'update' AND status <> 'pending') THEN 'conflict' ELSE action END AS kind
    FROM s JOIN ev ON ev.document = s.document AND ev.h = s.h AND ev.fid = s.fid AND ev.k = s.k + 1)),
last AS (SELECT * FROM s QUALIFY k = max(k) OVER (PARTITION BY document, h, fid)),
now AS (SELECT document, CASE WHEN arg_max(action, seq) = 'add' THEN arg_max(h, seq) END AS now_hash FROM e WHERE action IN ('add', 'invalidate') GROUP BY 1)
SELECT document, h AS source_hash, fid, revision, conflicts, CASE WHEN h = now_hash THEN status ELSE 'stale' END AS shown, coalesce(h = now_hash AND status = 'approved' AND approved = coalesce(proposal, ''), false) AS usable FROM last LEFT JOIN now USING (document) WHERE status <> ''""")
def u7_registry_state(spark, sf_dir):
    """Orders as events of their customers' documents: two files' bytes, two formulas in each."""
    events, sources = registry_events(table(spark, sf_dir, "orders"))
    found = registry.current(registry.states(events), sources)
    return found.select(F.col("document").cast("bigint").alias("document"), "source_hash", "fid", "revision", "conflicts", "shown", "usable")


def registry_events(orders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events of the registry, and the bytes that each document has after them."""
    k = F.col("o_orderkey")
    m = (k * 7 + F.col("o_custkey")) % 10
    action = F.when(m < 3, "add").when(m < 5, "update").when(m < 8, "approve").when(m == 8, "reject").when(k % 2 == 0, "patch").otherwise("invalidate")
    document = F.col("o_custkey").cast("string").alias("document")
    whole = action.isin("add", "invalidate")
    fids = F.when(action == "add", F.when(m == 1, F.array(F.lit("f0"))).otherwise(F.array(F.lit("f0"), F.lit("f1"))))
    fid = F.when(~whole, F.concat(F.lit("f"), F.expr("o_orderkey div 2 % 2").cast("string")))
    events = orders.select(document, k.alias("seq"), action.alias("action"), F.when(m == 2, "b").otherwise("a").alias("source_hash"), fids.alias("fids"), fid.alias("fid"), F.expr("1 + o_orderkey div 4 % 3").cast("long").alias("revision"), F.col("o_orderpriority").alias("proposal"))
    last = events.filter("action IN ('add', 'invalidate')").groupBy("document").agg(F.max_by(F.struct("action", "source_hash"), "seq").alias("x"))
    return events, last.select("document", F.when(F.col("x.action") == "add", F.col("x.source_hash")).alias("source_hash"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(lim, 6) AS "limit", CASE WHEN abs(measured - nominal) <= lim THEN 'Đạt' ELSE 'Không đạt' END AS verdict FROM (SELECT *, greatest(abs(nominal) * rate / 100, 0.4) AS lim FROM (SELECT *, l_quantity AS nominal, l_quantity + l_linenumber / 8.0::DOUBLE AS measured, CAST(l_linenumber AS DOUBLE) AS rate FROM lineitem))""")
def u8_verdicts(spark, sf_dir):
    n = F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").alias("nominal"), (F.col("l_quantity") + n / 8.0).alias("measured"), n.cast("double").alias("rate"), F.lit(0.4).alias("floor"))
    return R.verdict(rows).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("limit", 6).alias("limit"), "verdict")


@query("SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 6) AS total FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1")
def v1_approved_only(spark, sf_dir):
    ext = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("extraction_id"), F.when(F.col("o_orderstatus") == "F", "approved").otherwise("pending").alias("status"))
    rows = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "extraction_id")
    return R.approved_only(rows, ext).groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 6).alias("total"))


@query("""WITH p AS (SELECT l_orderkey AS record_id, l_partkey * 1000 + l_suppkey AS point_id, l_linenumber AS point_no, l_quantity AS span FROM lineitem),
f AS (SELECT record_id, arg_min(point_id, (point_no, point_id)) AS first_point, arg_max(point_id, (span, point_id)) AS widest_point, count(*) AS n_points FROM p GROUP BY 1)
SELECT o_orderkey AS record_id, c_name AS device, n_name AS place, first_point, widest_point, n_points FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN f ON record_id = o_orderkey""")
def v2_wide_records(spark, sf_dir):
    rec = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_id"), F.col("o_custkey").alias("device_id"))
    dev = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("device_id"), F.col("c_name").alias("device"), F.col("c_nationkey").alias("place_id"))
    place = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("place_id"), F.col("n_name").alias("place"))
    points = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("record_id"), (F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("point_id"), F.col("l_linenumber").alias("point_no"), F.col("l_quantity").alias("span"))
    return R.wide_records(rec, dev, place, points).select("record_id", "device", "place", "first_point", "widest_point", "n_points")


@query("SELECT l_partkey AS procedure_id, max(l_quantity) FILTER (l_returnflag = 'A') AS a, max(l_quantity) FILTER (l_returnflag = 'N') AS n, max(l_quantity) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY 1")
def v3_pivot_kinds(spark, sf_dir):
    return R.pivot_kinds(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("procedure_id"), F.col("l_returnflag").alias("kind"), F.col("l_quantity").alias("value")), ["A", "N", "R"])


@query("""SELECT n.n_name AS supplier_nation, m.n_name AS customer_nation, count(*) AS n FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation n ON n.n_nationkey = s_nationkey JOIN nation m ON m.n_nationkey = c_nationkey GROUP BY 1, 2""")
def v4_two_roles(spark, sf_dir):
    l, s, o, c, n = (table(spark, sf_dir, t) for t in ("lineitem", "supplier", "orders", "customer", "nation"))
    rows = l.join(s, l.l_suppkey == s.s_suppkey).join(o, l.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey)
    counted = rows.groupBy("s_nationkey", "c_nationkey").agg(F.count("*").alias("n"))
    a, b = (n.select(F.col("n_nationkey").alias(f"{p}_key"), F.col("n_name").alias(name)) for p, name in (("a", "supplier_nation"), ("b", "customer_nation")))
    return counted.join(a, F.col("s_nationkey") == F.col("a_key")).join(b, F.col("c_nationkey") == F.col("b_key")).select("supplier_nation", "customer_nation", "n")


@query("SELECT c_custkey, c_name, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def v5_reference_view(spark, sf_dir):
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    return c.join(n, c.c_nationkey == n.n_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "left").select("c_custkey", "c_name", "n_name", "r_name")


@query("SELECT 'part' AS catalog, p_partkey AS id, p_name AS name FROM part UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier UNION ALL SELECT 'customer', c_custkey, c_name FROM customer UNION ALL SELECT 'nation', n_nationkey, n_name FROM nation")
def v6_catalogs(spark, sf_dir):
    out = None
    for name, p, key in (("part", "p", "partkey"), ("supplier", "s", "suppkey"), ("customer", "c", "custkey"), ("nation", "n", "nationkey")):
        rows = table(spark, sf_dir, name).select(F.lit(name).alias("catalog"), F.col(f"{p}_{key}").cast("bigint").alias("id"), F.col(f"{p}_name").alias("name"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("SELECT o_orderkey AS record_id, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 100")
def v7_latest_by_verdict(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_id"), F.col("o_orderdate").alias("at"), F.col("o_orderstatus").alias("verdict"), "o_totalprice")
    return R.by_time(rows, "F", 100).select("record_id", "o_totalprice")


@query("""WITH cells AS (SELECT p_size AS table_id, p_brand AS class, p_partkey % 40 AS low, p_partkey % 40 + 3 AS high, p_partkey % 11 = 0 AS open, p_name || p_partkey AS cell FROM part),
q AS (SELECT o_orderkey AS query_id, CAST(o_orderkey % 50 AS INTEGER) AS table_id, 'Brand#' || (o_orderkey % 5 + 1) AS class, CAST(o_custkey % 45 AS DOUBLE) AS value FROM orders),
h AS (SELECT query_id, count(*) AS n, min(cell) AS cell FROM q JOIN cells USING (table_id, class) WHERE CASE WHEN open THEN value > low ELSE value >= low AND value <= high END GROUP BY 1)
SELECT q.query_id, CASE WHEN n = 1 THEN cell END AS cell FROM q LEFT JOIN h USING (query_id)""")
def t8_range_lookup(spark, sf_dir):
    k = F.col("p_partkey")
    cells = table(spark, sf_dir, "part").select(F.col("p_size").cast("int").alias("table_id"), F.col("p_brand").alias("class"), (k % 40).alias("low"), (k % 40 + 3).alias("high"), (k % 11 == 0).alias("open"), F.concat("p_name", k.cast("string")).alias("cell"))
    o = F.col("o_orderkey")
    q = table(spark, sf_dir, "orders").select(o.alias("query_id"), (o % 50).cast("int").alias("table_id"), F.concat(F.lit("Brand#"), (o % 5 + 1).cast("string")).alias("class"), (F.col("o_custkey") % 45).cast("double").alias("value"))
    return R.range_lookup(cells, q)
