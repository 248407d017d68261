"""Streaming queries: each runs a stream over a table to its end and returns the state it reached."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.operators.kept import Kept
from tessera.plans.registry import query
from tessera.plans.retrieval_queries import CHUNKS, TOKENS, chunks
from tessera.session import shared_dir, table
from tessera.streaming import jobs as J


@query(f"""WITH {CHUNKS}, p AS (SELECT file_stem, chunk_id, unnest({TOKENS.format("text")}) AS term FROM chunks), d AS (SELECT term, count(DISTINCT chunk_id) AS df, count(*) AS tf FROM p GROUP BY 1),
raw AS (SELECT term, df, tf, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM d, (SELECT count(*) AS n FROM chunks))
SELECT term, df, tf, round(CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END, 9) AS idf FROM raw""")
def w1_index_refresh(spark, sf_dir):
    """A stream of the documents in two arrivals: first without every fourth and with others cut short, then those that were missing and those that were short. The index is as if built at once."""
    docs, k = table(spark, sf_dir, "documents"), F.col("doc_id") % 4
    home = f"{shared_dir(spark).rstrip('/')}/arrivals-{uuid.uuid4().hex}"
    index = Kept(spark, f"{home}/index")
    first = docs.withColumn("text", F.when(k == 0, F.substring("text", 1, 20)).otherwise(F.col("text"))).filter(k != 1)
    for arriving in (first, docs.filter(k.isin(0, 1))):
        arriving.write.mode("append").parquet(f"{home}/files")
        J.keep_index(spark.readStream.schema(docs.schema).parquet(f"{home}/files"), index, lambda d: chunks(spark, sf_dir, d).select("file_stem", "chunk_id", F.col("text").alias("indexed")), f"{home}/progress")
    tf = index.postings.groupBy("term").agg(F.sum("tf").alias("tf"))
    return index.weights.join(tf, "term").select("term", "df", "tf", F.round("idf", 9).alias("idf"))


_EVENTS = "e AS (SELECT event_id, ts, user_id AS doc, CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'chunk' WHEN 'view' THEN 'embed' ELSE 'done' END AS stage, value AS progress FROM events)"


def stages(spark, sf_dir):
    s = J.stream_of(spark, f"{sf_dir}/events.parquet")
    stage = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "click", "chunk").when(F.col("event_type") == "view", "embed").otherwise("done")
    return s.select("event_id", "ts", F.col("user_id").alias("doc"), stage.alias("stage"), F.col("value").alias("progress"))


@query(f"WITH {_EVENTS} SELECT doc, arg_max(stage, (ts, event_id)) AS stage, arg_max(progress, (ts, event_id)) FILTER (stage <> 'error') AS progress FROM e GROUP BY 1")
def w2_latest_stage(spark, sf_dir):
    return J.newest(J.run_to_end(J.latest_stage(stages(spark, sf_dir)), "update"), "doc")


@query(f"""WITH {_EVENTS}, s AS (SELECT c_custkey AS doc, CASE WHEN c_custkey % 7 = 0 THEN 'error' ELSE 'done' END AS st, c_custkey % 2 = 0 AS published FROM customer)
SELECT doc, event_id, CASE WHEN stage NOT IN ('done', 'error') THEN stage WHEN stage = 'error' OR st = 'error' THEN 'error' WHEN published THEN 'ready' ELSE 'waiting' END AS status FROM e LEFT JOIN s USING (doc)""")
def w3_derived_status(spark, sf_dir):
    k = F.col("c_custkey")
    led = table(spark, sf_dir, "customer").select(k.alias("doc"), F.when(k % 7 == 0, "error").otherwise("done").alias("ingest_status"), (k % 2 == 0).alias("published"))
    return J.run_to_end(J.derived_status(stages(spark, sf_dir), led), "append").drop("batch_no")


@query("""WITH t AS (SELECT conv_id, turn, text, min(turn) FILTER (turn % 3 = 2 AND text IS NOT NULL) OVER (PARTITION BY conv_id) AS stop FROM conversations)
SELECT conv_id, CAST(coalesce(sum(length(text)), 0) + count(*) FILTER (turn = stop) AS BIGINT) AS passed, max(stop) IS NOT NULL AS stopped FROM t WHERE stop IS NULL OR turn <= stop GROUP BY 1""")
def w4_stream_guard(spark, sf_dir):
    deltas = J.stream_of(spark, f"{sf_dir}/conversations.parquet").select("conv_id", "turn", F.concat("text", F.when(F.col("turn") % 3 == 2, " 测量结果显示压力合格").otherwise("")).alias("text"))
    return J.newest(J.run_to_end(J.guard(deltas), "update"), "conv_id")


@query("SELECT user_id AS entity, arg_max(event_type, (ts, event_id)) AS state, count(*) AS entries FROM events GROUP BY 1")
def w5_audit_state(spark, sf_dir):
    log = J.stream_of(spark, f"{sf_dir}/events.parquet").select(F.col("user_id").alias("entity"), F.col("event_id").alias("entry_id"), F.col("ts").cast("timestamp").alias("at"), F.col("event_type").alias("after"))
    return J.newest(J.run_to_end(J.audit_state(log.unionAll(log)), "update"), "entity")


@query("SELECT DISTINCT sha256(text) AS sha256 FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 10 = 3)")
def w6_duplicate_gate(spark, sf_dir):
    docs = J.stream_of(spark, f"{sf_dir}/documents.parquet").select(F.sha2("text", 256).alias("sha256"))
    led = table(spark, sf_dir, "documents").filter("doc_id % 10 = 3").select(F.sha2("text", 256).alias("sha256")).distinct()
    return J.run_to_end(J.new_documents(docs, led), "append").drop("batch_no")
