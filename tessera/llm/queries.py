"""The registered queries of the training-data operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, decontaminate, jaccard, license_scan, neardup, periodic, quality, repair, sharding, token_counts, token_output, warc, webp
from tessera.session import table

#: Vocabulary file of the queries; operators take any path.
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), WORD_BPE)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_files(table(spark, sf_dir, "documents"), WORD_BPE)


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licences(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webp.media_column(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), WORD_BPE)


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op10_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similarity_join(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.summary(periodic.periodic_runs(periodic.with_runs(table(spark, sf_dir, "documents"))))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    report, _ = repair.repair(repair.damaged(conversations))
    return repair.with_all(report, conversations)


_ALL = (op1_near_duplicates, op2_warc, op3_bpe, op4_token_files, op5_licences, op6_quality, op7_webp, op8_token_counts, op9_shards, op10_contamination, op11_jaccard_join, op12_periodic_runs, op13_conversation_repair)
QUERIES = {f.__name__: f for f in _ALL}

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: SQL for the rows of the queries that SQL can express; the others are tested against brute force in tests/llm.
ORACLE_SQL: dict[str, str] = {
    "op1_near_duplicates": f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
both_in AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT u, v FROM both_in JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * k >= 75 * (x.n + y.n - k)),
edge AS (SELECT u, v FROM link UNION SELECT v, u FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, edge.v FROM reach JOIN edge ON edge.u = reach.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(b) AS component_id, d.doc_id = min(b) AS kept FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN reach ON a = d.doc_id GROUP BY 1, 2""",
    "op2_warc": """WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT payload_digest, max(page_id) AS winner FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND winner <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN payload_bytes >= 1000 AND winner <> page_id THEN winner END AS refers_to FROM p LEFT JOIN m USING (payload_digest)""",
    "op11_jaccard_join": f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
both_in AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT u, v FROM both_in JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * k >= 85 * (x.n + y.n - k)),
edge AS (SELECT u, v FROM link UNION SELECT v, u FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, edge.v FROM reach JOIN edge ON edge.u = reach.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(b) AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN reach ON a = d.doc_id GROUP BY 1, 2""",
}
