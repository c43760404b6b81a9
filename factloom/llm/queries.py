"""Queries of the llm problems, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import ann, bpe, consensus, leakage, neardup, residue
from factloom.sources.views import sql_uuid
from factloom.sources.tables import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "retrieve_requests").select(F.col("retrieve_id").alias("id"), "ns", "vector")
    w = table(spark, d, "write_requests").select(F.col("write_id").alias("id"), "ns", "vector")
    return ann.similar(q, w).select(F.col("query").alias("retrieve_id"), F.col("row").alias("write_id"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return consensus.consensus(table(spark, d, "assertions")).select(F.col("claim").alias("claim_id"), "consensus")


def p4_reliability(spark: SparkSession, d: str) -> DataFrame:
    return consensus.reliability(table(spark, d, "assertions"))


def p4_agreement(spark: SparkSession, d: str) -> DataFrame:
    return consensus.agreement(table(spark, d, "assertions"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "write_requests").select(F.col("write_id").alias("id"), "content")
    return neardup.all_pairs(*neardup.similar_pairs(w)).select(F.col("a").alias("write_id_a"), F.col("b").alias("write_id_b"))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "write_requests").select(F.col("write_id").alias("id"), "content")
    return neardup.groups(*neardup.similar_pairs(w)).select(F.col("id").alias("write_id"), F.col("group").alias("group_id"), "links")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.token_ids(table(spark, d, "documents"))


def _corpus_and_items(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """All documents are the corpus; the stored queries among them are the test items, each looked for in all other documents."""
    docs = table(spark, d, "documents").select("doc_id", "text", "doc_kind")
    return docs, leakage.stored_queries(docs)


def p7_documents(spark: SparkSession, d: str) -> DataFrame:
    return leakage.contamination(*_corpus_and_items(spark, d), own=True).select("doc_id", "items", "windows", "coverage", "item_id")


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(*_corpus_and_items(spark, d), own=True)


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(*_corpus_and_items(spark, d), own=True).select("doc_id", "item_id", "windows", "coverage")


def p8_residue(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(table(spark, d, "documents").select("doc_id", "source", "text"))


def p8_clean(spark: SparkSession, d: str) -> DataFrame:
    return residue.clean(table(spark, d, "documents").select("doc_id", "source", "text")).select("doc_id")


QUERIES = {"p3_found": p3_found, "p4_found": p4_found, "p4_reliability": p4_reliability, "p4_agreement": p4_agreement, "p5_found": p5_found, "p5_groups": p5_groups, "p6_ids": p6_ids, "p7_documents": p7_documents, "p7_items": p7_items, "p7_leaks": p7_leaks, "p8_residue": p8_residue, "p8_clean": p8_clean}
_P3 = """WITH w AS (SELECT DISTINCT write_id, ns, CAST(vector AS DOUBLE[]) AS v FROM write_requests WHERE len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0),
q AS (SELECT DISTINCT retrieve_id, ns, CAST(vector AS DOUBLE[]) AS v FROM retrieve_requests WHERE len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0),
s AS (SELECT retrieve_id, write_id, max(list_cosine_similarity(q.v, w.v)) AS c FROM q JOIN w ON q.ns = w.ns GROUP BY 1, 2)
SELECT retrieve_id, write_id FROM s WHERE c >= 0.85 QUALIFY row_number() OVER (PARTITION BY retrieve_id ORDER BY c DESC, write_id) <= 10"""
_P5 = r"""WITH t AS (SELECT DISTINCT write_id, content FROM write_requests WHERE content IS NOT NULL),
u AS (SELECT write_id, list_distinct(string_split(trim(regexp_replace(regexp_replace(lower(content), '[^\p{L}\p{Nd}\s\x{0B}\x{85}\p{Z}]+', '', 'g'), '[\s\x{0B}\x{85}\p{Z}]+', ' ', 'g')), ' ')) AS w FROM t),
n AS (SELECT write_id, len(w) AS n, w FROM u WHERE len(w) >= 8),
x AS (SELECT write_id, n, unnest(w) AS w FROM n),
f AS (SELECT w, count(*) AS f FROM x GROUP BY w),
o AS (SELECT x.write_id, x.n, x.w, row_number() OVER (PARTITION BY x.write_id ORDER BY f.f, x.w) AS r FROM x JOIN f USING (w)),
p AS (SELECT * FROM o WHERE r <= n - ceil(0.7 * n) + 1),
c AS (SELECT DISTINCT a.write_id AS a, b.write_id AS b FROM p a JOIN p b ON a.w = b.w AND a.write_id < b.write_id AND 10 * a.n >= 7 * b.n AND 10 * b.n >= 7 * a.n),
s AS (SELECT c.a, c.b, count(*) AS s FROM c JOIN x a ON a.write_id = c.a JOIN x b ON b.write_id = c.b AND a.w = b.w GROUP BY 1, 2)
SELECT s.a AS write_id_a, s.b AS write_id_b FROM s JOIN n a ON a.write_id = s.a JOIN n b ON b.write_id = s.b WHERE 10 * s >= 7 * (a.n + b.n - s)"""
_POSITIONS = f"""WITH a AS (SELECT {sql_uuid("claim_id")} AS claim, {sql_uuid("source_id")} AS source, assertion_id, asserted_at, lower(trim(assertion_type)) AS t
FROM assertions WHERE trim(claim_id) <> '' AND trim(source_id) <> ''),
l AS (SELECT DISTINCT claim, source, t FROM a QUALIFY dense_rank() OVER (PARTITION BY claim, source ORDER BY asserted_at DESC NULLS LAST, assertion_id DESC, t DESC NULLS LAST) = 1),
v AS (SELECT claim, source, CASE t WHEN 'supports' THEN 1 ELSE 0 END AS s FROM l WHERE t IN ('supports', 'contradicts'))"""
SQL = {
    "p5_groups": _P5.replace("WITH t AS", "WITH RECURSIVE t AS", 1).replace("SELECT s.a AS write_id_a, s.b AS write_id_b", ", l AS (SELECT s.a, s.b", 1)
    + """), m AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), r AS (SELECT DISTINCT write_id AS a, write_id AS b FROM n UNION SELECT r.a, m.b FROM r JOIN m ON r.b = m.a)
SELECT r.a AS write_id, min(r.b) AS group_id, (SELECT count(DISTINCT m.b) FROM m WHERE m.a = r.a) AS links FROM r GROUP BY r.a""",
    "p7_leaks": leakage.sql("SELECT doc_id, item_id, windows, coverage FROM leaks"),
    "p7_items": leakage.sql("SELECT item_id, count(*) AS documents, max(coverage) AS coverage FROM leaks GROUP BY 1"),
    "p7_documents": leakage.sql(
        """, per AS (SELECT doc_id, count(*) AS items, CAST(sum(windows) AS BIGINT) AS windows, max(coverage) AS coverage FROM leaks GROUP BY 1),
best AS (SELECT leaks.doc_id, min(item_id) AS item_id FROM leaks JOIN per ON leaks.doc_id = per.doc_id AND leaks.coverage = per.coverage GROUP BY 1)
SELECT d.doc_id, coalesce(per.items, 0) AS items, coalesce(per.windows, 0) AS windows, coalesce(per.coverage, 0) AS coverage, best.item_id
FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN per ON d.doc_id = per.doc_id LEFT JOIN best ON d.doc_id = best.doc_id"""
    ),
    "p8_residue": residue.sql(),
    "p8_clean": f"SELECT DISTINCT doc_id FROM ({residue.sql()}) GROUP BY doc_id HAVING NOT bool_or(residue)",
    "p5_found": _P5,
    "p3_found": _P3,
    "p4_agreement": _POSITIONS + """, c AS (SELECT claim, count(*) AS n, sum(s) AS s FROM v GROUP BY claim HAVING count(*) >= 2),
t AS (SELECT count(*) AS claims, CAST(coalesce(sum(n), 0) AS BIGINT) AS positions, CAST(coalesce(sum(s), 0) AS DOUBLE) AS s, sum(2.0 * s * (n - s) / (n - 1)) AS apart FROM c)
SELECT claims, positions, round(1 - apart / positions, 9) AS observed, round(1 - 2.0 * s * (positions - s) / (CAST(positions AS DOUBLE) * (positions - 1)), 9) AS expected,
round(1 - (apart / positions) / (2.0 * s * (positions - s) / (CAST(positions AS DOUBLE) * (positions - 1))), 9) AS alpha FROM t""",
}
