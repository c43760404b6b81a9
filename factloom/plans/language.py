"""Queries given in the query language."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from factloom.dsl.execute import hashed_vector, mode_of, run
from factloom.dsl.language import parse
from factloom.plans import retrieval
from factloom.plans.epistemic import _EFF
from factloom.sources import views as v

NOW = datetime.fromisoformat(v.AS_OF)
TEXT = "which depot can't be reached"
STATEMENTS = {
    "dsl_pipe_top": (f'search "{TEXT}" | in harbor/claims mode belief_system | top 15 | return id, score, similarity', "n.ns = 'harbor/claims'", None),
    "dsl_pipe_where": (f'search "{TEXT}" | where confidence >= 0.4 and (label = "Fact" or label = "Claim") | weight utility:high, recency:off | top 12 | return ns, id, score', "confidence >= 0.4 AND (list_contains(n.labels, 'Fact') OR list_contains(n.labels, 'Claim'))", None),
    "dsl_pipe_known_at": (f'search "{TEXT}" | as_of "2025-04-01" | known_at "2025-03-15" | return ns, id, version, score', "TRUE", ("2025-04-01", "2025-03-15")),
    "dsl_cql_boolean": (f'FIND "{TEXT}" WHERE NOT (confidence < 0.3 OR mem_type = "working") AND valid_until IS NULL LIMIT 20 RETURN ns, id, score, mem_type', "NOT (confidence < 0.3 OR mem_type = 'working') AND valid_until IS NULL", None),
    "dsl_cql_sources": (f'FIND "{TEXT}" WHERE source.credibility BETWEEN 0.3 AND 0.9 AND label IN ("Alert", "Skill") EXCLUDE SOURCES "agent:siozeaxfin", "user:pruwend" LIMIT 10 RETURN ns, id, source.name, score', "cred BETWEEN 0.3 AND 0.9 AND list_has_any(n.labels, ['Alert', 'Skill']) AND (n.source_id IS NULL OR n.source_id NOT IN ('agent:siozeaxfin', 'user:pruwend'))", None),
    "dsl_cql_like": (f'FIND "{TEXT}" IN NAMESPACE orchid/rag MODE agent_memory WHERE content LIKE "%isn\'t the%" LIMIT 8 RETURN id, score, content', "n.ns = 'orchid/rag' AND content LIKE '%isn''t the%'", None),
    "dsl_pipe_rerank": (f'search "{TEXT}" | in harbor/claims | rerank | top 15 | return ns, id, score', "n.ns = 'harbor/claims'", None),
    "dsl_cql_follow": (f'FIND "{TEXT}" IN harbor/agent FOLLOW supports DEPTH 2, cites LIMIT 20 RETURN id, score, path', None, None),
}


def _query(text: str):
    def go(spark: SparkSession, d: str) -> DataFrame:
        return run(parse(text, NOW), v.nodes(spark, d), v.vectors(spark, d), v.edges(spark, d), v.sources(spark, d), NOW)

    return go


QUERIES = {k: _query(s) for k, (s, _, _) in STATEMENTS.items()}
_OUT = {"ns": "ns", "id": "id", "score": "score", "similarity": "similarity", "version": "version_no", "mem_type": "mem_type", "source.name": "source_id", "content": "content"}


def _sql(text: str, where: str, times: tuple[str, str] | None) -> str:
    q = parse(text, NOW)
    t = f"TIMESTAMP '{times[0] if times else v.AS_OF}'"
    known = f"AND tx_time <= TIMESTAMP '{times[1]}'" if times else ""
    limit = 10 if q.limit is None else q.limit
    score = retrieval.sql_score(mode_of(q).weights, sim="sim", t=t)["score"]
    fields = ", ".join(f"{_OUT[f]} AS {f.replace('.', '_')}" for f in q.fields)
    vec = "[" + ", ".join(repr(x) for x in hashed_vector(q.text)) + "]"
    # reranked by the default, which keeps the order: scores are 1 - i / n
    head, again = ("", "")
    if q.rerank:
        fields = "ns, id, score"
        head, again = "SELECT ns, id, round(1 - (row_number() OVER (ORDER BY score DESC, ns, id) - 1) / count(*) OVER (), 6) AS score FROM (", ")"
    return v.sql(
        f"{head}SELECT {fields} FROM (SELECT *, round({score}, 6) AS score, round(greatest(0.0, least(1.0, sim)), 6) AS similarity FROM b) WHERE score > 0 ORDER BY score DESC, ns, id LIMIT {limit}{again}",
        w=f"SELECT * FROM n WHERE valid_from <= {t} AND (valid_until IS NULL OR {t} <= valid_until) {known} QUALIFY row_number() OVER (PARTITION BY ns, id ORDER BY version_no DESC) = 1",
        cr=f"SELECT ns, external_id, {_EFF} AS cred FROM s", sd="SELECT ns, node_id AS id, arg_max(content, write_id) AS content FROM v WHERE node_id IS NOT NULL GROUP BY 1, 2",
        f=f"SELECT n.*, cr.cred, sd.content FROM w n LEFT JOIN cr ON cr.ns = n.ns AND cr.external_id = n.source_id LEFT JOIN sd ON sd.ns = n.ns AND sd.id = n.id WHERE {where}",
        k=f"SELECT * FROM (SELECT v.ns, v.node_id AS id, v.write_id, round(list_cosine_similarity(v.vec, {vec}), 9) AS sim FROM v JOIN f ON f.ns = v.ns AND f.id = v.node_id) WHERE sim > 0 QUALIFY row_number() OVER (PARTITION BY ns ORDER BY sim DESC, write_id) <= {max(50, 4 * limit)}",
        b="SELECT f.*, x.sim AS sim FROM (SELECT ns, id, max(sim) AS sim FROM k GROUP BY 1, 2) x JOIN f ON f.ns = x.ns AND f.id = x.id",
    )


SQL = {k: _sql(s, w, t) for k, (s, w, t) in STATEMENTS.items() if w}
