"""The tables as the engine sees them: one row per key, keys spelled alike. DF builds each view, SQL says the same."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions.keys import uuid_key
from factloom.functions.vector import usable
from factloom.session import cut
from factloom.sources.tables import table

DIM = 64
#: Fields of a version besides its key.
NODE = ["labels", "source_id", "mem_type", "epistemic_type", "utility", "fingerprint", "confidence", "tx_time", "valid_from", "valid_until"]
#: The clock of queries that need one.
AS_OF = "2025-06-01 00:00:00"
#: Repeated keys that are broadcast, 8 MB of them at most.
FEW = 1_000_000

_TRIM = "trim({x}, chr(32)||chr(9)||chr(10)||chr(13)||chr(11)||chr(12)||chr(133)||chr(160)||chr(8232)||chr(8233)||chr(12288))"


def now() -> Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


def sql_uuid(x: str) -> str:
    t = _TRIM.format(x=x)
    bare = f"replace(regexp_replace(regexp_replace(lower({t}), '^urn:uuid:', ''), '^\\{{(.*)\\}}$', '\\1'), '-', '')"
    spelled = f"substr({bare},1,8)||'-'||substr({bare},9,4)||'-'||substr({bare},13,4)||'-'||substr({bare},17,4)||'-'||substr({bare},21,12)"
    return f"CASE WHEN regexp_full_match({bare}, '[0-9a-f]{{32}}') THEN {spelled} ELSE nullif({t}, '') END"


def _whole(df: DataFrame, key: list[str], labels: str | None = None) -> DataFrame:
    """One row of each key, whole: the largest by all its other fields in turn, nulls last."""
    order = [F.array_join(c, "\x1f").desc_nulls_last() if c == labels else F.col(c).desc_nulls_last() for c in df.columns if c not in key]
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def _once(df: DataFrame, key: str, narrow: bool) -> DataFrame:
    """One row of each key. narrow: repeated keys are found by themselves, so that only their rows are shuffled; above FEW of them all rows are."""
    if not narrow:
        return df.dropDuplicates([key])
    twice = cut(df.groupBy(F.col(key).alias("_key")).count().where("count > 1").select("_key"))
    if twice.count() > FEW:
        return df.dropDuplicates([key])
    same = F.col(key).eqNullSafe(F.col("_key"))
    return df.join(F.broadcast(twice), same, "left_anti").unionByName(df.join(F.broadcast(twice), same, "left_semi").dropDuplicates([key]))


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """Versions. Of repeated rows one, whole; a null valid_from is tx_time. All versions of a node lie in one partition,
    so that what follows by (ns, id) needs no other shuffle."""
    n = table(spark, d, "nodes").select("ns", "id", "version_no", *NODE).repartition("ns", "id")
    return _whole(n, ["ns", "id", "version_no"], "labels").withColumn("valid_from", F.coalesce("valid_from", "tx_time"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "edges").select("id", "ns", uuid_key("src").alias("src"), uuid_key("dst").alias("dst"), "edge_type", "weight", F.coalesce("valid_from", "tx_time").alias("valid_from"), "valid_until", "tx_time", "invalidated_at")
    return _whole(e, ["id"])


def sources(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sources")
    empty = F.array().cast("array<string>")
    return s.select("id", "ns", "external_id", F.coalesce("labels", empty).alias("labels"), F.coalesce("alpha", F.lit(1.0)).alias("alpha"), F.coalesce("beta", F.lit(1.0)).alias("beta"), "claims_asserted", "claims_validated", "claims_refuted", "created_at", F.coalesce("updated_at", "created_at").alias("updated_at"))


def assertions(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "assertions")
    a = a.select("assertion_id", uuid_key("claim_id").alias("claim"), uuid_key("source_id").alias("source"), "source_credibility", F.lower(F.trim("assertion_type")).alias("kind"), F.col("epistemic_type").alias("epistemic"), F.col("claim_domain").alias("domain"), "asserted_at")
    return _whole(a, ["assertion_id"])


def vectors(spark: SparkSession, d: str, admitted: bool = True, narrow: bool = False) -> DataFrame:
    """Entries of the vector index: usable vectors of admitted write requests; admitted=False: of all write requests. narrow: see _once."""
    w = table(spark, d, "write_requests").where(usable(F.col("vector"), DIM))
    w = w.where("admitted") if admitted else w
    return _once(w.select("write_id", "ns", uuid_key("node_id").alias("node_id"), F.col("vector").alias("vec"), "content", "received_at"), "write_id", narrow).withColumn("vec", F.col("vec").cast("array<double>"))


def requests(spark: SparkSession, d: str, narrow: bool = False) -> DataFrame:
    """Retrieve requests with a usable vector; t is their point in time. narrow: see _once."""
    r = table(spark, d, "retrieve_requests").where(usable(F.col("vector"), DIM))
    return _once(r.select("retrieve_id", "ns", F.col("vector").alias("vec"), F.when(F.col("top_k") > 0, F.col("top_k")).otherwise(F.lit(10)).alias("top_k"), "labels", F.coalesce("as_of", "requested_at").alias("t"), "seed_ids"), "retrieve_id", narrow).withColumn("vec", F.col("vec").cast("array<double>"))


_GOOD = f"len(vector) = {DIM} AND len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0"
SQL = {
    "n": f"""SELECT ns, id, version_no, {", ".join(NODE).replace("valid_from", "coalesce(valid_from, tx_time) AS valid_from")} FROM nodes
      QUALIFY row_number() OVER (PARTITION BY ns, id, version_no ORDER BY {", ".join(f"{c} DESC NULLS LAST" for c in NODE).replace("labels", "array_to_string(labels, chr(31))").replace("valid_from DESC", "nodes.valid_from DESC")}) = 1""",
    "e": f"""SELECT * FROM (SELECT id, ns, {sql_uuid("src")} AS src, {sql_uuid("dst")} AS dst, edge_type, weight, coalesce(valid_from, tx_time) AS valid_from, valid_until, tx_time, invalidated_at FROM edges)
      QUALIFY row_number() OVER (PARTITION BY id ORDER BY {", ".join(f"{c} DESC NULLS LAST" for c in ["ns", "src", "dst", "edge_type", "weight", "valid_from", "valid_until", "tx_time", "invalidated_at"])}) = 1""",
    "s": "SELECT id, ns, external_id, coalesce(labels, []) AS labels, coalesce(alpha, 1) AS alpha, coalesce(beta, 1) AS beta, claims_asserted, claims_validated, claims_refuted, created_at, coalesce(updated_at, created_at) AS updated_at FROM sources",
    "a": f"""SELECT * FROM (SELECT assertion_id, {sql_uuid("claim_id")} AS claim, {sql_uuid("source_id")} AS source, source_credibility, lower(trim(assertion_type)) AS kind, epistemic_type AS epistemic, claim_domain AS domain, asserted_at FROM assertions)
      QUALIFY row_number() OVER (PARTITION BY assertion_id ORDER BY {", ".join(f"{c} DESC NULLS LAST" for c in ["claim", "source", "source_credibility", "kind", "epistemic", "domain", "asserted_at"])}) = 1""",
    "v": f"""SELECT DISTINCT write_id, ns, {sql_uuid("node_id")} AS node_id, CAST(vector AS DOUBLE[]) AS vec, content, received_at FROM write_requests WHERE admitted AND {_GOOD}""",
    "q": f"""SELECT DISTINCT retrieve_id, ns, CAST(vector AS DOUBLE[]) AS vec, CASE WHEN top_k > 0 THEN top_k ELSE 10 END AS top_k, labels, coalesce(as_of, requested_at) AS t, seed_ids FROM retrieve_requests WHERE {_GOOD}""",
    "latest": "SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY ns, id ORDER BY version_no DESC) = 1",
    "clock": f"SELECT TIMESTAMP '{AS_OF}' AS now",
}
_NEEDS = {"latest": ["n"]}


def sql(body: str, recursive: bool = False, **more: str) -> str:
    """A statement whose WITH defines the views that it names, then the given ones."""
    text = " ".join([body, *more.values()])
    names = [k for k in SQL if re.search(rf"\b(?:FROM|JOIN|,)\s+{k}\b", text)]
    names = list(dict.fromkeys(x for k in names for x in [*_NEEDS.get(k, []), k]))
    parts = [f"{k} AS ({SQL[k]})" for k in names] + [f"{k} AS ({v})" for k, v in more.items()]
    return f"WITH {'RECURSIVE ' * recursive}{', '.join(parts)} {body}"
