"""What a model's answers say: entities, relations and claims as rows, and the whole of a text's ingestion."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import hashed_uuid

# What is assumed of an entity's confidence, a relation's weight, a claim's confidence and type where an answer says nothing.
ENTITY_CONFIDENCE, RELATION_WEIGHT, CLAIM_CONFIDENCE, CLAIM_TYPE = 0.7, 0.8, 0.7, "assertion"

_ANSWER = "struct<entities: array<struct<name: string, type: string>>, relations: array<struct<subject: string, predicate: string, object: string, weight: double>>>"
_CLAIM = "struct<content: string, labels: array<string>, confidence: double, epistemic_type: string>"


def unfenced(answer: Column | str) -> Column:
    """An answer without the fence of code that models like to put around JSON."""
    c = F.col(answer) if isinstance(answer, str) else answer
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), r"^```(?:json)?", ""), r"```$", ""))


def _parsed(answers: DataFrame, schema: str, key: str) -> DataFrame:
    """Answers with `said`, and `error` where they can't be read as an object of the form."""
    said = F.from_json(unfenced("answer"), schema)
    whole = F.get_json_object(unfenced("answer"), "$")
    ok = whole.startswith("{")
    return answers.withColumn("said", F.when(ok, said)).withColumn("error", F.when(~F.coalesce(ok, F.lit(False)), F.concat(F.lit("can't be read: "), F.substring(F.coalesce("answer", F.lit("")), 1, 80))))


def entities(answers: DataFrame) -> DataFrame:
    """(text_id, ns, id, content, labels, confidence, error): nodes of the entities that answers name, or one row with an error.

    answers: text_id, ns, answer (JSON with entities and relations, perhaps fenced). Of several entities of one name in an answer the first
    counts; ids depend on namespace, text and name. Entities without a name are left out; null answers are errors."""
    p = _parsed(answers, _ANSWER, "entities")
    bad = p.where("error is not null").select("text_id", "ns", F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("content"), F.array().cast("array<string>").alias("labels"), F.lit(None).cast("double").alias("confidence"), "error")
    e = p.where("error is null").select("text_id", "ns", F.posexplode("said.entities").alias("pos", "e")).where("e.name is not null and e.name <> ''")
    e = e.groupBy("text_id", "ns", "e.name").agg(F.min_by("e.type", "pos").alias("type"))
    good = e.select("text_id", "ns", hashed_uuid("ns", "text_id", "name").alias("id"), F.col("name").alias("content"), F.array_compact(F.array("type")).alias("labels"), F.lit(ENTITY_CONFIDENCE).alias("confidence"), F.lit(None).cast("string").alias("error"))
    return good.unionByName(bad)


def relations(answers: DataFrame) -> DataFrame:
    """(text_id, ns, src, dst, edge_type, weight): edges between entities that the same answer names; others are left out. A weight that is null, 0
    or less is the default."""
    p = _parsed(answers, _ANSWER, "relations").where("error is null")
    names = F.transform(F.coalesce("said.entities", F.from_json(F.lit("[]"), "array<struct<name: string, type: string>>")), lambda x: x["name"])
    r = p.select("text_id", "ns", names.alias("names"), F.explode("said.relations").alias("r")).where(F.array_contains("names", F.col("r.subject")) & F.array_contains("names", F.col("r.object")))
    w = F.when(F.col("r.weight") > 0, F.col("r.weight")).otherwise(RELATION_WEIGHT)
    return r.select("text_id", "ns", hashed_uuid("ns", "text_id", "r.subject").alias("src"), hashed_uuid("ns", "text_id", "r.object").alias("dst"), F.col("r.predicate").alias("edge_type"), w.alias("weight")).distinct()


def claims(answers: DataFrame) -> DataFrame:
    """(text_id, content, labels, confidence, epistemic_type, error): the one claim that each answer states, with defaults."""
    p = _parsed(answers, _CLAIM, "content")
    c = F.col("said")
    return p.select("text_id", c["content"].alias("content"), F.coalesce(c["labels"], F.array().cast("array<string>")).alias("labels"), F.when(F.coalesce(c["confidence"], F.lit(0.0)) != 0, c["confidence"]).when(F.col("error").isNull(), CLAIM_CONFIDENCE).alias("confidence"), F.when(F.col("error").isNull(), F.coalesce(F.nullif(c["epistemic_type"], F.lit("")), F.lit(CLAIM_TYPE))).alias("epistemic_type"), "error")


def asked(texts: DataFrame, model: Callable[[str], str | None]) -> DataFrame:
    """texts (text_id bigint, ns, text) with the `answer` of a callable; a failure gives null. A callable that always gives the same is the static extractor."""

    def run(pdfs):
        for pdf in pdfs:
            out = []
            for t in pdf.text:
                try:
                    out.append(model(t) if t else None)
                except Exception:
                    out.append(None)
            yield pdf.assign(answer=out)

    return texts.select("text_id", "ns", "text").mapInPandas(run, "text_id bigint, ns string, text string, answer string")


def ingested(answers: DataFrame, admitted: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes of the entities that pass a gate, edges of which both ends passed, and (ns, text_id, nodes): how many claims each text asserted,
    for the counter of its source. admitted: from entities (ns, id, content, labels, confidence) to those kept."""
    nodes = admitted(entities(answers).where("error is null").drop("error"))
    keep = nodes.select("ns", "id").distinct()
    e = relations(answers).join(keep.withColumnRenamed("id", "src"), ["ns", "src"], "left_semi").join(keep.withColumnRenamed("id", "dst"), ["ns", "dst"], "left_semi")
    return nodes, e, nodes.groupBy("ns", "text_id").agg(F.count("*").alias("nodes"))
