"""A handle on a store of facts: tables as DataFrames, namespaces with writing, retrieval, ingestion and the query language.

    engine = Engine.open(spark, "/data/facts")        # or Engine(spark) for an empty one
    space = engine.namespace("harbor/claims", "belief")
    space.write(rows)                                   # write_id, content, source_id, labels, vector, ... -> results
    space.retrieve(vectors, top_k=5)                    # retrieve_id, vec -> ranked nodes
    engine.query('FIND "a text" IN harbor/claims LIMIT 5 RETURN id, score')

Writes are batches: each is judged against what was stored before it. State is kept as checkpointed DataFrames; save() writes it."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from factloom.dsl.execute import hashed_vector, run
from factloom.dsl.language import parse
from factloom.functions import beta
from factloom.functions.score import MODES
from factloom.operators import extract, retrieve, search, temporal, write
from factloom.session import cut
from factloom.sources import views

SCHEMAS = {
    "nodes": "ns string, id string, version_no bigint, labels array<string>, source_id string, mem_type string, epistemic_type string, utility double, fingerprint string, confidence double, tx_time timestamp_ntz, valid_from timestamp_ntz, valid_until timestamp_ntz",
    "edges": "id string, ns string, src string, dst string, edge_type string, weight double, valid_from timestamp_ntz, valid_until timestamp_ntz, tx_time timestamp_ntz, invalidated_at timestamp_ntz",
    "sources": "id string, ns string, external_id string, labels array<string>, alpha double, beta double, claims_asserted bigint, claims_validated bigint, claims_refuted bigint, created_at timestamp_ntz, updated_at timestamp_ntz",
    "entries": "write_id bigint, ns string, node_id string, vec array<double>, content string, received_at timestamp_ntz",
}
WRITE = {"write_id": "bigint", "content": "string", "source_id": "string", "labels": "array<string>", "vector": "array<float>", "confidence": "double", "valid_from": "timestamp_ntz", "mem_type": "string", "dedup": "boolean", "received_at": "timestamp_ntz"}


class Engine:
    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame] | None = None, dim: int = 64, embed: Callable[[str], list[float]] = hashed_vector, near: search.Search = search.topk, rerankers: dict | None = None, auto_embed: bool = False) -> None:
        """tables: nodes, edges, sources, entries of the form of SCHEMAS; missing ones are empty. near: the search, exact or in cells.
        auto_embed: whether contents written without a vector get that of embed."""
        self.auto_embed = auto_embed
        self.spark, self.dim, self.embed, self.near, self.rerankers = spark, dim, embed, near, rerankers
        self.tables = {k: (tables or {}).get(k, spark.createDataFrame([], s)) for k, s in SCHEMAS.items()}

    @classmethod
    def open(cls, spark: SparkSession, folder: str, **options) -> Engine:
        """Over the parquet tables nodes, edges, sources and write_requests of a folder."""
        of = {"nodes": views.nodes, "edges": views.edges, "sources": views.sources, "entries": views.vectors}
        return cls(spark, {k: f(spark, folder) for k, f in of.items()}, **options)

    def namespace(self, name: str, mode: str = "general") -> Namespace:
        return Namespace(self, name, mode)

    def ping(self) -> dict:
        return {"status": "ok", "spark": self.spark.version}

    def stats(self) -> dict:
        """Rows of each table, and nodes by their latest versions."""
        return {k: df.count() for k, df in self.tables.items()} | {"latest": temporal.latest(self.tables["nodes"]).count()}

    def query(self, text: str, now: datetime | None = None) -> DataFrame:
        """A query in either spelling of the language."""
        now = now or datetime.now()
        t = self.tables
        return run(parse(text, now), t["nodes"], t["entries"], t["edges"], t["sources"], now, self.embed, rerankers=self.rerankers)

    def save(self, folder: str) -> None:
        for k, df in self.tables.items():
            df.write.mode("overwrite").parquet(f"{folder}/{k}")


class Namespace:
    def __init__(self, engine: Engine, name: str, mode: str) -> None:
        if mode not in MODES:
            raise ValueError(f"no mode {mode!r}; there are {', '.join(MODES)}")
        self.engine, self.name, self.mode = engine, name, MODES[mode]

    def _own(self, table: str) -> DataFrame:
        return self.engine.tables[table].where(F.col("ns") == self.name)

    def _credibility(self) -> DataFrame:
        return self._own("sources").select("ns", F.col("external_id").alias("source_id"), beta.effective(F.col("labels"), F.col("alpha"), F.col("beta")).alias("credibility"))

    def write(self, rows: DataFrame, now: datetime | None = None) -> DataFrame:
        """Judge and store a batch; its results. rows: of the columns of WRITE those at hand; unknown sources are added with even odds."""
        e, now = self.engine, now or datetime.now()
        t = F.lit(now).cast("timestamp_ntz")
        cols = [(F.col(c) if c in rows.columns else F.lit(None)).cast(kind).alias(c) for c, kind in WRITE.items()]
        w = rows.select(*cols)
        if e.auto_embed:
            embed = e.embed

            def filled(pdfs):
                for pdf in pdfs:
                    pdf["vector"] = [embed(c) if (v is None or not len(v)) and c else v for v, c in zip(pdf.vector, pdf.content)]
                    yield pdf

            w = w.mapInPandas(filled, w.schema)
        w = cut(w.withColumns({"ns": F.lit(self.name), "received_at": F.coalesce("received_at", t)}))
        new = w.where("source_id is not null").select(F.col("source_id").alias("external_id")).distinct().join(self._own("sources").select("external_id"), "external_id", "left_anti")
        zero = F.lit(0).cast("bigint")
        made = new.select(F.sha2("external_id", 256).alias("id"), F.lit(self.name).alias("ns"), "external_id", F.array().cast("array<string>").alias("labels"), F.lit(1.0).alias("alpha"), F.lit(1.0).alias("beta"), zero.alias("claims_asserted"), zero.alias("claims_validated"), zero.alias("claims_refuted"), t.alias("created_at"), t.alias("updated_at"))
        e.tables["sources"] = cut(e.tables["sources"].unionByName(made))
        out = write.write_batch(w, self._own("nodes"), self._own("entries"), self._credibility(), t, self.mode.admit, e.dim, e.near)
        results = cut(out["results"])
        for name in ("nodes", "edges", "entries"):
            more = out[name].select(*[(F.col(f) if f in out[name].columns else F.lit(None)).cast(e.tables[name].schema[f].dataType).alias(f) for f in e.tables[name].columns])
            e.tables[name] = e.tables[name].unionByName(more)
        e.tables["nodes"] = e.tables["nodes"].unionByName(out["touched"].select(*e.tables["nodes"].columns))
        e.tables["edges"] = e.tables["edges"].withColumns({"valid_from": F.coalesce("valid_from", t), "tx_time": F.coalesce("tx_time", t)})
        for name in ("nodes", "edges", "entries"):
            e.tables[name] = cut(e.tables[name])
        return results

    def retrieve(self, requests: DataFrame, top_k: int = 10, now: datetime | None = None, labels: list[str] | None = None, hybrid: bool = True, rerank: Callable | None = None, **options) -> DataFrame:
        """Ranked nodes for each request (retrieve_id, vec and perhaps seeds); with labels, those that have all of them."""
        t = F.lit(now or datetime.now()).cast("timestamp_ntz")
        none = F.array().cast("array<string>")
        q = requests.withColumns({"ns": F.lit(self.name), "t": t, "top_k": F.lit(top_k), "labels": F.array(*map(F.lit, labels)).cast("array<string>") if labels else none})
        q = q if "seeds" in q.columns else q.withColumn("seeds", none)
        found = retrieve.retrieve(q, temporal.latest(self._own("nodes")), self._own("entries"), self.mode.weights, edges=self._own("edges") if hybrid else None, labels=bool(labels), **options)
        return retrieve.rerank(found, rerank) if rerank else found

    def search(self, text: str, **options) -> DataFrame:
        """Ranked nodes for one text."""
        one = self.engine.spark.range(1).select(F.col("id").alias("retrieve_id"), F.array(*[F.lit(float(x)) for x in self.engine.embed(text)]).alias("vec"))
        return self.retrieve(one, **options)

    def stream_retrieve(self, requests: DataFrame, **options) -> Iterator[Row]:
        """The rows of retrieve one by one, by request and rank, partition after partition."""
        yield from self.retrieve(requests, **options).orderBy("retrieve_id", "rank").toLocalIterator()

    def ingest_text(self, texts: DataFrame, model: Callable[[str], str | None], now: datetime | None = None) -> DataFrame:
        """Entities and relations that a model finds in texts (text_id, text, source_id), written like all else; the results of the entities."""
        e, t = self.engine, F.lit(now or datetime.now()).cast("timestamp_ntz")
        answers = cut(extract.asked(texts.withColumn("ns", F.lit(self.name)), model))
        found = cut(extract.entities(answers).where("error is null"))
        rows = found.join(texts.select("text_id", "source_id"), "text_id").select(F.xxhash64("id").alias("write_id"), F.col("content"), "source_id", "labels", "confidence", F.col("id").alias("entity"), F.lit(True).alias("dedup"))
        results = self.write(rows, now)
        node = rows.join(results.select("write_id", "node_id", "admitted"), "write_id").where("admitted").select("entity", "node_id", "source_id")
        links = extract.relations(answers).join(node.select(F.col("entity").alias("src"), F.col("node_id").alias("a")), "src").join(node.select(F.col("entity").alias("dst"), F.col("node_id").alias("b")), "dst")
        new = links.select(F.sha2(F.concat_ws("|", "a", "edge_type", "b"), 256).alias("id"), "ns", F.col("a").alias("src"), F.col("b").alias("dst"), "edge_type", "weight", t.alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_until"), t.alias("tx_time"), F.lit(None).cast("timestamp_ntz").alias("invalidated_at")).dropDuplicates(["id"])
        e.tables["edges"] = cut(write.upsert_edges(e.tables["edges"], new))
        said = node.groupBy(F.col("source_id").alias("external_id")).agg(F.count("*").alias("_n"))
        s = e.tables["sources"].join(said, "external_id", "left")
        e.tables["sources"] = cut(s.withColumn("claims_asserted", F.when(F.col("ns") == self.name, F.coalesce("claims_asserted", F.lit(0)) + F.coalesce("_n", F.lit(0))).otherwise(F.col("claims_asserted"))).select(*e.tables["sources"].columns))
        return results

    def label_source(self, external_id: str, labels: list[str], now: datetime | None = None) -> None:
        e = self.engine
        e.tables["sources"] = cut(write.label_source(e.tables["sources"], self.name, external_id, labels, F.lit(now or datetime.now()).cast("timestamp_ntz")))

    def history(self, node: str) -> DataFrame:
        return temporal.history(self._own("nodes"), self.name, node)

    def as_of(self, t: datetime) -> DataFrame:
        return temporal.as_of(self._own("nodes"), F.lit(t).cast("timestamp_ntz"))

    def acquisitions(self, budget: int = 10, now: datetime | None = None) -> DataFrame:
        """What to find out next."""
        from factloom.operators import epistemics as ep
        from factloom.operators import graph

        t = F.lit(now or datetime.now()).cast("timestamp_ntz")
        return ep.acquisitions(ep.active_learning(temporal.valid_nodes(self._own("nodes"), t), graph.active(self._own("edges"), t), t), budget)
