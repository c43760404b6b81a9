"""Structured Streaming twins of the event operators. Each takes and gives streaming DataFrames; run() drains one into a table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.operators.replication import last_writer
from factloom.session import shared_folder


def events(spark: SparkSession, path: str) -> DataFrame:
    """The event table as a stream: its schema is read, not inferred anew with each file. The path may be a folder or one file,
    which the file source takes only as a pattern."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(f"{path[:-1]}[{path[-1]}]").withColumn("ts", F.col("ts").cast("timestamp"))


def rate_bursts(stream: DataFrame, key: str, seconds: int, least: int, late: str = "1 hour") -> DataFrame:
    """Tumbling windows of a key with more than `least` events; windows close when the watermark passes them."""
    g = stream.withWatermark("ts", late).groupBy(key, F.window("ts", f"{seconds} seconds").alias("w")).agg(F.count("*").alias("n"))
    return g.where(F.col("n") > least).select(key, F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


def sessions(stream: DataFrame, key: str, gap: str, late: str = "1 hour") -> DataFrame:
    """Sessions: events of a key that follow each other within the gap."""
    g = stream.withWatermark("ts", late).groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return g.select(key, F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


def once(stream: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    """Deliveries of one key once, for as long as the watermark remembers."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def live_trust(stream: DataFrame) -> DataFrame:
    """(source, alpha, beta, seen) after each batch, in update mode: Beta parameters from a uniform prior. stream: source, outcome."""
    n = lambda kind: 1.0 + F.sum(F.when(F.col("outcome") == kind, 1.0).otherwise(0.0))
    return stream.groupBy("source").agg(n("validated").alias("alpha"), n("refuted").alias("beta"), F.count("*").alias("seen"))


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def run(stream: DataFrame, mode: str = "append", key: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """Drain what there is into a table in the shared folder. With a key, batches are merged, the last by `order` winning (batch
    number last), so that repeated batches do no harm."""
    spark = stream.sparkSession
    at = _folder(spark)

    def write(df: DataFrame, batch: int) -> None:
        df.withColumn("_batch", F.lit(batch)).write.mode("overwrite").parquet(f"{at}/out/batch={batch}")

    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("_batch", T.IntegerType())])).parquet(f"{at}/out/*")
    return (last_writer(out, key, [*(order or []), "_batch"]) if key else out).drop("_batch")
