"""Session settings and the shared folder that cuts lineage."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Settings that the engine expects; cluster sizes (executors, shuffle partitions) stay with the caller.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(cores: int = 8, partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    b = SparkSession.builder.master(f"local[{cores}]").appName("factloom").config(map=SETTINGS)
    b = b.config("spark.sql.shuffle.partitions", str(partitions)).config("spark.driver.memory", memory)
    b = b.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a session: executors need not have it on their path."""
    sc = spark.sparkContext
    if getattr(sc, "_factloom_sent", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    sc.addPyFile(shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="factloom-"), "factloom"), "zip", root, "factloom"))
    sc._factloom_sent = True


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only a session on one machine may go without: then a temporary folder serves; on a
    cluster each machine would see another one, so that is an error."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named and not (sc.master or "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return named or tempfile.mkdtemp(prefix="factloom-")


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut lineage with checkpoint() in the shared folder. Checkpoints that nothing refers to any more are removed by Spark where
    spark.cleaner.referenceTracking.cleanCheckpoints is set, as in SETTINGS."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    done = df.checkpoint(eager)
    # A checkpoint keeps the estimated size of what it was made from, and joins multiply these: in a loop the numbers grow to
    # thousands of digits. The same rows without an estimate leave broadcasts to adaptive execution, which knows true sizes.
    jdf = done._jdf
    plain = df.sparkSession._jsparkSession.internalCreateDataFrame(jdf.queryExecution().toRdd(), jdf.schema(), False)
    return DataFrame(plain, df.sparkSession)


def micros(x):
    """Microseconds since 1970 of a timestamp with or without zone (UTC session)."""
    from pyspark.sql import functions as F

    return F.unix_micros(x.cast("timestamp"))
