"""Session set-up and the few settings that the library reads from it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_own: dict[str, str] = {}  #: folders of sessions within this process that name none, by application


def build(master: str = "local[*]", name: str = "inkmill", **conf: str) -> SparkSession:
    """A session within one process for tests and benchmarks; on a cluster the caller brings its own, with spark.checkpoint.dir set."""
    if master.split("[")[0] != "local" and "spark.checkpoint.dir" not in conf:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    builder = (
        SparkSession.builder.master(master)
        .appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if "spark.checkpoint.dir" not in conf:
        builder = builder.config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-"))
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the supplied tables, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one that driver and executors share (spark.checkpoint.dir)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        # One process, whose owner set nothing: a folder of its own.
        base = _own.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="spark-")
        _own[spark.sparkContext.applicationId] = base
    return f"{base.rstrip('/')}/inkmill/{uuid.uuid4().hex}"


def spread(df):
    """df over as many tasks as the session has cores at least: a table in one small file would keep all but one idle.

    Larger tables are left as they are, so this moves little data at any size.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def written(df):
    """df as a table in the shared folder: what follows reads it again, and a lost executor costs a re-read only."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
