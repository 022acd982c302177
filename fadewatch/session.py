"""Session helpers: a local session for tests and a lineage cut for clusters."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("fadewatch")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the cluster's checkpoint folder and cut its lineage.

    Used where a result feeds several later jobs (iterative fits, sampled
    attributions), so that a lost executor costs one re-read, not a re-run.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return df.checkpoint(eager=True)


def work_folder(spark: SparkSession) -> str:
    """A new folder name below the folder that all executors share; a local one only for a local master without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def store(df: DataFrame) -> DataFrame:
    """Write ``df`` by columns to a work folder and read it from there: a lineage cut for tables that many later passes scan.

    A checkpoint keeps rows as Java objects; reading those took longer than most passes.
    """
    path = work_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
