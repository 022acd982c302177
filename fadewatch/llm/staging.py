"""Tables written to the folder that all executors share, and small DataFrame helpers."""
from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new folder name under ``spark.checkpoint.dir``; a local one only for a local master that names none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


_scratch: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete the tables that are staged inside at its end, but for those staged with ``keep``.

    Spark removes shuffle files once the driver has collected the plans that made them, as its periodic collection does
    every half hour; here it need not wait for that.
    """
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def staged(df: DataFrame, keep: bool = False) -> DataFrame:
    """Write ``df`` as Parquet and read it back.

    This cuts the lineage, survives a lost executor, and gives the optimizer the real size: later joins with it are
    broadcast only while it is below ``spark.sql.autoBroadcastJoinThreshold`` and shuffled beyond that. A table that
    outlives the innermost ``scratch`` is staged with ``keep``.
    """
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    if len(_scratch) > keep:
        _scratch[-1 - keep].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_key(text: Column | str = "text") -> list[Column]:
    """128 bits that stand for a text (null: empty)."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return [F.xxhash64(t).alias("text_key1"), F.xxhash64(F.lit(7), t).alias("text_key2")]
