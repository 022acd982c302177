"""Readers and writers of telemetry, feature, prediction and selection tables."""
from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import finite, format_g
from ..operators.splits import assert_disjoint, assert_one_row_each, assert_same_ids, assert_unique
from ..schema import RAW_CELL


class MissingCellsError(LookupError):
    """Wanted entities have no data."""


# ------------------------------------------------------------- telemetry

def read_raw_cells(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Nested records, one per entity, with a fixed schema (no inference pass over the data)."""
    return spark.read.schema(RAW_CELL).format(fmt).load(path)


def cells_table(raw: DataFrame) -> DataFrame:
    return raw.select(
        "cell_id", F.col("nominal_capacity_in_Ah").alias("nominal_capacity_ah"), F.col("min_voltage_limit_in_V").alias("min_voltage_v"),
        F.col("max_voltage_limit_in_V").alias("max_voltage_v"), "charge_protocol",
    )


def cycles_table(raw: DataFrame) -> DataFrame:
    return raw.select("cell_id", F.posexplode("cycle_data").alias("cycle_idx", "c")).select(
        "cell_id", "cycle_idx", "c.cycle_number", F.col("c.internal_resistance_in_ohm").alias("ir"),
        F.col("c.Qdlin").cast("array<float>").alias("qdlin"),
    )


def points_table(raw: DataFrame) -> DataFrame:
    """One row per point, non-finite values as NULL; ``valid`` is False when time and current have unequal lengths."""
    arrays = {"t": "time_in_s", "i": "current_in_A", "v": "voltage_in_V", "temp": "temperature_in_C",
              "qd": "discharge_capacity_in_Ah", "qc": "charge_capacity_in_Ah"}
    rows = raw.select("cell_id", F.posexplode("cycle_data").alias("cycle_idx", "c"))
    rows = rows.select(
        "cell_id", "cycle_idx", (F.size("c.time_in_s") == F.size("c.current_in_A")).alias("valid"),
        F.posexplode(F.arrays_zip(*[F.coalesce(F.col(f"c.{src}"), F.array().cast("array<double>")).alias(k) for k, src in arrays.items()])).alias("pt_idx", "p"),
    )
    return rows.select("cell_id", "cycle_idx", F.col("pt_idx").cast("long").alias("pt_idx"), *[finite(f"p.{k}").alias(k) for k in arrays], "valid")


def available_cells(points: DataFrame, key: str = "cell_id") -> DataFrame:
    return points.select(key).distinct().orderBy(key)


def missing_cells(wanted: DataFrame, have: DataFrame, key: str = "cell_id") -> DataFrame:
    return wanted.select(key).distinct().join(have.select(key).distinct(), key, "left_anti")


def require_cells(wanted: DataFrame, have: DataFrame, key: str = "cell_id") -> None:
    """Raise with the number of missing entities and up to three of them."""
    gone = missing_cells(wanted, have, key)
    row = gone.agg(F.count("*").alias("n"), F.min(key).alias("first")).first()
    if row["n"]:
        sample = [r[key] for r in gone.orderBy(key).limit(3).collect()]
        raise MissingCellsError(f"{row['n']} cells missing (e.g. {sample}); build the signal table first")


def new_cells(source: DataFrame, sink: DataFrame, key: str = "cell_id") -> DataFrame:
    """Rows of entities that the sink does not hold yet."""
    return source.join(sink.select(key).distinct(), key, "left_anti")


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def write_signals(signals: DataFrame, path: str, partition: str | None = None, incremental: bool = False) -> None:
    """Materialise the per-cycle table once, in ranges of (entity, cycle).

    Files then hold few entities and prune by their id, and one long-lived
    entity spreads over several files. ``incremental`` appends only entities
    that are not present yet.
    """
    spark = signals.sparkSession
    rows, mode = signals, "overwrite"
    if incremental and _exists(spark, path):
        rows, mode = new_cells(signals, spark.read.parquet(path)), "append"
    w = rows.repartitionByRange("cell_id", "cycle_idx").sortWithinPartitions("cell_id", "cycle_idx").write.mode(mode)
    (w.partitionBy(partition) if partition else w).option("compression", "zstd").parquet(path)


def read_signals(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


# ------------------------------------------------------------- protocols

def protocol_columns(cells: DataFrame) -> DataFrame:
    """Two-step charging protocol as scalars and as a text code; another number of steps raises."""
    steps = F.when(F.size("charge_protocol") == 2, F.col("charge_protocol")).otherwise(
        F.raise_error(F.concat(F.lit("not a two-step protocol: cell "), F.col("cell_id").cast("string"))).cast(cells.schema["charge_protocol"].dataType)
    )
    out = cells.withColumn("__s", steps).withColumns(
        {"c1": F.col("__s")[0]["rate_in_C"], "soc_switch": F.col("__s")[0]["end_soc"], "c2": F.col("__s")[1]["rate_in_C"]}
    ).drop("__s")
    code = F.concat(format_g("c1"), F.lit("C("), format_g("soc_switch"), F.lit("%)-"), format_g("c2"), F.lit("C"))
    return out.withColumn("protocol", code)


def protocol_table(cells: DataFrame) -> DataFrame:
    """Protocols with the flag 'seen in training' for test entities (column ``partition`` needed)."""
    p = protocol_columns(cells)
    train = p.filter(F.col("partition") == "train").select("protocol").distinct().withColumn("__seen", F.lit(True))
    return p.join(train, "protocol", "left").withColumn(
        "protocol_seen_in_train", F.coalesce("__seen", F.lit(False)) & (F.col("partition") == "test")
    ).drop("__seen")


# ------------------------------------------------------------- manifests, features, results

def write_manifests(path: str, train: DataFrame, test: DataFrame, folds: DataFrame, key: str = "cell_id") -> None:
    assert_disjoint({"train": train, "test": test}, key)
    for name, df in (("train_cells", train), ("test_cells", test), ("cv_folds", folds)):
        df.write.mode("overwrite").option("header", True).csv(f"{path}/{name}")


def read_manifests(spark: SparkSession, path: str, key: str = "cell_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Train, test and fold tables; raises on overlap or when folds do not cover exactly the training entities."""
    life = f"{key} string, cycle_life double"
    train, test = (spark.read.option("header", True).schema(life).csv(f"{path}/{n}") for n in ("train_cells", "test_cells"))
    folds = spark.read.option("header", True).schema(f"{key} string, fold int").csv(f"{path}/cv_folds")
    assert_disjoint({"train": train, "test": test}, key)
    assert_same_ids(folds, train, key)
    for df in (train, test, folds):
        assert_unique(df, key)
    return train, test, folds


def write_features(features: DataFrame, path: str, feature_set: str) -> None:
    """Feature matrix of one set, partitioned by (feature_set, T) so that a reader prunes to one matrix.

    A second run replaces the matrices that it writes and leaves all others.
    """
    (features.withColumn("feature_set", F.lit(feature_set)).repartitionByRange("T", "cell_id")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("feature_set", "T").parquet(path))


def read_features(spark: SparkSession, path: str, feature_set: str, horizon: int, columns: Sequence[str],
                  partition: DataFrame | None = None) -> DataFrame:
    """One matrix with its columns; with ``partition`` every entity must be in the manifest exactly once."""
    df = spark.read.option("mergeSchema", True).parquet(path).filter((F.col("feature_set") == feature_set) & (F.col("T") == horizon))
    out = df.select("cell_id", "T", *columns)
    if partition is not None:
        assert_one_row_each(out, partition, "cell_id")
        out = out.join(partition.select("cell_id", "partition"), "cell_id")
    return out


PREDICTION_COLUMNS = ["model", "seed", "partition", "cell_id", "y_true", "y_pred"]


class BrokenBatchError(AssertionError):
    """A committed batch does not hold the rows that its manifest states."""


def write_attempt(df: DataFrame, path: str, batch: str) -> str:
    """Write the rows of a batch without committing them; the attempt's name."""
    attempt = f"a{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/data/batch=b-{batch}/attempt={attempt}")
    return attempt


def commit_attempt(spark: SparkSession, path: str, batch: str, attempt: str) -> None:
    """Make an attempt the one that counts for its batch.

    The manifest entry is one small file that is written last and names the attempt and its rows. A job that dies before
    leaves the batch as it was, and one that runs again replaces what it wrote before.
    """
    n = spark.read.parquet(f"{path}/data/batch=b-{batch}/attempt={attempt}").count()
    entry = spark.createDataFrame([(attempt, n)], "attempt string, n_rows long")
    entry.coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/batch=b-{batch}")


def append_predictions(preds: DataFrame, path: str, batch: str) -> None:
    """Add a batch to the prediction log (model, seed, partition, cell_id, y_true, y_pred).

    A batch is one unit of work, named by the caller (a run, a fold). Running it again replaces it, so the log never holds
    a prediction twice; batches do not touch each other.
    """
    attempt = write_attempt(preds.select(*PREDICTION_COLUMNS), path, batch)
    commit_attempt(preds.sparkSession, path, batch, attempt)


def read_predictions(spark: SparkSession, path: str, check: bool = False) -> DataFrame:
    """Rows of all committed batches with their ``batch``; attempts that were not committed or were replaced are not read.

    With ``check`` the rows of each batch are counted against its manifest first.
    """
    commits = spark.read.parquet(f"{path}/commits")
    data = spark.read.parquet(f"{path}/data").join(commits.select("batch", "attempt"), ["batch", "attempt"], "left_semi")
    if check:
        found = data.groupBy("batch").agg(F.count("*").alias("n"))
        bad = commits.join(found, "batch", "left").filter(F.coalesce("n", F.lit(0)) != F.col("n_rows")).select("batch").first()
        if bad is not None:
            raise BrokenBatchError(f"batch {bad['batch'][2:]} does not hold the rows of its manifest")
    return data.select(F.substring("batch", 3, 1 << 20).alias("batch"), *PREDICTION_COLUMNS)


def write_small(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Selections, weights and best parameters: a handful of rows."""
    df.coalesce(1).write.mode("overwrite").format(fmt).save(path)
