"""Life labels from whole capacity trajectories, and their comparison."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .order_stats import _join, quantiles


def end_of_life(
    trajectory: DataFrame, key: str = "cell_id", capacity: str = "qd_full", nominal: str = "nominal_capacity_ah",
    soh: float = 0.8, pad: bool = True, min_life: float = 100.0,
) -> DataFrame:
    """Cycle-life label: first 0-based cycle at or below soh x nominal, plus 2.

    Entities that never fall that low get their cycle count plus 2 (``pad``) or
    no label; labels of at most ``min_life`` cycles are excluded (NULL). One
    aggregate with map-side combine, so a hot entity costs no more than others.
    """
    low = F.col(capacity) <= F.lit(soh) * F.col(nominal)
    agg = trajectory.groupBy(key).agg(
        F.min(F.when(low, F.col("cycle_idx"))).alias("__first"), F.count("*").alias("n_cycles_recorded")
    )
    never = F.col("n_cycles_recorded") + 2 if pad else F.lit(None).cast("long")
    life = F.coalesce(F.col("__first") + 2, never).cast("double")
    return agg.select(key, F.when(life > min_life, life).alias("label"), "n_cycles_recorded")


def recorded_cycles(trajectory: DataFrame, key: str = "cell_id") -> DataFrame:
    return trajectory.groupBy(key).agg(F.count("*").cast("double").alias("legacy_label"))


def label_table(trajectory: DataFrame, cells: DataFrame, partition: DataFrame, key: str = "cell_id", **kw) -> DataFrame:
    """Both labels, their difference and the partition of every entity."""
    rows = trajectory.join(cells.select(key, "nominal_capacity_ah"), key)
    both = end_of_life(rows, key, **kw).withColumn("legacy_label", F.col("n_cycles_recorded").cast("double"))
    return both.join(partition.select(key, "partition"), key).select(
        key, "partition", "label", "legacy_label", "n_cycles_recorded", (F.col("legacy_label") - F.col("label")).alias("difference")
    )


def label_comparison(labels: DataFrame) -> DataFrame:
    """How far the two labels differ over all entities."""
    d = F.abs("difference")
    return labels.agg(
        F.avg("difference").alias("mean_difference"), F.max(d).alias("max_difference"),
        F.sum((d > 0).cast("int")).alias("n_differ"), F.corr("label", "legacy_label").alias("correlation"),
    )


def life_summary(labels: DataFrame, by: Sequence[str] = ("partition",), life: str = "label") -> DataFrame:
    """Count, min, max, mean and median life per partition."""
    basic = labels.groupBy(*by).agg(
        F.count(life).alias("n"), F.min(life).alias("min_life"), F.max(life).alias("max_life"), F.avg(life).alias("mean_life")
    )
    return _join(basic, quantiles(labels, by, life, {"median_life": 0.5}), by, "left")
