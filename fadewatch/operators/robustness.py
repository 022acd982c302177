"""Controlled corruptions of test inputs; models stay trained on clean data."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import hash_normal, hash_uniform
from .features import build_features


def mask_missing(features: DataFrame, columns: Sequence[str], rate: float, key: str = "cell_id", seed: int = 0, repeat: int = 0) -> DataFrame:
    """Set a random share of feature values to missing, independently per entity and column."""
    return features.withColumns(
        {c: F.when(hash_uniform(seed, repeat, F.col(key), c) >= rate, F.col(c)) for c in columns}
    )


def noisy_signals(signals: DataFrame, capacity_sigma: float, voltage_sigma: float, seed: int = 0, repeat: int = 0) -> DataFrame:
    """Gaussian noise on capacities, curves, mean voltage and, through noisy capacity, on energy."""
    n = lambda tag: hash_normal(seed, repeat, F.col("cell_id"), F.col("cycle_idx"), tag)
    qd = F.col("qd") + F.lit(capacity_sigma) * n("qd")
    changes = {
        "qd": qd,
        "qc": F.col("qc") + F.lit(capacity_sigma) * n("qc"),
        "v_dis_avg": F.col("v_dis_avg") + F.lit(voltage_sigma) * n("v"),
        "e_dis": F.col("e_dis") + qd * F.lit(voltage_sigma) * n("e"),
    }
    if "qdlin" in signals.columns:
        changes["qdlin"] = F.transform(
            "qdlin",
            lambda x, i: (x + F.lit(capacity_sigma) * hash_normal(seed, repeat, F.col("cell_id"), F.col("cycle_idx"), F.lit("c"), i)).cast("float"),
        )
    return signals.withColumns(changes)


def noisy_features(signals: DataFrame, feature_set: str, horizons: Sequence[int], capacity_sigma: float, voltage_sigma: float,
                   seed: int = 0, repeat: int = 0, **kw) -> DataFrame:
    return build_features(noisy_signals(signals, capacity_sigma, voltage_sigma, seed, repeat), feature_set, horizons, **kw)


def sparse_features(signals: DataFrame, feature_set: str, horizons: Sequence[int], every: int, **kw) -> DataFrame:
    return build_features(signals, feature_set, horizons, every=every, **kw)


def change_from_baseline(metrics: DataFrame, keys: Sequence[str], label: str, baseline: str, values: Sequence[str], prefix: str = "d") -> DataFrame:
    """Subtract the baseline row (``label`` = ``baseline``) with the same keys from every row.

    A window and not a join: a join would compute the metrics twice, and sums in another order leave the baseline's own change
    at +-1e-13, whose sign a report prints ('+0.0' or '-0.0').
    """
    w = Window.partitionBy(*keys)  # one row per label
    return metrics.withColumns({f"{prefix}{v}": F.col(v) - F.max(F.when(F.col(label) == baseline, F.col(v))).over(w) for v in values})


def condition_summary(metrics: DataFrame, values: Sequence[str] = ("RMSE", "MAE")) -> DataFrame:
    """Mean and std over seeds and repeats of errors and of their change from clean inputs."""
    m = change_from_baseline(metrics, ["seed", "model"], "condition", "clean", values)
    cols = [*values, *[f"d{v}" for v in values]]
    return m.groupBy("condition", "model").agg(
        *[F.avg(c).alias(f"{c}_mean") for c in cols], *[F.stddev_samp(c).alias(f"{c}_std") for c in cols]
    )
