"""Observation windows over per-cycle tables."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import assert_feature_inputs


class ShortHistoryError(ValueError):
    """An entity has fewer cycles than the observation window asks for."""


def prefix(df: DataFrame, horizon: int, key: str = "cell_id", index: str = "cycle_idx", short: str = "fail") -> DataFrame:
    """Cycles 0..horizon-1 of every entity.

    Entities with fewer cycles raise (``short='fail'``, one extra aggregate)
    or are dropped (``short='drop'``).
    """
    assert_feature_inputs(df)
    _known(short)
    rows = df.filter(F.col(index) < horizon)
    counts = rows.groupBy(key).agg(F.count("*").alias("__n"))
    if short == "fail":
        bad = counts.filter(F.col("__n") < horizon).limit(3).collect()
        if bad:
            raise ShortHistoryError(f"fewer than {horizon} cycles, e.g. {[(r[key], r['__n']) for r in bad]}")
        return rows
    return rows.join(counts.filter(F.col("__n") >= horizon).select(key), key, "left_semi")


def keep_every(df: DataFrame, every: int, key: str = "cell_id", index: str = "cycle_idx", short: str = "fail") -> DataFrame:
    """Cycles 0, k, 2k, ...; entities that retain fewer than two of them raise, or are dropped with ``short='drop'``."""
    _known(short)
    counts = df.groupBy(key).agg(F.sum((F.col(index) % every == 0).cast("int")).alias("__n"))
    rows = df.filter(F.col(index) % every == 0)
    if short == "fail":
        bad = counts.filter("__n < 2").limit(3).collect()
        if bad:
            raise ShortHistoryError(f"fewer than two cycles of every {every}, e.g. {[(r[key], r['__n']) for r in bad]}")
        return rows
    return rows.join(counts.filter("__n >= 2").select(key), key, "left_semi")


def require_cycles(signals: DataFrame, horizons: Sequence[int], every: int = 1, key: str = "cell_id", index: str = "cycle_idx") -> None:
    """Raise if an entity lacks cycles of a horizon, or retains fewer than two of them."""
    top = max(horizons)
    if -(-min(horizons) // every) < 2:
        raise ShortHistoryError(f"{min(horizons)} cycles leave fewer than two of every {every}")
    counts = signals.select(key, F.when(F.col(index) < top, 1).alias("__in")).groupBy(key).agg(F.count("__in").alias("__n"))
    bad = counts.filter(F.col("__n") < top).limit(3).collect()
    if bad:
        raise ShortHistoryError(f"fewer than {top} cycles, e.g. {[(r[key], r['__n']) for r in bad]}")


def _known(short: str) -> None:
    if short not in ("fail", "drop"):
        raise ValueError("short is 'fail' or 'drop'")


def in_cycles(a: int, b: int, index: str = "cycle_idx") -> Column:
    """Half-open cycle range a <= index < b."""
    return (F.col(index) >= a) & (F.col(index) < b)


def as_of(value: Column | str, k: Column | int, index: Column | str = "cycle_idx") -> Column:
    """Aggregate: value at cycle k, else at the nearest retained cycle before it, else at the first one.

    A missing value at the chosen cycle is returned as missing.
    """
    value = F.col(value) if isinstance(value, str) else value
    index = F.col(index) if isinstance(index, str) else index
    k = k if isinstance(k, Column) else F.lit(k)
    boxed = F.struct(value.alias("x"))
    return F.coalesce(F.max_by(boxed, F.when(index <= k, index)), F.min_by(boxed, index))["x"]


def with_horizons(df: DataFrame, horizons: Sequence[int], index: str = "cycle_idx") -> DataFrame:
    """Repeat every cycle for each horizon that covers it."""
    ts = F.array(*[F.lit(int(t)) for t in sorted(set(horizons))])
    return df.withColumn("T", F.explode(F.filter(ts, lambda t: t > F.col(index))))
