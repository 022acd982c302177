"""Expressions over one curve held as an array (capacity on a falling voltage grid).

A curve stays in its row: smoothing, differences and look-ups are array
expressions, so they need no shuffle and the row count never grows. Arguments
named ``smoothed`` expect the output of ``batch.running_median``, so that one
smoothed column can serve several look-ups.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batch import running_median
from .numeric import EPS, col

GRID_HIGH_V = 3.6
GRID_LOW_V = 2.0
GRID_POINTS = 1000


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def grid_voltage(i: Column, n: Column, high: float = GRID_HIGH_V, low: float = GRID_LOW_V) -> Column:
    """Voltage at 0-based position ``i`` of an ``n``-point grid from high to low."""
    return F.lit(high) + i * ((F.lit(low) - F.lit(high)) / (n - 1))


def to_double(curve: Column | str) -> Column:
    """Array of double with NaN and infinities as NULL."""
    return F.transform(
        col(curve),
        lambda x: F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x.cast("double")),
    )


def difference(late: Column | str, early: Column | str) -> Column:
    return F.zip_with(col(late), col(early), lambda a, b: a - b)


def drop_missing(curve: Column | str) -> Column:
    return F.filter(col(curve), lambda x: x.isNotNull())


def zero_missing(curve: Column | str) -> Column:
    return F.transform(col(curve), lambda x: F.coalesce(x, F.lit(0.0)))


def smoothed(df: DataFrame, half: int = 10, **curves: Column | str) -> DataFrame:
    """Add one smoothed curve per keyword; a batch function cannot sit inside a lambda, so it gets its own column."""
    return df.withColumns({name: running_median(c, half) for name, c in curves.items()})


def total(curve: Column, f: Callable[[Column], Column] = lambda x: x) -> Column:
    return F.aggregate(curve, F.lit(0.0), lambda acc, x: acc + f(x))


def moments(curve: Column | str) -> Column:
    """Struct(n, mean, min, max_abs, m2, m3, m4) with m_k the sum of k-th centred powers."""
    c = col(curve)
    n = F.size(c)
    return bind(
        total(c) / n,
        lambda mu: F.struct(
            n.alias("n"),
            mu.alias("mean"),
            F.array_min(c).alias("min"),
            total(c, lambda x: x * x).alias("ss"),
            total(c, lambda x: (x - mu) * (x - mu)).alias("m2"),
            total(c, lambda x: (x - mu) * (x - mu) * (x - mu)).alias("m3"),
            total(c, lambda x: (x - mu) * (x - mu) * (x - mu) * (x - mu)).alias("m4"),
        ),
    )


def var_sample(m: Column) -> Column:
    return F.try_divide(m["m2"], m["n"] - 1)


def rms(m: Column) -> Column:
    return F.sqrt(m["ss"] / m["n"])


def skew_ratio(m: Column, eps: float = EPS) -> Column:
    """|mean cubed deviation| / (sample std^3 + eps)."""
    return F.abs(m["m3"] / m["n"]) / (F.pow(F.sqrt(var_sample(m)), F.lit(3.0)) + F.lit(eps))


def kurt_ratio(m: Column, eps: float = EPS) -> Column:
    """mean fourth-power deviation / (sample variance^2 + eps)."""
    v = var_sample(m)
    return (m["m4"] / m["n"]) / (v * v + F.lit(eps))


def running_max(curve: Column | str) -> Column:
    c = col(curve)
    return F.transform(c, lambda _, i: F.array_max(F.slice(c, F.lit(1), i + 1)))


def voltage_at_fraction(smoothed: Column | str, fraction: float, min_points: int = 10) -> Column:
    """Grid voltage at which ``fraction`` of the final capacity of the curve is delivered.

    Takes the smoothed curve and works on its running maximum, with linear
    interpolation between the two bracketing points; NULL with fewer than
    ``min_points`` points. The running maximum first exceeds the target where
    the smoothed curve does, so one search finds the bracket.
    """
    n = F.size(col(smoothed))
    pairs = F.filter(
        F.transform(
            col(smoothed),
            lambda q, i: F.struct(q.alias("q"), grid_voltage(i, n).alias("v")),
        ),
        lambda p: p["q"].isNotNull(),
    )

    def locate(p: Column, q: Column, target: Column, k: Column) -> Column:
        q0, q1 = F.array_max(F.slice(q, F.lit(1), k)), F.element_at(q, k + 1)
        v0, v1 = F.element_at(p, k)["v"], F.element_at(p, k + 1)["v"]
        return (
            F.when(k < 0, F.element_at(p, -1)["v"])
            .when(k == 0, F.element_at(p, 1)["v"])
            .otherwise(v0 + (v1 - v0) * (target - q0) / (q1 - q0))
        )

    def search(p: Column) -> Column:
        return bind(
            F.transform(p, lambda s: s["q"]),
            lambda q: bind(
                F.array_max(q) * F.lit(fraction),
                lambda target: bind(
                    (F.array_position(F.transform(q, lambda x: x > target), True) - 1).cast("int"),
                    lambda k: locate(p, q, target, k),
                ),
            ),
        )

    return bind(pairs, lambda p: F.when(F.size(p) >= min_points, search(p)))


def slope_peak(smoothed: Column | str, width: int = 25, margin: int = 50) -> Column:
    """Struct(v, height) of the main peak of -dQ/dV of a smoothed curve; NULL if a point is missing.

    Central differences (one-sided at the ends), a centred moving mean of
    ``width`` points padded with zeros, then the first maximum among the
    positions that are at least ``margin`` away from both ends. Voltage steps
    come from the number of points between, not from two rounded voltages, so
    that equal rises have equal slopes everywhere and the first of them wins.
    """
    n = F.size(col(smoothed))
    side = width // 2

    def gradient(q: Column) -> Column:
        def at(_, i: Column) -> Column:
            left = F.greatest(i - 1, F.lit(0))
            right = F.least(i + 1, n - 1)
            rise = F.element_at(q, right + 1) - F.element_at(q, left + 1)
            return -rise / ((right - left) * F.lit(GRID_LOW_V - GRID_HIGH_V) / (n - 1))

        return F.transform(q, at)

    def best(g: Column) -> Column:
        def at(j: Column) -> Column:
            first = F.greatest(j - side, F.lit(0))
            last = F.least(j + side, n - 1)
            return F.struct(
                (total(F.slice(g, first + 1, last - first + 1)) / F.lit(float(width))).alias("height"),
                (-j).alias("neg"),
            )

        inner = F.transform(F.sequence(F.lit(margin), n - margin - 1), at)
        return bind(
            F.array_max(inner),
            lambda m: F.struct(grid_voltage(-m["neg"], n).alias("v"), m["height"].alias("height")),
        )

    complete = lambda q: F.size(drop_missing(q)) == n
    return bind(
        col(smoothed),
        lambda q: F.when(complete(q) & (n > 2 * margin), bind(gradient(q), best)),
    )


def sample_evenly(curve: Column | str, points: int = 50) -> Column:
    """Values at ``points`` evenly spaced positions (half-even rounding of the position)."""
    c = col(curve)
    step = (F.size(c) - 1) / F.lit(float(points - 1))
    return F.transform(
        F.sequence(F.lit(0), F.lit(points - 1)),
        lambda j: F.element_at(c, F.bround(j * step, 0).cast("int") + 1),
    )
