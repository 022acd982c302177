"""Expressions over one per-cycle series held as an array in cycle order.

The series of an entity is short by construction (at most the observation
horizon), so the array stays small however many points were recorded.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .curves import bind
from .numeric import col

def fill_gaps(index: Column | str, series: Column | str) -> Column:
    """Linear interpolation over the cycle index; ends held constant; all-missing unchanged."""
    idx, y = col(index), col(series)
    known = F.filter(
        F.zip_with(idx, y, lambda i, v: F.struct(i.cast("double").alias("i"), v.alias("v"))),
        lambda p: p["v"].isNotNull(),
    )

    def at(pts: Column):
        def value(v: Column, pos: Column) -> Column:
            here = F.element_at(idx, pos + 1).cast("double")
            left = F.try_element_at(F.filter(pts, lambda p: p["i"] <= here), F.lit(-1))
            right = F.try_element_at(F.filter(pts, lambda p: p["i"] >= here), F.lit(1))
            between = left["v"] + (right["v"] - left["v"]) * (here - left["i"]) / (right["i"] - left["i"])
            return F.when(v.isNotNull(), v).otherwise(F.coalesce(between, left["v"], right["v"]))

        return F.transform(y, value)

    return bind(
        known,
        lambda pts: F.when((F.size(pts) == 0) | (F.size(pts) == F.size(y)), y).otherwise(at(pts)),
    )
