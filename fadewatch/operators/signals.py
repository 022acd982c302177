"""Points -> one row of signals per cycle.

Time differences and the trapezoid integrals need the previous point. Points
are therefore ordered inside blocks of consecutive point numbers, each block is
condensed to one row with its sums and its first and last points, and the rows
of a cycle are then combined, adding the step across each block border. A cycle
with any number of points is processed by many tasks.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import finite, ratio

# Current and voltage limits of the charging regimes.
REST_CURRENT_A = 0.05
DISCHARGE_CURRENT_A = 0.1
CV_VOLTAGE_V = 3.595

BLOCK_POINTS = 1 << 18

DURATIONS = {"t_bml_chg": "neg", "t_chg": "chg", "t_dis": "dis", "t_cv": "cv", "t_rest": "rest"}


def regimes(i: Column | str = "i", v: Column | str = "v") -> dict[str, Column]:
    """Regime predicates; a missing current or voltage is in no regime that needs it."""
    i = F.col(i) if isinstance(i, str) else i
    v = F.col(v) if isinstance(v, str) else v
    yes = lambda c: F.coalesce(c, F.lit(False))
    return {
        "neg": yes(i < 0),
        "chg": yes(i > REST_CURRENT_A),
        "dis": yes(i < -DISCHARGE_CURRENT_A),
        "cv": yes((i > REST_CURRENT_A) & (v >= CV_VOLTAGE_V)),
        "rest": yes(F.abs(i) <= REST_CURRENT_A),
    }


def _trapezoid(v: Column, q: Column, pv: Column, pq: Column) -> Column:
    return (q - pq) * (v + pv) / 2


def _poisoned(total: Column, missing: Column) -> Column:
    """A sum is missing when one of its terms was."""
    return F.when(missing == 0, total)


def cycle_signals(points: DataFrame, cycle_keys: Sequence[str] = ("cell_id", "cycle_idx"),
                  block_points: int = BLOCK_POINTS) -> DataFrame:
    """Signals of every cycle except ``ir`` (a scalar of the cycle table).

    ``points`` has the cycle keys, ``pt_idx``, ``t``, ``i``, ``v``, ``temp``,
    ``qd``, ``qc`` and optionally ``valid`` (False: arrays of unequal length).
    Cycles with fewer than three points or not valid keep NULL signals.
    """
    keys = list(cycle_keys)
    valid = F.col("valid") if "valid" in points.columns else F.lit(True)
    rows = points.select(
        *keys, "pt_idx", *[finite(c).alias(c) for c in ("t", "i", "v", "temp", "qd", "qc")],
        valid.alias("valid"), F.floor(F.col("pt_idx") / block_points).alias("__block"),
    ).withColumns(regimes())

    block = [*keys, "__block"]
    order = Window.partitionBy(*block).orderBy("pt_idx")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    vq = {"dis": F.struct(F.col("v").alias("v"), F.col("qd").alias("q")),
          "chg": F.struct(F.col("v").alias("v"), F.col("qc").alias("q"))}
    rows = rows.select(
        "*",
        (F.col("t") - F.lag("t").over(order)).alias("dt"),
        (F.row_number().over(order) == 1).alias("__first"),
        *[F.last(F.when(F.col(r), vq[r]), ignorenulls=True).over(earlier).alias(f"__p_{r}") for r in vq],
        F.first(F.when(F.col("chg"), F.col("i")), ignorenulls=True).over(so_far).alias("__i0"),
    )

    c = F.col
    has_prev = lambda r: c(r) & c(f"__p_{r}").isNotNull()
    area = {
        r: F.when(has_prev(r), _trapezoid(c("v"), c("qd" if r == "dis" else "qc"), c(f"__p_{r}")["v"], c(f"__p_{r}")["q"]))
        for r in vq
    }
    hole = {r: (c(r) & (c("v").isNull() | c("qd" if r == "dis" else "qc").isNull())).cast("int") for r in vq}
    weight = F.when(c("chg"), c("dt"))
    shifted = c("i") - c("__i0")
    edge = F.struct("t", "i", *DURATIONS.values())
    blocks = rows.groupBy(*block).agg(
        F.count("*").alias("n"),
        F.min("valid").alias("valid"),
        F.max("qd").alias("qd"), F.max("qc").alias("qc"),
        *[F.sum(F.when(c(f), c("dt"))).alias(k) for k, f in DURATIONS.items()],
        *[F.sum((c(f) & c("dt").isNull() & ~c("__first")).cast("int")).alias(f"__no_{k}") for k, f in DURATIONS.items()],
        *[F.sum(area[r]).alias(f"__area_{r}") for r in vq],
        *[F.sum(hole[r]).alias(f"__hole_{r}") for r in vq],
        *[F.sum(c(r).cast("int")).alias(f"__n_{r}") for r in vq],
        F.max(F.when(c("dis"), c("qd"))).alias("__qd_hi"), F.min(F.when(c("dis"), c("qd"))).alias("__qd_lo"),
        F.min_by(F.when(c("chg"), c("__i0")), F.when(c("chg"), c("pt_idx"))).alias("__i0"),
        F.sum(weight * shifted).alias("__s1"),
        F.sum(weight * shifted * shifted).alias("__s2"),
        F.sum(weight).alias("__s0"),
        F.max(F.abs("i")).alias("i_max"),
        F.sum("temp").alias("__temp_sum"), F.count("temp").alias("__temp_n"),
        F.max("temp").alias("temp_max"), F.min("temp").alias("temp_min"),
        F.min_by(edge, "pt_idx").alias("__head"), F.max_by("t", "pt_idx").alias("__tail_t"),
        *[F.min_by(F.when(c(r), vq[r]), F.when(c(r), c("pt_idx"))).alias(f"__head_{r}") for r in vq],
        *[F.max_by(F.when(c(r), vq[r]), F.when(c(r), c("pt_idx"))).alias(f"__tail_{r}") for r in vq],
    )

    # one row per block from here on: add the steps across block borders
    seq = Window.partitionBy(*keys).orderBy("__block")
    past = seq.rowsBetween(Window.unboundedPreceding, -1)
    upto = seq.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = blocks.select(
        "*",
        (F.row_number().over(seq) == 1).alias("__first"),
        (c("__head")["t"] - F.lag("__tail_t").over(seq)).alias("__gap"),
        *[F.last(c(f"__tail_{r}"), ignorenulls=True).over(past).alias(f"__p_{r}") for r in vq],
        F.first(c("__i0"), ignorenulls=True).over(upto).alias("__ref"),
    )
    gap = F.when(c("__first"), F.lit(0.0)).otherwise(c("__gap"))
    step = {k: F.when(c("__head")[f], gap) for k, f in DURATIONS.items()}
    lost = {k: (c("__head")[f] & gap.isNull()).cast("int") for k, f in DURATIONS.items()}
    border = {
        r: F.when(
            c(f"__head_{r}").isNotNull() & c(f"__p_{r}").isNotNull(),
            _trapezoid(c(f"__head_{r}")["v"], c(f"__head_{r}")["q"], c(f"__p_{r}")["v"], c(f"__p_{r}")["q"]),
        )
        for r in vq
    }
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    # move the block's shifted sums from its own origin to the origin of the cycle
    move = c("__i0") - c("__ref")
    head_w = zero(step["t_chg"])
    head_d = zero(c("__head")["i"] - c("__ref"))
    s0 = zero(c("__s0")) + head_w
    s1 = zero(c("__s1") + move * c("__s0")) + head_w * head_d
    s2 = zero(c("__s2") + 2 * move * c("__s1") + move * move * c("__s0")) + head_w * head_d * head_d
    cycles = blocks.groupBy(*keys).agg(
        F.sum("n").alias("n_points"),
        F.min("valid").alias("valid"),
        F.max("qd").alias("qd"), F.max("qc").alias("qc"),
        *[_poisoned(F.sum(zero(c(k)) + zero(step[k])), F.sum(c(f"__no_{k}") + lost[k])).alias(k) for k in DURATIONS],
        *[F.abs(_poisoned(F.sum(zero(c(f"__area_{r}")) + zero(border[r])), F.sum(f"__hole_{r}"))).alias(f"__area_{r}") for r in vq],
        *[F.sum(f"__n_{r}").alias(f"__n_{r}") for r in vq],
        (F.max("__qd_hi") - F.min("__qd_lo")).alias("__span"),
        F.sum(s0).alias("__s0"), F.sum(s1).alias("__s1"), F.sum(s2).alias("__s2"),
        F.min_by("__ref", F.when(c("__ref").isNotNull(), c("__block"))).alias("__ref"),
        F.max("i_max").alias("i_max"),
        ratio(F.sum("__temp_sum"), F.sum("__temp_n")).alias("temp_mean"),
        F.max("temp_max").alias("temp_max"), F.min("temp_min").alias("temp_min"),
    )
    e_dis = F.when(c("__n_dis") > 2, c("__area_dis"))
    charged = (c("__n_chg") > 2) & (c("__s0") > 0) & c("t_chg").isNotNull()
    m = c("__s1") / c("__s0")
    signals = {
        "qd": c("qd"), "qc": c("qc"),
        **{k: c(k) for k in DURATIONS},
        "e_dis": e_dis,
        "e_chg": F.when(c("__n_chg") > 2, c("__area_chg")),
        "v_dis_avg": F.when(c("__span") > 0, ratio(e_dis, c("__span"))),
        "i_chg_mean": F.when(charged, c("__ref") + m),
        "i_chg_std": F.when(charged, F.sqrt(F.greatest(c("__s2") / c("__s0") - m * m, F.lit(0.0)))),
        **{k: c(k) for k in ("i_max", "temp_mean", "temp_max", "temp_min")},
    }
    ok = c("valid") & (c("n_points") >= 3)
    return cycles.select(*keys, "n_points", *[F.when(ok, x).alias(k) for k, x in signals.items()])


def assemble_signals(points: DataFrame, cycles: DataFrame, t_max: int, curve_points: int = 1000,
                     block_points: int = BLOCK_POINTS) -> DataFrame:
    """Signal table of the first ``t_max`` cycles: signals, resistance, cycle number and accepted curves."""
    early = F.col("cycle_idx") < t_max
    sig = cycle_signals(points.filter(early), block_points=block_points)
    meta = cycles.filter(early).select(
        "cell_id", "cycle_idx", "cycle_number", finite("ir").alias("ir"),
        F.when(F.size("qdlin") == curve_points, F.col("qdlin")).alias("qdlin"),
    )
    return meta.join(sig, ["cell_id", "cycle_idx"], "left").withColumn(
        "ir", F.when(F.col("n_points") >= 3, F.col("ir"))
    )


def capacity_trajectory(points: DataFrame) -> DataFrame:
    """Capacity of every recorded cycle: only for labels, never a feature input."""
    return points.groupBy("cell_id", "cycle_idx").agg(
        F.max(finite("qd")).alias("qd_full")
    )


def discharge_curve(points: DataFrame, limits: DataFrame, keys: Sequence[str] = ("cell_id", "cycle_idx"),
                    curve_points: int = 1000, block_points: int = BLOCK_POINTS) -> DataFrame:
    """Capacity on an even voltage grid from raw discharge points, highest voltage first.

    Each pair of neighbouring discharge points (by voltage) emits only the grid
    positions it covers, so the join is a bounded expansion and not a range
    search. Points of one voltage follow each other by ``pt_idx``. Grid positions
    outside the observed range are missing, its ends are inside; a cycle with at
    most two discharge points gives zeros. ``limits`` has ``cell_id``,
    ``min_voltage_v`` and ``max_voltage_v``.
    """
    keys = list(keys)
    dis = (
        points.filter(F.col("i") < -DISCHARGE_CURRENT_A)
        .select(*keys, finite("v").alias("v"), finite("qd").alias("q"), "pt_idx")
        .filter("v IS NOT NULL AND q IS NOT NULL")
        .join(limits.select("cell_id", "min_voltage_v", "max_voltage_v"), "cell_id")
    )
    step = (F.col("max_voltage_v") - F.col("min_voltage_v")) / (curve_points - 1)
    dis = dis.withColumn(
        # all points beyond the grid share one interval on each side
        "__bin", F.greatest(F.lit(-1), F.least(F.lit(curve_points), F.floor((F.col("v") - F.col("min_voltage_v")) / step)))
    )
    # the grid only sees the points next to it: keep the extreme points of every grid interval and bridge them
    ends = dis.groupBy(*keys, "min_voltage_v", "max_voltage_v", "__bin").agg(
        F.min_by(F.struct("v", "q"), F.struct("v", "pt_idx")).alias("lo"),
        F.max_by(F.struct("v", "q"), F.struct("v", "pt_idx")).alias("hi"),
        F.count("*").alias("n"),
    )
    w = Window.partitionBy(*keys).orderBy("__bin")
    bridged = ends.select(
        *keys, "min_voltage_v", "max_voltage_v", "n", "__bin", "lo", "hi", F.lag("hi").over(w).alias("left"),
    )
    v_at = lambda j: F.col("min_voltage_v") + j * step
    # grid positions in (left.v, lo.v]; position of the very first point when it lies on the grid
    first_j = F.when(F.col("left").isNull(), F.ceil((F.col("lo.v") - F.col("min_voltage_v")) / step)).otherwise(
        F.floor((F.col("left.v") - F.col("min_voltage_v")) / step) + 1
    )
    last_j = F.floor((F.col("lo.v") - F.col("min_voltage_v")) / step)
    span = F.when(
        F.greatest(first_j, F.lit(0)) <= F.least(last_j, F.lit(curve_points - 1)),
        F.sequence(F.greatest(first_j, F.lit(0)), F.least(last_j, F.lit(curve_points - 1))),
    )
    vals = F.transform(
        span,
        lambda j: F.struct(
            j.cast("int").alias("j"),
            F.when(F.col("left").isNull() | (F.col("lo.v") == F.col("left.v")), F.col("lo.q"))
            .otherwise(
                F.col("left.q") + (F.col("lo.q") - F.col("left.q")) * (v_at(j) - F.col("left.v"))
                / (F.col("lo.v") - F.col("left.v"))
            ).alias("q"),
        ),
    )
    per_cycle = bridged.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.map_from_entries(F.flatten(F.collect_list(vals))).alias("m")
    )
    grid = F.sequence(F.lit(curve_points - 1), F.lit(0), F.lit(-1))
    curve = F.transform(grid, lambda j: F.try_element_at(F.col("m"), j))
    zeros = F.transform(grid, lambda j: F.lit(0.0))
    return per_cycle.select(*keys, F.when(F.col("n") > 2, curve).otherwise(zeros).alias("qdlin"))
