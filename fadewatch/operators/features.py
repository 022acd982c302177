"""Early-life feature sets A-D, the legacy set and the full-curve vector.

One shuffle brings the first cycles of an entity together (their number is
bounded by the longest horizon). Everything else stays in that partitioning:
series are cleaned as arrays per entity and horizon, unfolded to rows for plain
aggregates, and the few curves a horizon needs are picked by as-of aggregates.
All horizons are computed in the same pass.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import curves as cv
from ..functions.batch import spike_free
from ..functions.numeric import EPS, finite, in_range_or_null, ln_eps, log10_abs, positive_or_null, ratio, zero_if_missing
from ..functions.series import fill_gaps
from ..schema import SET_A, SIGNALS, assert_feature_inputs
from .windows import ShortHistoryError

REF = 1          # cycle 2 is the reference cycle
LEVEL_SPAN = 5   # cycles of an end level
CURVE_SAMPLES = 50
BASE_CURVE, FULL_CURVE = 8, 98

# Features of set B and those that set C adds, in table order.
SET_B_NAMES = [
    "qd_ref", "qc_ref", "qd_mean", "qd_std", "qd_retention", "qd_max_minus_ref", "qd_slope", "qd_slope_late",
    "ce_mean", "ce_std", "ce_slope", "v_dis_avg_mean", "v_dis_avg_std", "e_dis_mean",
    "v_q10_last", "v_q50_last", "v_q90_last", "i_chg_mean", "i_chg_std", "i_max",
    "t_chg_mean", "t_dis_mean", "t_cv_mean", "temp_mean", "temp_max", "temp_range", "temp_std",
    "ir_ref", "ir_min", "ir_change",
]
SET_C_EXTRA = [
    "qd_curvature", "qd_slope_last10", "qd_resid_std_last10", "dq_var_log", "dq_min_log", "dq_mean", "dq_rms",
    "dv_q50", "dv_dis_avg", "dqdv_peak_shift", "dqdv_peak_ratio",
    "t_chg_slope", "t_dis_slope", "t_cv_slope", "ir_slope", "temp_slope",
]
SET_D_EXTRA = ["dq2_var_log", "dq2_min_log", "dq2_mean", "dq2_rms"] + [f"dq2_curve_{j:02d}" for j in range(CURVE_SAMPLES)]
FEATURE_SETS = {"A": SET_A, "B": SET_B_NAMES, "C": SET_B_NAMES + SET_C_EXTRA, "D": SET_B_NAMES + SET_C_EXTRA + SET_D_EXTRA}
LEGACY_NAMES = [
    "DeltaQ_Variance", "DeltaQ_Minimum", "Early_Discharge_Capacity", "Max_Min_Capacity_Diff", "Capacity_Fade_Slope",
    "Capacity_Fade_Intercept", "Avg_Charge_Time", "Temperature_Integral", "Min_Internal_Resistance", "IR_Change",
]


def critical_cycles(horizon: int) -> tuple[int, int, int]:
    """First used, reference and last cycle index of a horizon."""
    return 2, min(9, horizon // 2), horizon - 1


# ---------------------------------------------------------------- series

#: Signals that can be cleaned: range or sign rule, spike filter and interpolation for the first three, spike filter for all.
CLEANED = ("qd", "qc", "ir", "v_dis_avg", "e_dis", "t_chg", "t_dis", "t_cv", "temp_max")


def series_rows(
    signals: DataFrame, horizons: Sequence[int], nominal: Column | float = 1.1, every: int = 1, cleaned: Sequence[str] = CLEANED, strict: bool = False,
) -> DataFrame:
    """Raw and cleaned signals, one row per (entity, horizon, retained cycle).

    Cleaned columns: ``cl_qd``, ``cl_qc``, ``cl_ir`` (range or sign rule, spike
    filter, in-window interpolation) and ``hp_*`` (spike filter only), for the
    signals named in ``cleaned``. Only entities that recorded all cycles of a
    horizon get rows for it; with ``strict`` an entity without all cycles of the
    longest one raises when the rows are computed.
    """
    assert_feature_inputs(signals)
    top = max(horizons)
    nominal = nominal if isinstance(nominal, Column) else F.lit(float(nominal))
    inside = F.col("cycle_idx") < top
    early = (signals if strict else signals.filter(inside)).select(
        "cell_id", "cycle_idx", nominal.alias("__nominal"), *[finite(s).alias(s) for s in SIGNALS]
    )
    per_cell = early.groupBy("cell_id").agg(
        F.max("__nominal").alias("__nominal"),
        F.sort_array(F.collect_list(F.when(inside, F.struct("cycle_idx", *SIGNALS)))).alias("__rows"),
    )
    if strict:
        short = F.raise_error(F.concat(F.lit(f"fewer than {top} cycles: cell "), F.col("cell_id").cast("string")))
        per_cell = per_cell.withColumn("__rows", F.when(F.size("__rows") >= top, F.col("__rows")).otherwise(short.cast(per_cell.schema["__rows"].dataType)))
    ts = F.array(*[F.lit(int(t)) for t in sorted(set(horizons))])
    windows = (
        per_cell.withColumn("T", F.explode(F.filter(ts, lambda t: t <= F.size("__rows"))))
        .withColumn("__rows", F.filter(F.slice("__rows", F.lit(1), F.col("T")), lambda r: r["cycle_idx"] % every == 0))
        .filter(F.size("__rows") >= 2)
    )
    take = lambda name: F.transform("__rows", lambda r: r[name])
    lo, hi = F.col("__nominal") * 0.5, F.col("__nominal") * 1.3
    windows = windows.withColumns(
        {
            "__idx": take("cycle_idx"),
            "__qd": F.transform("__rows", lambda r: in_range_or_null(r["qd"], lo, hi)),
            "__qc": F.transform("__rows", lambda r: in_range_or_null(r["qc"], lo, hi)),
            "__ir": F.transform("__rows", lambda r: positive_or_null(r["ir"])),
            **{f"__{s}": take(s) for s in ("v_dis_avg", "e_dis", "t_chg", "t_dis", "t_cv", "temp_max")},
        }
    )
    filtered = list(cleaned)
    windows = windows.withColumns({f"__{s}": spike_free(f"__{s}") for s in filtered})
    windows = windows.withColumns({f"__{s}": fill_gaps("__idx", f"__{s}") for s in filtered if s in ("qd", "qc", "ir")})
    names = {s: ("cl_" if s in ("qd", "qc", "ir") else "hp_") + s for s in filtered}
    zipped = F.arrays_zip(F.col("__rows").alias("raw"), *[F.col(f"__{s}").alias(names[s]) for s in filtered])
    return windows.select("cell_id", "T", F.explode(zipped).alias("z")).select(
        "cell_id", "T", "z.raw.*", *[f"z.{n}" for n in names.values()]
    )


def slope(y: str, where: Column | None = None) -> Column:
    """Least-squares slope per 100 cycles over finite values (at least two)."""
    x = F.col("cycle_idx") / F.lit(100.0)
    v = F.col(y) if where is None else F.when(where, F.col(y))
    return F.regr_slope(v, x)


def curvature(y: str, where: Column, centre: Column) -> Column:
    """Leading coefficient of a quadratic fit over (cycle / 100), at least three finite values.

    Power sums about ``centre`` are shifted to their mean, then the quadratic
    part orthogonal to the line is projected on y.
    """
    ok = where & F.col(y).isNotNull()
    x = (F.col("cycle_idx") - centre) / F.lit(100.0)
    s = lambda e: F.sum(F.when(ok, e))
    v = F.col(y)
    n = F.sum(ok.cast("int"))
    s1, s2, s3, s4 = s(x), s(x * x), s(x * x * x), s(x * x * x * x)
    sy, sxy, sxxy = s(v), s(x * v), s(x * x * v)
    m = s1 / n
    c2 = s2 - n * m * m
    c3 = s3 - 3 * m * s2 + 2 * n * m * m * m
    c4 = s4 - 4 * m * s3 + 6 * m * m * s2 - 3 * n * m * m * m * m
    cxy = sxy - m * sy
    cxxy = sxxy - 2 * m * sxy + m * m * sy
    num = cxxy - ratio(c3, c2) * cxy - c2 / n * sy
    den = c4 - ratio(c3 * c3, c2) - c2 * c2 / n
    return F.when(n >= 3, ratio(num, den))


def level(y: str, a: Column, b: Column) -> Column:
    """Median over cycles a <= idx < b; without any such row, the as-of value at a."""
    i = F.col("cycle_idx")
    inside = (i >= a) & (i < b)
    med = F.percentile(F.when(inside, F.col(y)), F.lit(0.5))
    return F.when(F.sum(inside.cast("int")) > 0, med).otherwise(pick(y, a))


def pick(y: str, k: Column) -> Column:
    """As-of value at cycle k inside a horizon (k is first clipped to it)."""
    i = F.col("cycle_idx")
    boxed = F.struct(F.col(y).alias("x"))
    k = F.greatest(F.least(k, F.col("T") - 1), F.lit(0))
    return F.coalesce(F.max_by(boxed, F.when(i <= k, i)), F.min_by(boxed, i))["x"]


def residual_std(y: str, where: Column) -> Column:
    """Population std around the least-squares line, at least three rows in range."""
    x = F.col("cycle_idx").cast("double")
    v = F.when(where, F.col(y))
    n = F.sum(where.cast("int"))
    sse = F.regr_syy(v, x) - ratio(F.regr_sxy(v, x) * F.regr_sxy(v, x), F.regr_sxx(v, x))
    return F.when((n >= 3) & (F.count(v) == n), F.sqrt(F.greatest(sse, F.lit(0.0)) / n))


def set_a_series() -> dict[str, Column]:
    i, c2 = F.col("cycle_idx"), F.col("T") - 1
    mid = (i >= 2) & (i < c2)
    late = i >= 2
    early_list = F.sort_array(F.collect_list(F.when(mid, F.struct("cycle_idx", "qd"))))
    qd_early = F.try_element_at(early_list, F.least(F.lit(3), F.size(early_list)))["qd"]
    x = (i - 2).cast("double")
    qd = F.when(mid, F.col("qd"))
    ir = F.when(late, F.col("ir"))
    return {
        "qd_early": qd_early,
        "qd_max_minus_early": F.max(qd) - qd_early,
        "qd_slope": F.regr_slope(qd, x),
        "qd_intercept": F.regr_intercept(qd, x),
        "t_early_chg_log": ln_eps(F.coalesce(F.avg(F.when(i < 4, F.col("t_bml_chg"))), F.lit(0.0))),
        "temp_avg_log": ln_eps(F.coalesce(F.avg(F.when(late, F.col("temp_mean"))), F.lit(0.0))),
        "ir_min": F.when(F.count(ir) == F.sum(late.cast("int")), F.min(ir)),
        "ir_change": pick("ir", c2) - pick("ir", F.lit(2)),
    }


def set_b_series() -> dict[str, Column]:
    i, T = F.col("cycle_idx"), F.col("T")
    ce = ratio("cl_qd", "cl_qc")
    end_a, end_b, ref_a, ref_b = T - LEVEL_SPAN, T, F.lit(REF), F.lit(REF + 3)
    after_ref = i >= REF
    return {
        "qd_ref": pick("cl_qd", F.lit(REF)),
        "qc_ref": pick("cl_qc", F.lit(REF)),
        "qd_mean": F.avg("cl_qd"),
        "qd_std": F.stddev_pop("cl_qd"),
        "qd_retention": ratio(level("cl_qd", end_a, end_b), level("cl_qd", ref_a, ref_b)),
        "qd_max_minus_ref": F.max(F.when(after_ref, F.col("cl_qd"))) - pick("cl_qd", F.lit(REF)),
        "qd_slope": slope("cl_qd", after_ref),
        "qd_slope_late": slope("cl_qd", i >= F.floor(T / 2)),
        "ce_mean": F.avg(ce),
        "ce_std": F.stddev_pop(ce),
        "ce_slope": F.regr_slope(ce, i / F.lit(100.0)),
        "v_dis_avg_mean": F.avg("hp_v_dis_avg"),
        "v_dis_avg_std": F.stddev_pop("hp_v_dis_avg"),
        "e_dis_mean": F.avg("hp_e_dis"),
        "i_chg_mean": F.avg("i_chg_mean"),
        "i_chg_std": F.avg("i_chg_std"),
        "i_max": F.max("i_max"),
        "t_chg_mean": F.avg("hp_t_chg"),
        "t_dis_mean": F.avg("hp_t_dis"),
        "t_cv_mean": F.avg("hp_t_cv"),
        "temp_mean": F.avg("temp_mean"),
        "temp_max": F.max("hp_temp_max"),
        "temp_range": F.avg(F.col("temp_max") - F.col("temp_min")),
        "temp_std": F.stddev_pop("temp_mean"),
        "ir_ref": pick("cl_ir", F.lit(REF)),
        "ir_min": F.min("cl_ir"),
        "ir_change": level("cl_ir", end_a, end_b) - level("cl_ir", ref_a, ref_b),
    }


def set_c_series() -> dict[str, Column]:
    i, T = F.col("cycle_idx"), F.col("T")
    last10 = i >= T - 10
    return {
        "qd_curvature": curvature("cl_qd", i >= REF, T / 2),
        "qd_slope_last10": slope("cl_qd", last10),
        "qd_resid_std_last10": residual_std("cl_qd", last10),
        "dv_dis_avg": level("hp_v_dis_avg", T - LEVEL_SPAN, T) - level("hp_v_dis_avg", F.lit(REF), F.lit(REF + 3)),
        "t_chg_slope": slope("hp_t_chg"),
        "t_dis_slope": slope("hp_t_dis"),
        "t_cv_slope": slope("hp_t_cv"),
        "ir_slope": slope("cl_ir"),
        "temp_slope": slope("temp_mean"),
    }


# ---------------------------------------------------------------- curves

def horizon_curves(signals: DataFrame, horizons: Sequence[int], every: int = 1, curve: str = "qdlin") -> DataFrame:
    """Per (entity, horizon) the curves at the reference cycles and at the last cycle.

    Columns ``c_early`` (set A/C reference), ``c_late`` (cycle T) and ``c_ref``
    (cycle 2), each as-of. Only wanted cycles leave the map side.
    """
    ts = sorted(set(int(t) for t in horizons))
    wanted = {"c_early": {t: critical_cycles(t)[1] for t in ts}, "c_late": {t: t - 1 for t in ts}, "c_ref": {t: REF for t in ts}}
    idx = F.col("cycle_idx")
    slots = sorted({min(k, t - 1) for m in wanted.values() for t, k in m.items()})
    kept = F.when(idx % every == 0, idx)
    boxed = F.struct("c")
    per_cell = (
        signals.filter(idx < max(ts)).select("cell_id", "cycle_idx", cv.to_double(curve).alias("c"))
        .groupBy("cell_id").agg(
            F.count("*").alias("__n"),
            *[F.coalesce(F.max_by(boxed, F.when(idx <= k, kept)), F.min_by(boxed, kept))["c"].alias(f"c{k}") for k in slots],
        )
    )
    rows = F.array(
        *[F.struct(F.lit(t).alias("T"), *[F.col(f"c{min(m[t], t - 1)}").alias(n) for n, m in wanted.items()]) for t in ts]
    )
    return per_cell.select("cell_id", "__n", F.inline(rows)).filter("T <= __n").drop("__n")


def curve_features(picked: DataFrame, names: Sequence[str], zero_fill: bool = False, half: int = 10,
                   peak_width: int = 25, peak_margin: int = 50) -> DataFrame:
    """The asked curve-shape features from the picked curves; only what they need is computed.

    ``zero_fill`` (set A) treats an empty difference curve as two zeros, else
    its features are missing.
    """
    need = lambda *parts: any(n.startswith(parts) for n in names)
    drift, peak, delta, fixed = need("dv_"), need("dqdv"), need("dq_"), need("dq2_")
    first = {"s_late": "c_late"}
    if drift or peak:
        first["s_early"] = "c_early"
    if fixed:
        first["s_ref"] = "c_ref"
    if delta:
        first["dq"] = cv.difference("c_late", "c_early")
    s = cv.smoothed(picked, half, **first)
    cols: dict[str, Column] = {}
    if delta:
        points = cv.drop_missing("dq")
        some = F.size(points) > 1
        two_zeros = F.array(F.lit(0.0), F.lit(0.0))
        cols["ma"] = cv.moments(F.when(some, points).otherwise(two_zeros)) if zero_fill else F.when(some, cv.moments(points))
    if fixed:
        s = cv.smoothed(s.withColumn("d2", cv.difference("s_late", "s_ref")), half, d2="d2").withColumn("d2", cv.zero_missing("d2"))
        cols["m2"] = cv.moments("d2")
        cols["pts"] = cv.sample_evenly("d2", CURVE_SAMPLES)
    if peak:
        cols.update(pe=cv.slope_peak("s_early", peak_width, peak_margin), pl=cv.slope_peak("s_late", peak_width, peak_margin))
    fractions = {n: f for n, f in (("v_q10_last", 0.1), ("v_q50_last", 0.5), ("v_q90_last", 0.9)) if n in names or (drift and f == 0.5)}
    cols.update({n: cv.voltage_at_fraction("s_late", f) for n, f in fractions.items()})
    if drift:
        cols["e50"] = cv.voltage_at_fraction("s_early", 0.5)
    s = s.select("cell_id", "T", *[e.alias(n) for n, e in cols.items()])
    ma, m2 = F.col("ma"), F.col("m2")
    log10 = lambda x: F.log10(x + F.lit(EPS))
    exprs = {
        "dq_min_log": lambda: log10_abs(ma["min"]), "dq_var_log": lambda: log10(cv.var_sample(ma)),
        "dq_skew_log": lambda: log10(cv.skew_ratio(ma)), "dq_kurt_log": lambda: log10(cv.kurt_ratio(ma)),
        "dq_mean": lambda: ma["mean"], "dq_rms": lambda: cv.rms(ma),
        **{n: (lambda n=n: F.col(n)) for n in fractions},
        "dv_q50": lambda: F.col("v_q50_last") - F.col("e50"),
        "dqdv_peak_shift": lambda: F.col("pl.v") - F.col("pe.v"), "dqdv_peak_ratio": lambda: ratio("pl.height", "pe.height"),
        "dq2_var_log": lambda: log10(cv.var_sample(m2)), "dq2_min_log": lambda: log10_abs(m2["min"]),
        "dq2_mean": lambda: m2["mean"], "dq2_rms": lambda: cv.rms(m2),
        **{f"dq2_curve_{j:02d}": (lambda j=j: F.try_element_at("pts", F.lit(j + 1))) for j in range(CURVE_SAMPLES)},
    }
    return s.select("cell_id", "T", *[exprs[n]().alias(n) for n in names])


# ---------------------------------------------------------------- sets

def build_features(
    signals: DataFrame, feature_set: str, horizons: Sequence[int], nominal: Column | float = 1.1, every: int = 1,
    half: int = 10, peak_width: int = 25, peak_margin: int = 50, short: str = "fail",
) -> DataFrame:
    """Feature matrix of one set: (cell_id, T, features...), all horizons in one pass.

    An entity without all cycles of every horizon raises when the matrix is
    computed (no job runs before); with ``short='drop'`` it has rows for the
    horizons it covers only.
    ``every`` > 1 keeps cycles 0, k, 2k, ... only. Non-finite values become
    NULL; set A reports 0 instead.
    """
    if feature_set not in FEATURE_SETS:
        raise KeyError(f"unknown feature set {feature_set!r}; known: {sorted(FEATURE_SETS)}")
    if short not in ("fail", "drop"):
        raise ValueError("short is 'fail' or 'drop'")
    if short == "fail" and -(-min(horizons) // every) < 2:
        raise ShortHistoryError(f"{min(horizons)} cycles leave fewer than two of every {every}")
    series = set_a_series() if feature_set == "A" else set_b_series()
    if feature_set in ("C", "D"):
        series.update(set_c_series())
    names = FEATURE_SETS[feature_set]
    rows = series_rows(signals, horizons, nominal, every, () if feature_set == "A" else CLEANED, short == "fail")
    out = rows.groupBy("cell_id", "T").agg(*[e.alias(n) for n, e in series.items()])
    curve_names = [n for n in names if n not in series]
    shape = curve_features(
        horizon_curves(signals, horizons, every), curve_names, feature_set == "A", half, peak_width, peak_margin
    )
    clean = zero_if_missing if feature_set == "A" else finite
    return out.join(shape, ["cell_id", "T"]).select("cell_id", "T", *[clean(n).alias(n) for n in names])


def legacy_features(signals: DataFrame, cycles: tuple[int, int, int] = (1, 9, 99), half: int = 10) -> DataFrame:
    """The earlier ten-column set: missing curve points are zero before smoothing, population variance."""
    assert_feature_inputs(signals)
    a, b, c = cycles
    i = F.col("cycle_idx")
    mid, inc = (i >= a) & (i < c), (i >= a) & (i <= c)
    qd, ir = F.when(mid, F.col("qd")), F.when(inc, F.col("ir"))
    x = (i - a).cast("double")
    at = lambda col, k: F.max(F.when(i == k, F.col(col)))
    first_qd = at("qd", a)
    whole = lambda e, v, m: F.when(F.count(v) == F.sum(m.cast("int")), e)
    t4 = F.when(i < 4, F.col("t_bml_chg"))
    temp = F.when(inc, F.col("temp_mean"))
    rows = signals.filter(i <= c).select(
        "cell_id", "cycle_idx", "qdlin", *[finite(s).alias(s) for s in ("qd", "ir", "t_bml_chg", "temp_mean")]
    )
    scal = rows.groupBy("cell_id").agg(
        first_qd.alias("Early_Discharge_Capacity"),
        whole(F.max(qd) - first_qd, qd, mid).alias("Max_Min_Capacity_Diff"),
        whole(F.regr_slope(qd, x), qd, mid).alias("Capacity_Fade_Slope"),
        whole(F.regr_intercept(qd, x), qd, mid).alias("Capacity_Fade_Intercept"),
        ln_eps(whole(F.avg(t4), t4, i < 4)).alias("Avg_Charge_Time"),
        ln_eps(whole(F.avg(temp), temp, inc)).alias("Temperature_Integral"),
        whole(F.min(ir), ir, inc).alias("Min_Internal_Resistance"),
        (at("ir", c) - at("ir", a)).alias("IR_Change"),
    )
    pair = rows.filter(i.isin(b, c)).groupBy("cell_id").agg(
        F.max_by(cv.to_double("qdlin"), F.when(i == b, i)).alias("e"), F.max_by(cv.to_double("qdlin"), F.when(i == c, i)).alias("l")
    )
    pair = cv.smoothed(pair.withColumn("d", cv.zero_missing(cv.difference("l", "e"))), half, s="d").withColumn("m", cv.moments("s"))
    shape = pair.select(
        "cell_id",
        F.log10(F.col("m.m2") / F.col("m.n") + F.lit(EPS)).alias("DeltaQ_Variance"),
        log10_abs("m.min").alias("DeltaQ_Minimum"),
    )
    return scal.join(shape, "cell_id").select("cell_id", *LEGACY_NAMES)


def full_curve_vector(signals: DataFrame, base: int = BASE_CURVE, cycle: int = FULL_CURVE, half: int = 10) -> DataFrame:
    """Smoothed change of the whole discharge curve between two cycles, one array per entity."""
    i = F.col("cycle_idx")
    pair = signals.filter(i <= cycle).groupBy("cell_id").agg(
        *[
            F.coalesce(F.max_by(F.struct("qdlin"), F.when(i <= k, i)), F.min_by(F.struct("qdlin"), i))["qdlin"].alias(n)
            for n, k in (("b", base), ("c", cycle))
        ]
    )
    pair = cv.smoothed(pair.select("cell_id", cv.to_double("b").alias("b"), cv.to_double("c").alias("c")), half, sb="b", sc="c")
    pair = cv.smoothed(pair.withColumn("d", cv.difference("sc", "sb")), half, s="d")
    return pair.select("cell_id", cv.zero_missing("s").alias("curve_change"))


def expand_curve(df: DataFrame, curve: str, points: int, prefix: str = "q") -> DataFrame:
    """Curve array as columns q000, q001, ..."""
    width = max(3, len(str(points - 1)))
    return df.select(
        *[c for c in df.columns if c != curve],
        *[F.element_at(curve, j + 1).alias(f"{prefix}{j:0{width}d}") for j in range(points)],
    )
