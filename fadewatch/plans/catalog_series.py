"""Queries over points, per-cycle series, curves and feature sets."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import curves as cv
from ..functions.batch import spike_free
from ..functions.numeric import in_range_or_null, positive_or_null, ratio, zero_if_missing
from ..functions.series import fill_gaps
from ..operators import features as ft
from ..operators import labels as lb
from ..operators import signals as sg
from ..operators import windows as wn
from ..operators.order_stats import with_sequence_position
from .bindings import (
    CURVE_POINTS, CURVED_SQL, HORIZONS, PAIRS_SQL, POINTS_SQL, SERIES_SQL, curve_pairs, curved_series, points, query, series,
    smooth_sql, table,
)

# ------------------------------------------------------------- points -> cycles

_SIGNALS_SQL = POINTS_SQL + """,
d AS (SELECT *, coalesce(t - lag(t) OVER (PARTITION BY cell_id, cycle_idx ORDER BY pt_idx), 0.0) AS dt FROM pts),
base AS (
  SELECT cell_id, cycle_idx, count(*) AS n_points, max(qd) AS qd, max(qc) AS qc,
    coalesce(sum(dt) FILTER (WHERE i < 0), 0.0) AS t_bml_chg, coalesce(sum(dt) FILTER (WHERE i > 0.05), 0.0) AS t_chg,
    coalesce(sum(dt) FILTER (WHERE i < -0.1), 0.0) AS t_dis, coalesce(sum(dt) FILTER (WHERE i > 0.05 AND v >= 3.595), 0.0) AS t_cv,
    coalesce(sum(dt) FILTER (WHERE abs(i) <= 0.05), 0.0) AS t_rest, max(abs(i)) AS i_max,
    avg(temp) AS temp_mean, max(temp) AS temp_max, min(temp) AS temp_min,
    CASE WHEN count(*) FILTER (WHERE i > 0.05) > 2 AND sum(dt) FILTER (WHERE i > 0.05) > 0
      THEN sum(i * dt) FILTER (WHERE i > 0.05) / sum(dt) FILTER (WHERE i > 0.05) END AS i_chg_mean
  FROM d GROUP BY ALL),
spread AS (
  SELECT d.cell_id, d.cycle_idx, sqrt(sum(d.dt * (d.i - b.i_chg_mean) * (d.i - b.i_chg_mean)) / sum(d.dt)) AS i_chg_std
  FROM d JOIN base b USING (cell_id, cycle_idx) WHERE d.i > 0.05 AND b.i_chg_mean IS NOT NULL GROUP BY ALL),
dis AS (SELECT *, lag(v) OVER w AS pv, lag(qd) OVER w AS pq FROM pts WHERE i < -0.1
  WINDOW w AS (PARTITION BY cell_id, cycle_idx ORDER BY pt_idx)),
disa AS (SELECT cell_id, cycle_idx, abs(sum((qd - pq) * (v + pv) / 2)) AS e_dis, max(qd) - min(qd) AS span FROM dis
  GROUP BY ALL HAVING count(*) > 2),
chg AS (SELECT *, lag(v) OVER w AS pv, lag(qc) OVER w AS pq FROM pts WHERE i > 0.05
  WINDOW w AS (PARTITION BY cell_id, cycle_idx ORDER BY pt_idx)),
chga AS (SELECT cell_id, cycle_idx, abs(sum((qc - pq) * (v + pv) / 2)) AS e_chg FROM chg GROUP BY ALL HAVING count(*) > 2),
sig AS (
  SELECT b.*, s.i_chg_std, x.e_dis, y.e_chg, CASE WHEN x.span > 0 THEN x.e_dis / x.span END AS v_dis_avg
  FROM base b LEFT JOIN spread s USING (cell_id, cycle_idx) LEFT JOIN disa x USING (cell_id, cycle_idx)
    LEFT JOIN chga y USING (cell_id, cycle_idx) WHERE n_points >= 3)"""
_SIGNAL_COLS = "qd qc t_bml_chg t_chg t_dis t_cv t_rest e_dis e_chg v_dis_avg i_chg_mean i_chg_std i_max temp_mean temp_max temp_min"


@query("C1-C2 C4-C17 W1 P4 P5", f"WITH {_SIGNALS_SQL} SELECT cell_id, cycle_idx, n_points, {', '.join(_SIGNAL_COLS.split())} FROM sig", _SIGNAL_COLS, 5)
def cycle_signals(spark, sf):
    return sg.cycle_signals(points(spark, sf)).filter("n_points >= 3")


@query("C1-C2 C4-C17 (blocks of 4,096 point numbers: border steps)",
       f"WITH {_SIGNALS_SQL} SELECT cell_id, cycle_idx, n_points, {', '.join(_SIGNAL_COLS.split())} FROM sig", _SIGNAL_COLS, 5)
def cycle_signals_small_blocks(spark, sf):
    return sg.cycle_signals(points(spark, sf), block_points=4096).filter("n_points >= 3")


@query("P4", f"""WITH {POINTS_SQL} SELECT cell_id, cycle_idx, count(*) AS n, CAST(sum(CASE WHEN i > 0.05 THEN 1 ELSE 0 END) AS BIGINT) AS n_chg,
  CAST(sum(CASE WHEN i < -0.1 THEN 1 ELSE 0 END) AS BIGINT) AS n_dis, CAST(sum(CASE WHEN i > 0.05 AND v >= 3.595 THEN 1 ELSE 0 END) AS BIGINT) AS n_cv,
  CAST(sum(CASE WHEN abs(i) <= 0.05 THEN 1 ELSE 0 END) AS BIGINT) AS n_rest, CAST(sum(CASE WHEN i < 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_neg
  FROM pts GROUP BY ALL""")
def regime_counts(spark, sf):
    p = points(spark, sf).withColumns(sg.regimes())
    return p.groupBy("cell_id", "cycle_idx").agg(
        F.count("*").alias("n"), *[F.sum(F.col(r).cast("int")).alias(f"n_{r}") for r in ("chg", "dis", "cv", "rest", "neg")]
    )


@query("C3 C18", f"""WITH {_SIGNALS_SQL} SELECT s.cell_id, s.cycle_idx, s.cycle_idx + 1 AS cycle_number,
    CASE WHEN m.ir > 0.2 THEN NULL ELSE m.ir END AS ir, s.qd, s.e_dis, CASE WHEN s.cycle_idx % 2 = 0 THEN 64 END AS curve_len
  FROM sig s JOIN (SELECT cell_id, cycle_idx, min(temp) / 200.0 AS ir FROM pts GROUP BY ALL) m USING (cell_id, cycle_idx) WHERE cycle_idx < 3""",
       "ir qd e_dis", 5)
def assembled_signals(spark, sf):
    p = points(spark, sf)
    ir = F.min("temp") / 200.0
    meta = p.groupBy("cell_id", "cycle_idx").agg(F.when(ir > 0.2, F.lit(None)).otherwise(ir).alias("ir")).select(
        "cell_id", "cycle_idx", (F.col("cycle_idx") + 1).alias("cycle_number"), "ir",
        F.array_repeat(F.lit(1.0), F.when(F.col("cycle_idx") % 2 == 0, CURVE_POINTS).otherwise(CURVE_POINTS - 1)).cast("array<float>").alias("qdlin"),
    )
    out = sg.assemble_signals(p, meta, t_max=3, curve_points=CURVE_POINTS)
    return out.filter("n_points >= 3").select("cell_id", "cycle_idx", "cycle_number", "ir", "qd", "e_dis", F.size("qdlin").alias("curve_len"))


@query("C19", f"WITH {POINTS_SQL} SELECT cell_id, cycle_idx, max(qd) AS qd_full FROM pts GROUP BY ALL", "qd_full")
def capacity_trajectory(spark, sf):
    return sg.capacity_trajectory(points(spark, sf))


@query("FX3 J7", f"""WITH {POINTS_SQL},
  dis AS (SELECT cell_id, cycle_idx, pt_idx, v, qd FROM pts WHERE i < -0.1),
  big AS (SELECT cell_id, cycle_idx, count(*) AS n FROM dis GROUP BY ALL),
  grid AS (SELECT j, 3.0 + j * (0.8 / 39) AS v FROM range(40) g(j)),
  ordered AS (SELECT *, lead(v) OVER w AS v2, lead(qd) OVER w AS q2, lag(v) OVER w AS v0 FROM dis WINDOW w AS (PARTITION BY cell_id, cycle_idx ORDER BY v, pt_idx)),
  hit AS (SELECT o.cell_id, o.cycle_idx, g.j, o.qd + (o.q2 - o.qd) * (g.v - o.v) / (o.v2 - o.v) AS q
    FROM ordered o JOIN grid g ON g.v > o.v AND g.v <= o.v2
    UNION ALL SELECT o.cell_id, o.cycle_idx, g.j, o.qd FROM ordered o JOIN grid g ON g.v = o.v WHERE o.v0 IS NULL)
  SELECT b.cell_id, b.cycle_idx, 39 - g.j AS v_idx, CASE WHEN b.n > 2 THEN h.q ELSE 0.0 END AS q
  FROM big b CROSS JOIN grid g LEFT JOIN hit h ON h.cell_id = b.cell_id AND h.cycle_idx = b.cycle_idx AND h.j = g.j""", "q", 5)
def discharge_curve_on_grid(spark, sf):
    p = points(spark, sf)
    limits = p.select("cell_id").distinct().select("cell_id", F.lit(3.0).alias("min_voltage_v"), F.lit(3.8).alias("max_voltage_v"))
    return sg.discharge_curve(p, limits, curve_points=40).select("cell_id", "cycle_idx", F.posexplode("qdlin").alias("v_idx", "q"))


@query("W1 (positions of an unbounded series)", """SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos FROM events""")
def sequence_positions(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id")
    return with_sequence_position(e, ["user_id"], "event_id", "pos")


# ------------------------------------------------------------- labels

_FULL_SQL = """full_ev AS (SELECT user_id AS cell_id, count(*) OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS cycle_idx, value AS qd_full FROM events)"""


def _full(spark, sf):
    e = with_sequence_position(table(spark, sf, "events").select("user_id", "event_id", "value"), ["user_id"], "event_id", "cycle_idx")
    return e.select(F.col("user_id").alias("cell_id"), "cycle_idx", F.col("value").alias("qd_full"), F.lit(5.0).alias("nominal_capacity_ah"))


_LABEL_SQL = _FULL_SQL + """, lab AS (SELECT cell_id, count(*) AS n_cycles_recorded,
  CAST(coalesce(min(CASE WHEN qd_full <= 0.8 * 5.0 THEN cycle_idx END) + 2, count(*) + 2) AS DOUBLE) AS life FROM full_ev GROUP BY ALL),
  labs AS (SELECT cell_id, CASE WHEN life > 4 THEN life END AS label, n_cycles_recorded FROM lab)"""


@query("L1 L2", f"WITH {_LABEL_SQL} SELECT * FROM labs", "label")
def end_of_life_label(spark, sf):
    return lb.end_of_life(_full(spark, sf), min_life=4.0)


_LABEL_TABLE_SQL = _LABEL_SQL + """, lt AS (SELECT cell_id, CASE WHEN cell_id % 2 = 1 THEN 'train' ELSE 'test' END AS partition, label,
  CAST(n_cycles_recorded AS DOUBLE) AS legacy_label, n_cycles_recorded, n_cycles_recorded - label AS difference FROM labs)"""


def _label_table(spark, sf):
    full = _full(spark, sf)
    ids = full.select("cell_id").distinct()
    part = ids.withColumn("partition", F.when(F.col("cell_id") % 2 == 1, "train").otherwise("test"))
    return lb.label_table(full.drop("nominal_capacity_ah"), ids.withColumn("nominal_capacity_ah", F.lit(5.0)), part, min_life=4.0)


@query("S7", f"WITH {_LABEL_TABLE_SQL} SELECT * FROM lt", "label legacy_label difference")
def label_table(spark, sf):
    return _label_table(spark, sf)


@query("L3", f"""WITH {_LABEL_TABLE_SQL} SELECT avg(difference) AS mean_difference, max(abs(difference)) AS max_difference,
  CAST(sum(CASE WHEN abs(difference) > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_differ,
  corr(label, legacy_label) AS correlation FROM lt""", "mean_difference max_difference correlation")
def label_comparison(spark, sf):
    return lb.label_comparison(_label_table(spark, sf))


@query("L3", f"""WITH {_LABEL_TABLE_SQL} SELECT partition, count(label) AS n, min(label) AS min_life, max(label) AS max_life,
  avg(label) AS mean_life, quantile_cont(label, 0.5) AS median_life FROM lt GROUP BY ALL""", "min_life max_life mean_life median_life")
def life_by_partition(spark, sf):
    return lb.life_summary(_label_table(spark, sf))


# ------------------------------------------------------------- windows over series

@query("P1", f"""WITH {SERIES_SQL} SELECT cell_id, cycle_idx, qd, ir FROM series WHERE cycle_idx < 20
  AND cell_id IN (SELECT cell_id FROM series WHERE cycle_idx < 20 GROUP BY cell_id HAVING count(*) >= 20)""", "qd ir")
def prefix_window(spark, sf):
    return wn.prefix(series(spark, sf), 20, short="drop").select("cell_id", "cycle_idx", "qd", "ir")


@query("P2 B4", f"""WITH {SERIES_SQL} SELECT cell_id, cycle_idx, qd FROM series WHERE cycle_idx % 5 = 0
  AND cell_id IN (SELECT cell_id FROM series WHERE cycle_idx % 5 = 0 GROUP BY cell_id HAVING count(*) >= 2)""", "qd")
def sparse_window(spark, sf):
    return wn.keep_every(series(spark, sf), 5, short="drop").select("cell_id", "cycle_idx", "qd")


@query("P6 P7 P9 V17", f"""WITH {SERIES_SQL} SELECT cell_id, cycle_idx, CASE WHEN qd BETWEEN 0.9 AND 1.08 THEN qd END AS qd,
  CASE WHEN ir > 0 THEN ir END AS ir, qd / qc AS ce, coalesce(CASE WHEN ir > 0 THEN ir END, 0.0) AS ir_zero FROM series""", "qd ir ce ir_zero")
def range_cleaning(spark, sf):
    return series(spark, sf).select(
        "cell_id", "cycle_idx", in_range_or_null("qd", 0.9, 1.08).alias("qd"), positive_or_null("ir").alias("ir"),
        ratio("qd", "qc").alias("ce"), zero_if_missing(positive_or_null("ir")).alias("ir_zero"),
    )


@query("P10", f"""WITH {SERIES_SQL} SELECT cell_id, count(*) AS n, avg(qd) AS qd_mean, max(temp_max) AS temp_max FROM series
  WHERE cycle_idx >= 3 AND cycle_idx < 12 GROUP BY ALL""", "qd_mean temp_max")
def half_open_range(spark, sf):
    return series(spark, sf).filter(wn.in_cycles(3, 12)).groupBy("cell_id").agg(
        F.count("*").alias("n"), F.avg("qd").alias("qd_mean"), F.max("temp_max").alias("temp_max")
    )


@query("J6", f"""WITH {SERIES_SQL}, kept AS (SELECT * FROM series WHERE cycle_idx % 4 = 1)
  SELECT cell_id, coalesce(arg_max(qd, CASE WHEN cycle_idx <= 7 THEN cycle_idx END), arg_min(qd, cycle_idx)) AS at7,
    coalesce(arg_max(qd, CASE WHEN cycle_idx <= 0 THEN cycle_idx END), arg_min(qd, cycle_idx)) AS at0,
    coalesce(arg_max(qd, CASE WHEN cycle_idx <= 29 THEN cycle_idx END), arg_min(qd, cycle_idx)) AS at29 FROM kept GROUP BY ALL""", "at7 at0 at29")
def as_of_lookup(spark, sf):
    s = series(spark, sf).filter(F.col("cycle_idx") % 4 == 1)
    return s.groupBy("cell_id").agg(wn.as_of("qd", 7).alias("at7"), wn.as_of("qd", 0).alias("at0"), wn.as_of("qd", 29).alias("at29"))


_HAMPEL_STEP = """SELECT {keys}, i + 1 AS i,
      CASE WHEN x IS NOT NULL AND len(w) >= 3 AND 1.4826 * list_median(list_transform(w, lambda v: abs(v - list_median(w)))) > 0
        AND abs(x - list_median(w)) > 3 * (1.4826 * list_median(list_transform(w, lambda v: abs(v - list_median(w)))))
      THEN list_concat(arr[1:i - 1], [NULL::DOUBLE], arr[i + 1:]) ELSE arr END AS arr
    FROM (SELECT *, arr[i] AS x, list_filter(arr[greatest(1, i - 5):least(len(arr), i + 5)], lambda v: v IS NOT NULL) AS w FROM {rel} WHERE i <= len(arr)) q"""


def _hampel_sql(rel: str, keys: str, source: str) -> str:
    return f"""{rel} AS (SELECT {keys}, 1 AS i, arr FROM {source} UNION ALL {_HAMPEL_STEP.format(keys=keys, rel=rel)})"""


@query("V1 W3", f"""WITH RECURSIVE {SERIES_SQL}, src AS (SELECT cell_id, list(e_dis ORDER BY cycle_idx) AS arr FROM series GROUP BY ALL),
  {_hampel_sql('h', 'cell_id', 'src')}
  SELECT cell_id, u.pos AS cycle_idx, arr[u.pos + 1] AS e_dis FROM (SELECT * FROM h WHERE i = len(arr) + 1) z, LATERAL (SELECT unnest(range(len(z.arr))) AS pos) u""", "e_dis")
def spike_filter(spark, sf):
    s = series(spark, sf).groupBy("cell_id").agg(F.sort_array(F.collect_list(F.struct("cycle_idx", "e_dis"))).alias("r"))
    s = s.withColumn("x", spike_free(F.transform("r", lambda z: z["e_dis"])))
    return s.select("cell_id", F.posexplode("x").alias("cycle_idx", "e_dis"))


_FILL_SQL = """SELECT {keys}, cycle_idx, CASE WHEN v IS NOT NULL THEN v WHEN pv IS NULL THEN nv WHEN nv IS NULL THEN pv
    ELSE pv + (nv - pv) * (cycle_idx - pi) / (ni - pi) END AS v FROM (
    SELECT *, last_value(v IGNORE NULLS) OVER b AS pv, last_value(CASE WHEN v IS NOT NULL THEN cycle_idx END IGNORE NULLS) OVER b AS pi,
      first_value(v IGNORE NULLS) OVER f AS nv, first_value(CASE WHEN v IS NOT NULL THEN cycle_idx END IGNORE NULLS) OVER f AS ni FROM {src}
    WINDOW b AS (PARTITION BY {keys} ORDER BY cycle_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
      f AS (PARTITION BY {keys} ORDER BY cycle_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) g"""


@query("J8", f"""WITH {SERIES_SQL}, gaps AS (SELECT cell_id, cycle_idx, CASE WHEN ir > 0 AND qd < 1.08 THEN ir END AS v FROM series)
  {_FILL_SQL.format(keys='cell_id', src='gaps')}""", "v")
def gap_fill(spark, sf):
    s = series(spark, sf).withColumn("v", F.when((F.col("ir") > 0) & (F.col("qd") < 1.08), F.col("ir")))
    s = s.groupBy("cell_id").agg(F.sort_array(F.collect_list(F.struct("cycle_idx", "v"))).alias("r"))
    idx, v = F.transform("r", lambda z: z["cycle_idx"]), F.transform("r", lambda z: z["v"])
    s = s.withColumns({"idx": idx, "v": v}).withColumn("y", fill_gaps("idx", "v"))
    return s.select("cell_id", F.inline(F.arrays_zip(F.col("idx").alias("cycle_idx"), F.col("y").alias("v"))))


@query("J8 (window form)", f"""WITH {SERIES_SQL}, gaps AS (SELECT cell_id, cycle_idx, CASE WHEN ir > 0 AND qd < 1.08 THEN ir END AS v FROM series)
  {_FILL_SQL.format(keys='cell_id', src='gaps')}""", "v")
def gap_fill_by_windows(spark, sf):
    s = series(spark, sf).select("cell_id", "cycle_idx", F.when((F.col("ir") > 0) & (F.col("qd") < 1.08), F.col("ir")).alias("v"))
    w = Window.partitionBy("cell_id").orderBy("cycle_idx")
    back, fwd = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col("v").isNotNull(), F.struct(F.col("cycle_idx").alias("i"), F.col("v").alias("v")))
    p, n = F.last(known, ignorenulls=True).over(back), F.first(known, ignorenulls=True).over(fwd)
    s = s.withColumns({"p": p, "n": n})
    line = F.col("p.v") + (F.col("n.v") - F.col("p.v")) * (F.col("cycle_idx") - F.col("p.i")) / (F.col("n.i") - F.col("p.i"))
    return s.select("cell_id", "cycle_idx", F.coalesce("v", F.when(F.col("p.i") < F.col("n.i"), line), "p.v", "n.v").alias("v"))


@query("V3 V6", f"""WITH {SERIES_SQL} SELECT cell_id, regr_slope(qd, cycle_idx / 100.0) AS slope100, regr_slope(qd, cycle_idx) AS slope,
  regr_intercept(qd, cycle_idx) AS intercept FROM series WHERE cycle_idx >= 1 GROUP BY ALL""", "slope100 slope intercept")
def linear_fits(spark, sf):
    x = F.col("cycle_idx").cast("double")
    return series(spark, sf).filter("cycle_idx >= 1").groupBy("cell_id").agg(
        ft.slope("qd").alias("slope100"), F.regr_slope("qd", x).alias("slope"), F.regr_intercept("qd", x).alias("intercept")
    )


_QUAD = """, m AS (SELECT {k}, count(v) AS n, avg(x) AS mx FROM {src} WHERE v IS NOT NULL GROUP BY ALL),
  c AS (SELECT {k}, any_value(n) AS n, sum((x-mx)*(x-mx)) AS c2, sum((x-mx)*(x-mx)*(x-mx)) AS c3, sum((x-mx)*(x-mx)*(x-mx)*(x-mx)) AS c4,
    sum(v) AS sy, sum((x-mx)*v) AS cxy, sum((x-mx)*(x-mx)*v) AS cxxy FROM {src} JOIN m USING ({k}) WHERE v IS NOT NULL GROUP BY ALL),
  quad AS (SELECT {k}, CASE WHEN n >= 3 THEN (cxxy - c3 / c2 * cxy - c2 / n * sy) / (c4 - c3 * c3 / c2 - c2 * c2 / n) END AS qd_curvature FROM c)"""


@query("V4", f"""WITH {SERIES_SQL}, q AS (SELECT cell_id, cycle_idx / 100.0 AS x, qd AS v FROM series WHERE cycle_idx >= 1)
  {_QUAD.format(k='cell_id', src='q')} SELECT * FROM quad""", "qd_curvature", 5)
def quadratic_coefficient(spark, sf):
    s = series(spark, sf)
    return s.groupBy("cell_id").agg(ft.curvature("qd", F.col("cycle_idx") >= 1, F.lit(15.0)).alias("qd_curvature"))


@query("V5", f"""WITH {SERIES_SQL} SELECT cell_id, quantile_cont(CASE WHEN cycle_idx >= 25 AND cycle_idx < 30 THEN qd END, 0.5) AS end_level,
  quantile_cont(CASE WHEN cycle_idx >= 1 AND cycle_idx < 4 THEN qd END, 0.5) AS ref_level, max(CASE WHEN cycle_idx = 29 THEN qd END) AS empty_range
  FROM series WHERE cycle_idx < 30 GROUP BY ALL""", "end_level ref_level empty_range")
def levels(spark, sf):
    s = series(spark, sf).filter("cycle_idx < 30").withColumn("T", F.lit(30))  # the horizon
    return s.groupBy("cell_id").agg(
        ft.level("qd", F.lit(25), F.lit(30)).alias("end_level"), ft.level("qd", F.lit(1), F.lit(4)).alias("ref_level"),
        ft.level("qd", F.lit(40), F.lit(45)).alias("empty_range"),
    )


@query("V16", f"""WITH {SERIES_SQL}, t AS (SELECT cell_id, cycle_idx::DOUBLE AS x, qd AS y FROM series WHERE cycle_idx >= 20),
  l AS (SELECT cell_id, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM t GROUP BY ALL)
  SELECT cell_id, stddev_pop(y - (a + b * x)) AS resid_std FROM t JOIN l USING (cell_id) GROUP BY ALL""", "resid_std")
def residual_spread(spark, sf):
    return series(spark, sf).groupBy("cell_id").agg(ft.residual_std("qd", F.col("cycle_idx") >= 20).alias("resid_std"))


# ------------------------------------------------------------- curves

_C = smooth_sql("late")


@query("V7 W2", f"""WITH {PAIRS_SQL} SELECT vec_id, u.pos AS v_idx, u.q AS q FROM (SELECT vec_id, {_C} AS s FROM pairs) z,
  LATERAL (SELECT unnest(range(len(z.s))) AS pos, unnest(z.s) AS q) u""", "q")
def running_median(spark, sf):
    return cv.smoothed(curve_pairs(spark, sf), s="late").select("vec_id", F.posexplode("s").alias("v_idx", "q"))


@query("V8 J5", f"""WITH {PAIRS_SQL}, d AS (SELECT vec_id, list_transform(range(1, len(late) + 1), lambda i: late[i] - early[i]) AS d FROM pairs)
  SELECT vec_id, u.pos AS v_idx, u.q AS q FROM (SELECT vec_id, {smooth_sql('d')} AS s FROM d) z,
  LATERAL (SELECT unnest(range(len(z.s))) AS pos, unnest(z.s) AS q) u""", "q")
def delta_curve(spark, sf):
    d = curve_pairs(spark, sf).withColumn("d", cv.difference("late", "early"))
    return cv.smoothed(d, s="d").select("vec_id", F.posexplode(cv.drop_missing("s")).alias("v_idx", "q"))


_D2 = f"""WITH {PAIRS_SQL}, s1 AS (SELECT vec_id, {_C} AS sl, {smooth_sql('early')} AS se FROM pairs),
  d2 AS (SELECT vec_id, list_transform(range(1, len(sl) + 1), lambda i: sl[i] - se[i]) AS d FROM s1),
  s2 AS (SELECT vec_id, {smooth_sql('d')} AS c FROM d2)"""


def _delta2(spark, sf):
    s = cv.smoothed(curve_pairs(spark, sf), sl="late", se="early")
    s = cv.smoothed(s.withColumn("d", cv.difference("sl", "se")), c="d")
    return s.select("vec_id", cv.zero_missing("c").alias("c"))


@query("V9 V13", f"""{_D2} SELECT vec_id, u.pos AS v_idx, u.q AS q FROM s2 z, LATERAL (SELECT unnest(range(len(z.c))) AS pos, unnest(z.c) AS q) u""", "q")
def smoothed_change(spark, sf):
    return _delta2(spark, sf).select("vec_id", F.posexplode("c").alias("v_idx", "q"))


@query("V14 X10", f"""{_D2} SELECT vec_id, j, c[CAST(round_even(j * (len(c) - 1) / 9.0, 0) AS INTEGER) + 1] AS q FROM s2, range(10) r(j)""", "q")
def curve_samples(spark, sf):
    return _delta2(spark, sf).select("vec_id", F.posexplode(cv.sample_evenly("c", 10)).alias("j", "q"))


@query("V15", """WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS q FROM embeddings),
  m AS (SELECT vec_id, avg(q) AS mu FROM x GROUP BY ALL)
  SELECT x.vec_id, var_samp(q) AS variance, min(q) AS low, avg(q) AS mean, sqrt(avg(q * q)) AS rms,
    abs(avg(pow(q - mu, 3))) / (pow(stddev_samp(q), 3) + 1e-8) AS skew, avg(pow(q - mu, 4)) / (pow(var_samp(q), 2) + 1e-8) AS kurt
  FROM x JOIN m USING (vec_id) GROUP BY ALL""", "variance low mean rms skew kurt")
def curve_moments(spark, sf):
    m = table(spark, sf, "embeddings").select("vec_id", cv.moments(cv.to_double("embedding")).alias("m"))
    c = F.col("m")
    return m.select("vec_id", cv.var_sample(c).alias("variance"), c["min"].alias("low"), c["mean"].alias("mean"), cv.rms(c).alias("rms"),
                    cv.skew_ratio(c).alias("skew"), cv.kurt_ratio(c).alias("kurt"))


def _vfrac_sql(s: str, f: float) -> str:
    """Voltage at a fraction of the final capacity, from a smoothed list column."""
    k = f"list_position(list_transform({s}, lambda x: x > {f} * list_max({s})), true)"
    n = f"(len({s}) - 1)"
    v = lambda j: f"(3.6 + ({j}) * (-1.6) / {n})"
    q0 = f"list_max({s}[1:{k} - 1])"
    return (
        f"CASE WHEN coalesce({k}, 0) = 0 THEN 2.0 WHEN {k} = 1 THEN 3.6 ELSE {v(f'{k} - 2')} + ({v(f'{k} - 1')} - {v(f'{k} - 2')}) * "
        f"({f} * list_max({s}) - {q0}) / ({s}[{k}] - {q0}) END"
    )


@query("V11 J7 W4", f"""WITH {PAIRS_SQL}, s AS (SELECT vec_id, {_C} AS s FROM pairs)
  SELECT vec_id, {_vfrac_sql('s', 0.1)} AS v10, {_vfrac_sql('s', 0.5)} AS v50, {_vfrac_sql('s', 0.9)} AS v90 FROM s""", "v10 v50 v90")
def voltage_at_fraction(spark, sf):
    s = cv.smoothed(curve_pairs(spark, sf), s="late")
    return s.select("vec_id", *[cv.voltage_at_fraction("s", f / 100).alias(f"v{f}") for f in (10, 50, 90)])


@query("W4", f"""WITH {PAIRS_SQL}, x AS (SELECT vec_id, unnest(range(len(late))) AS v_idx, unnest(late) AS q FROM pairs)
  SELECT vec_id, v_idx, max(q) OVER (PARTITION BY vec_id ORDER BY v_idx) AS q FROM x""", "q")
def running_maximum(spark, sf):
    return curve_pairs(spark, sf).select("vec_id", F.posexplode(cv.running_max("late")).alias("v_idx", "q"))


def _peak_sql(s: str, width: int, margin: int, v: str, h: str) -> str:
    side = width // 2
    g = (
        f"list_transform(range(1, len({s}) + 1), lambda i: -({s}[least(i + 1, len({s}))] - {s}[greatest(i - 1, 1)]) / "
        f"((least(i + 1, len({s})) - greatest(i - 1, 1)) * (-1.6) / (len({s}) - 1)))"
    )
    mean = f"list_transform(range({margin} + 1, len({s}) - {margin} + 1), lambda i: list_sum(({g})[greatest(1, i - {side}):least(len({s}), i + {side})]) / {width})"
    return (
        f"list_max({mean}) AS {h}, 3.6 + (list_position({mean}, list_max({mean})) - 1 + {margin}) * (-1.6) / (len({s}) - 1) AS {v}"
    )


@query("V12 W5 W6", f"""WITH {PAIRS_SQL}, s AS (SELECT vec_id, {_C} AS s FROM pairs) SELECT vec_id, {_peak_sql('s', 5, 3, 'v', 'height')} FROM s""", "v height", 5)
def slope_peak(spark, sf):
    s = cv.smoothed(curve_pairs(spark, sf), s="late")
    return s.select("vec_id", cv.slope_peak("s", 5, 3).alias("p")).select("vec_id", "p.height", "p.v")


# ------------------------------------------------------------- feature sets

_CLEANED = {"cl_qd": "CASE WHEN qd BETWEEN 0.55 AND 1.43 THEN qd END", "cl_qc": "CASE WHEN qc BETWEEN 0.55 AND 1.43 THEN qc END",
            "cl_ir": "CASE WHEN ir > 0 THEN ir END", "hp_v_dis_avg": "v_dis_avg", "hp_e_dis": "e_dis", "hp_t_chg": "t_chg",
            "hp_t_dis": "t_dis", "hp_t_cv": "t_cv", "hp_temp_max": "temp_max"}


def _rows_sql(horizons, every: int = 1) -> str:
    """Raw and cleaned series per (entity, horizon), through the recursive spike filter and gap filling."""
    values = ", ".join(f"({t})" for t in horizons)
    arms = " UNION ALL ".join(
        f"SELECT cell_id, T, '{n}' AS name, list({e} ORDER BY cycle_idx) AS arr, list(cycle_idx ORDER BY cycle_idx) AS idx FROM raw GROUP BY cell_id, T"
        for n, e in _CLEANED.items()
    )
    pivot = ", ".join(f"max(v) FILTER (WHERE name = '{n}') AS {n}" for n in _CLEANED)
    return f"""{CURVED_SQL},
hz(T) AS (VALUES {values}),
raw AS (SELECT s.*, hz.T FROM series s JOIN hz ON s.cycle_idx < hz.T WHERE s.cycle_idx % {every} = 0),
src AS ({arms}),
{_hampel_sql('h', 'cell_id, T, name, idx', 'src')},
spiked AS (SELECT cell_id, T, name, unnest(idx) AS cycle_idx, unnest(arr) AS v FROM h WHERE i = len(arr) + 1),
filled AS ({_FILL_SQL.format(keys='cell_id, T, name', src="(SELECT * FROM spiked WHERE name LIKE 'cl_%')")}),
clean AS (SELECT cell_id, T, cycle_idx, {pivot} FROM (SELECT cell_id, T, name, cycle_idx, v FROM filled UNION ALL
  SELECT cell_id, T, name, cycle_idx, v FROM spiked WHERE name LIKE 'hp_%') GROUP BY cell_id, T, cycle_idx),
rws AS (SELECT r.*, c.* EXCLUDE (cell_id, T, cycle_idx) FROM raw r JOIN clean c USING (cell_id, T, cycle_idx))"""


def _at(col: str, k: str) -> str:
    return f"coalesce(arg_max(({col},), CASE WHEN cycle_idx <= {k} THEN cycle_idx END), arg_min(({col},), cycle_idx))[1]"


def _lvl(col: str, a: str, b: str) -> str:
    inside = f"cycle_idx >= {a} AND cycle_idx < {b}"
    return f"CASE WHEN count(*) FILTER (WHERE {inside}) > 0 THEN quantile_cont({col}, 0.5) FILTER (WHERE {inside}) ELSE {_at(col, f'greatest({a}, 0)')} END"


def _slp(col: str, where: str = "true") -> str:
    return f"regr_slope({col}, cycle_idx / 100.0) FILTER (WHERE {where})"


_B_SQL = {
    "qd_ref": _at("cl_qd", "1"), "qc_ref": _at("cl_qc", "1"), "qd_mean": "avg(cl_qd)", "qd_std": "stddev_pop(cl_qd)",
    "qd_retention": f"({_lvl('cl_qd', 'T - 5', 'T')}) / ({_lvl('cl_qd', '1', '4')})",
    "qd_max_minus_ref": f"max(cl_qd) FILTER (WHERE cycle_idx >= 1) - {_at('cl_qd', '1')}",
    "qd_slope": _slp("cl_qd", "cycle_idx >= 1"), "qd_slope_late": _slp("cl_qd", "cycle_idx >= T // 2"),
    "ce_mean": "avg(cl_qd / cl_qc)", "ce_std": "stddev_pop(cl_qd / cl_qc)", "ce_slope": "regr_slope(cl_qd / cl_qc, cycle_idx / 100.0)",
    "v_dis_avg_mean": "avg(hp_v_dis_avg)", "v_dis_avg_std": "stddev_pop(hp_v_dis_avg)", "e_dis_mean": "avg(hp_e_dis)",
    "i_chg_mean": "avg(i_chg_mean)", "i_chg_std": "avg(i_chg_std)", "i_max": "max(i_max)", "t_chg_mean": "avg(hp_t_chg)",
    "t_dis_mean": "avg(hp_t_dis)", "t_cv_mean": "avg(hp_t_cv)", "temp_mean": "avg(temp_mean)", "temp_max": "max(hp_temp_max)",
    "temp_range": "avg(temp_max - temp_min)", "temp_std": "stddev_pop(temp_mean)", "ir_ref": _at("cl_ir", "1"), "ir_min": "min(cl_ir)",
    "ir_change": f"({_lvl('cl_ir', 'T - 5', 'T')}) - ({_lvl('cl_ir', '1', '4')})",
}
_C_SQL = {
    "qd_slope_last10": _slp("cl_qd", "cycle_idx >= T - 10"),
    "qd_resid_std_last10": "CASE WHEN count(*) FILTER (WHERE cycle_idx >= T - 10) >= 3 THEN sqrt(greatest(regr_syy(cl_qd, cycle_idx) FILTER (WHERE cycle_idx >= T - 10) - "
                           "pow(regr_sxy(cl_qd, cycle_idx) FILTER (WHERE cycle_idx >= T - 10), 2) / regr_sxx(cl_qd, cycle_idx) FILTER (WHERE cycle_idx >= T - 10), 0.0) / "
                           "count(*) FILTER (WHERE cycle_idx >= T - 10)) END",
    "dv_dis_avg": f"({_lvl('hp_v_dis_avg', 'T - 5', 'T')}) - ({_lvl('hp_v_dis_avg', '1', '4')})",
    "t_chg_slope": _slp("hp_t_chg"), "t_dis_slope": _slp("hp_t_dis"), "t_cv_slope": _slp("hp_t_cv"), "ir_slope": _slp("cl_ir"),
    "temp_slope": _slp("temp_mean"),
}
_MID = "cycle_idx >= 2 AND cycle_idx < T - 1"
_QE = f"list(qd ORDER BY cycle_idx) FILTER (WHERE {_MID})"
_A_SQL = {
    "qd_early": f"({_QE})[least(3, len({_QE}))]", "qd_max_minus_early": f"max(qd) FILTER (WHERE {_MID}) - ({_QE})[least(3, len({_QE}))]",
    "qd_slope": f"regr_slope(qd, cycle_idx - 2) FILTER (WHERE {_MID})", "qd_intercept": f"regr_intercept(qd, cycle_idx - 2) FILTER (WHERE {_MID})",
    "t_early_chg_log": "ln(avg(t_bml_chg) FILTER (WHERE cycle_idx < 4) + 1e-8)",
    "temp_avg_log": "ln(avg(temp_mean) FILTER (WHERE cycle_idx >= 2) + 1e-8)",
    "ir_min": "min(ir) FILTER (WHERE cycle_idx >= 2)", "ir_change": f"{_at('ir', 'T - 1')} - {_at('ir', '2')}",
}
_PW, _PM = 5, 3


def _curves_sql(every: int = 1) -> str:
    """Picked curves per (entity, horizon), their smoothed forms, differences and all shape features."""
    pick = lambda k, n: f"coalesce(arg_max(c, CASE WHEN cycle_idx <= {k} THEN cycle_idx END), arg_min(c, cycle_idx)) AS {n}"
    mom = lambda c, p: (
        f"list_min({c}) AS {p}min, list_aggregate({c}, 'var_samp') AS {p}var, list_avg({c}) AS {p}mean, "
        f"sqrt(list_avg(list_transform({c}, lambda x: x * x))) AS {p}rms, "
        f"list_avg(list_transform({c}, lambda x: pow(x - list_avg({c}), 3))) AS {p}m3, list_avg(list_transform({c}, lambda x: pow(x - list_avg({c}), 4))) AS {p}m4"
    )
    samples = ", ".join(f"d2[{j} + 1] AS dq2_curve_{i:02d}" for i, j in enumerate(_sample_positions(CURVE_POINTS, 50)))
    return f"""cc AS (SELECT cell_id, cycle_idx, T, list_transform(qdlin, lambda x: x::DOUBLE) AS c FROM curved JOIN hz ON cycle_idx < T WHERE cycle_idx % {every} = 0),
pk AS (SELECT cell_id, T, {pick('least(9, T // 2)', 'ce')}, {pick('T - 1', 'cl')}, {pick('1', 'cr')} FROM cc GROUP BY cell_id, T),
sm AS (SELECT cell_id, T, list_transform(range(1, len(cl) + 1), lambda i: cl[i] - ce[i]) AS d0, {smooth_sql('ce')} AS se, {smooth_sql('cl')} AS sl, {smooth_sql('cr')} AS sr FROM pk),
sm2 AS (SELECT cell_id, T, se, sl, {smooth_sql('d0')} AS d1, list_transform(range(1, len(sl) + 1), lambda i: sl[i] - sr[i]) AS e0 FROM sm),
sm3 AS (SELECT *, {smooth_sql('e0')} AS d2 FROM sm2),
mm AS (SELECT *, {mom('d1', 'a_')}, {mom('d2', 'b_')}, {_peak_sql('se', _PW, _PM, 'pe_v', 'pe_h')}, {_peak_sql('sl', _PW, _PM, 'pl_v', 'pl_h')},
  {_vfrac_sql('sl', 0.1)} AS v_q10_last, {_vfrac_sql('sl', 0.5)} AS v_q50_last, {_vfrac_sql('sl', 0.9)} AS v_q90_last, {_vfrac_sql('se', 0.5)} AS e50 FROM sm3),
shape AS (SELECT cell_id, T, log10(abs(a_min) + 1e-8) AS dq_min_log, log10(a_var + 1e-8) AS dq_var_log,
  log10(abs(a_m3) / (pow(sqrt(a_var), 3) + 1e-8) + 1e-8) AS dq_skew_log, log10(a_m4 / (a_var * a_var + 1e-8) + 1e-8) AS dq_kurt_log,
  a_mean AS dq_mean, a_rms AS dq_rms, v_q10_last, v_q50_last, v_q90_last, v_q50_last - e50 AS dv_q50, pl_v - pe_v AS dqdv_peak_shift,
  CASE WHEN pe_h <> 0 THEN pl_h / pe_h END AS dqdv_peak_ratio, log10(b_var + 1e-8) AS dq2_var_log, log10(abs(b_min) + 1e-8) AS dq2_min_log,
  b_mean AS dq2_mean, b_rms AS dq2_rms, {samples} FROM mm)"""


def _sample_positions(n: int, points: int) -> list[int]:
    return [round(j * (n - 1) / (points - 1)) for j in range(points)]


def _set_sql(fs: str, horizons, every: int = 1) -> str:
    exprs = dict(_A_SQL) if fs == "A" else dict(_B_SQL)
    if fs in ("C", "D"):
        exprs.update(_C_SQL)
    names = ft.FEATURE_SETS[fs]
    quad = ""
    if fs in ("C", "D"):
        quad = ", qs AS (SELECT cell_id, T, cycle_idx / 100.0 AS x, cl_qd AS v FROM rws WHERE cycle_idx >= 1)" + _QUAD.format(k="cell_id, T", src="qs")
    agg = ", ".join(f"{e} AS {n}" for n, e in exprs.items())
    join = " JOIN quad USING (cell_id, T)" if quad else ""
    return f"""WITH RECURSIVE {_rows_sql(horizons, every)}, {_curves_sql(every)}{quad},
agg AS (SELECT cell_id, T, {agg} FROM rws GROUP BY cell_id, T)
SELECT cell_id, T, {', '.join(names)} FROM agg JOIN shape USING (cell_id, T){join}"""


def _build(spark, sf, fs, horizons, every=1):
    return ft.build_features(curved_series(spark, sf), fs, horizons, every=every, peak_width=_PW, peak_margin=_PM, short="drop")


@query("FA1-FA12 P9 FX1", _set_sql("A", HORIZONS), " ".join(ft.FEATURE_SETS["A"]), 5)
def feature_set_a(spark, sf):
    return _build(spark, sf, "A", HORIZONS)


@query("FB1-FB30 V2 FX1 P8", _set_sql("B", [20]), " ".join(ft.FEATURE_SETS["B"]), 5)
def feature_set_b(spark, sf):
    return _build(spark, sf, "B", [20])


@query("FC1-FC16 V10 FX1", _set_sql("C", [5, 20]), " ".join(ft.FEATURE_SETS["C"]), 4)
def feature_set_c(spark, sf):
    return _build(spark, sf, "C", [5, 20])


@query("FD1-FD5 FX1", _set_sql("D", [30]), " ".join(ft.FEATURE_SETS["D"]), 4)
def feature_set_d(spark, sf):
    return _build(spark, sf, "D", [30])


@query("B4 P2 FX1 (sparse sampling)", _set_sql("B", [20, 30], 3), " ".join(ft.FEATURE_SETS["B"]), 5)
def sparse_features(spark, sf):
    return _build(spark, sf, "B", [20, 30], every=3)


@query("V13 S9", f"""WITH {CURVED_SQL}, pk AS (SELECT cell_id, max(CASE WHEN cycle_idx = 28 THEN list_transform(qdlin, lambda x: x::DOUBLE) END) AS a,
    max(CASE WHEN cycle_idx = 8 THEN list_transform(qdlin, lambda x: x::DOUBLE) END) AS b FROM curved GROUP BY cell_id),
  s AS (SELECT cell_id, {smooth_sql('a')} AS sa, {smooth_sql('b')} AS sb FROM pk),
  d AS (SELECT cell_id, list_transform(range(1, len(sa) + 1), lambda i: sa[i] - sb[i]) AS d FROM s), z AS (SELECT cell_id, {smooth_sql('d')} AS c FROM d)
  SELECT cell_id, {', '.join(f'c[{j + 1}] AS q{j:03d}' for j in range(64))} FROM z""", " ".join(f"q{j:03d}" for j in range(64)))
def full_curve_matrix(spark, sf):
    v = ft.full_curve_vector(curved_series(spark, sf), 8, 28)
    return ft.expand_curve(v, "curve_change", 64)


@query("FX2", f"""WITH {CURVED_SQL}, pk AS (SELECT cell_id, max(CASE WHEN cycle_idx = 29 THEN list_transform(qdlin, lambda x: x::DOUBLE) END) AS a,
    max(CASE WHEN cycle_idx = 9 THEN list_transform(qdlin, lambda x: x::DOUBLE) END) AS b FROM curved GROUP BY cell_id),
  d AS (SELECT cell_id, list_transform(range(1, len(a) + 1), lambda i: a[i] - b[i]) AS d FROM pk), z AS (SELECT cell_id, {smooth_sql('d')} AS c FROM d),
  sc AS (SELECT cell_id, max(CASE WHEN cycle_idx = 1 THEN qd END) AS Early_Discharge_Capacity,
    max(qd) FILTER (WHERE cycle_idx BETWEEN 1 AND 28) - max(CASE WHEN cycle_idx = 1 THEN qd END) AS Max_Min_Capacity_Diff,
    regr_slope(qd, cycle_idx - 1) FILTER (WHERE cycle_idx BETWEEN 1 AND 28) AS Capacity_Fade_Slope,
    regr_intercept(qd, cycle_idx - 1) FILTER (WHERE cycle_idx BETWEEN 1 AND 28) AS Capacity_Fade_Intercept,
    ln(avg(t_bml_chg) FILTER (WHERE cycle_idx < 4) + 1e-8) AS Avg_Charge_Time,
    ln(avg(temp_mean) FILTER (WHERE cycle_idx BETWEEN 1 AND 29) + 1e-8) AS Temperature_Integral,
    min(ir) FILTER (WHERE cycle_idx BETWEEN 1 AND 29) AS Min_Internal_Resistance,
    max(CASE WHEN cycle_idx = 29 THEN ir END) - max(CASE WHEN cycle_idx = 1 THEN ir END) AS IR_Change FROM series GROUP BY cell_id)
  SELECT sc.*, log10(list_aggregate(c, 'var_pop') + 1e-8) AS DeltaQ_Variance, log10(abs(list_min(c)) + 1e-8) AS DeltaQ_Minimum FROM sc JOIN z USING (cell_id)""",
       " ".join(ft.LEGACY_NAMES))
def legacy_feature_set(spark, sf):
    return ft.legacy_features(curved_series(spark, sf), (1, 9, 29))
