"""Queries that write a table to the shared folder and read it back."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.numeric import finite
from ..operators import attribution as at
from ..session import work_folder
from ..sources import tables as src
from .bindings import MATRIX_SQL, PHI_COLUMNS, PHI_SQL, PREDS_SQL, SERIES_SQL, features_matrix, phi_items, preds, query, series, table

# ------------------------------------------------------------- telemetry and signals


@query("S1", """WITH pts AS (SELECT o_custkey, l_orderkey, l_linenumber, l_quantity AS t, CASE WHEN l_returnflag = 'R' THEN 'NaN'::DOUBLE ELSE l_extendedprice / 103.7 END AS i,
    count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
  cyc AS (SELECT o_custkey, l_orderkey, dense_rank() OVER (PARTITION BY o_custkey ORDER BY l_orderkey) - 1 AS cycle_idx, l_linenumber, t, i, n FROM pts)
  SELECT o_custkey::VARCHAR AS cell_id, count(*) AS n_points, count(DISTINCT cycle_idx) AS n_cycles, sum(t) AS sum_t, sum(CASE WHEN NOT isnan(i) THEN i END) AS sum_i,
    count(*) FILTER (isnan(i)) AS n_missing, sum(t * cycle_idx) AS by_cycle, count(*) FILTER (n % 2 = 1) AS n_invalid FROM cyc GROUP BY o_custkey""", "sum_t sum_i by_cycle", 4)
def raw_cells(spark, sf):
    """Line items as points and orders as cycles, written as nested records and read with the fixed schema."""
    items = table(spark, sf, "lineitem").join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    i = F.when(F.col("l_returnflag") == "R", float("nan")).otherwise(F.col("l_extendedprice") / 103.7)
    points = F.sort_array(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("double").alias("t"), i.alias("i"))))
    cycles = items.groupBy("o_custkey", "l_orderkey").agg(points.alias("p"))
    # an odd number of points loses its last current: such a cycle is not valid
    current = F.when(F.size("p") % 2 == 1, F.concat(F.col("p.i"), F.array(F.lit(0.0)))).otherwise(F.col("p.i"))
    cycle = F.struct(F.col("l_orderkey"), F.lit(1).alias("cycle_number"), current.alias("current_in_A"), F.col("p.t").alias("time_in_s"))
    nested = cycles.groupBy(F.col("o_custkey").cast("string").alias("cell_id")).agg(F.sort_array(F.collect_list(cycle)).alias("cycle_data"))
    path = work_folder(spark)
    nested.write.parquet(path)
    p = src.points_table(src.read_raw_cells(spark, path, "parquet")).filter("t IS NOT NULL")
    return p.groupBy("cell_id").agg(
        F.count("*").alias("n_points"), F.countDistinct("cycle_idx").alias("n_cycles"), F.sum("t").alias("sum_t"), F.sum("i").alias("sum_i"),
        F.count_if(F.col("i").isNull()).alias("n_missing"), F.sum(F.col("t") * F.col("cycle_idx")).alias("by_cycle"), F.count_if(~F.col("valid")).alias("n_invalid"),
    )


@query("S4 S5", f"""WITH {SERIES_SQL} SELECT cell_id, count(*) AS n, sum(qd) AS qd, sum(cycle_idx)::BIGINT AS cycles, min(temp_min) AS temp_min FROM series GROUP BY cell_id""", "qd temp_min")
def signal_table(spark, sf):
    """Signals of some users, then of all: the second write adds only users that are not there yet."""
    path, s = work_folder(spark), series(spark, sf).drop("event_id")
    src.write_signals(s.filter("cell_id % 3 = 0"), path)
    src.write_signals(s, path, incremental=True)
    src.write_signals(s, path, incremental=True)
    return src.read_signals(spark, path).groupBy("cell_id").agg(F.count("*").alias("n"), F.sum("qd").alias("qd"), F.sum("cycle_idx").alias("cycles"), F.min("temp_min").alias("temp_min"))


# ------------------------------------------------------------- features and results


@query("S8 S10 J1", f"""WITH {MATRIX_SQL} SELECT cell_id, 20 AS T, x2 + 20 AS x2, x5, CASE WHEN fold = 0 THEN 'test' ELSE 'train' END AS partition FROM fm""", "x2 x5")
def feature_table(spark, sf):
    """Two horizons written, one written again; one matrix read with its partition."""
    path, m = work_folder(spark), features_matrix(spark, sf)
    rows = m.withColumn("T", F.explode(F.array(F.lit(10), F.lit(20)))).select("cell_id", "T", "x1", (F.col("x2") + F.col("T")).alias("x2"), (F.col("x5") - 1).alias("x5"))
    src.write_features(rows, path, "X")
    src.write_features(rows.filter("T = 20").withColumn("x5", F.col("x5") + 1), path, "X")
    part = m.select("cell_id", F.when(F.col("fold") == 0, "test").otherwise("train").alias("partition"))
    return src.read_features(spark, path, "X", 20, ["x2", "x5"], part)


@query("S11", f"""WITH {PREDS_SQL} SELECT 'run-' || seed AS batch, model, seed, CASE WHEN cell_id % 3 = 0 THEN 'oof' ELSE 'test' END AS partition, count(*) AS n, count(DISTINCT cell_id) AS n_cells,
  sum(y_true) AS y_true, sum(y_pred) AS y_pred FROM preds GROUP BY ALL""", "y_true y_pred", 4)
def prediction_log(spark, sf):
    """One batch for each seed; one of them runs twice, and one attempt dies before it is committed."""
    path = work_folder(spark)
    p = preds(spark, sf).withColumn("partition", F.when(F.col("cell_id") % 3 == 0, "oof").otherwise("test"))
    for seed in (0, 1, 0):
        src.append_predictions(p.filter(F.col("seed") == seed), path, f"run-{seed}")
    src.write_attempt(p.select(*src.PREDICTION_COLUMNS), path, "run-2")
    log = src.read_predictions(spark, path, check=True)
    return log.groupBy("batch", "model", "seed", "partition").agg(F.count("*").alias("n"), F.countDistinct("cell_id").alias("n_cells"), F.sum("y_true").alias("y_true"), F.sum("y_pred").alias("y_pred"))


@query("S12 K6", f"""WITH {PREDS_SQL}, r AS (SELECT seed, model, sqrt(avg((y_pred - y_true) * (y_pred - y_true))) AS rmse FROM preds GROUP BY ALL)
  SELECT seed, model, rmse FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY rmse, model) AS k FROM r) WHERE k = 1""", "rmse")
def small_selection(spark, sf):
    """The best model of each seed, written as JSON twice and read back."""
    path, e = work_folder(spark), F.col("y_pred") - F.col("y_true")
    r = preds(spark, sf).groupBy("seed", "model").agg(F.sqrt(F.avg(e * e)).alias("rmse"))
    best = r.withColumn("k", F.row_number().over(Window.partitionBy("seed").orderBy("rmse", "model"))).filter("k = 1").drop("k")
    src.write_small(best, path)
    src.write_small(best, path)
    return spark.read.schema("seed int, model string, rmse double").json(path).select("seed", "model", finite("rmse").alias("rmse"))


# ------------------------------------------------------------- importance by life group


@query("A5", f"""WITH {PREDS_SQL}, {PHI_SQL}, p AS (SELECT CASE model WHEN 'a' THEN 'm1' ELSE 'm2' END AS model, cell_id, y_true, y_pred FROM preds WHERE seed = 0 AND model <> 'c'),
  e AS (SELECT quantile_cont(y_true, 1.0/3) AS edge_low, quantile_cont(y_true, 2.0/3) AS edge_high FROM p WHERE model = 'm1' AND cell_id % 3 = 0),
  g AS (SELECT *, CASE WHEN y_true <= edge_low THEN 'short' WHEN y_true <= edge_high THEN 'medium' ELSE 'long' END AS life_group FROM p, e),
  f AS (SELECT model, l_orderkey AS cell_id, feature, sum(phi) AS phi FROM phi GROUP BY ALL),
  i AS (SELECT g.model, life_group, feature, avg(abs(phi)) AS importance FROM g JOIN f USING (model, cell_id) GROUP BY ALL),
  k AS (SELECT *, row_number() OVER (PARTITION BY model, life_group ORDER BY importance DESC, feature) AS rank FROM i),
  t AS (SELECT model, life_group, string_agg(feature, ', ' ORDER BY rank) AS top FROM k WHERE rank <= 3 GROUP BY ALL)
  SELECT g.model, g.life_group, edge_low, edge_high, count(*) AS n, sqrt(avg((y_pred - y_true) * (y_pred - y_true))) AS RMSE, avg(abs(y_pred - y_true)) AS MAE, avg(y_pred - y_true) AS Bias, any_value(top) AS top
  FROM g LEFT JOIN t USING (model, life_group) GROUP BY ALL""", "edge_low edge_high RMSE MAE Bias")
def life_group_importance(spark, sf):
    p = preds(spark, sf).filter("seed = 0 AND model <> 'c'").withColumn("model", F.when(F.col("model") == "a", "m1").otherwise("m2"))
    sums = phi_items(spark, sf).groupBy(F.col("l_orderkey").alias("cell_id")).agg(*[F.sum(c).alias(c) for c in PHI_COLUMNS.values()])
    runs = [
        F.struct(F.lit(m).alias("model"), F.array(*[F.struct(F.lit(f).alias("feature"), F.col(c).alias("phi")) for (n, f), c in PHI_COLUMNS.items() if n == m]).alias("features"))
        for m in dict.fromkeys(m for m, _ in PHI_COLUMNS)
    ]
    phi = sums.select("cell_id", F.inline(F.array(*runs)))
    p = p.select("model", "cell_id", "y_true", "y_pred")
    return at.importance_by_life_group(p, phi, p.filter("model = 'm1' AND cell_id % 3 = 0"), "cell_id", ["model"], k=3)
