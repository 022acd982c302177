"""Queries over entities, splits, prediction tables, alarms and policies."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import (
    clip, clip_probability, floor_at_one, format_g, format_signed_percent, hash_normal, hash_uniform, interval_text, ln_eps, log10_abs,
    mean_pm_std, percent_effect, sign_class,
)
from ..operators import metrics as mt
from ..operators import order_stats as os_
from ..operators import policy as pl
from ..operators import resampling as rs
from ..operators import splits as sp
from ..sources.tables import (
    missing_cells as missing_cells_of, new_cells, protocol_table,
)
from .bindings import (
    ALARMS_SQL, CELLS_SQL, MODELS, POLICIES, PREDS_SQL, SETS_SQL, alarms, cells, decision_sets, preds, query, resamples_sql, table,
)

# ------------------------------------------------------------- sources and set operations


@query("S2", "SELECT DISTINCT user_id FROM events")
def available_cells(spark, sf):
    return table(spark, sf, "events").select("user_id").distinct()


@query("S3", """SELECT count(*) AS n_missing, coalesce(min(c_custkey), -1) AS first_missing FROM customer
  WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def missing_cells(spark, sf):
    want = table(spark, sf, "customer").select(F.col("c_custkey").alias("cell_id"))
    have = table(spark, sf, "orders").select(F.col("o_custkey").alias("cell_id"))
    return missing_cells_of(want, have, "cell_id").agg(
        F.count("*").alias("n_missing"), F.coalesce(F.min("cell_id"), F.lit(-1)).alias("first_missing")
    )


@query("S5 U4", "SELECT c_custkey AS cell_id, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)", "c_acctbal")
def incremental_build(spark, sf):
    have = table(spark, sf, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("cell_id"))
    return new_cells(table(spark, sf, "customer").select(F.col("c_custkey").alias("cell_id"), "c_acctbal"), have, "cell_id")


@query("S6 U2 U3", """SELECT count(*) FILTER (WHERE s = 'left') AS only_left, count(*) FILTER (WHERE s = 'right') AS only_right FROM (
  SELECT 'left' AS s, c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
  UNION ALL SELECT DISTINCT 'right', o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer))""")
def id_set_difference(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    b = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"))
    return sp.uncovered_ids(a, b, "k").agg(
        F.count_if(F.col("only_in") == "left").alias("only_left"), F.count_if(F.col("only_in") == "right").alias("only_right")
    )


@query("J3 U2", """SELECT k, string_agg(p, ',' ORDER BY p) AS partitions FROM (
  SELECT DISTINCT o_custkey AS k, 'urgent' AS p FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL
  SELECT DISTINCT o_custkey, 'low' FROM orders WHERE o_orderpriority = '5-LOW' UNION ALL
  SELECT DISTINCT o_custkey, 'dear' FROM orders WHERE o_totalprice > 400000) GROUP BY k HAVING count(*) > 1""")
def overlapping_partitions(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_custkey", "k")
    parts = {"urgent": o.filter("o_orderpriority = '1-URGENT'"), "low": o.filter("o_orderpriority = '5-LOW'"), "dear": o.filter("o_totalprice > 400000")}
    return sp.overlapping_ids(parts, "k").withColumn("partitions", F.array_join("partitions", ","))


@query("R1 U4 J2", """SELECT c_custkey AS cell_id, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'train' ELSE 'test' END AS partition, c_acctbal
  FROM customer WHERE c_mktsegment <> 'FURNITURE' AND c_acctbal >= 0""", "c_acctbal")
def fixed_partition(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("cell_id"), "c_mktsegment", "c_acctbal")
    train = c.filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))
    test = c.filter(F.col("c_mktsegment").isin("AUTOMOBILE", "HOUSEHOLD"))
    out = sp.fixed_partition(c, train, test, "cell_id", excluded=c.filter("c_acctbal < 0"))
    return out.select("cell_id", "partition", "c_acctbal")


@query("J1", f"""WITH {CELLS_SQL}, f AS (SELECT o_custkey AS cell_id, avg(o_totalprice) AS spend, count(*) AS n FROM orders GROUP BY ALL)
  SELECT cell_id, spend, n, life, partition FROM f JOIN cells USING (cell_id)""", "spend life")
def features_with_labels(spark, sf):
    f = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("cell_id")).agg(F.avg("o_totalprice").alias("spend"), F.count("*").alias("n"))
    return f.join(cells(spark, sf).select("cell_id", "life", "partition"), "cell_id")


@query("U1 U5", """SELECT o_custkey AS cell_id, o_orderpriority AS model FROM orders WHERE o_orderstatus = 'O'
  UNION SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F'""")
def concatenated_blocks(spark, sf):
    o = table(spark, sf, "orders")
    a = o.filter("o_orderstatus = 'O'").select(F.col("o_custkey").alias("cell_id"), F.col("o_orderpriority").alias("model"))
    b = o.filter("o_orderstatus = 'F'").select(F.col("o_orderpriority").alias("model"), F.col("o_custkey").alias("cell_id"))
    return a.unionByName(b, allowMissingColumns=True).dropDuplicates(["cell_id", "model"])


@query("S13 D14 X3 J11", """WITH p AS (SELECT p_partkey AS cell_id, CASE WHEN p_partkey % 2 = 1 THEN 'train' ELSE 'test' END AS partition,
    p_size / 10.0 AS c1, (p_partkey % 8) * 12.5 AS soc_switch, (p_size % 7) / 2.0 AS c2 FROM part),
  t AS (SELECT *, replace(printf('%g', c1), '.0', '.0') || 'C(' || printf('%g', soc_switch) || '%)-' || printf('%g', c2) || 'C' AS protocol FROM p)
  SELECT *, partition = 'test' AND protocol IN (SELECT protocol FROM t WHERE partition = 'train') AS protocol_seen_in_train FROM t""", "c1 soc_switch c2")
def charging_protocols(spark, sf):
    p = table(spark, sf, "part")
    step = lambda r, s: F.struct(r.cast("double").alias("rate_in_C"), s.cast("double").alias("end_soc"))
    raw = p.select(
        F.col("p_partkey").alias("cell_id"), F.when(F.col("p_partkey") % 2 == 1, "train").otherwise("test").alias("partition"),
        F.array(step(F.col("p_size") / 10, (F.col("p_partkey") % 8) * 12.5), step((F.col("p_size") % 7) / 2, F.lit(80.0))).alias("charge_protocol"),
    )
    return protocol_table(raw).select("cell_id", "partition", "c1", "soc_switch", "c2", "protocol", "protocol_seen_in_train")


# ------------------------------------------------------------- scalar functions


@query("X1 X2 X4 P11 X9", """SELECT l_orderkey, l_linenumber, l_partkey, log10(abs(l_discount) + 1e-8) AS lg, ln(l_tax + 1e-8) AS nat, greatest(0.02, least(0.07, l_discount)) AS clipped,
    100 * (exp(l_tax - l_discount) - 1) AS pct, greatest(l_quantity - 25, 1.0) AS floored, greatest(1e-6, least(1 - 1e-6, l_discount * 10)) AS prob,
    CASE WHEN l_tax - l_discount * 5 > 0.3 THEN '+' WHEN l_tax - l_discount * 5 < -0.3 THEN '-' ELSE '~' END AS sgn FROM lineitem""",
       "lg nat clipped pct floored prob")
def scalar_functions(spark, sf):
    d, t = F.col("l_discount"), F.col("l_tax")
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", log10_abs(d).alias("lg"), ln_eps(t).alias("nat"), clip(d, 0.02, 0.07).alias("clipped"),
        percent_effect(t - d).alias("pct"), floor_at_one(F.col("l_quantity") - 25).alias("floored"), clip_probability(d * 10).alias("prob"),
        sign_class(t - d * 5).alias("sgn"),
    )


@query("X3", """SELECT c_custkey, printf('%g', c_acctbal / 3.7) AS g, printf('%g', c_acctbal / 3.7e9) AS g_small, printf('%g', c_acctbal / 3.7e-5) AS g_large, printf('%+.0f%%', c_acctbal / 117.3) AS pct,
    CASE WHEN c_nationkey > 0 THEN printf('%.1f', c_acctbal / 1.37) || ' ± ' || printf('%.1f', c_nationkey / 7.3) ELSE printf('%.1f', c_acctbal / 1.37) END AS pm,
    printf('%.1f [%.1f, %.1f]', c_acctbal / 1.37, c_acctbal / 2.11, c_acctbal * 1.1337) AS ci FROM customer""")
def text_formats(spark, sf):
    x = F.col("c_acctbal")
    return table(spark, sf, "customer").select(
        "c_custkey", format_g(x / 3.7).alias("g"), format_g(x / 3.7e9).alias("g_small"), format_g(x / 3.7e-5).alias("g_large"), format_signed_percent(x / 117.3).alias("pct"),
        mean_pm_std(x / 1.37, F.col("c_nationkey") / 7.3).alias("pm"), interval_text(x / 1.37, x / 2.11, x * 1.1337).alias("ci"),
    )


@query("X5 X6", """SELECT c_custkey, c_mktsegment LIKE 'F%' AS is_f, substr(c_name, 10) AS tail, '{"acct":' || c_nationkey || ',"seg":"' || c_mktsegment || '"}' AS js FROM customer""")
def text_parsing(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey", F.col("c_mktsegment").startswith("F").alias("is_f"), F.substring_index("c_name", "#", -1).alias("tail"),
        F.to_json(F.struct(F.col("c_nationkey").alias("acct"), F.col("c_mktsegment").alias("seg"))).alias("js"),
    )


_HASH = "('0x' || substr(md5({0}), 1, 8))::BIGINT / 4294967296.0"


@query("B1 B2 (hash randomness)", f"""SELECT c_custkey, {_HASH.format("'7,' || c_custkey")} AS u,
  sqrt(-2 * ln(1 - {_HASH.format("'7,' || c_custkey || ',u1'")})) * cos(2 * pi() * {_HASH.format("'7,' || c_custkey || ',u2'")}) AS z FROM customer""", "u z")
def hash_draws(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", hash_uniform(7, F.col("c_custkey")).alias("u"), hash_normal(7, F.col("c_custkey")).alias("z"))


# ------------------------------------------------------------- folds and resampling


def _fold_sql(rel: str, src: str, k: int, seed: str, by: str = "", key: str = "cell_id", label: str = "life", out: str = "fold") -> str:
    part = f"PARTITION BY {by}" if by else ""
    cols = f"{by}, " if by else ""
    return f"""{rel}_o AS (SELECT *, row_number() OVER ({part} ORDER BY {label}, md5({key}::VARCHAR), {key}) - 1 AS pos, {seed} AS sd FROM {src}),
  {rel}_b AS (SELECT {cols}b.sd, b.blk, i, row_number() OVER (PARTITION BY {cols}b.sd, b.blk ORDER BY md5(b.sd || ',' || b.blk || ',' || i), i) - 1 AS slot
    FROM (SELECT DISTINCT {cols}sd, pos // {k} AS blk FROM {rel}_o) b, range({k}) r(i)),
  {rel} AS (SELECT o.* EXCLUDE (pos, sd), CAST(b.i AS INTEGER) AS {out} FROM {rel}_o o JOIN {rel}_b b
    ON b.sd = o.sd AND b.blk = o.pos // {k} AND b.slot = o.pos % {k}{''.join(f' AND b.{c.strip()} = o.{c.strip()}' for c in by.split(',') if c)})"""


@query("R2 W10", f"WITH {CELLS_SQL}, {_fold_sql('fd', 'cells', 5, '7')} SELECT cell_id, fold FROM fd")
def stratified_folds(spark, sf):
    return sp.stratified_folds(cells(spark, sf), "cell_id", "life", 5, 7).select("cell_id", "fold")


_REP = f"""rep AS (SELECT cell_id, life, r AS repeat FROM cells, range(3) t(r)), {_fold_sql('fd', 'rep', 5, '2024 + repeat', 'repeat')}"""


@query("R3", f"WITH {CELLS_SQL}, {_REP} SELECT repeat::INTEGER AS repeat, cell_id, fold FROM fd")
def repeated_folds(spark, sf):
    return sp.repeated_folds(cells(spark, sf).select("cell_id", "life"), "cell_id", "life", 5, 3, 2024).select("repeat", "cell_id", "fold")


@query("R4", f"""WITH {CELLS_SQL}, rep AS (SELECT cell_id, life, r AS repeat FROM cells, range(2) t(r)), {_fold_sql('fd', 'rep', 3, '314 + repeat', 'repeat')},
  tr AS (SELECT cell_id, life, repeat, k AS outer_fold FROM fd, range(3) q(k) WHERE fold <> k),
  {_fold_sql('inr', 'tr', 3, '10000 + 100 * repeat + outer_fold', 'repeat, outer_fold', out='inner_fold')}
  SELECT repeat::INTEGER AS repeat, outer_fold::INTEGER AS outer_fold, cell_id, 'train' AS role, inner_fold FROM inr
  UNION ALL SELECT repeat::INTEGER, fold, cell_id, 'test', NULL FROM fd""")
def nested_folds(spark, sf):
    return sp.nested_folds(cells(spark, sf).select("cell_id", "life"), "cell_id", "life", 3, 2, 314).select(
        "repeat", "outer_fold", "cell_id", "role", "inner_fold"
    )


@query("J4", f"""WITH {CELLS_SQL} SELECT k::INTEGER AS split_fold, CASE WHEN cell_id % 4 = k THEN 'val' ELSE 'train' END AS role, count(*) AS n, avg(life) AS mean_life
  FROM cells, range(4) r(k) GROUP BY ALL""", "mean_life")
def fold_expansion(spark, sf):
    c = cells(spark, sf).withColumn("fold", (F.col("cell_id") % 4).cast("int"))
    return sp.expand_folds(c, 4).groupBy("split_fold", "role").agg(F.count("*").alias("n"), F.avg("life").alias("mean_life"))


@query("R5", f"WITH {CELLS_SQL}, {_REP} SELECT repeat::INTEGER AS repeat, count(*) AS n_rows, count(DISTINCT cell_id) AS n_cells FROM fd GROUP BY ALL")
def fold_coverage(spark, sf):
    f = sp.repeated_folds(cells(spark, sf).select("cell_id", "life"), "cell_id", "life", 5, 3, 2024)
    return sp.coverage_check(f, ["repeat"], "cell_id")


@query("R6 (draws)", f"""WITH ids AS (SELECT c_custkey AS cell_id FROM customer), {resamples_sql('ids', 5, 500)}
  SELECT b, count(*) FILTER (w > 0) AS n_drawn, sum(w)::BIGINT AS n_draws, max(w)::INTEGER AS most, sum(w * cell_id)::BIGINT AS check_sum FROM bw GROUP BY b""")
def bootstrap_draws(spark, sf):
    w = rs.resample_weights(cells(spark, sf).select("cell_id"), "cell_id", 500, 5).select("cell_id", F.posexplode("w").alias("b", "w"))
    return w.groupBy("b").agg(F.count_if(F.col("w") > 0).alias("n_drawn"), F.sum("w").alias("n_draws"), F.max("w").alias("most"), F.sum(F.col("w") * F.col("cell_id")).alias("check_sum"))


_RUNS = [(m, k) for m in MODELS for k in (0, 1)]


@query("R6", f"""WITH {PREDS_SQL}, ids AS (SELECT DISTINCT cell_id FROM preds), {resamples_sql('ids', 0, 2000)},
  e AS (SELECT cell_id, {', '.join(f"max((y_pred - y_true) * (y_pred - y_true)) FILTER (model = '{m}' AND seed = {k}) AS {m}{k}" for m, k in _RUNS)} FROM preds GROUP BY cell_id),
  pb AS (SELECT b, {', '.join(f'sqrt(sum(w * {m}{k}) / sum(w)) AS {m}{k}' for m, k in _RUNS)} FROM e JOIN bw USING (cell_id) GROUP BY b),
  pm AS (SELECT unnest({MODELS}) AS model, unnest([{', '.join(f'({m}0 + {m}1) / 2' for m in MODELS)}]) AS r FROM pb)
  SELECT model, quantile_cont(r, 0.025) AS lo, quantile_cont(r, 0.975) AS hi FROM pm GROUP BY ALL""", "lo hi")
def bootstrap_rmse_interval(spark, sf):
    return mt.bootstrap_metric_ci(preds(spark, sf), "cell_id", ["model"], n_boot=2000)


@query("R6 (Poisson weights)", f"""WITH ids AS (SELECT c_custkey AS cell_id FROM customer), {resamples_sql('ids', 9, 500)}
  SELECT cell_id, list(w ORDER BY b) AS w FROM bw GROUP BY cell_id""")
def poisson_draws(spark, sf):
    return rs.resample_weights(cells(spark, sf).select("cell_id"), "cell_id", 500, 9)


@query("R7 E2", f"""WITH {PREDS_SQL}, ids AS (SELECT DISTINCT cell_id FROM preds), {resamples_sql('ids', 0, 500)},
  wide AS (SELECT cell_id, seed, y_true AS y, max(y_pred) FILTER (WHERE model = 'a') AS a, max(y_pred) FILTER (WHERE model = 'b') AS b FROM preds GROUP BY ALL),
  e AS (SELECT cell_id, seed, (a - y) * (a - y) AS sa, (b - y) * (b - y) AS sb, abs(a - y) AS aa, abs(b - y) AS ab FROM wide),
  f AS (SELECT avg(dr) AS dRMSE, avg(dm) AS dMAE FROM (SELECT seed, sqrt(avg(sa)) - sqrt(avg(sb)) AS dr, avg(aa) - avg(ab) AS dm FROM e GROUP BY ALL)),
  bb AS (SELECT b, avg(d) AS d FROM (SELECT bw.b, seed, sqrt(sum(w * sa) / sum(w)) - sqrt(sum(w * sb) / sum(w)) AS d FROM e JOIN bw USING (cell_id) GROUP BY ALL) GROUP BY ALL),
  q AS (SELECT quantile_cont(d, 0.025) AS dRMSE_lo, quantile_cont(d, 0.975) AS dRMSE_hi, avg(CASE WHEN d < 0 THEN 1.0 ELSE 0.0 END) AS share_below_zero FROM bb),
  pc AS (SELECT cell_id, avg(aa) AS ma, avg(ab) AS mb FROM e GROUP BY ALL)
  SELECT f.*, q.*, (SELECT CAST(sum(CASE WHEN ma < mb THEN 1 ELSE 0 END) AS BIGINT) FROM pc) AS cells_a_better, (SELECT count(*) FROM pc) AS n_cells FROM f, q""",
       "dRMSE dMAE dRMSE_lo dRMSE_hi share_below_zero")
def paired_bootstrap(spark, sf):
    p = preds(spark, sf)
    wide = p.groupBy("cell_id", "seed", "y_true").pivot("model", ["a", "b"]).agg(F.max("y_pred"))
    return mt.paired_comparison(wide, "cell_id", [], "y_true", "a", "b", n_boot=500).drop("wilcoxon_p")


@query("R8", f"""WITH {SETS_SQL}, ids AS (SELECT cell_id FROM alarms), {resamples_sql('ids', 11, 500)},
  m AS (SELECT b, T, repeat, sum(w * CASE WHEN fail_in_set <> pass_in_set THEN 1.0 ELSE 0.0 END) / sum(w) AS v FROM sets JOIN bw USING (cell_id) WHERE alpha = 0.05 GROUP BY ALL),
  r AS (SELECT b, T, avg(v) AS v FROM m GROUP BY ALL) SELECT T, quantile_cont(v, 0.025) AS lo, quantile_cont(v, 0.975) AS hi FROM r GROUP BY ALL""", "lo hi")
def repeat_averaged_interval(spark, sf):
    s = decision_sets(spark, sf).filter("alpha = 0.05")
    sums = rs.weighted_sums(s, ["T", "repeat"], "cell_id", {"decided": (F.col("fail_in_set") != F.col("pass_in_set")).cast("int")}, 500, 11)
    return rs.bootstrap_interval(sums.groupBy("b", "T").agg(F.avg(F.try_divide("decided", "w")).alias("v")), ["T"], "v")


# ------------------------------------------------------------- regression metrics

_METRICS = """count(*) AS n, sqrt(avg((y_pred - y_true) * (y_pred - y_true))) AS RMSE, avg(abs(y_pred - y_true)) AS MAE,
  1 - sum((y_pred - y_true) * (y_pred - y_true)) / (var_pop(y_true) * count(*)) AS R2, quantile_cont(abs(y_pred - y_true), 0.5) AS MedAE,
  avg(y_pred - y_true) AS Bias, sqrt(avg((y_pred - y_true) * (y_pred - y_true))) / avg(y_true) AS nRMSE, avg(abs(y_pred - y_true)) / avg(y_true) AS nMAE,
  avg(abs(y_pred - y_true) / y_true) AS MAPE, max(abs(y_pred - y_true)) AS MaxAE, avg(y_true) AS mean_y"""
_MD = "RMSE MAE R2 MedAE Bias nRMSE nMAE MAPE MaxAE mean_y"


@query("E1", f"WITH {PREDS_SQL} SELECT model, seed, {_METRICS} FROM preds GROUP BY model, seed", _MD)
def regression_metrics(spark, sf):
    return mt.regression_metrics(preds(spark, sf), ["model", "seed"])


@query("E1 (one global group)", """WITH p AS (SELECT l_extendedprice AS y_true, l_quantity * 1013.7 * (1 - l_discount) AS y_pred FROM lineitem) """
       f"SELECT {_METRICS} FROM p", _MD, 4)
def regression_metrics_global(spark, sf):
    p = table(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("y_true"), (F.col("l_quantity") * 1013.7 * (1 - F.col("l_discount"))).alias("y_pred"))
    return mt.regression_metrics(p, [])


@query("R9", f"""WITH {PREDS_SQL}, m AS (SELECT model, seed, {_METRICS} FROM preds GROUP BY model, seed)
  SELECT model, avg(RMSE) AS RMSE_mean, avg(MAE) AS MAE_mean, stddev_samp(RMSE) AS RMSE_std, stddev_samp(MAE) AS MAE_std FROM m GROUP BY model""",
       "RMSE_mean MAE_mean RMSE_std MAE_std")
def seed_summary(spark, sf):
    return mt.summarize_seeds(mt.regression_metrics(preds(spark, sf), ["model", "seed"]), ["model"], ["RMSE", "MAE"])


@query("L4 P12", f"""WITH {CELLS_SQL}, e AS (SELECT quantile_cont(life, 1.0/3) AS lo, quantile_cont(life, 2.0/3) AS hi FROM cells WHERE partition = 'train')
  SELECT cell_id, CASE WHEN life <= lo THEN 'short' WHEN life <= hi THEN 'medium' ELSE 'long' END AS life_group, life <= lo AS early_failure FROM cells, e""")
def life_groups(spark, sf):
    c = cells(spark, sf)
    e = mt.tertile_edges(c.filter("partition = 'train'"), "life")
    return c.crossJoin(F.broadcast(e)).select("cell_id", mt.life_group("life").alias("life_group"), pl.early_failure("life", F.col("edge_low")).alias("early_failure"))


@query("E11 T8", f"""WITH {PREDS_SQL}, e AS (SELECT quantile_cont(y_true, 1.0/3) AS lo, quantile_cont(y_true, 2.0/3) AS hi FROM preds WHERE model = 'a' AND seed = 0 AND cell_id % 2 = 1),
  g AS (SELECT *, CASE WHEN y_true <= lo THEN 'short' WHEN y_true <= hi THEN 'medium' ELSE 'long' END AS life_group FROM preds, e)
  SELECT model, life_group, {_METRICS} FROM g GROUP BY model, life_group""", _MD)
def errors_by_life_group(spark, sf):
    p = preds(spark, sf)
    train = p.filter("model = 'a' AND seed = 0 AND cell_id % 2 = 1")
    return mt.errors_by_life_group(p, train, ["model"], "y_true", "y_pred", "y_true")


@query("E10 T5", f"""WITH {PREDS_SQL}, r AS (SELECT cell_id, model, avg(y_pred - y_true) AS e FROM preds GROUP BY ALL)
  SELECT x.model AS model_a, y.model AS model_b, corr(x.e, y.e) AS r FROM r x JOIN r y USING (cell_id) GROUP BY ALL""", "r")
def residual_correlation(spark, sf):
    return mt.residual_correlation(preds(spark, sf), "cell_id", MODELS)


@query("X7 T16", f"""WITH {PREDS_SQL} SELECT cell_id, y_true, avg(y_pred) FILTER (WHERE model = 'a') AS a, avg(y_pred) FILTER (WHERE model = 'b') AS b,
  avg(y_pred) FILTER (WHERE model = 'c') AS c FROM preds GROUP BY ALL""", "y_true a b c")
def predictions_wide(spark, sf):
    from ..operators.reports import predictions_by_model

    return predictions_by_model(preds(spark, sf), MODELS)


_RANKS = """avg_rank AS (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY {v}) + (count(*) OVER (PARTITION BY {by}, {v}) - 1) / 2.0 AS {r} FROM {src})"""


@query("W11 E2", """WITH d AS (SELECT l_returnflag, l_extendedprice / 1013.7 - l_quantity AS d FROM lineitem WHERE l_extendedprice / 1013.7 - l_quantity <> 0),
  k AS (SELECT *, rank() OVER (PARTITION BY l_returnflag ORDER BY abs(d)) + (count(*) OVER (PARTITION BY l_returnflag, abs(d)) - 1) / 2.0 AS r,
    count(*) OVER (PARTITION BY l_returnflag, abs(d)) AS t FROM d),
  s AS (SELECT l_returnflag, count(*) AS n_nonzero, sum(CASE WHEN d > 0 THEN r ELSE 0.0 END) AS w_plus, sum(CASE WHEN d < 0 THEN r ELSE 0.0 END) AS w_minus,
    sum((t::DOUBLE * t * t - t) / t) AS ties FROM k GROUP BY ALL)
  SELECT l_returnflag, n_nonzero, w_plus, w_minus, abs((least(w_plus, w_minus) - n_nonzero::DOUBLE * (n_nonzero + 1) / 4) /
    sqrt(n_nonzero::DOUBLE * (n_nonzero + 1) * (2 * n_nonzero + 1) / 24 - ties / 48)) AS z,
    2.0 / sqrt(2.0 * pi()) * exp(-z * z / 2) * (0.319381530 * t + -0.356563782 * t * t + 1.781477937 * t ** 3 - 1.821255978 * t ** 4 + 1.330274429 * t ** 5) AS p_value,
    FROM (SELECT *, 1.0 / (1.0 + 0.2316419 * abs((least(w_plus, w_minus) - n_nonzero::DOUBLE * (n_nonzero + 1) / 4) /
      sqrt(n_nonzero::DOUBLE * (n_nonzero + 1) * (2 * n_nonzero + 1) / 24 - ties / 48))) AS t FROM s)""", "w_plus w_minus z p_value")
def signed_ranks(spark, sf):
    p = table(spark, sf, "lineitem").select("l_returnflag", (F.col("l_extendedprice") / 1013.7).alias("a"), F.col("l_quantity").alias("b"))
    return mt.wilcoxon_signed_rank(p, ["l_returnflag"], "a", "b")


@query("M1 L4 (grouped exact quantiles)", """SELECT l_shipmode, quantile_cont(x, 0.01) AS low, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.99) AS high FROM (
  SELECT l_returnflag || l_linestatus AS l_shipmode, l_extendedprice / 7.3 AS x FROM lineitem) GROUP BY ALL""", "low median high")
def grouped_quantiles(spark, sf):
    p = table(spark, sf, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("l_shipmode"), (F.col("l_extendedprice") / 7.3).alias("x"))
    return os_.quantiles(p, ["l_shipmode"], "x", {"low": 0.01, "median": 0.5, "high": 0.99})


@query("W8 W9 (average ranks)", """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity DESC)
  + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS r FROM lineitem""", "l_quantity r")
def average_ranks(spark, sf):
    p = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_quantity")
    return os_.with_average_rank(p, ["l_returnflag"], "l_quantity", "r", descending=True).drop("l_returnflag")


# ------------------------------------------------------------- alarms


@query("E3", f"""WITH {ALARMS_SQL} SELECT lang, sum(CASE WHEN early_failure THEN r END) AS s, (sum(CASE WHEN early_failure THEN r END) - p * (p + 1) / 2.0) / (p * (n - p)) AS roc_auc
  FROM (SELECT *, rank() OVER (PARTITION BY lang ORDER BY p_fail) + (count(*) OVER (PARTITION BY lang, p_fail) - 1) / 2.0 AS r,
    count(*) OVER (PARTITION BY lang) AS n, count(*) FILTER (WHERE early_failure) OVER (PARTITION BY lang) AS p FROM alarms) GROUP BY lang, n, p""".replace("sum(CASE WHEN early_failure THEN r END) AS s, ", ""), "roc_auc")
def roc_auc(spark, sf):
    return os_.roc_auc(alarms(spark, sf), ["lang"], "p_fail", "early_failure")


_AP = """SELECT {by}sum(pos * tp / flagged::DOUBLE) / max(total) AS average_precision FROM (
  SELECT *, sum(pos) OVER ({part} ORDER BY p_fail DESC) AS tp, sum(n) OVER ({part} ORDER BY p_fail DESC) AS flagged, sum(pos) OVER ({part}) AS total
  FROM (SELECT {by}p_fail, count(*) AS n, count(*) FILTER (WHERE early_failure) AS pos FROM alarms GROUP BY ALL))"""


@query("E4 W12", f"WITH {ALARMS_SQL} {_AP.format(by='lang, ', part='PARTITION BY lang')} GROUP BY lang", "average_precision")
def average_precision(spark, sf):
    return os_.average_precision(alarms(spark, sf), ["lang"], "p_fail", "early_failure")


@query("E4 W12 (one global group)", f"WITH {ALARMS_SQL} {_AP.format(by='', part='')}", "average_precision")
def average_precision_global(spark, sf):
    return os_.average_precision(alarms(spark, sf), [], "p_fail", "early_failure")


_CUT = """cum AS (SELECT score, {by}sum(count(*) FILTER (WHERE early_failure)) OVER ({part} ORDER BY score) AS cp, sum(count(*) FILTER (WHERE early_failure)) OVER ({part}) AS pos
  FROM {src} GROUP BY {by}score),
  cuts AS (SELECT {by}rt AS recall_target, coalesce(min(CASE WHEN cp / pos::DOUBLE >= rt THEN score END), max(score)) AS cutoff
  FROM cum, (VALUES (0.95::DOUBLE), (0.9), (0.8), (0.7)) t(rt) GROUP BY {by}rt)"""
RECALLS = [0.95, 0.9, 0.8, 0.7]


@query("Q1", f"WITH {ALARMS_SQL}, {_CUT.format(by='lang, ', part='PARTITION BY lang', src='alarms')} SELECT * FROM cuts", "recall_target cutoff")
def recall_cutoffs(spark, sf):
    return os_.recall_cutoff(alarms(spark, sf), ["lang"], "score", "early_failure", RECALLS)


_ALARMED = f"""WITH {ALARMS_SQL}, {_CUT.format(by='', part='', src="(SELECT * FROM alarms WHERE fold <> 0)")},
  al AS (SELECT a.*, recall_target, score <= cutoff AS alarm FROM alarms a, cuts WHERE fold = 0)"""
_CONF = """count(*) FILTER (WHERE {f} AND {t}) AS TP, count(*) FILTER (WHERE {f} AND NOT {t}) AS FP, count(*) FILTER (WHERE NOT {f} AND {t}) AS FN,
  count(*) FILTER (WHERE NOT {f} AND NOT {t}) AS TN""".format(f="alarm", t="early_failure")


@query("Q2 E5 E8", f"""{_ALARMED}, c AS (SELECT recall_target, {_CONF} FROM al GROUP BY ALL),
  r AS (SELECT *, TP / greatest(TP + FN, 1)::DOUBLE AS recall, TP / greatest(TP + FP, 1)::DOUBLE AS precision, FP / greatest(FP + TN, 1)::DOUBLE AS false_alarm_rate FROM c)
  SELECT *, 2 * precision * recall / greatest(precision + recall, 1e-12) AS F1, (recall + 1 - false_alarm_rate) / 2 AS balanced_acc, TP + FP AS n_alarms FROM r""",
       "recall_target recall precision false_alarm_rate F1 balanced_acc")
def alarm_operating_points(spark, sf):
    a = alarms(spark, sf)
    al = pl.alarms_by_recall(a.filter("fold <> 0"), a.filter("fold = 0"), [], "score", "early_failure", RECALLS)
    return mt.confusion_metrics(al, ["recall_target"], "alarm", "early_failure")


@query("E3 E4 E5 T12", f"""WITH {ALARMS_SQL}, al AS (SELECT *, p_fail > 0.6 AS alarm FROM alarms), c AS (SELECT lang, {_CONF} FROM al GROUP BY ALL),
  r AS (SELECT *, TP / greatest(TP + FN, 1)::DOUBLE AS recall, TP / greatest(TP + FP, 1)::DOUBLE AS precision, FP / greatest(FP + TN, 1)::DOUBLE AS false_alarm_rate FROM c),
  ap AS ({_AP.format(by='lang, ', part='PARTITION BY lang')} GROUP BY lang)
  SELECT r.*, 2 * precision * recall / greatest(precision + recall, 1e-12) AS F1, (recall + 1 - false_alarm_rate) / 2 AS balanced_acc, TP + FP AS n_alarms, average_precision
  FROM r JOIN ap USING (lang)""", "recall precision false_alarm_rate F1 balanced_acc average_precision")
def alarm_metrics(spark, sf):
    a = alarms(spark, sf).withColumn("alarm", F.col("p_fail") > 0.6)
    return mt.alarm_metrics(a, ["lang"], "alarm", "early_failure", "p_fail").drop("roc_auc")


@query("E6", f"""WITH {ALARMS_SQL} SELECT lang, avg((p_fail - CASE WHEN early_failure THEN 1 ELSE 0 END) * (p_fail - CASE WHEN early_failure THEN 1 ELSE 0 END)) AS brier,
  avg(-CASE WHEN early_failure THEN ln(p_fail) ELSE ln(1 - p_fail) END) AS log_loss FROM alarms GROUP BY ALL""", "brier log_loss")
def probability_scores(spark, sf):
    return mt.brier_logloss(alarms(spark, sf), ["lang"], "p_fail", "early_failure")


@query("Q11 P12", f"""{_ALARMED} SELECT cell_id, recall_target, CASE WHEN alarm AND early_failure THEN 'true alarm' WHEN alarm THEN 'false alarm' WHEN early_failure THEN 'missed failure'
  ELSE 'correctly not flagged' END AS outcome FROM al""", "recall_target")
def alarm_outcomes(spark, sf):
    a = alarms(spark, sf)
    al = pl.alarms_by_recall(a.filter("fold <> 0"), a.filter("fold = 0"), [], "score", "early_failure", RECALLS)
    return al.select("cell_id", "recall_target", pl.outcome("alarm", "early_failure").alias("outcome"))


@query("Q10 T15", f"""{_ALARMED}, c AS (SELECT recall_target, {_CONF} FROM al GROUP BY ALL)
  SELECT 'forced_alarm_50' AS policy, recall_target, FP / greatest(FP + TN, 1)::DOUBLE AS false_alarm_rate, 1 - TP / greatest(TP + FN, 1)::DOUBLE AS missed_failure_rate FROM c""",
       "recall_target false_alarm_rate missed_failure_rate")
def forced_alarms(spark, sf):
    return pl.forced_alarms(_operating(spark, sf).withColumn("T", F.lit(50)))


def _operating(spark, sf):
    a = alarms(spark, sf)
    al = pl.alarms_by_recall(a.filter("fold <> 0"), a.filter("fold = 0"), [], "score", "early_failure", RECALLS)
    return mt.confusion_metrics(al, ["recall_target"], "alarm", "early_failure")


# ------------------------------------------------------------- conformal sets

ALPHAS = [0.05, 0.1, 0.2]
_CQ = """SELECT {by}a AS alpha, min(CASE WHEN rn = ceil((n + 1) * (1.0::DOUBLE - a)) THEN s END) AS q FROM (
  SELECT *, row_number() OVER ({part} ORDER BY s) AS rn, count(*) OVER ({part}) AS n FROM {src}), (VALUES (0.05::DOUBLE), (0.1), (0.2)) t(a) GROUP BY {by}a"""


@query("Q3", f"""WITH {ALARMS_SQL}, z AS (SELECT lang, 1 - p_fail AS s FROM alarms WHERE early_failure) {_CQ.format(by='lang, ', part='PARTITION BY lang', src='z')}""", "alpha q")
def conformal_quantiles(spark, sf):
    z = alarms(spark, sf).filter("early_failure").withColumn("s", 1 - F.col("p_fail"))
    q = os_.conformal_quantile(z, ["lang"], "s", ALPHAS)
    return q.withColumn("q", F.when(F.col("q") != float("inf"), F.col("q")))


@query("Q4", f"""WITH {PREDS_SQL}, z AS (SELECT model, abs(ln(y_pred) - ln(y_true)) AS s FROM preds WHERE seed = 0 AND cell_id % 5 <> 0),
  q AS ({_CQ.format(by='model, ', part='PARTITION BY model', src='z')})
  SELECT p.cell_id, p.model, alpha, y_pred * exp(-q) AS lo, y_pred * exp(q) AS hi FROM preds p JOIN q USING (model) WHERE seed = 0 AND cell_id % 5 = 0""", "alpha lo hi")
def life_intervals(spark, sf):
    p = preds(spark, sf).filter("seed = 0")
    out = pl.life_intervals(p.filter("cell_id % 5 <> 0"), p.filter("cell_id % 5 = 0"), ["model"], "y_true", "y_pred", ALPHAS)
    return out.select("cell_id", "model", "alpha", "lo", "hi")


@query("E7", f"""WITH {PREDS_SQL}, z AS (SELECT model, abs(ln(y_pred) - ln(y_true)) AS s FROM preds WHERE seed = 0 AND cell_id % 5 <> 0),
  q AS ({_CQ.format(by='model, ', part='PARTITION BY model', src='z')})
  SELECT model, alpha, avg(CASE WHEN y_true BETWEEN y_pred * exp(-q) AND y_pred * exp(q) THEN 1.0 ELSE 0.0 END) AS coverage, avg((y_pred * exp(q) - y_pred * exp(-q)) / y_pred) AS rel_width
  FROM preds p JOIN q USING (model) WHERE seed = 0 AND cell_id % 5 = 0 GROUP BY ALL""", "alpha coverage rel_width")
def interval_quality(spark, sf):
    p = preds(spark, sf).filter("seed = 0")
    out = pl.life_intervals(p.filter("cell_id % 5 <> 0"), p.filter("cell_id % 5 = 0"), ["model"], "y_true", "y_pred", ALPHAS)
    return mt.interval_metrics(out, ["model", "alpha"], "y_true", "lo", "hi", "y_pred")


_FP_SQL = f"""WITH {ALARMS_SQL}, zf AS (SELECT 1 - p_fail AS s FROM alarms WHERE early_failure AND fold <> 0), zp AS (SELECT p_fail AS s FROM alarms WHERE NOT early_failure AND fold <> 0),
  qf AS ({_CQ.format(by='', part='', src='zf')}), qp AS ({_CQ.format(by='', part='', src='zp')}),
  fp AS (SELECT cell_id, early_failure, qf.alpha, coalesce(1 - p_fail <= qf.q, true) AS fail_in_set, coalesce(p_fail <= qp.q, true) AS pass_in_set
    FROM alarms, qf JOIN qp USING (alpha) WHERE fold = 0)"""


def _fp(spark, sf):
    a = alarms(spark, sf)
    return pl.fail_pass_sets(a.filter("fold <> 0"), a.filter("fold = 0"), [], "p_fail", "early_failure", ALPHAS)


@query("Q5", f"{_FP_SQL} SELECT cell_id, alpha, fail_in_set, pass_in_set FROM fp", "alpha")
def fail_pass_sets(spark, sf):
    return _fp(spark, sf).select("cell_id", "alpha", "fail_in_set", "pass_in_set")


@query("E9", f"""{_FP_SQL}, z AS (SELECT *, early_failure AS t, fail_in_set AS fs, pass_in_set AS ps FROM fp)
  SELECT alpha, avg((fs <> ps)::INT) AS decided, count(*) FILTER (WHERE fs <> ps AND ((fs AND NOT t) OR (ps AND t))) / greatest(count(*) FILTER (WHERE fs <> ps), 1)::DOUBLE AS error_among_decided,
    avg(CASE WHEN t THEN fs::INT ELSE ps::INT END) AS coverage, count(*) FILTER (WHERE fs AND NOT ps AND NOT t) / greatest(count(*) FILTER (WHERE NOT t), 1)::DOUBLE AS false_alarm_rate,
    count(*) FILTER (WHERE fs AND NOT ps AND t) / greatest(count(*) FILTER (WHERE t), 1)::DOUBLE AS failures_caught,
    count(*) FILTER (WHERE ps AND NOT fs AND t) / greatest(count(*) FILTER (WHERE t), 1)::DOUBLE AS failures_cleared, 1 - avg((fs <> ps)::INT) AS deferred FROM z GROUP BY alpha""",
       "alpha decided error_among_decided coverage false_alarm_rate failures_caught failures_cleared deferred")
def conformal_set_quality(spark, sf):
    return mt.conformal_set_metrics(_fp(spark, sf), ["alpha"], "early_failure", "fail_in_set", "pass_in_set")


# ------------------------------------------------------------- stopping policies

_STOP_SQL = SETS_SQL + """,
  hit AS (SELECT repeat, policy, alpha, cell_id, max(y_true) AS true_life, bool_or(early_failure) AS early_failure, min(CASE WHEN fail_in_set <> pass_in_set THEN T END) AS at_t,
    arg_min(fail_in_set, CASE WHEN fail_in_set <> pass_in_set THEN T END) AS f FROM sets JOIN pol USING (T) GROUP BY ALL),
  stop AS (SELECT repeat, policy, alpha, cell_id, true_life, early_failure, CASE WHEN at_t IS NULL THEN (CASE WHEN early_failure THEN 'FAIL' ELSE 'PASS' END)
      WHEN f THEN 'FAIL' ELSE 'PASS' END AS decision, coalesce(at_t::DOUBLE, true_life) AS stopped_at_cycle, at_t IS NOT NULL AS decided_early FROM hit),
  dec AS (SELECT *, (decision = 'FAIL') = early_failure AS correct FROM stop)"""


def _decisions(spark, sf):
    return pl.stop_decisions(decision_sets(spark, sf), pl.policy_table(spark, POLICIES), ["repeat"])


@query("Q7 P16 D15", f"WITH {_STOP_SQL} SELECT * FROM dec", "alpha true_life stopped_at_cycle")
def stop_decisions(spark, sf):
    return _decisions(spark, sf)


def _sum_sql(w: str, scale: str = "") -> str:
    return f"""sum({w} * stopped_at_cycle) / sum({w}) AS avg_test_cycles, sum({w} * true_life) / sum({w}) AS full_test_cycles,
    1 - sum({w} * stopped_at_cycle) / sum({w} * true_life) AS test_time_saved, sum(CASE WHEN decided_early THEN {w} ELSE 0 END) / sum({w})::DOUBLE AS decided_early,
    sum(CASE WHEN NOT correct THEN {w} ELSE 0 END) / sum({w})::DOUBLE AS wrong_decisions, sum(CASE WHEN decision = 'PASS' AND early_failure THEN {w} ELSE 0 END)::DOUBLE{scale} AS missed_failures,
    sum(CASE WHEN decision = 'FAIL' AND NOT early_failure THEN {w} ELSE 0 END)::DOUBLE{scale} AS false_failures,
    sum(CASE WHEN decision = 'FAIL' AND NOT early_failure THEN {w} ELSE 0 END) / greatest(sum(CASE WHEN NOT early_failure THEN {w} ELSE 0 END), 1)::DOUBLE AS false_alarm_rate,
    sum(CASE WHEN decision = 'PASS' AND early_failure THEN {w} ELSE 0 END) / greatest(sum(CASE WHEN early_failure THEN {w} ELSE 0 END), 1)::DOUBLE AS missed_failure_rate,
    sum({w})::DOUBLE{scale} AS n_cells, sum(CASE WHEN early_failure THEN {w} ELSE 0 END)::DOUBLE{scale} AS n_failures"""


_NAMES = pl.SUMMARY_NAMES
_AVG = ", ".join(f"avg({n}) AS {n}" for n in _NAMES)


@query("Q8", f"WITH {_STOP_SQL}, s AS (SELECT repeat, policy, alpha, {_sum_sql('1')} FROM dec GROUP BY repeat, policy, alpha) SELECT policy, alpha, {_AVG} FROM s GROUP BY policy, alpha",
       "alpha " + " ".join(_NAMES))
def policy_summary(spark, sf):
    return pl.policy_summary(_decisions(spark, sf), repeat="repeat")


_LONG = f"UNPIVOT {{0}} ON {', '.join(_NAMES)} INTO NAME metric VALUE v"


@query("Q8 R8 T14", f"""WITH {_STOP_SQL}, ids AS (SELECT cell_id FROM alarms), {resamples_sql('ids', 3, 500)},
  s AS (SELECT repeat, policy, alpha, {_sum_sql('1')} FROM dec GROUP BY repeat, policy, alpha), m AS (SELECT policy, alpha, {_AVG} FROM s GROUP BY policy, alpha),
  t AS (SELECT b, repeat, policy, alpha, {_sum_sql('w', ' * count(*) / sum(w)')} FROM dec JOIN bw USING (cell_id) GROUP BY b, repeat, policy, alpha), u AS (SELECT b, policy, alpha, {_AVG} FROM t GROUP BY b, policy, alpha),
  ml AS (SELECT policy, alpha, metric, v AS mean FROM ({_LONG.format('m')})), ul AS (SELECT policy, alpha, metric, quantile_cont(v, 0.025) AS lo, quantile_cont(v, 0.975) AS hi
    FROM ({_LONG.format('u')}) GROUP BY ALL)
  SELECT * FROM ml JOIN ul USING (policy, alpha, metric)""", "alpha mean lo hi")
def policy_summary_intervals(spark, sf):
    return pl.policy_summary_ci(_decisions(spark, sf), n_boot=500)


@query("Q9", f"""WITH {_STOP_SQL}, x AS (SELECT repeat, d.policy, alpha, p.T AS checkpoint, avg((decided_early AND stopped_at_cycle <= p.T)::INT) AS s FROM dec d JOIN pol p USING (policy) GROUP BY ALL)
  SELECT policy, alpha, checkpoint, avg(s) AS cum_share_decided FROM x GROUP BY ALL""", "alpha cum_share_decided")
def share_decided_by_checkpoint(spark, sf):
    return pl.share_decided(_decisions(spark, sf), pl.policy_table(spark, POLICIES), repeat="repeat")


# ------------------------------------------------------------- protocols


@query("J12 J11", """WITH o AS (SELECT o_orderkey AS cell_id, o_totalprice AS life, o_orderpriority || '/' || (o_custkey % 97) AS protocol,
    CASE WHEN o_orderkey % 3 = 0 THEN 'train' ELSE 'test' END AS partition FROM orders), t AS (SELECT protocol, avg(life) AS lookup_life FROM o WHERE partition = 'train' GROUP BY ALL)
  SELECT cell_id, protocol, lookup_life, lookup_life IS NOT NULL AS seen FROM o LEFT JOIN t USING (protocol) WHERE partition = 'test'""", "lookup_life")
def protocol_lookup(spark, sf):
    return _lookup(spark, sf).select("cell_id", "protocol", "lookup_life", "seen")


def _lookup(spark, sf):
    o = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("cell_id"), F.col("o_totalprice").alias("life"),
        F.concat_ws("/", "o_orderpriority", (F.col("o_custkey") % 97).cast("string")).alias("protocol"),
        F.when(F.col("o_orderkey") % 3 == 0, "train").otherwise("test").alias("partition"),
    )
    return pl.protocol_lookup(o, "cell_id", "protocol", "life")


@query("E12 P15", f"""WITH {PREDS_SQL}, tr AS (SELECT DISTINCT protocol FROM preds WHERE cell_id % 7 = 0 AND y_true < 900), z AS (SELECT model, y_true, y_pred,
    CASE WHEN protocol <> '5-LOW' THEN 'seen' ELSE 'unseen' END AS g FROM preds),
  g AS (SELECT * FROM z UNION ALL SELECT model, y_true, y_pred, g || '_life<=1100' FROM z WHERE y_true <= 1100)
  SELECT model, g AS "group", count(*) AS n, avg(y_true) AS mean_life, avg(abs(y_pred - y_true)) AS MAE, sqrt(avg((y_pred - y_true) * (y_pred - y_true))) AS RMSE,
    100 * avg(abs(y_pred - y_true) / y_true) AS MAPE_pct FROM g GROUP BY ALL""", "mean_life MAE RMSE MAPE_pct")
def seen_unseen_errors(spark, sf):
    p = preds(spark, sf).withColumn("seen", F.col("protocol") != "5-LOW")
    return pl.seen_unseen_errors(p, ["model"], "y_true", "y_pred")


@query("T14", f"""WITH {_STOP_SQL}, ids AS (SELECT cell_id FROM alarms), {resamples_sql('ids', 3, 500)},
  s AS (SELECT repeat, policy, alpha, {_sum_sql('1')} FROM dec GROUP BY repeat, policy, alpha), m AS (SELECT policy, alpha, {_AVG} FROM s GROUP BY policy, alpha),
  t AS (SELECT b, repeat, policy, alpha, {_sum_sql('w', ' * count(*) / sum(w)')} FROM dec JOIN bw USING (cell_id) GROUP BY b, repeat, policy, alpha), u AS (SELECT b, policy, alpha, {_AVG} FROM t GROUP BY b, policy, alpha),
  q AS (SELECT policy, alpha, quantile_cont(avg_test_cycles, 0.025) AS lo, quantile_cont(avg_test_cycles, 0.975) AS hi FROM u GROUP BY ALL)
  SELECT policy, alpha, printf('%.1f [%.1f, %.1f]', avg_test_cycles, lo, hi) AS avg_test_cycles FROM m JOIN q USING (policy, alpha)""", "alpha")
def policy_table_text(spark, sf):
    from ..operators.reports import interval_pivot

    return interval_pivot(pl.policy_summary_ci(_decisions(spark, sf), n_boot=500), ["policy", "alpha"], ["avg_test_cycles"])


# ------------------------------------------------------------- resampled new and baseline models

_NESTED_SQL = ALARMS_SQL + """,
nested AS (
  SELECT *, 0.71 * pred_life AS lo90, 1.37 * pred_life AS hi90, 0.73 * base_pred_life AS base_lo90, 1.41 * base_pred_life AS base_hi90,
    p_fail > 0.453 AS alarm, base_pred_life < 1503.1 AS base_alarm, p_fail > 0.303 + 0.003 * T AS fail_in_set, p_fail < 0.601 AS pass_in_set
  FROM (SELECT cell_id, T, repeat, 200.0 + n_chars AS y_true, early_failure, n_chars / (n_chars + 900.0) * (0.5137 + (cell_id * 3 + T + repeat) % 7 / 14.3) AS p_fail,
    (200.0 + n_chars) * (0.8137 + (cell_id * 7 + T + repeat * 3) % 13 / 31.7) AS pred_life, 300.0 + 0.7137 * n_chars + 11.3 * ((cell_id * 5 + T * 2 + repeat) % 17) AS base_pred_life
    FROM alarms, (VALUES (5), (20)) c(T), (VALUES (0), (1)) r(repeat)))"""


def _nested(spark, sf):
    rows = alarms(spark, sf).select("cell_id", "early_failure", F.col("n_chars").alias("c"))
    rows = rows.withColumn("T", F.explode(F.array(F.lit(5), F.lit(20)))).withColumn("repeat", F.explode(F.array(F.lit(0), F.lit(1))))
    k, t, r, c = F.col("cell_id"), F.col("T"), F.col("repeat"), F.col("c")
    rows = rows.select(
        "cell_id", "T", "repeat", "early_failure", (200.0 + c).alias("y_true"), (c / (c + 900.0) * (0.5137 + (k * 3 + t + r) % 7 / 14.3)).alias("p_fail"),
        ((200.0 + c) * (0.8137 + (k * 7 + t + r * 3) % 13 / 31.7)).alias("pred_life"), (300.0 + 0.7137 * c + 11.3 * ((k * 5 + t * 2 + r) % 17)).alias("base_pred_life"),
    )
    ends = {"lo90": 0.71 * F.col("pred_life"), "hi90": 1.37 * F.col("pred_life"), "base_lo90": 0.73 * F.col("base_pred_life"), "base_hi90": 1.41 * F.col("base_pred_life")}
    p = F.col("p_fail")
    return rows.withColumns(ends | {"alarm": p > 0.453, "base_alarm": F.col("base_pred_life") < 1503.1, "fail_in_set": p > 0.303 + 0.003 * t, "pass_in_set": p < 0.601})


def _metric_sql() -> str:
    part = lambda hit, of: f"sum(w * ({hit})::INT) / greatest(sum(w * ({of})::INT), 1)::DOUBLE"
    share = lambda hit: f"sum(w * ({hit})::INT) / sum(w)::DOUBLE"
    f, fail, ok, out = "early_failure", "fail_in_set", "pass_in_set", {}
    for k, pre in (("new", ""), ("base", "base_")):
        p = f"{pre}pred_life"
        out |= {f"reg_{k}_RMSE": f"sqrt(sum(w * ({p} - y_true) * ({p} - y_true)) / sum(w))", f"reg_{k}_MAE": f"sum(w * abs({p} - y_true)) / sum(w)", f"reg_{k}_MAPE": f"sum(w * abs({p} - y_true) / y_true) / sum(w)"}
        out |= {f"reg_{k}_coverage90": share(f"y_true BETWEEN {pre}lo90 AND {pre}hi90"), f"reg_{k}_rel_width90": f"sum(w * ({pre}hi90 - {pre}lo90) / {p}) / sum(w)"}
        out |= {f"clf_{k}_recall": part(f"{pre}alarm AND {f}", f), f"clf_{k}_precision": part(f"{pre}alarm AND {f}", f"{pre}alarm"), f"clf_{k}_false_alarm_rate": part(f"{pre}alarm AND NOT {f}", f"NOT {f}")}
    wrong = f"{fail} <> {ok} AND (({fail} AND NOT {f}) OR ({ok} AND {f}))"
    out |= {"clf_new_Brier": f"sum(w * (p_fail - {f}::INT) * (p_fail - {f}::INT)) / sum(w)", "conf_decided": share(f"{fail} <> {ok}"), "conf_error_among_decided": part(wrong, f"{fail} <> {ok}")}
    out |= {"conf_coverage": share(f"CASE WHEN {f} THEN {fail} ELSE {ok} END"), "conf_false_alarm_rate": part(f"{fail} AND NOT {ok} AND NOT {f}", f"NOT {f}")}
    out |= {"conf_failures_caught": part(f"{fail} AND NOT {ok} AND {f}", f), "conf_failures_cleared": part(f"{ok} AND NOT {fail} AND {f}", f), "conf_deferred": f"1 - {share(f'{fail} <> {ok}')}"}
    return ",\n    ".join(f"{e} AS {k}" for k, e in out.items())


_RESAMPLED_SQL = f"""{_NESTED_SQL}, ids AS (SELECT DISTINCT cell_id FROM nested), {resamples_sql('ids', 7, 500)},
  wt AS (SELECT b, cell_id, w FROM bw UNION ALL SELECT -1, cell_id, 1 FROM ids),
  s AS (SELECT b, T, repeat, {_metric_sql()} FROM nested JOIN wt USING (cell_id) GROUP BY b, T, repeat),
  v AS (SELECT b, T, repeat, k, sc, sum(CASE WHEN early_failure THEN w ELSE 0 END) AS p, sum(CASE WHEN early_failure THEN 0 ELSE w END) AS n
    FROM (SELECT *, unnest(['new', 'base']) AS k, unnest([p_fail, -base_pred_life]) AS sc FROM nested) JOIN wt USING (cell_id) GROUP BY b, T, repeat, k, sc),
  c AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY b, T, repeat, k ORDER BY sc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb,
    sum(p) OVER (PARTITION BY b, T, repeat, k ORDER BY sc DESC) AS tp, sum(p + n) OVER (PARTITION BY b, T, repeat, k ORDER BY sc DESC) AS al FROM v),
  r AS (SELECT b, T, repeat, k, CASE WHEN sum(p) > 0 AND sum(n) > 0 THEN sum(p * (nb + n / 2.0)) / (sum(p) * sum(n))::DOUBLE END AS auc,
    CASE WHEN sum(p) > 0 AND sum(n) > 0 THEN sum(CASE WHEN al > 0 THEN p * tp / al::DOUBLE ELSE 0 END) / sum(p)::DOUBLE END AS ap FROM c GROUP BY b, T, repeat, k),
  wide AS (SELECT s.*, x.auc AS clf_new_ROC_AUC, x.ap AS clf_new_PR_AUC, y.auc AS clf_base_ROC_AUC, y.ap AS clf_base_PR_AUC
    FROM s JOIN (SELECT * FROM r WHERE k = 'new') x USING (b, T, repeat) JOIN (SELECT * FROM r WHERE k = 'base') y USING (b, T, repeat)),
  one AS (SELECT b, T, avg(COLUMNS(* EXCLUDE (b, T, repeat))) FROM wide GROUP BY b, T),
  kept AS (SELECT b, T, bool_and(clf_new_ROC_AUC IS NOT NULL) AS ok FROM wide GROUP BY b, T),
  skipped AS (SELECT T, count(*) FILTER (NOT ok AND b >= 0) AS n_skipped FROM kept GROUP BY T)"""


def _resampled(spark, sf):
    return rs.resampled_metrics(_nested(spark, sf), ["T"], n_boot=500, seed=7)


@query("T13 R8 E3 E4 E7 E9", f"""WITH {_RESAMPLED_SQL}, l AS (UNPIVOT one ON COLUMNS(* EXCLUDE (b, T)) INTO NAME metric VALUE x)
  SELECT l.T, metric, max(x) FILTER (l.b = -1) AS mean, quantile_cont(x, 0.025) FILTER (l.b >= 0 AND ok) AS lo95, quantile_cont(x, 0.975) FILTER (l.b >= 0 AND ok) AS hi95,
    2::BIGINT AS n_repeats, any_value(n_skipped) AS n_skipped FROM l JOIN kept ON kept.b = l.b AND kept.T = l.T JOIN skipped ON skipped.T = l.T GROUP BY l.T, metric""", "mean lo95 hi95")
def resampled_metric_table(spark, sf):
    return rs.resampled_metric_table(*_resampled(spark, sf), ["T"])


@query("T13 R7", f"""WITH {_RESAMPLED_SQL}, d AS (SELECT b, T, reg_new_MAE - reg_base_MAE AS "dMAE", reg_new_RMSE - reg_base_RMSE AS "dRMSE", clf_new_PR_AUC - clf_base_PR_AUC AS "dPR_AUC",
    clf_new_ROC_AUC - clf_base_ROC_AUC AS "dROC_AUC" FROM one), l AS (UNPIVOT d ON "dMAE", "dRMSE", "dPR_AUC", "dROC_AUC" INTO NAME difference VALUE x)
  SELECT l.T, difference, max(x) FILTER (l.b = -1) AS estimate, quantile_cont(x, 0.025) FILTER (l.b >= 0 AND ok) AS lo95, quantile_cont(x, 0.975) FILTER (l.b >= 0 AND ok) AS hi95,
    avg(CASE WHEN difference IN ('dMAE', 'dRMSE') THEN x < 0 ELSE x > 0 END::INT) FILTER (l.b >= 0 AND ok) AS share_better, any_value(n_skipped) AS n_skipped
  FROM l JOIN kept ON kept.b = l.b AND kept.T = l.T JOIN skipped ON skipped.T = l.T GROUP BY l.T, difference""", "estimate lo95 hi95 share_better")
def resampled_differences(spark, sf):
    return rs.paired_difference_table(*_resampled(spark, sf), ["T"])


@query("T13 T14", f"""WITH {_RESAMPLED_SQL}, l AS (UNPIVOT one ON reg_new_MAE, reg_base_MAE, reg_new_RMSE, reg_base_RMSE INTO NAME metric VALUE x),
  q AS (SELECT l.T, metric, printf('%.1f [%.1f, %.1f]', max(x) FILTER (l.b = -1), quantile_cont(x, 0.025) FILTER (l.b >= 0 AND ok), quantile_cont(x, 0.975) FILTER (l.b >= 0 AND ok)) AS line
    FROM l JOIN kept ON kept.b = l.b AND kept.T = l.T GROUP BY l.T, metric)
  SELECT T, max(line) FILTER (metric = 'reg_new_MAE') AS "reg_new_MAE", max(line) FILTER (metric = 'reg_base_MAE') AS "reg_base_MAE", max(line) FILTER (metric = 'reg_new_RMSE') AS "reg_new_RMSE",
    max(line) FILTER (metric = 'reg_base_RMSE') AS "reg_base_RMSE" FROM q GROUP BY T""")
def resampled_report(spark, sf):
    from ..operators.reports import interval_pivot

    rows = rs.resampled_metric_table(*_resampled(spark, sf), ["T"]).withColumnsRenamed({"lo95": "lo", "hi95": "hi"})
    return interval_pivot(rows, ["T"], ["reg_new_MAE", "reg_base_MAE", "reg_new_RMSE", "reg_base_RMSE"])
