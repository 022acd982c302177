"""Report tables as DataFrames, one row per printed row."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import format_fixed, format_signed, format_signed_percent, interval_text, mean_pm_std, number_text, percent_effect
from .policy import outcome


def predictions_by_model(preds: DataFrame, models: Sequence[str], key: str = "cell_id") -> DataFrame:
    """Seed-averaged prediction of every entity, one column per model."""
    return preds.groupBy(key, "y_true").pivot("model", list(models)).agg(F.avg("y_pred"))


def metric_text(df: DataFrame, by: Sequence[str], metrics: Sequence[str], digits: int = 1) -> DataFrame:
    """'mean ± sd' text of every metric from its _mean and _std columns."""
    return df.select(*by, *[mean_pm_std(f"{m}_mean", f"{m}_std", digits).alias(m) for m in metrics])


def main_benchmark(test: DataFrame, oof: DataFrame, ci: DataFrame, final: str) -> DataFrame:
    """Benchmark rows: test metrics, bootstrap interval, cross-validated error and a star for the final ensemble."""
    star = F.when(F.col("model") == final, F.concat("model", F.lit(" ★"))).otherwise(F.col("model"))
    cv = oof.select("model", F.col("RMSE_mean").alias("cv_mean"), F.col("RMSE_std").alias("cv_std"))
    t = test.join(ci.select("model", "lo", "hi"), "model", "left").join(cv, "model", "left")
    return t.select(
        star.alias("Model"), mean_pm_std("RMSE_mean", "RMSE_std").alias("RMSE"), F.concat(F.lit("["), number_text("lo", 0), F.lit(", "), number_text("hi", 0), F.lit("]")).alias("CI95"),
        mean_pm_std("MAE_mean", "MAE_std").alias("MAE"), mean_pm_std("MedAE_mean", "MedAE_std").alias("MedAE"),
        format_fixed("R2_mean", 3).alias("R2"), format_signed("Bias_mean").alias("Bias"), format_fixed("nRMSE_mean", 3).alias("nRMSE"),
        format_fixed(100 * F.col("MAPE_mean"), 1).alias("MAPE_pct"), mean_pm_std("cv_mean", "cv_std").alias("CV_RMSE"),
    )


def baseline_reproduction(ours: DataFrame, published: DataFrame) -> DataFrame:
    """Own error beside a published number per model; models that were not run show '-'."""
    return published.join(ours, "model", "left").select(
        "model", F.coalesce(mean_pm_std("RMSE", F.coalesce("RMSE_std", F.lit(0.0))), F.lit("-")).alias("our_rmse"), "published_rmse"
    )


def paired_table(comparisons: DataFrame) -> DataFrame:
    return comparisons.select(
        "versus", format_signed("dRMSE").alias("d_rmse"), F.concat(F.lit("["), number_text("dRMSE_lo", 1, True), F.lit(", "), number_text("dRMSE_hi", 1, True), F.lit("]")).alias("ci95"),
        format_fixed("share_below_zero", 2).alias("p_below_zero"), format_signed("dMAE").alias("d_mae"),
        format_fixed("wilcoxon_p", 3).alias("wilcoxon_p"), F.format_string("%d/%d", "cells_a_better", "n_cells").alias("cells_better"),
    )


def role_table(summary: DataFrame, roles: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows of chosen models per configuration (feature set or horizon): ``roles`` is (by..., role, model)."""
    return roles.join(summary, [*by, "model"]).select(
        *by, "role", "model", mean_pm_std("RMSE_mean", "RMSE_std").alias("test_rmse"), mean_pm_std("MAE_mean", "MAE_std").alias("test_mae"),
        mean_pm_std("cv_mean", "cv_std").alias("cv_rmse"),
    )


def mean_weights(weights: DataFrame) -> DataFrame:
    """Mean member weights of each combiner over seeds as text, e.g. 'a=0.40, b=0.60'."""
    m = weights.groupBy("combiner", "model").agg(F.avg("weight").alias("w"))
    items = F.transform(F.sort_array(F.collect_list(F.struct("model", "w"))), lambda s: F.concat(s["model"], F.lit("="), number_text(s["w"], 2)))
    return m.groupBy("combiner").agg(F.array_join(items, ", ").alias("mean_weights"))


def delta_pivot(summary: DataFrame, row: str, column: str, names: Sequence[str], mean: str, std: str) -> DataFrame:
    """'+x.x ± y.y' cells, one column per name."""
    text = F.concat(number_text(mean, 1, True), F.lit(" ± "), number_text(F.coalesce(std, F.lit(0.0)), 1))
    return summary.groupBy(row).pivot(column, list(names)).agg(F.first(text))


def group_share_pivot(by_horizon: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """Consensus share per mechanism group and horizon as 'share ± spread', with the mean share for ordering."""
    cell = lambda t: F.max(
        F.when(F.col("T") == t, F.concat(number_text("consensus_share", 2), F.lit(" ± "), number_text(F.coalesce("between_model_std", F.lit(0.0)), 2)))
    ).alias(f"T{t}")
    return by_horizon.groupBy("grp").agg(*[cell(t) for t in horizons], F.avg("consensus_share").alias("mean_share"))


def top_features(stability: DataFrame, k: int = 6) -> DataFrame:
    w = Window.partitionBy("T").orderBy("rank", "feature")
    t = stability.withColumn("row", F.row_number().over(w)).filter(F.col("row") <= k)
    return t.select(
        "T", "row", "feature", "grp", format_fixed("consensus_share", 3).alias("share"), format_fixed("top_frequency", 2).alias("top_frequency"),
        F.concat("learned_sign_majority", F.lit(" ("), "sign_agreement", F.lit(")")).alias("learned_sign"), "expected_sign", "plausibility",
    )


def ablation_pivot(consensus: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """'error (change)' per configuration and horizon."""
    text = F.concat(number_text("cv_mae", 1), F.lit(" ("), number_text("d_cv_mae", 1, True), F.lit(")"))
    return consensus.groupBy("config").agg(*[F.max(F.when(F.col("T") == t, text)).alias(f"T{t}") for t in horizons])


def interval_pivot(long: DataFrame, by: Sequence[str], metrics: Sequence[str], scale: float = 1.0, digits: int = 1) -> DataFrame:
    """'mean [lo, hi]' per metric column from (metric, mean, lo, hi) rows."""
    s = F.lit(scale)
    text = interval_text(s * F.col("mean"), s * F.col("lo"), s * F.col("hi"), digits)
    return long.groupBy(*by).agg(*[F.max(F.when(F.col("metric") == m, text)).alias(m) for m in metrics])


def driver_texts(group_phi: DataFrame, feature_phi: DataFrame, key: str, protocol_groups: Sequence[str]) -> DataFrame:
    """Per entity: up to three degradation groups that pull life down, the protocol effect, and the features behind it.

    Without a negative group the lowest one names the features.
    """
    is_protocol = F.col("grp").isin(list(protocol_groups))
    deg = group_phi.filter(~is_protocol)
    low = Window.partitionBy(key).orderBy("phi", "grp")  # groups of one entity
    ranked = deg.withColumn("r", F.row_number().over(low))
    item = F.concat(F.col("grp"), F.lit(" "), format_signed_percent(percent_effect("phi")))
    texts = F.transform(F.sort_array(F.collect_list(F.when((F.col("phi") < 0) & (F.col("r") <= 3), F.struct("r", item.alias("t"))))), lambda s: s["t"])
    down = ranked.groupBy(key).agg(F.array_join(texts, "; ").alias("life_pulled_down_by"), F.min_by("grp", "r").alias("top_group"))
    proto = group_phi.filter(is_protocol).groupBy(key).agg(format_signed_percent(percent_effect(F.sum("phi"))).alias("protocol_proxy_effect"))
    w = Window.partitionBy(key).orderBy("phi", "feature")
    feats = (
        feature_phi.join(down.select(key, F.col("top_group").alias("grp")), [key, "grp"])
        .withColumn("r", F.row_number().over(w)).filter("r <= 3")
        .groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "feature"))), lambda s: s["feature"]), ", ").alias("key_features_in_top_group"))
    )
    return down.join(proto, key, "left").join(feats, key, "left")


def driver_texts_wide(entities: DataFrame, phi: dict[str, str], members: dict[str, Sequence[str]], key: str, protocol_groups: Sequence[str]) -> DataFrame:
    """The texts of ``driver_texts`` from one row per entity, without a shuffle.

    ``phi`` names the column of each feature, ``members`` the features of each group. Missing values are left out.
    """
    zero = F.lit(0.0)
    total = lambda cols: F.when(F.coalesce(*cols).isNotNull(), sum((F.coalesce(c, zero) for c in cols), zero))
    present = lambda structs: F.filter(F.array(*structs), lambda s: s["phi"].isNotNull())
    columns = {g: [F.col(phi[f]) for f in fs if f in phi] for g, fs in members.items()}
    columns = {g: cols for g, cols in columns.items() if cols}
    degradation = [g for g in columns if g not in protocol_groups]
    text = lambda v: format_signed_percent(percent_effect(v))
    groups = present([F.struct(total(columns[g]).alias("phi"), F.lit(g).alias("grp"), text(total(columns[g])).alias("t")) for g in degradation])
    features = present([F.struct(F.col(phi[f]).alias("phi"), F.lit(f).alias("feature"), F.lit(g).alias("grp")) for g in degradation for f in members[g] if f in phi])
    protocol = [c for g in columns if g in protocol_groups for c in columns[g]]
    rows = entities.select(key, F.sort_array(groups).alias("__g"), F.sort_array(features).alias("__f"), *[
        (text(total(protocol)) if protocol else F.lit(None).cast("string")).alias("protocol_proxy_effect")
    ]).filter(F.size("__g") > 0).withColumn("top_group", F.col("__g")[0]["grp"])
    down = F.transform(F.filter(F.slice("__g", 1, 3), lambda s: s["phi"] < 0), lambda s: F.concat(s["grp"], F.lit(" "), s["t"]))
    top = F.transform(F.slice(F.filter("__f", lambda s: s["grp"] == F.col("top_group")), 1, 3), lambda s: s["feature"])
    return rows.select(key, F.array_join(down, "; ").alias("life_pulled_down_by"), "top_group", "protocol_proxy_effect",
                       F.array_join(top, ", ").alias("key_features_in_top_group"))


def maintenance_report(flags: DataFrame, life: DataFrame, drivers: DataFrame, key: str = "cell_id") -> DataFrame:
    """One row per entity, alarms first, then the shortest consensus life.

    ``flags``: (key, alarm, early_failure, risk_score, alarm_model); ``life``:
    (key, true_life, consensus_pred_life).
    """
    out = flags.join(life, key).join(drivers, key, "left").withColumn("outcome", outcome("alarm", "early_failure"))
    return out.orderBy(F.col("alarm").desc(), "consensus_pred_life", key)
