"""Regression, classification and paired statistics over long prediction tables."""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import ratio
from .order_stats import _join, average_precision, quantiles, roc_auc, value_profile
from .resampling import bootstrap_interval, weighted_sums

EXACT_PAIRS = 50


def regression_metrics(
    preds: DataFrame, by: Sequence[str], y: str = "y_true", p: str = "y_pred", ref_mean: float | None = None
) -> DataFrame:
    """RMSE, MAE, R2, MedAE, Bias, nRMSE, nMAE, MAPE and MaxAE per group (errors are prediction - truth)."""
    by = list(by)
    e = F.col(p) - F.col(y)
    rows = preds.select(*by, F.col(y).cast("double").alias("__y"), e.cast("double").alias("__e"), F.abs(e).alias("__ae"))
    agg = rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.sqrt(F.avg(F.col("__e") * F.col("__e"))).alias("RMSE"),
        F.avg("__ae").alias("MAE"),
        (F.lit(1.0) - ratio(F.sum(F.col("__e") * F.col("__e")), F.var_pop("__y") * F.count("*"))).alias("R2"),
        F.avg("__e").alias("Bias"),
        F.avg(ratio("__ae", "__y")).alias("MAPE"),
        F.max("__ae").alias("MaxAE"),
        F.avg("__y").alias("mean_y"),
    )
    ref = F.col("mean_y") if ref_mean is None else F.lit(float(ref_mean))
    med = quantiles(rows, by, "__ae", {"MedAE": 0.5})
    return (
        _join(agg, med, by, "left")
        .withColumns({"nRMSE": ratio("RMSE", ref), "nMAE": ratio("MAE", ref)})
        .select(*by, "n", "RMSE", "MAE", "R2", "MedAE", "Bias", "nRMSE", "nMAE", "MAPE", "MaxAE", "mean_y")
    )


def summarize_seeds(per_seed: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean and sample std over seeds; one seed has spread 0."""
    return per_seed.groupBy(*by).agg(
        *[F.avg(m).alias(f"{m}_mean") for m in metrics],
        *[F.coalesce(F.stddev_samp(m), F.lit(0.0)).alias(f"{m}_std") for m in metrics],
    )


def tertile_edges(train: DataFrame, y: str, by: Sequence[str] = ()) -> DataFrame:
    return quantiles(train, by, y, {"edge_low": 1.0 / 3.0, "edge_high": 2.0 / 3.0})


def life_group(y: Column | str) -> Column:
    """'short', 'medium' or 'long' by the columns edge_low and edge_high."""
    y = F.col(y) if isinstance(y, str) else y
    return F.when(y <= F.col("edge_low"), "short").when(y <= F.col("edge_high"), "medium").otherwise("long")


def errors_by_life_group(preds: DataFrame, train: DataFrame, by: Sequence[str], y: str, p: str, train_y: str) -> DataFrame:
    rows = preds.crossJoin(F.broadcast(tertile_edges(train, train_y)))
    rows = rows.withColumn("life_group", life_group(y))
    return regression_metrics(rows, [*by, "life_group"], y, p)


def resampled_error(
    preds: DataFrame, key: str, by: Sequence[str], n_boot: int, seed: int, y: str = "y_true", p: str = "y_pred"
) -> DataFrame:
    """RMSE and MAE of every resample and group; all groups share the same draws of entities."""
    e = F.col(p) - F.col(y)
    sums = weighted_sums(preds, by, key, {"__se": e * e, "__ae": F.abs(e)}, n_boot, seed)
    return sums.select("b", *by, F.sqrt(F.try_divide("__se", "w")).alias("RMSE"), F.try_divide("__ae", "w").alias("MAE"))


def bootstrap_metric_ci(
    preds: DataFrame, key: str, by: Sequence[str], n_boot: int = 2000, seed: int = 0, alpha: float = 0.05,
    metric: str = "RMSE", seed_col: str | None = "seed", y: str = "y_true", p: str = "y_pred",
) -> DataFrame:
    """Percentile interval of a metric over entity resamples, averaged over seeds inside each resample."""
    inner = [*by, seed_col] if seed_col else list(by)
    per_b = resampled_error(preds, key, inner, n_boot, seed, y, p)
    if seed_col:
        per_b = per_b.groupBy("b", *by).agg(F.avg(metric).alias(metric))
    return bootstrap_interval(per_b, by, metric, alpha)


def wilcoxon_signed_rank(pairs: DataFrame, by: Sequence[str], a: str, b: str, method: str = "normal") -> DataFrame:
    """Signed-rank test of paired values: W+, W- and the two-sided p-value.

    Zero differences are dropped and equal |differences| share their mean rank.
    ``method='normal'`` is the normal approximation with tie correction, for any
    number of pairs; ``'exact'`` counts sign patterns and raises for a group with
    ties or with more than EXACT_PAIRS pairs. The method never depends on the data.
    """
    if method not in ("normal", "exact"):
        raise ValueError("method is 'normal' or 'exact'")
    by = list(by)
    rows = pairs.select(*by, (F.col(a) - F.col(b)).alias("__d")).filter("__d <> 0")
    rows = rows.withColumn("__abs", F.abs("__d"))
    prof = value_profile(rows, by, "__abs", {"pos": (F.col("__d") > 0).cast("int")})
    rank = F.col("n_before") + (F.col("n") + 1) / 2
    n = F.max("n_total")
    stats = prof.groupBy(*by).agg(
        n.alias("n_nonzero"),
        F.sum(F.col("pos") * rank).alias("w_plus"),
        F.sum((F.col("n") - F.col("pos")) * rank).alias("w_minus"),
        F.sum(F.pow(F.col("n").cast("double"), F.lit(3.0)) - F.col("n")).alias("__ties"),
    )
    m = F.col("n_nonzero").cast("double")
    sd = F.sqrt(m * (m + 1) * (2 * m + 1) / 24 - F.col("__ties") / 48)
    z = F.abs(ratio(F.least("w_plus", "w_minus") - m * (m + 1) / 4, sd))
    stats = stats.withColumn("z", z)
    if method == "normal":
        return stats.select(*by, "n_nonzero", "w_plus", "w_minus", "z", normal_two_sided(F.col("z")).alias("p_value"))
    w = F.floor(F.least("w_plus", "w_minus")).cast("int")
    countable = (F.col("n_nonzero") <= EXACT_PAIRS) & (F.col("__ties") == 0)
    refused = F.raise_error(F.lit(f"the exact test takes at most {EXACT_PAIRS} pairs without ties; use method='normal'")).cast("int")
    stats = stats.withColumns({"__w": F.when(countable, w).otherwise(refused), "__n": F.col("n_nonzero").cast("int")})
    table = signed_rank_table(pairs.sparkSession).withColumnRenamed("__p", "p_value")
    return stats.join(F.broadcast(table), ["__n", "__w"], "left").select(*by, "n_nonzero", "w_plus", "w_minus", "z", "p_value")


def signed_rank_table(spark: SparkSession) -> DataFrame:
    """Exact two-sided p-value for every (n, smaller rank sum), n up to 50: about 22 000 rows.

    Counts of sign patterns by rank sum follow from adding one rank at a time.
    """
    counts, rows = [1], []
    for n in range(1, EXACT_PAIRS + 1):
        counts = [
            (counts[s] if s < len(counts) else 0) + (counts[s - n] if s >= n else 0) for s in range(len(counts) + n)
        ]
        below = 0
        for s in range(n * (n + 1) // 4 + 1):
            below += counts[s]
            rows.append((n, s, min(1.0, 2.0 * below / 2**n)))
    return spark.createDataFrame(rows, "__n int, __w int, __p double")


def normal_two_sided(z: Column) -> Column:
    """P(|N| > z) for z >= 0 by formula 26.2.17 of Abramowitz and Stegun's handbook (error < 1.5e-7)."""
    # The formula's coefficients.
    p = 0.2316419
    b = [0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429]
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(p) * z)
    poly = F.lit(0.0)
    for c in reversed(b):
        poly = t * (F.lit(c) + poly)
    return F.lit(2.0 / math.sqrt(2.0 * math.pi)) * F.exp(-z * z / 2) * poly


def paired_comparison(
    wide: DataFrame, key: str, by: Sequence[str], y: str, a: str, b: str, seed_col: str = "seed",
    n_boot: int = 2000, seed: int = 0,
) -> DataFrame:
    """Model a against model b on the same entities (negative differences favour a).

    ``wide`` has one row per entity and seed with both predictions. Output:
    seed-averaged dRMSE and dMAE, the paired bootstrap interval of dRMSE, the
    share of resamples below zero, the signed-rank test on per-entity absolute
    errors and the number of entities on which a is better.
    """
    by = list(by)
    ea, eb = F.col(a) - F.col(y), F.col(b) - F.col(y)
    rows = wide.select(
        *by, key, seed_col, (ea * ea).alias("__sa"), (eb * eb).alias("__sb"),
        F.abs(ea).alias("__aa"), F.abs(eb).alias("__ab"),
    )
    full = (
        rows.groupBy(*by, seed_col)
        .agg((F.sqrt(F.avg("__sa")) - F.sqrt(F.avg("__sb"))).alias("dr"), (F.avg("__aa") - F.avg("__ab")).alias("dm"))
        .groupBy(*by).agg(F.avg("dr").alias("dRMSE"), F.avg("dm").alias("dMAE"))
    )
    sums = weighted_sums(rows, [*by, seed_col], key, {"a": F.col("__sa"), "b2": F.col("__sb")}, n_boot, seed)
    boots = (
        sums.select(*by, "b", (F.sqrt(F.try_divide("a", "w")) - F.sqrt(F.try_divide("b2", "w"))).alias("d"))
        .groupBy("b", *by).agg(F.avg("d").alias("d"))
        .groupBy(*by).agg(
            F.percentile("d", F.lit(0.025)).alias("dRMSE_lo"),
            F.percentile("d", F.lit(0.975)).alias("dRMSE_hi"),
            F.avg((F.col("d") < 0).cast("double")).alias("share_below_zero"),
        )
    )
    per_cell = rows.groupBy(*by, key).agg(F.avg("__aa").alias("__ma"), F.avg("__ab").alias("__mb"))
    better = per_cell.groupBy(*by).agg(
        F.sum((F.col("__ma") < F.col("__mb")).cast("int")).alias("cells_a_better"), F.count("*").alias("n_cells")
    )
    test = wilcoxon_signed_rank(per_cell, by, "__ma", "__mb").select(*by, F.col("p_value").alias("wilcoxon_p"))
    out = _join(full, boots, by)
    out = _join(out, better, by)
    return _join(out, test, by, "left") if by else out.join(test, F.lit(True), "left")


def confusion_metrics(df: DataFrame, by: Sequence[str], flag: str, truth: str) -> DataFrame:
    """Counts and rates of a yes/no alarm; empty classes are guarded by a divisor of one."""
    f, t = F.col(flag).cast("boolean"), F.col(truth).cast("boolean")
    out = df.groupBy(*by).agg(
        *[F.sum(c.cast("int")).alias(k) for k, c in {"TP": f & t, "FP": f & ~t, "FN": ~f & t, "TN": ~f & ~t}.items()]
    )
    one = F.lit(1)
    recall = F.col("TP") / F.greatest(F.col("TP") + F.col("FN"), one)
    precision = F.col("TP") / F.greatest(F.col("TP") + F.col("FP"), one)
    far = F.col("FP") / F.greatest(F.col("FP") + F.col("TN"), one)
    return out.withColumns({"recall": recall, "precision": precision, "false_alarm_rate": far}).withColumns(
        {
            "F1": 2 * F.col("precision") * F.col("recall") / F.greatest(F.col("precision") + F.col("recall"), F.lit(1e-12)),
            "balanced_acc": (F.col("recall") + 1 - F.col("false_alarm_rate")) / 2,
            "n_alarms": F.col("TP") + F.col("FP"),
        }
    )


def alarm_metrics(df: DataFrame, by: Sequence[str], flag: str, truth: str, risk: str) -> DataFrame:
    """Confusion metrics plus ROC-AUC and average precision of the risk score."""
    out = confusion_metrics(df, by, flag, truth)
    out = _join(out, roc_auc(df, by, risk, truth), by, "left")
    return _join(out, average_precision(df, by, risk, truth), by, "left")


def brier_logloss(df: DataFrame, by: Sequence[str], p: str, truth: str) -> DataFrame:
    f = F.col(truth).cast("double")
    ll = -(f * F.log(F.col(p)) + (1 - f) * F.log(1 - F.col(p)))
    return df.groupBy(*by).agg(F.avg((F.col(p) - f) * (F.col(p) - f)).alias("brier"), F.avg(ll).alias("log_loss"))


def interval_metrics(df: DataFrame, by: Sequence[str], y: str, lo: str, hi: str, p: str) -> DataFrame:
    return df.groupBy(*by).agg(
        F.avg(F.col(y).between(F.col(lo), F.col(hi)).cast("double")).alias("coverage"),
        F.avg(ratio(F.col(hi) - F.col(lo), p)).alias("rel_width"),
    )


def conformal_set_metrics(df: DataFrame, by: Sequence[str], truth: str, fail_in: str, pass_in: str) -> DataFrame:
    """Quality of fail/pass sets: a case is decided when exactly one label is in its set."""
    t, fs, ps = (F.col(c).cast("boolean") for c in (truth, fail_in, pass_in))
    decided = fs != ps
    wrong = decided & ((fs & ~t) | (ps & t))
    total = lambda c: F.sum(c.cast("int"))
    guard = lambda c: F.greatest(total(c), F.lit(1))
    share = F.avg(decided.cast("double"))
    return df.groupBy(*by).agg(
        share.alias("decided"),
        (total(wrong) / guard(decided)).alias("error_among_decided"),
        F.avg(F.when(t, fs).otherwise(ps).cast("double")).alias("coverage"),
        (total(fs & ~ps & ~t) / guard(~t)).alias("false_alarm_rate"),
        (total(fs & ~ps & t) / guard(t)).alias("failures_caught"),
        (total(ps & ~fs & t) / guard(t)).alias("failures_cleared"),
        (1 - share).alias("deferred"),
    )


def residual_correlation(preds: DataFrame, key: str, models: Sequence[str], model: str = "model",
                         y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """Pairwise correlation of seed-averaged residuals, one row per ordered pair of models."""
    wide = (
        preds.groupBy(key).pivot(model, list(models))
        .agg(F.avg(F.col(p) - F.col(y)))
    )
    pairs = [(a, b) for i, a in enumerate(models) for b in models[i:]]
    row = wide.agg(*[F.corr(a, b).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    cells = [
        F.struct(F.lit(x).alias("model_a"), F.lit(z).alias("model_b"), F.col(f"{i}").alias("r"))
        for i, (a, b) in enumerate(pairs) for x, z in {(a, b), (b, a)}
    ]
    return row.select(F.inline(F.array(*cells)))
