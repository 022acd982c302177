"""Combiners fitted on out-of-fold predictions."""
from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import ratio


def equal_weight(preds: DataFrame, members: Sequence[str], by: Sequence[str], model: str = "model", p: str = "y_pred") -> DataFrame:
    """Mean prediction of the members per group."""
    name = "mean_" + "_".join(members)
    return (
        preds.filter(F.col(model).isin(list(members))).groupBy(*by)
        .agg(F.avg(p).alias(p)).withColumn(model, F.lit(name))
    )


def inverse_mse_weights(oof: DataFrame, by: Sequence[str], model: str = "model", y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """Weights proportional to 1 / out-of-fold MSE, normalised over the models of a group."""
    e = F.col(p) - F.col(y)
    inv = oof.groupBy(*by, model).agg(ratio(F.lit(1.0), F.avg(e * e)).alias("__i"))
    total = F.sum("__i").over(Window.partitionBy(*by))  # one row per model
    return inv.select(*by, model, (F.col("__i") / total).alias("weight"))


def combine(preds: DataFrame, weights: DataFrame, by: Sequence[str], key: str, intercepts: DataFrame | None = None,
            model: str = "model", p: str = "y_pred") -> DataFrame:
    """Weighted sum of member predictions plus intercept; ``weights`` is (by..., combiner, model, weight)."""
    rows = preds.join(F.broadcast(weights), [*by, model])  # groups x combiners x members rows
    out = rows.groupBy(*by, "combiner", key).agg(F.sum(F.col("weight") * F.col(p)).alias(p))
    if intercepts is not None:
        out = out.join(F.broadcast(intercepts), [*by, "combiner"]).withColumn(p, F.col(p) + F.col("intercept")).drop("intercept")
    return out


def simplex_least_squares(pp: np.ndarray, py: np.ndarray) -> np.ndarray:
    """Minimise w'PPw - 2 Py'w over w >= 0, sum w = 1, exactly, by trying every support.

    The number of members is at most four, so there are at most 15 supports;
    each is an equality-constrained least-squares problem in closed form.
    """
    k = len(py)
    scale = max(float(np.mean(np.diag(pp))), 1e-300)
    a, b = pp / scale, py / scale
    best, best_loss = np.full(k, 1.0 / k), np.inf
    for size in range(1, k + 1):
        for support in combinations(range(k), size):
            s = list(support)
            kkt = np.zeros((size + 1, size + 1))
            kkt[:size, :size] = a[np.ix_(s, s)]
            kkt[:size, size] = kkt[size, :size] = 1.0
            sol = np.linalg.lstsq(kkt, np.append(b[s], 1.0), rcond=1e-12)[0][:size]
            if sol.min() < -1e-10:
                continue
            w = np.zeros(k)
            w[s] = np.clip(sol, 0, None)
            w /= w.sum()
            loss = w @ a @ w - 2 * b @ w
            if loss < best_loss - 1e-13:
                best, best_loss = w, loss
    return best


def stack_moments(oof: DataFrame, members: Sequence[str], by: Sequence[str], key: str, y: str = "y_true",
                  model: str = "model", p: str = "y_pred") -> DataFrame:
    """Sums of products of (1, y, predictions) per group, one row each."""
    wide = oof.groupBy(*by, key, F.col(y).alias("__y")).pivot(model, list(members)).agg(F.max(p))
    cols = ["__y", *members]
    names = ["n"] + [f"s_{i}" for i in range(len(cols))] + [f"q_{i}_{j}" for i in range(len(cols)) for j in range(i, len(cols))]
    d = {c: F.col(c) for c in cols}
    aggs: list[Column] = [F.count("*").alias("n")] + [F.sum(d[c]).alias(f"s_{i}") for i, c in enumerate(cols)]
    aggs += [F.sum(d[a] * d[cols[j]]).alias(f"q_{i}_{j}") for i, a in enumerate(cols) for j in range(i, len(cols))]
    return wide.groupBy(*by).agg(*aggs).select(*by, *names)


def _fit(m: dict, all_members: Sequence[str], members: Sequence[str]) -> tuple[np.ndarray, float]:
    k = len(all_members) + 1
    s = np.array([m[f"s_{i}"] for i in range(k)]) / m["n"]
    q = np.array([[m[f"q_{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) / m["n"]
    cov = q - np.outer(s, s)
    at = [1 + list(all_members).index(x) for x in members]
    w = simplex_least_squares(cov[np.ix_(at, at)], cov[at, 0])
    return w, float(s[0] - w @ s[at])


def stack_name(members: Sequence[str]) -> str:
    return "stack_" + "_".join(members)


def stack_subsets(base: Sequence[str], extra: Sequence[str] = ()) -> list[list[str]]:
    """All member subsets of size two and three, plus ``extra`` + base."""
    subsets = [list(c) for r in (2, 3) for c in combinations(base, r)]
    return subsets + ([[*extra, *base]] if extra else [])


def fit_stacks(spark: SparkSession, moments: DataFrame, members: Sequence[str], subsets: Sequence[Sequence[str]],
               by: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Constrained stack of every subset and group: (weights, intercepts) tables.

    ``moments`` has one row per group and is solved on the driver.
    """
    weights, intercepts = [], []
    for r in moments.collect():
        g = tuple(str(r[c]) for c in by)
        for sub in subsets:
            w, b = _fit(r.asDict(), members, sub)
            weights += [(*g, stack_name(sub), m, float(x)) for m, x in zip(sub, w)]
            intercepts.append((*g, stack_name(sub), b))
    head = "".join(f"{c} string, " for c in by)
    return (
        spark.createDataFrame(weights, head + "combiner string, model string, weight double"),
        spark.createDataFrame(intercepts, head + "combiner string, intercept double"),
    )


def crossfit_weights(spark: SparkSession, fold_moments: DataFrame, members: Sequence[str], subset: Sequence[str],
                     fold: str = "fold") -> tuple[DataFrame, DataFrame]:
    """Weights for each fold from the moments of all other folds (total minus fold)."""
    rows = [r.asDict() for r in fold_moments.collect()]
    keys = [k for k in rows[0] if k != fold]
    total = {k: sum(r[k] for r in rows) for k in keys}
    weights, intercepts = [], []
    for r in rows:
        w, b = _fit({k: total[k] - r[k] for k in keys}, members, subset)
        weights += [(int(r[fold]), stack_name(subset), m, float(x)) for m, x in zip(subset, w)]
        intercepts.append((int(r[fold]), stack_name(subset), b))
    return (
        spark.createDataFrame(weights, f"{fold} int, combiner string, model string, weight double"),
        spark.createDataFrame(intercepts, f"{fold} int, combiner string, intercept double"),
    )


def final_ensemble(cv_rmse: DataFrame, full: str, reduced: str, by: Sequence[str] = (), model: str = "model", score: str = "RMSE") -> DataFrame:
    """The reduced stack when its cross-fitted error is strictly lower, else the full stack."""
    pick = lambda m: F.max(F.when(F.col(model) == m, F.col(score)))
    return cv_rmse.groupBy(*by).agg(
        F.when(pick(reduced) < pick(full), F.lit(reduced)).otherwise(F.lit(full)).alias("final_ensemble"),
        F.least(pick(reduced), pick(full)).alias("final_rmse"),
    )
