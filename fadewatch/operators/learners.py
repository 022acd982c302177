"""Tree learners of MLlib and logistic models behind the same fold-safe preprocessing."""
from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Estimator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import finite
from . import logistic
from .linear import Prepared, prepared_value

# Search spaces of the tree models.
FOREST_SPACE = {"numTrees": [200, 500], "maxDepth": [30, 3, 5, 8], "minInstancesPerNode": [1, 2, 4, 8],
                "featureSubsetStrategy": ["0.33", "0.5", "all", "sqrt"]}
BOOST_SPACE = {"maxDepth": [2, 3, 4, 6], "stepSize": [0.02, 0.05, 0.1, 0.2], "maxIter": [100, 200, 400, 800],
               "subsamplingRate": [0.6, 0.8, 1.0], "featureSubsetStrategy": ["0.5", "0.8", "all"], "minInstancesPerNode": [1, 3]}
LOGISTIC_BALANCED_C = [10 ** (-3 + 0.5 * i) for i in range(11)]


def forest(seed: int = 0, **params) -> RandomForestRegressor:
    return RandomForestRegressor(featuresCol="x", labelCol="z", seed=seed, **params)


def boosted(seed: int = 0, **params) -> GBTRegressor:
    return GBTRegressor(featuresCol="x", labelCol="z", seed=seed, **params)


def draw_params(space: dict[str, list], n_iter: int, seed: int) -> list[dict]:
    """Random search: ``n_iter`` distinct parameter sets picked by hash order of the whole grid."""
    grid = [{}]
    for k, values in space.items():
        grid = [{**g, k: v} for g in grid for v in values]
    grid.sort(key=lambda g: hashlib.md5(f"{seed},{sorted(g.items())}".encode()).hexdigest())
    return grid[:n_iter]


def assemble(rows: DataFrame, features: Sequence[str], prep: Prepared, label=None, keep: Sequence[str] = ()) -> DataFrame:
    """Preprocessed feature vector ``x`` (and label ``z``) with the statistics of one split."""
    cols = []
    for j, f in enumerate(features):
        v = prepared_value(finite(f), F.lit(float(prep.low[j])), F.lit(float(prep.high[j])), F.lit(float(prep.median[j])))
        cols.append(((v - F.lit(float(prep.mean[j]))) / F.lit(float(prep.std[j]))).alias(f"__{j}"))
    extra = [label.alias("z")] if label is not None else []
    out = rows.select(*keep, *cols, *extra)
    names = [f"__{j}" for j in range(len(features))]
    return VectorAssembler(inputCols=names, outputCol="x").transform(out).drop(*names)


def fit_regressor(train: DataFrame, features: Sequence[str], target: str, prep: Prepared, learner: Estimator):
    z = (F.log(F.col(target)) - F.lit(prep.y_mean)) / F.lit(prep.y_std)
    return learner.fit(assemble(train, features, prep, z))


def predict_regressor(model, rows: DataFrame, features: Sequence[str], prep: Prepared, keep: Sequence[str]) -> DataFrame:
    """Predicted life (at least one cycle)."""
    out = model.transform(assemble(rows, features, prep, keep=keep))
    life = F.exp(F.col("prediction") * F.lit(prep.y_std) + F.lit(prep.y_mean))
    return out.select(*keep, F.greatest(life, F.lit(1.0)).alias("y_pred"))


def in_parallel(jobs: Sequence[Callable], threads: int = 4) -> list:
    """Run independent fits from a few driver threads; every fit is itself a Spark job."""
    with ThreadPoolExecutor(max_workers=threads) as pool:
        return [f.result() for f in [pool.submit(j) for j in jobs]]


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def oof_regressor(rows: DataFrame, fold: str, k: int, features: Sequence[str], target: str, prepared: dict[str, Prepared],
                  make: Callable[[], Estimator], keep: Sequence[str]) -> DataFrame:
    """Out-of-fold predictions: one fit per fold on the other folds, all folds united."""

    def one(j: int) -> DataFrame:
        model = fit_regressor(rows.filter(F.col(fold) != j), features, target, prepared[str(j)], make())
        return predict_regressor(model, rows.filter(F.col(fold) == j), features, prepared[str(j)], keep)

    return _union(in_parallel([lambda j=j: one(j) for j in range(k)]))


def predict_probability(train: DataFrame, rows: DataFrame, features: Sequence[str], flag: str, prep: Prepared, c: float,
                        keep: Sequence[str], balanced: bool = False) -> DataFrame:
    """Failure probability; a training set with one class predicts that class's share."""
    problems = logistic.fit(train, features, flag, {"final": prep}, [c], balanced=balanced)
    return logistic.predict(rows, F.lit("final"), features, problems, {"final": prep}, keep).drop("C")


def oof_probabilities(rows: DataFrame, fold: str, k: int, features: Sequence[str], flag: str, prepared: dict[str, Prepared],
                      cs: Sequence[float], keep: Sequence[str], balanced: bool = False) -> DataFrame:
    """(keep..., C, p_fail) of each row by the models that did not see its fold, all folds and penalties fitted together."""
    folds = {str(j): prepared[str(j)] for j in range(k)}
    problems = logistic.fit(rows, features, flag, folds, cs, fold, balanced=balanced)
    return logistic.predict(rows, F.col(fold), features, problems, folds, keep)


def oof_probability(rows: DataFrame, fold: str, k: int, features: Sequence[str], flag: str, prepared: dict[str, Prepared],
                    c: float, keep: Sequence[str], balanced: bool = False) -> DataFrame:
    return oof_probabilities(rows, fold, k, features, flag, prepared, [c], keep, balanced).drop("C")
