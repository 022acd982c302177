"""Leakage-safe preprocessing and the linear family, fitted for many splits from few scans.

A split is one training set (fold complement, repeat, or the full training
set). For all splits at once, Spark computes the exact winsor bounds and
medians, then one moment matrix per split; only these matrices, whose size
depends on the number of features and not on the rows, reach the driver, where
every ridge penalty and every number of components is solved. Predictions are
expressions over a small joined parameter table.
"""
from __future__ import annotations

import sys
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..functions.numeric import finite
from .order_stats import RANGES, interpolated_quantile

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SPLIT = "split"


@dataclass
class Prepared:
    """Fitted preprocessing and standardised moments of one split."""

    low: np.ndarray
    high: np.ndarray
    median: np.ndarray
    n: float
    mean: np.ndarray
    std: np.ndarray
    y_mean: float
    y_std: float
    gram: np.ndarray   # X'X of standardised features
    cross: np.ndarray  # X'z of standardised features and target


@dataclass
class Weights:
    """A linear model in standardised space."""

    name: str
    split: str
    coef: np.ndarray


def _slim(rows: DataFrame, features: Sequence[str], *more: Column) -> DataFrame:
    """(part, more..., features...) as doubles. Rows of one part are in the same splits; the part's text names them, one a line."""
    split = F.col(SPLIT)
    part = F.array_join(split, "\n") if isinstance(rows.schema[SPLIT].dataType, ArrayType) else split.cast("string")
    return rows.select(part.alias("part"), *more, *[finite(f).alias(f) for f in features]).filter("part <> ''")


def _parts(batch: pa.RecordBatch) -> tuple[np.ndarray, list[str]]:
    """Codes of the parts of a batch's rows, and the parts; texts are compared once per distinct value."""
    d = batch.column(0).dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False), d.dictionary.to_pylist()


def _floats(batch: pa.RecordBatch, k: int) -> np.ndarray:
    """Column ``k`` with NaN for missing values and one zero."""
    return batch.column(k).to_numpy(zero_copy_only=False).astype(np.float64) + 0.0


def _mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """A one-to-one 64-bit hash of each number."""
    z = x.view(np.uint64) + np.uint64(seed)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def value_edges(slim: DataFrame, features: Sequence[str], ranges: int = RANGES) -> dict[int, np.ndarray]:
    """Sorted edges of value ranges of each feature, by its position: one hash-selected value per slot; only balance depends on them."""
    p = len(features)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        best, value = np.full((p, ranges), np.iinfo(np.uint64).max, np.uint64), np.full((p, ranges), np.nan)
        for batch in batches:
            for j in range(p):
                x = _floats(batch, 1 + j)
                x = x[~np.isnan(x)]
                slot, h = (_mixed(x, 1) % np.uint64(ranges)).astype(np.int64), _mixed(x, 2)
                better = h < best[j, slot]  # few rows, after the first batches
                x, slot, h = x[better], slot[better], h[better]
                order = np.lexsort((h, slot))
                slot, first = np.unique(slot[order], return_index=True)
                best[j, slot], value[j, slot] = h[order][first], x[order][first]
        j, slot = np.nonzero(~np.isnan(value))
        columns = [pa.array(j, pa.int32()), pa.array(slot, pa.int32()), pa.array(best[j, slot].view(np.int64)), pa.array(value[j, slot])]
        yield pa.RecordBatch.from_arrays(columns, names=["j", "slot", "h", "v"])

    found = slim.mapInArrow(run, "j int, slot int, h long, v double").groupBy("j", "slot").agg(F.min_by("v", "h").alias("v"))
    out = {j: [] for j in range(p)}
    for r in found.collect():  # features x ranges rows
        out[r.j].append(r.v)
    return {j: np.sort(np.array(v, dtype=float)) for j, v in out.items()}


def bounds_table(rows: DataFrame, features: Sequence[str], probs=(0.01, 0.99)) -> DataFrame:
    """Winsor bounds and median of every feature in every split (exact, missing values skipped).

    Clipping never moves the median, so one pass gives all three. Rows are
    counted once per part, not once per split: the counts of a split are sums
    over its parts, and only values of the ranges that hold a wanted position
    of some split are shuffled.
    """
    p, c = len(features), F.col
    slim = _slim(rows, features)
    edges = value_edges(slim, features)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        total: dict[str, list[np.ndarray]] = {}
        for batch in batches:
            codes, parts = _parts(batch)
            for part in parts:
                total.setdefault(part, [np.zeros(len(edges[j]) + 1, np.int64) for j in range(p)])
            for j in range(p):
                x, width = _floats(batch, 1 + j), len(edges[j]) + 1
                there = ~np.isnan(x)
                cell = codes[there].astype(np.int64) * width + np.searchsorted(edges[j], x[there], "left")
                for part, n in zip(parts, np.bincount(cell, minlength=len(parts) * width).reshape(len(parts), width), strict=True):
                    total[part][j] += n
        for part, tables in total.items():
            for j, n in enumerate(tables):
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(at), pa.string()), pa.array(np.full(len(at), j), pa.int32()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())],
                    names=["part", "j", "r", "n"])

    each = F.explode(F.split("part", "\n")).alias(SPLIT)
    counted = slim.mapInArrow(count, "part string, j int, r int, n long").groupBy("part", "j", "r").agg(F.sum("n").alias("n"))
    counted = counted.select(each, "j", "r", "n").groupBy(SPLIT, "j", "r").agg(F.sum("n").alias("n"))
    whole = Window.partitionBy(SPLIT, "j")  # at most ranges + 1 rows
    counted = counted.select(
        SPLIT, "j", "r", "n", F.coalesce(F.sum("n").over(whole.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("off"),
        F.sum("n").over(whole).alias("n_total"),
    )
    levels = {"low": probs[0], "high": probs[1], "median": 0.5}
    held = F.lit(False)
    for q in levels.values():
        h = (c("n_total") - 1) * F.lit(float(q))
        for position in (F.floor(h), F.ceil(h)):
            held = held | ((c("off") <= position) & (position < c("off") + c("n")))
    wanted = counted.filter(held).drop("n").collect()  # splits x features x 6 rows at most
    keep = {j: np.zeros(len(edges[j]) + 1, bool) for j in range(p)}
    for r in wanted:
        keep[r.j][r.r] = True

    def pick(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            codes, parts = _parts(batch)
            for j in range(p):
                x = _floats(batch, 1 + j)
                place = np.searchsorted(edges[j], x, "left")
                mine = np.flatnonzero(~np.isnan(x) & keep[j][np.minimum(place, len(edges[j]))])
                mine = mine[np.lexsort((x[mine], codes[mine]))]
                if not len(mine):
                    continue
                new = np.append(True, (np.diff(codes[mine]) != 0) | (np.diff(x[mine]) != 0))
                first = np.flatnonzero(new)
                at = mine[first]
                yield pa.RecordBatch.from_arrays(
                    [pa.DictionaryArray.from_arrays(pa.array(codes[at], pa.int32()), pa.array(parts, pa.string())).cast(pa.string()),
                     pa.array(np.full(len(at), j), pa.int32()), pa.array(place[at], pa.int32()), pa.array(x[at]),
                     pa.array(np.diff(np.append(first, len(mine))), pa.int64())], names=["part", "j", "r", "value", "n"])

    spark = rows.sparkSession
    ranges = F.broadcast(spark.createDataFrame(wanted, counted.drop("n").schema))
    near = slim.mapInArrow(pick, "part string, j int, r int, value double, n long").groupBy("part", "j", "r", "value").agg(F.sum("n").alias("n"))
    near = near.select(each, "j", "r", "value", "n").join(ranges, [SPLIT, "j", "r"])
    near = near.groupBy(SPLIT, "j", "r", "off", "n_total", "value").agg(F.sum("n").alias("n"))
    inside = Window.partitionBy(SPLIT, "j", "r").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    near = near.withColumn("before", c("off") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
    names = F.array(*[F.lit(f) for f in features])
    return near.groupBy(SPLIT, names[c("j")].alias("feature")).agg(
        *[interpolated_quantile(c("value"), c("before"), c("n"), c("n_total"), q).alias(k) for k, q in levels.items()]
    )


def prepared_value(x: Column, low: Column, high: Column, median: Column) -> Column:
    """Clip to the training bounds, then fill a missing value with the training median."""
    return F.coalesce(F.when(x.isNotNull(), F.greatest(low, F.least(high, x))), median)


def moment_table(rows: DataFrame, features: Sequence[str], target: str, bounds: dict[str, np.ndarray], log_target: bool = True) -> DataFrame:
    """Sums of products of (1, x - median, y - 6 or y) per split: (split, pos, total).

    Each task adds up its own rows and emits one matrix per split; a row
    reaches the task once, whatever the splits that it is in.
    """
    p, shift = len(features), (6.0 if log_target else 0.0)
    y = F.log(F.col(target).cast("double")) if log_target else F.col(target).cast("double")
    slim = _slim(rows, features, y.alias("__y"))

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            codes, parts = _parts(batch)
            values, z_y = np.stack([_floats(batch, 2 + j) for j in range(p)], axis=1), _floats(batch, 1) - shift
            for k, part in enumerate(parts):
                mine = codes == k
                own, own_y = values[mine], z_y[mine]
                missing = np.isnan(own)
                for split in part.split("\n"):
                    low, high, median = bounds[split]
                    x = np.where(missing, 0.0, np.clip(own, low, high) - median)
                    z = np.column_stack([np.ones(len(x)), x, own_y])
                    sums[split] = sums.get(split, 0.0) + z.T @ z
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([m.ravel() for m in sums.values()], pa.list_(pa.float64()))], names=[SPLIT, "m"])

    totals = slim.mapInArrow(partial, f"{SPLIT} string, m array<double>")
    return totals.select(SPLIT, F.posexplode("m").alias("pos", "v")).groupBy(SPLIT, "pos").agg(F.sum("v").alias("total"))


def prepare(rows: DataFrame, features: Sequence[str], target: str, probs=(0.01, 0.99), log_target: bool = True,
            sample_std: bool = False, winsor: bool = True) -> dict[str, Prepared]:
    """Fit the preprocessing of every split in ``rows`` (columns split, features, target; training rows only).

    ``split`` is the name of one split, or an array of the names of all splits
    that the row is in (nulls are skipped). ``rows`` is read by four jobs.
    ``sample_std`` with ``winsor=False`` gives the plain z-score variant with
    sample deviations floored at 1e-8.
    """
    p = len(features)
    spans: dict[str, np.ndarray] = {}
    for r in bounds_table(rows, features, probs).collect():  # splits x features rows
        spans.setdefault(r[SPLIT], np.full((3, p), np.nan))[:, list(features).index(r["feature"])] = (r["low"], r["high"], r["median"])
    for s in spans.values():
        s[np.isnan(s)] = 0.0  # a feature without any training value contributes nothing
        if not winsor:
            s[0], s[1] = -np.inf, np.inf
    sums: dict[str, np.ndarray] = {}
    for r in moment_table(rows, features, target, spans, log_target).collect():  # splits x (p + 2)^2 rows
        sums.setdefault(r[SPLIT], np.zeros((p + 2) ** 2))[r["pos"]] = r["total"]
    out = {}
    for split, flat in sums.items():
        m = flat.reshape(p + 2, p + 2)
        n = m[0, 0]
        mu = m[0, 1:] / n
        cov = m[1:, 1:] / n - np.outer(mu, mu)
        var = np.maximum(np.diag(cov), 0.0)
        if sample_std:
            sd = np.maximum(np.sqrt(var * n / max(n - 1, 1)), 1e-8)
        else:
            sd = np.sqrt(var)
            sd[sd < 1e-12 * np.maximum(1.0, np.abs(mu))] = 1.0
        z = n * cov / np.outer(sd, sd)
        low, high, median = spans[split]
        out[split] = Prepared(
            low, high, median, n, mu[:-1] + median, sd[:-1], mu[-1] + (6.0 if log_target else 0.0), sd[-1], z[:-1, :-1], z[:-1, -1]
        )
    return out


def solve_on(prep: Prepared, features: Sequence[str], used: Sequence[str], solve) -> np.ndarray:
    """Solve with a subset of the features, from sub-blocks of the moments; other coefficients are zero."""
    at = [list(features).index(f) for f in used]
    part = replace(prep, gram=prep.gram[np.ix_(at, at)], cross=prep.cross[at])
    coef = np.zeros(len(features))
    coef[at] = solve(part)
    return coef


def ridge(prep: Prepared, alpha: float) -> np.ndarray:
    return np.linalg.solve(prep.gram + alpha * np.eye(len(prep.cross)), prep.cross)


def ordinary(prep: Prepared) -> np.ndarray:
    return np.linalg.lstsq(prep.gram, prep.cross, rcond=1e-12)[0]


def principal_components(prep: Prepared, k: int) -> np.ndarray:
    values, vectors = np.linalg.eigh(prep.gram)
    top = vectors[:, ::-1][:, :k]
    lam = values[::-1][:k]
    return top @ ((top.T @ prep.cross) / lam)


def partial_least_squares(prep: Prepared, k: int) -> np.ndarray:
    """PLS1 coefficients from X'X and X'y alone (kernel algorithm of Dayal and MacGregor)."""
    xx, xy = prep.gram, prep.cross.copy()
    w_all, p_all, r_all, q_all = [], [], [], []
    for _ in range(min(k, len(xy))):
        norm = np.linalg.norm(xy)
        if norm < 1e-14:
            break
        w = xy / norm
        r = w.copy()
        for pj, rj in zip(p_all, r_all):
            r -= (pj @ w) * rj
        tt = r @ xx @ r
        load = xx @ r / tt
        q = (r @ xy) / tt
        xy = xy - load * q * tt
        w_all.append(w), p_all.append(load), r_all.append(r), q_all.append(q)
    return np.array(r_all).T @ np.array(q_all) if r_all else np.zeros(len(xy))


def solve_all(prepared: dict[str, Prepared], ridge_alphas: Sequence[float] = (), pls_components: Sequence[int] = (),
              dummy: bool = False, tag: str = "") -> list[Weights]:
    """Every candidate model of every split; candidate names carry their parameter and ``tag``."""
    out = []
    for split, p in prepared.items():
        if dummy:
            out.append(Weights(f"dummy{tag}", split, np.zeros(len(p.cross))))
        out += [Weights(f"ridge_a{a:g}{tag}", split, ridge(p, a)) for a in ridge_alphas]
        out += [Weights(f"plsr_k{k}{tag}", split, partial_least_squares(p, k)) for k in pls_components]
    return out


def model_table(spark: SparkSession, prepared: dict[str, Prepared], models: Sequence[Weights], features: Sequence[str]) -> DataFrame:
    """Parameters as a table: (split, model, base, params), one row per split and candidate."""
    rows = []
    for m in models:
        p = prepared[m.split]
        slope = m.coef * p.y_std / p.std
        params = [
            (f, float(lo), float(hi), float(md), float(mu), float(w))
            for f, lo, hi, md, mu, w in zip(features, p.low, p.high, p.median, p.mean, slope)
        ]
        rows.append((m.split, m.name, float(p.y_mean), params))
    return spark.createDataFrame(
        rows,
        f"{SPLIT} string, model string, base double, "
        "params array<struct<feature:string,low:double,high:double,median:double,mean:double,w:double>>",
    )


def statistics_table(spark: SparkSession, prepared: dict[str, Prepared], features: Sequence[str]) -> DataFrame:
    """Fitted preprocessing as a table: one row per split and feature."""
    rows = [
        (s, f, *(float(x[j]) for x in (p.low, p.high, p.median, p.mean, p.std)), float(p.y_mean), float(p.y_std))
        for s, p in prepared.items() for j, f in enumerate(features)
    ]
    return spark.createDataFrame(
        rows, f"{SPLIT} string, feature string, low double, high double, median double, mean double, std double, y_mean double, y_std double"
    )


def contributions(features: Sequence[str]) -> Column:
    """Array of struct(feature, value, phi): exact linear attribution of each feature around the training mean."""
    x = F.array(*[finite(f) for f in features])
    return F.zip_with(
        x, F.col("params"),
        lambda v, p: F.struct(
            p["feature"].alias("feature"), v.alias("value"),
            (p["w"] * (prepared_value(v, p["low"], p["high"], p["median"]) - p["mean"])).alias("phi"),
        ),
    )


def predict(rows: DataFrame, models: DataFrame, features: Sequence[str], log_target: bool = True, keep: Sequence[str] = ()) -> DataFrame:
    """Predictions of every candidate for the rows of its split, in life units (at least one cycle).

    ``models`` has splits x candidates rows and is broadcast.
    """
    joined = rows.withColumn(SPLIT, F.col(SPLIT).cast("string")).join(F.broadcast(models), SPLIT)
    z = F.col("base")
    for j, f in enumerate(features):  # compiled; a lambda over the array of parameters was not
        m = F.col("params")[j]
        z = z + m["w"] * (prepared_value(finite(f), m["low"], m["high"], m["median"]) - m["mean"])
    p = F.greatest(F.exp(z), F.lit(1.0)) if log_target else z
    return joined.select(SPLIT, *keep, "model", p.alias("y_pred"))


def training_sets(folds: DataFrame, fold: str, k: int, final: str = "final") -> DataFrame:
    """Every row once, with the array of the splits it trains: each fold but its own ('0', '1', ...) and the final fit on all rows."""
    return folds.withColumn(SPLIT, F.array(*other_folds(fold, k), F.lit(final)))


def other_folds(fold: str, k: int, prefix: Column | None = None) -> list[Column]:
    """The names of the folds, 'prefix/' before them; null for the row's own one."""
    name = lambda i: F.lit(str(i)) if prefix is None else F.concat_ws("/", prefix, F.lit(str(i)))
    return [F.when(F.col(fold) != i, name(i)) for i in range(k)]


def training_rows(folds: DataFrame, fold: str, k: int, final: str = "final") -> DataFrame:
    """Training rows of every fold split ('0', '1', ...) and of the final fit on all rows."""
    return training_sets(folds, fold, k, final).withColumn(SPLIT, F.explode(SPLIT)).filter(F.col(SPLIT).isNotNull())


def out_of_fold(rows: DataFrame, models: DataFrame, features: Sequence[str], fold: str, keep: Sequence[str]) -> DataFrame:
    """Prediction of every row by the models that did not see its fold."""
    return predict(rows.withColumn(SPLIT, F.col(fold).cast("string")), models, features, keep=keep)


def assert_covered(oof: DataFrame, column: str = "y_pred") -> None:
    if oof.filter(F.col(column).isNull()).limit(1).count():
        raise RuntimeError("out-of-fold predictions do not cover every training row")


def tuning_scores(oof: DataFrame, y: str, by: Sequence[str] = (), fold: str = SPLIT) -> DataFrame:
    """Candidate scores: mean over folds of the RMSE in cycles, and the RMSE of ln life over all rows."""
    e = F.col("y_pred") - F.col(y)
    le = F.log(F.col("y_pred")) - F.log(F.col(y))
    return (
        oof.groupBy(*by, "model", fold)
        .agg(F.sqrt(F.avg(e * e)).alias("r"), F.sum(le * le).alias("s"), F.count("*").alias("n"))
        .groupBy(*by, "model")
        .agg(F.avg("r").alias("cv_rmse"), F.sqrt(F.sum("s") / F.sum("n")).alias("log_rmse"))
    )


def best_candidate(scores: DataFrame, by: Sequence[str], score: str, order: Sequence[str]) -> DataFrame:
    """Candidate with the lowest score; the first in ``order`` wins ties."""
    rank = F.create_map(*[x for i, m in enumerate(order) for x in (F.lit(m), F.lit(i))])
    key = F.struct(F.col(score), rank[F.col("model")].alias("o"))
    return scores.groupBy(*by).agg(F.min_by("model", key).alias("model"), F.min(score).alias(score))
