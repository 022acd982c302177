"""Bootstrap statistics of all resamples in one pass, as arrays that merge by addition.

A resample gives each entity a Poisson(1) multiplicity, the bootstrap whose draws need no common count: the multiplicity of
entity k in resample b is a hash of (seed, b, k), so every task finds the same one and a retry repeats it. A task keeps, for
each group, one array of B weighted sums; arrays of tasks are added. No row is ever multiplied by B, and what is shuffled
does not grow with the entities: B numbers for each group, statistic and task.

Weighted rank statistics (area under the ROC curve, average precision) take the entities in order of their score, cut into
chunks by a range shuffle. A chunk is again a few arrays of B sums; entities that tie across chunks are added up apart, as
points. Running sums over points and chunks give what stands below and above each, for every resample at once.
"""
from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .order_stats import _join, average_precision, quantiles, roc_auc

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of sums that a task keeps before it passes them on; entities whose multiplicities are drawn together; rows of a
#: chunk of the score order; resamples that a chunk handles together; draws made at once, which a core's cache holds.
SUMS_BYTES, DRAWN, CHUNK, TOGETHER, CACHED = 64 << 20, 256, 4096, 256, 1 << 15
_STEP = 0x9E3779B97F4A7C15


def poisson_thresholds() -> list[int]:
    """Distribution function of Poisson(1) in units of 2**-53; a multiplicity is the number of thresholds that a draw reaches."""
    out, cdf, p, k = [], 0.0, math.exp(-1.0), 0
    while cdf + p > cdf:
        cdf, k = cdf + p, k + 1
        p /= k
        out.append(math.ceil(cdf * 2**53))
    return [t for t in out if t < 2**53]


_THRESHOLDS = poisson_thresholds()
_REACHED = np.array(_THRESHOLDS, np.uint64)


def _by_first_bits() -> np.ndarray:
    """Multiplicity of a draw by its first 16 bits; 255 where a threshold lies among the draws that begin so."""
    first = np.arange(1 << 16, dtype=np.uint64) << np.uint64(37)
    low, high = (np.searchsorted(_REACHED, x, side="right") for x in (first, first + np.uint64((1 << 37) - 1)))
    return np.where(low == high, low, 255).astype(np.uint8)


_BY_FIRST_BITS = _by_first_bits()


def entity_bits(seed: int, key: Column | str) -> Column:
    """60 bits of the hash of seed and entity, from which its multiplicities follow."""
    key = F.col(key) if isinstance(key, str) else key
    return F.conv(F.substring(F.md5(F.concat_ws(",", F.lit(str(seed)), key.cast("string"))), 1, 15), 16, 10).cast("bigint")


def multiplicities(bits: np.ndarray, first: int, until: int) -> np.ndarray:
    """Multiplicities (entities, resamples ``first`` to ``until``): thresholds reached by splitmix64 of bits + (b + 1) * step."""
    steps = (np.arange(first, until, dtype=np.uint64) + np.uint64(1)) * np.uint64(_STEP)
    bits, w = bits.astype(np.uint64), np.empty((len(bits), until - first))
    rows = max(1, CACHED // max(1, until - first))
    for at in range(0, len(bits), rows):
        z = bits[at : at + rows, None] + steps
        z ^= z >> np.uint64(30)
        z *= np.uint64(0xBF58476D1CE4E5B9)
        z ^= z >> np.uint64(27)
        z *= np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
        drawn = _BY_FIRST_BITS.take((z >> np.uint64(48)).view(np.int64), mode="clip")
        if drawn.max(initial=0) == 255:
            near = drawn == 255
            drawn[near] = np.searchsorted(_REACHED, z[near] >> np.uint64(11), side="right")
        w[at : at + rows] = drawn
    return w


def resample_weights(cells: DataFrame, key: str, n_boot: int, seed: int) -> DataFrame:
    """Add ``w array<int>``, the multiplicities of each entity in ``n_boot`` resamples; no shuffle."""
    rows = cells.withColumn("__bits", entity_bits(seed, key))
    schema = cells.withColumn("w", F.lit(None).cast("array<int>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, DRAWN):
                batch = whole.slice(at, DRAWN)
                w = multiplicities(batch.column(batch.num_columns - 1).to_numpy(), 0, n_boot).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * n_boot), pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists.cast(pa.list_(pa.int32()))], names=[*batch.schema.names[:-1], "w"])

    return rows.mapInArrow(run, schema)


def _groups(batch: pa.RecordBatch, n: int) -> tuple[np.ndarray, list[tuple]]:
    """Group of each row by the first ``n`` columns, and the groups' values."""
    if n == 0 or batch.num_rows == 0:
        return np.zeros(batch.num_rows, np.int64), [()]
    codes = np.stack([batch.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy() for k in range(n)])
    _, first, group = np.unique(codes, axis=1, return_index=True, return_inverse=True)
    return group.ravel(), list(zip(*(batch.column(k).take(pa.array(first)).to_pylist() for k in range(n)), strict=True))


def _lists(rows: Sequence[np.ndarray]) -> pa.Array:
    return pa.array(list(rows), pa.list_(pa.float64()))


def weighted_sums(rows: DataFrame, by: Sequence[str], key: str, values: Mapping[str, Column], n_boot: int, seed: int) -> DataFrame:
    """(by..., b, n, w, values...): for each group and resample its rows, the sum of multiplicities w, and the sums of w * value.

    Null and NaN values count as 0. A group without rows has no result.
    """
    by, names = list(by), list(values)
    given = rows.select(*by, entity_bits(seed, key).alias("__bits"), *[F.coalesce(F.nanvl(v.cast("double"), F.lit(0.0)), F.lit(0.0)).alias(f"__v{k}") for k, v in enumerate(values.values())])
    arrays = [f"__s{k}" for k in range(len(names) + 1)]
    schema = given.select(*by, F.lit(0).cast("bigint").alias("n"), *[F.lit(None).cast("array<double>").alias(a) for a in arrays]).schema
    n_by = len(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, count, kinds = {}, {}, None

        def out() -> pa.RecordBatch:
            keys = list(sums)
            columns = [pa.array([k[i] for k in keys], kinds[i]) for i in range(n_by)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([count[k] for k in keys], pa.int64()), *(_lists([sums[k][a] for k in keys]) for a in range(len(arrays)))], names=[*by, "n", *arrays])

        for batch in batches:
            kinds = [batch.column(k).type for k in range(n_by)]
            group, keys = _groups(batch, n_by)
            bits, of = np.unique(batch.column(n_by).to_numpy(), return_inverse=True)
            order = np.lexsort((group, of // DRAWN))
            v = np.stack([np.ones(len(order)), *(batch.column(n_by + 1 + k).to_numpy() for k in range(len(names)))])[:, order]
            group, of = group[order], of[order]
            ends = np.searchsorted(of // DRAWN, np.arange(-(-len(bits) // DRAWN) + 1))
            for block, (lo, hi) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                w = multiplicities(bits[block * DRAWN : (block + 1) * DRAWN], 0, n_boot)
                for k, n, added in _block_sums(v[:, lo:hi], group[lo:hi], of[lo:hi] - block * DRAWN, w):
                    k = keys[k]
                    if k not in sums:
                        sums[k], count[k] = np.zeros((len(arrays), n_boot)), 0
                    sums[k] += added
                    count[k] += n
            if len(sums) * len(arrays) * n_boot * 8 > SUMS_BYTES:
                yield out()
                sums, count = {}, {}
        if sums:
            yield out()

    parts = given.mapInArrow(run, schema)
    each = parts.select(*by, "n", F.posexplode(F.arrays_zip(*arrays)).alias("b", "s"))
    return each.groupBy(*by, "b").agg(F.sum("n").alias("n"), *[F.sum(f"s.{a}").alias(c) for a, c in zip(arrays, ["w", *names], strict=True)])


def _block_sums(v: np.ndarray, group: np.ndarray, of: np.ndarray, w: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(group, rows, sums) of the rows of a block in order of group; ``v``: values (arrays, rows), ``w``: (entities, resamples)."""
    cuts = np.flatnonzero(np.concatenate([[True], np.diff(group) != 0, [True]]))
    n = np.diff(cuts)
    if len(group) * 4 >= len(n) * len(w):  # most groups hold most entities: one product for all, multiplicities are not copied for each
        at = np.repeat(np.arange(len(n)), n) * len(w) + of
        cells = np.stack([np.bincount(at, x, len(n) * len(w)) for x in v]).reshape(len(v) * len(n), len(w))
        added = (cells @ w).reshape(len(v), len(n), -1).swapaxes(0, 1)
    else:
        added = (v[:, lo:hi] @ w[of[lo:hi]] for lo, hi in zip(cuts[:-1], cuts[1:], strict=True))
    yield from zip(group[cuts[:-1]], n.tolist(), added, strict=True)


# ------------------------------------------------------------- weighted rank statistics


def _chunks(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by..., chunk, point, low, scores, flags, bits): runs of one group in order of score; a run's ends, which may tie with the next, apart."""
    placed = rows.repartitionByRange(*by, "__score", "__bits").sortWithinPartitions(*by, "__score", "__bits")
    shape = {"chunk": "bigint", "point": "boolean", "low": "double", "scores": "array<double>", "flags": "array<int>", "bits": "array<bigint>"}
    schema = placed.select(*by, *[F.lit(None).cast(t).alias(c) for c, t in shape.items()]).schema
    n_by = len(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 33
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(at, CHUNK)
                group, _ = _groups(batch, n_by)
                score, flag, bits = (batch.column(n_by + k).to_numpy() for k in range(3))
                cut = np.flatnonzero(np.concatenate([[True], np.diff(group) != 0, [True]]))
                found, first = [], []
                for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                    head = lo + int(np.searchsorted(score[lo:hi], score[lo], side="right"))
                    tail = max(head, lo + int(np.searchsorted(score[lo:hi], score[hi - 1], side="left")))
                    for a, b, point in ((lo, head, True), (head, tail, False), (tail, hi, True)):
                        if b > a:
                            found.append((chunk, point, float(score[a]), score[a:b], flag[a:b], bits[a:b]))
                            first.append(a)
                            chunk += 1
                columns = [batch.column(k).take(pa.array(first, pa.int64())) for k in range(n_by)]
                kinds = [pa.int64(), pa.bool_(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.int32()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array([x[k] for x in found], t) for k, t in enumerate(kinds))], names=[*by, *shape])

    return placed.mapInArrow(run, schema)


def _pieces(chunks: DataFrame, by: list[str], n_boot: int) -> DataFrame:
    """(by..., chunk, point, low, pos, neg, wins): arrays over resamples of the weights of both classes and of the pairs in order inside the chunk."""
    given = chunks.select(*by, "chunk", "point", "low", "scores", "flags", "bits")
    arrays = ["pos", "neg", "wins"]
    schema = given.select(*by, "chunk", "point", "low", *[F.lit(None).cast("array<double>").alias(a) for a in arrays]).schema
    n = len(by) + 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [np.stack([np.concatenate(x) for x in zip(*(_piece(*part) for part in _resamples(row, n_boot)), strict=True)]) for row in zip(*(batch.column(n + k) for k in range(3)), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *(_lists([m[k] for m in made]) for k in range(3))], names=[*batch.schema.names[:n], *arrays])

    return given.mapInArrow(run, schema)


def _resamples(row, n_boot: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(weights of positives, weights of negatives) of each distinct score of a chunk, for TOGETHER resamples at a time."""
    score, flag, bits = (x.values.to_numpy() for x in row)
    starts = np.flatnonzero(np.concatenate([[True], np.diff(score) != 0]))
    for b in range(0, n_boot, TOGETHER):
        w = multiplicities(bits, b, min(b + TOGETHER, n_boot))
        yield np.add.reduceat(w * (flag == 1)[:, None], starts, axis=0), np.add.reduceat(w * (flag == 0)[:, None], starts, axis=0)


def _piece(pos: np.ndarray, neg: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return pos.sum(axis=0), neg.sum(axis=0), (pos * (np.cumsum(neg, axis=0) - neg / 2)).sum(axis=0)


def _steps(chunks: DataFrame, n_boot: int) -> DataFrame:
    """(chunk, steps array): sums of w(positive) * precision over the scores of a chunk, given the weights above it."""
    given = chunks.select("chunk", "pos_above", "neg_above", "scores", "flags", "bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in zip(*(batch.column(k) for k in range(1, 6)), strict=True):
                above = [x.values.to_numpy() for x in row[:2]]
                parts, at = [], 0
                for pos, neg in _resamples(row[2:], n_boot):
                    p0, n0 = (x[at : at + pos.shape[1]] for x in above)
                    tp = np.cumsum(pos[::-1], axis=0)[::-1] + p0
                    all_ = tp + np.cumsum(neg[::-1], axis=0)[::-1] + n0
                    parts.append((pos * np.divide(tp, all_, out=np.zeros_like(tp), where=all_ > 0)).sum(axis=0))
                    at += pos.shape[1]
                out.append(np.concatenate(parts))
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(out)], names=["chunk", "steps"])

    return given.mapInArrow(run, "chunk bigint, steps array<double>")


def weighted_rank_metrics(rows: DataFrame, by: Sequence[str], key: str, score: str, flag: str, n_boot: int, seed: int) -> DataFrame:
    """(by..., b, pos, neg, roc_auc, average_precision) of each group and resample.

    Both metrics are NULL where a resample holds one class only. Rows with a null or NaN score or a null flag are left out; equal scores
    count as one threshold. All chunks of all resamples are handled in two passes over the chunks.
    """
    by = list(by)
    given = rows.select(*by, F.col(score).cast("double").alias("__score"), F.col(flag).cast("int").alias("__flag"), entity_bits(seed, key).alias("__bits"))
    chunks = materialize(_chunks(given.filter("__score IS NOT NULL AND NOT isnan(__score) AND __flag IS NOT NULL"), by))
    names = ["pos", "neg", "wins"]
    each = _pieces(chunks, by, n_boot).select(*by, "chunk", "point", "low", F.posexplode(F.arrays_zip(*names)).alias("b", "s")).select(*by, "chunk", "point", "low", "b", *[f"s.{c}" for c in names])
    points = each.filter("point").groupBy(*by, "low", "b").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    points = points.select(*by, F.lit(None).cast("bigint").alias("chunk"), "low", "b", "pos", "neg", (F.col("pos") * F.col("neg") / 2).alias("wins"))
    entries = materialize(points.unionByName(each.filter("NOT point").drop("point")))
    one = Window.partitionBy(*by, "b")
    up = one.orderBy("low").rowsBetween(Window.unboundedPreceding, -1)
    down = one.orderBy(F.desc("low")).rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0.0)
    entries = entries.withColumns({"neg_below": F.coalesce(F.sum("neg").over(up), none), "pos_above": F.coalesce(F.sum("pos").over(down), none), "neg_above": F.coalesce(F.sum("neg").over(down), none)})
    auc = entries.groupBy(*by, "b").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum(F.col("wins") + F.col("pos") * F.col("neg_below")).alias("__wins"))
    tp, all_ = F.col("pos") + F.col("pos_above"), F.col("pos") + F.col("pos_above") + F.col("neg") + F.col("neg_above")
    of_points = entries.filter("chunk IS NULL").groupBy(*by, "b").agg(F.sum(F.coalesce(F.try_divide(F.col("pos") * tp, all_), none)).alias("steps"))
    above = entries.filter("chunk IS NOT NULL").groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("b", "pos_above", "neg_above"))).alias("a"))
    above = above.select("chunk", F.col("a.pos_above").alias("pos_above"), F.col("a.neg_above").alias("neg_above"))
    inner = _steps(chunks.filter("NOT point").join(above, "chunk"), n_boot).join(chunks.select("chunk", *by), "chunk")
    inner = inner.select(*by, F.posexplode("steps").alias("b", "steps")).groupBy(*by, "b").agg(F.sum("steps").alias("steps"))
    steps = of_points.unionByName(inner).groupBy(*by, "b").agg(F.sum("steps").alias("__steps"))
    both = (F.col("pos") > 0) & (F.col("neg") > 0)
    return _join(auc, steps, [*by, "b"]).select(
        *by, "b", "pos", "neg", F.when(both, F.col("__wins") / (F.col("pos") * F.col("neg"))).alias("roc_auc"), F.when(both, F.col("__steps") / F.col("pos")).alias("average_precision")
    )


def bootstrap_interval(values: DataFrame, by: Sequence[str], value: str, alpha: float = 0.05) -> DataFrame:
    """Percentile interval over resamples; the number of resamples bounds each group."""
    return quantiles(values, by, value, {"lo": alpha / 2, "hi": 1 - alpha / 2}, bounded=True)


# ------------------------------------------------------------- metric tables of resamples

_BOTH = {"new": "pred_life", "base": "base_pred_life"}


def _measured() -> dict[str, Column]:
    """What is summed of each row: errors, intervals, alarms and conformal sets of the new model and of the baseline."""
    y, f, out = F.col("y_true"), F.col("early_failure").cast("boolean"), {}
    for k, p in _BOTH.items():
        pre = "" if k == "new" else "base_"
        e, alarm = F.abs(F.col(p) - y), F.col(f"{pre}alarm").cast("boolean")
        out |= {f"{k}_se": e * e, f"{k}_ae": e, f"{k}_ape": e / y}
        out |= {f"{k}_in": ((y >= F.col(f"{pre}lo90")) & (y <= F.col(f"{pre}hi90"))).cast("int"), f"{k}_width": (F.col(f"{pre}hi90") - F.col(f"{pre}lo90")) / F.col(p)}
        out |= {f"{k}_tp": (alarm & f).cast("int"), f"{k}_fp": (alarm & ~f).cast("int")}
    fail, ok = F.col("fail_in_set").cast("boolean"), F.col("pass_in_set").cast("boolean")
    out |= {"fails": f.cast("int"), "brier": (F.col("p_fail") - f.cast("int")) * (F.col("p_fail") - f.cast("int"))}
    out |= {"decided": (fail != ok).cast("int"), "wrong": ((fail != ok) & ((fail & ~f) | (ok & f))).cast("int"), "covered": F.when(f, fail).otherwise(ok).cast("int")}
    return out | {"false_alarm": (fail & ~ok & ~f).cast("int"), "caught": (fail & ~ok & f).cast("int"), "cleared": (ok & ~fail & f).cast("int")}


def _metrics(w: Column) -> dict[str, Column]:
    """Metrics from the sums of _measured, where ``w`` is the number of rows; empty classes are guarded by a divisor of one."""
    part = lambda a, b: F.try_divide(F.col(a).cast("double"), F.greatest(b, F.lit(1.0)))
    mean = lambda a: F.try_divide(F.col(a).cast("double"), w)
    fails, out = F.col("fails").cast("double"), {}
    for k in _BOTH:
        out |= {f"reg_{k}_RMSE": F.sqrt(mean(f"{k}_se")), f"reg_{k}_MAE": mean(f"{k}_ae"), f"reg_{k}_MAPE": mean(f"{k}_ape")}
        out |= {f"reg_{k}_coverage90": mean(f"{k}_in"), f"reg_{k}_rel_width90": mean(f"{k}_width")}
        out |= {f"clf_{k}_recall": part(f"{k}_tp", fails), f"clf_{k}_precision": part(f"{k}_tp", F.col(f"{k}_tp") + F.col(f"{k}_fp")), f"clf_{k}_false_alarm_rate": part(f"{k}_fp", w - fails)}
    out |= {"clf_new_Brier": mean("brier"), "conf_decided": mean("decided"), "conf_error_among_decided": part("wrong", F.col("decided").cast("double")), "conf_coverage": mean("covered")}
    return out | {"conf_false_alarm_rate": part("false_alarm", w - fails), "conf_failures_caught": part("caught", fails), "conf_failures_cleared": part("cleared", fails), "conf_deferred": F.lit(1.0) - mean("decided")}


def resampled_metrics(pred: DataFrame, by: Sequence[str], key: str = "cell_id", repeat: str = "repeat", n_boot: int = 1000, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Metrics of the data (by..., repeat, metrics) and of each resample (by..., repeat, b, metrics, kept).

    Columns of ``pred``: y_true, early_failure, pred_life, lo90, hi90, base_pred_life, base_lo90, base_hi90, p_fail, alarm,
    base_alarm, fail_in_set, pass_in_set. The baseline's alarm score is its negative predicted life. ``kept`` is false for
    resamples with one class only.
    """
    group = [*by, repeat]
    scores = {"new": F.col("p_fail"), "base": -F.col("base_pred_life")}
    plain = pred.groupBy(*group).agg(F.count("*").cast("double").alias("w"), *[F.sum(c).alias(k) for k, c in _measured().items()])
    boots = weighted_sums(pred, group, key, _measured(), n_boot, seed)
    full = plain.select(*group, *[c.alias(k) for k, c in _metrics(F.col("w")).items()])
    each = boots.select(*group, "b", *[c.alias(k) for k, c in _metrics(F.col("w")).items()])
    for k, score in scores.items():
        rows = pred.withColumn("__s", score)
        names = {"roc_auc": f"clf_{k}_ROC_AUC", "average_precision": f"clf_{k}_PR_AUC"}
        for one in (roc_auc, average_precision):
            full = _join(full, one(rows, group, "__s", "early_failure").withColumnsRenamed(names), group, "left")
        ranked = weighted_rank_metrics(rows, group, key, "__s", "early_failure", n_boot, seed).drop("pos", "neg")
        each = _join(each, ranked.withColumnsRenamed(names), [*group, "b"], "left")
    return full, each.withColumn("kept", F.col("clf_new_ROC_AUC").isNotNull())


def _averaged(df: DataFrame, group: list[str], metrics: Mapping[str, Column]) -> DataFrame:
    """Means over repeats of ``metrics`` as a long table (group..., metric, value); a resample with one class in any repeat is left out."""
    kept = [F.min(F.col("kept").cast("int")).alias("__kept")] if "kept" in df.columns else [F.lit(1).alias("__kept")]
    wide = df.groupBy(*group).agg(*[F.avg(c).alias(k) for k, c in metrics.items()], *kept)
    entries = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("value")) for k in metrics])).alias("m")
    return wide.select(*group, "__kept", entries).select(*group, "__kept", "m.metric", "m.value")


def _with_interval(full: DataFrame, each: DataFrame, by: list[str], metrics: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    value = _averaged(full, by, metrics).drop("__kept")
    boots = _averaged(each, [*by, "b"], metrics)
    kept = boots.filter("__kept = 1")
    skipped = boots.groupBy(*by, "metric").agg(F.sum(1 - F.col("__kept")).alias("n_skipped"))
    out = _join(_join(value, bootstrap_interval(kept, [*by, "metric"], "value"), [*by, "metric"], "left"), skipped, [*by, "metric"])
    return out, kept


def resampled_metric_table(full: DataFrame, each: DataFrame, by: Sequence[str], repeat: str = "repeat") -> DataFrame:
    """(by..., metric, mean, lo95, hi95, n_repeats, n_skipped): repeat-averaged metrics with percentile intervals over resamples."""
    by = list(by)
    out, _ = _with_interval(full, each, by, {c: F.col(c) for c in full.columns if c not in (*by, repeat)})
    n = full.groupBy(*by).agg(F.countDistinct(repeat).alias("n_repeats"))
    return _join(out, n, by).select(*by, "metric", F.col("value").alias("mean"), F.col("lo").alias("lo95"), F.col("hi").alias("hi95"), "n_repeats", "n_skipped")


def paired_difference_table(full: DataFrame, each: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by..., difference, estimate, lo95, hi95, share_better, n_skipped) of the new model against the baseline on the same resamples.

    An error that falls and an area that grows count as better.
    """
    by = list(by)
    names = {"dMAE": "reg_{}_MAE", "dRMSE": "reg_{}_RMSE", "dPR_AUC": "clf_{}_PR_AUC", "dROC_AUC": "clf_{}_ROC_AUC"}
    out, kept = _with_interval(full, each, by, {k: F.col(c.format("new")) - F.col(c.format("base")) for k, c in names.items()})
    better = F.when(F.col("metric").isin("dMAE", "dRMSE"), F.col("value") < 0).otherwise(F.col("value") > 0)
    share = kept.groupBy(*by, "metric").agg(F.avg(better.cast("double")).alias("share_better"))
    out = _join(out, share, [*by, "metric"], "left")
    return out.select(*by, F.col("metric").alias("difference"), F.col("value").alias("estimate"), F.col("lo").alias("lo95"), F.col("hi").alias("hi95"), "share_better", "n_skipped")
