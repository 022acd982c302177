"""Penalised logistic models of many training sets and penalties at once, by Newton's method.

A problem is one training set (the complement of a fold, inside a group if there are groups, or all rows) with one inverse
penalty C: sum of weighted log-losses + |w|^2 / (2 C), the intercept without penalty. In each iteration one pass over the
rows adds up loss, gradient and Hessian of all problems; a task keeps one array for them, and what reaches the driver is
problems x (features + 2)^2 numbers, whatever the rows. Rows are never multiplied by folds or penalties. The problems of
a group have almost the same rows, so one of them is solved first, on all of its rows, and the others start from there.
"""
from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import finite
from ..session import store
from .linear import Prepared

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ITERATIONS, TOLERANCE, NOISE = 60, 1e-9, 1e-12
ROWS = 2048  # rows of one product; what they need stays in a core's cache
BLOCK = 4096  # bytes of a packed row, so that a batch of such rows stays small
CHUNK = 1 << 21  # numbers that a task holds while it packs
PACKED = "g string, f string, n long, pos double, block binary"


@dataclass
class Problem:
    """One training set and penalty; ``group`` and ``fold`` (None: no fold is left out) name the rows it learns from."""

    split: str
    c: float
    group: str
    fold: str | None
    coef: np.ndarray
    constant: float | None = None
    gradient: float = 0.0
    balanced: bool = False

    def learns_from(self, group: str | None, fold: str | None) -> bool:
        """A row without a fold is in final training sets only, as in ``linear.training_sets``."""
        return group == self.group and (self.fold is None or fold not in (None, self.fold))

    @property
    def weighting(self) -> str:
        """The name of its class weights."""
        return f"balanced {self.split}" if self.balanced else self.split


def _standardised(x: np.ndarray, prep: Sequence[np.ndarray]) -> np.ndarray:
    """Intercept and standardised features, one line each, from lines of features; missing values at the median."""
    low, high, median, mean, std = (v[:, None] for v in prep)
    z = np.ones((len(x) + 1, x.shape[1]))
    z[1:] = (np.where(np.isnan(x), median, np.clip(x, low, high)) - mean) / std
    return z


def _scale(prep: Prepared) -> tuple[np.ndarray, ...]:
    return prep.low, prep.high, prep.median, prep.mean, prep.std


def _coded(column: pa.Array) -> tuple[np.ndarray, list[str | None]]:
    """Codes of texts and the distinct texts; texts are compared once per distinct value, rows by their codes."""
    d = column.dictionary_encode(null_encoding="encode")
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary.to_pylist()


def _lines(batch: pa.RecordBatch, first: int, n: int) -> np.ndarray:
    """``n`` columns of numbers from column ``first`` on, one line each, NaN for missing values."""
    return np.stack([batch.column(first + k).to_numpy(zero_copy_only=False).astype(np.float64) for k in range(n)])


def _runs(codes: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """(start, stop) of equal codes that follow each other, at most ``size`` in one piece."""
    edges = [0, *(np.flatnonzero(np.diff(codes)) + 1), len(codes)]
    for start, stop in zip(edges, edges[1:]):
        for s in range(start, stop, size):
            yield s, min(s + size, stop)


def _blocks(rows: DataFrame, n_features: int) -> DataFrame:
    """Rows (group, fold, flag, features...) packed: a row holds entities of one group and fold, entity by entity, as doubles."""
    width, kind = n_features + 1, "<f8"
    size = max(1, BLOCK // (8 * width))
    names = [part.split()[0] for part in PACKED.split(", ")]

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        batch = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        (g, groups), (f, folds) = _coded(batch.column(0)), _coded(batch.column(1))
        part = g * len(folds) + f
        order = np.argsort(part, kind="stable")
        part, data = part[order], np.ascontiguousarray(_lines(batch, 2, width)[:, order].T, dtype=kind)
        start, stop = np.array(list(_runs(part, size)), dtype=np.int64).T
        ends = pa.py_buffer(np.append(start, len(part)).astype(np.int32) * np.int32(8 * width))
        block = pa.Array.from_buffers(pa.binary(), len(start), [None, ends, pa.py_buffer(data)])
        text = lambda codes, texts: pa.array([texts[k] for k in codes[order][start]], pa.string())
        pos = np.add.reduceat(np.nan_to_num(data[:, 0]), start)
        return pa.RecordBatch.from_arrays([text(g, groups), text(f, folds), pa.array(stop - start), pa.array(pos), block], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            n += batch.num_rows
            if n * width >= CHUNK:
                yield packed(held)
                held, n = [], 0
        if held:
            yield packed(held)

    return rows.mapInArrow(run, PACKED)


def _pieces(batch: pa.RecordBatch, n_features: int) -> Iterator[tuple[str | None, str | None, np.ndarray, np.ndarray]]:
    """(group, fold, flags, features) of up to ROWS entities of packed rows; features are lines."""
    width = n_features + 1
    (g, groups), (f, folds) = _coded(batch.column(0)), _coded(batch.column(1))
    block = batch.column(4).cast(pa.large_binary())
    ends = np.frombuffer(block.buffers()[1], np.int64)[block.offset : block.offset + len(block) + 1] // 8
    data = np.frombuffer(block.buffers()[2], "<f8")
    part = g * len(folds) + f
    for start, stop in _runs(part, len(part)):
        for s in range(ends[start], ends[stop], ROWS * width):
            own = np.ascontiguousarray(data[s : min(s + ROWS * width, ends[stop])].reshape(-1, width).T)
            yield groups[g[start]], folds[f[start]], own[0], own[1:]


def _by_split(problems: Sequence[Problem]) -> dict[str, list[int]]:
    """The positions of the problems of each split."""
    out: dict[str, list[int]] = {}
    for k, p in enumerate(problems):
        out.setdefault(p.split, []).append(k)
    return out


def _probabilities(x: np.ndarray, problems: Sequence[Problem], coef: np.ndarray, scale: tuple[np.ndarray, ...]) -> np.ndarray:
    """Clipped probabilities (problems x rows) by models of one split, from lines of features."""
    m = coef @ _standardised(x, scale)
    e = np.exp(-np.abs(m))
    out = np.where(m >= 0, 1.0, e) / (1.0 + e)
    for k, p in enumerate(problems):
        if p.constant is not None:
            out[k] = p.constant
    return np.clip(out, 1e-6, 1.0 - 1e-6)


def _sums(rows: DataFrame, n_features: int, problems: list[Problem], prepared: dict[str, Prepared], weights: dict[str, tuple[float, float]]) -> np.ndarray:
    """Loss, gradient and Hessian (problems, 1 + q + q * q) from rows (group, fold, flag, features...) or packed rows."""
    q = n_features + 1
    left, right = np.triu_indices(q)
    width, count = 1 + q + len(left), len(problems)
    jobs = []
    for split, at in _by_split(problems).items():
        mine = [problems[k] for k in at]
        jobs.append((mine[0], at, np.stack([p.coef for p in mine]), np.array([weights[p.weighting] for p in mine]), _scale(prepared[split])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((count, width))
        for group, fold, t, x in (piece for batch in batches for piece in _pieces(batch, n_features)):
            for one, at, coef, classes, scale in jobs:
                if not one.learns_from(group, fold):
                    continue
                z = _standardised(x, scale)
                w = np.where(t == 1, classes[:, 1:], classes[:, :1])
                m = coef @ z  # all penalties of the split at once: problems x rows
                e = np.exp(-np.abs(m))
                mu = np.where(m >= 0, 1.0, e) / (1.0 + e)
                total[at, 0] += (w * (np.maximum(m, 0.0) + np.log1p(e) - t * m)).sum(axis=1)
                total[at, 1 : 1 + q] += (w * (mu - t)) @ z.T
                total[at, 1 + q :] += (w * mu * (1.0 - mu)) @ (z[left] * z[right]).T
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], names=["s"])

    if "block" not in rows.columns:
        rows = _blocks(rows, n_features)
    found = np.zeros(count * width)
    for r in rows.mapInArrow(run, "s array<double>").select(F.posexplode("s").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).collect():  # at most problems x (q + 1)^2 rows
        found[r.k] = r.v
    found = found.reshape(count, width)
    out = np.zeros((count, 1 + q + q * q))
    out[:, : 1 + q] = found[:, : 1 + q]
    out[:, 1 + q + left * q + right] = out[:, 1 + q + right * q + left] = found[:, 1 + q :]
    return out


def _newton(rows: DataFrame, n_features: int, problems: Sequence[Problem], prepared: dict[str, Prepared], weights: dict[str, tuple[float, float]]) -> None:
    """Solve the problems, each from its coefficients.

    A problem is settled when its gradient is small beside its curvature; unless
    the gradient is mere rounding by then, one step more is taken, since the
    bound grows with the rows. Raises if a gradient has not settled after ITERATIONS passes.
    """
    q, todo = n_features + 1, list(problems)
    last: dict[int, tuple[float, np.ndarray, np.ndarray]] = {}  # loss, coefficients and step of the point before
    settled: dict[int, tuple[float, np.ndarray]] = {}  # gradient and coefficients
    for _ in range(ITERATIONS):
        if not todo:
            return
        for p, s in zip(list(todo), _sums(rows, n_features, todo, prepared, weights), strict=True):
            penalty = np.append(0.0, np.full(q - 1, 1.0 / p.c))
            loss = s[0] + (penalty * p.coef**2).sum() / 2
            gradient, hessian = s[1 : 1 + q] + penalty * p.coef, s[1 + q :].reshape(q, q) + np.diag(penalty)
            p.gradient = float(np.abs(gradient).max())
            bound = max(1.0, hessian[0, 0])
            if id(p) in settled or p.gradient <= NOISE * bound:
                if id(p) in settled and settled[id(p)][0] < p.gradient:
                    p.gradient, p.coef = settled[id(p)]
                todo.remove(p)
                continue
            if p.gradient <= TOLERANCE * bound:
                settled[id(p)] = (p.gradient, p.coef)
            elif id(p) in last and loss > last[id(p)][0] + 1e-12 * abs(last[id(p)][0]):
                before, start, step = last[id(p)]
                last[id(p)] = (before, start, step / 2)
                p.coef = start + step / 2
                continue
            step = -np.linalg.solve(hessian + 1e-12 * np.trace(hessian) / q * np.eye(q), gradient)
            last[id(p)] = (loss, p.coef, step)
            p.coef = p.coef + step
    for p in list(todo):  # settled in the last pass
        if id(p) in settled:
            p.gradient, p.coef = settled[id(p)]
            todo.remove(p)
    if todo:
        raise ArithmeticError(f"no convergence: {[(p.split, p.c) for p in todo]}")


def _rescaled(coef: np.ndarray, own: Prepared, other: Prepared) -> np.ndarray:
    """Coefficients of features standardised by ``own``, for features standardised by ``other``."""
    slope = coef[1:] / own.std
    return np.append(coef[0] + (slope * (other.mean - own.mean)).sum(), slope * other.std)


def fit(rows: DataFrame, features: Sequence[str], flag: str, prepared: dict[str, Prepared], cs: Sequence[float], fold: str | None = None,
        group: str | None = None, balanced: bool | Sequence[bool] = False) -> list[Problem]:
    """Fit every split of ``prepared`` with every C.

    A split is named 'fold' or 'final', with groups 'group/fold' or 'group/final'. ``balanced`` weights both classes
    equally within each training set; (False, True) fits both ways in the same passes. A training set of one class has
    its share as a constant probability. The largest training set of each group is solved with the smallest C, and the
    other problems start from it. Raises if a gradient has not settled after ITERATIONS passes.
    """
    return solve(pack(rows, features, flag, fold, group), len(features), prepared, cs, balanced)


def pack(rows: DataFrame, features: Sequence[str], flag: str, fold: str | None = None, group: str | None = None) -> DataFrame:
    """Rows as ``solve`` and ``training_means`` read them, stored."""
    name = lambda c: F.col(c).cast("string") if c else F.lit("")
    slim = rows.select(name(group).alias("g"), name(fold).alias("f"), F.col(flag).cast("double").alias("y"), *[finite(c).cast("double").alias(f"x{k}") for k, c in enumerate(features)])
    return store(_blocks(slim, len(features)))


def solve(packed: DataFrame, n_features: int, prepared: dict[str, Prepared], cs: Sequence[float], balanced: bool | Sequence[bool] = False) -> list[Problem]:
    """``fit`` of packed rows."""
    counts = {(r.g, r.f): (r.n, r.pos) for r in packed.groupBy("g", "f").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")).collect()}  # groups x folds rows
    problems, weights, sizes = [], {}, {}
    for split in prepared:
        g, _, f = split.rpartition("/")
        for way in [balanced] if isinstance(balanced, bool) else balanced:
            first = Problem(split, 0.0, g, None if f == "final" else f, np.zeros(n_features + 1), balanced=way)
            inside = [v for (a, b), v in counts.items() if first.learns_from(a, b)]
            n, pos = sum(v[0] for v in inside), sum(v[1] for v in inside)
            one, sizes[split] = n == 0 or pos in (0, n), n
            weights[first.weighting] = (n / (2.0 * (n - pos)), n / (2.0 * pos)) if way and not one else (1.0, 1.0)
            problems += [replace(first, c=float(c), constant=pos / max(n, 1) if one else None) for c in cs]
    todo, leads = [p for p in problems if p.constant is None], {}
    for p in sorted(todo, key=lambda p: (-sizes[p.split], p.c)):
        leads.setdefault((p.group, p.balanced), p)
    _newton(packed, n_features, list(leads.values()), prepared, weights)
    rest = [p for p in todo if p is not leads[p.group, p.balanced]]
    for p in rest:
        lead = leads[p.group, p.balanced]
        p.coef = _rescaled(lead.coef, prepared[lead.split], prepared[p.split])
    _newton(packed, n_features, rest, prepared, weights)
    return problems


def training_means(packed: DataFrame, n_features: int, problems: Sequence[Problem], prepared: dict[str, Prepared]) -> DataFrame:
    """(split, C, balanced, flag, n, p_fail) of each problem and class: its training rows and their mean probability.

    A task adds up its rows; no row is multiplied by splits or penalties.
    """
    jobs = []
    for split, at in _by_split(problems).items():
        mine = [problems[k] for k in at]
        jobs.append((mine, at, np.stack([p.coef for p in mine]), _scale(prepared[split])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros((len(problems), 2), np.int64), np.zeros((len(problems), 2))
        for group, fold, t, x in (piece for batch in batches for piece in _pieces(batch, n_features)):
            for mine, at, coef, scale in jobs:
                if mine[0].learns_from(group, fold):
                    p = _probabilities(x, mine, coef, scale)
                    for v in (0, 1):
                        n[at, v] += int((t == v).sum())
                        total[at, v] += p @ (t == v)
        k, v = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(v == 1), pa.array(n[k, v]), pa.array(total[k, v])], names=["k", "flag", "n", "p"])

    sums = packed.mapInArrow(run, "k int, flag boolean, n long, p double").groupBy("k", "flag").agg(F.sum("n").alias("n"), (F.sum("p") / F.sum("n")).alias("p_fail"))
    names = packed.sparkSession.createDataFrame([(k, p.split, p.c, p.balanced) for k, p in enumerate(problems)], "k int, split string, C double, balanced boolean")
    return sums.join(F.broadcast(names), "k").select("split", "C", "balanced", "flag", "n", "p_fail")  # one row per problem


def predict(rows: DataFrame, split: Column, features: Sequence[str], problems: Sequence[Problem], prepared: dict[str, Prepared], keep: Sequence[str]) -> DataFrame:
    """(keep..., C, p_fail) of each row and penalty by the models of the row's ``split``.

    Batches of rows are predicted as one product per split: an expression over
    a joined table of the models was, from three features on, more code than
    the JVM compiles, and 20 times slower.
    """
    models = {}
    for s, at in _by_split(problems).items():
        mine = [problems[k] for k in at]
        models[s] = (mine, np.stack([p.coef for p in mine]), _scale(prepared[s]))
    n = len(features)
    schema = T.StructType([*rows.select(*keep).schema.fields, T.StructField("C", T.DoubleType()), T.StructField("p_fail", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, names = _coded(batch.column(0))
            order = np.argsort(code, kind="stable")
            code, x = code[order], _lines(batch, 1, n)[:, order]
            at, c, p = [], [], []
            for start, stop in _runs(code, ROWS):
                if names[code[start]] in models:
                    mine, coef, scale = models[names[code[start]]]
                    at.append(np.tile(order[start:stop], len(mine)))
                    c.append(np.repeat([q.c for q in mine], stop - start))
                    p.append(_probabilities(x[:, start:stop], mine, coef, scale).ravel())
            if at:
                kept = batch.select(range(1 + n, batch.num_columns)).take(pa.array(np.concatenate(at)))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(np.concatenate(c)), pa.array(np.concatenate(p))], names=schema.names)

    slim = rows.select(split.cast("string").alias("__own"), *[finite(f).alias(f"__x{k}") for k, f in enumerate(features)], *keep)
    return slim.mapInArrow(run, schema)
