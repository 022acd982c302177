"""Document quality from a linear-chain conditional random field over the lines of a text.

Each line is good or bad. Its score comes from the shape of the line itself and of the lines before and after it; a
transition matrix ties neighbouring lines. The forward-backward marginals of the good state, weighted by the lines'
lengths, make the quality of the document; a logistic curve fitted on the same sample turns it into a probability.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text_arrays import WHITE_SPACE_WORDS, slices, text_buffers, words

#: Bounds of the sample that the model is fitted on: documents, runs of lines from each, lines in a run.
FIT_DOCUMENTS, FIT_RUNS, RUN_LINES = 2000, 8, 64
FIT_STEPS, FIT_RATE, FIT_PENALTY = 150, 0.15, 1e-3

#: Kinds of bytes whose shares describe a line.
KINDS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "space": b" \t\r\x0b\f", "stop": b".,;:?'\"-", "shout": b"!", "bar": b"|",
    "symbol": b"#$%&*@^~=_+<>{}[]\\/`", "paren": b"()",
}
_KIND_OF = np.zeros(256, dtype=np.int8)
for _k, _chars in enumerate(KINDS.values(), 1):
    _KIND_OF[list(_chars)] = _k
_UPPER, _SPACE = 1, 3
N_SHAPES = len(KINDS) + 8


@dataclass
class Lines:
    """Lines of consecutive texts: text ``t`` owns lines ``first[t]`` to ``first[t + 1]``."""

    first: np.ndarray
    length: np.ndarray
    shapes: np.ndarray


def line_shapes(data: np.ndarray, borders: np.ndarray) -> Lines:
    """Shape features of all lines (runs of bytes between line feeds and text borders) of the texts between ``borders``."""
    lo = int(borders[0])
    b = data[lo : int(borders[-1])]
    edges = borders - lo
    feeds = np.flatnonzero(b == 10)
    owner_end = edges[1:]
    begin = np.sort(np.concatenate([edges[:-1][edges[1:] > edges[:-1]], feeds + 1]))
    # a line feed that ends a text begins no line of the next one
    ends_text = np.isin(feeds + 1, owner_end)
    if ends_text.any():
        spare = feeds[ends_text] + 1
        at = np.searchsorted(begin, spare)
        begin = np.delete(begin, at)
    n = len(b)
    first = np.searchsorted(begin, edges)
    end = np.append(begin[1:], n)
    last_of_text = first[1:][first[1:] > first[:-1]] - 1
    end[last_of_text] = owner_end[first[1:] > first[:-1]]
    has_feed = (end > begin) & (b[np.maximum(end - 1, 0)] == 10) if n else np.zeros(0, bool)
    end = end - has_feed
    length = end - begin
    kind = _KIND_OF[b]
    shapes = np.zeros((len(begin), N_SHAPES), dtype=np.float32)
    total = np.zeros(n + 1, dtype=np.int32)
    size = np.maximum(length, 1)
    for k in range(1, len(KINDS) + 1):
        np.cumsum(kind == k, out=total[1:])
        shapes[:, k - 1] = (total[end] - total[begin]) / size
    spaces = shapes[:, _SPACE - 1] * size
    letters = np.zeros(n + 1, dtype=np.int32)
    np.cumsum(((b | 32) >= 97) & ((b | 32) <= 122) | (b >= 128), out=letters[1:])
    letter_count = letters[end] - letters[begin]
    filled = length > 0
    j = len(KINDS)
    shapes[:, j] = letter_count / size
    shapes[:, j + 1] = shapes[:, _UPPER - 1] * size / np.maximum(letter_count, 1)
    shapes[:, j + 2] = np.minimum(size / (spaces + 1), 30) / 10
    shapes[:, j + 3] = np.log1p(length) / 5
    shapes[filled, j + 4] = np.isin(b[end[filled] - 1], list(b".?!\""))
    shapes[filled, j + 5] = kind[begin[filled]] == _UPPER
    shapes[:, j + 6] = _repeats(data, borders, begin, end)
    shapes[:, j + 7] = 1
    shapes[:, : len(KINDS)] *= 5
    return Lines(first, length, shapes)


def _repeats(data: np.ndarray, borders: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Share of a line's words that equal the word before them."""
    w = words(data, borders, WHITE_SPACE_WORDS)
    total = np.zeros(len(w.hashes) + 1, dtype=np.int64)
    np.cumsum(np.append(False, w.hashes[1:] == w.hashes[:-1])[: len(w.hashes)], out=total[1:])
    a, z = np.searchsorted(w.begin, begin), np.searchsorted(w.begin, end)
    return np.where(z - a > 1, (total[z] - total[np.minimum(a + 1, z)]) / np.maximum(z - a, 1), 0)


def with_neighbours(lines: Lines) -> np.ndarray:
    """Shapes of each line, of the line before and of the line after it in its text (zeros beyond the ends)."""
    x = lines.shapes
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    starts = lines.first[:-1][lines.first[1:] > lines.first[:-1]]
    before[starts] = 0
    after[lines.first[1:][lines.first[1:] > lines.first[:-1]] - 1] = 0
    return np.concatenate([x, before, after], axis=1)


@dataclass
class ChainModel:
    weights: np.ndarray
    transition: np.ndarray
    slope: float = 1.0
    offset: float = 0.0


def _log_sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


def marginals(score: np.ndarray, first: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(good) of each line, expected transition counts [2, 2] and log partition per text; all texts advance together.

    ``score`` is the log-odds of good from the features alone; line k of every text that has one is handled in one step.
    """
    n_lines = np.diff(first)
    order = np.argsort(-n_lines, kind="stable")
    starts, counts = first[:-1][order], n_lines[order]
    longest = int(counts[0]) if len(counts) else 0
    alive = [int(np.searchsorted(-counts, -k, side="left")) for k in range(longest + 1)]  # texts with more than k lines
    forward = np.zeros((len(score), 2))
    backward = np.zeros((len(score), 2))
    for k in range(longest):
        m = alive[k]
        i = starts[:m] + k
        unary = np.stack([np.zeros(m), score[i]], axis=1)
        if k:
            p = forward[i - 1]
            unary = unary + np.stack([_log_sum(p[:, 0] + transition[0, s], p[:, 1] + transition[1, s]) for s in (0, 1)], axis=1)
        forward[i] = unary
    for k in range(longest - 2, -1, -1):
        m = alive[k + 1]
        i = starts[:m] + k
        nxt = backward[i + 1] + np.stack([np.zeros(m), score[i + 1]], axis=1)
        backward[i] = np.stack([_log_sum(nxt[:, 0] + transition[s, 0], nxt[:, 1] + transition[s, 1]) for s in (0, 1)], axis=1)
    both = forward + backward
    good = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -60, 60)))
    filled = n_lines > 0
    log_z = np.zeros(len(n_lines))
    ends = first[1:][filled] - 1
    log_z[filled] = _log_sum(forward[ends, 0], forward[ends, 1])
    inner = np.setdiff1d(np.arange(len(score)), first[:-1][filled], assume_unique=True)
    z = np.repeat(log_z, n_lines)[inner]
    unary = np.stack([np.zeros(len(inner)), score[inner]], axis=1)
    counts2 = np.array([[np.exp(forward[inner - 1, a] + transition[a, c] + unary[:, c] + backward[inner, c] - z).sum() for c in (0, 1)] for a in (0, 1)])
    return good, counts2, log_z


def document_quality(good: np.ndarray, lines: Lines) -> np.ndarray:
    """Length-weighted mean of the lines' marginals; 0 for texts without characters."""
    weight = np.append(0, np.cumsum(good * lines.length))
    size = np.append(0, np.cumsum(lines.length))
    w, s = weight[lines.first[1:]] - weight[lines.first[:-1]], size[lines.first[1:]] - size[lines.first[:-1]]
    return np.where(s > 0, w / np.maximum(s, 1), 0.0)


def fit_chain(x: np.ndarray, lines: Lines, quality: np.ndarray) -> ChainModel:
    """Conditional likelihood by Adam; every line carries the label of its document, both labels weigh the same."""
    n_lines = np.diff(lines.first)
    y = np.repeat(quality, n_lines).astype(float)
    share = min(max(quality.mean(), 1e-3), 1 - 1e-3)
    doc_weight = np.where(quality == 1, 0.5 / share, 0.5 / (1 - share))
    w, t = np.zeros(x.shape[1]), np.zeros((2, 2))
    state = [np.zeros(len(w) + 4), np.zeros(len(w) + 4)]
    sets = [(np.flatnonzero(quality == q), doc_weight[quality == q][0]) for q in (0, 1) if (quality == q).any()]
    parts = []
    for docs, weight in sets:
        rows = np.concatenate([np.arange(lines.first[d], lines.first[d + 1]) for d in docs]) if len(docs) else np.zeros(0, int)
        parts.append((x[rows], y[rows], np.append(0, np.cumsum(n_lines[docs])), weight))
    n = max(1, len(y))
    for step in range(1, FIT_STEPS + 1):
        g_w, g_t = FIT_PENALTY * w, FIT_PENALTY * t
        for px, py, first, weight in parts:
            good, pairs, _ = marginals(px @ w, first, t)
            g_w = g_w + weight * (px.T @ (good - py)) / n
            label = int(py[0]) if len(py) else 0
            seen = np.zeros((2, 2))
            seen[label, label] = pairs.sum()
            g_t = g_t + weight * (pairs - seen) / n
        g = np.concatenate([g_w, g_t.ravel()])
        state[0] = 0.9 * state[0] + 0.1 * g
        state[1] = 0.999 * state[1] + 0.001 * g * g
        move = FIT_RATE * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.999**step)) + 1e-8)
        w, t = w - move[: len(w)], t - move[len(w) :].reshape(2, 2)
    model = ChainModel(w, t)
    good, _, _ = marginals(x @ w, lines.first, t)
    return _with_curve(model, _odds(document_quality(good, lines)), quality)


def _odds(q: np.ndarray) -> np.ndarray:
    q = np.clip(q, 1e-4, 1 - 1e-4)
    return np.log(q / (1 - q))


def _with_curve(model: ChainModel, odds: np.ndarray, quality: np.ndarray) -> ChainModel:
    """Newton steps of a logistic curve with a small penalty; its slope never turns negative."""
    z = np.stack([odds, np.ones(len(odds))], axis=1)
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -40, 40)))
        h = (z * (p * (1 - p))[:, None]).T @ z + 0.5 * np.eye(2)
        step = np.linalg.solve(h, z.T @ (p - quality) + 0.5 * (beta - [1.0, 0.0]))
        beta = beta - step
        if abs(step).max() < 1e-8:
            break
    model.slope, model.offset = max(float(beta[0]), 0.0), float(beta[1])
    return model


def score_texts(data: np.ndarray, borders: np.ndarray, model: ChainModel) -> np.ndarray:
    lines = line_shapes(data, borders)
    good, _, _ = marginals(with_neighbours(lines) @ model.weights, lines.first, model.transition)
    quality = document_quality(good, lines)
    score = 1 / (1 + np.exp(-(model.slope * _odds(quality) + model.offset)))
    empty = np.diff(borders) == 0
    return np.where(empty, 0.0, score)


def held_out(doc_id: Column) -> Column:
    """Rows that no label may be learnt from; a null id is not held out (and has no label)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fitting_runs(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Shapes of the sample: runs of RUN_LINES lines, at most FIT_RUNS from each of FIT_DOCUMENTS labelled documents.

    Half of the documents have either label where there are enough; a hash of doc_id picks them. Documents whose labels
    disagree, are null or are neither 0 nor 1 take no part, nor do held-out ones.
    """
    sound = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    one = sound.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).filter("quality = other")
    picked = [one.filter(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_DOCUMENTS // 2) for q in (0, 1)]
    sample = F.broadcast(picked[0].unionAll(picked[1]).select("doc_id", "quality"))
    rows = docs.select("doc_id", "text").join(sample, "doc_id").select("text", "quality")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, borders = text_buffers(batch.column(0))
            out = []
            for lo, hi in slices(borders):
                lines = line_shapes(data, borders[lo : hi + 1])
                for t in range(hi - lo):
                    a, b = int(lines.first[t]), int(lines.first[t + 1])
                    starts = list(range(a, b, RUN_LINES))
                    for s in starts[:: max(1, -(-len(starts) // FIT_RUNS))]:
                        e = min(b, s + RUN_LINES)
                        out.append((batch.column(1)[lo + t].as_py(), lines.length[s:e].astype(np.int64), lines.shapes[s:e].ravel()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.list_(pa.int64())), pa.array([o[2] for o in out], pa.list_(pa.float32()))], names=["quality", "length", "shapes"])

    return rows.withColumn("quality", F.col("quality").cast("int")).mapInArrow(run, "quality int, length array<bigint>, shapes array<float>")


def fit(docs: DataFrame, labels: DataFrame) -> ChainModel:
    """The model from the bounded sample of ``fitting_runs``; without both labels it knows nothing and scores 0.5."""
    runs = fitting_runs(docs, labels).toArrow().to_pandas()
    if runs["quality"].nunique() < 2:
        return ChainModel(np.zeros(3 * N_SHAPES), np.zeros((2, 2)))
    runs = runs.assign(text=[bytes(np.asarray(s, np.float32).tobytes()) for s in runs["shapes"]]).sort_values(["quality", "text"])  # the same order in every run
    length = np.concatenate(runs["length"].to_list())
    shapes = np.concatenate(runs["shapes"].to_list()).reshape(-1, N_SHAPES)
    lines = Lines(np.append(0, np.cumsum([len(v) for v in runs["length"]])), length, shapes)
    return fit_chain(with_neighbours(lines).astype(float), lines, runs["quality"].to_numpy())


def score(docs: DataFrame, model: ChainModel) -> DataFrame:
    """Append ``score`` (0 to 1, higher: better) from the whole text of each row; no other column has a say.

    Null and empty texts score 0. A ``score`` column of the input is replaced. No shuffle.
    """
    rest = docs.drop("score")
    schema = rest.select("*", F.lit(0.0).alias("score")).schema
    at = rest.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, borders = text_buffers(batch.column(at))
            out = [score_texts(data, borders[lo : hi + 1], model) for lo, hi in slices(borders)]
            scores = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, "score"])

    return rest.mapInArrow(run, schema)
