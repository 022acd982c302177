"""Hard negatives by exact integer products of Kronecker-packed candidates.

Components are integers. The components of several candidates are biased so that none is negative and put into separated
fields of one wide word. The product of that word with one component of an anchor is the product with each candidate at
once; summed over the components, each field holds one inner product plus bias * sum(anchor), which is taken off when the
fields are unpacked. A field has one bit more than the largest sum can need, so fields never run into each other. Words are
integers of a double (53 bits, multiplied by the matrix product of NumPy) as long as two fields fit, else of 64 bits.

Anchors are a stated query set. They meet all candidates block against block: both are tables of blocks of bounded size,
and each pair of blocks reports only its best rows of each anchor. A first pass finds the positives of each anchor, a
second one the negatives in the range of scores that each positive sets.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import staged

#: Rows of a block of candidates and of a block of anchors; their scores are the largest array of a task.
CANDIDATE_ROWS, ANCHOR_ROWS = 8192, 256
#: Components become floor(SCALE * x).
SCALE = 256
_LEAST = np.iinfo(np.int64).min


@dataclass(frozen=True)
class Fields:
    """How components of candidates are packed: ``count`` fields of ``width`` bits, each component plus ``bias``."""

    bias: int
    width: int
    count: int
    kind: type

    @staticmethod
    def of(least: int, most: int, anchor_sum: int) -> Fields:
        """For components from ``least`` to ``most`` and anchors whose absolute components add up to ``anchor_sum`` at most."""
        largest = (most - least) * anchor_sum
        if largest >= 1 << 56:
            raise ValueError("components are too large: scores of 56 bits or more")
        width = largest.bit_length() + 1
        return Fields(-least, width, 53 // width, np.float64) if 53 // width > 1 else Fields(-least, width, max(1, 64 // width), np.uint64)

    def pack(self, components: np.ndarray) -> np.ndarray:
        """Words (rows / count, length) from components (rows, length); field j holds the j-th part of the rows."""
        each = -(-len(components) // self.count)
        words = np.zeros((each, components.shape[1]), np.uint64)
        for j in range(self.count):
            part = components[j * each : (j + 1) * each]
            words[: len(part)] |= (part + self.bias).astype(np.uint64) << np.uint64(j * self.width)
        return words

    def scores(self, words: np.ndarray, anchors: np.ndarray, rows: int) -> np.ndarray:
        """Inner products (anchors, rows): one multiplication for each word and anchor component."""
        if self.kind is np.float64:
            total = (anchors.astype(np.float64) @ words.astype(np.float64).T).astype(np.int64).view(np.uint64)
        else:
            total = anchors.view(np.uint64) @ words.T  # modulo 2**64, as the fields are
        half = 1 << (self.width - 1)
        total = total + np.uint64(sum(half << (j * self.width) for j in range(self.count)))
        mask = np.uint64((1 << self.width) - 1)
        fields = [((total >> np.uint64(j * self.width)) & mask).view(np.int64) - half for j in range(self.count)]
        return np.concatenate(fields, axis=1)[:, :rows] - self.bias * anchors.sum(axis=1)[:, None]


def participants(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(id, label, q array<bigint>) of the rows with a label whose vector is not null and all finite."""
    rows = df.select(F.col(key).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"), F.col(vector).alias("v")).filter("label IS NOT NULL AND v IS NOT NULL")
    rows = rows.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    return rows.select("id", "label", F.transform("v", lambda x: F.floor(x.cast("double") * SCALE)).alias("q"))


def _by_length(batch: pa.RecordBatch, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in the batch, components) of at most ``most`` vectors of one length."""
    column = batch.column(batch.schema.get_field_index("q"))
    values, size = column.flatten().to_numpy(), column.value_lengths().to_numpy()
    start = np.concatenate([[0], np.cumsum(size)])[:-1]
    for length in np.unique(size):
        of_length = np.flatnonzero(size == length)
        for at in range(0, len(of_length), most):
            places = of_length[at : at + most]
            yield places, values[start[places][:, None] + np.arange(length)]


def candidate_blocks(rows: DataFrame, fields: Fields) -> DataFrame:
    """(length, ids, labels, words) of up to CANDIDATE_ROWS vectors of one length, in order of id (nulls last)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.sort_by([("id", "ascending")])
            for places, q in _by_length(batch, CANDIDATE_ROWS):
                ordered = batch.take(pa.array(places))
                yield pa.RecordBatch.from_pydict(
                    {"length": pa.array([q.shape[1]], pa.int32()), "ids": pa.array([ordered.column(0)], pa.list_(pa.int64())), "labels": pa.array([ordered.column(1)], pa.list_(pa.int64())), "words": pa.array([fields.pack(q).tobytes()], pa.binary())}
                )

    return rows.select("id", "label", "q").mapInArrow(run, "length int, ids array<bigint>, labels array<bigint>, words binary")


_ANCHORS = "a_length int, anchor array<bigint>, a_ids array<bigint>, a_labels array<bigint>, a_components binary, p_ids array<bigint>, p_scores array<bigint>"


def anchor_blocks(anchors: DataFrame, positives: int) -> DataFrame:
    """Blocks of anchors (anchor, id, label, q, positives); the ids and scores of the positives fill ``positives`` places each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for places, q in _by_length(batch, ANCHOR_ROWS):
                own = batch.take(pa.array(places))
                known = [x or [] for x in own.column(4).to_pylist()]
                filled = [x + [None] * (positives - len(x)) for x in known]
                lists = [own.column(k) for k in range(3)] + [pa.array([p and p[f] for x in filled for p in x], pa.int64()) for f in ("id", "score")]
                arrays = [pa.array([q.shape[1]], pa.int32()), *(pa.array([x], pa.list_(pa.int64())) for x in lists)]
                arrays.insert(4, pa.array([q.astype(np.int64).tobytes()], pa.binary()))
                yield pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in _ANCHORS.split(", ")])

    return anchors.select("anchor", "id", "label", "q", "positives").mapInArrow(run, _ANCHORS)


def leaders(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``k`` best allowed scores of each row; of equal scores the first column."""
    s = np.where(allowed, scores, _LEAST)
    if s.shape[1] > k:
        allowed = allowed & (s >= np.partition(s, s.shape[1] - k, axis=1)[:, [-k]])
    row, column = np.nonzero(allowed)
    order = np.lexsort((column, -s[row, column], row))
    row, column = row[order], column[order]
    first = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[first], column[first]


def _numbers(column: pa.Array, k: int) -> np.ndarray:
    return column[k].values.fill_null(_LEAST).to_numpy(zero_copy_only=False)


def _meet(candidates: DataFrame, anchors: DataFrame, fields: Fields, work, schema: str) -> DataFrame:
    """``work`` on the scores of each pair of blocks whose vectors have one length; it yields the columns of ``schema``."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
            for k in range(batch.num_rows):
                length = c["length"][k].as_py()
                if length != c["a_length"][k].as_py():
                    continue
                ids, anchor_ids = c["ids"][k].values, _numbers(c["a_ids"], k)
                words = np.frombuffer(c["words"][k].as_buffer(), np.uint64)
                of_anchors = np.frombuffer(c["a_components"][k].as_buffer(), np.int64).reshape(len(anchor_ids), length)
                scores = fields.scores(words.reshape(-(-len(ids) // fields.count), length), of_anchors, len(ids))
                same = _numbers(c["a_labels"], k)[:, None] == _numbers(c["labels"], k)[None, :]
                for columns in work(scores, same, ids, anchor_ids, {x: c[x][k].values for x in ("anchor", "p_ids", "p_scores")}):
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    return candidates.crossJoin(anchors).mapInArrow(run, schema)


def _first(found: DataFrame, by: list[str], score: str, key: str, k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc(score), F.asc_nulls_last(key))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(df: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, percent: tuple[int, int] = (30, 90), key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for each row that ``is_anchor`` (on ``id``) picks.

    Components become floor(256 * x); a score is the inner product of these integers. The positives of an anchor are its
    first rows of the same label with another id, the negatives of a positive the first rows of another label whose score
    is ``percent`` of the positive's score; higher scores come first, then smaller ids (null ids last). Rows with a null
    label, a null vector or a null or non-finite component take no part; empty vectors score 0 with each other. Vectors
    meet those of their own length only. A row without an id is no anchor. Repeated rows are rows of their own: each may
    be a positive or a negative, and each repeated anchor has its own result; no row with the anchor's id is one of its
    positives. No rows give no rows; other columns are unused. Scores of 56 bits or more raise an error.
    """
    rows = participants(df, key, vector, label)
    size = F.aggregate(F.transform("q", F.abs), F.lit(0).cast("bigint"), lambda s, x: s + x)
    bound = rows.agg(F.min(F.array_min("q")), F.max(F.array_max("q")), F.max(F.when(is_anchor, size))).first()
    least, most, anchor_sum = (int(x or 0) for x in bound)
    fields = Fields.of(min(least, 0), max(most, 0), anchor_sum)
    candidates = staged(candidate_blocks(rows, fields))
    anchors = staged(rows.filter(is_anchor & F.col("id").isNotNull()).withColumn("anchor", F.monotonically_increasing_id()))

    def nearest_of_label(scores, same, ids, anchor_ids, more):
        other = ids.fill_null(_LEAST).to_numpy()[None, :] != anchor_ids[:, None]
        row, column = leaders(scores, same & other, positives)
        yield [more["anchor"].take(pa.array(row)), ids.take(pa.array(column)), pa.array(scores[row, column])]

    empty = F.lit(None).cast("array<struct<id: bigint, score: bigint>>").alias("positives")
    found = _meet(candidates, staged(anchor_blocks(anchors.select("*", empty), 0)), fields, nearest_of_label, "anchor bigint, id bigint, score bigint")
    found = _first(found, ["anchor"], "score", "id", positives)
    listed = found.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("p"))
    listed = listed.select("anchor", F.transform("p", lambda x: F.struct(x["id"].alias("id"), x["score"].alias("score"))).alias("positives"))

    def in_range(scores, same, ids, anchor_ids, more):
        p_ids, p_scores = more["p_ids"], more["p_scores"].fill_null(0).to_numpy().reshape(-1, positives)
        there = more["p_scores"].is_valid().to_numpy(zero_copy_only=False).reshape(-1, positives)
        for p in range(positives):
            low, high = -((-percent[0] * p_scores[:, p]) // 100), (percent[1] * p_scores[:, p]) // 100
            row, column = leaders(scores, ~same & there[:, [p]] & (scores >= low[:, None]) & (scores <= high[:, None]), negatives)
            at = pa.array(row)
            yield [more["anchor"].take(at), pa.array(np.full(len(row), p, np.int32)), pa.array(anchor_ids[row]), p_ids.take(pa.array(row * positives + p)), ids.take(pa.array(column)), pa.array(p_scores[row, p]), pa.array(scores[row, column])]

    schema = "anchor bigint, place int, anchor_id bigint, positive_id bigint, negative_id bigint, positive_score bigint, negative_score bigint"
    blocks = staged(anchor_blocks(anchors.join(listed, "anchor"), positives))
    mined = _first(_meet(candidates, blocks, fields, in_range, schema), ["anchor", "place"], "negative_score", "negative_id", negatives)
    return mined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
