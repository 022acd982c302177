"""Byte-level BPE as a monoid: a text is encoded as a tree of halves whose token lists are joined.

A node of the tree is a piece of text with its token ids. Two neighbouring nodes are joined by encoding a window around
their border anew. The window grows until both of its ends are *firm* places: places where the split pattern ends a match
in every context, so that what lies outside has the same matches, hence the same tokens, in the node and in the whole.
Decoding joins the bytes of the tokens up the same kind of tree.

Firm places follow from the pattern: no match holds white space after another character, and a match holds characters of
one class only (letters, numbers, others), but for the contractions, which begin with an apostrophe. So a border between
two characters is firm if the left one is no white space and the right one is white space or of another class, unless the
left one is an apostrophe. If a node has no firm place in reach, the window is the whole node, which is right by definition.
"""
from __future__ import annotations

import base64
import hashlib
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a leaf of the tree, and of the first window on each side of a border.
LEAF_CHARS = 1 << 14
WINDOW_CHARS = 32


@lru_cache(maxsize=4)
def vocabulary(path: str, pattern: str):
    """The merge ranks at ``path`` as an encoder of short texts, and the bytes of every id."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    names = np.empty(max(ranks.values()) + 1, dtype=object)
    for token, rank in ranks.items():
        names[rank] = token
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary, names


def _class(c: str) -> str:
    """White space, letter, number, other; '?' where Unicode versions may disagree."""
    kind = unicodedata.category(c)
    if kind == "Cn":
        return "?"
    return " " if c.isspace() and not "\x1c" <= c <= "\x1f" else kind[0] if kind[0] in "LN" else "P"


def firm(text: str, at: int) -> bool:
    """Whether the split pattern ends a match between ``text[at - 1]`` and ``text[at]`` whatever stands around them."""
    left, right = _class(text[at - 1]), _class(text[at])
    return left != " " and right != left and text[at - 1] != "'" and "?" not in (left, right)


def _firm_left(text: str, lo: int, border: int) -> int:
    """The last firm place of [lo, border) that is at least a window away from the border, or lo."""
    at = border - WINDOW_CHARS
    while at > lo and not firm(text, at):
        at -= 1
    return max(at, lo)


def _firm_right(text: str, border: int, hi: int) -> int:
    at = border + WINDOW_CHARS
    while at < hi and not firm(text, at):
        at += 1
    return min(at, hi)


def encode_text(text: str, encode, leaf_chars: int = LEAF_CHARS) -> list[int]:
    """Token ids of ``text`` by recursive halving; ``encode`` is used on leaves and on windows around borders only."""

    def node(lo: int, hi: int) -> list[int]:
        if hi - lo <= leaf_chars:
            return encode(text[lo:hi])
        middle = (lo + hi) // 2
        left, right = node(lo, middle), node(middle, hi)
        a, b = _firm_left(text, lo, middle), _firm_right(text, middle, hi)
        gone, come = len(encode(text[a:middle])), len(encode(text[middle:b]))
        return left[: len(left) - gone] + encode(text[a:b]) + right[come:]

    return node(0, len(text))


def decode_ids(ids: list[int] | np.ndarray, names: np.ndarray, leaf_ids: int = 1 << 14) -> bytes:
    """Bytes of the ids; the bytes of both halves are joined up the tree."""
    if len(ids) <= leaf_ids:
        return b"".join(names[np.asarray(ids, dtype=np.int64)])
    middle = len(ids) // 2
    return decode_ids(ids[:middle], names, leaf_ids) + decode_ids(ids[middle:], names, leaf_ids)


def _clash_free(df: DataFrame, names: list[str]) -> DataFrame:
    """Columns of ``df`` that carry the name of an output are dropped: the output wins."""
    return df.drop(*[c for c in df.columns if c.lower() in names])


def encode(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """Append ``ids array<int>``: the tokens of the whole text.

    A null text is empty and has no ids. An ``ids`` column of the input is replaced. No shuffle; a task holds one batch.
    """
    rest = _clash_free(df, ["ids"])
    schema = rest.select("*", F.lit(None).cast("array<int>").alias("ids")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, _ = vocabulary(path, pattern)
        for whole in batches:
            for batch in _small(whole, text):
                ids = [encode_text(t or "", code) for t in batch.column(text).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], names=[*batch.schema.names, "ids"])

    return rest.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """Append ``decoded binary``: the bytes of the ids (null ids: no bytes). A ``decoded`` column of the input is replaced."""
    rest = _clash_free(df, ["decoded"])
    schema = rest.select("*", F.lit(None).cast("binary").alias("decoded")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, names = vocabulary(path, pattern)
        for whole in batches:
            for batch in _small(whole, ids):
                out = [decode_ids(x if x is not None else [], names) for x in (v.values.to_numpy() if v.is_valid else None for v in batch.column(ids))]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "decoded"])

    return rest.mapInArrow(run, schema)


def _small(batch: pa.RecordBatch, column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes in ``column``, one row at least."""
    each = max(1, int(most * batch.num_rows / max(1, batch.column(column).nbytes)))
    for at in range(0, batch.num_rows, each):
        yield batch.slice(at, each)


def round_trip(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the key, n_tokens, SHA-256 of the ids (decimal, one space between) and of the bytes decoded from them.

    Encoding and decoding run in one pass, so that neither ids nor bytes leave the task. Rows with a null or empty text
    have no tokens; rows with a null key and repeated rows are returned as they are, one row each.
    """
    kept = df.select(F.col(key), F.col(text))
    schema = kept.select(key, F.lit(0).cast("bigint").alias("n_tokens"), F.lit("").alias("ids_sha256"), F.lit("").alias("decoded_sha256")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, names = vocabulary(path, pattern)
        for batch in batches:
            count, of_ids, of_bytes = [], [], []
            for t in batch.column(1):
                ids = encode_text(t.as_py() or "", code)
                count.append(len(ids))
                of_ids.append(hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
                of_bytes.append(hashlib.sha256(decode_ids(ids, names)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return kept.mapInArrow(run, schema)
