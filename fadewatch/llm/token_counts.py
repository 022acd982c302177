"""Tokens of each document in flat token files without an index, by a scan for the end-of-document identifier.

A flat file is nothing but fixed-width little-endian identifiers; an identifier ends each document. Files are cut into
blocks. In each block one vectorised search finds the ends and the counts between them; what crosses the borders of blocks
is stitched by a prefix scan over the blocks' summaries (the last end so far, the number of ends so far).
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .byte_bpe import encode_text, vocabulary

#: Identifiers of a block. A file is at most 2 GiB for Spark's reader, so a prefix scan sees at most 16,384 blocks.
BLOCK_TOKENS = 1 << 16


def _kind(width: int) -> np.dtype:
    return np.dtype({2: "<u2", 4: "<u4"}[width])


def write_token_files(docs: DataFrame, folder: str, path: str, pattern: str, end_id: int, width: int = 2) -> None:
    """Write the tokens of ``text`` as flat files, one for each partition of ``docs``, in the order of its rows.

    Spark's text writer puts the bytes of a row and then its line separator; here the separator is the end identifier.
    A null text has no tokens, only its end. No shuffle.
    """
    if end_id >= 1 << (8 * width):
        raise ValueError("the end identifier does not fit the width")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, _ = vocabulary(path, pattern)
        for batch in batches:
            out = [np.array(encode_text(t.as_py() or "", code), dtype=_kind(width)).tobytes() for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    separator = end_id.to_bytes(width, "little").decode("latin-1")
    flat = docs.select("text").mapInArrow(run, "value binary")
    flat.select(F.col("value").cast("string")).write.option("lineSep", separator).option("encoding", "ISO-8859-1").text(folder)


def block_summaries(files: DataFrame, end_id: int, width: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, block, tokens, ends, first_end, last_end, inner) for each block of ``files`` (path, content)."""
    size = block_tokens * width
    n = F.greatest(F.ceil(F.octet_length("content") / size).cast("int"), F.lit(1))
    parts = F.transform(F.sequence(F.lit(0), n - 1), lambda b: F.substring(F.col("content"), b * size + 1, F.lit(size)))
    blocks = files.select(F.col("path").alias("file"), F.posexplode(parts).alias("block", "bytes"))
    schema = "file string, block int, tokens bigint, ends bigint, first_end bigint, last_end bigint, inner array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, ends, first, last, inner = [], [], [], [], []
            for b in batch.column(2):
                raw = b.as_buffer()
                ids = np.frombuffer(raw, dtype=_kind(width), count=raw.size // width)
                at = np.flatnonzero(ids == end_id)
                tokens.append(len(ids))
                ends.append(len(at))
                first.append(int(at[0]) if len(at) else None)
                last.append(int(at[-1]) if len(at) else None)
                inner.append(np.diff(at) - 1)
            kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(c, k) for c, k in zip((tokens, ends, first, last, inner), kinds, strict=True))],
                                             names=["file", "block", "tokens", "ends", "first_end", "last_end", "inner"])

    return blocks.mapInArrow(run, schema)


def stitched(blocks: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, ordinal, n_tokens, ended): documents of each file in order; ended is false for what no end follows."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("block").cast("bigint") * block_tokens
    scan = blocks.withColumns({
        "previous": F.coalesce(F.max(start + F.col("last_end")).over(before), F.lit(-1)),
        "base": F.coalesce(F.sum("ends").over(before), F.lit(0)),
        "final": F.lead("block").over(Window.partitionBy("file").orderBy("block")).isNull(),
    })
    first = start + F.col("first_end") - F.col("previous") - 1
    counts = F.when(F.col("ends") > 0, F.concat(F.array(first), "inner")).otherwise(F.array().cast("array<bigint>"))
    ended = scan.select("file", "base", F.posexplode(counts).alias("k", "n_tokens")).select("file", (F.col("base") + F.col("k")).alias("ordinal"), "n_tokens", F.lit(True).alias("ended"))
    last = F.coalesce(start + F.col("last_end"), F.col("previous"))
    rest = scan.filter("final").select("file", (F.col("base") + F.col("ends")).alias("ordinal"), (start + F.col("tokens") - last - 1).alias("n_tokens"), F.lit(False).alias("ended"))
    return ended.unionAll(rest.filter("n_tokens > 0"))


def count_tokens(spark: SparkSession, folder: str, end_id: int, width: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Token counts of all documents in the flat files below ``folder``.

    Two ends in a row are a document without tokens. Identifiers after the last end are a document that has not ended;
    a last incomplete identifier is ignored. An empty file has no document.
    """
    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    return stitched(block_summaries(files, end_id, width, block_tokens), block_tokens)


def rows_in_order(docs: DataFrame, key: str) -> DataFrame:
    """(part, ordinal, key): the place at which ``write_token_files`` puts each row of a scan, without reading its text."""
    rows = docs.select(key)
    schema = rows.select(F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("ordinal"), key).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n)), batch.column(0)], names=["part", "ordinal", key])
            at += n

    return rows.mapInArrow(run, schema)


def part_of(file: Column) -> Column:
    """The partition that wrote a file."""
    return F.regexp_extract(file, r"part-(\d+)-[^/]*$", 1).cast("int")


def count_documents(docs: DataFrame, folder: str, path: str, pattern: str, end_id: int, key: str = "doc_id", width: int = 2) -> DataFrame:
    """(key, n_tokens) of a table read from files: writes flat token files below ``folder``, then counts from them alone.

    ``docs`` must be a scan: its rows have the same places each time it is read. Null and empty texts have 0 tokens;
    repeated rows and null keys are counted one by one.
    """
    write_token_files(docs, folder, path, pattern, end_id, width)
    counts = count_tokens(docs.sparkSession, folder, end_id, width).filter("ended").select(part_of(F.col("file")).alias("part"), "ordinal", "n_tokens")
    return rows_in_order(docs, key).join(counts, ["part", "ordinal"]).select(key, "n_tokens")
