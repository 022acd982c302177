"""Shards of bounded size by extendible hashing: a directory over hash-prefix bits in which only oversized buckets split."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import staged

#: Bits of the content hash, then as many of a number that tells repeated rows apart.
WORD_BITS = 60
#: Bits that the directory gains beyond the even split, and in each later round.
MORE_BITS = 4


def content_bits(*columns: str) -> Column:
    """60 bits of MD5 over the columns as text; the same rows have the same bits in every run."""
    text = F.concat_ws(":", *[F.md5(F.col(c).cast("string").cast("binary")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def _directory(rows: DataFrame, base: int, depth: int, limit: int) -> DataFrame:
    """One row for each prefix of ``depth`` bits: the least depth from ``base`` on at which its bucket fits, else null.

    Sizes are summed by the finest prefix first; the sums of the shorter prefixes come from these sums alone.
    """
    fine = rows.groupBy("above", F.expr(f"shiftright(bits, {WORD_BITS - depth})").alias("prefix")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("rows"))
    fine = staged(fine)
    levels = fine.select("*", F.explode(F.sequence(F.lit(base), F.lit(depth))).alias("level")).withColumn("bucket", F.expr(f"shiftright(prefix, {depth} - level)"))
    sums = levels.groupBy("above", "level", "bucket").agg(F.sum("bytes").alias("sum_bytes"), F.sum("rows").alias("sum_rows"))
    fits = sums.filter((F.col("sum_bytes") <= limit) | (F.col("sum_rows") == 1)).select("above", "level", "bucket")
    found = levels.select("above", "level", "bucket", "prefix").join(fits, ["above", "level", "bucket"]).groupBy("above", "prefix").agg(F.min("level").alias("depth"))
    return fine.select("above", "prefix").join(found, ["above", "prefix"], "left")


def assign_shards(df: DataFrame, limit: int, size: Column, identity: list[str], carry: list[str] | None = None) -> DataFrame:
    """``identity`` and ``carry`` columns, bytes, shard (its bits as text), depth for each row of ``df``.

    A bucket splits on its next bit while it holds more than ``limit`` bytes in more than one row, so every shard holds at
    most ``limit`` bytes, but for a single larger row. Bits come from the content of ``identity``; rows that agree in it
    split on further bits from a number of their own, so repeated rows and null keys do not make a shard too large.
    A null size counts as 0 bytes. An empty table gives no shard. ``df`` needs no other column; clashing names are unused,
    and refused in ``identity`` and ``carry``. ``carry`` takes the columns along that ``write_shards`` is to write.
    """
    columns = list(dict.fromkeys([*identity, *(carry or [])]))
    clash = {"bytes", "shard", "depth"} & {c.lower() for c in columns}
    if clash:
        raise ValueError(f"columns named as those of the assignment: {sorted(clash)}")
    rows = df.select(*columns, F.coalesce(size, F.lit(0)).cast("bigint").alias("_bytes"), content_bits(*identity).alias("_first"))
    rows = rows.withColumn("_second", F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 64 - WORD_BITS))
    return shards_of(staged(rows.select(F.struct(*columns).alias("row"), F.col("_bytes").alias("bytes"), F.col("_first").alias("first"), F.col("_second").alias("second"))), limit).select(
        "row.*", "bytes", "shard", "depth")


def shards_of(rows: DataFrame, limit: int) -> DataFrame:
    """Split rows (row, bytes, first, second) round by round; each round reads only what no bucket has taken yet."""
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    depth = min(WORD_BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + MORE_BITS)
    open_rows, done = rows.withColumns({"above": F.lit(0).cast("bigint"), "bits": F.col("first")}), []
    base, word = 0, 1
    while True:
        directory = staged(_directory(open_rows, base, depth, limit))
        placed = open_rows.withColumn("prefix", F.expr(f"shiftright(bits, {WORD_BITS - depth})")).join(directory, ["above", "prefix"])
        more = not directory.filter(F.col("depth").isNull()).isEmpty()
        last = word == 2 and depth == WORD_BITS
        if last:  # the same bits throughout: these rows stay together
            placed = placed.withColumn("depth", F.coalesce("depth", F.lit(WORD_BITS)))
        name = F.expr(f"lpad(bin(shiftright(bits, {WORD_BITS} - depth)), depth, '0')")
        if word == 2:
            name = F.concat(F.lpad(F.bin("first"), WORD_BITS, "0"), name)
        taken = placed.filter(F.col("depth").isNotNull())
        done.append(taken.select("row", "bytes", name.alias("shard"), (F.col("depth") + WORD_BITS * (word - 1)).alias("depth")))
        if not more or last:
            break
        open_rows = staged(placed.filter(F.col("depth").isNull()).select("row", "bytes", "first", "second", "above", "bits"))
        base = depth + 1
        if depth == WORD_BITS:
            word, base, depth = 2, 1, 0
            open_rows = open_rows.withColumns({"above": F.col("first"), "bits": F.col("second")})
        depth = min(WORD_BITS, depth + 2 * MORE_BITS)
    out = done[0]
    for part in done[1:]:
        out = out.unionAll(part)
    return out


def write_shards(df: DataFrame, shards: DataFrame, keys: list[str], path: str) -> None:
    """Write the rows of ``df`` below ``path``, one folder ``shard=b<bits>`` for each shard; a task writes whole shards, each of bounded size.

    ``shards`` is the assignment of ``df`` and has all its columns (``carry``): its rows are written as they are, with no
    join back, so rows with null or repeated ``keys`` are written once each and in the shard that counted them.
    """
    missing = [c for c in dict.fromkeys([*keys, *df.columns]) if c not in shards.columns]
    if missing:
        raise ValueError(f"the assignment does not carry {missing}")
    shards.select(*df.columns, F.concat(F.lit("b"), "shard").alias("shard")).repartition("shard").sortWithinPartitions("shard").write.partitionBy("shard").parquet(path)
