"""Exact order statistics of groups of any size.

Ranks, quantiles, cut-offs and ranking metrics all need the sorted values of a
group. A window over the group would put one hot group into one task, so the
values are first combined to one row per distinct value and then split into
value ranges whose edges come from a hash-selected sample. The edges depend
only on the data (not on task order), and only balance depends on them: every
result is exact.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize

RANGES = 256
FEW_GROUPS = 2000  # groups whose edges (2 kB each) are broadcast


def _join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Null-safe join on ``keys``; without keys ``right`` has exactly one row."""
    if not keys:
        return left.crossJoin(F.broadcast(right))
    right = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    cond = [left[k].eqNullSafe(right[f"__{k}"]) for k in keys]
    return left.join(right, cond, how).drop(*[f"__{k}" for k in keys])


def _with_range(rows: DataFrame, value: str, edges: str, ranges: int) -> DataFrame:
    """Add ``__range``, the number of edges below the value, by bisection.

    One projection per step keeps every step a compiled expression over the
    previous one; a lambda over the array was ten times slower.
    """
    at, step, k = F.lit(0), 1 << (ranges.bit_length() - 1), 0
    while step:
        below = F.get(F.col(edges), at + (step - 1)) < F.col(value)
        rows = rows.withColumn(f"__at{k}", at + F.when(below, step).otherwise(0))
        at, step, k = F.col(f"__at{k}"), step // 2, k + 1
    return rows.withColumnRenamed(f"__at{k - 1}", "__range").drop(edges, *[f"__at{i}" for i in range(k - 1)])


def _edges(rows: DataFrame, by: Sequence[str], value: str, ranges: int) -> tuple[DataFrame, bool]:
    """Range edges per group, and whether the groups are few enough to broadcast tables of them.

    One hash-selected value per slot, combined on the map side. The edges are
    fixed before they are used: up to ``FEW_GROUPS`` groups come to the driver
    (a bounded number of rows), more are written to the checkpoint folder.
    """
    slot = F.pmod(F.xxhash64(F.col(value), F.lit(1)), F.lit(ranges))
    edges = (
        rows.groupBy(*by, slot.alias("__slot"))
        .agg(F.min_by(value, F.xxhash64(F.col(value), F.lit(2))).alias("__v"))  # the hash of one number is one-to-one
        .groupBy(*by).agg(F.sort_array(F.collect_list("__v")).alias("__edges"))
    )
    few = edges.limit(FEW_GROUPS + 1).collect()
    if len(few) <= FEW_GROUPS:
        return F.broadcast(rows.sparkSession.createDataFrame(few, edges.schema)), True
    return materialize(edges), False


def _place(rows: DataFrame, edges: DataFrame, by: Sequence[str], value: str, ranges: int) -> DataFrame:
    return _with_range(_join(rows, edges, by), value, "__edges", ranges)


def _sized(table: DataFrame, few: bool) -> DataFrame:
    """Broadcast a per-group table only when the number of groups was checked."""
    return F.broadcast(table) if few else table


def value_profile(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    weights: dict[str, Column] | None = None,
    bounded: bool = False,
    ranges: int = RANGES,
) -> DataFrame:
    """One row per group and distinct value with counts of the rows before it.

    Columns: ``by``, ``value``, ``n``, ``n_before``, ``n_total`` and, for each
    weight ``w``, the sums ``w``, ``w_before``, ``w_total``. NULL values are
    left out. ``bounded=True`` is for groups whose size has a fixed small bound
    (cycles of one horizon, features of one model): one window does it.
    """
    by, weights = list(by), dict(weights or {})
    names = ["n", *weights]
    rows = df.filter(F.col(value).isNotNull())
    distinct = (
        rows.groupBy(*by, value)
        .agg(F.count("*").alias("n"), *[F.sum(c.cast("double")).alias(k) for k, c in weights.items()])
    )
    if bounded:
        part = Window.partitionBy(*by)
        before = part.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
        return distinct.select(
            "*",
            *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in names],
            *[F.sum(c).over(part).alias(f"{c}_total") for c in names],
        )

    edges, few = _edges(rows, by, value, ranges)
    placed = _place(distinct, edges, by, value, ranges)
    inside = Window.partitionBy(*by, "__range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    local = placed.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"__{c}") for c in names])
    part = Window.partitionBy(*by)  # at most ranges + 1 rows per group from here on
    before = part.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(*by, "__range")
        .agg(*[F.sum(c).alias(c) for c in names])
        .select(
            *by,
            "__range",
            *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_offset") for c in names],
            *[F.sum(c).over(part).alias(f"{c}_total") for c in names],
        )
    )
    return _join(local, _sized(offsets, few), [*by, "__range"]).select(
        *by,
        value,
        *names,
        *[(F.col(f"__{c}") + F.col(f"{c}_offset")).alias(f"{c}_before") for c in names],
        *[f"{c}_total" for c in names],
    )


def at_position(value: Column, before: Column, n: Column, position: Column) -> Column:
    """Aggregate: the value that covers 0-based ``position`` of the sorted group."""
    return F.max(F.when((before <= position) & (position < before + n), value))


def interpolated_quantile(value: Column, before: Column, n: Column, total: Column, q: float) -> Column:
    """Aggregate: linearly interpolated quantile from a profile."""
    h = (total - 1) * F.lit(float(q))
    low, high = F.floor(h), F.ceil(h)
    a, b = at_position(value, before, n, low), at_position(value, before, n, high)
    return a + (b - a) * F.max(h - low)


def quantiles(df: DataFrame, by: Sequence[str], value: str, probs: dict[str, float], bounded: bool = False,
              ranges: int = RANGES) -> DataFrame:
    """Exact interpolated quantiles per group; ``probs`` maps output name to probability.

    Counts per value range tell which ranges hold the wanted positions; only
    the values of those ranges are sorted, so the rows themselves are never
    shuffled as a whole.
    """
    if bounded:
        return df.groupBy(*by).agg(*[F.percentile(value, F.lit(float(q))).alias(k) for k, q in probs.items()])
    by, c = list(by), F.col
    rows = df.select(*by, value).filter(c(value).isNotNull())
    edges, few = _edges(rows, by, value, ranges)
    placed = _place(rows, edges, by, value, ranges)
    part = Window.partitionBy(*by)  # at most ranges + 1 rows per group
    counts = placed.groupBy(*by, "__range").agg(F.count("*").alias("__c")).select(
        *by, "__range", "__c",
        F.coalesce(F.sum("__c").over(part.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__off"),
        F.sum("__c").over(part).alias("n_total"),
    )
    held = F.lit(False)
    for q in probs.values():
        h = (c("n_total") - 1) * F.lit(float(q))
        for position in (F.floor(h), F.ceil(h)):
            held = held | ((c("__off") <= position) & (position < c("__off") + c("__c")))
    wanted = counts.filter(held).drop("__c")
    near = _join(placed, _sized(wanted, few), [*by, "__range"]).groupBy(*by, "__range", "__off", "n_total", value).agg(F.count("*").alias("n"))
    inside = Window.partitionBy(*by, "__range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    p = near.withColumn("n_before", c("__off") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return p.groupBy(*by).agg(
        *[interpolated_quantile(c(value), c("n_before"), c("n"), c("n_total"), q).alias(k) for k, q in probs.items()]
    )


def with_average_rank(
    df: DataFrame, by: Sequence[str], value: str, out: str, descending: bool = False, bounded: bool = False
) -> DataFrame:
    """Add the rank of ``value`` in its group; equal values share the mean of their ranks."""
    if bounded:
        w = Window.partitionBy(*by)
        order = F.col(value).desc() if descending else F.col(value).asc()
        ties = Window.partitionBy(*by, value)
        rank = F.rank().over(w.orderBy(order)) + (F.count("*").over(ties) - 1) / 2
        return df.withColumn(out, F.when(F.col(value).isNotNull(), rank))
    p = value_profile(df, by, value)
    low = F.col("n_total") - F.col("n_before") - F.col("n") if descending else F.col("n_before")
    ranks = p.select(*by, value, (low + (F.col("n") + 1) / 2).alias(out))
    return _join(df, ranks, [*by, value], "left")


def with_position(df: DataFrame, by: Sequence[str], value: str, key: str, out: str) -> DataFrame:
    """Add the 0-based position of each row in the order (value, md5(key), key) of its group. Rows without a value are left out.

    Ranges are cut in the order of (value, first digits of the hash), so even
    one value shared by most rows is ordered by many tasks, and a row is
    shuffled once.
    """
    by = list(by)
    rows = df.filter(F.col(value).isNotNull()).withColumn("__h", F.md5(F.col(key).cast("string")))
    rows = rows.withColumn("__s", F.struct(F.col(value).alias("v"), F.substring("__h", 1, 8).alias("h")))
    edges, few = _edges(rows, by, "__s", RANGES)
    placed = _place(rows, edges, by, "__s", RANGES).drop("__s")
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # at most RANGES + 1 rows
    offsets = (
        placed.groupBy(*by, "__range").agg(F.count("*").alias("__c"))
        .select(*by, "__range", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__off"))
    )
    numbered = placed.withColumn("__rn", F.row_number().over(Window.partitionBy(*by, "__range").orderBy(value, "__h", key)) - 1)
    return (
        _join(numbered, _sized(offsets, few), [*by, "__range"])
        .withColumn(out, (F.col("__off") + F.col("__rn")).cast("long"))
        .drop("__h", "__range", "__off", "__rn")
    )


def with_hash_index(df: DataFrame, by: Sequence[str], key: str, out: str, total: str | None = None) -> DataFrame:
    """Add a dense 0-based index per group in the order (md5(key), key), and optionally the group size."""
    by = list(by)
    rows = df.withColumn("__h", F.md5(F.col(key).cast("string"))).withColumn("__px", F.substring("__h", 1, 3))
    part = Window.partitionBy(*by)
    before = part.orderBy("__px").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(*by, "__px").agg(F.count("*").alias("__c"))
        .select(
            *by, "__px",
            F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__off"),
            *([F.sum("__c").over(part).alias(total)] if total else []),
        )
    )
    numbered = rows.withColumn("__rn", F.row_number().over(Window.partitionBy(*by, "__px").orderBy("__h", key)) - 1)
    return (
        _join(numbered, offsets, [*by, "__px"])
        .withColumn(out, (F.col("__off") + F.col("__rn")).cast("long"))
        .drop("__h", "__px", "__off", "__rn")
    )


def with_sequence_position(df: DataFrame, by: Sequence[str], order: str, out: str, width: int = 1 << 20) -> DataFrame:
    """Add the 0-based position of each row in the order of a unique integer column.

    Rows are numbered inside blocks of ``width`` consecutive order values, so a
    group of any length is numbered by many tasks of at most ``width`` rows.
    """
    by = list(by)
    rows = df.withColumn("__block", F.floor(F.col(order) / width))
    before = Window.partitionBy(*by).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(*by, "__block").agg(F.count("*").alias("__c"))
        .select(*by, "__block", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__off"))
    )
    numbered = rows.withColumn("__rn", F.row_number().over(Window.partitionBy(*by, "__block").orderBy(order)) - 1)
    return (
        _join(numbered, offsets, [*by, "__block"])
        .withColumn(out, (F.col("__off") + F.col("__rn")).cast("long"))
        .drop("__block", "__off", "__rn")
    )


def roc_auc(df: DataFrame, by: Sequence[str], score: str, flag: str) -> DataFrame:
    """Area under the ROC curve per group; NULL when a class is missing."""
    p = value_profile(df, by, score, {"pos": F.col(flag).cast("int")})
    neg, neg_before = F.col("n") - F.col("pos"), F.col("n_before") - F.col("pos_before")
    neg_total = F.max("n_total") - F.max("pos_total")
    wins = F.sum(F.col("pos") * (neg_before + neg / 2))
    return p.groupBy(*by).agg(F.try_divide(wins, F.max("pos_total") * neg_total).alias("roc_auc"))


def average_precision(df: DataFrame, by: Sequence[str], score: str, flag: str) -> DataFrame:
    """Sum of recall steps times precision over distinct scores, from the highest score down."""
    p = value_profile(df, by, score, {"pos": F.col(flag).cast("int")})
    tp = F.col("pos_total") - F.col("pos_before")
    flagged = F.col("n_total") - F.col("n_before")
    steps = F.sum(F.col("pos") * tp / flagged)
    return p.groupBy(*by).agg(F.try_divide(steps, F.max("pos_total")).alias("average_precision"))


def levels(values: Sequence[float]) -> Column:
    """One row per requested level (recall target, alpha, ...)."""
    return F.explode(F.array(*[F.lit(float(v)) for v in values]))


def recall_cutoff(df: DataFrame, by: Sequence[str], score: str, flag: str, targets: Sequence[float]) -> DataFrame:
    """Smallest score c whose share of positives with score <= c reaches the target, else the largest score."""
    p = value_profile(df, by, score, {"pos": F.col(flag).cast("int")})
    share = F.try_divide(F.col("pos_before") + F.col("pos"), F.col("pos_total"))
    return (
        p.withColumn("recall_target", levels(targets))
        .groupBy(*by, "recall_target")
        .agg(F.coalesce(F.min(F.when(share >= F.col("recall_target"), F.col(score))), F.max(score)).alias("cutoff"))
    )


def conformal_quantile(df: DataFrame, by: Sequence[str], score: str, alphas: Sequence[float]) -> DataFrame:
    """The ceil((n+1)(1-alpha))-th smallest score, +infinity when n is too small.

    A group without any score has no row; the caller reads that as +infinity.
    """
    p = value_profile(df, by, score)
    k = F.ceil((F.col("n_total") + 1) * (F.lit(1.0) - F.col("alpha")))
    hit = at_position(F.col(score), F.col("n_before"), F.col("n"), k - 1)
    return (
        p.withColumn("alpha", levels(alphas))
        .groupBy(*by, "alpha")
        .agg(F.coalesce(hit, F.lit(float("inf"))).alias("q"))
    )


def _pair_groups(rows: DataFrame, by: Sequence[str], x: str, y: str, ranges: int) -> tuple[DataFrame, bool]:
    """One row per group: its number ``__pair_group`` and sorted edges of both values, and whether the groups are few enough to broadcast.

    Edges are the values of one hash-selected pair per slot, so a value of
    many different pairs is nearly surely one of them.
    """
    slot, h = F.pmod(F.xxhash64(F.col(x), F.col(y), F.lit(1)), F.lit(ranges)), F.xxhash64(F.col(x), F.col(y), F.lit(2))
    found = rows.groupBy(*by, slot.alias("__slot")).agg(F.min_by(x, h).alias("__vx"), F.min_by(y, h).alias("__vy")).groupBy(*by).agg(
        F.sort_array(F.collect_set("__vx")).alias("__ex"), F.sort_array(F.collect_set("__vy")).alias("__ey")
    )
    few = found.limit(FEW_GROUPS + 1).collect()
    if len(few) > FEW_GROUPS:
        return materialize(found).withColumn("__pair_group", F.monotonically_increasing_id()), False
    schema = T.StructType([*found.schema.fields, T.StructField("__pair_group", T.LongType())])
    return rows.sparkSession.createDataFrame([(*r, i) for i, r in enumerate(few)], schema), True


def _with_cell(rows: DataFrame, groups: DataFrame, value: str, edges: str, other: str, few: bool, ranges: int) -> DataFrame:
    """Add ``__cell``, the number of the value's range in its group, and ``__salt``.

    A range is either one edge (odd numbers), whose rows share one rank and go
    to many tasks, or what lies between two edges (even numbers).
    """
    placed = _join(rows, _sized(groups.select("__pair_group", edges), few), ["__pair_group"])  # null-safe, like all joins here: no
    placed = _with_range(placed.withColumn("__e", F.col(edges)), value, "__e", ranges)  # filter then holds a copy of the bisection
    is_edge = F.coalesce(F.get(edges, F.col("__range")) == F.col(value), F.lit(False))
    cell = F.col("__pair_group") * (2 * ranges + 2) + 2 * F.col("__range") + is_edge.cast("int")
    return placed.select(*rows.columns, cell.alias("__cell"), F.when(is_edge, F.pmod(F.xxhash64(other), F.lit(ranges))).otherwise(0).alias("__salt"))


def _with_centred_rank(rows: DataFrame, pairs: DataFrame, groups: DataFrame, value: str, edges: str, other: str, out: str, few: bool, ranges: int) -> DataFrame:
    """Add the average rank of ``value`` among the weighted (``__n``) rows of its group, less the mean rank, by one shuffle of the rows.

    The sizes of the ranges come from ``pairs``, whose exchange is read again.
    """
    n, c = F.col("__n"), F.col
    whole = Window.partitionBy("__pair_group")  # at most 2 * ranges + 1 rows
    sizes = _with_cell(pairs, groups, value, edges, other, few, ranges).groupBy("__pair_group", "__cell").agg(F.sum(n).alias("__c")).select(
        "__cell", "__c", F.sum("__c").over(whole).alias("__total"),
        F.coalesce(F.sum("__c").over(whole.orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__off"),
    )
    placed = _with_cell(rows, groups, value, edges, other, few, ranges)
    up_to = F.sum(n).over(Window.partitionBy("__cell", "__salt").orderBy(value).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    ties = F.sum(n).over(Window.partitionBy("__cell", "__salt", value))
    ranked = _join(placed.select("*", up_to.alias("__le"), ties.alias("__t")), _sized(sizes, few), ["__cell"])
    one = c("__cell") % 2 == 1
    below, tied = F.when(one, 0).otherwise(c("__le") - c("__t")), F.when(one, c("__c")).otherwise(c("__t"))
    return ranked.select(*rows.columns, (c("__off") + below + (tied + 1) / 2 - (c("__total") + 1) / 2).alias(out))


def rank_correlation(df: DataFrame, by: Sequence[str], x: str, y: str, ranges: int = RANGES) -> DataFrame:
    """Per group, over rows where both values exist: rank correlation ``rho``, ``n_pairs``, and the smallest and largest x.

    Equal pairs of values are combined on the map side and become one row; a
    pair is shuffled once as such and once for each of its two ranks. The mean
    of average ranks is known, so the sums are taken around it.
    """
    by = list(by)
    rows = df.select(*by, x, y).filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    groups, few = _pair_groups(rows, by, x, y, ranges)
    pairs = _join(rows, _sized(groups.select(*by, "__pair_group"), few), by).groupBy("__pair_group", x, y).agg(F.count("*").alias("__n"))
    placed = _with_centred_rank(pairs, pairs, groups, x, "__ex", y, "__rx", few, ranges)
    placed = _with_centred_rank(placed, pairs, groups, y, "__ey", x, "__ry", few, ranges)
    w, a, b = F.col("__n"), F.col("__rx"), F.col("__ry")
    norm = F.sqrt(F.sum(w * a * a)) * F.sqrt(F.sum(w * b * b))
    out = placed.groupBy("__pair_group").agg(
        F.try_divide(F.sum(w * a * b), norm).alias("rho"), F.sum(w).alias("n_pairs"), F.min(x).alias("min_x"), F.max(x).alias("max_x")
    )
    return out.join(_sized(groups.select(*by, "__pair_group"), few), "__pair_group").drop("__pair_group").select(*by, "rho", "n_pairs", "min_x", "max_x")


def spearman(df: DataFrame, by: Sequence[str], x: str, y: str, out: str = "spearman") -> DataFrame:
    """Rank correlation per group over rows where both values exist, and their number ``n_pairs``."""
    return rank_correlation(df, by, x, y).select(*by, F.col("rho").alias(out), "n_pairs")
