"""Partitions and leakage-safe folds of entities."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order_stats import with_position


class LeakageError(AssertionError):
    """An entity is present where it must not be."""


def overlapping_ids(partitions: dict[str, DataFrame], key: str) -> DataFrame:
    """Ids that appear in more than one named partition, with the sorted names."""
    tagged = None
    for name, df in partitions.items():
        part = df.select(key, F.lit(name).alias("partition"))
        tagged = part if tagged is None else tagged.unionByName(part)
    return (
        tagged.groupBy(key)
        .agg(F.array_sort(F.collect_set("partition")).alias("partitions"))
        .filter(F.size("partitions") > 1)
    )


def assert_disjoint(partitions: dict[str, DataFrame], key: str) -> None:
    sample = overlapping_ids(partitions, key).orderBy(key).limit(3).collect()
    if sample:
        raise LeakageError(f"ids in several partitions, e.g. {[(r[key], r['partitions']) for r in sample]}")


def id_counts(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row per id with its rows on both sides (n_left, n_right), by one aggregate and without a join."""
    a = left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r"))
    b = right.select(key, F.lit(0).alias("l"), F.lit(1).alias("r"))
    return a.union(b).groupBy(key).agg(F.sum("l").alias("n_left"), F.sum("r").alias("n_right"))


def uncovered_ids(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Ids on one side only, with the side: empty when both id sets are equal."""
    alone = id_counts(left, right, key).filter("n_left = 0 OR n_right = 0")
    return alone.select(key, F.when(F.col("n_left") > 0, "left").otherwise("right").alias("only_in"))


def assert_same_ids(left: DataFrame, right: DataFrame, key: str) -> None:
    sample = uncovered_ids(left, right, key).orderBy(key).limit(3).collect()
    if sample:
        raise LeakageError(f"id sets differ, e.g. {[tuple(r) for r in sample]}")


def assert_one_row_each(left: DataFrame, right: DataFrame, key: str) -> None:
    """Both sides have the same ids, each once: one pass over the ids for both checks."""
    bad = id_counts(left, right, key).filter("n_left <> 1 OR n_right <> 1")
    sample = bad.orderBy((F.col("n_left") > 0) & (F.col("n_right") > 0), key).limit(3).collect()  # missing ids first
    if any(0 in (r["n_left"], r["n_right"]) for r in sample):
        raise LeakageError(f"id sets differ, e.g. {[(r[key], 'left' if r['n_left'] else 'right') for r in sample if 0 in (r['n_left'], r['n_right'])]}")
    if sample:
        raise LeakageError(f"ids with several rows, e.g. {[(r[key], max(r['n_left'], r['n_right'])) for r in sample]}")


def assert_unique(df: DataFrame, key: str) -> None:
    """Every id has one row."""
    sample = df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").limit(3).collect()
    if sample:
        raise LeakageError(f"ids with several rows, e.g. {[tuple(r) for r in sample]}")


def fixed_partition(cells: DataFrame, train: DataFrame, test: DataFrame, key: str, excluded: DataFrame | None = None) -> DataFrame:
    """Assign 'train' or 'test' from user lists; excluded ids and unlisted cells are dropped."""
    listed = train.select(key, F.lit("train").alias("partition")).unionByName(
        test.select(key, F.lit("test").alias("partition"))
    )
    if excluded is not None:
        listed = listed.join(excluded.select(key), key, "left_anti")
    return cells.join(listed, key)


def restrict(cells: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return cells.join(ids.select(key), key, "left_semi")


def without(cells: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return cells.join(ids.select(key), key, "left_anti")


def stratified_folds(
    cells: DataFrame, key: str, label: str, k: int, seed: Column | int, by: Sequence[str] = (), out: str = "fold"
) -> DataFrame:
    """Folds dealt in shuffled blocks of ``k`` entities that are neighbours by label.

    Each block of the label order (ties by id hash) draws distinct fold ids, so
    every fold spans short, medium and long lives. ``seed`` may be a column
    that is constant within a group of ``by``.
    """
    placed = with_position(cells, by, label, key, "__pos")
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    block = F.floor(F.col("__pos") / k)
    draw = lambda i: F.md5(F.concat_ws(",", seed.cast("string"), block.cast("string"), F.lit(str(i))))
    order = F.sort_array(F.array(*[F.struct(draw(i).alias("h"), F.lit(i).alias("i")) for i in range(k)]))
    return placed.withColumn(out, F.element_at(order, (F.col("__pos") % k + 1).cast("int"))["i"]).drop("__pos")


def repeated_folds(cells: DataFrame, key: str, label: str, k: int, repeats: int, seed: int) -> DataFrame:
    """Independent fold assignments, one per repeat, seeded seed + repeat."""
    rows = cells.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    return stratified_folds(rows, key, label, k, F.lit(seed) + F.col("repeat"), by=["repeat"])


def nested_folds(
    cells: DataFrame, key: str, label: str, k: int, repeats: int, seed: int, inner_seed: int = 10_000
) -> DataFrame:
    """Outer folds per repeat and, for every outer fold, inner folds of its training entities.

    Rows: (repeat, outer_fold, key, label, role, inner_fold); ``role`` is
    'test' for the held-out entities, whose inner fold is missing.
    """
    outer = repeated_folds(cells, key, label, k, repeats, seed).withColumnRenamed("fold", "__own")
    spread = outer.withColumn("outer_fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    test = spread.filter("__own = outer_fold").select(
        "repeat", "outer_fold", key, label, F.lit("test").alias("role"), F.lit(None).cast("int").alias("inner_fold")
    )
    train = spread.filter("__own <> outer_fold").drop("__own")
    inner = stratified_folds(
        train, key, label, k,
        F.lit(inner_seed) + 100 * F.col("repeat") + F.col("outer_fold"),
        by=["repeat", "outer_fold"], out="inner_fold",
    )
    return test.unionByName(
        inner.select("repeat", "outer_fold", key, label, F.lit("train").alias("role"), "inner_fold")
    )


def expand_folds(folds: DataFrame, k: int, fold: str = "fold") -> DataFrame:
    """One row per entity and split: 'val' in its own fold, 'train' in all others."""
    own = F.col(fold)
    return folds.withColumn("split_fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn(
        "role", F.when(F.col("split_fold") == own, "val").otherwise("train")
    )


def coverage_check(rows: DataFrame, by: Sequence[str], key: str) -> DataFrame:
    """Rows and distinct entities per group; both must equal the number of entities."""
    return rows.groupBy(*by).agg(F.count("*").alias("n_rows"), F.countDistinct(key).alias("n_cells"))
