"""Alarms, conformal fail/pass sets and test-stopping policies over long prediction tables."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import ratio
from .order_stats import conformal_quantile, levels, recall_cutoff
from .resampling import bootstrap_interval, weighted_sums


def policy_table(spark: SparkSession, policies: Mapping[str, Sequence[int]]) -> DataFrame:
    """One row per policy and checkpoint, from a map of policy names to checkpoint lists."""
    rows = [(k, sorted(int(t) for t in v)) for k, v in policies.items()]
    return spark.createDataFrame(rows, "policy string, checkpoints array<int>").withColumn("T", F.explode("checkpoints"))


def early_failure(life: Column | str, threshold: Column | float) -> Column:
    life = F.col(life) if isinstance(life, str) else life
    return life <= (threshold if isinstance(threshold, Column) else F.lit(float(threshold)))


def apply_cutoff(scores: DataFrame, cutoffs: DataFrame, by: Sequence[str], score: str) -> DataFrame:
    """Alarm when the score is at or below the cutoff of its group and recall target."""
    rows = scores.crossJoin(F.broadcast(cutoffs)) if not by else scores.join(cutoffs, list(by))
    return rows.withColumn("alarm", F.col(score) <= F.col("cutoff"))


def alarms_by_recall(oof: DataFrame, test: DataFrame, by: Sequence[str], score: str, flag: str, targets: Sequence[float]) -> DataFrame:
    """Cutoffs set on out-of-fold scores, applied to the test scores, per recall target."""
    return apply_cutoff(test, recall_cutoff(oof, by, score, flag, targets), by, score)


def life_intervals(oof: DataFrame, test: DataFrame, by: Sequence[str], y: str, p: str, alphas: Sequence[float]) -> DataFrame:
    """Interval exp(ln p -+ q) with q the conformal quantile of |ln y - ln p| out of fold."""
    s = oof.withColumn("__s", F.abs(F.log(F.col(p)) - F.log(F.col(y))))
    q = conformal_quantile(s, by, "__s", alphas)
    rows = test.crossJoin(F.broadcast(q)) if not by else test.join(q, list(by))
    return rows.withColumns({"lo": F.col(p) * F.exp(-F.col("q")), "hi": F.col(p) * F.exp(F.col("q"))})


def fail_pass_sets(oof: DataFrame, test: DataFrame, by: Sequence[str], p: str, flag: str, alphas: Sequence[float]) -> DataFrame:
    """Class-conditional conformal sets per alpha: is 'fail' / 'pass' in the set of each test case."""
    f = F.col(flag).cast("boolean")
    inf = F.lit(float("inf"))
    tables = []
    for name, rows, score in (("q_fail", oof.filter(f), 1 - F.col(p)), ("q_pass", oof.filter(~f), F.col(p))):
        tables.append(conformal_quantile(rows.withColumn("__s", score), by, "__s", alphas).withColumnRenamed("q", name))
    rows = test.withColumn("alpha", levels(alphas))
    for q in tables:
        rows = rows.join(q, [*by, "alpha"], "left")
    return rows.withColumns(
        {
            "q_fail": F.coalesce("q_fail", inf),
            "q_pass": F.coalesce("q_pass", inf),
            "fail_in_set": (1 - F.col(p)) <= F.coalesce("q_fail", inf),
            "pass_in_set": F.col(p) <= F.coalesce("q_pass", inf),
        }
    )


def stop_decisions(sets: DataFrame, policies: DataFrame, by: Sequence[str] = (), key: str = "cell_id") -> DataFrame:
    """First checkpoint with a one-label set decides; undecided entities run to their end of life.

    ``sets``: (by..., key, T, y_true, early_failure, alpha, fail_in_set,
    pass_in_set). One aggregate per entity and policy, combined on the map side.
    """
    fs, ps = F.col("fail_in_set"), F.col("pass_in_set")
    hit = F.when(fs != ps, F.struct(F.col("T").alias("T"), F.when(fs, "FAIL").otherwise("PASS").alias("d")))
    g = (
        sets.join(F.broadcast(policies.select("policy", "T")), "T")
        .groupBy(*by, "policy", "alpha", key)
        .agg(F.max("y_true").alias("true_life"), F.max("early_failure").alias("early_failure"), F.min(hit).alias("__hit"))
    )
    truth = F.when(F.col("early_failure"), "FAIL").otherwise("PASS")
    return g.select(
        *by, "policy", "alpha", key, "true_life", "early_failure",
        F.coalesce(F.col("__hit.d"), truth).alias("decision"),
        F.coalesce(F.col("__hit.T").cast("double"), F.col("true_life")).alias("stopped_at_cycle"),
        F.col("__hit").isNotNull().alias("decided_early"),
    ).withColumn("correct", (F.col("decision") == "FAIL") == F.col("early_failure"))


def _counted() -> dict[str, Column]:
    """What policy measures sum over decisions."""
    f = F.col("early_failure")
    flags = {
        "early": F.col("decided_early"), "wrong": ~F.col("correct"), "fails": f,
        "miss": (F.col("decision") == "PASS") & f, "false": (F.col("decision") == "FAIL") & ~f,
    }
    return {"stop": F.col("stopped_at_cycle"), "life": F.col("true_life")} | {k: c.cast("int") for k, c in flags.items()}


def _measures(w: Column, scale: Column) -> dict[str, Column]:
    """Policy measures from the sums of ``w`` decisions; ``scale`` brings counts of a resample to the size of the data."""
    per = lambda a, b: F.try_divide(F.col(a).cast("double"), b.cast("double"))
    count = lambda c: (c * scale).cast("double")
    fails = F.col("fails")
    return {
        "avg_test_cycles": per("stop", w),
        "full_test_cycles": per("life", w),
        "test_time_saved": F.lit(1.0) - per("stop", F.col("life")),
        "decided_early": per("early", w),
        "wrong_decisions": per("wrong", w),
        "missed_failures": count(F.col("miss")),
        "false_failures": count(F.col("false")),
        "false_alarm_rate": per("false", F.greatest(w - fails, F.lit(1))),
        "missed_failure_rate": per("miss", F.greatest(fails, F.lit(1))),
        "n_cells": count(w),
        "n_failures": count(fails),
    }


# Names of the policy measures.
SUMMARY_NAMES = [
    "avg_test_cycles", "full_test_cycles", "test_time_saved", "decided_early", "wrong_decisions", "missed_failures",
    "false_failures", "false_alarm_rate", "missed_failure_rate", "n_cells", "n_failures",
]


def policy_summary(decisions: DataFrame, by: Sequence[str] = (), repeat: str | None = None) -> DataFrame:
    """Measures per policy and alpha; with ``repeat``, their mean over repeats."""
    group = [*by, "policy", "alpha"]
    inner = [*group, *([repeat] if repeat else [])]
    sums = decisions.groupBy(*inner).agg(F.count("*").alias("w"), *[F.sum(c).alias(k) for k, c in _counted().items()])
    one = sums.select(*inner, *[e.alias(k) for k, e in _measures(F.col("w"), F.lit(1)).items()])
    return one.groupBy(*group).agg(*[F.avg(k).alias(k) for k in SUMMARY_NAMES]) if repeat else one


def policy_summary_ci(decisions: DataFrame, by: Sequence[str] = (), key: str = "cell_id", repeat: str = "repeat",
                      n_boot: int = 1000, seed: int = 3) -> DataFrame:
    """Long table (policy, alpha, metric, mean, lo, hi) with an entity bootstrap of the repeat-averaged measures."""
    group = [*by, "policy", "alpha"]
    names = SUMMARY_NAMES
    entries = lambda: F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("value")) for k in names]))
    mean = policy_summary(decisions, by, repeat).select(*group, entries().alias("m")).select(*group, "m.metric", F.col("m.value").alias("mean"))
    sums = weighted_sums(decisions, [*group, repeat], key, _counted(), n_boot, seed)
    boots = (
        sums.select("b", *group, *[e.alias(k) for k, e in _measures(F.col("w"), F.try_divide("n", "w")).items()])
        .groupBy("b", *group).agg(*[F.avg(k).alias(k) for k in names])
        .select(*group, entries().alias("m")).select(*group, "m.metric", "m.value")
    )
    return mean.join(bootstrap_interval(boots, [*group, "metric"], "value"), [*group, "metric"])


def share_decided(decisions: DataFrame, policies: DataFrame, by: Sequence[str] = (), repeat: str | None = None) -> DataFrame:
    """Share of entities decided by each checkpoint of their policy."""
    rows = decisions.join(F.broadcast(policies.select("policy", F.col("T").alias("checkpoint"))), "policy")
    done = (F.col("decided_early") & (F.col("stopped_at_cycle") <= F.col("checkpoint"))).cast("double")
    group = [*by, "policy", "alpha", "checkpoint"]
    if repeat:
        return rows.groupBy(*group, repeat).agg(F.avg(done).alias("s")).groupBy(*group).agg(F.avg("s").alias("cum_share_decided"))
    return rows.groupBy(*group).agg(F.avg(done).alias("cum_share_decided"))


def outcome(alarm: Column | str, truth: Column | str) -> Column:
    a = (F.col(alarm) if isinstance(alarm, str) else alarm).cast("boolean")
    t = (F.col(truth) if isinstance(truth, str) else truth).cast("boolean")
    return F.when(a & t, "true alarm").when(a, "false alarm").when(t, "missed failure").otherwise("correctly not flagged")


def forced_alarms(operating_points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Yes/no alarm table from operating points (T, recall_target, recall, false_alarm_rate [, fa_lo, fa_hi])."""
    extra = [c for c in ("fa_lo", "fa_hi") if c in operating_points.columns]
    return operating_points.select(
        *by, F.concat(F.lit("forced_alarm_"), F.col("T").cast("string")).alias("policy"), "recall_target",
        "false_alarm_rate", *extra, (1 - F.col("recall")).alias("missed_failure_rate"),
    )


def protocol_lookup(cells: DataFrame, key: str, protocol: str, life: str, partition: str = "partition") -> DataFrame:
    """Test entities with the mean training life of their protocol and whether it was seen in training."""
    train = cells.filter(F.col(partition) == "train").groupBy(protocol).agg(F.avg(life).alias("lookup_life"))
    test = cells.filter(F.col(partition) == "test")
    return test.join(train, protocol, "left").withColumn("seen", F.col("lookup_life").isNotNull())


def seen_unseen_errors(preds: DataFrame, by: Sequence[str], y: str, p: str, seen: str = "seen", limit: float = 1100.0) -> DataFrame:
    """Errors on seen and unseen protocols, with all entities and with lives up to ``limit`` only."""
    base = F.when(F.col(seen), "seen").otherwise("unseen")
    groups = F.array_compact(
        F.array(base, F.when(F.col(y) <= limit, F.concat(base, F.lit(f"_life<={limit:g}"))))
    )
    e = F.col(p) - F.col(y)
    rows = preds.filter(F.col(p).isNotNull()).withColumn("group", F.explode(groups))
    return rows.groupBy(*by, "group").agg(
        F.count("*").alias("n"), F.avg(y).alias("mean_life"), F.avg(F.abs(e)).alias("MAE"), F.sqrt(F.avg(e * e)).alias("RMSE"),
        (100 * F.avg(ratio(F.abs(e), F.col(y)))).alias("MAPE_pct"),
    )
