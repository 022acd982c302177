import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from fadewatch.operators import linear as li
from fadewatch.operators import logistic as lg


@pytest.fixture(scope="module")
def fleet(spark):
    rng = np.random.default_rng(11)
    x, e, f = rng.standard_normal((3000, 3)), rng.logistic(size=3000), rng.integers(0, 3, 3000)
    x[::13, 1] = np.nan
    flag = 2 * x[:, 0] + np.nan_to_num(x[:, 1]) + e > 0.4
    rows = [(i, int(f[i]), bool(flag[i]), 600.0 + i % 7, *(None if np.isnan(v) else float(v) for v in x[i])) for i in range(3000)]
    df = spark.createDataFrame(rows, "cell_id int, fold int, flag boolean, y double, a double, b double, c double")
    return df, li.prepare(li.training_sets(df, "fold", 3), ["a", "b", "c"], "y")


def test_folds_and_penalties_start_from_one_solved_problem(spark, fleet, monkeypatch):
    df, prep = fleet
    seen, sums = [], lg._sums
    monkeypatch.setattr(lg, "_sums", lambda rows, n, problems, *more: seen.append(len(problems)) or sums(rows, n, problems, *more))
    problems = lg.fit(df, ["a", "b", "c"], "flag", prep, [0.1, 1.0, 10.0], "fold")
    assert len(problems) == 12 and sum(seen) < 72  # from zeros 83: all took part in each of 7 passes, but one in the last
    assert max(p.gradient for p in problems) < 1e-8


def test_both_weightings_in_one_fit_equal_two_fits(spark, fleet):
    df, prep = fleet
    together = lg.fit(df, ["a", "b", "c"], "flag", prep, [0.1, 10.0], "fold", balanced=(False, True))
    for way in (False, True):
        alone = lg.fit(df, ["a", "b", "c"], "flag", prep, [0.1, 10.0], "fold", balanced=way)
        mine = [p for p in together if p.balanced == way]
        assert [(p.split, p.c) for p in mine] == [(p.split, p.c) for p in alone]
        for p, q in zip(mine, alone, strict=True):
            np.testing.assert_allclose(p.coef, q.coef, atol=1e-9)


def test_means_added_up_in_tasks_equal_means_of_predictions(spark, fleet):
    df, prep = fleet
    packed = lg.pack(df, ["a", "b", "c"], "flag", "fold")
    problems = lg.solve(packed, 3, prep, [0.1, 10.0])
    got = {(r.split, r.C, r.flag): (r.n, r.p_fail) for r in lg.training_means(packed, 3, problems, prep).collect()}
    p = lg.predict(li.training_rows(df, "fold", 3), F.col("split"), ["a", "b", "c"], problems, prep, ["split", "flag", "cell_id"])
    want = p.groupBy("split", "C", "flag").agg(F.count("*").alias("n"), F.countDistinct("cell_id").alias("ids"), F.avg("p_fail").alias("p")).collect()
    assert len(got) == len(want) == 4 * 2 * 2
    for r in want:
        assert r.n == r.ids and got[r.split, r.C, r.flag] == (r.n, pytest.approx(r.p, abs=1e-12))
    # a row of a split without models has no prediction; the others have those of the formula
    one = next(q for q in problems if q.split == "final" and q.c == 10.0)
    some = lg.predict(df, F.when(F.col("cell_id") < 50, "final").otherwise("none"), ["a", "b", "c"], [one], prep, ["cell_id", "a", "b", "c"]).collect()
    s = prep["final"]
    assert sorted(r.cell_id for r in some) == list(range(50))
    for r in some:
        x = np.array([m if v is None else min(max(v, lo), hi) for v, lo, hi, m in zip(r[1:4], s.low, s.high, s.median)])
        assert r.p_fail == pytest.approx(1 / (1 + np.exp(-one.coef[0] - one.coef[1:] @ ((x - s.mean) / s.std))))


def test_packed_rows_are_small_and_whole(spark, fleet):
    df, _ = fleet
    packed = lg.pack(df.withColumn("fold", F.when(F.col("cell_id") != 8, F.col("fold"))), ["a", "b", "c"], "flag", "fold")
    rows = packed.collect()
    assert sum(r.n for r in rows) == 3000 and max(len(r.block) for r in rows) <= lg.BLOCK and {r.f for r in rows} == {"0", "1", "2", None}
    values = np.concatenate([np.frombuffer(r.block).reshape(r.n, 4) for r in rows])
    assert values[:, 0].sum() == sum(r.pos for r in rows) == df.filter("flag").count()
    assert np.nansum(values[:, 1:]) == pytest.approx(sum(df.agg(F.sum("a"), F.sum("b"), F.sum("c")).first()))
    # the row without a fold is in the final training set alone
    prep = li.Prepared(np.full(3, -9.0), np.full(3, 9.0), np.zeros(3), 1, np.zeros(3), np.ones(3), 0, 1, None, None)
    problems = [lg.Problem(s, 1.0, "", None if s == "final" else s, np.zeros(4)) for s in ("0", "1", "2", "final")]
    n = {r.split: r.n for r in lg.training_means(packed, 3, problems, {p.split: prep for p in problems}).groupBy("split").agg(F.sum("n").alias("n")).collect()}
    assert n["final"] == 3000 and n["0"] + n["1"] + n["2"] == 2 * 2999


def test_code_of_predictions_is_small_enough_to_be_compiled(spark):
    """HotSpot leaves methods of more than 8,000 bytes to its interpreter, 20 times slower."""
    names = [f"x{k}" for k in range(12)]
    df = spark.range(5).select(F.col("id").alias("cell_id"), (F.col("id") % 2 == 0).alias("flag"), *[F.col("id").cast("double").alias(x) for x in names])
    prep = li.Prepared(np.zeros(12), np.ones(12), np.zeros(12), 1, np.zeros(12), np.ones(12), 0, 1, None, None)
    p = lg.predict(df, F.lit("final"), names, [lg.Problem("final", 1.0, "", None, np.ones(13))], {"final": prep}, ["flag"])
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = p.groupBy("C", "flag").agg(F.avg("p_fail"))._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", debug.codegenString(plan))]
    assert sizes and max(sizes) < 8000
