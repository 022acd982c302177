"""Order statistics against brute force (hot groups, ties), folds, resampling and metrics."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from fadewatch.operators import metrics as mt
from fadewatch.operators import order_stats as os_
from fadewatch.operators import splits as sp


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most rows, and one value holds a third of it."""
    rng = np.random.default_rng(0)
    rows = []
    for g, n in (("hot", 3000), ("small", 40), ("one", 1)):
        x = np.round(rng.normal(size=n), 3)
        x[: n // 3] = 0.125
        flag = rng.random(n) < 0.2
        flag[0] = True
        rows += [(g, i, float(v), bool(f)) for i, (v, f) in enumerate(zip(x, flag))]
    rows += [(None, 1, 5.0, True), ("small", 999, None, False)]
    return spark.createDataFrame(rows, "g string, id long, x double, f boolean").repartition(6).cache()


def groups(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.g, []).append(r)
    return out


def avg_rank(x):
    return np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])


@pytest.mark.parametrize("ranges", [1, 7, 64])
def test_profile_counts(spark, skewed, ranges):
    got = groups(os_.value_profile(skewed, ["g"], "x", {"pos": F.col("f").cast("int")}, ranges=ranges))
    for g, rows in groups(skewed).items():
        x = np.array([r.x for r in rows if r.x is not None])
        f = np.array([r.f for r in rows if r.x is not None])
        assert len(got[g]) == len(np.unique(x))
        for r in got[g][:: max(1, len(got[g]) // 50)]:
            assert (r.n, r.n_before, r.n_total) == ((x == r.x).sum(), (x < r.x).sum(), len(x))
            assert (r.pos, r.pos_before, r.pos_total) == (f[x == r.x].sum(), f[x < r.x].sum(), f.sum())


@pytest.mark.parametrize("few", [2000, 1])
def test_quantiles_exact_for_few_and_many_groups(skewed, monkeypatch, few):
    monkeypatch.setattr(os_, "FEW_GROUPS", few)
    probs = {"a": 0.01, "b": 1 / 3, "c": 0.5, "d": 0.99}
    for r in os_.quantiles(skewed, ["g"], "x", probs, ranges=16).collect():
        x = np.array([z.x for z in groups(skewed)[r.g] if z.x is not None])
        assert [r[k] for k in probs] == pytest.approx(list(np.quantile(x, list(probs.values()))))


def test_average_rank_auc_precision_cutoff(spark, skewed):
    ranks = groups(os_.with_average_rank(skewed, ["g"], "x", "r"))
    auc = {r.g: r.roc_auc for r in os_.roc_auc(skewed, ["g"], "x", "f").collect()}
    ap = {r.g: r.average_precision for r in os_.average_precision(skewed, ["g"], "x", "f").collect()}
    cut = {r.g: r.cutoff for r in os_.recall_cutoff(skewed, ["g"], "x", "f", [0.75]).collect()}
    for g, rows in groups(skewed).items():
        rows = [r for r in rows if r.x is not None]
        x, f = np.array([r.x for r in rows]), np.array([r.f for r in rows])
        got = {(r.id, r.x): r.r for r in ranks[g] if r.x is not None}
        np.testing.assert_allclose([got[(r.id, r.x)] for r in rows], avg_rank(x))
        if f.all():
            assert auc[g] is None
        else:
            pos, neg = x[f], x[~f]
            assert auc[g] == pytest.approx(((pos[:, None] > neg).mean() + (pos[:, None] == neg).mean() / 2))
        steps = [(f & (x == v)).sum() / f.sum() * (f & (x >= v)).sum() / (x >= v).sum() for v in np.unique(x)]
        assert ap[g] == pytest.approx(sum(steps))
        assert cut[g] == min(v for v in np.unique(x) if (x[f] <= v).mean() >= 0.75)


def test_positions_are_dense_and_ordered(skewed):
    base = skewed.filter("x is not null")
    for r in (groups(os_.with_position(base, ["g"], "x", "id", "p")),):
        for g, rows in r.items():
            rows.sort(key=lambda z: z.p)
            assert [z.p for z in rows] == list(range(len(rows)))
            assert all(a.x <= b.x for a, b in zip(rows, rows[1:]))
    for g, rows in groups(os_.with_hash_index(base, ["g"], "id", "p", "n")).items():
        assert sorted(z.p for z in rows) == list(range(len(rows))) and {z.n for z in rows} == {len(rows)}
    for g, rows in groups(os_.with_sequence_position(base, ["g"], "id", "p", width=16)).items():
        rows.sort(key=lambda z: z.id)
        assert [z.p for z in rows] == list(range(len(rows)))


def test_conformal_rank_and_too_few_scores(spark):
    rows = [("big", float(i)) for i in range(1, 20)] + [("few", float(i)) for i in range(5)]
    df = spark.createDataFrame(rows, "g string, s double")
    q = {(r.g, r.alpha): r.q for r in os_.conformal_quantile(df, ["g"], "s", [0.1, 0.05]).collect()}
    assert q[("big", 0.1)] == 18.0
    assert q[("few", 0.05)] == float("inf")


def test_conformal_coverage(spark):
    rng = np.random.default_rng(5)
    x = np.abs(rng.normal(size=(2000, 41)))
    df = spark.createDataFrame([(i, float(v)) for i in range(2000) for v in x[i, :40]], "g int, s double")
    q = {r.g: r.q for r in os_.conformal_quantile(df, ["g"], "s", [0.1]).collect()}
    assert 0.88 <= np.mean([x[i, 40] <= q[i] for i in range(2000)]) <= 0.94


def test_folds_cover_once_and_balance(spark):
    cells = spark.createDataFrame([(f"c{i}", 300.0 + 10 * i) for i in range(41)], "cell_id string, life double")
    rows = sp.stratified_folds(cells, "cell_id", "life", 5, 7).collect()
    assert sorted(r.cell_id for r in rows) == sorted(f"c{i}" for i in range(41))
    assert sorted(np.bincount([r.fold for r in rows])) == [8, 8, 8, 8, 9]
    by_block = {}
    for r in rows:
        by_block.setdefault(int((r.life - 300) // 50), []).append(r.fold)
    assert all(len(set(v)) == len(v) for v in by_block.values())
    assert {r.cell_id: r.fold for r in rows} == {r.cell_id: r.fold for r in sp.stratified_folds(cells.repartition(7), "cell_id", "life", 5, 7).collect()}


def test_nested_folds_never_train_on_the_outer_test(spark):
    cells = spark.createDataFrame([(i, float(i % 17)) for i in range(60)], "cell_id int, life double")
    rows = sp.nested_folds(cells, "cell_id", "life", 3, 2, 1).collect()
    assert len(rows) == 2 * 3 * 60
    for rep in range(2):
        test = {k: {r.cell_id for r in rows if (r.repeat, r.outer_fold, r.role) == (rep, k, "test")} for k in range(3)}
        assert sorted(c for s in test.values() for c in s) == list(range(60))
        for k in range(3):
            train = [r for r in rows if (r.repeat, r.outer_fold, r.role) == (rep, k, "train")]
            assert not test[k] & {r.cell_id for r in train}
            assert {r.inner_fold for r in train} == {0, 1, 2}


def test_overlap_and_coverage_checks_raise(spark):
    a, b = spark.createDataFrame([("x",), ("y",)], "cell_id string"), spark.createDataFrame([("y",), ("z",)], "cell_id string")
    with pytest.raises(sp.LeakageError, match="y"):
        sp.assert_disjoint({"train": a, "test": b}, "cell_id")
    with pytest.raises(sp.LeakageError):
        sp.assert_same_ids(a, b, "cell_id")
    sp.assert_same_ids(a, a.union(a), "cell_id")


def test_paired_comparison_and_signed_rank(spark):
    rng = np.random.default_rng(1)
    y = rng.uniform(300, 2000, 60)
    a, b = y + rng.normal(0, 20, 60), y + rng.normal(0, 80, 60)
    wide = spark.createDataFrame([(i, 0, float(y[i]), float(a[i]), float(b[i])) for i in range(60)], "cell_id int, seed int, y double, a double, b double")
    r = mt.paired_comparison(wide, "cell_id", [], "y", "a", "b", n_boot=50).first()
    assert r.dRMSE == pytest.approx(np.sqrt(((a - y) ** 2).mean()) - np.sqrt(((b - y) ** 2).mean()))
    assert r.dRMSE_lo < r.dRMSE < r.dRMSE_hi < 0 and r.share_below_zero == 1.0
    assert r.cells_a_better == (abs(a - y) < abs(b - y)).sum() and r.wilcoxon_p < 1e-4
    d = abs(a - y) - abs(b - y)
    rk = avg_rank(abs(d))
    w = mt.wilcoxon_signed_rank(wide.select(F.abs(F.col("a") - F.col("y")).alias("p"), F.abs(F.col("b") - F.col("y")).alias("q")), [], "p", "q").first()
    assert (w.w_plus, w.w_minus) == (pytest.approx(rk[d > 0].sum()), pytest.approx(rk[d < 0].sum()))


def test_exact_signed_rank_p_values(spark):
    import itertools

    d = [1.5, -0.2, 3.0, 0.7, 2.2, -0.9, 4.1]
    df = spark.createDataFrame([(x, 0.0) for x in d], "a double, b double")
    r = mt.wilcoxon_signed_rank(df, [], "a", "b", method="exact").first()
    with pytest.raises(Exception, match="at most 50"):
        mt.wilcoxon_signed_rank(df.union(df), [], "a", "b", method="exact").collect()
    ranks = avg_rank(np.abs(d))
    t = min(r.w_plus, r.w_minus)
    sums = [sum(k for k, s in zip(ranks, signs) if s) for signs in itertools.product((0, 1), repeat=7)]
    assert r.p_value == pytest.approx(min(1.0, 2 * np.mean([s <= t for s in sums])))


def test_id_checks_join_nothing_and_name_what_is_wrong(spark):
    ids = lambda *k: spark.createDataFrame([(x,) for x in k], "cell_id long")
    plan = sp.uncovered_ids(ids(1, 2), ids(2, 3), "cell_id")
    assert "Join" not in plan._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, sp.uncovered_ids(ids(1, 1, 2, None), ids(2, 3, None), "cell_id").collect())) == [(1, "left"), (3, "right")]
    sp.assert_one_row_each(ids(1, 2), ids(2, 1), "cell_id")
    with pytest.raises(sp.LeakageError, match="differ.*3, 'right'"):
        sp.assert_one_row_each(ids(1, 2, 2), ids(2, 1, 3), "cell_id")
    with pytest.raises(sp.LeakageError, match="several rows.*2, 2"):
        sp.assert_one_row_each(ids(1, 2, 2), ids(2, 1), "cell_id")


def test_rank_correlation_with_heavy_ties_and_few_shuffles(spark):
    """A value of many different pairs, values of few pairs, groups of one pair: as SciPy's ranks; no row meets its rank by a join."""
    rng = np.random.default_rng(8)
    rows, want = [], {}
    for g, (x, y) in {
        "heavy": (np.where(rng.random(3000) < 0.5, 1.5, rng.normal(size=3000)), rng.normal(size=3000)),
        "few": (rng.integers(0, 4, 2000).astype(float), rng.integers(0, 3, 2000).astype(float)),
        "line": (np.arange(700.0), -np.arange(700.0)), "one": (np.array([1.0]), np.array([2.0])),
    }.items():
        rows += [(g, float(a), float(b)) for a, b in zip(x, y, strict=True)]
        rank = lambda v: np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
        want[g] = np.corrcoef(rank(x), rank(y))[0, 1] if len(x) > 1 else None
    rows += [("heavy", None, 1.0), (None, 1.0, 1.0), (None, 2.0, 2.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double").repartition(5)
    for ranges in (8, 256):
        out = os_.rank_correlation(df, ["g"], "x", "y", ranges)
        got = {r.g: r for r in out.collect()}
        assert got[None].rho == pytest.approx(1.0) and got[None].n_pairs == 2
        for g, v in want.items():
            assert got[g].rho == (pytest.approx(v, abs=1e-12) if v is not None else None)
            assert got[g].n_pairs == sum(r[0] == g and r[1] is not None for r in rows)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join Inner") - plan.count("strategy=broadcast") == 0  # only tables of groups and ranges are joined
