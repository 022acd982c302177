"""Array-sum bootstrap against NumPy over explicit resamples."""
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fadewatch.operators import resampling as rs


def weights(keys, seed, n_boot):
    """Multiplicities (entities, resamples) in Python integers."""
    out, mask = [], (1 << 64) - 1
    for k in keys:
        h, row = int(hashlib.md5(f"{seed},{k}".encode()).hexdigest()[:15], 16), []
        for b in range(n_boot):
            z = (h + (b + 1) * 0x9E3779B97F4A7C15) & mask
            z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & mask
            z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & mask
            z = (z ^ (z >> 31)) >> 11
            row.append(sum(z >= t for t in rs.poisson_thresholds()))
        out.append(row)
    return np.array(out)


def test_multiplicities_are_poisson_and_repeatable(spark):
    cells = spark.range(300).select(F.col("id").alias("cell_id"), F.lit("x").alias("other"))
    got = {r.cell_id: r.w for r in rs.resample_weights(cells, "cell_id", 120, 3).collect()}
    w = np.array([got[k] for k in range(300)])
    assert (w == weights(range(300), 3, 120)).all()
    assert w.mean() == pytest.approx(1.0, abs=0.02) and w.var() == pytest.approx(1.0, abs=0.05)
    again = {r.cell_id: r.w for r in rs.resample_weights(cells.repartition(7), "cell_id", 120, 3).collect()}
    assert again == got
    assert rs.resample_weights(cells.limit(0), "cell_id", 5, 3).collect() == []


@pytest.fixture(scope="module")
def rows():
    """Several rows of each entity; one group holds most rows and one score a third of them; null group, scores and values."""
    rng = np.random.default_rng(2)
    out = []
    for k in range(700):
        for g in ("hot", "hot2", None)[: 1 + (k % 20 == 0) + (k % 50 == 0)]:
            score = 0.25 if k % 3 == 0 else round(float(rng.normal()), 1 + k % 3)
            out.append((k, g, score if k % 97 else None, bool(rng.random() < 0.3), float(rng.normal()) if k % 31 else None))
    return out


def test_weighted_sums(spark, rows):
    df = spark.createDataFrame(rows, "cell_id int, g string, s double, f boolean, v double").repartition(5)
    got = {(r.g, r.b): (r.n, r.w, r.v2, r.one) for r in rs.weighted_sums(df, ["g"], "cell_id", {"v2": F.col("v"), "one": F.lit(1.0)}, 40, 9).collect()}
    w = dict(zip(range(700), weights(range(700), 9, 40), strict=True))
    groups = {r[1] for r in rows}
    assert set(got) == {(g, b) for g in groups for b in range(40)}
    for g in groups:
        mine = [r for r in rows if r[1] == g]
        for b in range(40):
            n, total, v, one = got[g, b]
            assert (n, total, one) == (len(mine), sum(w[r[0]][b] for r in mine), total)
            assert v == pytest.approx(sum(w[r[0]][b] * (r[4] or 0.0) for r in mine))
    assert rs.weighted_sums(df.limit(0), ["g"], "cell_id", {"v": F.col("v")}, 4, 9).collect() == []
    assert len(rs.weighted_sums(df, [], "cell_id", {"v": F.col("v")}, 4, 9).collect()) == 4


def rank_metrics(s, f, w):
    pos, neg = w * f, w * ~f
    if pos.sum() == 0 or neg.sum() == 0:
        return None, None
    auc = sum(p * (neg[s < x].sum() + neg[s == x].sum() / 2) for p, x in zip(pos, s, strict=True)) / pos.sum() / neg.sum()
    at = [(pos[s == x].sum(), pos[s >= x].sum(), w[s >= x].sum()) for x in np.unique(s)]
    return auc, sum(p * tp / n for p, tp, n in at if n) / pos.sum()


def test_weighted_rank_metrics(spark, rows):
    df = spark.createDataFrame(rows, "cell_id int, g string, s double, f boolean, v double").repartition(5)
    got = {(r.g, r.b): r for r in rs.weighted_rank_metrics(df, ["g"], "cell_id", "s", "f", 12, 4).collect()}
    w = dict(zip(range(700), weights(range(700), 4, 12), strict=True))
    for g in {r[1] for r in rows}:
        mine = [r for r in rows if r[1] == g and r[2] is not None]
        s, f = np.array([r[2] for r in mine]), np.array([r[3] for r in mine])
        for b in range(12):
            auc, ap = rank_metrics(s, f, np.array([w[r[0]][b] for r in mine]))
            r = got[g, b]
            assert (r.roc_auc is None) == (auc is None)
            if auc is not None:
                assert (r.roc_auc, r.average_precision) == (pytest.approx(auc), pytest.approx(ap))


def test_resamples_of_one_class_are_left_out_and_counted(spark):
    cols = "cell_id int, T int, repeat int, y_true double, early_failure boolean, pred_life double, base_pred_life double, p_fail double"
    data = [(k, 5, r, 100.0 + 10 * k, k == 0, 90.0 + 11 * k, 120.0 + 9 * k, 1.0 / (1 + k)) for k in range(6) for r in range(2)]
    df = spark.createDataFrame(data, cols)
    df = df.withColumns({"lo90": F.col("pred_life") - 5, "hi90": F.col("pred_life") + 15, "base_lo90": F.col("base_pred_life") - 30, "base_hi90": F.col("base_pred_life") + 1})
    df = df.withColumns({"alarm": F.col("p_fail") > 0.4, "base_alarm": F.col("base_pred_life") < 130, "fail_in_set": F.col("p_fail") > 0.3, "pass_in_set": F.col("p_fail") < 0.6})
    full, each = rs.resampled_metrics(df, ["T"], n_boot=60, seed=1)
    w = weights(range(6), 1, 60)
    lost = [b for b in range(60) if w[0, b] == 0 or w[1:, b].sum() == 0]
    table = {r.metric: r for r in rs.resampled_metric_table(full, each, ["T"]).collect()}
    assert 0 < len(lost) < 60 and {r.n_skipped for r in table.values()} == {len(lost)} and {r.n_repeats for r in table.values()} == {2}
    err = np.array([abs((90.0 + 11 * k) - (100.0 + 10 * k)) for k in range(6)])
    kept = [(w[:, b] * err).sum() / w[:, b].sum() for b in range(60) if b not in lost]
    assert (table["reg_new_MAE"].mean, table["reg_new_MAE"].lo95) == (pytest.approx(err.mean()), pytest.approx(np.quantile(kept, 0.025)))
    assert table["clf_new_ROC_AUC"].mean == 1.0
    diff = {r.difference: r for r in rs.paired_difference_table(full, each, ["T"]).collect()}
    assert set(diff) == {"dMAE", "dRMSE", "dPR_AUC", "dROC_AUC"} and diff["dMAE"].n_skipped == len(lost)
    assert diff["dMAE"].estimate == pytest.approx(err.mean() - np.mean([abs(20.0 - k) for k in range(6)]))


def test_draws_are_made_in_pieces_and_equal_the_thresholds_reached():
    import tracemalloc

    bits = np.random.default_rng(4).integers(0, 1 << 60, 256)
    tracemalloc.start()
    w = rs.multiplicities(bits, 3, 2003)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.5 * w.nbytes  # three tables of that size before
    mask = (1 << 64) - 1
    for k in range(0, 256, 51):
        for b in range(3, 2003, 7):
            z = (int(bits[k]) + (b + 1) * 0x9E3779B97F4A7C15) & mask
            z = (z ^ (z >> 30)) * 0xBF58476D1CE4E5B9 & mask
            z = (z ^ (z >> 27)) * 0x94D049BB133111EB & mask
            z = (z ^ (z >> 31)) >> 11
            assert w[k, b - 3] == sum(z >= t for t in rs.poisson_thresholds())
    near = rs._BY_FIRST_BITS == 255
    assert 0 < near.sum() <= len(rs.poisson_thresholds()) and (np.diff(rs._BY_FIRST_BITS[~near].astype(int)) >= 0).all()


def test_block_sums_of_full_and_of_thin_groups_agree():
    rng = np.random.default_rng(8)
    w = rng.poisson(1.0, (50, 9)).astype(float)
    for n, groups in ((400, 3), (60, 40), (0, 3)):
        group, of, v = np.sort(rng.integers(0, groups, n)), rng.integers(0, 50, n), rng.random((2, n))
        got = {k: (m, x) for k, m, x in rs._block_sums(v, group, of, w)} if n else {}
        assert sorted(got) == sorted(set(group.tolist()))
        for k, (m, x) in got.items():
            assert m == (group == k).sum() and np.allclose(x, v[:, group == k] @ w[of[group == k]])
