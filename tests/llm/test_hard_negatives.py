import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fadewatch.llm import hard_negatives as hn


def brute(rows, positives=5, negatives=10, low=30, high=90):
    sound = [(i, lab, [math.floor(256 * x) for x in v]) for i, lab, v in rows if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    last = lambda i: (i is None, i or 0)
    out = []
    for a, lab, q in (r for r in sound if r[0] is not None and r[0] % 10 == 0):
        scored = sorted(((sum(x * y for x, y in zip(q, v, strict=True)), i, b) for i, b, v in sound if len(v) == len(q)), key=lambda r: (-r[0], last(r[1])))
        for ps, p, _ in [r for r in scored if r[2] == lab and r[1] != a][:positives]:
            fit = [r for r in scored if r[2] != lab and low * ps <= 100 * r[0] <= high * ps][:negatives]
            out += [(a, p, k + 1, n, ps, ns) for k, (ns, n, _) in enumerate(fit)]
    return sorted(out, key=repr)


def got(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, label int, embedding array<double>, anchor_id int, rank string")
    return sorted((tuple(r) for r in hn.mine(df, F.col("id") % 10 == 0, **more).collect()), key=repr)


def vectors(seed, n, length, scale=1.0, few=None):
    rng = np.random.default_rng(seed)
    draw = rng.integers(0, few, (n, length)) / few if few else rng.normal(size=(n, length)) * scale
    return [(i, int(rng.integers(0, 3)), [float(x) for x in v]) for i, v in enumerate(draw)]


@pytest.mark.parametrize(("scale", "few"), [(1.0, None), (1.0, 2), (5e4, None), (1e-4, None)])
def test_against_brute_force(spark, scale, few):
    rows = vectors(3, 150, 12, scale, few)
    want = brute(rows)
    assert want and got(spark, rows) == want


def test_odd_rows(spark):
    rows = vectors(5, 60, 4, few=3)
    rows += [(None, 1, rows[3][2]), (100, None, rows[0][2]), (110, 1, None), (120, 1, [0.1, None, 0.2, 0.3]), (130, 2, [math.nan, 0.0, 0.0, 1.0]), (140, 0, [math.inf, 0.0, 0.0, 1.0])]
    rows += [(150, 1, [0.5, 0.5]), (151, 1, [0.5, 0.25]), (152, 0, [0.25, 0.25]), (160, 1, []), (10, *rows[10][1:]), (11, *rows[11][1:]), (170, 2, [0.0] * 4)]
    assert got(spark, rows) == brute(rows)
    assert got(spark, []) == []
    assert got(spark, [(None, None, None)]) == []


def test_too_large_scores_are_refused(spark):
    with pytest.raises(ValueError, match="too large"):
        got(spark, [(0, 1, [1e9, 1.0]), (1, 1, [1e9, 2.0])])


@pytest.mark.parametrize(("least", "most"), [(0, 1), (-3, 0), (-140, 146), (-(1 << 20), 1 << 20), (-(1 << 24), (1 << 24) - 1)])
def test_fields_hold_exact_products(least, most):
    rng = np.random.default_rng(most)
    candidates, anchors = rng.integers(least, most + 1, (101, 33)), rng.integers(least, most + 1, (9, 33))
    candidates[:2] = [[least] * 33, [most] * 33]
    anchors[:2] = [[least] * 33, [most] * 33]
    f = hn.Fields.of(least, most, int(np.abs(anchors).sum(axis=1).max()))
    assert f.count * f.width <= 64
    assert (f.scores(f.pack(candidates), anchors, 101) == anchors @ candidates.T).all()
    assert (f.kind is np.float64) == (2 * f.width <= 53)


def test_leaders_break_ties_by_column():
    scores = np.array([[5, 7, 7, 1, 7], [0, 0, 0, 0, 0]])
    row, column = hn.leaders(scores, np.array([[True] * 5, [False, True, True, False, True]]), 2)
    assert list(zip(row.tolist(), column.tolist(), strict=True)) == [(0, 1), (0, 2), (1, 1), (1, 2)]
