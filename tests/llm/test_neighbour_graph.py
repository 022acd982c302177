import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from fadewatch.llm import neighbour_graph as ng
from fadewatch.llm.queries import op9_neighbour_graph


def brute(ids, x, queries, k):
    out = {}
    for q in queries:
        score = x @ x[ids.index(q)]
        order = sorted((-s, i) for s, i in zip(score, ids, strict=True) if i != q)[:k]
        out[q] = [(i, -s) for s, i in order]
    return out


def test_recall_on_the_embeddings(spark):
    sf = "/root/testdata/sf0.1"
    t = pq.read_table(f"{sf}/embeddings.parquet")
    ids, x = t["vec_id"].to_pylist(), np.array(t["embedding"].to_pylist(), dtype=float)
    want = brute(ids, x, [i for i in ids if i % 20 == 0], 20)
    got = {}
    for r in op9_neighbour_graph(spark, sf).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(want)
    hits = 0
    for q, rows in got.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, 21))
        assert all((-a[2], a[1]) < (-b[2], b[1]) for a, b in zip(rows, rows[1:], strict=False))
        assert all(abs(r[2] - x[ids.index(q)] @ x[ids.index(r[1])]) < 1e-12 and r[1] != q for r in rows)
        hits += len({r[1] for r in rows} & {i for i, _ in want[q]})
    assert hits >= 0.9 * 20 * len(want)


@pytest.mark.parametrize(("cell", "neighbours"), [(64, 24), (200, 32)])
def test_small_cells_still_reach_the_neighbours(spark, cell, neighbours):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 16))
    x[:300] = x[0]  # copies on a third of the rows
    df = spark.createDataFrame([(k, v.tolist(), "x") for k, v in enumerate(x)], "vec_id long, embedding array<double>, sim string")
    vectors = ng.sound_vectors(df, "vec_id", "embedding")
    codes = ng.in_bytes(vectors)
    graph = ng.build_graph(codes, k=neighbours, reverse=neighbours, cell=cell)
    found = ng.search(graph, codes, codes.filter("id % 20 = 0"))
    rows = ng.nearest(found, vectors, vectors.filter("id % 20 = 0"), 10).collect()
    want = brute(list(range(900)), x, range(0, 900, 20), 10)
    got = {}
    for r in rows:
        got.setdefault(r.query_id, []).append(r.score)
    hits = sum(sum(s >= want[q][-1][1] - 1e-9 for s in got[q]) for q in want)
    assert hits >= 0.9 * 10 * len(want)


def test_foreign_queries_start_from_entries(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 8))
    codes = ng.in_bytes(ng.sound_vectors(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>"), "id", "v"))
    inside = codes.filter("id >= 20")
    found = {r.query_id: list(r.pool) for r in ng.search(ng.build_graph(inside, k=16, reverse=16), inside, codes.filter("id < 20")).collect()}
    hits = sum(len({20 + int(k) for k in np.argsort(-(x[20:] @ x[q]))[:10]} & set(found[q])) for q in range(20))
    assert hits >= 0.9 * 200


def test_unsound_vectors_and_few_candidates(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (40, None), (60, [0.0, 0.0]), (80, [nan, 1.0]), (100, [inf, 1.0]), (None, [1.0, 1.0]), (120, []), (3, [None, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ng.nearest_neighbours(df, F.col("id") % 20 == 0, 20).collect())
    assert out == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 20, 0.5), (20, 1, 0, 0.5), (20, 2, 1, 0.5), (20, 3, 2, 0.5)]
    assert ng.nearest_neighbours(df.limit(0), F.col("id") % 20 == 0, 20).count() == 0
    assert ng.nearest_neighbours(df.filter("vec_id = 0"), F.col("id") % 20 == 0, 20).count() == 0
