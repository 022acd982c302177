import itertools
import zlib

import numpy as np
import pyarrow as pa

from fadewatch.llm import line_quality as lq
from fadewatch.llm.queries import op8_line_quality
from fadewatch.llm.text_arrays import slices, text_buffers

SF = "/root/testdata/sf0.01"


def test_lines_and_shares():
    texts = ["ab\nCD 1\n", "", "\n\nx", None, "one line!", "\n"]
    data, borders = text_buffers(pa.array(texts))
    lines = lq.line_shapes(data, borders)
    got = [list(lines.length[a:b]) for a, b in itertools.pairwise(lines.first)]
    assert got == [[2, 4], [], [0, 0, 1], [], [9], [0]]
    kinds = list(lq.KINDS)
    assert np.isclose(lines.shapes[1, kinds.index("upper")], 5 * 2 / 4) and np.isclose(lines.shapes[1, kinds.index("digit")], 5 * 1 / 4)


def test_marginals_against_all_labellings():
    rng = np.random.default_rng(1)
    first, score, t = np.array([0, 3, 3, 4, 8]), rng.normal(size=8), rng.normal(size=(2, 2))
    good, pairs, log_z = lq.marginals(score, first, t)
    want_pairs = np.zeros((2, 2))
    for d, (a, b) in enumerate(itertools.pairwise(first)):
        mass, p = 0.0, np.zeros(b - a)
        part = np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=b - a):
            w = np.exp(sum(score[a + k] for k in range(b - a) if y[k]) + sum(t[y[k - 1], y[k]] for k in range(1, b - a)))
            mass += w
            p += w * np.array(y, dtype=float)
            for k in range(1, b - a):
                part[y[k - 1], y[k]] += w
        if b > a:
            assert np.allclose(good[a:b], p / mass) and np.isclose(log_z[d], np.log(mass))
            want_pairs += part / mass
    assert np.allclose(pairs, want_pairs)


def test_slices_do_not_change_scores():
    texts = ["A line of words.\nAnother | one | here", "x!!\n" * 50, "", "plain text again and again"] * 3
    data, borders = text_buffers(pa.array(texts))
    model = lq.ChainModel(np.random.default_rng(2).normal(size=3 * lq.N_SHAPES), np.eye(2))
    whole = lq.score_texts(data, borders, model)
    parts = np.concatenate([lq.score_texts(data, borders[k : k + 2], model) for k in range(len(texts))])
    assert np.allclose(whole, parts) and sum(b - a for a, b in slices(borders)) == len(texts)
    assert whole[2] == 0


def test_held_out_accuracy(spark):
    out = {r.doc_id: r for r in op8_line_quality(spark, SF).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for d, r in out.items())
    hidden = [d for d in labels if d in out and out[d].held_out]
    assert np.mean([out[d].predicted == labels[d] for d in hidden]) >= 0.95


def test_labels_of_held_out_rows_have_no_say(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(string(doc_id) AS binary)) % 4 = 2 THEN 1 - quality ELSE quality END AS quality")
    a, b = lq.fit(docs, labels), lq.fit(docs, turned)
    assert np.array_equal(a.weights, b.weights) and (a.slope, a.offset) == (b.slope, b.offset)


def test_edge_rows(spark):
    docs = spark.createDataFrame([(None, None, "s"), (1, "", "s"), (1, "a b", "s"), (1, "a b", "s"), (2, "word " * 200_000, None)], "doc_id long, text string, score string")
    model = lq.fit(docs, spark.createDataFrame([(1, None), (None, 1), (2, 5)], "doc_id long, quality int"))
    rows = lq.score(docs, model).collect()
    assert len(rows) == 5 and [r.score for r in rows if not r.text] == [0.0, 0.0] and {r.score for r in rows if r.text} == {0.5}
    assert lq.score(docs.limit(0), model).count() == 0
