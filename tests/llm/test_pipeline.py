import importlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from fadewatch.llm import byte_bpe, line_quality
from fadewatch.llm.queries import KEEP_FROM, byte_bpe_files

brute_lines = importlib.import_module("test_line_dedup").brute
brute_copies = importlib.import_module("test_ngram_join").brute
brute_leaks = importlib.import_module("test_decontaminate").brute
SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    model = line_quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = [(r.doc_id, r.text) for r in line_quality.score(docs, model).filter(F.col("score") >= KEEP_FROM).collect()]
    texts = brute_lines(sorted(rows))
    ids = sorted(texts)
    component = {d: c for d, n, c in brute_copies([(d, texts[d]) for d in ids], cp.COPY_WORDS, cp.COPY_PERCENT) if n}
    kept = [d for d in ids if component.get(d, d) == d]
    leaks = {d for d, *_ in brute_leaks([(d, texts[d]) for d in kept], items)}
    code, _ = byte_bpe.vocabulary(*byte_bpe_files())
    want = {d: len(code(texts[d])) for d in kept if d not in leaks}
    assert {r.doc_id: r.n_tokens for r in cp.run(spark, SF).collect()} == want
    assert 0 < len(want) < len(rows)


@pytest.mark.parametrize("stage", [s for _, s in cp.STAGES[:-1]])
def test_stages_keep_columns_and_edge_rows(spark, stage):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, keep string, text_key string"
    text = "Plain words of a clean text that nobody copied, told in one line."
    rows = [(1, text, "en", None, 1, 0.1, "a", "b"), (1, text, "en", None, 1, 0.1, "a", "b"), (None, text, None, None, None, None, None, None), (2, None, None, "s", None, None, None, None), (3, "", "en", "s", 0, None, None, None), (4, "é" * 60_000, "en", "s", 0, None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    out = stage(spark, docs, SF)
    assert out.columns == docs.columns
    ids = {r.doc_id for r in out.collect()}
    assert 1 in ids or stage is cp.quality
    if stage is not cp.quality:
        assert {2, 3, 4} <= ids
    assert stage(spark, docs.limit(0), SF).count() == 0


def test_one_of_each_group_stays(spark):
    docs = spark.createDataFrame([(5, "a b c d e f g"), (3, "A b c d e f g"), (3, "a B c d e f g"), (None, "a b c d e f G"), (None, "lone words of a row"), (None, "lone words of a row"), (9, None)], "doc_id long, text string")
    out = sorted((r.doc_id is None, r.doc_id or 0) for r in cp.near_copies(spark, docs, SF).collect())
    assert out == [(False, 3), (False, 9), (True, 0)]
