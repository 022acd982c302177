"""Corpus pipeline: quality, repeated lines, near copies, benchmark leaks, token identifiers.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's ``docs``. All but the last return the columns of ``docs``; ``n_chars`` follows a text that lost lines. Rows with
null ids and repeated rows go through every stage. A stage whose rule cannot apply to a row (null or empty text) says below
what happens to it.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fadewatch.llm import byte_bpe, decontaminate, line_dedup, line_quality, ngram_join
from fadewatch.llm.queries import KEEP_FROM, byte_bpe_files, table
from fadewatch.llm.staging import staged, text_key

#: Near copies share this percentage of their shingles of so many words.
COPY_WORDS, COPY_PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose lines make a quality of KEEP_FROM or more; null and empty texts score 0 and go.

    The model learns from the labels of the documents given, held-out rows left out.
    """
    columns = docs.columns
    model = line_quality.fit(docs, table(spark, sf_dir, "labels"))
    return line_quality.score(docs.withColumnsRenamed({"score": "_score"}), model).filter(F.col("score") >= KEEP_FROM).drop("score").withColumnsRenamed({"_score": "score"}).select(*columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that equal or nearly equal an earlier line; a text may become empty."""
    kept = line_dedup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: the one with the smallest id (rows without a text are no copies and stay).

    Of rows that share that id in one component one stays: the first by text key, then any of wholly repeated rows.
    """
    found = staged(ngram_join.similarity_components(docs.select("doc_id", "text"), COPY_WORDS, COPY_PERCENT))
    own = found.filter("n_shingles > 0 AND doc_id <=> component_id")
    best = own.groupBy("component_id").agg(F.min(F.struct("text_key1", "text_key2")).alias("key"))
    best = best.select(F.col("component_id").alias("doc_id"), "key.*")
    without_id = own.filter("component_id IS NULL").select("doc_id", "text_key1", "text_key2").distinct()
    best = best.filter("doc_id IS NOT NULL").unionByName(without_id)
    keyed = docs.withColumns(dict(zip(("text_key1", "text_key2"), text_key(), strict=True)))
    same = (F.col("d.text_key1") == F.col("b.text_key1")) & (F.col("d.text_key2") == F.col("b.text_key2")) & F.col("d.doc_id").eqNullSafe(F.col("b.doc_id"))
    with_words = F.coalesce(F.col("text").rlike(r"[^ \t-\r]"), F.lit(False))
    stay = keyed.filter(with_words).alias("d").join(best.alias("b"), same, "left_semi").dropDuplicates(["doc_id", "text_key1", "text_key2"])
    return stay.select(*docs.columns).unionByName(docs.filter(~with_words))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark; null and empty texts hold none."""
    keyed = docs.withColumns(dict(zip(("text_key1", "text_key2"), text_key(), strict=True)))
    leaks = staged(decontaminate.contaminated(keyed, table(spark, sf_dir, "benchmark"), ["text_key1", "text_key2"]).select("text_key1", "text_key2").distinct())
    return keyed.join(leaks, ["text_key1", "text_key2"], "left_anti").select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The number of tokens and the digests of the identifiers and of the bytes decoded from them, for each document."""
    return byte_bpe.round_trip(docs, *byte_bpe_files())


STAGES = [("quality", quality), ("lines", lines), ("near_copies", near_copies), ("benchmark_leaks", benchmark_leaks), ("tokens", tokens)]

#: The classifier and the tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
