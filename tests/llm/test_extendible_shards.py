from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from fadewatch.llm.extendible_shards import assign_shards, write_shards


def sharded(spark, rows, limit, identity=("doc_id", "text")):
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string, bytes string")
    return assign_shards(df, limit, F.octet_length("text"), list(identity))


@pytest.mark.parametrize("limit", [1, 40, 1000, 10**9])
def test_every_shard_fits_and_is_needed(spark, limit):
    rows = [(i, "é" * (i * 7 % 23), "x", "y") for i in range(300)]
    out = sharded(spark, rows, limit).collect()
    assert sorted(r.doc_id for r in out) == list(range(300))
    size, count = defaultdict(int), defaultdict(int)
    for r in out:
        assert len(r.shard) == r.depth
        size[r.shard] += r.bytes
        count[r.shard] += 1
    assert all(size[s] <= limit or count[s] == 1 for s in size)
    assert not any(a != b and b.startswith(a) for a in size for b in size)  # no shard inside another
    for s in size:  # a bucket was split only because it was too large
        if s:
            inside = [x for x in size if x.startswith(s[:-1])]
            assert sum(size[x] for x in inside) > limit and sum(count[x] for x in inside) > 1


def test_repeated_rows_and_null_keys_split_too(spark):
    rows = [(None, "abcd", None, None)] * 200 + [(7, None, None, None)] * 5
    out = sharded(spark, rows, 40).collect()
    size = defaultdict(int)
    for r in out:
        size[r.shard] += r.bytes
    assert len(out) == 205 and max(size.values()) <= 40


def test_empty_table(spark):
    assert sharded(spark, [], 10).count() == 0


def test_written_folders(spark, tmp_path):
    df = spark.createDataFrame([(i, "ab" * i) for i in range(50)], "doc_id long, text string")
    shards = assign_shards(df, 300, F.octet_length("text"), ["doc_id", "text"])
    write_shards(df, shards, ["doc_id"], str(tmp_path / "out"))
    back = spark.read.option("basePath", str(tmp_path / "out")).parquet(str(tmp_path / "out"))
    assert back.count() == 50 and back.groupBy("shard").agg(F.sum(F.octet_length("text")).alias("b")).filter("b > 300").count() == 0


@pytest.mark.parametrize("identity", [["doc_id", "text"], ["doc_id"]])
def test_written_rows_with_null_and_repeated_keys(spark, tmp_path, identity):
    rows = [(None, "abcd")] * 100 + [(None, None)] * 3 + [(7, "efgh")] * 50 + [(7, "other")] + [(i, "x" * (i % 9)) for i in range(20, 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    shards = assign_shards(df, 40, F.octet_length("text"), identity, **({} if "text" in identity else {"carry": df.columns}))
    write_shards(df, shards, ["doc_id"], str(tmp_path / "out"))
    back = spark.read.option("basePath", str(tmp_path / "out")).parquet(str(tmp_path / "out"))
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter(rows)
    assert back.groupBy("shard").agg(F.sum(F.octet_length("text")).alias("b")).filter("b > 40").count() == 0


def test_writer_and_assignment_refuse_what_they_would_lose(spark, tmp_path):
    df = spark.createDataFrame([(1, "ab", "c")], "doc_id long, text string, shard string")
    with pytest.raises(ValueError, match="does not carry"):
        write_shards(df.drop("shard"), assign_shards(df, 40, F.octet_length("text"), ["doc_id"]), ["doc_id"], str(tmp_path / "out"))
    with pytest.raises(ValueError, match="shard"):
        assign_shards(df, 40, F.octet_length("text"), ["doc_id"], carry=df.columns)
