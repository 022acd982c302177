import random

import numpy as np
import pytest

from fadewatch.llm import byte_bpe
from fadewatch.llm import token_counts as tc
from fadewatch.llm.queries import byte_bpe_files

END = 50256


def brute(ids):
    out, n = [], 0
    for x in ids:
        if x == END:
            out.append((n, True))
            n = 0
        else:
            n += 1
    return out + ([(n, False)] if n else [])


@pytest.mark.parametrize(("width", "block"), [(2, 1), (2, 7), (4, 16), (2, 1 << 16)])
def test_scan_of_flat_files(spark, tmp_path, width, block):
    rng = random.Random(block)
    files = {}
    for f in range(6):
        # identifiers whose bytes look like the end across borders of identifiers
        ids = [rng.choice([END, 0x50C4, 0xC450, 0x5050, 0xC4C4, 5, 5, 5]) for _ in range(rng.choice([0, 1, 7, 14, 50, 333]))]
        (tmp_path / f"f{f}.bin").write_bytes(np.array(ids, dtype=f"<u{width}").tobytes() + (b"\x50" if f == 3 else b""))
        files[f"f{f}.bin"] = ids
    got = {}
    for r in tc.count_tokens(spark, str(tmp_path), END, width, block).collect():
        got.setdefault(r.file.rsplit("/", 1)[1], []).append((r.ordinal, r.n_tokens, r.ended))
    for name, ids in files.items():
        rows = sorted(got.get(name, []))
        assert [x[0] for x in rows] == list(range(len(rows))) and [x[1:] for x in rows] == brute(ids)


def test_counts_of_documents(spark, tmp_path):
    path, pattern = byte_bpe_files()
    code, _ = byte_bpe.vocabulary(path, pattern)
    texts = ["a b c", None, "", "PÄ 僄", "one\n\ntwo", "a b c"] + ["word " * k for k in range(300)]
    rows = [(k if k != 4 else None, t, "x") for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, ordinal string").repartition(5).write.parquet(str(tmp_path / "in"))
    docs = spark.read.parquet(str(tmp_path / "in"))
    got = {r.doc_id: r.n_tokens for r in tc.count_documents(docs, str(tmp_path / "flat"), path, pattern, END).collect()}
    assert got == {d: len(code(t or "")) for d, t, _ in rows}
    flat = b"".join(f.read_bytes() for f in (tmp_path / "flat").glob("part-*"))
    assert len(flat) == 2 * (sum(got.values()) + len(rows))
    empty = docs.limit(0)
    assert tc.count_documents(empty, str(tmp_path / "none"), path, pattern, END).count() == 0
