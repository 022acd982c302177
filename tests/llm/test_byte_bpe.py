import hashlib
import random

import pytest

from fadewatch.llm import byte_bpe
from fadewatch.llm.queries import byte_bpe_files

tiktoken = pytest.importorskip("tiktoken")
PATH, PATTERN = byte_bpe_files()

HARD = ["", " ", "a", "'s", "don't we'll I'd x's", "  a   b\n\n c", "\t\t x", "1234567890 12ab34", "ab'scd", "!!'s", "a\u00a0b", "é\u0301ñ 中文字符 テスト", "\x00\x01", "\x1c\x1d a", "😀😀 a😀"]


def whole(text):
    code, _ = byte_bpe.vocabulary(PATH, PATTERN)
    return code(text)


@pytest.mark.parametrize("leaf", [1, 2, 3, 7, 64])
def test_tree_equals_whole_encoding(leaf):
    code, names = byte_bpe.vocabulary(PATH, PATTERN)
    rng = random.Random(leaf)
    alphabets = ["ab", "a '", " \n\ta", "a1!' ", "'stremvdl a", "aé中😀 ’\u00a0\x1c", "abcdefghijklmnopqrstuvwxyz", "the and of to 's 12 ."]
    texts = HARD + ["".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randrange(1, 400))) for _ in range(60)]
    texts += ["".join(rng.choice(a) for _ in range(300)) for a in alphabets]
    for t in texts:
        ids = byte_bpe.encode_text(t, code, leaf)
        assert ids == whole(t), repr(t)
        assert byte_bpe.decode_ids(ids, names, max(1, leaf)) == t.encode()


def test_long_text_of_one_piece():
    code, _ = byte_bpe.vocabulary(PATH, PATTERN)
    text = "".join(random.Random(1).choice("abcdefgh") for _ in range(50_000))
    assert byte_bpe.encode_text(text, code, 1 << 10) == whole(text)


def test_rows_nulls_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b", 5), (None, None, 5), (2, "", None), (1, "a b", 5)], "doc_id long, text string, ids int")
    rows = [tuple(r) for r in byte_bpe.round_trip(df, PATH, PATTERN).collect()]
    none = hashlib.sha256(b"").hexdigest()
    assert (None, 0, none, none) in rows and (2, 0, none, none) in rows
    assert len(rows) == 4 and rows.count((1, 2, hashlib.sha256(" ".join(map(str, whole("a b"))).encode()).hexdigest(), hashlib.sha256(b"a b").hexdigest())) == 2
    back = byte_bpe.decode(byte_bpe.encode(df, PATH, PATTERN), PATH, PATTERN)
    assert back.columns == ["doc_id", "text", "ids", "decoded"]
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in back.collect())
    assert byte_bpe.round_trip(df.limit(0), PATH, PATTERN).count() == 0
