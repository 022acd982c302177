import random

import numpy as np
import pytest

from fadewatch.llm import suffix_dedup as sd


def brute(rows):
    """Kept bytes and spans of each distinct row, by a dictionary of all strings."""
    import xxhash

    def order(r):
        h = xxhash.xxh64(r[1].encode(), seed=42).intdigest()
        return (r[0] is not None, r[0] or 0, h - (1 << 64) if h >> 63 else h)

    seen, out = set(), {}
    for r in sorted({(d, t or "") for d, t in rows}, key=order):
        b = r[1].encode()
        gone = bytearray(len(b))
        for p in range(len(b) - sd.LENGTH + 1):
            s = b[p : p + sd.LENGTH]
            if s in seen:
                gone[p : p + sd.LENGTH] = b"\x01" * sd.LENGTH
            seen.add(s)
        spans, at = [], None
        for p, g in enumerate([*gone, 0]):
            if g and at is None:
                at = p
            elif not g and at is not None:
                spans.append((at, p))
                at = None
        out[r] = (len(b), spans, bytes(c for c, g in zip(b, gone, strict=True) if not g))
    return sorted((d is not None, d or 0, *out[d, t or ""]) for d, t in rows)


def got(spark, rows, **more):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, kept string, text_key int")
    return sorted((r.doc_id is not None, r.doc_id or 0, r.n_bytes, [(s.begin, s.end) for s in r.spans], bytes(r.kept)) for r in sd.remove_repeats(df, **more).collect())


def texts(seed, n):
    rng = random.Random(seed)
    parts = ["".join(rng.choice("abcdé .\n") for _ in range(k)) for k in (40, 60, 99, 100, 101, 140, 300)]
    rows = []
    for d in rng.sample(range(10 * n), n):
        text = ""
        for _ in range(rng.randrange(5)):
            text += rng.choice(parts) if rng.random() < 0.7 else "".join(rng.choice("abcd") for _ in range(rng.randrange(120)))
            if rng.random() < 0.3 and text:
                k = rng.randrange(len(text))
                text = text[:k] + "#" + text[k + 1 :]
        rows.append((d, text))
    return rows


@pytest.mark.parametrize("group", [256, 1])
def test_against_all_strings(spark, group):
    rows = texts(group, 60)
    want = brute(rows)
    assert any(spans for _, _, _, spans, _ in want)
    assert got(spark, rows, group=group) == want


def test_odd_rows(spark):
    long = "".join(random.Random(3).choice("abcdefgh ") for _ in range(400))
    rows = [(None, long), (4, None), (5, ""), (6, "a" * 99), (7, "b" * 100), (8, "b" * 101), (9, "ab" * 200), (10, "\x00" * 150), (11, "\x00" * 120 + "b" * 100), (12, long), (12, long), (12, long[100:] + long), (3, long[:250]), (13, "ü€😀" * 60)]
    assert got(spark, rows) == brute(rows)
    assert got(spark, []) == []


def test_a_shared_line_in_many_contexts(spark):
    """One line of 60 bytes makes one gram the seed of many different segments; groups are split and nothing is lost."""
    rng = random.Random(9)
    line = "Licensed under the terms that the owner of this text states."
    word = lambda: "".join(rng.choice("klmnop") for _ in range(rng.randrange(20, 90)))
    heads = [word() for _ in range(4)]
    rows = [(d, rng.choice(heads) + line + (rng.choice(heads) if d % 3 else word())) for d in range(120)]
    assert got(spark, rows, group=8) == brute(rows)


def test_very_long_text(spark):
    base = np.random.default_rng(1).integers(97, 123, 1_200_000).astype(np.uint8).tobytes().decode()
    text = base + base[1_048_500:1_048_700] + "-" + base[:150]
    (row,) = got(spark, [(1, text)])
    n = len(base)
    assert row[3] == [(n, n + 200), (n + 201, n + 351)]


@pytest.mark.parametrize("letters", ["a", "ab", "abcdefghijklmnopqrstuvwxyz", "\x00\x01"])
def test_suffix_array(letters):
    rng = random.Random(len(letters))
    for n in [*range(12), 50, 200, 1000]:
        for _ in range(8):
            text = [ord(rng.choice(letters)) + 1 for _ in range(n)] + [0]
            assert sd.suffix_array(text) == sorted(range(n + 1), key=lambda i: text[i:])


def test_equal_strings_have_equal_seeds():
    rng = np.random.default_rng(4)
    for few in (1, 2, 30):
        common = rng.integers(0, few, 100).astype(np.uint8)
        found = set()
        for _ in range(20):
            head = rng.integers(0, few, rng.integers(0, 200)).astype(np.uint8)
            b = np.concatenate([head, common, rng.integers(0, few, rng.integers(0, 200)).astype(np.uint8)])
            start, many, seed, gram, _ = sd.seeds(b)
            assert many.sum() == len(b) - 99 and (many <= sd.SPREAD).all()
            k = int(np.searchsorted(start, len(head), side="right")) - 1
            found.add((int(seed[k]) - len(head), int(gram[k])))
        assert len(found) == 1
