import random
import re
from collections import Counter

import numpy as np
import pytest

from fadewatch.llm import decontaminate as dc


def tokens(text):
    return re.findall(rb"[a-z0-9\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))


def bag(w, size):
    size = min(size, len(w))
    return Counter(tuple(w[i : i + size]) for i in range(len(w) - size + 1))


def alike(a, b):
    weight = lambda s: sum(map(len, s))
    most = sum(max(a[s], b[s]) * weight(s) for s in a | b)
    return sum(min(a[s], b[s]) * weight(s) for s in a & b) / most if most else 0.0


def brute(docs, items, size=5, threshold=0.8):
    out = []
    for d, t in docs:
        w = tokens(t or "")
        for i, text in items:
            q = tokens(text or "")
            if not q or i is None:
                continue
            n = min(len(q), len(w))
            best = None
            if not bag(w, min(size, len(q))).keys() & bag(q, size).keys():
                continue
            for s in range(len(w) - n + 1) if len(w) >= min(size, len(q)) else ():
                x = alike(bag(w[s : s + n], min(size, len(q))), bag(q, size))
                if x >= threshold and (best is None or x > best[0] + 1e-12):
                    best = (x, s, n)
            if best:
                out.append((d, i, best[1], best[2], round(best[0], 9)))
    return sorted(out, key=repr)


def got(spark, docs, items, **more):
    d = spark.createDataFrame([(k, t, 1) for k, t in docs], "doc_id long, text string, item_id int")
    i = spark.createDataFrame([(k, t, "x") for k, t in items], "item_id long, text string, doc_id string")
    return sorted(((r.doc_id, r.item_id, r.word_at, r.n_words, round(r.similarity, 9)) for r in dc.contaminated(d, i, **more).collect()), key=repr)


@pytest.mark.parametrize("item_bytes", [1 << 20, 900])
def test_against_all_windows(spark, item_bytes):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgé") for _ in range(rng.randrange(1, 7)))
    items = [(k, " ".join(word() for _ in range(rng.choice([1, 2, 4, 5, 6, 15, 30, 59])))) for k in range(25)]
    docs = []
    for d in range(80):
        w = [word() for _ in range(rng.randrange(0, 60))]
        for _ in range(rng.randrange(0, 3)):
            q = rng.choice(items)[1].split()
            for _ in range(rng.randrange(0, 3)):
                q[rng.randrange(len(q))] = word()
            at = rng.randrange(len(w) + 1)
            w[at:at] = q[rng.randrange(2) :]
        docs.append((d, rng.choice([", ", " ", "\n"]).join(w).title() if rng.random() < 0.5 else " ".join(w)))
    assert got(spark, docs, items, item_bytes=item_bytes) == brute(docs, items)


def test_index_finds_all_within_radius():
    rng = np.random.default_rng(1)
    prints = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    for radius in (0, 3, 7, 24, 63):
        index = dc.BlockIndex(prints, radius)
        for _ in range(30):
            x = prints[rng.integers(300)] ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 12), replace=False)))
            assert index.within(x) == [(k, int(d)) for k, d in enumerate(np.bitwise_count(prints ^ x)) if d <= radius]


def test_similar_windows_are_within_the_radius():
    rng = np.random.default_rng(2)
    worst = 0
    for _ in range(3000):
        n = int(rng.integers(11, 60))
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        b = a.copy()
        b[: n // 9] = rng.integers(0, 1 << 63, n // 9, dtype=np.uint64)
        weights = rng.integers(10, 40, n)
        if dc.similarity((a, weights), (b, weights)) >= 0.8:
            worst = max(worst, int(np.bitwise_count(dc.simhash(a, weights) ^ dc.simhash(b, weights))))
    assert 0 < worst <= dc.RADIUS


def test_edge_rows(spark):
    item = "the quick brown fox jumps over the lazy dog today"
    docs = [(None, "X " + item), (1, None), (2, ""), (3, item.upper()), (3, item.upper()), (4, "w " * 100_000 + item), (5, "...")]
    items = [(7, item), (7, item), (8, None), (None, item), (9, ""), (10, "?!")]
    out = got(spark, docs, items)
    assert [(d, i) for d, i, *_ in out] == [(3, 7), (3, 7), (4, 7), (None, 7)]
    assert got(spark, [], items) == [] and got(spark, docs, []) == []
