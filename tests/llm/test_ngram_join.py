import random
import re

import numpy as np
import pytest

from fadewatch.llm import ngram_join as nj
from fadewatch.llm.components import components


def grams(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w)} if 0 < len(w) < size else {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def brute(rows, size, percent):
    sets = [grams(t, size) for _, t in rows]
    top = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = top[i], top[j]
                top = [b if x == a else x for x in top]
    low = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            low[top[k]] = min(d, low.get(top[k], d))
    return sorted((d if d is not None else -1, len(sets[k]), (low.get(top[k], -1) if sets[k] else (d if d is not None else -1))) for k, (d, _) in enumerate(rows))


def got(spark, rows, size, percent, **more):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, component_id string, n int")
    none = lambda x: -1 if x is None else x
    return sorted((none(r.doc_id), r.n_shingles, none(r.component_id)) for r in nj.similarity_components(df, size, percent, **more).collect())


def copies(seed, n, words, edits):
    rng = random.Random(seed)
    base = [[rng.choice("abcdefghijklm") + str(rng.randrange(30)) for _ in range(rng.choice(words))] for _ in range(4)]
    rows = []
    for d in rng.sample(range(10 * n), n):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        rows.append((d, (" " if rng.random() < 0.5 else "\n").join(w).upper() if rng.random() < 0.2 else "  ".join(w)))
    return rows


@pytest.mark.parametrize(("size", "percent", "block"), [(3, 90, 1 << 20), (3, 90, 5000), (5, 80, 1 << 20), (1, 80, 4000)])
def test_against_all_pairs(spark, size, percent, block):
    rows = copies(size + percent, 70, [1, 4, 12, 40, 120, 200], 5)
    assert got(spark, rows, size, percent, block_ngrams=block) == brute(rows, size, percent)


def test_every_similar_pair_shares_a_key():
    rng = np.random.default_rng(5)
    for percent in (80, 90, 95):
        for n in (5, 9, 10, 11, 30, 99, 100, 101, 400, 2000):
            for _ in range(20):
                both = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
                if rng.random() < 0.3:
                    both = both >> np.uint64(rng.integers(1, 40))  # crowded at one end of the order
                extra = int(rng.integers(0, n * (100 - percent) // percent + 1))
                x, y = np.unique(both), np.unique(np.concatenate([both, rng.integers(0, 1 << 63, extra, dtype=np.uint64)]))
                if len(x) != len(y) and 100 * len(x) >= percent * len(y):
                    assert set(nj.candidate_keys(x, percent)) & set(nj.candidate_keys(y, percent)), (percent, n, extra)


def test_prefix_tree_finds_all_and_links_connect():
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(45, 61), replace=False), rng.integers(0, 1 << 63, rng.integers(0, 6), dtype=np.uint64)])) for _ in range(60)]
    tree = nj.prefix_tree(sets)
    for percent in (60, 80, 90):
        similar = lambda x, y: 100 * len(np.intersect1d(x, y)) >= percent * len(np.union1d(x, y))  # noqa: B023, E731
        for x in sets:
            assert sorted(nj.similar_to(x, tree, percent)) == [k for k, y in enumerate(sets) if similar(x, y)]
        top = list(range(60))
        for links in (nj.connecting_links(sets, percent),):
            for a, b in links:
                assert similar(sets[a], sets[b])
                top = [top[a] if t == top[b] else t for t in top]
        assert all(top[i] == top[j] for i in range(60) for j in range(i) if similar(sets[i], sets[j]))


def test_sets_without_partners_are_not_probed(monkeypatch):
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 63, 300, dtype=np.uint64)) for _ in range(800)]
    probes = []
    monkeypatch.setattr(nj, "similar_to", lambda x, root, percent, f=nj.similar_to: probes.append(1) or f(x, root, percent))
    assert nj.connecting_links(sets, 90) == [] and not probes
    sets += [np.unique(np.append(s[5:], s[:3] + np.uint64(1))) for s in sets[:20]]
    links = nj.connecting_links(sets, 90)
    assert sorted(map(sorted, links)) == [[k, 800 + k] for k in range(20)] and len(probes) <= 40


def test_similar_sets_share_a_prefix():
    rng = np.random.default_rng(11)
    for percent in (60, 80, 90, 95):
        for _ in range(300):
            n = int(rng.integers(1, 60))
            x = np.unique(rng.integers(0, 200, n, dtype=np.uint64))
            y = np.unique(np.concatenate([rng.permutation(x)[: max(1, len(x) - int(rng.integers(0, 4)))], rng.integers(0, 200, int(rng.integers(0, 4)), dtype=np.uint64)]))
            if 100 * len(np.intersect1d(x, y)) >= percent * len(np.union1d(x, y)):
                assert nj.related([x, y], percent) == [[0, 1]]


def test_edge_rows(spark):
    rows = [(5, None), (6, ""), (7, " \n\t"), (8, "one"), (9, "ONE "), (10, "a b"), (11, "a b c"), (None, "a b c"), (None, "own words of a row"), (11, "a b c"), (12, "É x"), (13, "é x"), (1, "w " * 100_000)]
    assert got(spark, rows, 3, 90) == brute(rows, 3, 90)
    assert got(spark, [], 3, 90) == []


def test_components_of_chain_and_star(spark):
    links = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (139, 138)]
    out = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert out == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 140)}


def test_sets_of_a_block_walk_the_tree_together(monkeypatch):
    rng = np.random.default_rng(13)
    text = rng.integers(0, 1 << 63, 330, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.permutation(text)[: rng.integers(285, 325)], rng.integers(0, 1 << 63, 5, dtype=np.uint64)])) for _ in range(200)]
    walks = []
    monkeypatch.setattr(nj, "similar_pairs", lambda xs, root, percent, f=nj.similar_pairs: walks.append(len(xs)) or f(xs, root, percent))
    links = nj.connecting_links(sets, 90)
    assert len(walks) <= 2  # one walk for each set before
    top = list(range(200))
    for a, b in links:
        top = [top[a] if t == top[b] else t for t in top]
    similar = [(i, j) for i in range(200) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 90 * len(np.union1d(sets[i], sets[j]))]
    assert similar and len(set(top)) > 1 and all(top[i] == top[j] for i, j in similar) and all((max(x), min(x)) in similar for x in links)


def test_stars_take_no_round_and_forests_may_be_small(spark, monkeypatch):
    from fadewatch.llm import components as cp

    tables = []
    monkeypatch.setattr(cp, "staged", lambda df, f=cp.staged: tables.append(1) or f(df))
    out = {r.node: r.component for r in cp.components(spark.createDataFrame([(k, k % 7) for k in range(7, 100)], "a long, b long")).collect()}
    assert out == {k: k % 7 for k in range(100)} and len(tables) == 1
    monkeypatch.setattr(cp, "FOREST", 3)
    rng = random.Random(2)
    links = [(k, k + 7) for k in range(100)] + [(200, k) for k in range(201, 230)]
    rng.shuffle(links)
    out = {r.node: r.component for r in cp.components(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()}
    assert out == {k: k % 7 for k in range(107)} | {k: 200 for k in range(200, 230)}
