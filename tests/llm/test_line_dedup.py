import random
import re

import pytest

from fadewatch.llm.line_dedup import MIN_WORDS, dedup_lines


def near(x, y):
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y)) <= 1
    if len(x) < len(y):
        x, y = y, x
    return len(x) == len(y) + 1 and any(x[:i] + x[i + 1 :] == y for i in range(len(x)))


def brute(rows):
    lines = sorted(((d, k, line) for d, t in rows if t is not None for k, line in enumerate(t.split("\n"))), key=lambda r: (r[0], r[1]))
    out = {d: (None if t is None else []) for d, t in rows}
    seen = []
    for d, _, line in lines:
        w = [x for x in re.split(r"[ \t\r\x0b\f]+", line) if x]
        if not w:
            out[d].append(line)
            continue
        again = any(line == s for s, _ in seen) or (len(w) >= MIN_WORDS and any(len(v) >= MIN_WORDS and near(w, v) for _, v in seen))
        if not again:
            out[d].append(line)
        seen.append((line, w))
    return {d: None if x is None else "\n".join(x) for d, x in out.items()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    base = [[rng.choice("abcdef") + rng.choice("xy") for _ in range(rng.randrange(1, 14))] for _ in range(8)]
    rows = []
    for d in range(60):
        lines = []
        for _ in range(rng.randrange(0, 5)):
            w = list(rng.choice(base))
            for _ in range(rng.randrange(0, 3)):
                k = rng.randrange(len(w) + 1)
                w[k : k + rng.randrange(0, 2)] = [rng.choice("abcdef")] * rng.randrange(0, 2)
            lines.append(rng.choice([" ", "  ", "\t"]).join(w) + rng.choice(["", " ", "\r"]))
        rows.append((d, "\n".join(lines)))
    got = {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_nulls_repeats_long_lines_and_clashes(spark):
    long = " ".join(f"w{i}" for i in range(30000))
    rows = [(2, "same\n\nother one", 1, "keep"), (None, "same", 2, "keep"), (3, None, 3, None), (4, "", 4, None), (2, "same\n\nother one", 5, "again"), (5, long, 6, None), (6, long + " more", 7, None)]
    out = {r.n_chars: r for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, n_chars int, n_kept string")).collect()}
    assert out[2].text == "same" and out[1].text == "\nother one" and out[5].text == "\nother one"
    assert out[3].text is None and out[3].n_lines == 0 and out[4].text == "" and out[6].text == long and out[7].text == "" and out[7].n_kept == 0


def test_empty_table(spark):
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_one_line_on_a_third_of_the_rows(spark):
    template = "this is a line that stands on many pages with number"
    rows = [(i, f"{template} {i}" if i % 3 == 0 else f"own {i}") for i in range(900)]
    out = {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[0] == f"{template} 0" and all(out[i] == ("" if i % 3 == 0 else f"own {i}") for i in range(1, 900))
