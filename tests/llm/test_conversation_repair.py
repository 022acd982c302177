import hashlib
import itertools
import random
import re

import pytest

from fadewatch.llm import conversation_repair as cr
from fadewatch.llm.queries import damaged

NAMES = {"u": "user", "a": "assistant"}
BLANK = re.compile(r"[^\x20\x09-\x0D]")


def brute(rows):
    """(cost, audit) of the best of all edit scripts with at most three insertions in a row."""
    best = None
    letters = [["D"] if f in ("blank", "duplicate") else ["D", "K", "Ru", "Ra"] for _, f in rows]
    gaps = ["", "u", "a", "ua", "au"]
    for edits in itertools.product(*letters):
        for ins in itertools.product(gaps, repeat=len(rows) + 1):
            roles, cost, audit = "", 0, ""
            for k in range(len(rows) + 1):
                roles, cost, audit = roles + ins[k], cost + 2 * len(ins[k]), audit + "I" * len(ins[k])
                if k < len(rows):
                    e, (initial, fault) = edits[k], rows[k]
                    roles += "" if e == "D" else initial if e == "K" else e[1]
                    cost += {"D": 3, "K": 0, "R": 2}[e[0]] + (e != "D" and fault == "truncated")
                    audit += e[0]
            if re.fullmatch(r"(s?(ua)+)?", roles) and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


def test_search_against_all_edit_scripts():
    rng = random.Random(7)
    for n in (0, 1, 2, 3):
        for _ in range(60 if n else 1):
            rows = [(rng.choice("suaax"), rng.choice(["", "", "truncated", "blank", "duplicate"])) for _ in range(n)]
            price, taken = cr.repair_rows(rows)
            state = taken[-1][1] if taken else ""
            assert (price, "".join(o[0] for o in taken) + cr.CLOSE[state]) == brute(rows), rows


def best_by_table(rows):
    """The same optimum from a table of the best (cost, audit) of every state, row by row."""
    best = {"": (0, "")}
    for initial, fault in rows:
        more, new = fault == "truncated", {}
        for g, (c, a) in best.items():
            for k in range(3):
                if k:
                    g, c, a = cr.NEXT[g], c + 2, a + "I"
                moves = [(g, c + 3, a + "D")]
                if fault not in ("blank", "duplicate"):
                    moves += [(initial, c + more, a + "K")] * ((initial or " ") in cr.FOLLOW[g]) + [(cr.NEXT[g], c + 2 + more, a + "R")]
                for to, cost, audit in moves:
                    new[to] = min(new.get(to, (cost, audit)), (cost, audit))
        best = new
    return min((c + 2 * len(cr.CLOSE[g]), a + cr.CLOSE[g]) for g, (c, a) in best.items())


@pytest.mark.parametrize("n", [5, 40, 400])
def test_search_against_a_table(n):
    rng = random.Random(n)
    for _ in range(30):
        rows = [(rng.choice(["s", "u", "a", "u", "a", ""]), rng.choice(["", "", "", "truncated", "blank", "duplicate"])) for _ in range(n)]
        price, taken = cr.repair_rows(rows)
        assert (price, "".join(o[0] for o in taken) + cr.CLOSE[taken[-1][1]]) == best_by_table(rows)


def expected(rows):
    """Reports, audits and digests by conversation."""
    out, convs = {}, {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn is not None, turn or 0, role if role is not None else " ", text if text is not None else " "))
    for conv, got in convs.items():
        got.sort()
        seen, marked = set(), []
        for _, _, role, text in got:
            visible = BLANK.findall(text)
            fault = "blank" if not visible else "duplicate" if (role, text) in seen else "truncated" if visible[-1] not in ".!?" else ""
            seen.add((role, text))
            marked.append((role[:1], fault))
        cost, audit = best_by_table(marked)
        state, lines, j = "", [], 0
        for letter in audit:
            if letter == "I":
                state = cr.NEXT[state]
                lines.append(NAMES[state] + ":")
                continue
            if letter == "K":
                state = marked[j][0]
                lines.append(f"{got[j][2]}:{got[j][3]}")
            elif letter == "R":
                state = cr.NEXT[state]
                lines.append(f"{NAMES[state]}:{got[j][3]}")
            j += 1
        turns = {t for there, t, _, _ in got if there}
        counts = [sum(f == k for _, f in marked) for k in ("blank", "duplicate", "truncated")]
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:], strict=False))
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest() if lines else None)
    return out


def found(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn int, role string, text string, place int, conv string")
    repaired, audits, reports = cr.repair(df)
    audit = {}
    for r in sorted(audits.collect(), key=lambda r: r.block):
        audit[r.conv] = audit.get(r.conv, "") + r.audit
    digest = {r.conv: r.repaired_sha256 for r in cr.digests(repaired).collect()}
    return {r.conv: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, audit[r.conv], digest.get(r.conv)) for r in reports.collect()}


def conversations(seed, n, most):
    rng = random.Random(seed)
    rows = []
    for conv in [None, *range(n)]:
        for turn in range(rng.randrange(1, most)):
            text = rng.choice(["One. ", "two", "", "  \n", "three!\t", "Four? no", "five.", f"{turn}.", f"{turn}", None, "é?"])
            rows.append((conv, rng.choice([turn, turn, turn, turn - 1, None, 3 * turn]), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", None, ""]), text))
    return rows


def test_conversations(spark):
    rows = conversations(1, 40, 9)
    assert found(spark, rows) == expected(rows)
    assert found(spark, []) == {}


@pytest.mark.parametrize("bits", [0, 2, 4])
def test_long_conversations_in_many_blocks(spark, bits, monkeypatch):
    monkeypatch.setattr(cr, "BLOCK_BITS", bits)
    rows = conversations(bits, 3, 120) + [(9, t, "user", f"again {t % 3}.") for t in range(150)]
    assert found(spark, rows) == expected(rows)


def test_very_long_text_and_conversation(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(20_000)] + [(2, 0, "user", "x" * 3_000_000 + "."), (2, 1, "assistant", " " * 1_000_000)]
    assert found(spark, rows) == expected(rows)


def test_damage(spark):
    rows = [(c, t, "assistant", "A. b! c? d") for c in range(30) for t in range(3)] + [(None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    import zlib

    want = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        want += [(c, t, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    assert sorted(map(repr, (tuple(r) for r in damaged(df).collect()))) == sorted(map(repr, want))
