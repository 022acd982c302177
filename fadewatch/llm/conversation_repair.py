"""Repair of the role structure of conversations by depth-first branch and bound.

A conversation is sound if the initials of its roles read ``(s?(ua)+)?``. Edits: Keep a row (costs 0), Rerole it to user or
assistant (2), Delete it (3; blank and duplicate rows must go), Insert an empty user or assistant row anywhere (2). A row that
stays and is truncated adds 1. The audit is the string of the edits' initials; of the cheapest ones the ASCII-least counts.

A node of the search is (rows done, state), where the state is the initial of the last row put out. The search keeps an
explicit stack and expands a node's edits in ASCII order, so that prefixes come up in the order of their audits. Therefore
* a prefix that reaches a node for the price of an earlier prefix, or more, cannot win: the table of each node's least
  price eliminates it;
* once an audit of the incumbent's price is found, only cheaper ones matter; before that, equal ones do.
The suffix bounds are prices alone, from one backward pass over the four states. They are attained, so the incumbent's price
is known from the start, the search only tells audits of that price apart, and its work is linear in the rows. (A looser
bound, the number of neighbours that do not fit, left the search as many prices as rows at each node.)
An insertion straight before a Delete is never needed (the same rows with the Delete first read ASCII-less), nor are two
insertions in a row but at the end (a second one leads back to a state from which the next row fits no better).

A conversation may be of any length: rows are ordered by a range shuffle that splits conversations, and searched in blocks
of at most BLOCK_ROWS places, once for each pair of states before and after the block. The blocks of a conversation are
then put together by the same search, whose edits are whole blocks.
"""
from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import staged, text_key

BLOCK_BITS = 12
BLOCK_ROWS = 1 << BLOCK_BITS
RETYPE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: States: nothing put out yet, or the initial of the last role. Which initials may follow, and the row an insertion adds.
FOLLOW = {"": "su", "s": "u", "u": "a", "a": "u"}
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
ROLE = {"u": "user", "a": "assistant"}
#: Rows to insert at the end of a conversation.
CLOSE = {"": "", "s": "II", "u": "I", "a": ""}
WHITE = " \t\n\x0b\x0c\r"

Option = tuple[str, str, int]


def search(n: int, start: str, options: Callable[[int, str], Sequence[Option]], close: dict[str, str]) -> tuple[int, list[Option]] | None:
    """The cheapest, then ASCII-least way through ``n`` steps from ``start`` to a state of ``close``.

    ``options(i, state)`` lists (letters, next state, price) in ASCII order of the letters, none of which begins another.
    Returns the price, the closing insertions included, and the options taken; None if no way leads there.
    """
    bound: list[dict[str, int]] = [{} for _ in range(n)] + [{state: INSERT * len(rows) for state, rows in close.items()}]
    for i in range(n - 1, -1, -1):
        for state in FOLLOW:
            prices = [price + bound[i + 1][after] for _, after, price in options(i, state) if after in bound[i + 1]]
            if prices:
                bound[i][state] = min(prices)
    if start not in bound[0]:
        return None
    best, won = bound[0][start], None  # the incumbent's price; the bound is attained, so it is the root's
    least: list[dict[str, int]] = [{} for _ in range(n + 1)]
    stack: list[tuple[int, str, int, object]] = [(0, start, 0, None)]
    while stack:
        i, state, price, way = stack.pop()
        lowest = price + bound[i].get(state, 1 << 62)
        if lowest > best or (won is not None and lowest == best) or least[i].get(state, price + 1) <= price:
            continue
        least[i][state] = price
        if i == n:
            best, won = lowest, (way,)
            continue
        for option in reversed(options(i, state)):
            stack.append((i + 1, option[1], price + option[2], (option, way)))
    taken, way = [], won[0]
    while way is not None:
        taken.append(way[0])
        way = way[1]
    return best, taken[::-1]


def repair_rows(rows: list[tuple[str, str]], start: str = "", close: dict[str, str] = CLOSE) -> tuple[int, list[Option]] | None:
    """Search over rows (initial of the role, fault: blank, duplicate, truncated or empty)."""

    @lru_cache(maxsize=None)
    def edits(initial: str, fault: str, state: str) -> list[Option]:
        out = [("D", state, DELETE)]
        if fault not in ("blank", "duplicate"):
            more, after = TRUNCATED * (fault == "truncated"), NEXT[state]
            if initial in FOLLOW[after]:
                out.append(("IK", initial, INSERT + more))
            out.append(("IR", NEXT[after], INSERT + RETYPE + more))
            if initial in FOLLOW[state]:
                out.append(("K", initial, more))
            out.append(("R", after, RETYPE + more))
        return out

    return search(len(rows), start, lambda i, state: edits(rows[i][0] or " ", rows[i][1], state), close)


# ------------------------------------------------------------- rows, blocks, conversations


def ordered(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, turn, role, text, place, block): rows in order of conversation, turn (nulls first), role and text; written once."""
    rows = df.select(F.col(conv).alias("conv"), F.col(turn).cast("bigint").alias("turn"), F.coalesce(role, F.lit(" ")).alias("role"), F.coalesce(text, F.lit(" ")).alias("text"))
    by = ["conv", "turn", "role", "text"]
    rows = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("place", F.monotonically_increasing_id())
    return staged(rows.withColumn("block", F.shiftright("place", BLOCK_BITS)))


def last_character(text: str) -> Column:
    return F.substring(F.rtrim(F.col(text), F.lit(WHITE)), -1, 1)


def _blocks(rows: DataFrame) -> DataFrame:
    """(conv, block, items) with the role's initial and fault of each row; items without initial mark firsts and both ends."""
    fault = F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), "blank").when(~last_character("text").isin(".", "!", "?"), "truncated").otherwise("")
    item = lambda place, initial, fault: F.struct(place.alias("place"), initial.alias("initial"), fault.alias("fault"))
    items = rows.select("conv", "block", item(F.col("place"), F.substring("role", 1, 1), fault).alias("item"))
    marks = [(rows.groupBy("conv", "role", *text_key()).agg(F.min("place").alias("p")), "first")]
    ends = rows.groupBy("conv").agg(F.min("place").alias("low"), F.max("place").alias("high"))
    marks += [(ends.select("conv", F.col("low").alias("p")), "low"), (ends.select("conv", F.col("high").alias("p")), "high")]
    for df, what in marks:
        items = items.unionByName(df.select("conv", F.shiftright("p", BLOCK_BITS).alias("block"), item(F.col("p"), F.lit(None).cast("string"), F.lit(what)).alias("item")))
    return items.groupBy("conv", "block").agg(F.sort_array(F.collect_list("item")).alias("items"))


_COUNTS = ("blank", "duplicate", "truncated", "illegal")
_SOLVED = {
    "places": ("array<bigint>", pa.list_(pa.int64())),
    "initials": ("array<string>", pa.list_(pa.string())),
    "edges": ("array<struct<before: string, after: string, price: bigint>>", pa.list_(pa.struct([("before", pa.string()), ("after", pa.string()), ("price", pa.int64())]))),
    "audits": ("array<string>", pa.list_(pa.string())),
    **{c: ("bigint", pa.int64()) for c in _COUNTS},
}


def _map(df: DataFrame, keys: list[str], inputs: list[str], outputs: dict[str, tuple[str, pa.DataType]], work: Callable[..., tuple]) -> DataFrame:
    """``keys`` of each row and what ``work`` makes of its ``inputs``."""
    rows = df.select(*keys, *inputs)
    schema = rows.select(*keys, *(F.lit(None).cast(t).alias(c) for c, (t, _) in outputs.items())).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [work(*x) for x in zip(*(c.to_pylist() for c in batch.columns[len(keys) :]), strict=True)]
            made = [pa.array([d[k] for d in done], kind) for k, (_, kind) in enumerate(outputs.values())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *made], names=[*keys, *outputs])

    return rows.mapInArrow(run, schema)


def _legal(initials: Sequence[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))


def _solve_block(items: list[dict]) -> tuple:
    """Columns of _SOLVED; ways through the block are in order of their audits."""
    rows, marks = [x for x in items if x["initial"] is not None], {x["fault"] for x in items if x["initial"] is None}
    firsts = {x["place"] for x in items if x["fault"] == "first"}
    seen = [(x["initial"], "duplicate" if x["fault"] != "blank" and x["place"] not in firsts else x["fault"]) for x in rows]
    ways = []
    for before in [""] if "low" in marks else FOLLOW:
        for close in [CLOSE] if "high" in marks else [{after: ""} for after in FOLLOW]:
            found = repair_rows(seen, before, close)
            if found:
                after = found[1][-1][1]
                ways.append(("".join(o[0] for o in found[1]) + close[after], before, after, found[0]))
    ways.sort()
    initials, faults = [x[0] for x in seen], [x[1] for x in seen]
    edges = [dict(zip(("before", "after", "price"), w[1:], strict=True)) for w in ways]
    return [x["place"] for x in rows], initials, edges, [w[0] for w in ways], *(faults.count(c) for c in _COUNTS[:3]), _legal(initials)


def _join_blocks(blocks: list[dict]) -> tuple[int, int, list[dict]]:
    """Price, illegal pairs at the borders, and the way through each block (its place among the block's ways)."""
    def options(i: int, state: str) -> list[Option]:
        return [(f"{k:02d}", e["after"], e["price"]) for k, e in enumerate(blocks[i]["edges"]) if e["before"] == state]

    price, taken = search(len(blocks), "", options, dict.fromkeys(FOLLOW, ""))
    befores = ["", *(after for _, after, _ in taken)]
    chosen = [{"block": b["block"], "before": befores[k], "way": int(taken[k][0])} for k, b in enumerate(blocks)]
    return price, sum(_legal([a["tail"], b["head"]]) for a, b in zip(blocks, blocks[1:], strict=False)), chosen


def _edits(places: list[int], initials: list[str], state: str, audit: str) -> tuple[list[dict]]:
    """The rows that an audit puts out: place, order at the place, new role (null: the row's own), inserted."""
    out, j, closing = [], 0, 0
    for letter in audit:
        if letter == "I":
            state, closing = NEXT[state], closing + (j == len(places))
            out.append({"place": places[min(j, len(places) - 1)], "nth": closing or -1, "role": ROLE[state], "inserted": True})
            continue
        if letter != "D":
            state = initials[j] if letter == "K" else NEXT[state]
            out.append({"place": places[j], "nth": 0, "role": None if letter == "K" else ROLE[state], "inserted": False})
        j += 1
    return (out,)


def repair(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Repair every conversation of ``df``: (repaired rows, audits of blocks, one report for each conversation).

    * repaired: (conv, place, nth, turn, role, text); place, then nth, is the order. Inserted rows have an empty text and
      no turn.
    * audits: (conv, block, audit); the audit of a conversation is that of its blocks in order.
    * reports: (conv, gaps, blank, duplicate, truncated, illegal, cost).
    Rows are ordered by turn (nulls first), then by role and text. Null roles and texts count as one space, so such a text
    is blank; a null conversation id is a conversation. The first fault of a row counts: blank (no other character than
    white space), duplicate (role and text seen earlier), truncated. gaps is maxTurn - minTurn + 1 - distinctTurns without
    nulls, 0 if there are only nulls. Texts are never gathered; other columns are unused; no rows give no rows.
    """
    rows = ordered(df, conv, turn, role, text)
    blocks = staged(_map(_blocks(rows), ["conv", "block"], ["items"], _SOLVED, _solve_block))
    listed = blocks.select("conv", F.struct("block", F.element_at("initials", 1).alias("head"), F.element_at("initials", -1).alias("tail"), "edges").alias("b"))
    listed = listed.groupBy("conv").agg(F.sort_array(F.collect_list("b")).alias("blocks"))
    chosen = ("array<struct<block: bigint, before: string, way: int>>", pa.list_(pa.struct([("block", pa.int64()), ("before", pa.string()), ("way", pa.int32())])))
    ways = staged(_map(listed, ["conv"], ["blocks"], {"cost": _SOLVED["blank"], "borders": _SOLVED["blank"], "chosen": chosen}, _join_blocks))

    picked = ways.select(F.col("conv").alias("c"), F.explode("chosen").alias("x")).select("c", F.col("x.block").alias("b"), "x.before", "x.way")
    audits = blocks.join(picked, blocks["conv"].eqNullSafe(picked["c"]) & (blocks["block"] == picked["b"]))
    audits = staged(audits.select("conv", "block", "places", "initials", "before", F.element_at("audits", F.col("way") + 1).alias("audit")))

    edit = ("array<struct<place: bigint, nth: int, role: string, inserted: boolean>>", pa.list_(pa.struct([("place", pa.int64()), ("nth", pa.int32()), ("role", pa.string()), ("inserted", pa.bool_())])))
    edits = _map(audits, ["conv"], ["places", "initials", "before", "audit"], {"edits": edit}, _edits).select("conv", F.explode("edits").alias("e")).select("conv", "e.*")
    own = rows.select(F.col("place").alias("p"), F.col("turn").alias("t"), F.col("role").alias("own_role"), F.col("text").alias("own_text"))
    text_of = F.when(F.col("inserted"), F.lit("")).otherwise(F.col("own_text")).alias("text")
    repaired = edits.join(own, F.col("place") == F.col("p")).select("conv", "place", "nth", F.when(~F.col("inserted"), F.col("t")).alias("turn"), F.coalesce("role", "own_role").alias("role"), text_of)

    turns = rows.groupBy("conv", "turn").agg(F.lit(1)).groupBy("conv").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0).cast("bigint")).alias("gaps"))
    counts = blocks.groupBy(F.col("conv").alias("c1")).agg(*(F.sum(c).alias(c) for c in _COUNTS))
    reports = turns.join(counts, F.expr("conv <=> c1")).join(ways.select(F.col("conv").alias("c2"), "cost", "borders"), F.expr("conv <=> c2"))
    reports = reports.select("conv", "gaps", *_COUNTS[:3], (F.col("illegal") + F.col("borders")).alias("illegal"), "cost")
    return repaired, audits.select("conv", "block", "audit"), reports


def digests(repaired: DataFrame) -> DataFrame:
    """(conv, repaired_sha256) of ``role:text`` of the repaired rows in order, one newline between rows.

    A digest is sequential by definition: the rows of a conversation are sorted into one task, which reads them as a
    stream and keeps no row, so memory does not grow with a conversation.
    """
    line = F.concat("role", F.lit(":"), "text").alias("line")
    placed = repaired.repartition("conv").sortWithinPartitions("conv", "place", "nth").select("conv", line)
    schema = placed.select("conv", F.lit("").alias("repaired_sha256")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest = None, None
        for batch in batches:
            ends, out = [], []
            for conv, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if digest is None or conv != at:
                    if digest is not None:
                        ends.append(at)
                        out.append(digest.hexdigest())
                    at, digest = conv, hashlib.sha256(line.encode())
                else:
                    digest.update(b"\n" + line.encode())
            yield pa.RecordBatch.from_arrays([pa.array(ends, batch.schema.field(0).type), pa.array(out, pa.string())], names=["conv", "repaired_sha256"])
            kind = batch.schema.field(0).type
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], kind), pa.array([digest.hexdigest()])], names=["conv", "repaired_sha256"])

    return placed.mapInArrow(run, schema)
