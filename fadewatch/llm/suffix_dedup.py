"""Removal of repeated byte strings by suffix arrays (linear grouping construction).

Every string of LENGTH bytes that also starts earlier in the corpus is removed, byte for byte. Equal strings are brought
together first: a string belongs to its *seed*, the leftmost of its GRAM-byte grams with the least hash. Equal strings have
equal seeds at equal places, so the strings of one seed (consecutive starts, a *segment* of less than LENGTH + SPREAD
bytes) need to be compared with the strings of the same gram elsewhere only. Steps:

1. Count the grams that are seeds. A filter of fixed size lets through those seen twice.
2. Segments of these grams; equal segments are one, owned by the earliest. Whatever is not an owner is a repeat.
3. Owners of one gram meet. First they are split by the offset of the seed in the string: strings in the lower and the
   upper half of the offsets share a longer context, which makes the new key. Too large groups are split on; at the end of
   the halving a key stands for one string, so no group stays too large.
4. A task writes the owners of its grams one after the other, builds the suffix array of that text, and reads equal strings
   off neighbours in it. All but the earliest are repeats.
5. Repeats are joined to the documents, whose texts lose these bytes.

Suffix array: suffixes are grouped by first byte. Groups are processed from the last to the first: each suffix finds its
previous smaller suffix (the nearest to the left in a lower group, along pointers that skip what is larger); the suffixes
pointed to from the group continue with its Lyndon prefix, so they move to a group just above their own, those pointed to
more often higher. Then suffixes are grouped by their longest Lyndon prefix. A last pass takes suffixes in their final order
and puts the one before each, and what its pointers lead to, at the next place of its group. Both passes are linear; no
names are computed and nothing recurses.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import scratch, staged
from .text_arrays import mix, powers, slices, text_buffers

#: Bytes of a string and of a gram; a seed is the gram of up to SPREAD strings.
LENGTH, GRAM = 100, 50
SPREAD = LENGTH - GRAM + 1
#: Text is cut into parts of so many starts, which bounds the arrays of a very long one.
PART = 1 << 20
#: Owners of a key that may meet in one suffix array, and bytes of a text for one suffix array.
GROUP, TEXT = 256, 1 << 13
#: How many times the segments of every gram are split by the offset of the seed before they meet.
HALVINGS = 2
#: Bits of the filter of repeated grams, 8 MiB at every size of the input; filling up, it lets more grams through.
FILTER_BITS = 1 << 26


def suffix_array(text: list[int]) -> list[int]:
    """Order of the suffixes of ``text``, whose last element is smaller than all others."""
    n = len(text)
    codes = np.asarray(text)
    by_first = np.argsort(codes, kind="stable")
    _, begin, count = np.unique(codes[by_first], return_index=True, return_counts=True)
    start = np.empty(n, np.int64)
    start[by_first] = np.repeat(begin, count)
    order, group, place = by_first.tolist(), start.tolist(), np.argsort(by_first).tolist()
    size = np.zeros(n, np.int64)
    size[begin] = count
    size = size.tolist()
    smaller = [-1] * n  # previous smaller suffix; group[-1] is the lowest group, where every search ends
    end = n
    while end > 1:
        at = group[order[end - 1]]
        if end - at == 1:
            i = order[at]
            j = i - 1
            while group[j] > at:
                j = smaller[j]
            smaller[i] = j
            if j >= 0:
                g = group[j]
                size[g] -= 1
                if size[g]:
                    to = g + size[g]
                    k, p = order[to], place[j]
                    order[p], place[k] = k, p
                    order[to], place[j] = j, to
                    group[j] = to
                    size[to] = 1
                else:
                    size[g] = 1
        else:
            times: dict[int, int] = {}
            for i in sorted(order[at:end]):
                j = i - 1
                while group[j] >= at:
                    j = smaller[j]
                smaller[i] = j
                if j >= 0:
                    times[j] = times.get(j, 0) + 1
            for much in sorted(set(times.values()), reverse=True):
                moved = [j for j, t in times.items() if t == much]
                for j in moved:
                    g = group[j]
                    size[g] -= 1
                    to = g + size[g]
                    k, p = order[to], place[j]
                    order[p], place[k] = k, p
                    order[to], place[j] = j, to
                for j, to in [(j, group[j] + size[group[j]]) for j in moved]:
                    group[j] = to
                    size[to] += 1
        end = at
    free = list(range(n))
    out, done = [n - 1] * n, bytearray(n)
    done[n - 1] = 1
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not done[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            done[j] = 1
            j = smaller[j]
    return out


# ------------------------------------------------------------- seeds


def seeds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, strings, seed's place, hash of the gram, hash of the bytes) of each segment of a text."""
    found = []
    for lo in range(0, len(data) - LENGTH + 1, PART):
        b = data[lo : lo + PART + LENGTH - 1]
        p, inverse = powers(len(b) + 1)
        total = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * p[: len(b)], out=total[1:])
        grams = mix((total[GRAM:] - total[:-GRAM]) * inverse[: len(b) - GRAM + 1])
        least = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)  # of equal hashes the leftmost
        reach = 1
        while 2 * reach <= SPREAD:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if reach < SPREAD:
            least = np.minimum(least[: len(least) - (SPREAD - reach)], least[SPREAD - reach :])
        seed = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        start = np.flatnonzero(np.concatenate([[True], seed[1:] != seed[:-1]]))
        many = np.diff(np.append(start, len(seed)))
        seed = seed[start]
        content = mix((total[start + many + LENGTH - 1] - total[start]) * inverse[start] + many.astype(np.uint64) + ((seed - start).astype(np.uint64) << np.uint64(32)))
        found.append((start + lo, many, seed + lo, grams[seed], content))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _texts(column: pa.Array) -> Iterator[np.ndarray]:
    data, borders = text_buffers(column)
    for lo, hi in zip(borders[:-1], borders[1:], strict=True):
        yield data[lo:hi]


def gram_counts(docs: DataFrame) -> DataFrame:
    """(key, n, least, most): segments of each gram in a batch, and the least and greatest hash of their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for b in batches if b.num_rows):
            found = [seeds(b)[3:] for b in _texts(batch.column(0))]
            key, own = (np.concatenate(x).view(np.int64) for x in zip(*found, strict=True))
            order = np.lexsort((own, key))
            key, own = key[order], own[order]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
            last = np.append(first[1:], len(key))[: len(first)] - 1
            yield pa.RecordBatch.from_arrays([pa.array(key[first]), pa.array(last - first + 1), pa.array(own[first]), pa.array(own[last])], names=["key", "n", "least", "most"])

    return docs.select("text").mapInArrow(run, "key bigint, n bigint, least bigint, most bigint")


def repeated_grams(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Two tables with a bit for each value of the lowest bits of a gram's hash: seed of two segments, of two that differ."""
    total = gram_counts(docs).groupBy("key").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most")).filter("n > 1")
    slot = F.pmod("key", F.lit(FILTER_BITS)) + 1
    bits = total.select((F.col("least") != F.col("most")).alias("differ"), F.bitmap_bucket_number(slot).alias("bucket"), F.bitmap_bit_position(slot).alias("bit"))
    twice, differ = np.zeros(FILTER_BITS // 8, np.uint8), np.zeros(FILTER_BITS // 8, np.uint8)
    for r in bits.groupBy("bucket", "differ").agg(F.bitmap_construct_agg("bit").alias("bits")).collect():  # 2 * FILTER_BITS bits at most
        for table in (twice, differ) if r.differ else (twice,):
            table[(r.bucket - 1) * len(r.bits) : r.bucket * len(r.bits)] |= np.frombuffer(bytes(r.bits), np.uint8)
    return twice, differ


def _passes(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys & np.uint64(FILTER_BITS - 1)
    return (table[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def segments(docs: DataFrame, sent) -> DataFrame:
    """Segments of grams seen twice: gram, hash, document, start, strings, offset of the seed, and bytes if segments of the gram differ."""
    schema = "key bigint, segment bigint, doc_id bigint, text_key bigint, start bigint, many int, lead int, bytes binary"

    def found(batch: pa.RecordBatch) -> pa.RecordBatch:
        twice, differ = sent.value
        cols, content = [], []
        for k, b in enumerate(_texts(batch.column(2))):
            start, many, seed, gram, own = seeds(b)
            keep = _passes(twice, gram)
            start, many, gram = start[keep], many[keep], gram[keep]
            size = np.where(_passes(differ, gram), many + LENGTH - 1, 0)
            cols.append((gram.view(np.int64), own[keep].view(np.int64), start, many.astype(np.int32), (seed[keep] - start).astype(np.int32), np.full(len(start), k), size))
            content.append(b[np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())])
        key, own, start, many, lead, k, size = (np.concatenate(x) for x in zip(*cols, strict=True))
        ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        absent = np.packbits(size > 0, bitorder="little")
        content = pa.Array.from_buffers(pa.binary(), len(size), [pa.py_buffer(absent.tobytes()), pa.py_buffer(ends.tobytes()), pa.py_buffer(np.concatenate(content).tobytes())])
        at = pa.array(k)
        arrays = [pa.array(key), pa.array(own), batch.column(0).take(at), batch.column(1).take(at), pa.array(start), pa.array(many), pa.array(lead), content]
        return pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, borders = text_buffers(batch.column(2))
            for lo, hi in slices(borders):
                yield found(batch.slice(lo, hi - lo))

    return docs.select("doc_id", "text_key", "text").mapInArrow(run, schema)


# ------------------------------------------------------------- owners and groups


def owners(rows: DataFrame, by: list[str]) -> DataFrame:
    """The earliest of equal segments; ``by`` and the hash of the bytes tell segments apart."""
    first = F.min(F.struct("doc_id", "text_key", "start")).alias("owner")
    rest = [c for c in rows.columns if c not in ("doc_id", "text_key", "start", "segment", *by)]
    found = rows.groupBy(*by, "segment").agg(first, *(F.first(c).alias(c) for c in rest))
    return found.select(*by, "segment", "owner.*", *rest)


def halves(rows: DataFrame) -> DataFrame:
    """Each segment as the strings whose seed is in the lower and in the upper half of the offsets ``low`` to ``high``."""
    middle = F.expr("(low + high) div 2")
    cut = F.least(F.greatest(F.col("lead") - middle, F.lit(0)), F.col("many")).cast("int")  # strings of the upper half come first
    part = lambda name, at, many, low, high: F.struct(F.lit(name).alias("side"), at.cast("int").alias("at"), many.cast("int").alias("many"), low.cast("int").alias("low"), high.cast("int").alias("high"))
    sides = F.array(part(1, F.lit(0), cut, middle + 1, F.col("high")), part(0, cut, F.col("many") - cut, F.col("low"), middle))
    rows = rows.select("key", "doc_id", "text_key", "start", "lead", "bytes", F.explode(sides).alias("s")).filter("s.many > 0")
    rows = rows.select("key", "doc_id", "text_key", (F.col("start") + F.col("s.at")).alias("start"), (F.col("lead") - F.col("s.at")).alias("lead"), "s.many", "s.low", "s.high", "s.side", F.expr(f"substring(bytes, s.at + 1, s.many + {LENGTH - 1})").alias("bytes"))
    context = F.expr(f"substring(bytes, lead - low + 1, {LENGTH} - (high - low))")
    return rows.select(F.xxhash64("key", "side", context).alias("key"), F.xxhash64("bytes", "lead").alias("segment"), "doc_id", "text_key", "start", "many", "lead", "low", "high", "bytes")


def groups_of_owners(rows: DataFrame, group: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Owners that meet under one key, at most ``group`` of them, and the repeats found while groups were split.

    All groups are split HALVINGS times, which parts segments that share too little, and those that are still too large again.
    """
    rows = rows.withColumns({"low": F.lit(0), "high": F.lit(SPREAD - 1)})
    meet, repeats, level = [], [], 0
    while True:
        sizes = staged(rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))
        most, level = (group if level >= HALVINGS else 1), level + 1
        if most > 1:
            meet.append(rows.join(sizes.filter(F.col("n") <= most).select("key"), "key").select("key", "doc_id", "text_key", "start", "many", "bytes"))
        large = sizes.filter(F.col("n") > most).select("key")
        if level > HALVINGS and large.isEmpty():
            return meet, repeats
        split = staged(halves(rows.join(large, "key")))
        rows = staged(owners(split, ["key"]))
        repeats.append(split.join(rows, (split["doc_id"].eqNullSafe(rows["doc_id"])) & (split["text_key"] == rows["text_key"]) & (split["start"] == rows["start"]), "left_anti").select("doc_id", "text_key", "start", "many"))


def repeats_in(owned: list[tuple[int, int, int, bytes]]) -> list[tuple[int, int, int]]:
    """(place in the list, first string, strings) of the repeats of a list of (order of the document, start, strings, bytes)."""
    size = np.array([len(b) for *_, b in owned])
    first = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
    raw = np.frombuffer(b"\x00".join(b for *_, b in owned) + bytes(9), np.uint8)
    n = int(size.sum()) + len(owned)
    codes = raw[:n].astype(np.int64) + 2
    codes[first + size] = 1
    order = np.array(suffix_array([*codes.tolist(), 0]))
    many = np.array([m for _, _, m, _ in owned])
    index = np.repeat(np.arange(len(owned)), many)
    nth = np.arange(len(index)) - np.repeat(np.cumsum(many) - many, many)
    string = np.full(n + 1, -1)
    string[first[index] + nth] = np.arange(len(index))
    of = string[order]
    at, of = order[of >= 0], of[of >= 0]
    words = sum(raw[k : k + n].astype(np.uint64) << np.uint64(8 * k) for k in range(8))
    same = np.flatnonzero(words[at[1:]] == words[at[:-1]])
    for shift in [*range(8, LENGTH - 8, 8), LENGTH - 8]:
        same = same[words[at[same + 1] + shift] == words[at[same] + shift]]
    new = np.ones(len(at), bool)
    new[same + 1] = False
    kind = np.cumsum(new)
    doc, start = np.array([d for d, *_ in owned])[index[of]], np.array([s for _, s, *_ in owned])[index[of]] + nth[of]
    by = np.lexsort((start, doc, kind))
    later = by[1:][kind[by[1:]] == kind[by[:-1]]]
    repeated = np.zeros(len(index), bool)
    repeated[of[later]] = True
    flags = np.flatnonzero(repeated)
    begins = flags[np.concatenate([[True], (np.diff(flags) > 1) | (index[flags[1:]] != index[flags[:-1]])])] if len(flags) else flags
    ends = flags[np.concatenate([(np.diff(flags) > 1) | (index[flags[1:]] != index[flags[:-1]]), [True]])] if len(flags) else flags
    return [(int(index[b]), int(nth[b]), int(e - b + 1)) for b, e in zip(begins, ends, strict=True)]


def repeats_of_groups(rows: DataFrame) -> DataFrame:
    """Repeats among rows (key, doc_id, text_key, start, many, bytes) of one key, from suffix arrays of texts of whole groups."""
    placed = rows.repartition("key").sortWithinPartitions("key")

    def solve(texts: list[tuple]) -> pa.RecordBatch:
        docs = {d: k for k, d in enumerate(sorted({(t[1] is not None, t[1] or 0, t[2]) for t in texts}))}
        found = repeats_in([(docs[t[1] is not None, t[1] or 0, t[2]], t[3], t[4], t[5]) for t in texts]) if texts else []
        arrays = [pa.array([texts[k][1] for k, _, _ in found], pa.int64()), pa.array([texts[k][2] for k, _, _ in found], pa.int64())]
        arrays += [pa.array([texts[k][3] + s for k, s, _ in found], pa.int64()), pa.array([m for *_, m in found], pa.int32())]
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "text_key", "start", "many"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size > TEXT and row[0] != texts[-1][0]:
                    yield solve(texts)
                    texts, size = [], 0
                texts.append(row)
                size += len(row[5])
        yield solve(texts)

    return placed.select("key", "doc_id", "text_key", "start", "many", "bytes").mapInArrow(run, "doc_id bigint, text_key bigint, start bigint, many int")


# ------------------------------------------------------------- documents


def _marks(docs: DataFrame, sent, group: int) -> DataFrame:
    """(d, t, marks) of each document: starts of the segments it owns (0 strings) and its repeats among them (start, strings).

    Shuffle files and tables of a step go with its scratch, so that steps do not add up on disk.
    """
    with scratch(docs.sparkSession):
        found = staged(owners(segments(docs, sent), ["key"]), keep=True)
    meet, repeats = groups_of_owners(found, group)
    repeats += [repeats_of_groups(rows) for rows in meet]
    marks = found.select("doc_id", "text_key", "start", F.lit(0).alias("many"))  # an owner: no repeat in itself
    for more in repeats:
        marks = marks.unionByName(more)
    marks = marks.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("start", "many")).alias("marks"))
    return staged(marks.withColumnsRenamed({"doc_id": "d", "text_key": "t"}), keep=True)


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", group: int = GROUP) -> DataFrame:
    """(doc_id, n_bytes, spans array<struct<begin, end>>, kept binary) for each row of ``df``: its text without repeats.

    A text is its UTF-8 bytes (null: none). A byte goes if it is in a string of LENGTH bytes that also starts earlier: in a
    document with a smaller id (null ids first; of texts with one id, the one with the smaller hash), or further to the
    left. Strings never cross documents. Rows repeated as a whole count as one document, and each is returned. Spans are
    maximal removed runs. Texts of fewer than LENGTH bytes lose nothing; no rows give no rows; other columns are unused.
    """
    docs = df.select(F.col(key).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("text"))
    spark = df.sparkSession
    with scratch(spark):
        sent = spark.sparkContext.broadcast(repeated_grams(docs))
    with scratch(spark):
        marks = _marks(docs, sent, group)
    rows = docs.join(marks, F.expr("doc_id <=> d AND text_key = t"), "left").select("doc_id", "text", "marks")
    schema = "doc_id bigint, n_bytes bigint, spans array<struct<begin: bigint, end: bigint>>, kept binary"
    span = pa.struct([("begin", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice, _ = sent.value
        for batch in batches:
            sizes, spans, kept = [], [], []
            lists = batch.column(2)
            ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy())
            all_starts, all_many = (lists.flatten().field(k).to_numpy() for k in range(2))
            for k, b in enumerate(_texts(batch.column(1))):
                own, more = (x[ends[k - 1] if k else 0 : ends[k]] for x in (all_starts, all_many))
                start, many, _, gram, _ = seeds(b)
                keep = _passes(twice, gram)
                start, many = start[keep], many[keep]
                if len(own):
                    owner = np.append(np.sort(own[more == 0]), -1)
                    other = owner[np.searchsorted(owner[:-1], start)] != start
                    start, many = np.concatenate([start[other], own[more > 0]]), np.concatenate([many[other], more[more > 0]])
                sizes.append(len(b))
                if not len(start):
                    spans.append([])
                    kept.append(b.tobytes())
                    continue
                edge = np.zeros(len(b) + 2, np.int16)  # ranges are disjoint as starts, so no place has two of either kind
                edge[start + 1] += 1
                edge[start + many + LENGTH] -= 1
                gone = np.cumsum(edge, dtype=np.int32) > 0  # with one place before and after the text
                borders = np.flatnonzero(gone[1:] != gone[:-1])
                spans.append([{"begin": x, "end": y} for x, y in zip(borders[::2].tolist(), borders[1::2].tolist(), strict=True)])
                kept.append(b[~gone[1:-1]].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(span)), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    return rows.mapInArrow(run, schema)
