"""Benchmark items inside documents, by SimHash fingerprints of item-sized windows.

A window has as many words as the item it is held against (or is the whole text, if that is shorter). Its fingerprint is
the 64-bit SimHash of its word shingles, each weighted by the characters it holds. Items of each size are indexed by the
bits of RADIUS + 1 blocks: two fingerprints within RADIUS bits agree in at least one block, so the index loses none of
them. What it finds within the radius is verified by the exact weighted Jaccard similarity of the shingles.

Only windows that can pass are fingerprinted: the shingles that a window shares with some item of its size must weigh
THRESHOLD of the whole window, else no similarity can reach it. Running sums tell that for every window of a text.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text_arrays import ALPHANUMERIC_WORDS, MULTIPLIER, Words, mix, slices, text_buffers, words

SHINGLE_WORDS = 5
THRESHOLD = 0.8
#: At a similarity of 0.8 a bit differs with probability 0.15; of 64 bits 9.7 do, with a deviation of 2.9.
RADIUS = 24
#: Bytes of item texts that a task holds at a time; more items are handled in several passes over the documents.
ITEM_BYTES = 32 << 20


def weighted_shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and weight (bytes of its words) of the shingle at each word, as if all texts of ``w`` were one."""
    n = len(w.hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.append(0, np.cumsum(w.end - w.begin))
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h = (h + w.hashes[k : k + n]) * MULTIPLIER + np.uint64(k + 1)
    return mix(h + np.uint64(size)), total[size:] - total[: n]


def _bit_sums(hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Running sums, for each of 64 bits, of the weights with the sign of the bit."""
    signs = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int64) * 2 - 1
    out = np.zeros((len(hashes) + 1, 64), np.int64)
    np.cumsum(signs * weights[:, None], axis=0, out=out[1:])
    return out


def _pack(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1).view(np.uint64).ravel()


def simhash(hashes: np.ndarray, weights: np.ndarray) -> np.uint64:
    return _pack(_bit_sums(hashes, weights)[-1:])[0]


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two bags of shingles (hashes, weights)."""
    each, at = np.unique(np.concatenate([a[0], b[0]]), return_inverse=True)
    count = np.zeros((2, len(each)), np.int64)
    np.add.at(count[0], at[: len(a[0])], 1)
    np.add.at(count[1], at[len(a[0]) :], 1)
    weight = np.zeros(len(each), np.int64)
    weight[at] = np.concatenate([a[1], b[1]])
    most = int((count.max(axis=0) * weight).sum())
    return int((count.min(axis=0) * weight).sum()) / most if most else 0.0


class BlockIndex:
    """Fingerprints by the bits of ``radius + 1`` blocks; ``within`` finds all of them within the radius."""

    def __init__(self, prints: np.ndarray, radius: int):
        self.prints, self.radius = prints, radius
        edges = [64 * k // (radius + 1) for k in range(radius + 2)]
        self.masks = [(np.uint64(lo), np.uint64((1 << (hi - lo)) - 1)) for lo, hi in zip(edges, edges[1:], strict=False)]
        self.blocks = []
        for shift, mask in self.masks:
            of: dict[int, list[int]] = {}
            for k, value in enumerate(((prints >> shift) & mask).tolist()):
                of.setdefault(value, []).append(k)
            self.blocks.append({v: np.array(x) for v, x in of.items()})

    def within(self, fingerprint: np.uint64) -> list[tuple[int, int]]:
        """(place, distance) of each fingerprint within the radius."""
        hits = [block[v] for (shift, mask), block in zip(self.masks, self.blocks, strict=True) if (v := int((fingerprint >> shift) & mask)) in block]
        if not hits:
            return []
        near = np.unique(np.concatenate(hits))
        distance = np.bitwise_count(self.prints[near] ^ fingerprint)
        return [(int(k), int(d)) for k, d in zip(near, distance, strict=True) if d <= self.radius]


@dataclass
class SizeClass:
    """The items of one number of words."""

    n_words: int
    ids: list[int]
    bags: list[tuple[np.ndarray, np.ndarray]]
    index: BlockIndex
    known: np.ndarray


class ItemIndex:
    """All items of a pass: by size, and for each shingle length the shingles that some item has."""

    def __init__(self, ids: list[int], texts: list[str], size: int, radius: int):
        data, borders = text_buffers(pa.array(texts, pa.string()))
        by_size: dict[int, list[tuple[int, tuple[np.ndarray, np.ndarray]]]] = {}
        for k, item in enumerate(ids):
            w = words(data, borders[k : k + 2], ALPHANUMERIC_WORDS)
            n = len(w.hashes)
            if n:
                by_size.setdefault(n, []).append((item, weighted_shingles(w, min(size, n))))
        self.size, self.classes, self.known = size, {}, {}
        for n, items in by_size.items():
            bags = [b for _, b in items]
            known = np.unique(np.concatenate([b[0] for b in bags]))
            prints = np.array([simhash(*b) for b in bags], np.uint64)
            self.classes[n] = SizeClass(n, [i for i, _ in items], bags, BlockIndex(prints, radius), known)
        for length in sorted({min(size, n) for n in self.classes}):
            of = [c for n, c in self.classes.items() if min(size, n) == length]
            shingle = np.concatenate([c.known for c in of])
            owner = np.concatenate([np.full(len(c.known), c.n_words) for c in of])
            order = np.argsort(shingle, kind="stable")
            maybe = np.zeros(1 << 16, bool)
            maybe[(shingle & np.uint64(0xFFFF)).astype(np.int64)] = True
            self.known[length] = (shingle[order], owner[order], maybe)

    def matches(self, w: Words, texts: range, threshold: float) -> list[tuple[int, int, int, int, int, float]]:
        """(text, item, first word, words, distance, similarity): the best window of each text for each item."""
        out = []
        for length, (shingle, owner, maybe) in self.known.items():
            h, weight = weighted_shingles(w, length)
            place = np.flatnonzero(maybe[(h & np.uint64(0xFFFF)).astype(np.int64)])
            lo = np.searchsorted(shingle, h[place])
            hit = (lo < len(shingle)) & (shingle[np.minimum(lo, len(shingle) - 1)] == h[place])
            place = place[hit]
            text = np.searchsorted(w.first, place, side="right") - 1
            inside = place + length <= w.first[text + 1]  # not across the border of two texts
            place, text = place[inside], text[inside]
            sizes: dict[int, set[int]] = {}
            for t, p in zip(text.tolist(), place.tolist(), strict=True):
                a = int(np.searchsorted(shingle, h[p]))
                z = int(np.searchsorted(shingle, h[p], side="right"))
                sizes.setdefault(t, set()).update(owner[a:z].tolist())
            for t, of in sizes.items():
                begin, end = int(w.first[t]), int(w.first[t + 1]) - length + 1
                for n in sorted(of):
                    out += [(texts[t], *m) for m in self._windows(self.classes[n], h[begin:end], weight[begin:end], threshold)]
        return out

    def _windows(self, c: SizeClass, h: np.ndarray, weight: np.ndarray, threshold: float) -> list[tuple[int, int, int, int, float]]:
        length = min(self.size, c.n_words)
        per = min(c.n_words - length + 1, len(h))  # shingles of a window
        shared = np.where(np.isin(h, c.known), weight, 0)
        all_weight, shared_weight = np.append(0, np.cumsum(weight)), np.append(0, np.cumsum(shared))
        whole, part = all_weight[per:] - all_weight[:-per], shared_weight[per:] - shared_weight[:-per]
        starts = np.flatnonzero(part >= threshold * whole - 1e-9)
        best: dict[int, tuple[float, int, int]] = {}
        if len(starts):
            lo = int(starts[0])
            sums = _bit_sums(h[lo : int(starts[-1]) + per], weight[lo : int(starts[-1]) + per])
            prints = _pack(sums[starts - lo + per] - sums[starts - lo])
            for s, fingerprint in zip(starts.tolist(), prints, strict=True):
                for k, distance in c.index.within(fingerprint):
                    if k in best and best[k][0] >= 1.0:
                        continue
                    alike = similarity((h[s : s + per], weight[s : s + per]), c.bags[k])
                    if alike >= threshold and (k not in best or alike > best[k][0]):
                        best[k] = (alike, s, distance)
        return [(c.ids[k], s, per + length - 1, distance, alike) for k, (alike, s, distance) in sorted(best.items())]


def _passes(items: DataFrame, most_bytes: int) -> Iterator[tuple[list[int], list[str]]]:
    """Items in parts of bounded size, by a hash of their id; each part is a job of its own, so the driver holds one."""
    items = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").filter("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    total = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    parts = max(1, -(-2 * int(total) // most_bytes) if total > most_bytes else 1)
    for p in range(parts):
        part = items if parts == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p)
        rows = part.orderBy("item_id", "text").collect()
        if rows:
            yield [r.item_id for r in rows], [r.text for r in rows]


def contaminated(docs: DataFrame, items: DataFrame, keys: list[str] | None = None, size: int = SHINGLE_WORDS, threshold: float = THRESHOLD, radius: int = RADIUS, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """Rows (keys..., item_id, word_at, n_words, distance, similarity): the best window of a text for each item in it.

    Words are runs of ASCII letters, digits and non-ASCII bytes, A-Z lower-cased. Items without words or id, and null or
    empty texts, match nothing. An item with fewer than ``size`` words is one shingle. Repeated rows are reported one by
    one; repeated items once. Ties take the first window. No shuffle of the documents.
    """
    keys = keys or ["doc_id"]
    rows = docs.select(*keys, "text")
    schema = rows.select(*keys, F.lit(0).cast("bigint").alias("item_id"), F.lit(0).cast("bigint").alias("word_at"), F.lit(0).cast("bigint").alias("n_words"), F.lit(0).alias("distance"), F.lit(0.0).alias("similarity")).schema
    out = docs.sparkSession.createDataFrame([], schema)
    for ids, texts in _passes(items, item_bytes):
        shipped = docs.sparkSession.sparkContext.broadcast((ids, texts))

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            index = ItemIndex(*shipped.value, size, radius)
            for batch in batches:
                data, borders = text_buffers(batch.column(len(keys)))
                found = []
                for lo, hi in slices(borders):
                    found += index.matches(words(data, borders[lo : hi + 1], ALPHANUMERIC_WORDS), range(lo, hi), threshold)
                at = pa.array([m[0] for m in found], pa.int64())
                columns = [pa.array([m[k] for m in found], kind) for k, kind in ((1, pa.int64()), (2, pa.int64()), (3, pa.int64()), (4, pa.int32()), (5, pa.float64()))]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(len(keys))), *columns], names=schema.names)

        out = out.unionAll(rows.mapInArrow(run, schema))
    return out
