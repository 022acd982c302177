"""Jaccard self-join of word n-gram sets with a prefix tree, and the components of its links.

Sets are ordered by one global order (the n-grams' hashes). Equal sets are combined first.

Candidates. Sets of up to L n-grams with similarity of at least t differ in at most d = L (1 - t) / t n-grams. Cut the
global order into more than d ranges: at least one range then holds the same n-grams in both sets. Each set emits a key
for the content of every range, under cuts for its own class of sizes and for the class below (a class spans 1 / t, so
partners are in neighbouring classes). Empty ranges are emitted only by sets with more of them than the spare ranges,
where alone they can matter. So every link shares a key, and sets that only share a passage share hardly any.

Groups that share sets are merged (by their ids alone) as long as the merged group fits one block, so a set is sent to one
task only. What does not fit stays in its groups, where those of the same members count once. Groups too large for a
block are cut into blocks that all hold the group's hub (its first set). Each block is joined by a prefix tree, which
its sets walk together, and reports links that connect it, not all pairs. Groups cut into blocks whose sets are still in
several components are joined block against block. So no link between components is lost, and copies never expand into
all pairs.
"""
from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .staging import scratch, staged, text_key
from .text_arrays import WHITE_SPACE_WORDS, mix, shingles, slices, text_buffers, words

#: n-grams of a block of a group (8 bytes each); a set counts as so many more, which bounds the sets of a block too.
BLOCK_NGRAMS, SET_COST = 1 << 18, 300


# ------------------------------------------------------------- candidate keys


@lru_cache(maxsize=None)
def class_edges(percent: int, upto: int) -> tuple[int, ...]:
    """Smallest sizes of the classes; a set and its partners are in one class or in neighbouring ones."""
    edges = [1]
    while edges[-1] <= upto:
        edges.append(edges[-1] * 100 // percent + 1)
    return tuple(edges)


@lru_cache(maxsize=4096)
def cut(percent: int, label: int) -> tuple[int, int, np.ndarray]:
    """Most differing n-grams, spare ranges and range borders under the cuts of class ``label``."""
    n = 1
    for _ in range(label):
        n = n * 100 // percent + 1
    largest = n * 100 // percent  # of class ``label``
    d = largest * (100 - percent) // percent
    empty = (d + 1) * math.exp(-percent * percent / (100 * (100 - percent)))  # expected empty ranges of the smallest sets
    spare = max(1, math.ceil(empty + 4 * math.sqrt(empty)))
    ranges = d + 1 + spare
    return d, spare, np.array([(k << 64) // ranges for k in range(1, ranges)], dtype=np.uint64)


def candidate_keys(ngrams: np.ndarray, percent: int) -> np.ndarray:
    """Keys of a sorted set; two different sets with the similarity share one."""
    n = len(ngrams)
    if n == 0:
        return np.zeros(0, np.int64)
    own = int(np.searchsorted(class_edges(percent, 1 << max(10, n.bit_length())), n, side="right")) - 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(ngrams), out=total[1:])
    out = []
    for label in (own - 1, own):
        if label < 0:
            continue
        d, spare, borders = cut(percent, label)
        if d == 0:
            continue  # such sets are similar only if equal
        at = np.concatenate([[0], np.searchsorted(ngrams, borders), [n]])
        inside = np.diff(at)
        use = inside > 0
        if (~use).sum() > spare:
            use[:] = True
        k = np.flatnonzero(use)
        out.append(mix((total[at[k + 1]] - total[at[k]]) + mix((k + 1).astype(np.uint64) * np.uint64(0x1F123BB5) + np.uint64(label << 40))))
    return np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)


def ngram_sets(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted set of n-gram hashes) for each text of a column."""
    data, borders = text_buffers(column)
    for lo, hi in slices(borders):
        w = words(data, borders[lo : hi + 1], WHITE_SPACE_WORDS)
        for t in range(hi - lo):
            yield lo + t, np.unique(shingles(w.hashes[w.first[t] : w.first[t + 1]], size))


def _set_key(ngrams: np.ndarray) -> tuple[int, int]:
    if len(ngrams) == 0:
        return 0, 0
    a, b = mix(ngrams).sum(dtype=np.uint64), mix(ngrams ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int((b + np.uint64(len(ngrams))).view(np.int64))


def sets_with_keys(docs: DataFrame, size: int, percent: int | None) -> DataFrame:
    """(doc_id, text_key1, text_key2, n, set1, set2, keys) for each document; no keys without a similarity."""
    schema = "doc_id bigint, text_key1 bigint, text_key2 bigint, n bigint, set1 bigint, set2 bigint, keys array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, one, two, keys = [], [], [], []
            for _, s in ngram_sets(batch.column(3), size):
                a, b = _set_key(s)
                n.append(len(s))
                one.append(a)
                two.append(b)
                keys.append(candidate_keys(s, percent) if percent else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                                             names=["doc_id", "text_key1", "text_key2", "n", "set1", "set2", "keys"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *text_key(), "text").mapInArrow(run, schema)


def sets_of(rows: DataFrame, size: int) -> DataFrame:
    """(set_id, ngrams) from rows (set_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.view(np.int64) for _, s in ngram_sets(batch.column(1), size)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["set_id", "ngrams"])

    return rows.select("set_id", "text").mapInArrow(run, "set_id bigint, ngrams array<bigint>")


# ------------------------------------------------------------- prefix tree


@dataclass
class Node:
    """An edge of the tree with the n-grams it holds, and bounds on the sizes of the sets below."""

    ngrams: np.ndarray
    depth: int
    least: int
    most: int
    ends: list[int] = field(default_factory=list)
    children: list[Node] = field(default_factory=list)


def prefix_tree(sets: list[np.ndarray]) -> Node:
    """The tree of all sets in the global order; shared beginnings are stored once."""
    order = sorted(range(len(sets)), key=lambda k: sets[k].astype(">u8").tobytes())

    def build(lo: int, hi: int, depth: int) -> Node:
        members = order[lo:hi]
        first, last = sets[members[0]], sets[members[-1]]
        short = min(len(first), len(last))
        same = first[depth:short] == last[depth:short]
        shared = depth + (int(np.argmin(same)) if not same.all() else short - depth)
        sizes = [len(sets[k]) for k in members]
        node = Node(first[depth:shared], shared, min(sizes), max(sizes))
        at = lo
        while at < hi and len(sets[order[at]]) == shared:
            node.ends.append(order[at])
            at += 1
        while at < hi:
            token, to = sets[order[at]][shared], at + 1
            while to < hi and sets[order[to]][shared] == token:
                to += 1
            todo.append((node, at, to, shared))
            at = to
        return node

    todo: list[tuple[Node, int, int, int]] = []
    root = build(0, len(order), 0)
    while todo:
        parent, lo, hi, depth = todo.pop()
        parent.children.append(build(lo, hi, depth))
    return root


#: Cells (n-gram, set) of the table in which sets are probed together; n-grams between two counts of what a set has left.
PROBED, STRIDE = 1 << 25, 64


def similar_pairs(xs: list[np.ndarray], root: Node, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """(set of the tree, those of ``xs`` with Jaccard similarity of ``percent`` or more to it), by one walk for all ``xs``.

    The overlap of a path is counted once for all sets below it, for all ``xs`` at once. A set leaves a subtree if no size
    that the subtree holds can still reach the overlap it needs from what is left of the set and of the tree's sets.
    """
    size = np.array([len(x) for x in xs])
    ngrams, of = np.unique(np.concatenate(xs), return_inverse=True)
    holds = np.zeros((len(ngrams), len(xs)), bool)
    holds[of, np.repeat(np.arange(len(xs)), size)] = True
    before = np.zeros((-(-len(ngrams) // STRIDE) + 1, len(xs)), np.int64)
    np.cumsum(np.add.reduceat(holds, np.arange(0, len(ngrams), STRIDE), axis=0, dtype=np.int64), axis=0, out=before[1:])
    todo = [(root, np.arange(len(xs)), np.zeros(len(xs), np.int64))]
    while todo:
        node, x, overlap = todo.pop()
        left = size[x]
        if len(node.ngrams):
            at = np.searchsorted(ngrams, node.ngrams)
            at = at[ngrams[np.minimum(at, len(ngrams) - 1)] == node.ngrams]
            overlap = overlap + (holds[at] if len(x) == len(xs) else holds[np.ix_(at, x)]).sum(axis=0, dtype=np.int32)
            left = left - before[np.searchsorted(ngrams, node.ngrams[-1], side="right") // STRIDE, x]
        best = np.minimum(np.maximum(node.depth + left, node.least), node.most)  # the size that comes nearest
        stay = (100 + percent) * (overlap + np.minimum(best - node.depth, left)) >= percent * (size[x] + best)
        x, overlap = x[stay], overlap[stay]
        if len(x) == 0:
            continue
        if node.ends:
            similar = x[(100 + percent) * overlap >= percent * (size[x] + node.depth)]
            yield from ((k, similar) for k in node.ends)
        todo.extend((child, x, overlap) for child in node.children)


def similar_to(x: np.ndarray, root: Node, percent: int) -> list[int]:
    """Sets of the tree with Jaccard similarity of ``percent`` or more to ``x``."""
    return [k for k, found in similar_pairs([x], root, percent) if len(found)]


def prefix_length(n: int, percent: int) -> int:
    """N-grams at the start of a set of ``n`` of which each partner has one among its own first ones.

    A partner has n * percent / 100 n-grams at least, and the overlap it needs leaves fewer than this many out.
    """
    smallest = -(-percent * n // 100)
    return n + (-percent * (n + smallest) // (100 + percent)) + 1


def related(sets: list[np.ndarray], percent: int) -> list[list[int]]:
    """Sets that prefixes connect: no two similar sets are apart. Sets without a partner are left out."""
    owner = np.repeat(np.arange(len(sets)), [prefix_length(len(s), percent) for s in sets])
    first = np.concatenate([s[: prefix_length(len(s), percent)] for s in sets])
    order = np.argsort(first, kind="stable")
    first, owner = first[order], owner[order]
    same = np.flatnonzero(first[1:] == first[:-1])
    parent = list(range(len(sets)))
    for a, b in np.unique(np.stack([owner[same], owner[same + 1]], axis=1), axis=0).tolist():
        while parent[a] != a:
            parent[a] = a = parent[parent[a]]
        while parent[b] != b:
            parent[b] = b = parent[parent[b]]
        parent[max(a, b)] = min(a, b)
    out: dict[int, list[int]] = {}
    for k in range(len(sets)):
        a = k
        while parent[a] != a:
            a = parent[a]
        parent[k] = a
        out.setdefault(a, []).append(k)
    return [members for members in out.values() if len(members) > 1]


#: Sets that are probed before the component whose members need no further probes is chosen.
FIRST_PROBES = 16


def connecting_links(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that connect what all links connect; a tree holds only sets that prefixes connect."""
    if len(sets) < 2:
        return []
    return [(members[a], members[b]) for members in related(sets, percent) for a, b in _links_in_tree([sets[k] for k in members], percent)]


def _links_in_tree(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that connect what all links connect.

    A link between two components has an end outside any given component. So once the largest component after a few
    probes is chosen, its members need no probe of their own, and a group of copies takes few probes.
    """
    label, root, links = np.arange(len(sets)), prefix_tree(sets), []

    def probe(xs: np.ndarray) -> None:
        while len(xs):
            cells = np.cumsum([len(sets[x]) for x in xs]) * np.arange(1, len(xs) + 1)
            now, xs = np.split(xs, [max(1, int(np.searchsorted(cells, PROBED, side="right")))])
            for y, found in similar_pairs([sets[x] for x in now], root, percent):
                found = now[found]
                found = found[label[found] != label[y]]
                for x in found[np.unique(label[found], return_index=True)[1]] if len(found) else ():
                    label[label == label[x]] = label[y]
                    links.append((int(x), y))

    probe(np.arange(min(FIRST_PROBES, len(sets))))
    rest = np.arange(FIRST_PROBES, len(sets))
    probe(rest[label[rest] != np.bincount(label).argmax()])
    return links


# ------------------------------------------------------------- the join


def _links_of_groups(rows: DataFrame, by: list[str], percent: int) -> DataFrame:
    """Connecting links (a, b) within each group of rows (by..., set_id, ngrams); a task holds one group at a time."""
    placed = rows.repartition(*by).sortWithinPartitions(*by, "set_id").select(*by, "set_id", "ngrams")
    n_by = len(by)

    def links(group: dict[int, np.ndarray]) -> list[tuple[int, int]]:
        ids = list(group)
        return [(ids[x], ids[y]) for x, y in connecting_links([group[k] for k in ids], percent)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, at = {}, None
        for batch in batches:
            out = []
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(n_by)), strict=True))
            ids, sets = batch.column(n_by).to_pylist(), batch.column(n_by + 1)
            values, borders = sets.values.to_numpy(), sets.offsets.to_numpy()
            for k, key in enumerate(keys):
                if key != at:
                    out += links(group)
                    group, at = {}, key
                group[ids[k]] = values[borders[k] : borders[k + 1]].view(np.uint64).copy()
            yield _pairs(out)
        yield _pairs(links(group))

    return placed.mapInArrow(run, "a bigint, b bigint")


def _pairs(out: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])


#: Bits of the filter that keys pass before they are joined: 8 MiB at every size of the input. When it fills up at very
#: large inputs it lets more keys through, and the join still decides.
FILTER_BITS = 1 << 26


def _maybe_shared(sets: DataFrame, shared: DataFrame) -> DataFrame:
    """(set_id, key) of the keys whose bit is set by a shared key."""
    slot = F.pmod(F.col("key"), F.lit(FILTER_BITS)) + 1
    bits = shared.select(F.bitmap_bucket_number(slot).alias("bucket"), F.bitmap_bit_position(slot).alias("bit"))
    parts = bits.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()  # at most FILTER_BITS bits
    table = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in parts:
        at = (r.bucket - 1) * len(r.bits)
        table[at : at + len(r.bits)] = np.frombuffer(bytes(r.bits), np.uint8)
    sent = sets.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for batch in batches:
            owner = np.repeat(batch.column(0).to_numpy(), batch.column(1).value_lengths().fill_null(0).to_numpy())
            key = batch.column(1).flatten().to_numpy()
            at = np.mod(key, FILTER_BITS)
            keep = (table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
            yield pa.RecordBatch.from_arrays([pa.array(owner[keep]), pa.array(key[keep])], names=["set_id", "key"])

    return sets.select("set_id", "keys").mapInArrow(run, "set_id bigint, key bigint")


def candidate_groups(sets: DataFrame, block_ngrams: int) -> DataFrame:
    """Members (group, set_id, hub) of groups in which every two sets that share a key meet."""
    keys = sets.select(F.explode("keys").alias("key"))
    shared = staged(keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"))
    members = staged(_maybe_shared(sets, shared).join(shared, "key"))
    seal = F.bit_xor(F.xxhash64("set_id")).alias("seal")
    groups = members.groupBy("key").agg(F.count("*").alias("n"), seal, F.min("set_id").alias("hub"), F.max("set_id").alias("last"))
    groups = groups.groupBy("n", "seal", "hub", "last").agg(F.min("key").alias("key"))
    groups = staged(members.join(groups.select("key", "hub"), "key").select(F.col("key").alias("group"), "set_id", "hub"))
    merged = components(groups.select(F.col("hub").alias("a"), F.col("set_id").alias("b")))
    merged = staged(merged.join(sets.select(F.col("set_id").alias("node"), "n"), "node"))
    fits = staged(merged.groupBy("component").agg(F.sum(F.col("n") + SET_COST).alias("total")).filter(F.col("total") <= block_ngrams).select("component"))
    whole = merged.join(fits, "component").select(F.col("component").alias("group"), F.col("node").alias("set_id"), F.col("component").alias("hub"))
    rest = merged.join(fits, "component", "left_anti").select(F.col("node").alias("set_id"))
    return whole.unionByName(groups.join(rest, "set_id", "left_semi"))


def linked_sets(docs: DataFrame, sets: DataFrame, groups: DataFrame, size: int, percent: int, block_ngrams: int = BLOCK_NGRAMS) -> DataFrame:
    """(node, component) of the set_ids that have a similar set. ``sets``: set_id, doc_id, text_key1/2 (of one of its documents), n."""
    wanted = groups.select("set_id").distinct().join(sets.select("set_id", "doc_id", "text_key1", "text_key2"), "set_id").alias("w")
    keyed = docs.select("doc_id", "text", *text_key()).alias("d")
    same = (F.col("d.text_key1") == F.col("w.text_key1")) & (F.col("d.text_key2") == F.col("w.text_key2")) & F.col("d.doc_id").eqNullSafe(F.col("w.doc_id"))
    texts = keyed.join(wanted, same).select("w.set_id", "d.text").dropDuplicates(["set_id"])
    ngrams = staged(sets_of(texts, size))
    sizes = groups.join(sets.select("set_id", "n"), "set_id")
    blocks = sizes.groupBy("group").agg(F.ceil(F.sum(F.col("n") + SET_COST) / block_ngrams).alias("blocks"))
    placed = groups.join(blocks, "group").withColumn("block", F.when(F.col("blocks") == 1, F.lit(0).cast("bigint")).otherwise(F.pmod(F.xxhash64("set_id"), F.col("blocks"))))
    hubs = placed.filter("blocks > 1").select("group", F.col("hub").alias("set_id"), "hub", "blocks", "block").distinct()
    placed = staged(placed.unionByName(hubs).distinct())
    known = staged(components(_links_of_groups(placed.join(ngrams, "set_id"), ["group", "block"], percent)))
    rows = placed.filter("blocks > 1").join(known.withColumnRenamed("node", "set_id"), "set_id", "left")
    rows = staged(rows.select("group", "block", "set_id", F.coalesce("component", "set_id").alias("component")))
    pairs = staged(_open_pairs(rows))
    if pairs.isEmpty():
        return known
    sides = pairs.select("*", F.col("block_a").alias("block")).union(pairs.select("*", "block_b"))
    more = _links_of_groups(sides.join(rows, ["group", "block"]).join(ngrams, "set_id"), ["group", "block_a", "block_b"], percent)
    return components(known.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))


def _open_pairs(rows: DataFrame) -> DataFrame:
    """(group, block_a, block_b): the pairs of blocks of a group that are not in one component yet."""
    ends = rows.groupBy("group", "block").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    a, b = ends.select("group", F.col("block").alias("block_a"), F.col("low").alias("low_a"), F.col("high").alias("high_a")), ends.select("group", F.col("block").alias("block_b"), "low", "high")
    return a.join(b, "group").filter("block_a < block_b AND NOT (low_a = high_a AND low = high AND low = low_a)").select("group", "block_a", "block_b")


def similarity_components(docs: DataFrame, size: int, percent: int, block_ngrams: int = BLOCK_NGRAMS) -> DataFrame:
    """(doc_id, text_key1, text_key2, n_shingles, component_id) for each row of ``docs`` (doc_id, text).

    Words are runs of non-white-space with A-Z lower-cased; a text with fewer than ``size`` words is one n-gram. Texts
    link if 100 * intersection >= ``percent`` * union; component_id is the smallest doc_id that links reach. Null, empty
    and white-space texts have no n-gram, no link, and their own doc_id. A null doc_id counts as larger than every id and
    never names a component that has another id. Repeated rows are equal texts, hence linked. Other columns are unused.
    """
    rows = staged(sets_with_keys(docs, size, None).drop("keys"))
    with scratch(docs.sparkSession):
        per_set = staged(_components_of_sets(docs, size, percent, block_ngrams), keep=True)
    out = rows.select("doc_id", "text_key1", "text_key2", F.col("n").alias("n_shingles"), "set1", "set2")
    out = out.filter("n_shingles > 0").join(per_set, ["set1", "set2"]).unionByName(out.filter("n_shingles = 0").withColumn("component_id", F.col("doc_id")))
    return out.select("doc_id", "text_key1", "text_key2", "n_shingles", "component_id")


def _sets_and_groups(docs: DataFrame, size: int, percent: int, block_ngrams: int) -> tuple[DataFrame, DataFrame]:
    """The distinct sets and their candidate groups; the keys, the largest table of the join, go with the caller's scratch."""
    rows = sets_with_keys(docs, size, percent)
    one = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key1", "text_key2")
    sets = rows.filter("n > 0").groupBy("set1", "set2").agg(F.min(one).alias("one"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    sets = staged(sets.select("set1", "set2", "n", "keys", "one.doc_id", "one.text_key1", "one.text_key2").withColumn("set_id", F.monotonically_increasing_id()))
    return staged(sets.drop("keys"), keep=True), staged(candidate_groups(sets, block_ngrams), keep=True)


def _components_of_sets(docs: DataFrame, size: int, percent: int, block_ngrams: int) -> DataFrame:
    """(set1, set2, component_id) of each distinct set."""
    with scratch(docs.sparkSession):
        sets, groups = _sets_and_groups(docs, size, percent, block_ngrams)
    with scratch(docs.sparkSession):
        known = staged(linked_sets(docs, sets, groups, size, percent, block_ngrams), keep=True)
    named = sets.join(known.withColumnRenamed("node", "set_id"), "set_id")
    ids = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    linked = named.join(ids, "component").select("set1", "set2", "component_id")
    return sets.select("set1", "set2", "doc_id").join(linked, ["set1", "set2"], "left").select("set1", "set2", F.coalesce("component_id", "doc_id").alias("component_id"))
