"""Approximate nearest neighbours by inner product: NN-descent builds a neighbour graph, queries search it greedily.

Vectors are held as 8-bit integers with a scale while the graph is built and searched (their products are exact integers,
so every task finds the same value); the neighbours that a query returns are scored again on the original vectors.

Build: vectors that fall on the same sides of random planes meet in cells of bounded size, which gives a first graph. In
each round every node gathers the vectors of its neighbours, old and new, forward and some reverse, and joins them with
each other: neighbours of a node are likely neighbours. Each candidate goes to the node it may serve, which keeps the best.

Search: the pool of a query starts with its own neighbours in the graph (a query that is not in the graph starts from a
few nodes that a hash picks). Each round expands the pool's nodes that were not expanded yet, until there are none.
"""
from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import staged

#: Neighbours of a node, reverse neighbours that join a round, rounds at most, share of new neighbours that ends them.
NEIGHBOURS, REVERSE, ROUNDS, SETTLED = 48, 32, 5, 0.02
#: Vectors of a cell, and how many times vectors are dealt into cells.
CELL, DEALS = 1024, 4
#: Size of a query's pool, rounds of a search at most, nodes where foreign queries start.
POOL, SEARCH_ROUNDS, ENTRIES = 64, 12, 32


def sound_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, vector array<double>) of rows with an id whose vector is not null, not empty, not zero and all finite."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    rows = df.select(F.col(key).cast("bigint").alias("id"), v.alias("vector")).filter("id IS NOT NULL AND vector IS NOT NULL AND size(vector) > 0")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(finite & F.exists("vector", lambda x: x != 0))


def in_bytes(vectors: DataFrame) -> DataFrame:
    """(id, code binary, scale double): the vector divided by scale, as 8-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, scale = [], []
            for x in batch.column(1):
                v = x.values.to_numpy()
                s = float(np.abs(v).max()) / 127
                code.append(np.round(v / s).astype(np.int8).tobytes() if s > 0 else bytes(len(v)))
                scale.append(s)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(code, pa.binary()), pa.array(scale, pa.float64())], names=["id", "code", "scale"])

    return vectors.select("id", "vector").mapInArrow(run, "id bigint, code binary, scale double")


def matrix(codes: pa.Array) -> np.ndarray:
    """Codes of one length as rows of a float matrix; integers this small multiply exactly."""
    n = len(codes)
    ends = np.frombuffer(codes.buffers()[1], dtype=np.int32)[codes.offset : codes.offset + n + 1]
    return np.frombuffer(codes.buffers()[2], dtype=np.int8)[ends[0] : ends[-1]].reshape(n, -1).astype(np.float64)


def per_group(batches: Iterator[pa.RecordBatch], n_keys: int, work: Callable[[pa.Table], list[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """Call ``work`` on the rows of each key; rows of a key follow each other, also across batches."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table]).combine_chunks()
        if table.num_rows == 0:
            continue
        keys = [table.column(k).to_numpy() for k in range(n_keys)]
        change = np.zeros(table.num_rows - 1, bool)
        for k in keys:
            change |= k[1:] != k[:-1]
        at = np.concatenate([[0], np.flatnonzero(change) + 1])
        for a, b in zip(at, at[1:], strict=False):
            yield from work(table.slice(a, b - a))
        rest = table.slice(at[-1])
    if rest is not None and rest.num_rows:
        yield from work(rest)


def _one(column: pa.ChunkedArray) -> pa.Array:
    out = column.combine_chunks()
    return out.chunk(0) if isinstance(out, pa.ChunkedArray) else out


# ------------------------------------------------------------- graph


def first_links(codes: DataFrame, k: int, cell: int, deals: int) -> DataFrame:
    """(v, w, sim) of the best within cells of at most about ``cell`` vectors, in ``deals`` random partitions."""
    n, width = codes.agg(F.count("*"), F.max(F.octet_length("code"))).first()
    bits = max(0, math.ceil(math.log2(max(1, n / cell))))
    planes = np.random.default_rng(17).normal(size=(deals, bits, width or 1))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            side = np.zeros((deals, batch.num_rows), np.int64)
            for r, code in enumerate(batch.column(1)):
                v = np.frombuffer(code.as_buffer(), np.int8)
                side[:, r] = ((planes[:, :, : len(v)] @ v) > 0) @ (1 << np.arange(bits)) if bits else 0
            for d in range(deals):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, d, np.int32)), pa.array(side[d]), *batch.columns], names=["deal", "side", "id", "code", "scale"])

    dealt = staged(codes.mapInArrow(deal, "deal int, side bigint, id bigint, code binary, scale double"))
    cells = dealt.groupBy("deal", "side").agg(F.ceil(F.count("*") / cell).alias("cells"))
    placed = dealt.join(cells, ["deal", "side"]).withColumn("cell", F.pmod(F.xxhash64("id", "deal"), F.col("cells")))
    placed = placed.repartition("deal", "side", "cell").sortWithinPartitions("deal", "side", "cell", "id").select("deal", "side", "cell", "id", "code", "scale")

    def work(t: pa.Table) -> list[pa.RecordBatch]:
        ids, x, scale = t.column(3).to_numpy(), matrix(_one(t.column(4))), t.column(5).to_numpy()
        out = []
        for a in range(0, len(ids), cell):
            sim = x[a : a + cell] @ x.T * scale[a : a + cell, None] * scale[None, :]
            sim[ids[a : a + cell, None] == ids[None, :]] = -np.inf
            top = np.argsort(-sim, axis=1, kind="stable")[:, :k]
            out.append(_links(np.repeat(ids[a : a + cell], top.shape[1]), ids[top].ravel(), np.take_along_axis(sim, top, axis=1).ravel()))
        return out

    return placed.mapInArrow(lambda batches: per_group(batches, 3, work), "v bigint, w bigint, sim double")


def _links(v: np.ndarray, w: np.ndarray, sim: np.ndarray) -> pa.RecordBatch:
    keep = np.isfinite(sim)
    return pa.RecordBatch.from_arrays([pa.array(v[keep]), pa.array(w[keep]), pa.array(sim[keep])], names=["v", "w", "sim"])


def best_links(links: DataFrame, k: int) -> DataFrame:
    """(v, w array, sim array, fresh array): the ``k`` best distinct of rows (v, w, sim, fresh); known ones stay known.

    A task keeps ``k`` of each batch as it goes on, so a node that very many candidates reach needs no more memory.
    """
    placed = links.select("v", "w", "sim", "fresh").repartition("v").sortWithinPartitions("v")

    def top(w: np.ndarray, sim: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.lexsort((fresh, w, -sim))
        w, sim, fresh = w[order], sim[order], fresh[order]
        first = np.concatenate([[True], w[1:] != w[:-1]]) if len(w) else np.zeros(0, bool)
        return w[first][:k], sim[first][:k], fresh[first][:k]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None
        for batch in batches:
            v, w, sim, fresh = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(4))
            at = np.concatenate([[0], np.flatnonzero(v[1:] != v[:-1]) + 1, [len(v)]]) if len(v) else np.zeros(1, int)
            done = []
            for a, b in zip(at, at[1:], strict=False):
                new = (w[a:b], sim[a:b], fresh[a:b])
                if held is not None and v[a] == now:
                    new = tuple(np.concatenate(p) for p in zip(held, new, strict=True))
                elif held is not None:
                    done.append((now, held))
                now, held = v[a], top(*new)
            yield _nodes(done)
        yield _nodes([(now, held)] if held is not None else [])

    return placed.mapInArrow(run, "v bigint, w array<bigint>, sim array<double>, fresh array<boolean>")


def _nodes(done: list) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.bool_())]
    columns = [[d[0] for d in done], *([d[1][c] for d in done] for c in range(3))]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["v", "w", "sim", "fresh"])


def descend(graph: DataFrame, codes: DataFrame, k: int, reverse: int, turn: int) -> DataFrame:
    """One round: each node joins its neighbours with each other; what improves a neighbour's list is offered to it."""
    flat = graph.select("v", F.explode(F.arrays_zip("w", "fresh")).alias("x")).select("v", F.col("x.w").alias("w"), F.col("x.fresh").alias("fresh"))
    back = flat.select(F.col("w").alias("v"), F.col("v").alias("w"), "fresh")
    order = Window.partitionBy("v").orderBy(F.xxhash64("v", "w", F.lit(turn)), "w")
    back = back.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= reverse).drop("rank")
    around = flat.unionByName(back).groupBy("v", "w").agg(F.max("fresh").alias("fresh"))
    full = F.when(F.size("w") >= k, F.array_min("sim")).otherwise(F.lit(float("-inf")))
    known = codes.join(graph.select(F.col("v").alias("id"), full.alias("least")), "id").select(F.col("id").alias("w"), "code", "scale", "least")
    gathered = around.join(known, "w").repartition("v").sortWithinPartitions("v").select("v", "w", "fresh", "code", "scale", "least")

    def work(t: pa.Table) -> list[pa.RecordBatch]:
        fresh = t.column(2).to_numpy()
        if t.num_rows < 2 or not fresh.any():
            return []
        ids, x, scale, least = t.column(1).to_numpy(), matrix(_one(t.column(3))), t.column(4).to_numpy(), t.column(5).to_numpy()
        sim = (x @ x.T) * scale[:, None] * scale[None, :]
        use = (fresh[:, None] | fresh[None, :]) & (sim > least[:, None])
        np.fill_diagonal(use, False)
        a, b = np.nonzero(use)
        return [_links(ids[a], ids[b], sim[a, b])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for out in per_group(batches, 1, work):
            held.append(out)
            rows += out.num_rows
            if rows > 50_000:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, rows = [], 0
        yield from (pa.Table.from_batches(held).combine_chunks().to_batches() if held else [])

    offers = gathered.mapInArrow(run, "v bigint, w bigint, sim double").withColumn("fresh", F.lit(True))
    old = graph.select("v", F.explode(F.arrays_zip("w", "sim")).alias("x")).select("v", "x.w", "x.sim", F.lit(False).alias("fresh"))
    return best_links(old.unionByName(offers), k)


def build_graph(codes: DataFrame, k: int = NEIGHBOURS, reverse: int = REVERSE, rounds: int = ROUNDS, cell: int = CELL, deals: int = DEALS) -> DataFrame:
    """The neighbour graph (v, w array, sim array, fresh array) of vectors (id, code, scale)."""
    graph = staged(best_links(first_links(codes, k, cell, deals).withColumn("fresh", F.lit(True)), k))
    for turn in range(rounds):
        graph = staged(descend(graph, codes, k, reverse, turn))
        new, every = graph.agg(F.sum(F.size(F.filter("fresh", lambda x: x))), F.sum(F.size("fresh"))).first()
        if not every or new <= SETTLED * every:
            break
    return graph


# ------------------------------------------------------------- search


def search(graph: DataFrame, codes: DataFrame, queries: DataFrame, pool: int = POOL, rounds: int = SEARCH_ROUNDS, entries: int = ENTRIES) -> DataFrame:
    """(query_id, pool array<bigint>): the nodes that a greedy search of the graph finds for queries (id, code, scale), best first.

    A query never finds itself. The search of a query ends when every node of its pool has been expanded.
    """
    own = queries.select(F.col("id").alias("query_id")).join(graph.select(F.col("v").alias("query_id"), F.col("w").alias("next")), "query_id", "left")
    start = codes.orderBy(F.xxhash64("id"), "id").limit(entries).agg(F.collect_list("id").alias("entry"))  # one row of ``entries`` ids
    own = own.join(F.broadcast(start)).select("query_id", F.coalesce("next", "entry").alias("next"))
    asked = queries.select(F.col("id").alias("query_id"), F.lit(None).cast("bigint").alias("id"), "code", "scale", F.lit(None).cast("double").alias("sim"), F.lit(False).alias("open"))
    state = None
    for _ in range(rounds):
        near = own.select("query_id", F.explode("next").alias("id")).filter("id <> query_id").distinct()
        rows = near.join(codes, "id").select("query_id", "id", "code", "scale", F.lit(None).cast("double").alias("sim"), F.lit(True).alias("open"))
        rows = rows.unionAll(asked)
        if state is not None:
            held = state.select("query_id", F.explode(F.arrays_zip("ids", "sims")).alias("x"))
            rows = rows.unionAll(held.select("query_id", "x.ids", F.lit(None).cast("binary"), F.lit(None).cast("double"), "x.sims", F.lit(False)))
        state = staged(_pools(rows, pool))
        own = staged(state.select("query_id", F.explode("fresh").alias("v")).join(graph.select("v", "w"), "v").select("query_id", F.col("w").alias("next")))
        if own.isEmpty():
            break
    return state.select("query_id", F.col("ids").alias("pool"))


def _pools(rows: DataFrame, pool: int) -> DataFrame:
    """(query_id, ids, sims, fresh): the best of the old pool and of the candidates; fresh are those to be expanded next."""
    placed = rows.repartition("query_id").sortWithinPartitions("query_id").select("query_id", "id", "code", "scale", "sim", "open")

    def work(t: pa.Table) -> list[pa.RecordBatch]:
        ids, codes, scale, sim = _one(t.column(1)), _one(t.column(2)), t.column(3).to_numpy(), t.column(4).to_numpy().copy()
        asked = ids.is_null().to_numpy(zero_copy_only=False)
        if not asked.any():
            return []
        new = codes.is_valid().to_numpy(zero_copy_only=False) & ~asked
        me = int(np.flatnonzero(asked)[0])
        q = np.frombuffer(codes[me].as_buffer(), np.int8).astype(np.float64)
        if new.any():
            sim[new] = matrix(codes.filter(pa.array(new))) @ q * scale[new] * scale[me]
        node, old = ids.fill_null(0).to_numpy()[~asked], ~new[~asked]
        sim = sim[~asked]
        order = np.lexsort((~old, node, -sim))
        node, sim, old = node[order], sim[order], old[order]
        first = np.concatenate([[True], node[1:] != node[:-1]]) if len(node) else np.zeros(0, bool)
        node, sim, old = node[first][:pool], sim[first][:pool], old[first][:pool]
        columns = [pa.array([t.column(0)[0].as_py()], pa.int64()), pa.array([node], pa.list_(pa.int64())), pa.array([sim], pa.list_(pa.float64())), pa.array([node[~old]], pa.list_(pa.int64()))]
        return [pa.RecordBatch.from_arrays(columns, names=["query_id", "ids", "sims", "fresh"])]

    return placed.mapInArrow(lambda batches: per_group(batches, 1, work), "query_id bigint, ids array<bigint>, sims array<double>, fresh array<bigint>")


def nearest(found: DataFrame, vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best of each pool by the inner product of the original vectors in double precision."""
    pairs = found.select("query_id", F.explode("pool").alias("vec_id"))
    pairs = pairs.join(vectors.select(F.col("id").alias("vec_id"), F.col("vector").alias("a")), "vec_id").join(queries.select(F.col("id").alias("query_id"), F.col("vector").alias("b")), "query_id")
    score = F.aggregate(F.zip_with("a", "b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = pairs.select("query_id", "vec_id", score.alias("score")).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def nearest_neighbours(df: DataFrame, is_query, k: int, key: str = "vec_id", vector: str = "embedding", **build) -> DataFrame:
    """The ``k`` nearest other vectors that are found for each row of ``df`` that ``is_query`` (a condition on ``id``) picks.

    Vectors that are null, empty or zero or hold a null or non-finite component take no part; so do rows without an id and
    vectors of another length than the longest. Of rows with one id the first vector counts. Ties go to the smaller id.
    With no more candidates than a pool holds, all are returned, for then the graph links everything.
    """
    vectors = sound_vectors(df, key, vector).groupBy("id").agg(F.min("vector").alias("vector"))
    vectors = staged(vectors)
    width = vectors.agg(F.max(F.size("vector"))).first()[0] or 0
    vectors = vectors.filter(F.size("vector") == width)
    codes = staged(in_bytes(vectors))
    graph = build_graph(codes, **build)
    found = search(graph, codes, codes.filter(is_query))
    return nearest(found, vectors, vectors.filter(is_query), k)
