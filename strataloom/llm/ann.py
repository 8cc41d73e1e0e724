"""Approximate nearest neighbours by inner product: one HNSW graph per shard, results merged.

A shard holds a bounded number of vectors. Its graph is a set of flat arrays: vectors, and for each
layer a matrix of neighbour numbers padded with -1. Points are inserted in batches: a batch searches
the graph built so far, and its own members, for candidates; neighbours are chosen so that none is
closer to a kept neighbour than to the point, and linked both ways. All searches advance a whole
batch of queries per step.

Inner product is no metric, so a coordinate that gives all points of a shard the same length is added
(zero for queries): the order by inner product with a query then is the order by angle. So that this
coordinate stays small, a shard holds vectors of one dimension and one band of lengths, a factor of ``BAND`` wide.
Vectors that are equal share one point.

A task takes a block of queries through its group of shards, one after the other, and keeps the best
results of each query so far by exact score; the results of these tasks are merged in a last step. In every shard
the first queries of the block are also answered exactly; the search widens until it finds ``RECALL`` of those
answers, at worst until it visits every point.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataloom.llm.common import keep
from strataloom.materialize import broadcast_if_small

SHARD_ROWS = 5_000
LINKS = 16  # per point in the upper layers; twice that in the lowest
BUILD_WIDTH = 64
SEARCH_WIDTH = 64  # at first
RECALL = 0.97  # share of exact answers that a search finds in a shard before it stops widening
SAMPLE = 64  # queries of a block that are answered exactly
BAND = 2 ** 0.5
QUERY_BLOCK = 4_096  # queries that a task takes through its shards
SHARDS_A_TASK = 64
_BATCH = 256
_AT_ONCE = 512  # queries that advance together


def _choose(sims: np.ndarray, among: np.ndarray, most: int) -> np.ndarray:
    """Which candidates to keep, for rows of candidates in falling order of ``sims``.

    ``among[i, a, b]``: similarity of candidates a and b of row i. Candidates with sims of -inf are
    none. Those that were passed over fill up what room is left.
    """
    rows, width = sims.shape
    taken = np.zeros((rows, width), bool)
    for c in range(width):
        shadowed = ((among[:, c, :] >= sims[:, c, None]) & taken).any(axis=1)
        taken[:, c] = ~shadowed & np.isfinite(sims[:, c]) & (taken.sum(axis=1) < most)
    spare = np.isfinite(sims) & ~taken
    room = most - taken.sum(axis=1)
    return taken | (spare & (np.cumsum(spare, axis=1) <= room[:, None]))


class Graph:
    """HNSW over the rows of ``points``; ``layers[l]`` lists neighbours in layer ``l`` for every point."""

    def __init__(self, points: np.ndarray, links: int = LINKS, build_width: int = BUILD_WIDTH, seed: int = 0):
        n = len(points)
        points = points.astype(np.float64) / (np.abs(points).max(initial=0.0) or 1.0)
        norms = (points ** 2).sum(axis=1)
        extra = np.sqrt(np.maximum(norms.max(initial=0.0) - norms, 0.0))
        self.points = np.concatenate([points, extra[:, None]], axis=1).astype(np.float32)
        draws = np.random.default_rng(seed).random(n)
        height = np.floor(-np.log(np.maximum(draws, 1e-12)) / np.log(links)).astype(np.int64)
        self.order = np.argsort(-height, kind="stable")  # upper layers are complete before lower ones need them
        self.layers = [np.full((n, 2 * links if layer == 0 else links), -1, np.int32) for layer in range(int(height.max(initial=0)) + 1)]
        self.height, self.entry = height, int(self.order[0]) if n else -1
        for at in range(1, n, _BATCH):
            self._insert(self.order[at:at + _BATCH], self.order[:at], build_width)

    def _sims(self, x: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return np.einsum("qd,qkd->qk", x, self.points[ids])

    def _search(self, x: np.ndarray, start: np.ndarray, layer: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` best points found for each row of ``x``, best first; -1 and -inf as padding."""
        links, q = self.layers[layer], np.arange(len(x))
        seen = np.zeros((len(x), len(self.points) + 1), bool)  # the last column stands for -1
        seen[:, -1] = True
        ids = np.full((len(x), width), -1, np.int64)
        sims = np.full((len(x), width), -np.inf, np.float32)
        fresh = np.zeros((len(x), width), bool)
        ids[:, 0], sims[:, 0], fresh[:, 0] = start, self._sims(x, start[:, None])[:, 0], True
        seen[q, start] = True
        while len(open_ := np.flatnonzero(fresh.any(axis=1))):
            at = fresh[open_].argmax(axis=1)  # rows are sorted: the best that was not expanded
            fresh[open_, at] = False
            near = links[ids[open_, at]].astype(np.int64)
            new = ~seen[open_[:, None], near]
            seen[open_[:, None], near] = True
            s = np.where(new, self._sims(x[open_], near), -np.inf).astype(np.float32)
            all_s = np.concatenate([sims[open_], s], axis=1)
            best = np.argsort(-all_s, axis=1, kind="stable")[:, :width]
            ids[open_] = np.take_along_axis(np.concatenate([ids[open_], np.where(new, near, -1)], axis=1), best, axis=1)
            sims[open_] = np.take_along_axis(all_s, best, axis=1)
            fresh[open_] = np.take_along_axis(np.concatenate([fresh[open_], new], axis=1), best, axis=1)
            fresh[open_] &= ids[open_] >= 0
        return ids, sims

    def _insert(self, new: np.ndarray, old: np.ndarray, width: int) -> None:
        x = self.points[new]
        start = np.full(len(new), self.entry)
        own = x @ x.T
        for layer in range(len(self.layers) - 1, -1, -1):
            inside = self.height[new] >= layer
            if layer and not inside.any():
                start = self._search(x, start, layer, 1)[0][:, 0]
                continue
            ids, sims = self._search(x, start, layer, width)
            start = ids[:, 0]
            # members of the batch that are in this layer are candidates of each other
            mates = np.where(inside[None, :] & ~np.eye(len(new), dtype=bool), own, -np.inf)
            part = np.argsort(-mates, axis=1, kind="stable")[:, :width // 2]
            ids = np.concatenate([ids, new[part]], axis=1)[inside]
            sims = np.concatenate([sims, np.take_along_axis(mates, part, axis=1)], axis=1)[inside]
            self._link(new[inside], ids, sims, layer, width)

    def _pick(self, ids: np.ndarray, sims: np.ndarray, most: int, width: int) -> np.ndarray:
        best = np.argsort(-sims, axis=1, kind="stable")[:, :width]
        ids, sims = np.take_along_axis(ids, best, axis=1), np.take_along_axis(sims, best, axis=1)
        p = self.points[ids]
        taken = _choose(sims, np.einsum("qad,qbd->qab", p, p), most)
        front = np.argsort(~taken, axis=1, kind="stable")[:, :most]
        out = np.take_along_axis(np.where(taken, ids, -1), front, axis=1)
        return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)

    def _link(self, new: np.ndarray, ids: np.ndarray, sims: np.ndarray, layer: int, width: int) -> None:
        links = self.layers[layer]
        most = links.shape[1]
        chosen = self._pick(ids, sims, most // 2 if layer == 0 else most, width)
        links[new, :chosen.shape[1]] = chosen
        # the other way: every chosen point picks anew among its neighbours and the points that chose it
        source = np.repeat(new, chosen.shape[1])[chosen.ravel() >= 0]
        target = chosen.ravel()[chosen.ravel() >= 0]
        if not len(target):
            return
        sim = np.einsum("kd,kd->k", self.points[source], self.points[target])
        at = np.lexsort((-sim, target))
        source, target = source[at], target[at]
        points, first, count = np.unique(target, return_index=True, return_counts=True)
        rank = np.arange(len(target)) - np.repeat(first, count)
        come = np.full((len(points), most), -1, np.int64)  # the nearest are enough: no more can be kept
        fits = rank < most
        come[np.repeat(np.arange(len(points)), count)[fits], rank[fits]] = source[fits]
        both = np.concatenate([links[points].astype(np.int64), come], axis=1)
        twice = (both[:, :, None] == both[:, None, :]) & np.tri(both.shape[1], k=-1, dtype=bool)
        both = np.where(twice.any(axis=2), -1, both)
        sims = np.where(both >= 0, self._sims(self.points[points], both), -np.inf)
        links[points] = self._pick(both, sims, most, both.shape[1])

    def search(self, queries: np.ndarray, k: int, width: int = SEARCH_WIDTH) -> np.ndarray:
        """Point numbers of about the ``k`` largest inner products per query, -1 as padding."""
        x = np.concatenate([queries, np.zeros((len(queries), 1))], axis=1).astype(np.float32)
        start = np.full(len(x), self.entry)
        for layer in range(len(self.layers) - 1, 0, -1):
            start = self._search(x, start, layer, 1)[0][:, 0]
        return self._search(x, start, 0, max(width, k))[0][:, :k]

    def arrays(self) -> dict[str, np.ndarray]:
        return {"points": self.points, "entry": np.array([self.entry]), **{f"layer{i}": x for i, x in enumerate(self.layers)}}

    @classmethod
    def of(cls, points: np.ndarray, entry: int, layers: list[np.ndarray]) -> Graph:
        graph = cls.__new__(cls)
        graph.points, graph.entry, graph.layers = points, entry, layers
        return graph


def _build(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """One row: the graph of one shard, which is the whole partition, as flat arrays."""
    found = [b for b in batches if b.num_rows]
    if not found:
        return
    table = pa.Table.from_batches(found)
    dim = table["dim"][0].as_py()
    ids = table["vec_id"].to_numpy()
    vectors = table["v"].combine_chunks().flatten().to_numpy().reshape(-1, dim)
    at = np.argsort(ids, kind="stable")
    ids, vectors = ids[at], vectors[at]
    points, which = np.unique(vectors, axis=0, return_inverse=True)
    graph = Graph(points)
    # of equal vectors only the smallest identifiers can be among a query's k nearest
    by = np.argsort(which.ravel(), kind="stable")
    point = which.ravel()[by]
    rank = np.arange(len(point)) - np.searchsorted(point, point)
    by, point = by[rank <= k], point[rank <= k]
    yield pa.record_batch({
        "shard": table["shard"][:1].combine_chunks(), "dim": table["dim"][:1].combine_chunks(), "points": pa.array([points.astype("<f8").tobytes()], pa.binary()),
        "lifted": pa.array([graph.points.tobytes()], pa.binary()), "entry": pa.array([graph.entry], pa.int64()),
        "layers": pa.array([[x.tobytes() for x in graph.layers]], pa.list_(pa.binary())),
        "widths": pa.array([[x.shape[1] for x in graph.layers]], pa.list_(pa.int32())),
        "member_point": pa.array([point.tolist()], pa.list_(pa.int64())), "member_id": pa.array([ids[by].tolist()], pa.list_(pa.int64())),
    })


_SHARD = "shard int, dim int, points binary, lifted binary, entry long, layers array<binary>, widths array<int>, member_point array<long>, member_id array<long>"
_FOUND = "query_id long, vec_id long, score double"


def _visit(batches: Iterator[pa.RecordBatch], k: int, width: int) -> Iterator[pa.RecordBatch]:
    """The ``k`` best of each query over the shards of its task.

    Rows are sorted by task and shard; the queries of a task stand before its shards, as shard -1.
    """
    task = best = None
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(name)[i] for name in batch.schema.names}
            if row["task"].as_py() != task:
                if best is not None:
                    yield _rows(query_ids, best)
                task, best = row["task"].as_py(), None
            dim = row["dim"].as_py()
            if row["shard"].as_py() == -1:
                query_ids = row["query_ids"].values.to_numpy()
                queries = np.frombuffer(row["vectors"].as_py(), "<f8").reshape(-1, dim)
                best = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
            elif best is not None:  # else no query was dealt to this block
                best = _merged(best, _shard_results(row, dim, query_ids, queries, k, width), k)
    if best is not None:
        yield _rows(query_ids, best)


def _rows(query_ids: np.ndarray, best: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
    q, ids, score = best
    return pa.record_batch([pa.array(query_ids[q]), pa.array(ids), pa.array(score)], names=["query_id", "vec_id", "score"])


def _merged(one: tuple, other: tuple, k: int) -> tuple:
    """The ``k`` best of each query, ties to the smaller identifier."""
    q, ids, score = (np.concatenate(pair) for pair in zip(one, other))
    order = np.lexsort((ids, -score, q))
    q, ids, score = q[order], ids[order], score[order]
    best = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[best], ids[best], score[best]


def _shard_results(row: dict, dim: int, query_ids: np.ndarray, queries: np.ndarray, k: int, width: int) -> tuple:
    """Numbers of queries, identifiers and scores of what the graph of one shard finds."""
    points = np.frombuffer(row["points"].as_py(), "<f8").reshape(-1, dim)
    lifted = np.frombuffer(row["lifted"].as_py(), np.float32).reshape(-1, dim + 1)
    layers = [np.frombuffer(x, np.int32).reshape(-1, w) for x, w in zip(row["layers"].as_py(), row["widths"].as_py())]
    graph = Graph.of(lifted, row["entry"].as_py(), layers)
    member_point, member_id = row["member_point"].values.to_numpy(), row["member_id"].values.to_numpy()
    first, count = np.searchsorted(member_point, np.arange(len(points))), np.bincount(member_point, minlength=len(points))
    largest = np.abs(queries).max(axis=1, keepdims=True)
    rays = (queries / largest).astype(np.float32)
    width = _wide_enough(graph, points, queries[:SAMPLE], rays[:SAMPLE], k, width)
    out = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    for at in range(0, len(queries), _AT_ONCE):
        found = graph.search(rays[at:at + _AT_ONCE], k + 1, width)
        q, rank = np.nonzero(found >= 0)
        point = found[q, rank]
        q = q + at
        score = np.einsum("kd,kd->k", queries[q], points[point])
        n = count[point]
        q, score = np.repeat(q, n), np.repeat(score, n)
        ids = member_id[np.repeat(first[point], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        other = ids != query_ids[q]
        out = _merged(out, (q[other], ids[other], score[other]), k)
    return out


def _wide_enough(graph: Graph, points: np.ndarray, queries: np.ndarray, rays: np.ndarray, k: int, width: int) -> int:
    """The least width, by doubling from ``width``, at which the sample's answers are found."""
    n = min(k, len(points))
    scores = queries @ points.T
    least = np.partition(scores, len(points) - n, axis=1)[:, len(points) - n]
    while width < len(points):
        found = graph.search(rays, n, width)
        own = np.take_along_axis(scores, np.maximum(found, 0), axis=1)
        if ((found >= 0) & (own >= least[:, None])).mean() >= RECALL:
            break
        width *= 2
    return min(width, max(len(points), 1))


def build_index(vectors: DataFrame, shard_rows: int = SHARD_ROWS, k: int = 20) -> tuple[DataFrame, DataFrame]:
    """One row per shard, and the shards of each dimension (``dim, first, shards``); ``vectors``: ``vec_id, v`` (array of doubles)."""
    largest = F.array_max(F.transform("v", F.abs))
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + (x / largest) * (x / largest))
    band = F.floor((F.log2(largest) + F.log2(length) / 2) / float(np.log2(BAND)) + 0.5)
    # rows that repeat identifier and vector count once
    rows = keep(vectors.select("vec_id", "v", F.size("v").alias("dim"), band.alias("band")).distinct())
    # a row per dimension and band: some thousands of bands hold all numbers
    sizes = rows.groupBy("dim", "band").agg(F.ceil(F.count(F.lit(1)) / shard_rows).cast("int").alias("shards"))
    bands = keep(sizes.withColumn("first", (F.sum("shards").over(Window.orderBy("dim", "band")) - F.col("shards")).cast("int")))
    dims = keep(bands.groupBy("dim").agg(F.min("first").alias("first"), F.sum("shards").cast("int").alias("shards")))
    number = F.col("first") + F.pmod(F.xxhash64("vec_id", "v"), F.col("shards")).cast("int")
    dealt = rows.join(broadcast_if_small(bands), ["dim", "band"]).select("vec_id", "v", "dim", number.alias("shard"))
    n = dims.agg(F.sum("shards")).first()[0] or 1
    return keep(dealt.repartitionById(n, "shard").mapInArrow(partial(_build, k=k), _SHARD)), dims


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, v`` of vectors that are not null, empty or zero and hold only finite numbers."""
    rows = rows.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0))


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 20, width: int = SEARCH_WIDTH, shard_rows: int = SHARD_ROWS,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score``: about the ``k`` largest inner products for every query.

    Best first, ties to the smaller ``vec_id``; a query is not its own neighbour. Scores are exact, in
    double precision. Null, empty and zero vectors, vectors with null or non-finite components and rows
    without identifier take no part. A query meets the vectors of its own dimension. Rows that repeat identifier
    and vector count once; with another vector an identifier is a row of its own and can appear more than once.
    Other columns are not read.
    """
    index, dims = build_index(usable(vectors, id_col, vector_col), shard_rows, k)
    asked = usable(queries, id_col, vector_col).withColumn("dim", F.size("v"))
    # the stated query set against all shards: a task is one group of shards and, beyond QUERY_BLOCK, one block of queries
    slots = vectors.sparkSession.sparkContext.defaultParallelism
    sizes = asked.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("blocks"))
    groups = F.least("shards", F.greatest(F.ceil(F.col("shards") / SHARDS_A_TASK), F.ceil(F.lit(slots) / F.col("blocks")))).cast("int")
    plan = dims.join(sizes, "dim").withColumn("groups", groups).withColumn("tasks", F.col("groups") * F.col("blocks"))
    plan = keep(plan.withColumn("base", (F.sum("tasks").over(Window.orderBy("dim")) - F.col("tasks")).cast("int")))  # a row per dimension
    n_tasks = plan.agg(F.sum("tasks")).first()[0] or 1
    block = asked.join(broadcast_if_small(plan), "dim")
    block = block.select("vec_id", "v", "dim", F.pmod(F.xxhash64("vec_id", "v"), F.col("blocks")).cast("int").alias("block"))

    def pack(t: pa.Table) -> pa.Table:
        v = t["v"].combine_chunks().flatten().to_numpy().astype("<f8").tobytes()
        return pa.table({
            "block": t["block"][:1], "dim": t["dim"][:1], "query_ids": pa.array([t["vec_id"].to_pylist()], pa.list_(pa.int64())), "vectors": pa.array([v], pa.binary()),
        })

    packed = keep(block.groupBy("dim", "block").applyInArrow(pack, "block int, dim int, query_ids array<long>, vectors binary"))
    asking = packed.join(broadcast_if_small(plan), "dim").withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).withColumn("shard", F.lit(-1))
    shards = index.join(broadcast_if_small(plan), "dim").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    shards = shards.withColumn("group", (F.col("shard") - F.col("first")) % F.col("groups"))
    visits = asking.unionByName(shards, allowMissingColumns=True).withColumn("task", F.col("base") + F.col("block") * F.col("groups") + F.col("group"))
    visits = visits.drop("block", "group", "groups", "blocks", "tasks", "base", "first", "shards")
    visits = visits.repartitionById(n_tasks, "task").sortWithinPartitions("task", "shard")
    found = visits.mapInArrow(partial(_visit, k=k, width=width), _FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
