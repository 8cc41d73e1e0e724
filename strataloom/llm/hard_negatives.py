"""Hard negatives: rows of another label that score a little below an anchor's positives.

Anchors of one label that stand in one block form a minimum spanning tree. A block of anchors meets a block of rows in one
task, and every anchor is passed after its parent. If a row's score at the parent lies between two bounds, its score at
the anchor lies within the same bounds moved out by the length of the tree edge times the row's norm. Rows whose
bounds miss the anchor's windows, or that enough other rows of the window beat for certain, are not scored; all
others are, which makes their bounds exact for the anchors below. The roots score every row.

Blocks are cut by hash and bounded in rows; the best of all blocks are merged per anchor (and positive). Every block of
anchors meets every block of rows, so the work grows with the product, as the task states.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.llm.common import keep
from strataloom.materialize import broadcast_if_small

ROW_BLOCK = 8_192
ANCHOR_BLOCK = 1_024
TREE = 256  # anchors of one tree, on average
LARGEST = float(1 << 62)  # bound of a row's squared norm: products of two rows then fit 64 bits
_EXACT = float(1 << 53)
_SLACK = 1e-9  # relative room for rounding in the bounds


def whole_vectors(vectors: DataFrame, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``vec_id, label, v, dim``: components as ``floor(scale * x)``.

    Rows with a null label, a null vector, a null or non-finite component or a squared length of 2^62 and
    more are left out; rows equal in all three columns count once.
    """
    x = F.transform(F.col(f"`{vec_col}`"), lambda c: c.cast("double"))
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").alias("label"), x.alias("x"))
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    scaled = F.transform("x", lambda c: F.floor(c * float(scale)))
    length2 = F.aggregate("x", F.lit(0.0), lambda a, c: a + F.floor(c * float(scale)).cast("double") * F.floor(c * float(scale)).cast("double"))
    fit = rows.where("label is not null and x is not null").where(~bad).where(length2 < LARGEST)
    return fit.select("vec_id", "label", scaled.alias("v"), F.size("x").alias("dim")).distinct()


def _matrix(table: pa.Table, order: np.ndarray | None = None) -> np.ndarray:
    values = table["v"].combine_chunks()
    dim = table["dim"][0].as_py()
    flat = values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), dim)
    return flat if order is None else flat[order]


def spanning_tree(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ``v`` in an order with parents first: row numbers, the parent's place in the order (-1: root), edge lengths."""
    n = len(v)
    x = v.astype(float)
    left = np.ones(n, dtype=bool)
    near, parent = np.full(n, np.inf), np.full(n, -1)
    order, above, edge = np.zeros(n, dtype=np.int64), np.full(n, -1), np.zeros(n)
    at = 0
    for place in range(n):
        order[place], left[at] = at, False
        if place:
            above[place], edge[place] = parent[at], near[at]
        gone = x - x[at]
        d = np.sqrt((gone * gone).sum(axis=1))
        closer = left & (d < near)
        near[closer], parent[closer] = d[closer], place
        if place + 1 < n:
            at = int(np.argmin(np.where(left, near, np.inf)))
    return order, above, edge


def _plant(table: pa.Table) -> pa.Table:
    """Adds the place in the tree, the parent's place and the edge to the anchors of one tree."""
    v = _matrix(table)
    # the same tree whatever order the rows come in
    first = np.lexsort((*v.T[::-1], table["vec_id"].to_numpy(zero_copy_only=False)))
    order, above, edge = spanning_tree(v[first])
    out = table.take(pa.array(first[order]))
    return out.append_column("place", pa.array(np.arange(len(order)), pa.int32())).append_column(
        "parent", pa.array(above, pa.int32())).append_column("edge", pa.array(edge, pa.float64()))


class _Rows:
    """The rows of a block: exact scores, and bounds that follow the tree."""

    def __init__(self, table: pa.Table):
        ids = table["vec_id"]
        self.none = ids.is_null().to_numpy()
        self.ids = ids.fill_null(0).to_numpy()
        self.labels = np.array(table["label"].to_pylist(), dtype=object)
        self.v = _matrix(table)
        self.x = self.v.astype(float)
        self.norms = np.sqrt((self.x * self.x).sum(axis=1))
        self.largest = np.abs(self.v).max(initial=0)

    def score(self, at: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """Inner products of the rows ``at``, in whole numbers."""
        if float(self.largest) * float(np.abs(anchor).max(initial=0)) * max(1, len(anchor)) < _EXACT:
            return (self.x[at] @ anchor.astype(float)).astype(np.int64)
        return self.v[at] @ anchor

    def best(self, at: np.ndarray, scores: np.ndarray, n: int) -> np.ndarray:
        """Places in ``at`` of the ``n`` best: high score, then small identifier, null last."""
        if len(at) > n:  # ties of the n-th stay in
            least = np.partition(scores, len(scores) - n)[len(scores) - n]
            keep_ = np.flatnonzero(scores >= least)
        else:
            keep_ = np.arange(len(at))
        own = at[keep_]
        return keep_[np.lexsort((self.ids[own], self.none[own], -scores[keep_]))[:n]]


def _walk(rows: _Rows, anchors: pa.Table, same: bool, needed) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Anchor number, rows scored there and their scores; ``needed(number, low, high, rows)`` tells which must be."""
    v, labels = _matrix(anchors), anchors["label"].to_pylist()
    tree, place = anchors["tree"].to_numpy(), anchors["place"].to_numpy()
    parent, edge = anchors["parent"].to_numpy(), anchors["edge"].to_numpy()
    for t in np.unique(tree):
        own = np.flatnonzero(tree == t)
        own = own[np.argsort(place[own])]
        same_label = rows.labels == labels[own[0]]
        at = np.flatnonzero(same_label if same else ~same_label)
        if not len(at):
            continue
        norms = rows.norms[at]
        waiting = np.bincount(parent[own][1:], minlength=len(own)) if len(own) > 1 else np.zeros(len(own), dtype=int)
        bounds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for i, a in enumerate(own):
            if i == 0:
                scored = np.arange(len(at))
                low = high = rows.score(at, v[a]).astype(float)
                scores = rows.score(at, v[a])
            else:
                up = parent[a]
                below, above = bounds[up]
                reach = edge[a] * norms
                slack = _SLACK * (np.abs(below) + np.abs(above) + reach) + 1e-6
                low, high = below - reach - slack, above + reach + slack
                scored = np.flatnonzero(needed(a, low, high, at))
                scores = rows.score(at[scored], v[a])
                low[scored] = high[scored] = scores
                waiting[up] -= 1
                if not waiting[up]:
                    del bounds[up]
            if waiting[i]:
                bounds[i] = (low, high)
            yield a, at[scored], scores


def _nth_largest(values: np.ndarray, n: int) -> float:
    return np.partition(values, len(values) - n)[len(values) - n] if len(values) >= n else -np.inf


def _positives(n: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            rows, ids = _Rows(left), right["vec_id"].to_numpy()
            v = _matrix(right)

            def other(a: int, at: np.ndarray) -> np.ndarray:
                return (rows.ids[at] != ids[a]) | rows.none[at] | (rows.v[at] != v[a]).any(axis=1)

            def needed(a, low, high, at):
                mine = other(a, at)
                return mine & (high >= _nth_largest(low[mine], n))

            for a, at, scores in _walk(rows, right, True, needed):
                mine = np.flatnonzero(other(a, at))
                for i in mine[rows.best(at[mine], scores[mine], n)]:
                    out.append((ids[a], right["anchor"][a].as_py(), None if rows.none[at[i]] else rows.ids[at[i]], scores[i]))
        return _table(out, ("anchor_id", "anchor", "positive_id", "positive_score"))

    return run


def _table(rows: list[tuple], names: tuple[str, ...]) -> pa.Table:
    return pa.table({c: pa.array([None if r[i] is None else int(r[i]) for r in rows], pa.int64()) for i, c in enumerate(names)})


def _window(score: int, low: int, high: int) -> tuple[int, int]:
    """Whole numbers ``s`` with ``low * score <= 100 * s <= high * score``."""
    score = int(score)
    return -(-low * score // 100), high * score // 100


def _negatives(n: int, low: int, high: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            rows = _Rows(left)
            windows = [[_window(s, low, high) for s in found] for found in right["scores"].to_pylist()]

            def needed(a, below, above, at):
                wanted = np.zeros(len(at), dtype=bool)
                for least, most in windows[a]:
                    if least > most:
                        continue
                    inside = below[(below >= least) & (above <= most)]
                    wanted |= (above >= max(least, _nth_largest(inside, n))) & (below <= most)
                return wanted

            for a, at, scores in _walk(rows, right, False, needed):
                for no, (least, most) in enumerate(windows[a]):
                    inside = np.flatnonzero((scores >= least) & (scores <= most))
                    for i in inside[rows.best(at[inside], scores[inside], n)]:
                        out.append((right["anchor"][a].as_py(), no, None if rows.none[at[i]] else rows.ids[at[i]], scores[i]))
        return _table(out, ("anchor", "no", "negative_id", "negative_score"))

    return run


def _blocks(n_rows: int, size: int) -> int:
    return max(1, -(-n_rows // size))


def _meet(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int, run, schema: str, row_block: int, anchor_block: int) -> DataFrame:
    """Every block of rows with every block of anchors of the same dimension, one task each."""
    row_blocks, anchor_blocks = _blocks(n_rows, row_block), _blocks(n_anchors, anchor_block)
    left = rows.withColumn("rb", F.pmod(F.xxhash64("vec_id", "v"), F.lit(row_blocks)).cast("int"))
    left = left.withColumn("ab", F.explode(F.sequence(F.lit(0), F.lit(anchor_blocks - 1))))
    right = anchors.withColumn("ab", F.pmod(F.xxhash64("tree"), F.lit(anchor_blocks)).cast("int"))
    right = right.withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))))
    keys = ["dim", "rb", "ab"]
    right = right.toDF(*right.columns)
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)


def mine(
    rows: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 10, low: int = 30, high: int = 90,
    row_block: int = ROW_BLOCK, anchor_block: int = ANCHOR_BLOCK, tree: int = TREE,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for ``rows`` as :func:`whole_vectors` gives them.

    Positives are an anchor's ``n_positives`` best other rows of its label, negatives of a positive the ``n_negatives`` best
    rows of another label whose score is between ``low`` and ``high`` percent of the positive's; ties go to the smaller
    identifier, null identifiers come last. An identifier may repeat with another label or vector: each is a row of its own. Vectors
    meet those of their own length only. Empty tables, anchors without positives and positives without
    negatives give no rows.
    """
    rows = keep(rows)
    sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(is_anchor).alias("a")).first()
    labels = rows.where(is_anchor).groupBy("dim", "label").agg(F.count(F.lit(1)).alias("n"))
    part = F.pmod(F.xxhash64("vec_id", "v"), F.ceil(F.col("n") / tree))
    anchors = rows.where(is_anchor).join(broadcast_if_small(keep(labels)), ["dim", "label"])
    anchors = anchors.select("vec_id", "label", "v", "dim", F.xxhash64("dim", "label", part).alias("tree"), F.xxhash64("vec_id", "label", "v").alias("anchor"))
    kind = dict(rows.dtypes)["label"]
    fields = f"vec_id long, label {kind}, v array<long>, dim int, tree long, anchor long"
    anchors = keep(anchors.groupBy("tree", "dim", "label").applyInArrow(_plant, f"{fields}, place int, parent int, edge double"))

    near = _meet(rows, anchors, sizes["n"], sizes["a"], _positives(n_positives), "anchor_id long, anchor long, positive_id long, positive_score long", row_block, anchor_block)
    best = Window.partitionBy("anchor").orderBy(F.desc("positive_score"), F.col("positive_id").asc_nulls_last())
    positives = near.withColumn("no", F.row_number().over(best) - 1).where(F.col("no") < n_positives)
    positives = keep(positives)

    scores = positives.groupBy("anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("no", "positive_score"))), lambda s: s["positive_score"]).alias("scores"))
    windows = anchors.join(scores, "anchor", "left").withColumn("scores", F.coalesce("scores", F.array().cast("array<long>")))
    found = _meet(rows, windows, sizes["n"], sizes["a"], _negatives(n_negatives, low, high), "anchor long, no long, negative_id long, negative_score long", row_block, anchor_block)
    best = Window.partitionBy("anchor", "no").orderBy(F.desc("negative_score"), F.col("negative_id").asc_nulls_last())
    negatives = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n_negatives)
    return negatives.join(positives, ["anchor", "no"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
