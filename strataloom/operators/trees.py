"""Decision trees and forests: all trees of all folds and attempts grow level by level in one plan.

A pass takes every open node of every tree. Rows are counted per class for each value of the features that the node
looks at, running sums over the values give both sides of every cut, and the cut of least impurity wins. Values are cut
into ranges first, so that no task has to sort all values of a node. Rows move to the children by a join with the
cuts. The number of passes is the depth of the deepest tree, whatever the number of trees, and nothing depends on the
length of the batches.

Features, bootstrap weights and ties are decided by hashes of the seed, the tree and the path from the root (``0``
left, ``1`` right), so plain SQL can repeat them.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.functions.hashing import hash60, uniform
from strataloom.materialize import broadcast_if_small, pin, settle

# one array of nodes per tree, breadth first
TREE_TYPE = "array<array<struct<feature:int,threshold:double,left:int,right:int,share:double>>>"
# Values of one feature that a range holds on average, if they are spread evenly.
RANGE_ROWS = 100_000
# The moves of this many passes are chained before the rows are written.
_CHAINED = 6
_LEAF = -1
_TREE = ["fold", "attempt", "tree"]
_NODE = [*_TREE, "path"]
_ROUNDED = 9


def split_features(setting: Column, p: int) -> Column:
    """Features looked at per split: all, a count, a fraction, ``sqrt`` or ``log2``; ``setting`` is text."""
    number = setting.try_cast("double")
    counted = F.when(setting.contains("."), F.floor(number * p)).otherwise(F.floor(number)).cast("int")
    named = {"None": p, "all": p, "sqrt": math.isqrt(p), "auto": math.isqrt(p), "log2": int(math.log2(max(p, 1)))}
    out = F.least(F.lit(p), F.greatest(F.lit(1), counted))
    for name, n in named.items():
        out = F.when(setting == name, F.lit(max(1, n))).otherwise(out)
    return F.coalesce(F.when(setting.isNull(), F.lit(p)).otherwise(out), F.raise_error(F.concat(F.lit("max_features: "), setting)).cast("int"))


def row_number_setting(setting: Column, n: Column) -> Column:
    """A number of rows, or a fraction of ``n``, rounded up."""
    value = setting.cast("double")
    return F.when(value < 1, F.greatest(F.lit(1), F.ceil(value * n))).otherwise(F.floor(value)).cast("long")


def poisson_weight(*key) -> Column:
    """How often a bootstrap sample draws a row: a Poisson number with mean 1, by the key."""
    u = uniform(*key)
    total, term, weight = 0.0, math.exp(-1.0), F.lit(0)
    for k in range(1, 15):
        total += term
        term /= k
        weight = weight + (u >= total).cast("int")
    return weight.cast("long")


def _can_split() -> Column:
    deep = F.col("max_depth").isNotNull() & (F.col("depth") >= F.col("max_depth"))
    pure = (F.col("pos") == 0) | (F.col("pos") == F.col("n"))
    return ~pure & (F.col("n") >= F.greatest("min_split", 2 * F.col("min_leaf"))) & ~deep


def _in_order(p: int) -> Column:
    """All features in the order in which the node looks at them."""
    keys = F.transform(F.sequence(F.lit(0), F.lit(p - 1)), lambda f: F.struct(hash60(F.col("seed"), "split", F.col("tree"), F.col("path"), f).alias("h"), f.alias("f")))
    return F.transform(F.array_sort(keys), lambda s: s["f"])


def _looked_at(p: int) -> Column:
    """The first ``n_features``; if none of them can split, the others, of which the first that can is taken."""
    some = F.when(F.col("second"), F.slice(_in_order(p), F.col("n_features") + 1, p)).otherwise(F.slice(_in_order(p), 1, F.col("n_features")))
    return F.when(F.col("n_features") >= p, F.sequence(F.lit(0), F.lit(p - 1))).otherwise(some)


def _best_cuts(rows: DataFrame, nodes: DataFrame, p: int, limits: list | None, n_ranges: int) -> DataFrame:
    """The best cut of each node that can be split: feature, value, next value, rows and hits on the left."""
    look = nodes.select(*_NODE, "n", "pos", "min_leaf", "second", _looked_at(p).alias("look"))
    met = rows.where("w > 0").join(broadcast_if_small(look.select(*_NODE, "look")), _NODE)
    values = met.select(*_NODE, "y", "w", F.posexplode("look").alias("rank", "f"), "x").select(*_NODE, "rank", "f", F.get("x", F.col("f")).alias("v"), "y", "w")
    by = [*_NODE, "rank", "f"]
    if limits is not None:
        low, width = (F.get(F.array(*[F.lit(v) for v in side]), F.col("f")) for side in zip(*limits))
        place = F.floor((F.col("v") - low) / width * float(n_ranges))
        values = values.withColumn("range", F.when(width > 0, place).otherwise(0).cast("int"))
        ranged = [*by, "range"]
    else:
        ranged = by
    cells = values.groupBy(*ranged, "v").agg(F.sum("w").alias("m"), F.sum(F.col("w") * F.col("y")).alias("hits"))
    inside = Window.partitionBy(*ranged).orderBy("v")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = cells.withColumn("ln", F.sum("m").over(upto)).withColumn("lp", F.sum("hits").over(upto)).withColumn("following", F.lead("v").over(inside))
    if limits is not None:
        ranges = cells.groupBy(*ranged).agg(F.sum("m").alias("m"), F.sum("hits").alias("hits"), F.min("v").alias("least"))
        along = Window.partitionBy(*by).orderBy("range")
        before = along.rowsBetween(Window.unboundedPreceding, -1)
        offsets = ranges.select(*ranged, F.coalesce(F.sum("m").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("hits").over(before), F.lit(0)).alias("p0"),
                                F.lead("least").over(along).alias("after"))
        sums = sums.join(offsets, ranged).withColumn("ln", F.col("ln") + F.col("n0")).withColumn("lp", F.col("lp") + F.col("p0")).withColumn(
            "following", F.coalesce("following", "after"))
    sums = sums.where("following is not null").join(broadcast_if_small(look.drop("look")), _NODE)
    ln, lp, n, pos = (F.col(c).cast("double") for c in ("ln", "lp", "n", "pos"))
    cost = F.round((lp - lp * lp / ln) + ((pos - lp) - (pos - lp) * (pos - lp) / (n - ln)), _ROUNDED)
    cuts = sums.where("ln >= min_leaf and n - ln >= min_leaf")
    cut = F.struct(F.when(F.col("second"), F.col("rank")).otherwise(0).alias("rank"), cost.alias("cost"), F.col("f"), F.col("v"), F.col("following"), F.col("ln"), F.col("lp"))
    return cuts.groupBy(*_NODE).agg(F.min(cut).alias("cut")).select(*_NODE, "cut.f", "cut.v", "cut.following", "cut.ln", "cut.lp")


def grow(rows: DataFrame, tries: DataFrame, p: int, range_rows: int = RANGE_ROWS) -> tuple[DataFrame, DataFrame]:
    """Grow the trees of ``tries`` on ``rows``.

    ``rows`` holds ``fold, attempt, tree, y, w, x`` and any other columns: the class 0 or 1, the weight (0: the
    row only follows the cuts) and the features. ``tries`` holds ``fold, attempt, seed, max_depth, n_features, min_leaf,
    min_split``; the last three count weights. Returns the nodes ``fold, attempt, tree, path, feature, threshold,
    n, pos`` (leaves have no feature) and the rows with the ``path`` of their leaf.
    """
    counts = rows.where("w > 0").groupBy(*_TREE).agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("y")).alias("pos"))
    state = settle(counts.join(broadcast_if_small(tries), ["fold", "attempt"]).select(
        *_TREE, F.lit("").alias("path"), F.lit(0).alias("depth"), F.lit(False).alias("second"), "n", "pos", "seed", "max_depth", "n_features", "min_leaf", "min_split"))
    most = state.agg(F.max("n")).first()[0] or 0
    n_ranges = -(-most // range_rows)
    limits = None
    if n_ranges > 1:
        at = rows.where("w > 0").agg(*[f(F.get("x", F.lit(i))) for i in range(p) for f in (F.min, F.max)]).first()
        limits = [(at[2 * i], w if math.isfinite(w := at[2 * i + 1] - at[2 * i]) else 0.0) for i in range(p)]
    rows = rows.withColumn("path", F.lit(""))
    settings = ["seed", "max_depth", "n_features", "min_leaf", "min_split"]
    done, passes = [], 0
    while True:
        done.append(_leaves(state.where(~_can_split())))
        nodes = state.where(_can_split())
        if nodes.isEmpty():
            break
        found = settle(nodes.join(_best_cuts(rows, nodes, p, limits, n_ranges), _NODE, "left"))
        once_more = F.col("f").isNull() & ~F.col("second") & (F.col("n_features") < p)
        again = found.where(once_more).withColumn("second", F.lit(True)).drop("f", "v", "following", "ln", "lp")
        done.append(_leaves(found.where(F.col("f").isNull() & ~once_more)))
        middle = (F.col("v") + F.col("following")) / 2
        threshold = F.when(middle < F.col("following"), middle).otherwise(F.col("v"))
        cut = found.where("f is not null").withColumn("threshold", threshold)
        moves = cut.select(*_NODE, F.col("f").alias("feature"), "threshold")
        done.append(cut.select(*_NODE, F.col("f").alias("feature"), "threshold", "n", "pos"))
        left, right = (F.struct(F.concat("path", F.lit(d)).alias("path"), n.alias("n"), hits.alias("pos")) for d, n, hits in (
            ("0", F.col("ln"), F.col("lp")), ("1", F.col("n") - F.col("ln"), F.col("pos") - F.col("lp"))))
        children = cut.select(*_TREE, "depth", *settings, F.inline(F.array(left, right)))
        children = children.select(*_NODE, (F.col("depth") + 1).alias("depth"), F.lit(False).alias("second"), "n", "pos", *settings)
        state = settle(children.unionByName(again.select(*children.columns)))
        side = F.when(F.col("feature").isNull(), "").when(F.get("x", F.col("feature")) <= F.col("threshold"), "0").otherwise("1")
        rows = rows.join(broadcast_if_small(moves), _NODE, "left").withColumn("path", F.concat("path", side)).drop("feature", "threshold")
        passes += 1
        if passes % _CHAINED == 0:
            rows = pin(rows)
    nodes = done[0]
    for part in done[1:]:
        nodes = nodes.unionByName(part)
    return settle(nodes), rows


def _leaves(nodes: DataFrame) -> DataFrame:
    return nodes.select(*_NODE, F.lit(None).cast("int").alias("feature"), F.lit(None).cast("double").alias("threshold"), "n", "pos")


def share() -> Column:
    """Share of class 1 in a node."""
    return F.col("pos").cast("double") / F.col("n")


def forest_vote(shares: Column) -> Column:
    """1 if the trees' mean share of class 1 is over one half."""
    return (F.round(shares, _ROUNDED) > 0.5).cast("int")


def scores(nodes: DataFrame, moved: DataFrame) -> DataFrame:
    """``fold, attempt, test_score, train_score``: share of rows (``side, slot, y``) that a forest classifies right."""
    leaves = nodes.where("feature is null").select(*_NODE, share().alias("share"))
    shares = moved.join(broadcast_if_small(leaves), _NODE).groupBy("fold", "attempt", "side", "slot", "y").agg(F.avg("share").alias("share"))
    hit = (forest_vote(F.col("share")) == F.col("y")).cast("double")
    return shares.groupBy("fold", "attempt").agg(*[F.avg(F.when(F.col("side") == s, hit)).alias(f"{s}_score") for s in ("test", "train")])


def as_arrays(nodes: DataFrame) -> DataFrame:
    """``fold, attempt, tree``: node arrays, breadth first; the children of the j-th split stand at ``2j - 1`` and ``2j``."""
    order = Window.partitionBy(*_TREE).orderBy(F.length("path"), "path")
    nth = F.sum(F.col("feature").isNotNull().cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("int")
    split = F.col("feature").isNotNull()
    placed = nodes.withColumn("nth", nth).withColumn("at", F.row_number().over(order))
    node = F.struct("at", F.when(split, F.col("feature")).otherwise(_LEAF).alias("feature"), F.coalesce("threshold", F.lit(0.0)).alias("threshold"),
                    F.when(split, 2 * F.col("nth") - 1).otherwise(_LEAF).alias("left"), F.when(split, 2 * F.col("nth")).otherwise(_LEAF).alias("right"), share().alias("share"))
    grown = placed.groupBy(*_TREE).agg(F.array_sort(F.collect_list(node)).alias("nodes"))
    forest = grown.groupBy("fold", "attempt").agg(F.array_sort(F.collect_list(F.struct("tree", "nodes"))).alias("trees"))
    return forest.select("fold", "attempt", F.transform("trees", lambda t: F.transform(t["nodes"], lambda n: F.struct(
        n["feature"].alias("feature"), n["threshold"].alias("threshold"), n["left"].alias("left"), n["right"].alias("right"), n["share"].alias("share")))).cast(TREE_TYPE).alias("tree"))


def tree_arrays(nodes) -> tuple[np.ndarray, ...]:
    return tuple(np.array([n[c] for n in nodes]) for c in ("feature", "threshold", "left", "right", "share"))


def forest_votes(x: np.ndarray, forest) -> np.ndarray:
    """0/1 votes of one forest (a list of :func:`tree_arrays`) for all rows of ``x``."""
    total = np.zeros(len(x))
    for feature, threshold, left, right, shares in forest:
        at = np.zeros(len(x), dtype=int)
        active = np.flatnonzero(feature[at] != _LEAF)
        while len(active):
            node = at[active]
            goes_left = x[active, feature[node]] <= threshold[node]
            at[active] = np.where(goes_left, left[node], right[node])
            active = active[feature[at[active]] != _LEAF]
        total += shares[at]
    return (np.round(total / len(forest), _ROUNDED) > 0.5).astype(int)
