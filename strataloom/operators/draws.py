"""Exact seeded draws from groups of any size.

Rows of a group are ordered by ``(hash of row_id, row_id)``; a draw picks a position in
that order. The order, and with it every draw, is the same for any strategy below.

Small groups (the largest is known from a count) are ranked by one window per group.
For larger ones no task ever sorts a group:

1. count rows per ``(group, hash prefix)``, combined on the map side;
2. running offsets of the prefixes, in two levels so that no window is large;
3. each position finds its prefix by an equi-join on position blocks;
4. only rows whose prefix was hit are ranked, within their prefix.

That reads the rows twice, once to count and once to rank, besides the count of group sizes.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataloom.functions.hashing import HASH_BITS, hash60
from strataloom.materialize import pin

# Largest group that one window may rank.
WINDOW_ROWS = 200_000
# Rows a hash prefix should hold, and the longest prefix, for larger groups.
PREFIX_ROWS = 1_000
MAX_PREFIX_BITS = 24
ORDER = "__order"
_COARSE_SHIFT = 12
_SLOT_CHUNK = 4096
# Draws up to this number are broadcast; their number follows from the settings.
DRAWS_BROADCAST = 2_000_000
# Requests up to this many slots are expanded where they are.
_LOCAL_SLOTS = 500_000
# Slots that one task expands if there are more.
_TASK_SLOTS = 100_000
# Groups of which at least one row in so many is drawn count as dense; see draw_without_replacement.
_DENSE = 4
# Longest walk of a permuted draw; see permuted.
_WALK_STEPS = 64


def small_table(spark: SparkSession, rows, fields) -> DataFrame:
    """A table of literal rows, for lists of a known small size; ``fields`` are (name, type)."""
    names = [name for name, _ in fields]
    text = json.dumps([dict(zip(names, row)) for row in rows], default=str)
    kind = "array<struct<" + ",".join(f"`{name}`:{kind}" for name, kind in fields) + ">>"
    return spark.range(0, 1, 1, 1).select(F.inline(F.from_json(F.lit(text), kind)))


def prefix_bits(largest: int) -> int:
    """Prefix length for a group of ``largest`` rows; 0 means one window per group."""
    if largest <= WINDOW_ROWS:
        return 0
    return min(MAX_PREFIX_BITS, (largest // PREFIX_ROWS).bit_length())


def index_rows(pool: DataFrame, by, row_id: str, weight: str | None = None) -> DataFrame:
    """Narrow view of the pool: group, id, order hash and multiplicity.

    A pool that repeats its rows may bring the hash along as ``ORDER``.
    """
    times = F.col(weight).cast("bigint") if weight else F.lit(1).cast("bigint")
    order = F.col(ORDER) if ORDER in pool.columns else hash60(F.col(row_id))
    return pool.select(*by, F.col(row_id), times.alias("__times"), order.alias(ORDER))


def _prefix(bits: int) -> Column:
    return F.shiftright("__order", HASH_BITS - bits)


def group_sizes(rows: DataFrame, by) -> dict[tuple, int]:
    """Rows (with multiplicity) per group; one entry per fold, side and class at most."""
    found = rows.groupBy(*by).agg(F.sum("__times").alias("n")).collect()
    return {tuple(r[c] for c in by): r["n"] for r in found}


def _prefix_starts(rows: DataFrame, by, bits: int) -> DataFrame:
    """Position range ``[__start, __start + __count)`` of every prefix, and the positions ``__n`` of its group."""
    # both levels read these counts, so the rows are scanned once for them
    fine = pin(
        rows.groupBy(*by, _prefix(bits).alias("__prefix"))
        .agg(F.sum("__times").alias("__count"))
        .withColumn("__coarse", F.shiftright("__prefix", _COARSE_SHIFT))
    )
    coarse = fine.groupBy(*by, "__coarse").agg(F.sum("__count").alias("__in_coarse"))
    over_coarse = Window.partitionBy(*by).orderBy("__coarse")
    over_group = Window.partitionBy(*by)
    coarse = coarse.select(
        *by,
        "__coarse",
        (F.sum("__in_coarse").over(over_coarse) - F.col("__in_coarse")).alias("__base"),
        F.sum("__in_coarse").over(over_group).alias("__n"),
    )
    over_fine = Window.partitionBy(*by, "__coarse").orderBy("__prefix")
    return fine.join(coarse, [*by, "__coarse"]).select(
        *by,
        "__prefix",
        "__count",
        (F.col("__base") + F.sum("__count").over(over_fine) - F.col("__count")).alias("__start"),
        "__n",
    )


def _prefix_offsets(rows: DataFrame, by, bits: int) -> DataFrame:
    """The ranges of the prefixes per position block."""
    spans = _prefix_starts(rows, by, bits).withColumn("__width", _block_width(F.col("__n"), bits))
    first = F.expr("__start div __width")
    last = F.expr("(__start + __count - 1) div __width")
    return spans.withColumn("__block", F.explode(F.sequence(first, last))).drop("__width", "__n")


def _block_width(n: Column, bits: int) -> Column:
    return F.greatest(F.lit(1).cast("bigint"), F.shiftright(n, bits))


def _ranked(rows: DataFrame, by, row_id: str, rank: str) -> DataFrame:
    """Every position of every row, counted from 0 within ``by``; a row drawn k times has k."""
    order = Window.partitionBy(*by).orderBy("__order", row_id).rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.withColumn("__end", F.sum("__times").over(order))
        .withColumn(rank, F.explode(F.expr("sequence(__end - __times, __end - 1)")))
        .select(*by, rank, row_id)
    )


def rows_at_positions(draws: DataFrame, rows: DataFrame, by, row_id: str, bits: int, n_draws: int) -> DataFrame:
    """Replace ``position`` (of ``n``) in ``draws`` by the id of the row standing there.

    With at most ``DRAWS_BROADCAST`` draws, draws and prefixes hit are broadcast: only rows
    in those prefixes are shuffled, and many draws of one row meet no single task.
    """
    by = list(by)
    if bits == 0:
        ranked = _ranked(rows, by, row_id, "position")
        return ranked.join(_known_size(draws.drop("n"), n_draws), [*by, "position"]).drop("position")
    blocks = (
        draws.withColumn("__width", _block_width(F.col("n"), bits))
        .withColumn("__block", F.expr("position div __width"))
        .drop("__width", "n")
    )
    placed = pin(
        _known_size(blocks, n_draws).join(_prefix_offsets(rows, by, bits), [*by, "__block"])
        .filter((F.col("position") >= F.col("__start")) & (F.col("position") < F.col("__start") + F.col("__count")))
        .withColumn("__rank", F.col("position") - F.col("__start"))
        .drop("__block", "__start", "__count", "position")
    )
    in_prefix = [*by, "__prefix"]
    hit = _known_size(placed.select(*in_prefix).distinct(), n_draws)
    near = rows.withColumn("__prefix", _prefix(bits)).join(hit, in_prefix, "left_semi")
    ranked = _ranked(near, in_prefix, row_id, "__rank")
    return ranked.join(_known_size(placed, n_draws), [*in_prefix, "__rank"]).drop("__prefix", "__rank")


def _known_size(df: DataFrame, n_rows: int) -> DataFrame:
    """Broadcast hint for a table whose size follows from the settings; above the limit a shuffle.

    Without a hint Spark would take expanded requests for the few rows they come from, and broadcast them.
    """
    return F.broadcast(df) if n_rows <= DRAWS_BROADCAST else df.hint("merge")


def expand_slots(requests: DataFrame, n_slots: int, size: str = "k", slot: str = "slot") -> DataFrame:
    """One row per slot ``0 … size-1``; many slots are spread over tasks before they grow."""
    chunks = requests.filter(F.col(size) > 0).withColumn(
        "__chunk", F.explode(F.expr(f"sequence(0L, ({size} - 1) div {_SLOT_CHUNK})"))
    )
    if n_slots > _LOCAL_SLOTS:
        # a number of its own, as partitions of so few bytes would be coalesced into one
        chunks = chunks.repartition(n_slots // _TASK_SLOTS + 1, *[c for c in requests.columns if c != size], "__chunk")
    first = F.col("__chunk") * _SLOT_CHUNK
    last = F.least(first + _SLOT_CHUNK, F.col(size).cast("bigint")) - 1
    return chunks.withColumn(slot, F.explode(F.sequence(first, last))).drop("__chunk")


def _requests(rows: DataFrame, by, groups, batches) -> DataFrame:
    """Request rows; ``batches`` is the batch column with one count, or one count per group."""
    fields = [(c, rows.schema[c].dataType.simpleString()) for c in by] + [("n", "bigint"), ("k", "bigint")]
    if batches is None:
        return small_table(rows.sparkSession, groups, fields)
    name, counts = batches
    counts = [counts] * len(groups) if isinstance(counts, int) else counts
    table = small_table(
        rows.sparkSession, [(*g, c) for g, c in zip(groups, counts)], [*fields, ("__batches", "int")]
    )
    return table.withColumn(name, F.explode(F.sequence(F.lit(0), F.col("__batches") - 1))).drop("__batches")


def n_draws_of(groups, batches=None) -> int:
    """Total draws of a request list."""
    counts = 1 if batches is None else batches[1]
    counts = [counts] * len(groups) if isinstance(counts, int) else counts
    return sum(g[-1] * c for g, c in zip(groups, counts))


def holders_at_positions(draws: DataFrame, rows: DataFrame, by, row_id: str, bits: int, widths, n_draws: int) -> DataFrame:
    """The row that holds each ``position`` if every row takes ``__times`` of them in a run, and the ``offset`` in its run.

    ``draws`` has one row per draw, ``rows`` any other columns beside those of :func:`index_rows`. Runs and draws meet by
    position blocks; ``widths`` lists ``(*by, width)``, best the positions of the group over its rows. Nothing is expanded to single positions.
    """
    by = list(by)
    if bits == 0:
        upto = Window.partitionBy(*by).orderBy("__order", row_id).rowsBetween(Window.unboundedPreceding, 0)
        runs = rows.withColumn("__start", F.sum("__times").over(upto) - F.col("__times"))
    else:
        starts = _prefix_starts(rows, by, bits).select(*by, "__prefix", F.col("__start").alias("__before"))
        upto = Window.partitionBy(*by, "__prefix").orderBy("__order", row_id).rowsBetween(Window.unboundedPreceding, 0)
        runs = rows.withColumn("__prefix", _prefix(bits)).join(starts, [*by, "__prefix"]).withColumn(
            "__start", F.col("__before") + F.sum("__times").over(upto) - F.col("__times")).drop("__prefix", "__before")
    fields = [(c, rows.schema[c].dataType.simpleString()) for c in by] + [("__width", "bigint")]
    wide = F.broadcast(small_table(rows.sparkSession, widths, fields))  # a row per group
    blocks = F.sequence(F.expr("__start div __width"), F.expr("(__start + __times - 1) div __width"))
    runs = runs.drop("__order").join(wide, by).withColumn("__block", F.explode(blocks)).drop("__width")
    placed = draws.join(wide, by).withColumn("__block", F.expr("position div __width")).drop("__width")
    inside = (F.col("position") >= F.col("__start")) & (F.col("position") < F.col("__start") + F.col("__times"))
    met = runs.join(_known_size(placed, n_draws), [*by, "__block"]).filter(inside)
    return met.withColumn("offset", F.col("position") - F.col("__start")).drop("__block", "__start", "__times", "position")


def drawn_positions(rows: DataFrame, by, groups, seed, op: str, batches=None) -> DataFrame:
    """``by``, the batch, ``slot``, ``n`` and a ``position`` below ``n`` for every draw; see :func:`draw_with_replacement`."""
    key = [*by, *([batches[0]] if batches else [])]
    return expand_slots(_requests(rows, by, groups, batches), n_draws_of(groups, batches)).withColumn(
        "position", hash60(seed, op, *[F.col(c) for c in key], F.col("slot")) % F.col("n")
    ).drop("k")


def draw_with_replacement(rows: DataFrame, by, groups, row_id: str, seed, op: str,
                          batches=None, bits: int | None = None) -> DataFrame:
    """``k`` independent draws from each group, once or for each of several batches.

    ``groups`` lists ``(*by, n, k)``; ``batches`` is the name of the batch column and the
    number of batches (one for all groups, or a list). The result holds ``by``, the batch, ``slot`` and ``row_id``.
    """
    by = list(by)
    bits = prefix_bits(max(g[-2] for g in groups)) if bits is None else bits
    return rows_at_positions(drawn_positions(rows, by, groups, seed, op, batches), rows, by, row_id, bits, n_draws_of(groups, batches))


def permuted(df: DataFrame, column: str, name: str, n: Column, key, inverse: bool = False) -> DataFrame:
    """``df`` with ``name``, the image of ``column`` under a permutation of ``0 … n-1`` that ``key`` selects, or its origin.

    Four Feistel rounds over the pairs ``(l, r)`` with ``l < a``, ``r < b``, ``a * b >= n``; images from ``n``
    on are permuted again until one falls below. At most ``a - 1 < sqrt(n) + 1`` numbers lie beyond, so the
    walk ends within a step or two; one that has not after ``_WALK_STEPS`` raises. Every row takes the first step as plain
    columns, only those beyond ``n`` walk on.
    """
    a, b = F.col("__a"), F.col("__b")

    def turned(i: int, left: Column, right: Column, tag=None) -> Column:
        """The half that round ``i`` (hashed as ``tag``) changes."""
        half, other, size = (left, right, a) if i % 2 == 0 else (right, left, b)
        moved = hash60(*key, i if tag is None else tag, other)
        return F.pmod(half - moved, size) if inverse else (half + moved) % size

    rounds = (3, 2, 1, 0) if inverse else (0, 1, 2, 3)

    def image(v: Column) -> Column:
        def step(s: Column, i: Column) -> Column:
            left, right = (F.struct(turned(0, s["l"], s["r"], i).alias("l"), s["r"].alias("r")),
                           F.struct(s["l"].alias("l"), turned(1, s["l"], s["r"], i).alias("r")))
            return F.when(i % 2 == 0, left).otherwise(right)

        start = F.struct(F.floor(v / b).cast("bigint").alias("l"), (v % b).alias("r"))
        return F.aggregate(F.array(*map(F.lit, rounds)), start, step, lambda s: s["l"] * b + s["r"])

    def ended(v: Column) -> Column:
        return F.when(v < n, v).otherwise(F.raise_error(F.lit("a draw did not end; change the seed")).cast("bigint"))

    wide = df.withColumn("__a", F.floor(F.sqrt(n.cast("double"))).cast("bigint") + 1).withColumn("__b", F.floor((n + a - 1) / a).cast("bigint"))
    wide = wide.withColumn("__l", F.expr(f"`{column}` div __b")).withColumn("__r", F.col(column) % b)
    for i in rounds:
        wide = wide.withColumn("__l" if i % 2 == 0 else "__r", turned(i, F.col("__l"), F.col("__r")))
    once = wide.withColumn("__v", F.col("__l") * b + F.col("__r"))
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(_WALK_STEPS - 1)), F.col("__v"),
                         lambda v, _: F.when(v < n, v).otherwise(image(v)), ended)
    last = F.when(F.col("__v") < n, F.col("__v")).otherwise(walked)
    return once.withColumn(name, last).drop("__a", "__b", "__l", "__r", "__v")


def _computed_once(df: DataFrame, column: str) -> DataFrame:
    """Filters on ``column`` stay above the ``explode``; pushed below, they would compute it once more."""
    return df.withColumn(column, F.explode(F.array(column)))


def _positions(rows: DataFrame, by, row_id: str, bits: int) -> DataFrame:
    """``by``, ``row_id`` and ``position`` for every position of every row."""
    if bits == 0:
        return _ranked(rows, by, row_id, "position")
    in_prefix = [*by, "__prefix"]
    ranked = _ranked(rows.withColumn("__prefix", _prefix(bits)), in_prefix, row_id, "__rank")
    starts = _prefix_starts(rows, by, bits).select(*in_prefix, "__start")
    return ranked.join(starts, in_prefix).withColumn("position", F.col("__start") + F.col("__rank")).drop("__prefix", "__start", "__rank")


def draw_without_replacement(rows: DataFrame, by, groups, row_id: str, seed, op: str,
                             batches=None, bits: int | None = None) -> DataFrame:
    """``k`` distinct rows (``k <= n``) from each group; ``draw_key`` is the order of drawing.

    Slot ``0 … k-1`` takes the position that a keyed permutation of the group's positions gives it:
    distinct by construction, at the cost of ``k`` draws whatever the size of the group. Groups of which
    a good part is drawn go the other way: every row is ranked once and finds its own slot in each batch by
    the inverse permutation, without a join of draws and rows. Of groups drawn whole no row needs its slot to be
    known as drawn, so that ``draw_key`` is computed there only if it is read.
    """
    by = list(by)
    if any(g[-1] > g[-2] for g in groups):
        raise ValueError("more distinct rows asked for than the group has")
    key = by + ([batches[0]] if batches else [])
    counts = None if batches is None else [batches[1]] * len(groups) if isinstance(batches[1], int) else batches[1]
    keyed = [seed, op, *[F.col(c) for c in key]]

    def part(kind: str):
        """The groups of one kind, and their batches."""
        kinds = ["whole" if n == k else "dense" if k * _DENSE >= n else "sparse" for *_, n, k in groups]
        chosen = [i for i, found in enumerate(kinds) if found == kind]
        return [groups[i] for i in chosen], None if counts is None else (batches[0], [counts[i] for i in chosen])

    drawn = []
    sparse, its = part("sparse")
    if sparse:
        n_slots = n_draws_of(sparse, its)
        length = prefix_bits(max(g[-2] for g in sparse)) if bits is None else bits
        slots = expand_slots(_requests(rows, by, sparse, its), n_slots, slot="draw_key")
        slots = _computed_once(permuted(slots, "draw_key", "position", F.col("n"), keyed).drop("k"), "position")
        drawn.append(rows_at_positions(slots, rows, by, row_id, length, n_slots).select(*key, "draw_key", row_id))
    for kind in ("dense", "whole"):
        chosen, its = part(kind)
        if not chosen:
            continue
        length = max(bits or 0, prefix_bits(max(g[-2] for g in chosen)))
        requests = F.broadcast(_requests(rows, by, chosen, its))  # a row per group and batch
        own = rows if len(chosen) == len(groups) else rows.join(F.broadcast(requests.select(*by).distinct()), by, "left_semi")
        placed = _positions(own, by, row_id, length).join(requests, by)
        slots = permuted(placed, "position", "draw_key", F.col("n"), keyed, inverse=True)
        if kind == "dense":
            slots = _computed_once(slots, "draw_key").filter(F.col("draw_key") < F.col("k"))
        drawn.append(slots.select(*key, "draw_key", row_id))
    return reduce(DataFrame.unionByName, drawn)
