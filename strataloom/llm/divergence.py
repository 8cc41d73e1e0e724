"""Divergence of the sources of each language, term by term.

The terms of a language are numbered inside blocks of bounded size, and a group (language, source) holds one
pair of sorted arrays, term numbers and counts, per block. For every unordered pair of groups and every
block a task has both arrays: a galloping search finds the common terms, which are priced with both
counts; terms of one side alone are priced against a count of zero, in both directions. Terms that
neither side holds all have the same price, so their number is enough; it is added at the end.
A task serves the pairs of two tiles of groups, so its size is bounded in groups and in terms.

A group's share of a term is ``1 + floor(10^9 * (count + 1) / (N + V))``, in whole numbers throughout: the
quotient is taken in three steps of base 1,000, so that no product leaves 64 bits for any count below 9 * 10^15.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.llm.common import keep
from strataloom.materialize import broadcast_if_small

# What is no letter of A-Z and below 128 parts terms; A-Z in lower case. All other bytes of UTF-8 are 128 and more.
_FOLD = bytes(c if c >= 128 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
BLOCK = 262_144  # pairs of a group and a term in a block, on average
TILE = 32  # groups of a tile
HELD = 8_000_000  # characters of the texts whose terms are counted together
MOST_TASKS = 10_000
STEPS, BASE = 3, 1_000  # the scale of the shares is BASE ** STEPS


def terms_of(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """All terms of the texts in order, A-Z in lower case, and the number of the text that each stands in."""
    parts = [t.encode().translate(_FOLD) for t in texts]
    ends = np.cumsum([len(x) + 1 for x in parts])
    line = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
    inside = line != 32
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    starts, stops = edges[::2], edges[1::2]
    places = np.concatenate([[0], np.cumsum(stops - starts)]).astype(np.int32)
    terms = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(line[inside])])
    return terms, np.searchsorted(ends, starts, side="right")


def share(count: Column, total: Column, n_terms: Column) -> Column:
    """``1 + floor(10^9 * (count + 1) / (total + n_terms))``."""
    rest, whole, by = count + 1, F.lit(0).cast("long"), total + n_terms
    for _ in range(STEPS):
        rest = rest * BASE
        whole, rest = whole * BASE + F.call_function("div", rest, by), rest % by
    return whole + 1


def gap(p: Column, q: Column) -> Column:
    """``floor((p - q)^2 / q)``."""
    return F.call_function("div", (p - q) * (p - q), q)


def _shares(counts: np.ndarray, total: int, n_terms: int) -> np.ndarray:
    rest, whole, by = counts + 1, np.zeros(len(counts), dtype=np.int64), total + n_terms
    for _ in range(STEPS):
        rest = rest * BASE
        whole, rest = whole * BASE + rest // by, rest % by
    return whole + 1


def gallop(needles: np.ndarray, hay: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which ``needles`` stand in ``hay``, and where; both sorted, distinct and not negative.

    A number ``x`` cannot stand after position ``x``. All needles go down from there at once in doubling
    steps until they pass their place, and halve the last step.
    """
    high = np.minimum(needles, len(hay) - 1)
    low, step = high.copy(), 1
    over = np.flatnonzero(hay[low] > needles)
    while len(over):
        high[over] = low[over]
        low[over] = np.maximum(low[over] - step, 0)
        step *= 2
        over = over[(hay[low[over]] > needles[over]) & (low[over] > 0)]
    wide = np.flatnonzero(high - low > 1)
    while len(wide):
        middle = (low[wide] + high[wide]) // 2
        right = hay[middle] <= needles[wide]
        low[wide[right]], high[wide[~right]] = middle[right], middle[~right]
        wide = wide[high[wide] - low[wide] > 1]
    at = np.where(hay[high] == needles, high, low)
    return hay[at] == needles, at


class Side(NamedTuple):
    """One group's terms of one block: numbers and shares, and the share of every term that it does not hold."""

    name: str
    ids: np.ndarray
    shares: np.ndarray
    rest: int


def merge(a: Side, b: Side) -> tuple[int, int, int]:
    """Prices of one block in both directions, and the number of terms that either side holds."""
    if len(a.ids) > len(b.ids):
        back, forth, held = merge(b, a)
        return forth, back, held
    alone = np.ones(len(b.ids), dtype=bool)
    common, at = gallop(a.ids, b.ids) if len(a.ids) else (np.zeros(0, dtype=bool), np.zeros(0, dtype=np.int64))
    alone[at[common]] = False
    forth = back = 0
    for x, y in ((a.shares[common], b.shares[at[common]]), (a.shares[~common], b.rest), (a.rest, b.shares[alone])):
        square = (x - y) * (x - y)
        forth, back = forth + int((square // y).sum()), back + int((square // x).sum())
    return forth, back, len(a.ids) + int(alone.sum())


def _pair_tasks(table: pa.Table) -> pa.Table:
    """All unordered pairs of two tiles of groups (or within one tile), for one block of terms, in both directions.

    A group brings one row without a term, which holds its totals, and one for every term of the block that it holds.
    """
    one = {c: table[c][0].as_py() for c in ("lang", "ta", "tb")}
    heads = table.filter(pc.is_null(table["no"])).select(["tile", "source", "total", "n_terms"]).to_pylist()
    rows = table.filter(pc.is_valid(table["no"]))
    names = {h["source"]: i for i, h in enumerate(heads)}
    coded = rows["source"].combine_chunks().dictionary_encode()
    owner = np.array([names[x] for x in coded.dictionary.to_pylist()], dtype=np.int64)[coded.indices.to_numpy()] if len(coded) else np.zeros(0, dtype=np.int64)
    no, n = rows["no"].to_numpy().astype(np.int64), rows["n"].to_numpy().astype(np.int64)
    order = np.lexsort((no, owner))
    owner, no, n = owner[order], no[order], n[order]
    cuts = np.searchsorted(owner, np.arange(len(heads) + 1))
    sides: dict[int, list[Side]] = {}
    for i, h in enumerate(heads):
        at = slice(cuts[i], cuts[i + 1])
        shares = _shares(np.append(n[at], 0), h["total"], h["n_terms"])
        sides.setdefault(h["tile"], []).append(Side(h["source"], no[at], shares[:-1], int(shares[-1])))
    left, right = sides.get(one["ta"], []), sides.get(one["tb"], [])
    found = []
    for a, b in combinations(left, 2) if one["ta"] == one["tb"] else product(left, right):
        forth, back, held = merge(a, b)
        found += [(a.name, b.name, forth, held), (b.name, a.name, back, held)]
    columns = {c: pa.array([f[i] for f in found], pa.string() if i < 2 else pa.int64()) for i, c in enumerate(("source", "item", "value", "held"))}
    return pa.table({"lang": pa.array([one["lang"]] * len(found), pa.string()), **columns})


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences, and documents with the term, per group and term of a bounded part of the texts."""
    def counted(groups: list[int], texts: list[str]) -> pa.RecordBatch:
        terms, doc = terms_of(texts)
        coded = terms.dictionary_encode()
        n_terms = max(1, len(coded.dictionary))
        cells, times = np.unique(doc * n_terms + coded.indices.to_numpy(), return_counts=True)  # of a document and a term
        names, group = np.unique(np.array(groups, dtype=np.int64), return_inverse=True)
        keys, at = np.unique(group[cells // n_terms] * n_terms + cells % n_terms, return_inverse=True)
        return pa.record_batch({
            "gid": pa.array(names[keys // n_terms]), "term": coded.dictionary.take(pa.array(keys % n_terms)),
            "n": pa.array(np.bincount(at, weights=times, minlength=len(keys)).astype(np.int64)), "docs": pa.array(np.bincount(at, minlength=len(keys)).astype(np.int64)),
        })

    groups, texts, size = [], [], 0
    for batch in batches:
        for gid, text in zip(batch.column("gid").to_pylist(), batch.column("text").to_pylist()):
            groups.append(gid)
            texts.append(text)
            size += len(text)
            if size > HELD:
                yield counted(groups, texts)
                groups, texts, size = [], [], 0
    if texts:
        yield counted(groups, texts)


def _number(table: pa.Table, min_docs: int) -> pa.Table:
    """The rows of one block without the terms that too few documents hold; terms get numbers and their occurrences in the language."""
    coded = table["term"].combine_chunks().dictionary_encode()
    codes, n = coded.indices.to_numpy(), table["n"].to_numpy()
    in_docs, lang_n = np.zeros(len(coded.dictionary), np.int64), np.zeros(len(coded.dictionary), np.int64)
    np.add.at(in_docs, codes, table["docs"].to_numpy())
    np.add.at(lang_n, codes, n)
    stays = in_docs >= min_docs
    rows = np.flatnonzero(stays[codes])
    out = table.select(["gid", "lang", "block", "term"]).take(pa.array(rows))
    no = (np.cumsum(stays) - 1)[codes[rows]]
    return out.append_column("no", pa.array(no, pa.int32())).append_column("n", pa.array(n[rows])).append_column("lang_n", pa.array(lang_n[codes[rows]]))


def _pairs(held: DataFrame, groups: DataFrame, tile: int) -> DataFrame:
    """``lang, source, item, value, held``: sums over the terms that either of two sources holds; languages with terms only.

    Groups come in tiles; a task takes two tiles, so a group is sent once per tile and not once per partner.
    """
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    tiles = F.ceil(F.count(F.lit(1)).over(Window.partitionBy("lang")) / tile).cast("int")
    groups = broadcast_if_small(keep(groups.withColumn("tile", F.floor(place / tile).cast("int")).withColumn("tiles", tiles)))
    blocks = keep(held.select("lang", "block").distinct())
    nothing = F.lit(None).cast("long")
    heads = groups.join(broadcast_if_small(blocks), "lang").select("lang", "block", "source", "tile", "tiles", "total", "n_terms", F.lit(None).cast("int").alias("no"), nothing.alias("n"))
    rows = held.join(groups, "gid").select(held["lang"], "block", "source", "tile", "tiles", nothing.alias("total"), nothing.alias("n_terms"), "no", "n")
    dealt = heads.unionByName(rows).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.withColumn("ta", F.least("tile", "other")).withColumn("tb", F.greatest("tile", "other")).drop("other", "tiles")
    keys = ["lang", "block", "ta", "tb"]
    n_tasks = min(MOST_TASKS, max(1, blocks.count()))
    merged = dealt.repartition(n_tasks, *keys).groupBy(*keys).applyInArrow(_pair_tasks, "lang string, source string, item string, value long, held long")
    return merged.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"), F.sum("held").alias("held"))


def _ranked(rows: DataFrame, top: int | None = None) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = rows.withColumn("rank", rank)
    return ranked if top is None else ranked.where(F.col("rank") <= top)


def source_divergence(
    docs: DataFrame, min_docs: int = 3, top_terms: int = 200, block: int = BLOCK, tile: int = TILE,
    text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
) -> DataFrame:
    """``lang, source, part, item, value, rank``.

    Part ``pair``: every other source of the language, with the sum of ``floor((p - q)^2 / q)`` over all terms
    of the language, ``p`` and ``q`` the shares of the term in the source and in the other one. Part ``term``: the
    ``top_terms`` terms that the source holds oftener than the language as a whole, by the same measure against the
    share in the language. A term belongs to a language if at least ``min_docs`` of its rows hold it; rows that
    repeat count each. Null text, language and source are empty texts and take part. A language without terms
    gives pairs of value 0 and no terms; an empty table gives an empty table; other columns are not read.
    """
    rows = docs.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    groups = keep(rows.select("lang", "source").distinct().withColumn("gid", F.monotonically_increasing_id()))
    known = broadcast_if_small(groups)
    found = rows.join(known, ["lang", "source"]).select("gid", "text").mapInArrow(_count_terms, "gid long, term string, n long, docs long")
    counts = keep(found.groupBy("gid", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))

    # terms of one block stand together: their documents are added up, those kept are numbered
    blocks = max(1, -(-counts.count() // block))
    spread = counts.join(broadcast_if_small(groups.select("gid", "lang")), "gid").withColumn("block", F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int"))
    numbered = spread.groupBy("lang", "block").applyInArrow(lambda t: _number(t, min_docs), "gid long, lang string, block int, term string, no int, n long, lang_n long")
    held = keep(numbered)

    sums = held.groupBy("lang", "block").agg((F.max("no") + 1).alias("terms"), F.sum("n").alias("n"))
    langs = sums.groupBy("lang").agg(F.sum("terms").cast("long").alias("n_terms"), F.sum("n").alias("lang_total"))
    totals = held.groupBy("gid").agg(F.sum("n").alias("total"))
    zero = F.lit(0).cast("long")
    groups = keep(groups.join(broadcast_if_small(keep(langs)), "lang", "left").join(broadcast_if_small(keep(totals)), "gid", "left").fillna(0, ["n_terms", "lang_total", "total"]))

    own = held.select("gid", "term", "n", "lang_n").join(broadcast_if_small(groups), "gid")
    p, q = share(F.col("n"), F.col("total"), F.col("n_terms")), share(F.col("lang_n"), F.col("lang_total"), F.col("n_terms"))
    over = own.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    best = _ranked(over.select("lang", "source", "item", gap(F.col("p"), F.col("q")).alias("value")), top_terms)

    both = _pairs(held, groups.drop("lang_total"), tile)
    others = groups.select("lang", F.col("source").alias("item"), F.col("total").alias("other_total"))
    pairs = groups.join(broadcast_if_small(others), "lang").where("source <> item").join(both, ["lang", "source", "item"], "left")
    rest = F.col("n_terms") - F.coalesce("held", zero)
    absent = F.when(rest > 0, rest * gap(share(zero, F.col("total"), F.col("n_terms")), share(zero, F.col("other_total"), F.col("n_terms"))))
    apart = _ranked(pairs.select("lang", "source", "item", (F.coalesce("value", zero) + F.coalesce(absent, zero)).alias("value")))

    parts = [r.select("lang", "source", F.lit(n).alias("part"), "item", "value", "rank") for n, r in (("pair", apart), ("term", best))]
    return parts[0].unionByName(parts[1])
