"""SimHash near-dedup with deletion-variant signatures.

A fingerprint is cut into two segments of 32 bits. Of at most 3 differing bits one segment has at
most one, so two linked fingerprints share a segment with one bit blanked out. Every distinct
fingerprint is indexed under its 64 one-wildcard variants; equal variants are brought together by
a shuffle and verified on all bits.

Within a variant group only a spanning forest of the links is emitted, never all pairs. A group
larger than ``GROUP`` is cut again by one-wildcard variants of the other segment (16-bit halves);
what is left then fixes 46 of 64 bits, so that such a group has at most 2**18 members.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataloom.llm.common import components, keep

GROUP = 4096
_CHUNK = 1 << 16


def fingerprint(text: str | None, words: int = 3) -> int:
    """64-bit SimHash of one text: majority over the XXH64 (seed 42) of its word shingles."""
    tokens = (text or "").encode("utf-8", "replace").lower().split()  # bytes: only A-Z and ASCII white space
    if not tokens:
        return 0
    joined = memoryview(b" ".join(tokens))
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(words, len(tokens))
    starts, ends = starts[: len(tokens) - width + 1].tolist(), ends[width - 1:].tolist()
    total = np.zeros(64, np.int64)
    for i in range(0, len(starts), _CHUNK):
        hashes = [xxhash.xxh64_intdigest(joined[s:e], 42) for s, e in zip(starts[i:i + _CHUNK], ends[i:i + _CHUNK])]
        octets = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * total > len(starts)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.fromiter((fingerprint(t.as_py(), words) for t in batch.column(1)), np.uint64, batch.num_rows)
        yield pa.record_batch([batch.column(0), batch.column(2), pa.array(found.view(np.int64))], names=["doc_id", "text_hash", "fp"])


def forest(fps: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that span the components of ``fps`` (distinct uint64) under distance ``bits``."""
    left, out = fps, []
    while len(left) > 1:
        seeds, left = [left[0]], left[1:]
        while seeds and len(left):
            at = seeds.pop()
            near = np.bitwise_count(left ^ at) <= bits
            if near.any():
                new = left[near]
                left = left[~near]
                out.append((np.full(len(new), at), new))
                seeds.extend(new)
    return out


def _links(batches: Iterator[pa.RecordBatch], bits: int, limit: int | None) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key come in; links (over = false) or members of too large groups go out."""

    def emit(a, b, over):
        a, b = np.ascontiguousarray(a).view(np.int64), np.ascontiguousarray(b).view(np.int64)
        return pa.record_batch([pa.array(a), pa.array(b), pa.array(np.full(len(a), over))], names=["a", "b", "over"])

    def group(key, fps):
        fps = np.unique(fps)
        if limit and len(fps) > limit:
            return emit(np.full(len(fps), key), fps, True)
        found = forest(fps, bits)
        return emit(np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found]), False) if found else None

    key, held, large = None, [], False
    for batch in batches:
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        fps = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        cuts = np.flatnonzero(np.diff(keys)) + 1
        starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(keys)]))
        pairs = np.flatnonzero((ends - starts)[1:-1] == 2) + 1  # whole groups of two, all at once
        x, y = fps[starts[pairs]], fps[starts[pairs] + 1]
        near = (np.bitwise_count(x ^ y) <= bits) & (x != y)
        if near.any():
            yield emit(x[near], y[near], False)
        sizes = ends - starts
        for i in np.flatnonzero((sizes > 2) | (np.arange(len(starts)) == 0) | (np.arange(len(starts)) == len(starts) - 1)):
            if len(keys) == 0:
                break
            if keys[starts[i]] != key:
                if held and (out := group(key, np.concatenate(held))):
                    yield out
                key, held, large = keys[starts[i]], [], False
            part = fps[starts[i]:ends[i]]
            held.append(part)
            if limit and sum(map(len, held)) > limit:  # the rest of this group is passed on as it comes
                merged = np.unique(np.concatenate(held))
                large = large or len(merged) > limit
                if large:
                    yield emit(np.full(len(merged), key), merged, True)
                    held = []
                else:
                    held = [merged]
            elif large and held:
                yield emit(np.full(sum(map(len, held)), key), np.concatenate(held), True)
                held = []
    if held and (out := group(key, np.concatenate(held))):
        yield out


_VARIANTS = """transform(sequence(0, 63), p -> shiftleft(cast(p as bigint), 32) |
  ((case when p < 32 then fp & 4294967295 else shiftrightunsigned(fp, 32) end) & ~shiftleft(1L, p % 32)))"""
# the same for the halves of the other segment
_SUBVARIANTS = """transform(sequence(0, 31), q -> shiftleft(cast(q as bigint), 32) |
  ((case when q < 16 then other & 65535 else shiftright(other, 16) end) & ~shiftleft(1L, q % 16)))"""


def near_links(distinct: DataFrame, bits: int = 3, group_limit: int = GROUP) -> DataFrame:
    """Links ``a, b`` that span the components of the distinct fingerprints ``fp``.

    At most 3 bits: the two segments guarantee no more.
    """
    if not 0 <= bits <= 3:
        raise ValueError("bits must be 0 to 3")
    schema = "a long, b long, over boolean"
    keyed = distinct.select(F.explode(F.expr(_VARIANTS)).alias("key"), "fp")
    first = keep(
        keyed.repartition("key").sortWithinPartitions("key")
        .mapInArrow(partial(_links, bits=bits, limit=group_limit), schema)
    )
    large = first.where("over").select(F.col("a").alias("outer"), F.col("b").alias("fp"))
    other = F.expr("case when shiftrightunsigned(outer, 32) < 32 then shiftrightunsigned(fp, 32) else fp & 4294967295 end")
    cut = large.withColumn("other", other).select("outer", "fp", F.explode(F.expr(_SUBVARIANTS)).alias("inner"))
    second = (
        cut.select(F.xxhash64("outer", "inner").alias("key"), "fp").repartition("key").sortWithinPartitions("key")
        .mapInArrow(partial(_links, bits=bits, limit=None), schema)
    )
    found = first.where("not over").unionByName(second)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def simhash_groups(
    docs: DataFrame, words: int = 3, bits: int = 3, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, fingerprint, component_id, text_hash, first``.

    ``component_id`` is the smallest identifier that links of at most ``bits`` differing bits
    reach (null only if no member has one). ``first`` marks exactly one row of each component, the
    one with the smallest identifier; ``text_hash`` is XXH64 of its whole text. Null, empty and blank texts have fingerprint zero and link
    like any other. Other columns are not read.
    """
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, text_hash long, fp long"
    fps = keep(docs.select(F.col(id_col), F.col(text_col), F.xxhash64(F.col(text_col))).mapInArrow(partial(_fingerprints, words=words), schema))
    distinct = keep(fps.groupBy("fp").agg(F.min("doc_id").alias("low")))
    roots = components(near_links(distinct, bits))
    rooted = distinct.join(roots.withColumnRenamed("v", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = keep(rooted)
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.select("fp", "root").join(lows, "root")
    found = fps.join(named, "fp")
    # ties: only rows that repeat the smallest identifier of their component are ranked
    smallest = F.col("doc_id").eqNullSafe(F.col("component_id"))
    tie = Window.partitionBy("root", "doc_id", F.when(~smallest, F.monotonically_increasing_id())).orderBy("fp", "text_hash")
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "text_hash",
        (smallest & (F.row_number().over(tie) == 1)).alias("first"),
    )


def first_of_groups(docs: DataFrame, words: int = 3, bits: int = 3) -> DataFrame:
    """The rows of ``docs`` (with ``doc_id, text``) of which each near-duplicate group keeps one."""
    firsts = simhash_groups(docs, words, bits).where("first").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    twin = Window.partitionBy("_id", "_hash").orderBy("_hash")  # rows alike in identifier and text
    rows = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    joined = rows.join(firsts.withColumnsRenamed({"_id": "_i", "_hash": "_h"}), F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_hash") == F.col("_h")), "left_semi")
    return joined.withColumn("_twin", F.row_number().over(twin)).where("_twin = 1").select("_row.*")
