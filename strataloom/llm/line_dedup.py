"""Line dedup within one edit: a deletion-neighbourhood join in DataFrame operations.

Lines are compared after trimming and collapsing white space. A line goes if an earlier line is
equal, or, from ``min_chars`` characters on, at most one character edit away. Documents are ordered
by identifier, lines by position. Blank lines stay where they are.

Emitting every one-character deletion of every line would cost as many rows as the corpus has
characters. The neighbourhood is therefore taken in two steps, both without loss:

1. A line of ``m`` characters is cut into blocks; for each block, the line with that block left out
   is emitted as a hashed key (also for ``m = n - 1``, as the longer partner of a pair). Two lines one
   edit apart agree outside the block that holds the edit, so they share a key. Lines that share no
   key have no neighbour. The number of blocks grows with the root of the length.
2. For shared keys only, all deletions and gaps inside the block are emitted, hashed together with
   the block key and the position. All lines with one such key are one edit apart from each other:
   there are no more of them than letters in the alphabet, and the earliest of them decides. The
   edit distance is then verified on the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.llm.common import WHITE, keep
from strataloom.materialize import broadcast_if_small

_BLOCKS = "greatest(3, cast(floor(sqrt(m) / 8) as int))"


def _cut(j: str) -> str:
    return f"cast(floor(cast({j} as double) * m / {_BLOCKS}) as int)"


# keys of a line l of n characters, taken as a line of m = n - r characters: (r, j, key) per block
_BLOCK_KEYS = f"""
flatten(transform(array(0, 1), r -> transform(array(n - r), m -> transform(sequence(0, {_BLOCKS} - 1), j ->
  struct(r as r, j as j, xxhash64(m, j, substring(l, 1, {_cut('j')}), right(l, m - {_cut('(j + 1)')})) as key)))[0]))
"""

_SPACES = " \t\n\x0b\x0c\r"
SHORT = 1024  # lines below this length have three blocks


def _short_keys() -> Column:
    """The same keys of a line of three blocks, written out: as a plain expression they take a fraction of the time."""
    l, n = F.col("l"), F.col("n")
    keys = []
    for r in (0, 1):
        m = n - r
        cuts = [F.lit(0), F.floor(m / 3).cast("int"), F.floor(2 * m / 3).cast("int"), m]
        keys += [F.xxhash64(m, F.lit(j), F.substring(l, F.lit(1), cuts[j]), F.right(l, m - cuts[j + 1])) for j in range(3)]
    return F.array(*keys)


def line_text(line: Column) -> Column:
    """Trimmed, every run of white space as one space."""
    odd = F.contains(line, F.lit("  "))
    for space in _SPACES[1:]:
        odd = odd | F.contains(line, F.lit(space))
    return F.trim(F.when(odd, F.regexp_replace(line, WHITE, " ")).otherwise(line))


def _lines(docs: DataFrame) -> DataFrame:
    """``first`` (order of the occurrence), ``l`` for every line that is not blank."""
    exploded = docs.select("doc_id", "dh", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "dh", "at").alias("first")
    return exploded.select(first, line_text(F.col("line")).alias("l")).where("l <> ''")


def _digest(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("d1"), F.xxhash64(F.reverse(line)).alias("d2")]


def kept_lines(docs: DataFrame, min_chars: int = 20) -> DataFrame:
    """``first`` of every line that stays, from ``docs`` (``doc_id, dh, text``)."""
    seen = _lines(docs).withColumn("n", F.length("l"))
    long_keys = F.transform(F.expr(_BLOCK_KEYS), lambda x: x["key"])
    keys = F.when(F.col("n") >= min_chars, F.when(F.col("n") < SHORT, _short_keys()).otherwise(long_keys))
    seen = seen.select("first", "n", *_digest(F.col("l")), keys.alias("keys"))
    lines = keep(seen.groupBy("d1", "d2").agg(F.min("first").alias("first"), F.first("keys").alias("keys")))

    blocked = lines.where("keys is not null").select("d1", "d2", "first", F.posexplode("keys").alias("k", "key"))
    shared = keep(blocked.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key"))
    near = keep(blocked.join(shared, "key"))

    # the texts of lines that share a key, from the document of their first occurrence
    wanted = near.groupBy("d1", "d2", "first").agg(F.collect_list(F.struct("k", "key")).alias("hits"))
    wanted = keep(wanted.select("d1", "d2", "hits", "first", F.col("first.doc_id").alias("wd"), F.col("first.dh").alias("wh")))
    texts = keep(
        docs.join(broadcast_if_small(wanted, 50_000), docs["doc_id"].eqNullSafe(wanted["wd"]) & (docs["dh"] == wanted["wh"]))
        .select("d1", "d2", "first", "hits", line_text(F.split("text", "\n")[F.col("first.at")]).alias("l"))
        .dropDuplicates(["d1", "d2"])
    )

    # k counts the blocks of r = 0, then those of r = 1
    hit = texts.select("d1", "d2", "first", "l", F.explode("hits").alias("hit")).select(
        "d1", "d2", "first", "l", "hit.k", "hit.key", F.length("l").alias("n"))
    hit = hit.withColumn("m", F.col("n")).withColumn("b0", F.expr(_BLOCKS))
    hit = hit.withColumn("r", F.when(F.col("k") < F.col("b0"), 0).otherwise(1)).withColumn("m", F.col("n") - F.col("r"))
    hit = hit.withColumn("j", F.when(F.col("r") == 0, F.col("k")).otherwise(F.col("k") - F.col("b0")))
    region = f"substring(l, {_cut('j')} + 1, n - {_cut('j')} - (m - {_cut('(j + 1)')}))"
    hit = hit.select("d1", "d2", "first", "key", "r", F.expr(region).alias("x"))
    cuts = "transform(sequence(1, length(x)), o -> xxhash64(key, o, concat(substring(x, 1, o - 1), substring(x, o + 1))))"
    gaps = "transform(sequence(1, length(x) + 1), o -> xxhash64(key, o, x))"
    emitted = F.expr(f"case when length(x) = 0 then array(xxhash64(key, 1, x)) when r = 0 then concat({cuts}, {gaps}) else {cuts} end")
    variants = hit.select("d1", "d2", "first", F.explode(emitted).alias("variant"))
    earliest = variants.withColumn("low", F.min("first").over(Window.partitionBy("variant")))
    pairs = earliest.where("low < first").select("d1", "d2", "first", "low").distinct()
    known = texts.select(F.col("first").alias("low"), F.col("l").alias("low_l"))
    own = texts.select("first", "l")
    gone = pairs.join(own, "first").join(known, "low").where(F.levenshtein("l", "low_l", 1).between(0, 1))
    return lines.select("first").join(gone.select("first").distinct(), "first", "left_anti")


def dedup_lines(docs: DataFrame, min_chars: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text`` (without the repeated lines), ``n_lines, n_kept, has_lines, had_text, row``.

    ``row`` holds the other columns, so that no name can clash. ``has_lines`` tells whether a line that is
    not blank was kept. Null and empty texts
    have no lines and come back as they were. Rows that share identifier and text get the same
    decisions. Null identifiers come last in the order. A document can lose all its lines; its text
    is then empty. An empty table gives an empty table.
    """
    wide = docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("dh"), F.col(text_col).alias("text"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("row"),
    )
    narrow = wide.where("text is not null and text <> ''").select("doc_id", "dh", "text")
    stays = kept_lines(narrow, min_chars).select("first.*")
    stays = stays.groupBy(F.col("doc_id").alias("_d"), F.col("dh").alias("_h")).agg(F.collect_list("at").alias("at"))
    joined = wide.join(stays, wide["doc_id"].eqNullSafe(stays["_d"]) & (wide["dh"] == stays["_h"]), "left").drop("_d", "_h")
    lines = F.split("text", "\n")
    joined = joined.withColumn("lines", lines)
    blank = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: F.trim(F.element_at("lines", i + 1), F.lit(_SPACES)) == "")
    order = F.array_sort(F.array_union(F.coalesce("at", F.array().cast("array<int>")), blank))
    had = F.coalesce(F.col("text") != "", F.lit(False))
    kept = joined.withColumn("order", F.when(had, order))
    text = F.when(F.size("order") > 0, F.array_join(F.transform("order", lambda i: F.element_at("lines", i + 1)), "\n"))
    return kept.select(
        "doc_id", F.when(had, F.coalesce(text, F.lit(""))).otherwise(F.col("text")).alias("text"),
        F.when(had, F.size("lines")).otherwise(0).cast("long").alias("n_lines"),
        F.when(had, F.size("order")).otherwise(0).cast("long").alias("n_kept"),
        F.coalesce(F.size("at") > 0, F.lit(False)).alias("has_lines"), had.alias("had_text"), "row",
    )
