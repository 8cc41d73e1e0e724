"""Secret scans through a trigram index.

Each rule is a regular expression. From its parse tree a Boolean query over trigrams is derived that every text with
a match must satisfy: an AND of ORs of strings, brought to clauses (sets of trigrams, one of which a text must hold
whole). The index lists, for every trigram of any rule, the documents whose lower-cased text holds it. The postings of
a clause's trigrams are intersected, and only the documents found are matched with the rule's expression. Rules
from which no trigram follows (a class repeated, for instance) match all texts.

Limits on the size of the derived query only make it weaker: a part that would grow too large is left out,
which adds candidates and loses none.
"""

from __future__ import annotations

import re
from itertools import product
from re import _constants as op
from re import _parser as regex
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.llm.common import keep
from strataloom.materialize import broadcast_if_small

STRINGS = 64  # alternatives followed through a pattern
CHARS = 8  # characters of a class that are spelled out
CLAUSES = 64

Strings = frozenset[str]
Clause = frozenset[str]


class Rule(NamedTuple):
    """``pattern`` is read by Java and Python alike. A match whose ``group`` is shorter than ``least`` is dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),
)
# Published formats of tokens and key files.
ADDED = (
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("forge", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[0-9A-Za-z-]{10,}"),
)
RULES = BASE + ADDED


def trigrams(text: str) -> Clause:
    return frozenset(text[i:i + 3] for i in range(len(text) - 2))


class _Walk:
    """Strings that the part read so far may end in, and the conditions found on the way (each an OR of strings)."""

    def __init__(self):
        self.ends: set[str] = {""}
        self.found: list[set[Clause]] = []

    def cut(self) -> None:
        """What comes next is unknown: the strings at hand become a condition."""
        clauses = {trigrams(s) for s in self.ends}
        if all(clauses):
            self.found.append(clauses)
        self.ends = {""}

    def add(self, strings: Strings) -> None:
        if len(self.ends) * len(strings) > STRINGS:
            self.cut()
        self.ends = {a + b for a, b in product(self.ends, strings)}


def _exact(items) -> Strings | None:
    """All strings that the items match, in lower case; None if there are too many."""
    known = {""}
    for item in items:
        here = _exact_item(*item)
        if here is None or len(known) * len(here) > STRINGS:
            return None
        known = {a + b for a, b in product(known, here)}
    return frozenset(known)


def _exact_item(kind, arg) -> Strings | None:
    if kind is op.LITERAL:
        return frozenset([chr(arg).lower()]) if arg < 128 else None  # other letters can change in number
    if kind is op.IN:
        chars: set[str] = set()
        for what, value in arg:
            if what is op.LITERAL and value < 128:
                chars.add(chr(value).lower())
            elif what is op.RANGE and value[1] < 128:
                chars |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None
        return frozenset(chars) if len(chars) <= CHARS else None
    if kind is op.SUBPATTERN:
        return _exact(arg[-1])
    if kind is op.BRANCH:
        parts = [_exact(p) for p in arg[1]]
        return None if None in parts or sum(map(len, parts)) > STRINGS else frozenset().union(*parts)
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT) and arg[1] <= 4:
        one = _exact(arg[2])
        if one is None or len(one) ** arg[1] > STRINGS:
            return None
        return frozenset("".join(p) for n in range(arg[0], arg[1] + 1) for p in product(one, repeat=n))
    if kind in (op.AT, op.ASSERT, op.ASSERT_NOT):
        return frozenset([""])
    return None


def _read(walk: _Walk, items) -> None:
    for kind, arg in items:
        known = _exact_item(kind, arg)
        if known is not None:
            walk.add(known)
        elif kind is op.SUBPATTERN:
            _read(walk, arg[-1])
        elif kind is op.BRANCH:
            walk.cut()
            parts = [_clauses(p) for p in arg[1]]
            if all(parts):
                walk.found.append(set().union(*parts))
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT) and arg[0] > 0:
            # the first turn joins what stands before, the last what comes after
            _read(walk, arg[2])
            walk.cut()
            ends = _exact(arg[2])
            walk.add(ends if ends is not None else frozenset([""]))
        else:
            walk.cut()


def _least(clauses: set[Clause]) -> set[Clause]:
    """Without clauses that contain another one."""
    return {c for c in clauses if not any(d < c for d in clauses)}


def _clauses(items) -> set[Clause]:
    walk = _Walk()
    _read(walk, items)
    walk.cut()
    whole: set[Clause] = {frozenset()}
    for condition in sorted((_least(c) for c in walk.found), key=len):
        if len(whole) * len(condition) <= CLAUSES:
            whole = _least({a | b for a, b in product(whole, condition)})
    return whole if all(whole) else set()


def trigram_query(pattern: str) -> list[Clause]:
    """A text that matches ``pattern`` holds, in lower case, all trigrams of one of the clauses; none: no such bound."""
    return sorted(_clauses(regex.parse(pattern)), key=sorted)


def postings(texts: DataFrame, grams: list[str]) -> DataFrame:
    """The index: ``gram, doc_id, h`` for the ``grams`` that the lower-cased texts hold, one row for equal texts of one identifier."""
    held = F.concat(*[F.when(F.contains("low", F.lit(g)), F.array(F.lit(g))).otherwise(F.array().cast("array<string>")) for g in grams])
    rows = texts.select("doc_id", "h", F.lower("text").alias("low")).select("doc_id", "h", held.alias("grams")).where(F.size("grams") > 0)
    rows = rows.groupBy("doc_id", "h").agg(F.first("grams").alias("grams"))
    return keep(rows.select(F.explode("grams").alias("gram"), "doc_id", "h").sortWithinPartitions("gram"))


def candidates(index: DataFrame, queries: dict[int, list[Clause]]) -> DataFrame:
    """``doc_id, h, rules``: rules of which some clause has all its trigrams in the document's postings."""
    listed = [(rule, 100 * rule + i, len(c), g) for rule, clauses in queries.items() for i, c in enumerate(clauses) for g in sorted(c)]
    # the clauses come from the rules: CLAUSES of them a rule at most
    clauses = index.sparkSession.createDataFrame(listed, "rule int, clause int, need int, gram string")
    met = index.join(F.broadcast(clauses), "gram").groupBy("doc_id", "h", "rule", "clause", "need").agg(F.count(F.lit(1)).alias("n"))
    return met.where("n = need").groupBy("doc_id", "h").agg(F.collect_set("rule").alias("rules"))


def _matches(number: int, rule: Rule) -> Column:
    """One entry per match, those to be dropped too: text before it (since the last match), lengths of the match and the group."""
    def found(group: int) -> Column:
        return F.transform(F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(group)), F.length)

    sizes = found(0)
    before = F.transform(F.split("text", rule.pattern, -1), F.length)
    zipped = F.arrays_zip(before.alias("before"), sizes.alias("size"), (found(rule.group) if rule.group else sizes).alias("inner"))
    entries = F.transform(zipped, lambda x, i: F.struct(
        F.lit(number).alias("kind"), i.alias("i"), x["before"].alias("before"), x["size"].alias("size"), x["inner"].alias("inner")))
    return F.filter(entries, lambda x: x["size"].isNotNull())  # the text after the last match has none


def _all_matches(rows: DataFrame, rules: list[tuple[int, Rule]], wanted: Column | None = None) -> DataFrame:
    none = F.array().cast("array<struct<kind:int,i:int,before:int,size:int,inner:int>>")
    # a text without a match is read once
    parts = [F.when(F.col("text").rlike(r.pattern) if wanted is None else F.array_contains(wanted, n), _matches(n, r)).otherwise(none) for n, r in rules]
    return rows.select("doc_id", "h", F.inline(F.concat(*parts) if len(parts) > 1 else parts[0]))


def secret_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, spans``, an array of ``start, no, end, kind`` sorted by start and rule.

    Matches of one rule are leftmost and do not overlap; a match that its rule drops still covers its text.
    Positions count code points, the end is exclusive. Null text counts as empty. Rows that repeat identifier and text
    get equal spans. An empty table gives an empty table; other columns are not read.
    """
    for rule in rules:
        if not 0 <= rule.group <= re.compile(rule.pattern).groups:
            raise ValueError(f"rule {rule.kind!r}: no group {rule.group}")
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    texts = texts.withColumn("h", F.xxhash64("text"))
    queries = {n: trigram_query(r.pattern) for n, r in enumerate(rules)}
    indexed = {n: q for n, q in queries.items() if q}
    scanned = [(n, r) for n, r in enumerate(rules) if n not in indexed]
    found = []
    if indexed:
        index = postings(texts, sorted({g for q in indexed.values() for c in q for g in c}))
        hits = broadcast_if_small(keep(candidates(index, indexed)).select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), "rules"))
        chosen = texts.join(hits, texts["doc_id"].eqNullSafe(hits["_id"]) & (texts["h"] == hits["_h"]))
        found.append(_all_matches(chosen, [(n, rules[n]) for n in indexed], F.col("rules")))
    if scanned:
        found.append(_all_matches(texts, scanned))
    matches = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    # equal texts of one identifier give equal rows
    matches = matches.distinct()
    upto = Window.partitionBy("doc_id", "h", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("before").cast("long") + F.col("size")).over(upto)
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    least = F.array(*[F.lit(r.least) for r in rules])
    spans = (
        matches.withColumn("end", end).where(F.col("inner") >= F.get(least, F.col("kind")))
        .groupBy("doc_id", "h")
        .agg(F.array_sort(F.collect_list(F.struct((F.col("end") - F.col("size")).alias("start"), F.col("kind").alias("no"), "end", F.get(kinds, F.col("kind")).alias("kind")))).alias("spans"))
        .select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), "spans")
    )
    spans = broadcast_if_small(keep(spans), 20_000)
    rows = texts.select("doc_id", "h")
    joined = rows.join(spans, rows["doc_id"].eqNullSafe(spans["_id"]) & (rows["h"] == spans["_h"]), "left")
    return joined.select("doc_id", F.coalesce("spans", F.array().cast(spans.schema["spans"].dataType)).alias("spans"))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of all spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
