"""URL filters from association rules.

FP-growth mines sets of URL tokens that come with bad labels. Rules ``tokens -> bad`` that pass the
support and confidence bounds are stored as an inverted index (token, rule); a URL matches a rule
if it holds all of the rule's tokens. A short list of hand-written host and path rules goes before.
All work is done by DataFrame operations and MLlib.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.llm.common import keep

BAD = "label=bad"
SALTS = 32  # copies of the rule index: a token that a third of all URLs hold is dealt to that many tasks


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"),
)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    host = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_tokens(url: Column) -> Column:
    """Distinct tokens: host, its labels and their parts, path segments and query names without digits.

    Numbers are left out: they name one page.
    """
    host, path = host_of(url), path_of(url)
    labels = F.split(host, r"\.")
    names = F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit(r"[?&]([^=&#]+)="), F.lit(1))

    def tagged(tag: str, parts: Column) -> Column:
        return F.transform(F.filter(parts, lambda x: (x != "") & ~x.rlike("[0-9]")), lambda x: F.concat(F.lit(tag), x))

    return F.array_distinct(F.concat(
        F.filter(F.array(F.concat(F.lit("host="), host)), lambda x: x != "host="), tagged("label=", F.filter(labels, lambda x: x != "bad")),
        tagged("part=", F.filter(F.flatten(F.transform(labels, lambda x: F.split(x, "-"))), lambda x: x != "")),
        tagged("path=", F.split(path, "/")), tagged("query=", names),
    ))


def mine_rules(
    labelled: DataFrame, min_support: float = 0.001, min_rows: int = 5, min_confidence: float = 0.5, max_tokens: int = 3,
) -> DataFrame:
    """``rule, tokens, confidence`` from ``labelled`` (``url``, ``bad`` boolean).

    A rule has 1 to ``max_tokens`` tokens, holds together with the bad label in at least
    ``min_support`` of the rows and in ``min_rows`` rows, and at least ``min_confidence`` of the rows
    with its tokens are bad. Rows whose label is null are left out; without rows there are no rules.
    """
    known = labelled.where("bad is not null")
    items = known.select(F.concat(url_tokens(F.col("url")), F.when(F.col("bad"), F.array(F.lit(BAD))).otherwise(F.array().cast("array<string>"))).alias("items"))
    items = keep(items)
    n = items.count()
    if n == 0:
        return items.select(F.lit(0).cast("long").alias("rule"), F.col("items").alias("tokens"), F.lit(0.0).alias("confidence"))
    support = max(min_support, (min_rows - 0.5) / n)
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, support), minConfidence=min_confidence).fit(items)
    rules = model.associationRules.where(F.col("consequent") == F.array(F.lit(BAD))).where(F.size("antecedent") <= max_tokens)
    tokens = F.array_sort("antecedent")
    return keep(rules.select(F.xxhash64(tokens).alias("rule"), tokens.alias("tokens"), "confidence"))


def match_rules(tokens: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct ``key`` of ``tokens`` (``key, tokens``) that hold all tokens of some rule."""
    index = rules.select("rule", F.size("tokens").alias("need"), F.explode("tokens").alias("token"))
    index = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    sought = tokens.select("key", F.explode("tokens").alias("token"), F.pmod("key", F.lit(SALTS)).cast("int").alias("salt"))
    held = sought.join(index, ["token", "salt"]).groupBy("key", "rule", "need").agg(F.count(F.lit(1)).alias("held"))
    return held.where("held = need").select("key").distinct()


def url_verdicts(
    pages: DataFrame, labelled: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url", **mining,
) -> DataFrame:
    """One row per row of ``pages``: ``page_id, host, path, rule, verdict``.

    ``rule`` is the longest hand-written rule that fits, else null. ``verdict`` is that rule's, else
    block if a mined rule matches, else allow. Null URLs and URLs without ``://`` have no tokens and
    are allowed. The hand-written list is meant to be short (it becomes part of the plan).
    """
    urls = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    # URLs with equal tokens share their match; the key parts them over tasks
    sets = F.array_sort(url_tokens(F.col("url")))
    urls = urls.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.xxhash64(sets).alias("key"), sets.alias("tokens"))
    distinct = urls.groupBy("key").agg(F.first("tokens").alias("tokens"))
    blocked = keep(match_rules(distinct, mine_rules(labelled, **mining)))
    fit = F.lit(None).cast("string")
    given = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):  # the longest is asked first
        fits = (F.col("host").isin(rule.host) | F.col("host").endswith(f".{rule.host}")) & F.col("path").startswith(rule.path)
        fit = F.when(fits, F.lit(rule.text)).otherwise(fit)
        given = F.when(fits, F.lit(rule.verdict)).otherwise(given)
    joined = urls.join(blocked.withColumn("mined", F.lit(True)), "key", "left")
    mined = F.when(F.col("mined"), "block").otherwise("allow")
    return joined.select("page_id", "host", "path", fit.alias("rule"), F.coalesce(given, mined).alias("verdict"))
