"""The queries of this subpackage, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable
from secrets import token_hex

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm import ann, divergence, exact_dedup, hard_negatives, language_id, line_dedup, mixing, pii, secrets, sentencepiece_bpe, simhash, url_rules, warc
from strataloom.llm.common import table

PIECES = "piece_bpe_32k.model"
PSEUDONYM_KEY = "spark.strataloom.pseudonymKey"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


@query("op1_nearest_vectors")
def nearest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20)


@query("op2_sentencepiece")
def sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return sentencepiece_bpe.tokenise(table(spark, folder, "documents"), public_tokenizers.path(PIECES))


# Lines of the documents, and the first occurrence of each; a line of 20 characters or more also goes
# if it is one edit from an earlier one: a common deletion at one position, or one the other's deletion.
_LINE_DEDUP = r"""
with lines as (
  select doc_id, pos, line, trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g')) as l
  from (select doc_id, unnest(string_split(text, chr(10))) as line,
               unnest(range(len(string_split(text, chr(10))))) as pos
        from documents where text <> '')
), firsts as (
  select l, min({'d': doc_id, 'a': pos}) as f from lines where l <> '' group by l
), cuts as (
  select l, f, o, left(l, o) || substring(l, o + 2) as z
  from (select l, f, unnest(range(length(l))) as o from firsts where length(l) >= 20)
), gone as (
  select l from (select l, f, min(f) over (partition by o, z) as low from cuts) where low < f
  union select c.l from cuts c join firsts x on x.l = c.z where length(x.l) >= 20 and x.f < c.f
  union select x.l from cuts c join firsts x on x.l = c.z where length(x.l) >= 20 and c.f < x.f
), stays as (
  select doc_id, pos, line from lines left join firsts using (l) left join gone g using (l)
  where l = '' or (g.l is null and f = {'d': doc_id, 'a': pos})
), texts as (
  select doc_id, string_agg(line, chr(10) order by pos) as text, count(*) as n_kept from stays group by doc_id
)
select d.doc_id, cast(case when d.text <> '' then len(string_split(d.text, chr(10))) else 0 end as bigint) as n_lines,
       cast(coalesce(t.n_kept, 0) as bigint) as n_kept, sha256(coalesce(t.text, '')) as text_sha256
from documents d left join texts t using (doc_id)
"""


@query("op3_line_dedup", _LINE_DEDUP)
def lines_deduplicated(spark: SparkSession, folder: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, folder, "documents"))
    return found.select("doc_id", "n_lines", "n_kept", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


@query("op4_language_id")
def languages(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = language_id.identify(docs)
    return found.select("doc_id", language_id.in_fold(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def labelled_urls(spark: SparkSession, folder: str) -> DataFrame:
    """``url, bad``: a page's last number names the document that it shows; toxic or poor is bad."""
    pages, labels = table(spark, folder, "pages"), table(spark, folder, "labels")
    shown = F.regexp_extract(url_rules.path_of(F.col("url")), r"/([0-9]+)[^/]*/?$", 1)
    return pages.select("url", shown.try_cast("bigint").alias("doc_id")).join(labels, "doc_id").select("url", ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("bad"))


def _tagged(tag: str, parts: str) -> str:
    return f"list_transform(list_filter({parts}, lambda x: x <> '' and not regexp_matches(x, '[0-9]')), lambda x: '{tag}=' || x)"


# The same rules by counting every set of up to three tokens.
_URL_FILTER = rf"""
with cut as (
  select page_id, url, coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') as path from pages
), tokens as (
  select *, list_sort(list_distinct(list_concat(list_concat(
    case when host = '' then [] else ['host=' || host] end,
    {_tagged('label', "list_filter(string_split(host, '.'), lambda x: x <> 'bad')")}), list_concat(list_concat(
    {_tagged('part', "flatten(list_transform(string_split(host, '.'), lambda x: string_split(x, '-')))")},
    {_tagged('path', "string_split(path, '/')")}),
    {_tagged('query', "regexp_extract_all(coalesce(url, ''), '[?&]([^=&#]+)=', 1)")})))) as t from cut
), labelled as (
  select row_number() over () as r, t, l.toxic = 1 or l.quality = 0 as bad
  from tokens p join labels l on l.doc_id = try_cast(regexp_extract(path, '/([0-9]+)[^/]*/?$', 1) as bigint)
), held as (
  select r, bad, unnest(t) as a from labelled where bad is not null
), sets as (
  select r, bad, [a] as s from held
  union all select x.r, x.bad, [x.a, y.a] from held x join held y on x.r = y.r and x.a < y.a
  union all select x.r, x.bad, [x.a, y.a, z.a] from held x join held y on x.r = y.r and x.a < y.a
    join held z on x.r = z.r and y.a < z.a
), mined as (
  select s from sets group by s
  having count(*) filter (where bad) >= greatest(5, (select ceil(0.001::double * count(*)) from labelled where bad is not null))
     and count(*) filter (where bad)::double / count(*) >= 0.5::double
), hit as (
  select distinct page_id from tokens, mined where list_has_all(t, s)
), ruled as (
  select *, case
    when (host = 'example.org' or host like '%.example.org') and starts_with(path, '/en/1') then 'example.org/en/1'
    when (host = 'example.org' or host like '%.example.org') and starts_with(path, '/es/') then 'example.org/es/'
    when (host = 'com' or host like '%.com') and starts_with(path, '/fr/') then 'com/fr/'
    when (host = 'com' or host like '%.com') and starts_with(path, '/de/') then 'com/de/'
    when (host = 'org' or host like '%.org') and starts_with(path, '/') then 'org/' end as rule from tokens
)
select page_id, host, path, rule, case when rule in ('org/', 'com/fr/') then 'allow' when rule is not null then 'block'
       when page_id in (select page_id from hit) then 'block' else 'allow' end as verdict
from ruled
"""


@query("op5_url_filter", _URL_FILTER)
def url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_rules.url_verdicts(table(spark, folder, "pages"), labelled_urls(spark, folder))


@query("op6_simhash")
def near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, folder, "documents"), words=3, bits=3).select("doc_id", "fingerprint", "component_id")


@query("op7_pseudonyms")
def pseudonyms(spark: SparkSession, folder: str) -> DataFrame:
    # without a key of one's own the pseudonyms of two runs differ
    key = spark.conf.get(PSEUDONYM_KEY, None) or token_hex(32)
    return pii.pseudonymise(table(spark, folder, "documents"), key)


_EXACT = r"""
with rows as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents)
select doc_id, min(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
       row_number() over (partition by t order by doc_id nulls last) = 1 as kept, sha256(t) as text_sha256
from rows
"""


@query("op8_exact_dedup", _EXACT)
def exact_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, folder, "documents"))


_WARC = """
with rows as (
  select page_id, octet_length(encode(coalesce(html, ''))) as n, sha256(coalesce(html, '')) as digest from pages
), ranked as (
  select *, row_number() over (partition by digest order by page_id nulls last) as r,
         min(page_id) over (partition by digest) as head from rows
)
select page_id, cast(n as bigint) as payload_bytes, digest as payload_digest,
       case when n >= 100 and r > 1 then 'revisit' else 'response' end as record_type,
       case when n >= 100 and r > 1 then head end as refers_to
from ranked
"""


@query("op9_warc", _WARC)
def warc_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(table(spark, folder, "pages")).drop("url")


@query("op10_mixing")
def source_mix(spark: SparkSession, folder: str) -> DataFrame:
    plan = mixing.mix(table(spark, folder, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


# All products of the anchors with all rows.
_NEGATIVES = """
with rows as (
  select distinct vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
  from embeddings where label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scores as (
  select a.vec_id as anchor_id, a.label = r.label as same, r.vec_id,
         cast(list_sum(list_transform(range(1, len(r.v) + 1), lambda i: a.v[i] * r.v[i])) as bigint) as score
  from rows a join rows r on a.vec_id <> r.vec_id where a.vec_id % 100 = 0
), positives as (
  select * from (select *, row_number() over (partition by anchor_id order by score desc, vec_id) as n from scores where same) where n <= 5
), found as (
  select p.anchor_id, p.vec_id as positive_id, n.vec_id as negative_id, p.score as positive_score, n.score as negative_score,
         row_number() over (partition by p.anchor_id, p.vec_id order by n.score desc, n.vec_id) as rank
  from positives p join scores n on p.anchor_id = n.anchor_id and not n.same
  where 30 * p.score <= 100 * n.score and 100 * n.score <= 90 * p.score
)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score from found where rank <= 10
"""


@query("op11_hard_negatives", _NEGATIVES)
def hard_negatives_of_anchors(spark: SparkSession, folder: str) -> DataFrame:
    rows = hard_negatives.whole_vectors(table(spark, folder, "embeddings"))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


# Matches of a kind in order; where one stands follows from the texts between them.
_ASSIGN = """((?i:password|passwd|secret|token|api_?key))["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_SECRET_KINDS = (
    ("assign", _ASSIGN, 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24),
    ("pem", "-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", 0, 1), ("forge", "gh[opsu]_[A-Za-z0-9]{36,}", 0, 1), ("chat", "xox[abprs]-[0-9A-Za-z-]{10,}", 0, 1),
)
_SECRETS = "with " + ", ".join(
    f"""m{n} as (
  select r, doc_id, {n} as no, '{kind}' as kind, i, whole, part, text, sum(length(whole)) over (partition by r order by i) as covered,
         split_text, sum(length(split_text)) over (partition by r order by i) as before
  from (select r, doc_id, text, unnest(regexp_extract_all(text, '{pattern}', 0)) as whole, unnest(regexp_extract_all(text, '{pattern}', {group})) as part,
               unnest(regexp_split_to_array(text, '{pattern}')[:-2]) as split_text, unnest(range(len(regexp_extract_all(text, '{pattern}', 0)))) as i
        from (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents)) x
), s{n} as (
  select r, doc_id, no, kind, covered + before - length(whole) as start, covered + before as stop from m{n} where length(part) >= {least}
)"""
    for n, (kind, pattern, group, least) in enumerate(_SECRET_KINDS)
) + """, spans as (""" + " union all ".join(f"select * from s{n}" for n in range(len(_SECRET_KINDS))) + """
), joined as (
  select r, count(*) filter (where no = 0) as n_assign, count(*) filter (where no = 1) as n_access, count(*) filter (where no = 2) as n_hex,
         string_agg(kind || ':' || start || ':' || stop, ',' order by start, no) filter (where no < 3) as base,
         string_agg(kind || ':' || start || ':' || stop, ',' order by start, no) as spans from spans group by r
)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
       sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from (select row_number() over () as r, doc_id from documents) d left join joined j on d.r = j.r
"""


@query("op12_secrets", _SECRETS)
def secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.secret_spans(table(spark, folder, "documents"))
    base = F.filter("spans", lambda s: s["no"] < len(secrets.BASE))

    def n(kind: int):
        return F.size(F.filter("spans", lambda s: s["no"] == kind)).cast("long")

    return found.select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
        F.sha2(secrets.span_text(base), 256).alias("base_sha256"), secrets.span_text(F.col("spans")).alias("spans"),
    )


# Every term of a language in every of its sources, pairs of sources side by side.
_DIVERGENCE = r"""
with texts as (
  select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents
), occurrences as (
  select r, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')),
                                    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term from texts
), kept as (
  select lang, term, count(*) as n from occurrences group by lang, term having count(distinct r) >= 3
), langs as (
  select lang, count(*) as v, sum(n) as total from kept group by lang
), groups as (
  select distinct lang, source from texts
), counts as (
  select lang, source, term, count(*) as n from occurrences group by lang, source, term
), cells as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) as n, k.n as lang_n, l.total as lang_total, l.v,
         sum(coalesce(c.n, 0)) over (partition by g.lang, g.source) as total
  from groups g join kept k on g.lang = k.lang join langs l on g.lang = l.lang
  left join counts c on c.lang = g.lang and c.source = g.source and c.term = k.term
), shares as (
  select lang, source, term, n, 1 + (1000000000::hugeint * (n + 1)) // (total + v)::hugeint as p,
         1 + (1000000000::hugeint * (lang_n + 1)) // (lang_total + v)::hugeint as q from cells
), apart as (
  select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) as value
  from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by a.lang, a.source, b.source
), pairs as (
  select x.lang, x.source, y.source as item, coalesce(z.value, 0) as value
  from groups x join groups y on x.lang = y.lang and x.source <> y.source
  left join apart z on z.lang = x.lang and z.source = x.source and z.item = y.source
), ranked as (
  select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, item) as rank from pairs
  union all
  select * from (select lang, source, 'term' as part, term as item, ((p - q) * (p - q)) // q as value,
                        row_number() over (partition by lang, source order by ((p - q) * (p - q)) // q desc, term) as rank
                 from shares where n > 0 and p > q) where rank <= 200
)
select lang, source, part, item, cast(value as bigint) as value, cast(rank as integer) as rank from ranked
"""


@query("op13_divergence", _DIVERGENCE)
def divergence_of_sources(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.source_divergence(table(spark, folder, "documents"))
