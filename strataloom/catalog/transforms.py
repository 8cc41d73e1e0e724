"""Queries: encoders, scalers, row estimators, compression."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataloom.catalog.draws import SEED, STRATA_SQL, BALANCED_SQL
from strataloom.catalog.registry import FRAMES, FX_EVENTS, FX_FRAMES, FX_ORDERS, FX_VECTORS, query
from strataloom.catalog.views import fx_events, fx_frames, fx_orders, fx_vectors, subjects_of_orders
from strataloom.functions.estimators import ESTIMATORS
from strataloom.operators import compress as cmp
from strataloom.operators.draws import small_table
from strataloom.operators.encode import OneHotEncoder, TargetEncoder
from strataloom.operators.folds import strata_folds
from strataloom.operators.gram import grouped_gram
from strataloom.operators.scale import MinMaxScaler, StandardScaler
from strataloom.operators.transform import encoder_chain, fit_stages, normalizer_chain

# Rows of every stratum fold with their role.
_ROWS = f"""
select f.fold, f.role, f.n_draws, s.*, nullif(s.priority, '5-LOW') as urgency
from ({FX_ORDERS}) s join ({STRATA_SQL}) f on s.subject = f.subject
"""
_BALANCED_ROWS = f"""
select f.fold, f.role, f.n_draws, s.* from ({FX_ORDERS}) s join ({BALANCED_SQL}) f on s.subject = f.subject
"""


def fold_rows(spark, folder, balanced_by=None):
    subjects = subjects_of_orders(spark, folder)
    folds = strata_folds(subjects, "subject", "segment", balanced_by, seed=SEED)
    rows = fx_orders(spark, folder).withColumn(
        "urgency", F.when(F.col("priority") != "5-LOW", F.col("priority"))
    )
    return rows.join(folds, "subject")


def _fitted(rows, transformer, weight=None, target=None):
    fit = rows.filter("role = 'fit'")
    return transformer.fit(fit, ["fold"], weight, target).transform(rows)


def _one_hot_sql(column: str, values) -> str:
    """0/1 per value, and 0 where the fold's fit rows do not have the value."""
    flags = ", ".join(
        f"cast(s.fold is not null and r.v is not distinct from {v} as integer) as {column}_{i}" for i, v in enumerate(values, start=1)
    )
    return f"""
with r as (select fold, role, row_id, {column} as v, coalesce({column}, '-') as k from ({_ROWS})),
s as (select distinct fold, k from r where role = 'fit')
select r.fold, r.row_id, {flags} from r left join s on r.fold = s.fold and r.k = s.k"""


@query("one_hot", _one_hot_sql("urgency", ["'1-URGENT'", "'2-HIGH'", "'3-MEDIUM'", "'4-NOT SPECIFIED'", "null"]))
def one_hot(spark, folder):
    out = _fitted(fold_rows(spark, folder), OneHotEncoder(["urgency"]))
    return out.select("fold", "row_id", *[f"urgency_{i}" for i in range(1, 6)])


@query("one_hot_unseen", _one_hot_sql(
    "segment", ["'AUTOMOBILE'", "'BUILDING'", "'FURNITURE'", "'HOUSEHOLD'", "'MACHINERY'"]))
def one_hot_unseen(spark, folder):
    out = _fitted(fold_rows(spark, folder), OneHotEncoder(["segment"]))
    return out.select("fold", "row_id", *[f"segment_{i}" for i in range(1, 6)])


_EVENTS_ONE_HOT = f"""
select row_id, cast(event_type = v.v as integer) as hit, v.v as value
from ({FX_EVENTS}), (select distinct event_type as v from ({FX_EVENTS})) v
"""


@query("one_hot_drop_invariant", f"select * from ({_EVENTS_ONE_HOT})")
def one_hot_drop_invariant(spark, folder):
    events = fx_events(spark, folder).withColumn("constant", F.lit("x"))
    names = [r[0] for r in events.select("event_type").distinct().orderBy("event_type").collect()]
    model = OneHotEncoder(["event_type", "constant"], drop_invariant=True).fit(events)
    values = F.explode(F.array(*[
        F.struct(F.col(c).alias("hit"), F.lit(v).alias("value")) for c, v in zip(model.added, names, strict=True)
    ]))
    return model.transform(events).select("row_id", values.alias("v")).select("row_id", "v.hit", "v.value")


def _target_sql(rows: str, column: str, weight: str) -> str:
    return f"""
with r as ({rows}), fit as (select * from r where role = 'fit'),
p as (select fold, sum({weight} * target)::double / sum({weight}) as prior from fit group by fold),
c as (select fold, {column} as v, sum({weight}) as n, sum({weight} * target)::double / sum({weight}) as m
      from fit where {column} is not null group by fold, {column}),
s as (select c.fold, c.v, p.prior * (1 - 1 / (1 + exp(-(c.n - 20)::double / 10)))
                          + c.m / (1 + exp(-(c.n - 20)::double / 10)) as code
      from c join p on c.fold = p.fold)
select r.fold, r.row_id, round(coalesce(s.code, p.prior), 6) as {column}
from r join p on r.fold = p.fold left join s on r.fold = s.fold and r.{column} = s.v"""


@query("target_encoding", _target_sql(_ROWS, "urgency", "1"))
def target_encoding(spark, folder):
    out = _fitted(fold_rows(spark, folder), TargetEncoder(["urgency"]), target="target")
    return out.select("fold", "row_id", F.round("urgency", 6).alias("urgency"))


@query("target_encoding_unseen", _target_sql(_BALANCED_ROWS, "segment", "n_draws"))
def target_encoding_unseen(spark, folder):
    out = _fitted(fold_rows(spark, folder, "target"), TargetEncoder(["segment"]), "n_draws", "target")
    return out.select("fold", "row_id", F.round("segment", 6).alias("segment"))


@query("min_max_scaling", f"""
with r as ({_ROWS}), p as (select fold, min(amount) as lo, max(amount) as hi from r where role = 'fit' group by fold)
select r.fold, r.row_id, round((amount - lo) / (hi - lo) * 2 - 1, 6) + 0.0 as amount from r join p on r.fold = p.fold""")
def min_max_scaling(spark, folder):
    out = _fitted(fold_rows(spark, folder), MinMaxScaler(["amount"], feature_range=(-1.0, 1.0)))
    return out.select("fold", "row_id", (F.round("amount", 6) + 0.0).alias("amount"))


@query("min_max_scaling_constant", f"select row_id, 0.0::double as level, 0.0::double as target_value from ({FX_EVENTS})")
def min_max_scaling_constant(spark, folder):
    rows = fx_events(spark, folder).select("row_id", F.lit(4.0).alias("level"), F.lit(1).alias("target_value"))
    return MinMaxScaler(["level", "target_value"]).fit(rows).transform(rows)


@query("mean_variance_scaling", f"""
with r as ({_BALANCED_ROWS}),
p as (select fold, avg(amount) as m, stddev_pop(amount) as s
      from r, lateral (select unnest(range(n_draws))) c where role = 'fit' group by fold)
select r.fold, r.row_id, r.role, round((amount - m) / s, 6) + 0.0 as amount from r join p on r.fold = p.fold""")
def mean_variance_scaling(spark, folder):
    out = _fitted(fold_rows(spark, folder, "target"), StandardScaler(["amount"]), "n_draws")
    return out.select("fold", "row_id", "role", (F.round("amount", 6) + 0.0).alias("amount"))


@query("transformer_chain", f"""
with t as ({_target_sql(_ROWS, 'priority', '1').replace('round(coalesce(s.code, p.prior), 6)', 'r.role, r.amount, coalesce(s.code, p.prior)')}),
p as (select fold, min(priority) as lo, max(priority) as hi, avg(amount) as m, stddev_pop(amount) as s
      from t where role = 'fit' group by fold)
select t.fold, t.row_id, round((priority - lo) / (hi - lo), 5) + 0.0 as priority,
       round((amount - m) / s, 5) + 0.0 as amount
from t join p on t.fold = p.fold""")
def transformer_chain(spark, folder):
    rows = fold_rows(spark, folder)
    chain = fit_stages(
        rows.filter("role = 'fit'"), ["fold"], "n_draws",
        encoder_chain(["target_encoder"], [{}], [["priority"]], ["target"]),
        normalizer_chain(["min_max_normalization", "mean_var_normalization"], [{}, {}], [["priority"], ["amount"]]),
        None,
    )
    return chain.transform(rows).select(
        "fold", "row_id", (F.round("priority", 5) + 0.0).alias("priority"), (F.round("amount", 5) + 0.0).alias("amount")
    )


# Frames with gaps: a month without lines counts as missing.
_GAPS = "[" + ", ".join(f"nullif({c}, 0)" for c in FRAMES) + "]"
_LIST_SQL = {
    "mean": "list_avg(x)", "median": "list_median(x)", "std": "list_aggregate(x, 'stddev_pop')",
    "sum": "coalesce(list_sum(x), 0.0::double)",
}


def _row_estimator(name: str):
    @query(f"row_{name}", f"select row_id, round({_LIST_SQL[name]}, 6) as value from (select row_id, {_GAPS} as x from ({FX_FRAMES}))")
    def run(spark, folder):
        values = F.array(*[F.nullif(F.col(c), F.lit(0.0)) for c in FRAMES])
        return fx_frames(spark, folder).select("row_id", F.round(ESTIMATORS[name](values), 6).alias("value"))

    return run


_HALVES = [list(range(6)), list(range(6, 12))]
_ALTERNATE = [list(range(0, 12, 2)), list(range(1, 12, 2))]


def _compressed(name: str):
    def pick(positions):
        return "[" + ", ".join(FRAMES[i] for i in positions) + "]"

    columns = ", ".join(
        f"round({_LIST_SQL[name].replace('x', f'g{i}', 1) if name != 'sum' else f'list_sum(g{i})'}, 6)"
        f" as compressed_1_frame_{i}" for i in (1, 2)
    )

    @query(f"compressed_{name}", f"""
select row_id, {columns} from (
  select row_id, case when segment in ('BUILDING', 'MACHINERY') then {pick(_HALVES[0])} else {pick(_ALTERNATE[0])} end as g1,
         case when segment in ('BUILDING', 'MACHINERY') then {pick(_HALVES[1])} else {pick(_ALTERNATE[1])} end as g2
  from ({FX_FRAMES}))""")
    def run(spark, folder):
        frames = fx_frames(spark, folder)
        segments = [r[0] for r in frames.select("segment").distinct().collect()]
        groups = small_table(
            spark, [(s,) for s in segments], [("segment", "string")]
        ).withColumn("groups", F.when(
            F.col("segment").isin("BUILDING", "MACHINERY"), F.lit(_HALVES)).otherwise(F.lit(_ALTERNATE)))
        names = ["compressed_1_frame_1", "compressed_1_frame_2"]
        out = cmp.compress(frames, groups, ["segment"], FRAMES, names, ESTIMATORS[name])
        return out.select("row_id", *[F.round(n, 6).alias(n) for n in names])

    return run


for _name in ESTIMATORS:
    _row_estimator(_name)
    _compressed(_name)


@query("column_gram", f"""
with u as (unpivot (select segment, row_id, {", ".join(FRAMES)} from ({FX_FRAMES})) on {", ".join(FRAMES)}
           into name frame value v),
n as (select *, cast(replace(frame, 'signal_frame', '') as integer) - 1 as i from u)
select a.segment, a.i, b.i as j, sum(a.v * b.v) as v from n a join n b on a.row_id = b.row_id and a.i <= b.i
group by a.segment, a.i, b.i""")
def column_gram(spark, folder):
    return grouped_gram(fx_frames(spark, folder), ["segment"], FRAMES)


@query("vector_gram_centered", f"""
with u as (select site, row_id, cast(unnest(range(64)) as integer) as i, unnest(embedding)::double as v from ({FX_VECTORS})),
m as (select row_id, avg(v) as m from u group by row_id),
c as (select u.site, u.row_id, u.i, u.v - m.m as v from u join m on u.row_id = m.row_id)
select a.site, a.i, b.i as j, round(sum(a.v * b.v), 6) + 0.0 as v from c a join c b on a.row_id = b.row_id and a.i <= b.i
group by a.site, a.i, b.i""")
def vector_gram_centered(spark, folder):
    names = [f"d{i}" for i in range(64)]
    vectors = fx_vectors(spark, folder).select(
        "site", *[F.get("embedding", F.lit(i)).cast("double").alias(n) for i, n in enumerate(names)]
    )
    cells = grouped_gram(vectors, ["site"], names, center_rows=True)
    return cells.select("site", "i", "j", (F.round("v", 6) + 0.0).alias("v"))


_CENTRED_CELLS = f"""
u as (unpivot (select segment, row_id, {", ".join(FRAMES)} from ({FX_FRAMES})) on {", ".join(FRAMES)} into name frame value v),
m as (select row_id, avg(v) as m from u group by row_id),
n as (select u.segment, u.row_id, cast(replace(frame, 'signal_frame', '') as integer) - 1 as i, u.v - m.m as v from u join m on u.row_id = m.row_id),
o as (select a.segment, a.i, b.i as j, sum(a.v * b.v) as v from n a join n b on a.row_id = b.row_id group by a.segment, a.i, b.i)"""


def _clusters_sql(cells: str, k: int, rounds: int = 12) -> str:
    """CTEs up to ``clusters`` (fold, i, part): k-means of the columns on the cells ``g`` (fold, i, j, v), farthest start."""
    parts = [f"""
g as ({cells}),
e as (select a.fold, a.i, a.j, b.v + c.v - 2 * a.v as d from g a join g b on b.fold = a.fold and b.i = a.i and b.j = a.i
      join g c on c.fold = a.fold and c.i = a.j and c.j = a.j),
s0 as (select distinct fold, 0 as c, 0 as i from g)"""]
    for c in range(1, k):
        parts.append(f"""
s{c} as (select * from s{c - 1} union all select fold, {c}, i from (
  select e.fold, e.i, row_number() over (partition by e.fold order by min(d) desc, e.i) as nth
  from e join s{c - 1} s on s.fold = e.fold and s.i = e.j where (e.fold, e.i) not in (select (fold, i) from s{c - 1}) group by e.fold, e.i) where nth = 1)""")
    parts.append(f"""
l0 as (select fold, i, c from (select e.fold, e.i, s.c, row_number() over (partition by e.fold, e.i order by case when e.i = s.i then -1 else d end, s.c) as nth
       from e join s{k - 1} s on s.fold = e.fold and s.i = e.j) where nth = 1)""")
    for r in range(rounds):
        parts.append(f"""
m{r} as (select g.fold, g.i, l.c, avg(g.v) as v from g join l{r} l on l.fold = g.fold and l.i = g.j group by g.fold, g.i, l.c),
c{r} as (select m.fold, m.c, avg(m.v) as v from m{r} m join l{r} l on l.fold = m.fold and l.i = m.i and l.c = m.c group by m.fold, m.c),
l{r + 1} as (select fold, i, c from (select m.fold, m.i, m.c, row_number() over (partition by m.fold, m.i order by g.v - 2 * m.v + c.v, m.c) as nth
             from m{r} m join c{r} c on c.fold = m.fold and c.c = m.c join g on g.fold = m.fold and g.i = m.i and g.j = m.i) where nth = 1)""")
    parts.append(f"""
clusters as (select fold, i, dense_rank() over (partition by fold order by first) - 1 as part
             from (select *, min(i) over (partition by fold, c) as first from l{rounds}))""")
    return ",".join(parts)


@query("frame_clusters", f"""
with {_CENTRED_CELLS}, {_clusters_sql("select segment as fold, i, j, v from o", 4)}
select fold as segment, cast(i as integer) as frame, cast(part as integer) as part from clusters""")
def frame_clusters(spark, folder):
    """Clusters of the monthly frames, fitted per segment."""
    groups = cmp.fit_groups(fx_frames(spark, folder), ["segment"], FRAMES, 4)
    return groups.select("segment", F.posexplode("groups").alias("part", "frames")).select("segment", F.explode("frames").alias("frame"), "part")


@query("frame_segments", f"""
with u as (unpivot (select segment, row_id, {", ".join(FRAMES)} from ({FX_FRAMES})) on {", ".join(FRAMES)}
           into name frame value v),
m as (select row_id, avg(v) as m from u group by row_id),
n as (select u.segment, u.row_id, cast(replace(frame, 'signal_frame', '') as integer) - 1 as i, u.v - m.m as v
      from u join m on u.row_id = m.row_id),
g as (select a.segment, a.i, b.i as j, sum(a.v * b.v) as v from n a join n b on a.row_id = b.row_id
      group by a.segment, a.i, b.i),
cuts as (select x.c as a, y.c as b, z.c as c from range(1, 12) x(c), range(1, 12) y(c), range(1, 12) z(c)
         where x.c < y.c and y.c < z.c),
part as (select g.segment, a, b, c, (i >= a)::int + (i >= b)::int + (i >= c)::int as part,
                sum(case when i = j then v else 0 end) - sum(v) / count(distinct i) as cost
         from g, cuts where (i >= a)::int + (i >= b)::int + (i >= c)::int = (j >= a)::int + (j >= b)::int + (j >= c)::int
         group by g.segment, a, b, c, part),
best as (select segment, a, b, c, row_number() over (partition by segment order by sum(cost)) as place
         from part group by segment, a, b, c)
select segment, cast(i as integer) as frame, cast((i >= a)::int + (i >= b)::int + (i >= c)::int as integer) as part
from best, range(12) f(i) where place = 1""")
def frame_segments(spark, folder):
    """Best contiguous split of the monthly frames, per segment."""
    groups = cmp.fit_groups(fx_frames(spark, folder), ["segment"], FRAMES, 4, contiguous=True)
    return groups.select("segment", F.posexplode("groups").alias("part", "frames")).select(
        "segment", F.explode("frames").alias("frame"), "part"
    )


_OTHER_SEGMENTS = "select x.segment as fold, o.i, o.j, sum(o.v) as v from (select distinct segment from o) x join o on x.segment <> o.segment group by x.segment, o.i, o.j"


@query("compressed_signals", f"""
with {_CENTRED_CELLS}, {_clusters_sql(_OTHER_SEGMENTS, 4)},
w as (select u.segment, u.row_id, cast(replace(frame, 'signal_frame', '') as integer) - 1 as i, v from u),
v as (select c.fold, w.segment, w.row_id, c.part, median(w.v) as v from w join clusters c on w.i = c.i group by all)
select fold, case when fold = segment then 'val' else 'fit' end as role, row_id,
       {", ".join(f"round(max(v) filter (where part = {n})::double, 6) as compressed_1_frame_{n + 1}" for n in range(4))}
from v group by fold, segment, row_id""")
def compressed_signals(spark, folder):
    """Fit on the rows of other segments, applied to all rows of every fold."""
    folds = strata_folds(subjects_of_orders(spark, folder), "subject", "segment")
    rows = fx_frames(spark, folder).join(folds, "subject")
    model = cmp.SignalCompressor([4], [FRAMES], ["median"]).fit(rows.filter("role = 'fit'"), ["fold"])
    return model.transform(rows).select("fold", "role", "row_id", *[F.round(c, 6).alias(c) for c in model.added])


_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("encoded_and_compressed", f"""
with u as (unpivot (select segment, row_id, {", ".join(FRAMES)} from ({FX_FRAMES})) on {", ".join(FRAMES)}
           into name frame value v),
m as (select row_id, avg(v) as m from u group by row_id),
n as (select u.segment, u.row_id, cast(replace(frame, 'signal_frame', '') as integer) - 1 as i, u.v - m.m as v
      from u join m on u.row_id = m.row_id),
g as (select a.segment, a.i, b.i as j, sum(a.v * b.v) as v from n a join n b on a.row_id = b.row_id
      group by a.segment, a.i, b.i),
part as (select g.segment, a, i >= a as part, sum(case when i = j then v else 0 end) - sum(v) / count(distinct i) as cost
         from g, range(1, 12) c(a) where (i >= a) = (j >= a) group by g.segment, a, part),
best as (select segment, a, row_number() over (partition by segment order by sum(cost)) as place from part group by segment, a)
select o.row_id, {", ".join(f"cast(o.priority = '{v}' as integer) as priority_{i}" for i, v in enumerate(_PRIORITIES, start=1))},
       round(list_sum([{", ".join(FRAMES)}][1:a]), 6) as compressed_1_frame_1,
       round(list_sum([{", ".join(FRAMES)}][a + 1:]), 6) as compressed_1_frame_2
from ({FX_FRAMES}) f join ({FX_ORDERS}) o on f.row_id = o.row_id join best on f.segment = best.segment where place = 1""")
def encoded_and_compressed(spark, folder):
    """The columns that a chain of encoder and compressor names, fitted per segment."""
    rows = fx_frames(spark, folder).join(fx_orders(spark, folder).select("row_id", "priority"), "row_id")
    compressor = cmp.SignalCompressor([2], [FRAMES], ["sum"], contiguous=True)
    chain = fit_stages(rows, ["segment"], None, encoder_chain(["one_hot"], [{}], [["priority"]]), None, compressor)
    names = chain.features(["priority", *FRAMES])
    return chain.transform(rows).select("row_id", *[F.round(n, 6).alias(n) if n in chain.steps[-1].added else n for n in names])
