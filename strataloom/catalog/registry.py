"""Query registry and the SQL pieces the queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, folder)`` under ``name``, with SQL that gives the same rows."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def h(*parts: str) -> str:
    """SQL of the 60-bit hash of SQL expressions."""
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 15))::BIGINT"


FX_ORDERS = """
select o_orderkey as row_id, o_custkey as subject, c_mktsegment as segment,
       cast(case when c_acctbal >= 4500 then 1 else 0 end as integer) as target,
       o_orderpriority as priority, o_orderstatus as status, o_totalprice as amount
from orders join customer on o_custkey = c_custkey
"""

FRAMES = [f"signal_frame{m}" for m in range(1, 13)]

FX_FRAMES = f"""
select o.row_id, o.subject, o.segment, o.target,
{", ".join(f"sum(case when month(l_shipdate) = {m} then l_quantity else 0 end) as signal_frame{m}" for m in range(1, 13))}
from lineitem join ({FX_ORDERS}) o on l_orderkey = o.row_id
group by o.row_id, o.subject, o.segment, o.target
"""

FX_VECTORS = """
select vec_id as row_id, vec_id % 50 as subject, (vec_id % 50) % 5 as site,
       cast((vec_id % 50) % 2 as integer) as target, embedding from embeddings
"""

FX_DOCS = """
select d.doc_id as row_id, d.source as subject, d.lang as lang, l.quality as target, d.n_chars as n_chars
from documents d left join labels l on d.doc_id = l.doc_id
"""

FX_EVENTS = """
select event_id as row_id, user_id as subject, event_type, value, cast(user_id % 2 as integer) as target
from events
"""

# Subject roll-up of fx_orders, as the fold queries use it.
SUBJECTS = f"""
select subject, max(segment) as segment, max(target) as target from ({FX_ORDERS}) group by subject
"""


def with_views(sql: str, **views: str) -> str:
    """Prefix ``sql`` with named subqueries."""
    return "with " + ", ".join(f"{name} as ({text})" for name, text in views.items()) + " " + sql
