"""The synthetic query log QL(query_id, gold, pred), one row per ``events`` row.

Every choice is an md5 bucket over ``event_id`` so the log is built the same way
by Spark and by the SQL oracle, on any partitioning. The shape and binding
tables below are fixed values of the test fixture; they are tiny (12 x 5
templates) and are broadcast into the per-event projection.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.hashing import bucket, sql_bucket

# ---- fixed values: query shapes of the fixture log (index = shape id) ----
SHAPES = [
    "select count(*) from {T}",
    "select {c1} from {T} where {n1} > {k}",
    "select distinct {c1} from {T}",
    "select {c1} , count(*) from {T} group by {c1}",
    "select {c1} from {T} order by {n1} desc limit 1",
    "select avg({n1}) , max({n1}) from {T} where {c1} = '{v}'",
    "select T1.{c1} from {T} as T1 join {U} as T2 on T1.{fk} = T2.{uk} where T2.{c2} = '{w}'",
    "select {c1} from {T} where {n1} > ( select avg({n1}) from {T} )",
    "select {c1} from {T} where {pk} not in ( select {vk} from {V} )",
    "select {c1} from {T} where {n1} > {k} intersect select {c1} from {T} where {n1} < {j}",
    "select {c1} , count(*) from {T} group by {c1} having count(*) > {h} order by count(*) desc limit {l}",
    "select {c1} from {T} where {n1} between {k} and {j} or {c1} like '%{v}%'",
]

# ---- fixed values: table bindings of the fixture log (index = binding id) ----
BINDING_KEYS = ["T", "c1", "n1", "pk", "fk", "U", "uk", "c2", "V", "vk", "v", "w"]
BINDINGS = [
    ["customer", "c_mktsegment", "c_acctbal", "c_custkey", "c_nationkey", "nation", "n_nationkey", "n_name",
     "orders", "o_custkey", "FURNITURE", "NATION_2"],
    ["orders", "o_orderpriority", "o_totalprice", "o_orderkey", "o_custkey", "customer", "c_custkey",
     "c_mktsegment", "lineitem", "l_orderkey", "3-MEDIUM", "FURNITURE"],
    ["supplier", "s_name", "s_acctbal", "s_suppkey", "s_nationkey", "nation", "n_nationkey", "n_name",
     "lineitem", "l_suppkey", "Supplier#000000001", "NATION_2"],
    ["lineitem", "l_returnflag", "l_extendedprice", "l_partkey", "l_partkey", "part", "p_partkey", "p_brand",
     "part", "p_partkey", "N", "Brand#13"],
    ["nation", "n_name", "n_nationkey", "n_nationkey", "n_regionkey", "region", "r_regionkey", "r_name",
     "customer", "c_nationkey", "NATION_3", "AFRICA"],
]


def bound_templates() -> list[tuple[int, int, str]]:
    """(shape, binding, text) with table/column placeholders filled; numbers stay as {k} {j} {h} {l}."""
    out = []
    for s, shape in enumerate(SHAPES):
        for b, row in enumerate(BINDINGS):
            text = shape
            for key, val in zip(BINDING_KEYS, row):
                text = text.replace("{" + key + "}", val)
            out.append((s, b, text))
    return out


def _values_sql() -> str:
    rows = ", ".join(f"({s}, {b}, '{t.replace(chr(39), chr(39) * 2)}')" for s, b, t in bound_templates())
    return f"(VALUES {rows}) AS tpl(shape, binding, text)"


def _pred(gold, p):
    """Prediction rules by bucket p (0-5 copy, 6 flip order/comparison, 7 drop distinct etc., 8 drop limit, 9 cut)."""
    r6 = F.replace(F.replace(gold, F.lit(" desc"), F.lit(" asc")), F.lit(" > "), F.lit(" < "))
    r7 = F.replace(F.replace(F.replace(gold, F.lit("distinct "), F.lit("")), F.lit("avg("), F.lit("min(")),
                   F.lit("count(*)"), F.lit("count(*) "))
    r8 = F.regexp_replace(gold, " limit [0-9]+$", "")
    r9 = F.expr("substring(gold, 1, length(gold) - 1)")
    return (F.when(p <= 5, gold).when(p == 6, r6).when(p == 7, r7).when(p == 8, r8).otherwise(r9))


def query_log(spark: SparkSession, events: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """QL(query_id, shape, gold, pred) from the events table (one row per event), then the columns ``keep`` of the event."""
    tpl = spark.createDataFrame(bound_templates(), "shape int, binding int, text string")
    e = events.select(F.col("event_id").alias("query_id"), *keep)
    k = F.lit(100) * bucket("k", "query_id", 50)
    j = k + F.lit(1000) * (F.lit(1) + bucket("j", "query_id", 9))
    h = F.lit(1) + bucket("h", "query_id", 9)
    lim = F.lit(1) + bucket("l", "query_id", 5)
    e = e.select("query_id", bucket("t", "query_id", 12).cast("int").alias("shape"),
                 bucket("b", "query_id", 5).cast("int").alias("binding"),
                 k.alias("k"), j.alias("j"), h.alias("h"), lim.alias("l"),
                 bucket("p", "query_id", 10).alias("p"), *keep)
    # 60-row constant table: broadcast, so the per-event rows never shuffle here.
    x = e.join(F.broadcast(tpl), ["shape", "binding"])
    gold = F.col("text")
    for name in ("k", "j", "h", "l"):
        gold = F.replace(gold, F.lit("{" + name + "}"), F.col(name).cast("string"))
    x = x.select("query_id", "shape", gold.alias("gold"), "p", *keep)
    return x.select("query_id", "shape", "gold", _pred(F.col("gold"), F.col("p")).alias("pred"), *keep)


def query_log_sql() -> str:
    """The same log as a SQL CTE body named ``ql`` (query_id, shape, gold, pred)."""
    k = f"(100 * {sql_bucket('k', 'event_id', 50)})"
    j = f"({k} + 1000 * (1 + {sql_bucket('j', 'event_id', 9)}))"
    h = f"(1 + {sql_bucket('h', 'event_id', 9)})"
    lim = f"(1 + {sql_bucket('l', 'event_id', 5)})"
    gold = ("replace(replace(replace(replace(tpl.text, '{k}', CAST(e.k AS VARCHAR)), '{j}', CAST(e.j AS VARCHAR)), "
            "'{h}', CAST(e.h AS VARCHAR)), '{l}', CAST(e.l AS VARCHAR))")
    return f"""ql_e AS (
  SELECT event_id AS query_id, {sql_bucket('t', 'event_id', 12)} AS shape, {sql_bucket('b', 'event_id', 5)} AS binding,
         {k} AS k, {j} AS j, {h} AS h, {lim} AS l, {sql_bucket('p', 'event_id', 10)} AS p
  FROM events),
ql_g AS (
  SELECT e.query_id, e.shape, {gold} AS gold, e.p
  FROM ql_e e JOIN {_values_sql()} ON e.shape = tpl.shape AND e.binding = tpl.binding),
ql AS (
  SELECT query_id, shape, gold,
    CASE WHEN p <= 5 THEN gold
         WHEN p = 6 THEN replace(replace(gold, ' desc', ' asc'), ' > ', ' < ')
         WHEN p = 7 THEN replace(replace(replace(gold, 'distinct ', ''), 'avg(', 'min('), 'count(*)', 'count(*) ')
         WHEN p = 8 THEN regexp_replace(gold, ' limit [0-9]+$', '')
         ELSE substr(gold, 1, length(gold) - 1) END AS pred
  FROM ql_g)"""


def with_ql(sql_body: str, *more_ctes: str) -> str:
    ctes = ",\n".join((query_log_sql(),) + more_ctes)
    return f"WITH {ctes}\n{sql_body}"


# ---- dialogue link: user turns of `conversations` take one log row each ----

def conversation_queries(conversations: DataFrame, events: DataFrame) -> DataFrame:
    """CONV x QL link: (conv_id, turn, query_id) for every user turn.

    query_id = bucket('u', conv_id || '-' || turn, number of events); the
    event count is a scalar subquery, not a driver round trip.
    """
    n = events.select(F.count("*")).scalar()
    u = conversations.filter(F.col("role") == "user").select("conv_id", "turn")
    key = F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    return u.select("conv_id", "turn", bucket("u", key, n).alias("query_id"))


def conversation_queries_sql() -> str:
    key = "(CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR))"
    return f"""cq AS (
  SELECT conv_id, turn, {sql_bucket('u', key, '(SELECT count(*) FROM events)')} AS query_id
  FROM conversations WHERE role = 'user')"""
