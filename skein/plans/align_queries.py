"""Aligned literals (T13), pointers (D30, D31, D41), matching results (E21), mixed batches (D22), streamed chains (ST2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions.hashing import sql_bucket
from skein.operators import align as al
from skein.operators import generate as gen
from skein.operators import score as sc
from skein.operators import tokens as tk
from skein.plans.dialog_queries import tw
from skein.plans.generate_queries import KEYS, gw
from skein.plans.querylog import conversation_queries, query_log, with_ql
from skein.plans.registry import register
from skein.session import Tables, cut_lineage
from skein.sources import files as io
from skein.sources.catalog import star_catalog
from skein.streaming import turns as st

# ------------------------------------------------------------------ T13: a log with literals of several words


def _value_tokens():
    """Tokens with the quotes apart, so that a literal of several words is several tokens."""
    return F.flatten(F.transform("toks", lambda t: F.when(t.startswith('"'), F.regexp_extract_all(t, F.lit(r'"|[^\s"]+'), 0)).otherwise(F.array(t))))


def _slot_tokens():
    return F.flatten(F.transform("toks", lambda t, i: F.when(t.startswith('"'), F.array(F.lit('"'), F.lit("value"), F.lit('"')))
                                 .when(tk.is_literal(t), F.array(F.when(F.get("toks", i - 1) == "limit", F.lit("limit_value")).otherwise(F.lit("value")))).otherwise(F.array(t))))


@register("t13_align_values", with_ql(r"""SELECT query_id, CAST(len(vals) AS INTEGER) AS n_slots, array_to_string(vals, ' | ') AS vals FROM (
  SELECT query_id, list(v ORDER BY i) AS vals, bool_and(v IS NOT NULL) AS ok FROM (
    SELECT query_id, i, arg_min(array_to_string(yes[j:j + len], ' '), len * 1000 + j) AS v FROM (
      SELECT query_id, i, j, yes, list_min(list_filter(range(j, len(yes) + 1), lambda k: (k = len(yes) AND i = len(no)) OR (k < len(yes) AND i < len(no) AND lower(yes[k + 1]) = lower(no[i + 1])))) - j AS len
      FROM (SELECT *, unnest(range(1, len(yes) + 1)) AS j FROM (SELECT *, unnest(list_filter(range(1, len(no) + 1), lambda i: no[i] IN ('value', 'limit_value'))) AS i FROM pair))
      WHERE (i = 1 AND j = 1) OR (i > 1 AND j > 1 AND lower(yes[j - 1]) = lower(no[i - 1])))
    WHERE len IS NOT NULL GROUP BY query_id, i) GROUP BY query_id) WHERE ok""", r"""long AS (
  SELECT query_id, replace(replace(replace(gold, 'FURNITURE', 'big FURNITURE set'), '''', '"'), 'NATION_2', 'New = NATION') AS s FROM ql),
tk AS (SELECT query_id, list_transform(regexp_extract_all(s, '"[^"]*"|[!<>]=|[A-Za-z0-9_.#$]+|[^\s]', 0), lambda t: CASE WHEN t LIKE '"%' THEN t ELSE lower(t) END) AS toks FROM long),
pair AS (SELECT query_id,
  flatten(list_transform(toks, lambda t: CASE WHEN t LIKE '"%' THEN regexp_extract_all(t, '"|[^\s"]+', 0) ELSE [t] END)) AS yes,
  flatten(list_transform(toks, lambda t, i: CASE WHEN t LIKE '"%' THEN ['"', 'value', '"'] WHEN regexp_matches(t, '^-?[0-9]+(\.[0-9]+)?$') THEN [CASE WHEN i > 1 AND toks[i - 1] = 'limit' THEN 'limit_value' ELSE 'value' END] ELSE [t] END)) AS no
  FROM tk)"""))
def t13(spark, d):
    ql = query_log(spark, Tables(spark, d).events)
    s = F.replace(F.replace(F.col("gold"), F.lit("FURNITURE"), F.lit("big FURNITURE set")), F.lit("NATION_2"), F.lit("New = NATION"))
    x = tk.tokenize(ql.select("query_id", s.alias("gold")), "gold").withColumn("yes", _value_tokens()).withColumn("no", _slot_tokens())
    x = al.align_values(x, "no", "yes").where(F.size("vals") > 0)
    return x.select("query_id", F.size("vals").alias("n_slots"), F.array_join(F.transform("vals", lambda v: F.array_join(v, " ")), " | ").alias("vals"))


# ------------------------------------------------------------------ D30, D31, D41


def _pointers(spark, d):
    """Distinct no-FROM texts of the log with their pointers; (texts, log, vocabulary, size)."""
    cat = star_catalog(spark, d)
    log = query_log(spark, Tables(spark, d).events).select("query_id", "gold")
    texts = log.groupBy("gold").agg(F.min("query_id").alias("query_id"))
    ut, _ = sc.query_tokens(texts, "query_id", cat.columns, sides=("gold",))
    nf = gen.no_from_tokens(ut, KEYS)
    names = F.lower(F.concat_ws(".", "table_name", "column_name"))
    cands = cat.columns.where("column_id > 0").agg(F.array_sort(F.collect_list(names)).alias("c"), F.array_sort(F.collect_set(F.concat(F.lower("table_name"), F.lit(".*")))).alias("s"))
    g = nf.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", "ntok"))).alias("ts")).select("query_id", F.transform("ts", lambda s: s["ntok"]).alias("toks"))
    x = cut_lineage(g.crossJoin(F.broadcast(cands.select(F.concat("c", "s").alias("cands")))))  # one row of names
    vocab = cut_lineage(al.vocabulary(x.select(F.explode(F.array_except("toks", "cands")).alias("w")), "w"))
    size = vocab.count()
    return cut_lineage(x.join(al.encode(x, "query_id", "toks", "cands", vocab, size), "query_id")), log.join(texts.withColumnRenamed("query_id", "k"), "gold"), vocab, size


_POINT_SQL = """cand AS (SELECT list_concat((SELECT list(lower(table_name || '.' || column_name) ORDER BY lower(table_name || '.' || column_name)) FROM lcat WHERE db_id = 'star'),
                 (SELECT list(DISTINCT lower(table_name) || '.*' ORDER BY lower(table_name) || '.*') FROM lcat WHERE db_id = 'star')) AS cands),
voc AS (SELECT word, row_number() OVER (ORDER BY word) - 1 AS idx FROM (SELECT DISTINCT ntok AS word FROM nf, cand WHERE NOT list_contains(cands, ntok) UNION SELECT 'EOS')),
vs AS (SELECT count(*) AS size FROM voc),
ptr AS (SELECT nf.query_id, nf.pos, nf.ntok, coalesce(v.idx, vs.size + list_position(c.cands, nf.ntok) - 1) AS p FROM nf LEFT JOIN voc v ON v.word = nf.ntok, cand c, vs)"""


@register("d30_encode", gw("SELECT query_id, string_agg(CAST(p AS VARCHAR), ' ' ORDER BY pos) || ' ' || CAST((SELECT idx FROM voc WHERE word = 'EOS') AS VARCHAR) AS pointer FROM ptr GROUP BY query_id", _POINT_SQL))
def d30(spark, d):
    x, log, _, _ = _pointers(spark, d)
    return log.join(x.select(F.col("query_id").alias("k"), F.array_join(F.transform("pointer", lambda p: p.cast("string")), " ").alias("pointer")), "k").select("query_id", "pointer")


@register("d31_decode", gw("SELECT query_id, string_agg(ntok, ' ' ORDER BY pos) AS decoded FROM nf GROUP BY query_id"))
def d31(spark, d):
    """Pointers back to tokens: the SQL gives the texts that were encoded."""
    x, log, vocab, size = _pointers(spark, d)
    back = al.decode(x, "query_id", "pointer", "cands", vocab, size)
    return log.join(back.select(F.col("query_id").alias("k"), F.array_join("toks", " ").alias("decoded")), "k").select("query_id", "decoded")


@register("d41_upper_bound", gw("SELECT count(DISTINCT query_id) AS n, CAST(1 AS DOUBLE) AS string_em FROM nf"))
def d41(spark, d):
    """Share of the log that survives encoding and decoding: the ceiling of any model that emits pointers."""
    x, log, vocab, size = _pointers(spark, d)
    back = al.decode(x, "query_id", "pointer", "cands", vocab, size).withColumnRenamed("toks", "back")
    same = x.join(back, "query_id").select(F.col("query_id").alias("k"), (F.col("toks") == F.col("back")).cast("double").alias("same"))
    return log.join(same, "k", "left").agg(F.count("*").alias("n"), F.avg(F.coalesce("same", F.lit(0.0))).alias("string_em"))


# ------------------------------------------------------------------ E21

_PAIRS = {
    "columns_permuted": ("SELECT n_name, n_regionkey, n_nationkey FROM nation", "SELECT n_nationkey AS a, n_name AS b, n_regionkey AS c FROM nation", 1),
    "duplicates_dropped": ("SELECT c_mktsegment FROM customer", "SELECT DISTINCT c_mktsegment FROM customer", 0),
    "same_bag": ("SELECT o_orderpriority, o_custkey FROM orders WHERE o_totalprice > 1000", "SELECT o_custkey, o_orderpriority FROM orders WHERE NOT o_totalprice <= 1000", 1),
    "null_rows": ("SELECT c_name, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey", "SELECT c_name, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey", 0),
    "values_moved_between_rows": ("SELECT r_regionkey, r_name FROM region", "SELECT 4 - r_regionkey AS r_regionkey, r_name FROM region", 0),
    "aggregate": ("SELECT l_returnflag, count(*) AS n, max(l_quantity) AS m FROM lineitem GROUP BY l_returnflag", "SELECT max(l_quantity) AS a, l_returnflag, count(l_orderkey) AS b FROM lineitem GROUP BY l_returnflag", 1),
}


def _bag_sql(name, gold, pred):
    """The pair compared by EXCEPT ALL both ways, the second side's columns put in the first's order by hand."""
    order = {"columns_permuted": "b, c, a", "same_bag": "o_orderpriority, o_custkey", "aggregate": "l_returnflag, b, a"}.get(name, "*")
    return f"""SELECT '{name}' AS pair, (SELECT count(*) FROM ({gold})) AS n_gold, (SELECT count(*) FROM ({pred})) AS n_pred,
      NOT EXISTS (SELECT 1 FROM (({gold}) EXCEPT ALL (SELECT {order} FROM ({pred}))) UNION ALL SELECT 1 FROM ((SELECT {order} FROM ({pred})) EXCEPT ALL ({gold}))) AS matches"""


_ORDERED = {
    "order_kept": ("n_name", "n_name"), "order_reversed": ("n_name", "n_name DESC"),
}
_ORDER_SQL = [f"""SELECT '{k}' AS pair, (SELECT count(*) FROM nation) AS n_gold, (SELECT count(*) FROM nation) AS n_pred, NOT EXISTS (
  SELECT 1 FROM (SELECT n_name, n_regionkey, row_number() OVER (ORDER BY {a}) AS p FROM nation) g JOIN (SELECT n_name, n_regionkey, row_number() OVER (ORDER BY {b}) AS p FROM nation) q USING (p)
  WHERE g.n_name <> q.n_name OR g.n_regionkey <> q.n_regionkey) AS matches""" for k, (a, b) in _ORDERED.items()]


@register("e21_result_match", " UNION ALL ".join([*(_bag_sql(k, g, p) for k, (g, p, _) in _PAIRS.items()), *_ORDER_SQL]))
def e21(spark, d):
    """Result pairs over the star tables: permuted columns, dropped duplicates, null rows, moved values, row order."""
    t = Tables(spark, d)
    for n in ("nation", "customer", "orders", "region", "lineitem"):
        getattr(t, n).createOrReplaceTempView(n)
    rows = []
    for k, (g, p, _) in _PAIRS.items():
        a, b = spark.sql(g), spark.sql(p)
        rows.append((k, a.count(), b.count(), al.result_match(a, b)))
    for k, (g, p) in _ORDERED.items():
        pos = lambda by: F.expr(f"row_number() over (order by {by})")
        a, b = t.nation.select("n_name", "n_regionkey"), t.nation.select(F.col("n_regionkey").alias("x"), F.col("n_name"))
        rows.append((k, a.count(), b.count(), al.result_match(a, b, (pos(g), pos(p)))))
    return spark.createDataFrame(rows, "pair string, n_gold long, n_pred long, matches boolean")


# ------------------------------------------------------------------ D22


@register("d22_mix_batches", f"""WITH r AS (SELECT event_id, row_number() OVER (ORDER BY md5('d22:' || CAST(event_id AS VARCHAR)), event_id) AS nr FROM events WHERE event_id % 3 > 0),
s AS (SELECT event_id, row_number() OVER (ORDER BY md5('d22:' || CAST(event_id AS VARCHAR)), event_id) AS nr FROM events WHERE event_id % 3 = 0),
n AS (SELECT CAST(ceil((SELECT count(*) FROM r) / 45.0) AS BIGINT) AS batches, (SELECT count(*) FROM s) AS n_s),
d AS (SELECT b AS batch, k AS slot, 1 + {sql_bucket('d22s', "(CAST(b AS VARCHAR) || ':' || CAST(k AS VARCHAR))", 'n_s')} AS nr FROM n, range(0, batches) AS x(b), range(0, 19) AS y(k))
SELECT CAST((nr - 1) // 45 AS BIGINT) AS batch, 'real' AS origin, CAST((nr - 1) % 45 AS BIGINT) AS slot, event_id FROM r
UNION ALL SELECT CAST(batch AS BIGINT), 'synthetic', CAST(slot AS BIGINT), event_id FROM d JOIN s USING (nr)""")
def d22(spark, d):
    """Events as training rows: a third of them stands for synthetic ones; batches of 64 with a share of 0.3."""
    e = Tables(spark, d).events.select("event_id")
    return al.mix_batches(e.where("event_id % 3 > 0"), e.where("event_id % 3 = 0"), "event_id", 0.3, 64)


# ------------------------------------------------------------------ ST2


@register("st2_stream_chain", tw("""SELECT conv_id, turn, coalesce(last_value(CASE WHEN (length(pred) - length(replace(pred, '''', ''))) % 2 = 0 THEN pred END IGNORE NULLS)
  OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'none') AS prev_query
FROM (SELECT u.conv_id, u.turn, ql.pred FROM ut u JOIN cq ON cq.conv_id = u.conv_id AND cq.turn = u.turn JOIN ql ON ql.query_id = cq.query_id)"""))
def st2(spark, d):
    """Predicted queries of the conversations, in four shards of turns; a prediction with an open quote is not accepted."""
    t = Tables(spark, d)
    x = conversation_queries(t.conversations, t.events).join(query_log(spark, t.events).select("query_id", F.col("pred").alias("query")), "query_id")
    x = x.select("conv_id", "turn", "query", ((F.length("query") - F.length(F.replace("query", F.lit("'"), F.lit("")))) % 2 == 0).alias("accepted"))
    x = cut_lineage(x)
    base = io.scratch_path(spark, "stream_chain")
    most = x.agg(F.max("turn")).first()[0] or 0
    for i in range(4):  # turns arrive in order; the job stops and starts again between shards two and three
        x.where((F.col("turn") * 4 >= i * (most + 1)) & (F.col("turn") * 4 < (i + 1) * (most + 1))).coalesce(1).write.json(f"{base}/src/part_{i}")
        if i == 1:
            st.stream_chain(spark, f"{base}/src/part_*", f"{base}/sink", f"{base}/_checkpoint")
    return st.stream_chain(spark, f"{base}/src/part_*", f"{base}/sink", f"{base}/_checkpoint").select("conv_id", "turn", "prev_query")
