"""Turn and dialogue reports (E19, E20), flag averages (E25) and dataset operators
(D12, D17, D33, D34, D36, D40) on the dialogue link CONV x QL and the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.functions.hashing import bucket, sql_bucket
from skein.operators import score as sc
from skein.plans.catalog_queries import CAT_SQL
from skein.plans.dialog_queries import d29, tw, turns
from skein.plans.querylog import conversation_queries, query_log, query_log_sql
from skein.plans.querylog_queries import _SQL_TOKS
from skein.plans.registry import register
from skein.session import Tables
from skein.sources.catalog import star_catalog, star_catalogs

# ---------------------------------------------------------------- E19, E20
# correctness of a turn = string exact match of its QL pair


def _turn_em(spark, d):
    t = Tables(spark, d)
    cq = conversation_queries(t.conversations, t.events)
    em = sc.string_em(query_log(spark, t.events))
    x = cq.join(em, "query_id")
    w = Window.partitionBy("conv_id").orderBy("turn")
    return x.select("conv_id", "turn", (F.row_number().over(w) - 1).alias("turn_idx"), "string_em")


_SQL_TURN_EM = """em AS (
  SELECT query_id, CASE WHEN coalesce(g.toks = p.toks, false) THEN 1 ELSE 0 END AS string_em
  FROM (SELECT query_id, toks FROM toks WHERE side = 'gold') g JOIN (SELECT query_id, toks FROM toks WHERE side = 'pred') p
  USING (query_id)),
tem AS (
  SELECT cq.conv_id, cq.turn, row_number() OVER (PARTITION BY cq.conv_id ORDER BY cq.turn) - 1 AS turn_idx, em.string_em
  FROM cq JOIN em USING (query_id))"""


@register("e19_turn_report", tw(
    "SELECT CASE WHEN turn_idx > 3 THEN 'turn >4' ELSE 'turn ' || CAST(turn_idx + 1 AS VARCHAR) END AS bucket, "
    "count(*) AS n, round(avg(string_em), 6) AS acc FROM tem GROUP BY 1", _SQL_TOKS, _SQL_TURN_EM))
def e19(spark, d):
    x = _turn_em(spark, d)
    b = F.when(F.col("turn_idx") > 3, F.lit("turn >4")).otherwise(
        F.concat(F.lit("turn "), (F.col("turn_idx") + 1).cast("string")))
    return x.groupBy(b.alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg("string_em"), 6).alias("acc"))


@register("e20_joint_report", tw(
    "SELECT count(*) AS n_interactions, round(avg(ok), 6) AS joint_acc "
    "FROM (SELECT conv_id, min(string_em) AS ok FROM tem GROUP BY conv_id)", _SQL_TOKS, _SQL_TURN_EM))
def e20(spark, d):
    per = _turn_em(spark, d).groupBy("conv_id").agg(F.min("string_em").alias("ok"))
    return per.agg(F.count("*").alias("n_interactions"), F.round(F.avg("ok"), 6).alias("joint_acc"))


# -------------------------------------------------------------------- E25
# labels: quality = gold flag, toxic = predicted flag

@register("e25_denotation_averages", """SELECT count(*) AS n,
  round(avg(CASE WHEN quality = toxic THEN 1.0 ELSE 0.0 END), 6) AS agree_rate,
  round(avg(quality), 6) AS gold_rate, round(avg(toxic), 6) AS pred_rate,
  round(sum(quality * toxic) / nullif(sum(toxic), 0), 6) AS prec,
  round(sum(quality * toxic) / nullif(sum(quality), 0), 6) AS rec,
  round(2.0 * sum(quality * toxic) / nullif(sum(quality) + sum(toxic), 0), 6) AS f1
FROM labels""")
def e25(spark, d):
    lb = Tables(spark, d).labels
    tp = F.sum(F.col("quality") * F.col("toxic"))
    q, p = F.sum("quality"), F.sum("toxic")

    def ratio(a, b):
        return F.round(F.when(b != 0, a / b), 6)
    return lb.agg(F.count("*").alias("n"),
                  F.round(F.avg(F.when(F.col("quality") == F.col("toxic"), 1.0).otherwise(0.0)), 6).alias("agree_rate"),
                  F.round(F.avg("quality"), 6).alias("gold_rate"), F.round(F.avg("toxic"), 6).alias("pred_rate"),
                  ratio(tp, p).alias("prec"), ratio(tp, q).alias("rec"), ratio(2.0 * tp, q + p).alias("f1"))


# -------------------------------------------------------------------- D12

@register("d12_quality_filter")
def d12(spark, d):
    """Dialogues whose last user turn has pooled acc > .5 and pooled rec > .5 over the ten categories."""
    t = Tables(spark, d)
    cq = conversation_queries(t.conversations, t.events)
    last = cq.groupBy("conv_id").agg(F.max_by("query_id", "turn").alias("query_id"))
    ql = query_log(spark, t.events).join(last.select("query_id").distinct(), "query_id", "left_semi")
    _, pc = sc.score_pairs(ql, "query_id", star_catalog(spark, d).columns)
    pooled = pc.groupBy("query_id").agg(
        (F.sum("cnt") / F.sum(F.when(F.col("pred_total") > 0, F.col("pred_total")))).alias("acc"),
        (F.sum("cnt") / F.sum(F.when(F.col("label_total") > 0, F.col("label_total")))).alias("rec"))
    good = pooled.filter((F.col("acc") > 0.5) & (F.col("rec") > 0.5)).select("query_id")
    keep = last.join(good, "query_id").select("conv_id")
    return t.conversations.join(keep, "conv_id", "left_semi").select("conv_id", "turn", "role")


# -------------------------------------------------------------------- D17
# a = dialogue turns (split 'train'); b = single-turn examples of the log (no history, no conv)

@register("d17_concat_splits", tw(f"""SELECT * FROM (
  SELECT conv_id, turn_idx, question, query, 'train' AS split FROM turns
  UNION ALL BY NAME
  SELECT CAST(query_id AS BIGINT) AS example_id, gold AS query, 'extra' AS split
  FROM ql WHERE {sql_bucket('x', 'query_id', 8)} = 0)"""))
def d17(spark, d):
    a = turns(spark, d).select("conv_id", "turn_idx", "question", "query", F.lit("train").alias("split"))
    ql = query_log(spark, Tables(spark, d).events)
    b = ql.filter(bucket("x", "query_id", 8) == 0).select(
        F.col("query_id").cast("long").alias("example_id"), F.col("gold").alias("query"), F.lit("extra").alias("split"))
    return a.unionByName(b, allowMissingColumns=True)


# -------------------------------------------------------------------- D40
# batch 0 = predictions of the log; batch 1 = a re-run over a bucket of the ids with the gold text

@register("d40_merge_predictions", f"""WITH {query_log_sql()},
b AS (SELECT query_id, pred AS prediction, 0 AS batch FROM ql
      UNION ALL SELECT query_id, gold, 1 FROM ql WHERE {sql_bucket('m', 'query_id', 3)} = 0)
SELECT query_id, arg_max(prediction, batch) AS prediction, max(batch) AS batch FROM b GROUP BY query_id""")
def d40(spark, d):
    ql = query_log(spark, Tables(spark, d).events)
    b = ql.select("query_id", F.col("pred").alias("prediction"), F.lit(0).alias("batch")).unionByName(
        ql.filter(bucket("m", "query_id", 3) == 0).select("query_id", F.col("gold").alias("prediction"),
                                                          F.lit(1).alias("batch")))
    return b.groupBy("query_id").agg(F.max_by("prediction", "batch").alias("prediction"), F.max("batch").alias("batch"))


# -------------------------------------------------------------------- D36

@register("d36_candidates", """WITH RECURSIVE {cat},
cand AS (SELECT db_id, column_id, table_name, column_name FROM lcat
         UNION ALL SELECT DISTINCT db_id, 0, NULL, '*' FROM lcat)
SELECT db_id, CAST(count(*) AS BIGINT) AS n_cand,
       string_agg(coalesce(lower(table_name), 'null') || '.' || lower(column_name), ' ' ORDER BY column_id) AS candidates
FROM cand GROUP BY db_id""".replace("{cat}", CAT_SQL))
def d36(spark, d):
    cols = star_catalogs(spark, d).columns
    name = F.concat(F.coalesce(F.lower("table_name"), F.lit("null")), F.lit("."), F.lower("column_name"))
    g = cols.groupBy("db_id").agg(F.count("*").cast("long").alias("n_cand"),
                                  F.array_sort(F.collect_list(F.struct("column_id", name.alias("n")))).alias("c"))
    return g.select("db_id", "n_cand", F.array_join(F.transform("c", lambda s: s["n"]), " ").alias("candidates"))


# -------------------------------------------------------------------- D34

@register("d34_average_vectors", """SELECT label, CAST(max(n) AS BIGINT) AS n,
  list(round(m, 5) ORDER BY pos) AS mean_vec
FROM (SELECT label, pos, count(*) AS n, avg(CAST(v AS DOUBLE)) AS m
      FROM (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings)
      GROUP BY label, pos)
GROUP BY label""")
def d34(spark, d):
    e = Tables(spark, d).embeddings
    x = e.select("label", F.posexplode("embedding").alias("pos", "v"))
    # partial aggregation per (label, pos) before the shuffle: a hot label never lands whole in one task
    m = x.groupBy("label", "pos").agg(F.count("*").alias("n"), F.avg(F.col("v").cast("double")).alias("m"))
    g = m.groupBy("label").agg(F.max("n").cast("long").alias("n"),
                               F.array_sort(F.collect_list(F.struct("pos", F.round("m", 5).alias("m")))).alias("a"))
    return g.select("label", "n", F.transform("a", lambda s: s["m"]).alias("mean_vec"))


# -------------------------------------------------------------------- D33
# vocabulary of D29 (idx) -> vector with vec_id = idx, zeros when missing

@register("d33_vector_lookup", """WITH v AS (
  SELECT token, CAST(row_number() OVER (ORDER BY conv_id, turn, pos) AS BIGINT) AS idx FROM (
    SELECT token, arg_min(conv_id, conv_id * 100000000 + turn * 100000 + pos) AS conv_id,
           arg_min(turn, conv_id * 100000000 + turn * 100000 + pos) AS turn,
           arg_min(pos, conv_id * 100000000 + turn * 100000 + pos) AS pos FROM (
      SELECT conv_id, turn, unnest(w) AS token, generate_subscripts(w, 1) AS pos FROM (
        SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z]+', 0) AS w FROM conversations WHERE role = 'user'))
    GROUP BY token)),
dim AS (SELECT max(len(embedding)) AS k FROM embeddings)
SELECT v.token, v.idx, e.vec_id IS NOT NULL AS found,
       round(list_sum(coalesce(e.embedding, list_transform(range((SELECT k FROM dim)), lambda i: CAST(0 AS FLOAT)))), 4) AS vsum,
       len(coalesce(e.embedding, list_transform(range((SELECT k FROM dim)), lambda i: CAST(0 AS FLOAT)))) AS dim
FROM v LEFT JOIN embeddings e ON e.vec_id = v.idx""")
def d33(spark, d):
    v = d29(spark, d)
    e = Tables(spark, d).embeddings
    k = e.select(F.max(F.size("embedding"))).scalar()  # scalar subquery, no driver round trip
    x = v.join(e, v["idx"] == e["vec_id"], "left")
    x = x.withColumn("vec", F.coalesce(F.col("embedding"), F.array_repeat(F.lit(0.0).cast("float"), k.cast("int"))))
    # a missing vector is all zeros: its sum is 0 (the scalar subquery may not sit inside a lambda)
    vsum = F.coalesce(F.aggregate("embedding", F.lit(0.0).cast("double"), lambda a, b: a + b), F.lit(0.0))
    return x.select("token", "idx", F.col("vec_id").isNotNull().alias("found"), F.round(vsum, 4).alias("vsum"),
                    F.size("vec").alias("dim"))


# -------------------------------------------------------------------- D32
# question words of user turns -> first star column whose natural name (prefix stripped) equals the word
# up to a trailing s (the stemmer is dropped). The candidate keys are schema-sized and broadcast.

_D32_SQL = f"""WITH RECURSIVE {CAT_SQL},
cand AS (SELECT column_id, regexp_replace(lower(column_name), '^[a-z]+_', '') AS c FROM lcat WHERE db_id = 'star'),
keys AS (SELECT k, min(column_id) AS pointer FROM (
  SELECT c AS k, column_id FROM cand UNION ALL SELECT c || 's', column_id FROM cand
  UNION ALL SELECT substr(c, 1, length(c) - 1), column_id FROM cand WHERE suffix(c, 's')) GROUP BY k),
w AS (SELECT conv_id, turn, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos
      FROM (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z_]+', 0) AS ws FROM conversations WHERE role = 'user'))
SELECT w.conv_id, w.turn, CAST(w.pos AS INTEGER) AS pos, w.word, CAST(k.pointer AS INTEGER) AS pointer
FROM w LEFT JOIN keys k ON k.k = w.word"""


@register("d32_fuzzy_pointer", _D32_SQL)
def d32(spark, d):
    cols = star_catalog(spark, d).columns.filter(F.col("column_name") != "*")
    c = cols.select("column_id", F.regexp_replace(F.lower("column_name"), "^[a-z]+_", "").alias("c"))
    keys = c.select(F.col("c").alias("k"), "column_id").unionByName(
        c.select(F.concat("c", F.lit("s")).alias("k"), "column_id")).unionByName(
        c.filter(F.col("c").endswith("s")).select(F.expr("substring(c, 1, length(c) - 1)").alias("k"), "column_id"))
    keys = keys.groupBy("k").agg(F.min("column_id").cast("int").alias("pointer"))
    u = Tables(spark, d).conversations.filter(F.col("role") == "user")
    w = u.select("conv_id", "turn", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z_]+"), 0))
                 .alias("pos", "word"))
    x = w.join(keys, w["word"] == keys["k"], "left")
    return x.select("conv_id", "turn", F.col("pos").cast("int"), "word", "pointer")


# -------------------------------------------------------------------- D42
# split by dialogue bucket; a turn is valid when its linked prediction tokenizes; gold previous turn attached

@register("d42_training_pairs", tw(f"""SELECT * FROM (
  SELECT t.conv_id, t.turn_idx, CASE WHEN {sql_bucket('sp', 't.conv_id', 4)} = 0 THEN 'dev' ELSE 'train' END AS split,
         coalesce(lag(t.query) OVER (PARTITION BY t.conv_id ORDER BY t.turn_idx), 'none') AS prev_query, t.query,
         (length(replace(ql.pred, '''', '"')) - length(replace(replace(ql.pred, '''', '"'), '"', ''))) % 2 = 0 AS valid
  FROM turns t JOIN cq ON cq.conv_id = t.conv_id AND cq.turn = t.turn JOIN ql ON ql.query_id = cq.query_id)
WHERE split <> 'train' OR valid"""))
def d42(spark, d):
    from skein.operators import tokens as tk
    t = Tables(spark, d)
    cq = conversation_queries(t.conversations, t.events)
    ql = query_log(spark, t.events).select("query_id", "pred")
    x = turns(spark, d).join(cq, ["conv_id", "turn"]).join(ql, "query_id")
    w = Window.partitionBy("conv_id").orderBy("turn_idx")
    x = x.select("conv_id", "turn_idx",
                 F.when(bucket("sp", "conv_id", 4) == 0, F.lit("dev")).otherwise(F.lit("train")).alias("split"),
                 F.coalesce(F.lag("query").over(w), F.lit("none")).alias("prev_query"), "query",
                 tk.tokenize_expr("pred").isNotNull().alias("valid"))
    return x.filter((F.col("split") != "train") | F.col("valid"))
