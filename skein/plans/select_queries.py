"""Reranked beams (D26, D27), numbered interactions (D38) and predictions in gold order."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions.hashing import bucket, sql_bucket
from skein.operators import select as se
from skein.operators import tokens as tk
from skein.plans.dialog_queries import tw, turns
from skein.plans.querylog import query_log, with_ql
from skein.plans.querylog_queries import _SQL_TOKS
from skein.plans.registry import register
from skein.session import Tables
from skein.sources.catalog import STAR_DATABASES

DBS = sorted(STAR_DATABASES)


def beams(spark, d):
    """Two beams a log query, gold and prediction, with an EOS and a token after it; scores and a tenth of invalid ones by md5."""
    ql = query_log(spark, Tables(spark, d).events)
    x = ql.select("query_id", tk.tokenize_expr("gold").alias("gold_toks"), F.explode(F.array(F.struct(F.lit(0).alias("beam"), F.col("gold").alias("sql")), F.struct(F.lit(1).alias("beam"), F.col("pred").alias("sql")))).alias("b"))
    x = x.select("query_id", "gold_toks", "b.beam", tk.tokenize_expr("b.sql").alias("t")).where("t is not null")
    key = F.concat_ws(":", "query_id", "beam")
    x = x.withColumn("toks", F.concat("t", F.array(F.lit("EOS"), F.lit("x"))))
    score = F.transform("toks", lambda t, i: (-bucket("rk", F.concat_ws(":", key, i), 1000)).cast("double"))  # whole thousandths: sums are exact
    return x.select("query_id", "beam", "gold_toks", "toks", score.alias("scores"), (bucket("rv", key, 10) > 0).alias("valid"))


_BEAM_SQL = f"""beam AS (SELECT query_id, CASE side WHEN 'gold' THEN 0 ELSE 1 END AS beam, toks FROM toks WHERE toks IS NOT NULL),
scored AS (SELECT query_id, beam, toks, list_sum(list_transform(range(0, len(toks) + 1), lambda i: -{sql_bucket('rk', "(CAST(query_id AS VARCHAR) || ':' || CAST(beam AS VARCHAR) || ':' || CAST(i AS VARCHAR))", 1000)}))::DOUBLE / (len(toks) + 1) AS score
  FROM beam WHERE {sql_bucket('rv', "(CAST(query_id AS VARCHAR) || ':' || CAST(beam AS VARCHAR))", 10)} > 0)"""


@register("d26_rerank_max", with_ql("SELECT query_id, CAST(beam AS INTEGER) AS beam, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, beam) AS r FROM scored) WHERE r = 1", _SQL_TOKS, _BEAM_SQL))
def d26(spark, d):
    return se.rerank_max(beams(spark, d), "query_id").withColumn("score", F.round("score", 6))


@register("d27_rerank_oracle", with_ql("""SELECT query_id, CAST(beam AS INTEGER) AS beam, round(score, 6) AS score FROM (
  SELECT s.*, row_number() OVER (PARTITION BY s.query_id ORDER BY CASE WHEN s.toks = g.toks THEN 0 ELSE 1 END, s.score DESC, s.beam) AS r
  FROM scored s LEFT JOIN toks g ON g.query_id = s.query_id AND g.side = 'gold') WHERE r = 1""", _SQL_TOKS, _BEAM_SQL))
def d27(spark, d):
    return se.rerank_oracle(beams(spark, d), "query_id", "gold_toks").withColumn("score", F.round("score", 6))


def _dialogues(spark, d):
    """Turns with a database per conversation; one query in seven names its table instead of the alias."""
    t = turns(spark, d).select("conv_id", "turn", "query", F.element_at(F.array(*[F.lit(x) for x in DBS]), (bucket("nd", "conv_id", len(DBS)) + 1).cast("int")).alias("db_id"))
    plain = F.when(bucket("na", F.concat_ws(":", "conv_id", "turn"), 7) == 0, F.replace("query", F.lit("T1."), F.lit("customer."))).otherwise(F.col("query"))
    return t.withColumn("query", plain)


_DIALOGUE_SQL = f"""dlg AS (SELECT conv_id, turn, CASE WHEN {sql_bucket('na', "(CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR))", 7)} = 0 THEN replace(query, 'T1.', 'customer.') ELSE query END AS query,
  [{", ".join(f"'{x}'" for x in DBS)}][1 + {sql_bucket('nd', 'conv_id', len(DBS))}] AS db_id FROM turns),
nums AS (SELECT conv_id, db_id, row_number() OVER (PARTITION BY db_id ORDER BY conv_id) AS number FROM (SELECT DISTINCT conv_id, db_id FROM dlg))"""


@register("d38_number_interactions", tw("""SELECT d.conv_id, d.turn, d.db_id, n.number FROM dlg d JOIN nums n USING (conv_id)
WHERE NOT contains(d.query, 'customer.')""", _DIALOGUE_SQL))
def d38(spark, d):
    x = _dialogues(spark, d)
    numbers = se.number_interactions(x.select("conv_id", "db_id").distinct(), "db_id", "conv_id")
    kept = x.withColumn("toks", tk.tokenize_expr("query")).where("toks is not null").where(~se.unaliased("toks"))
    return kept.select("conv_id", "turn").join(numbers, "conv_id").select("conv_id", "turn", "db_id", "number")


@register("d39_order_like_gold", tw("""SELECT d.conv_id, d.turn, row_number() OVER (ORDER BY f.p, d.conv_id, d.turn) AS ordinal
FROM dlg d JOIN (SELECT db_id, min(md5('go:' || CAST(conv_id AS VARCHAR))) AS p FROM dlg GROUP BY db_id) f USING (db_id)""", _DIALOGUE_SQL))
def d39(spark, d):
    """The gold file is the dialogues in md5 order."""
    x = _dialogues(spark, d).select("conv_id", "turn", "db_id")
    gold = x.withColumn("pos", F.md5(F.concat(F.lit("go:"), F.col("conv_id").cast("string"))))
    return se.order_like_gold(x, gold, "db_id", "conv_id", "turn", "pos").select("conv_id", "turn", "ordinal")
