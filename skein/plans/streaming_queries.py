"""Streaming jobs (ST1, ST3) fed with files Spark derives from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.functions.hashing import bucket
from skein.plans.dialog_queries import tw, turns
from skein.plans.querylog import conversation_queries, conversation_queries_sql, query_log, query_log_sql
from skein.plans.registry import register
from skein.session import Tables
from skein.sources import files as io
from skein.streaming import turns as st


@register("st1_stream_turns", tw("""SELECT goal, question, query, db_id, turn_idx, CAST(count(*) OVER w AS BIGINT) AS n_utt
FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""))
def st1(spark, d):
    t = turns(spark, d)
    w = Window.partitionBy("conv_id").orderBy("turn_idx").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("utterances", F.collect_list("question").over(w)).withColumn("b", bucket("st", "conv_id", 4))
    base = io.scratch_path(spark, "stream_turns")
    for i in range(4):  # four shards appended one after another
        io.write_turns_jsonl(t.filter(F.col("b") == i), f"{base}/src/self_play_{i}")
    out = st.stream_turns(spark, f"{base}/src/self_play_*", f"{base}/sink", f"{base}/_checkpoint")
    return out.select("goal", "question", "query", "db_id", "turn_idx", "n_utt")


@register("st3_stream_keep_rate", f"""WITH {query_log_sql()}, {conversation_queries_sql()}
SELECT cq.conv_id, count(*) AS n_turns, sum(CASE WHEN ql.gold = ql.pred THEN 1 ELSE 0 END) AS n_kept,
       round(sum(CASE WHEN ql.gold = ql.pred THEN 1 ELSE 0 END) / count(*), 6) AS keep_rate
FROM cq JOIN ql USING (query_id) GROUP BY cq.conv_id""")
def st3(spark, d):
    t = Tables(spark, d)
    x = conversation_queries(t.conversations, t.events).join(query_log(spark, t.events), "query_id").select(
        "conv_id", "turn", F.when(F.col("gold") == F.col("pred"), 1).otherwise(0).cast("long").alias("kept"),
        bucket("sk", F.concat_ws("-", "conv_id", "turn"), 3).alias("b"))
    base = io.scratch_path(spark, "stream_keep")
    for i in range(3):  # turns arrive in three files
        x.filter(F.col("b") == i).drop("b").write.json(f"{base}/src/part_{i}")
    return st.stream_keep_rate(spark, f"{base}/src/part_*", "conv_id long, turn long, kept long",
                               f"{base}/sink", f"{base}/_checkpoint")
