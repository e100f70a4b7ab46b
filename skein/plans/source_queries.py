"""Sources and sinks (S2-S6, S8-S13) as round trips: data Spark derives from the
given tables is written in the stored format under the shared checkpoint
folder, then read back with the source under test."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.functions.hashing import bucket
from skein.operators import dialog as dg
from skein.plans.catalog_queries import CAT_SQL
from skein.plans.dialog_queries import tw, turns
from skein.plans.querylog import conversation_queries, conversation_queries_sql, query_log, query_log_sql
from skein.plans.registry import register
from skein.session import Tables
from skein.sources import files as io
from skein.sources.catalog import catalog_from_json, star_catalogs

# -------------------------------------------------------------------- S2


@register("s02_read_interactions", tw("""SELECT conv_id AS interaction_id, 'star' AS database_id,
  arg_max(question, turn_idx) AS final_utterance, arg_max(query, turn_idx) AS final_query, count(*) AS n_turns
FROM turns GROUP BY conv_id"""))
def s02(spark, d):
    inter = dg.interactions(turns(spark, d)).select(
        F.col("db_id").alias("database_id"), F.col("conv_id").alias("interaction_id"), "final", "interaction")
    path = io.scratch_path(spark, "interactions")
    io.write_interactions(inter, path)
    r = io.read_interactions(spark, path)
    return r.select("interaction_id", "database_id", F.col("final.utterance").alias("final_utterance"),
                    F.col("final.query").alias("final_query"), F.size("interaction").cast("long").alias("n_turns"))


# -------------------------------------------------------------------- S3
# two question files (a bucket split of the log), read together

@register("s03_read_questions", f"""WITH {query_log_sql()}
SELECT gold AS goal, 'how about ' || CAST(query_id AS VARCHAR) AS question, gold AS query, 'star' AS db_id,
       CAST(0 AS BIGINT) AS turn_idx, 1 AS n_utt FROM ql""")
def s03(spark, d):
    ql = query_log(spark, Tables(spark, d).events)
    q = ql.select(F.lit("star").alias("db_id"), F.concat(F.lit("how about "), F.col("query_id").cast("string"))
                  .alias("question"), F.col("gold").alias("query"), bucket("s", "query_id", 4).alias("b"))
    a, b = io.scratch_path(spark, "questions"), io.scratch_path(spark, "questions_others")
    q.filter(F.col("b") != 0).drop("b").write.json(a)
    q.filter(F.col("b") == 0).drop("b").write.json(b)
    r = io.read_questions(spark, [a, b])
    return r.select("goal", "question", "query", "db_id", "turn_idx", F.size("utterances").alias("n_utt"))


# ---------------------------------------------------------------- S4, S10
# turn lines appended in two shards (a bucket split of the dialogues), read back by glob

@register("s04_read_turns_jsonl", tw("""SELECT goal, question, query, db_id, turn_idx, CAST(count(*) OVER w AS BIGINT) AS n_utt,
  string_agg(question, ' | ') OVER w AS history FROM turns
WINDOW w AS (PARTITION BY conv_id ORDER BY turn_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""))
def s04(spark, d):
    t = turns(spark, d)
    w = Window.partitionBy("conv_id").orderBy("turn_idx").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("utterances", F.collect_list("question").over(w)).withColumn("b", bucket("sh", "conv_id", 2))
    path = io.scratch_path(spark, "self_play")
    io.write_turns_jsonl(t.filter(F.col("b") == 0), path + "/shard_0")
    io.write_turns_jsonl(t.filter(F.col("b") == 1), path + "/shard_1")
    r = io.read_turns_jsonl(spark, path + "/shard_*")
    return r.select("goal", "question", "query", "db_id", "turn_idx", F.size("utterances").cast("long").alias("n_utt"),
                    F.array_join("utterances", " | ").alias("history"))


# -------------------------------------------------------------------- S5
# gold lines ``sql<TAB>db`` and prediction lines, both in query_id order

@register("s05_read_pairs_tsv", f"""WITH {query_log_sql()}
SELECT CAST(row_number() OVER (ORDER BY query_id) - 1 AS BIGINT) AS idx, gold, 'star' AS db_id, pred FROM ql""")
def s05(spark, d):
    ql = query_log(spark, Tables(spark, d).events)
    g, p = io.scratch_path(spark, "gold"), io.scratch_path(spark, "pred")
    ql.orderBy("query_id").select(F.concat("gold", F.lit("\tstar")).alias("value")).write.text(g)
    ql.orderBy("query_id").select(F.col("pred").alias("value")).write.text(p)
    return io.read_pairs_tsv(spark, g, p)


# ---------------------------------------------------------------- S6, S11
# predictions of the user turns, one block per conversation

@register("s06_read_blocks", f"""WITH {query_log_sql()}, {conversation_queries_sql()},
p AS (SELECT cq.conv_id, cq.turn, ql.pred FROM cq JOIN ql USING (query_id))
SELECT arg_min(pred, turn) OVER (PARTITION BY conv_id) AS block,
       CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS pos, pred AS line FROM p""")
def s06(spark, d):
    t = Tables(spark, d)
    p = conversation_queries(t.conversations, t.events).join(query_log(spark, t.events), "query_id")
    path = io.scratch_path(spark, "predictions")
    io.write_predictions(p, path, "conv_id", "turn", "pred")
    return io.read_blocks(spark, path)


# -------------------------------------------------------------------- S8
# the catalogs of the logical star databases, written as a tables.json array and read back

@register("s08_catalog_from_json", f"""WITH RECURSIVE {CAT_SQL}
SELECT db_id, column_id, table_id, table_name, column_name, column_type, is_pk FROM lcat
UNION ALL SELECT DISTINCT db_id, 0, -1, NULL, '*', 'text', false FROM lcat""")
def s08(spark, d):
    cat = star_catalogs(spark, d)
    tabs = cat.tables.groupBy("db_id").agg(F.array_sort(F.collect_list(F.struct("table_id", "table_name"))).alias("t"))
    cols = cat.columns.groupBy("db_id").agg(
        F.array_sort(F.collect_list(F.struct("column_id", "table_id", "column_name", "column_type", "is_pk"))).alias("c"))
    fks = cat.fks.groupBy("db_id").agg(F.collect_list(F.array(F.col("column_id").cast("long"),
                                                              F.col("other_column_id").cast("long"))).alias("f"))
    db = tabs.join(cols, "db_id").join(fks, "db_id", "left").select(
        "db_id",
        F.transform("t", lambda s: s["table_name"]).alias("table_names_original"),
        F.transform("t", lambda s: F.lower(s["table_name"])).alias("table_names"),
        F.transform("c", lambda s: F.array(s["table_id"].cast("string"), s["column_name"])).alias("column_names_original"),
        F.transform("c", lambda s: F.array(s["table_id"].cast("string"), F.lower(s["column_name"]))).alias("column_names"),
        F.transform("c", lambda s: s["column_type"]).alias("column_types"),
        F.transform(F.filter("c", lambda s: s["is_pk"]), lambda s: s["column_id"].cast("long")).alias("primary_keys"),
        F.coalesce("f", F.array().cast("array<array<long>>")).alias("foreign_keys"))
    # the catalog is schema-sized: one JSON array for all databases
    doc = db.agg(F.concat(F.lit("["), F.array_join(F.collect_list(F.to_json(F.struct(*db.columns))), ",\n"),
                          F.lit("]")).alias("value"))
    path = io.scratch_path(spark, "tables_json")
    doc.write.text(path)
    return catalog_from_json(spark, path).columns


# -------------------------------------------------------------------- S9

_HEADS = [("nation", "n_nationkey", ["n_nationkey", "n_name", "n_regionkey"]),
          ("region", "r_regionkey", ["r_regionkey", "r_name"]),
          ("part", "p_partkey", ["p_partkey", "p_name", "p_brand", "p_type", "p_size"])]


def _head_sql() -> str:
    parts = []
    for t, k, cols in _HEADS:
        for c in cols:
            parts.append(f"SELECT '{t}' AS table_name, '{c}' AS column_name, "
                         f"string_agg(coalesce(CAST({c} AS VARCHAR), 'NULL'), ' | ' ORDER BY {k}) AS vals "
                         f"FROM (SELECT * FROM {t} ORDER BY {k} LIMIT 5)")
    return "\nUNION ALL ".join(parts)


@register("s09_table_head", _head_sql())
def s09(spark, d):
    t = Tables(spark, d)
    out = None
    for name, key, cols in _HEADS:
        h = io.table_head(getattr(t, name).select(*cols), name, key)
        out = h if out is None else out.unionByName(h)
    return out


# -------------------------------------------------------------------- S12

@register("s12_write_examples_json", tw("SELECT conv_id, turn_idx, question, query, goal FROM turns"))
def s12(spark, d):
    x = turns(spark, d).select("conv_id", "turn_idx", "question", "query", "goal")
    path = io.scratch_path(spark, "examples")
    io.write_examples_json(x, path)
    return spark.read.schema(x.schema).json(path)


# -------------------------------------------------------------------- S13

@register("s13_stage", f"WITH {query_log_sql()} SELECT query_id, shape, gold, pred FROM ql")
def s13(spark, d):
    path = io.scratch_path(spark, "stage_ql")
    first = io.stage(spark, lambda: query_log(spark, Tables(spark, d).events), path)
    again = io.stage(spark, lambda: (_ for _ in ()).throw(RuntimeError("stage recomputed")), path)
    assert first.schema == again.schema
    return again

