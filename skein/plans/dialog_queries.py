"""Dialogue family on CONV x QL: the user turns of ``conversations`` carry a query of the log."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.functions import ordered
from skein.operators import catalog as co
from skein.operators import dialog as dg
from skein.operators import score as sc
from skein.plans.catalog_queries import CAT_SQL
from skein.plans.querylog import conversation_queries, conversation_queries_sql, query_log, query_log_sql
from skein.plans.registry import register
from skein.session import Tables
from skein.sources.catalog import star_catalogs


def turns(spark, d):
    """(conv_id, turn, turn_idx, question, query, goal, db_id) for every user turn."""
    t = Tables(spark, d)
    cq = conversation_queries(t.conversations, t.events)
    ql = query_log(spark, t.events).select("query_id", F.col("gold").alias("query"))
    u = t.conversations.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"))
    x = u.join(cq, ["conv_id", "turn"]).join(ql, "query_id")
    w = Window.partitionBy("conv_id").orderBy("turn")
    x = x.withColumn("turn_idx", (F.row_number().over(w) - 1).cast("long"))
    goal = F.last("query").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return x.select("conv_id", "turn", "turn_idx", "question", "query", goal.alias("goal"), F.lit("star").alias("db_id"))


TURNS_SQL = f"""{query_log_sql()},
{conversation_queries_sql()},
ut AS (
  SELECT c.conv_id, c.turn, c.text AS question, ql.gold AS query,
         CAST(row_number() OVER (PARTITION BY c.conv_id ORDER BY c.turn) - 1 AS BIGINT) AS turn_idx
  FROM conversations c JOIN cq ON cq.conv_id = c.conv_id AND cq.turn = c.turn JOIN ql ON ql.query_id = cq.query_id
  WHERE c.role = 'user'),
turns AS (
  SELECT conv_id, turn, turn_idx, question, query,
         last_value(query) OVER (PARTITION BY conv_id ORDER BY turn_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS goal,
         'star' AS db_id FROM ut)"""


def tw(body: str, *extra: str) -> str:
    more = "".join(",\n" + e for e in extra)
    return f"WITH RECURSIVE {TURNS_SQL}{more}\n{body}"


_SCHEMA_SQL = CAT_SQL + """,
pt AS (SELECT db_id, table_id, table_name, string_agg(lower(column_name), ' , ' ORDER BY column_id) AS cols
       FROM lcat GROUP BY db_id, table_id, table_name),
sch AS (SELECT db_id, ' | ' || db_id || string_agg(' | ' || lower(table_name) || ' : ' || cols, '' ORDER BY table_id) AS schema
        FROM pt GROUP BY db_id)"""


def _schema(spark, d):
    return co.serialize_schema(star_catalogs(spark, d))


def _flat(spark, d):
    return dg.flatten_turns(dg.interactions(turns(spark, d)))


@register("d01_flatten_turns", tw("SELECT conv_id, turn_idx, question AS utterance, query FROM turns"))
def d01(spark, d):
    return _flat(spark, d).select("conv_id", "turn_idx", "utterance", "query")


@register("d02_goal_row", tw(
    "SELECT conv_id, turn_idx, question AS utterance, query FROM turns UNION ALL "
    "SELECT conv_id, -1, arg_max(question, turn_idx), arg_max(query, turn_idx) FROM turns GROUP BY conv_id"))
def d02(spark, d):
    return dg.goal_row(_flat(spark, d)).select("conv_id", "turn_idx", "utterance", "query")


_HIST = ("SELECT conv_id, turn_idx, CAST(count(*) OVER w AS BIGINT) AS n_hist, "
         "string_agg(question, ' | ') OVER w AS history FROM turns "
         "WINDOW w AS (PARTITION BY conv_id ORDER BY turn_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")


@register("d03_utterance_history", tw(_HIST))
def d03(spark, d):
    h = dg.utterance_history(_flat(spark, d))
    return h.select("conv_id", "turn_idx", F.size("utterances").cast("long").alias("n_hist"),
                    F.array_join("utterances", " | ").alias("history"))


@register("d03p_history_split_pipe", tw(
    "SELECT conv_id, turn_idx, CAST(sum(len(string_split(question, '|'))) OVER w AS BIGINT) AS n_hist FROM turns "
    "WINDOW w AS (PARTITION BY conv_id ORDER BY turn_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"))
def d03p(spark, d):
    h = dg.utterance_history(_flat(spark, d), split_pipe=True)
    return h.select("conv_id", "turn_idx", F.size("utterances").cast("long").alias("n_hist"))


@register("d04_sessionize",
          "SELECT conv_id, turn, CAST(sum(r) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) "
          "AS session FROM (SELECT conv_id, turn, k, CASE WHEN lag(turn) OVER (ORDER BY k) IS NULL "
          "OR turn <= lag(turn) OVER (ORDER BY k) THEN 1 ELSE 0 END AS r "
          "FROM (SELECT conv_id, turn, conv_id * 100000 + turn AS k FROM conversations))")
def d04(spark, d):
    c = Tables(spark, d).conversations.select("conv_id", "turn", (F.col("conv_id") * 100000 + F.col("turn")).alias("k"))
    return dg.sessionize(c, "k", "turn").select("conv_id", "turn", F.col("session").cast("long"))


_CTX = ("SELECT conv_id, turn_idx, goal, "
        "coalesce(string_agg(target, ' / ') OVER (PARTITION BY conv_id ORDER BY turn_idx DESC ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS question, "
        "coalesce(string_agg(query, ' / ') OVER (PARTITION BY conv_id ORDER BY turn_idx DESC ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS query, "
        "target, ltrim(s.schema, ' |') AS schema FROM (SELECT *, CASE WHEN lead(turn_idx) OVER (PARTITION BY conv_id ORDER BY turn_idx) IS NULL "
        "THEN trim(question) || ' <s>' ELSE trim(question) END AS target FROM turns) t LEFT JOIN sch s USING (db_id)")


@register("d05_contexts", tw(_CTX, _SCHEMA_SQL))
def d05(spark, d):
    return dg.contexts(turns(spark, d), _schema(spark, d))


@register("d06_model_input", tw(
    "SELECT conv_id, turn_idx, trim(question) || ' ' || trim(s.schema) || "
    "coalesce(' || ' || string_agg(trim(question), ' | ') OVER (PARTITION BY conv_id ORDER BY turn_idx DESC "
    "ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS input FROM turns LEFT JOIN sch s USING (db_id)", _SCHEMA_SQL))
def d06(spark, d):
    h = dg.utterance_history(_flat(spark, d)).withColumn("db_id", F.lit("star"))
    return dg.model_input(h, _schema(spark, d))


_NORM_SQL = ("replace(regexp_replace(trim(array_to_string(list_transform(regexp_extract_all(query, "
             "'[\"'']?\\w+[\"'']?|[^\\w]', 0), lambda p: CASE WHEN regexp_matches(p, '^[\"'']|[\"'']$') THEN p ELSE lower(p) END), '')), "
             "'\\s+', ' ', 'g'), ' , ', ', ')")


@register("d07_target", tw(f"SELECT conv_id, turn_idx, db_id || ' | ' || {_NORM_SQL} AS target FROM turns"))
def d07(spark, d):
    return dg.target(turns(spark, d)).select("conv_id", "turn_idx", "target")


@register("t07_normalize_case", tw(f"SELECT conv_id, turn_idx, {_NORM_SQL} AS norm FROM turns"))
def t07(spark, d):
    return turns(spark, d).select("conv_id", "turn_idx", dg.normalize_case("query").alias("norm"))


@register("d08_strip_db_id", tw(
    f"SELECT conv_id, turn_idx, trim(regexp_replace(db_id || ' | ' || {_NORM_SQL}, '^[^|]*\\|', '')) AS stripped FROM turns"))
def d08(spark, d):
    t = dg.target(turns(spark, d))
    return t.select("conv_id", "turn_idx", dg.strip_db_id("target").alias("stripped"))


@register("d09_sql2text_pair", tw(
    "SELECT conv_id, turn_idx, lower(concat_ws(' | ', trim(goal), trim(question), trim(query), trim(schema))) AS context, "
    f"lower(target) AS target FROM ({_CTX})", _SCHEMA_SQL))
def d09(spark, d):
    return dg.sql2text_pair(dg.contexts(turns(spark, d), _schema(spark, d)))


@register("d10_stop_marker", tw(
    "SELECT conv_id, turn_idx, target LIKE '%<s>' AS is_last, CASE WHEN target LIKE '%<s>' "
    f"THEN trim(substr(target, 1, length(target) - 3)) ELSE target END AS target FROM ({_CTX})", _SCHEMA_SQL))
def d10(spark, d):
    c = dg.contexts(turns(spark, d), _schema(spark, d))
    return dg.stop_marker(c).select("conv_id", "turn_idx", "is_last", "target")


@register("t10_split_utterances", tw(
    "SELECT conv_id, turn_idx, CAST(len(list_filter(list_transform(regexp_split_to_array(question, '[/|]'), "
    f"lambda s: trim(s)), lambda s: s <> '')) AS BIGINT) AS n_parts FROM ({_CTX})", _SCHEMA_SQL))
def t10(spark, d):
    c = dg.contexts(turns(spark, d), _schema(spark, d))
    return c.select("conv_id", "turn_idx", F.size(dg.split_utterances("question")).cast("long").alias("n_parts"))


@register("d15_prefix_turns", tw(
    "SELECT conv_id, turn_idx, goal, string_agg(question, ' | ') OVER (PARTITION BY conv_id ORDER BY turn_idx "
    "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS utterances FROM turns"))
def d15(spark, d):
    t = turns(spark, d)
    w = Window.partitionBy("conv_id").orderBy("turn_idx")
    return t.select("conv_id", "turn_idx", "goal",
                    F.array_join(F.collect_list("question").over(w.rowsBetween(Window.unboundedPreceding, 0)), " | ")
                    .alias("utterances"))


@register("d16_chain_previous", tw(
    "SELECT conv_id, turn_idx, coalesce(lag(query) OVER (PARTITION BY conv_id ORDER BY turn_idx), 'none') AS prev_query FROM turns"))
def d16(spark, d):
    t = turns(spark, d)
    w = Window.partitionBy("conv_id").orderBy("turn_idx")
    return t.select("conv_id", "turn_idx", F.coalesce(F.lag("query").over(w), F.lit("none")).alias("prev_query"))


@register("d13_keep_rate", f"WITH {query_log_sql()} SELECT query_id, round(avg(CASE WHEN gold = pred THEN 1.0 ELSE 0.0 END) "
          "OVER (ORDER BY query_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS keep_rate FROM ql")
def d13(spark, d):
    ql = query_log(spark, Tables(spark, d).events)
    x = ql.select("query_id", F.when(F.col("gold") == F.col("pred"), 1).otherwise(0).alias("kept"))
    chunk = F.floor(F.col("query_id") / 4096)
    x = ordered.running_sum(x, chunk, [F.col("query_id")], F.col("kept"), "n_kept")
    x = ordered.global_ordinal(x, chunk, [F.col("query_id")], "n_seen")
    return x.select("query_id", F.round(F.col("n_kept") / F.col("n_seen"), 6).alias("keep_rate"))


@register("d14_shard", "SELECT event_id FROM events WHERE event_id % 4 = 1")
def d14(spark, d):
    e = Tables(spark, d).events
    return e.filter(F.pmod(F.col("event_id"), F.lit(4)) == 1).select("event_id")


@register("d18_duplicate_audit",
          "SELECT count(*) AS n, count(DISTINCT text) AS n_distinct, count(*) - count(DISTINCT text) AS n_duplicate FROM documents")
def d18(spark, d):
    doc = Tables(spark, d).documents
    return doc.agg(F.count("*").alias("n"), F.count_distinct("text").alias("n_distinct")) \
        .withColumn("n_duplicate", F.col("n") - F.col("n_distinct"))


@register("d19_take_first", "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 50")
def d19(spark, d):
    return Tables(spark, d).documents.select("doc_id", "lang").orderBy("doc_id").limit(50)


_NTOK_SQL = "CAST(len(list_filter(string_split_regex(text, '\\s+'), lambda s: s <> '')) AS BIGINT)"


def _ntok(c="text"):
    return F.size(F.filter(F.split(F.col(c), r"\s+"), lambda s: s != "")).cast("long")


@register("d20_prune_long", f"SELECT doc_id, {_NTOK_SQL} AS n_tok FROM documents WHERE {_NTOK_SQL} < 1000")
def d20(spark, d):
    doc = Tables(spark, d).documents.select("doc_id", _ntok().alias("n_tok"))
    return doc.filter(F.col("n_tok") < 1000)


@register("d21_length_report",
          f"SELECT lang, count(*) AS n, max({_NTOK_SQL}) AS max_tok, max(length(text)) AS max_chars FROM documents GROUP BY lang")
def d21(spark, d):
    doc = Tables(spark, d).documents
    return doc.groupBy("lang").agg(F.count("*").alias("n"), F.max(_ntok()).alias("max_tok"),
                                   F.max(F.length("text")).cast("long").alias("max_chars"))


@register("d23_batches",
          "SELECT conv_id, turn, CAST((row_number() OVER (ORDER BY md5('s:' || CAST(conv_id * 100000 + turn AS VARCHAR)), conv_id, turn) - 1) // 64 AS BIGINT) AS batch "
          "FROM conversations")
def d23(spark, d):
    c = Tables(spark, d).conversations.select("conv_id", "turn")
    key = F.md5(F.concat(F.lit("s:"), (F.col("conv_id") * 100000 + F.col("turn")).cast("string")))
    c = c.withColumn("_k", key)
    c = ordered.global_ordinal(c, F.conv(F.substring("_k", 1, 3), 16, 10).cast("long"),
                               [F.col("_k"), F.col("conv_id"), F.col("turn")], "rn")
    return c.select("conv_id", "turn", F.floor((F.col("rn") - 1) / 64).cast("long").alias("batch"))


@register("d24_keep", "SELECT conv_id, turn FROM conversations WHERE role = 'user' AND length(text) > 200")
def d24(spark, d):
    c = Tables(spark, d).conversations
    return c.filter((F.col("role") == "user") & (F.length("text") > 200)).select("conv_id", "turn")


@register("d28_best_so_far",
          "SELECT event_id, CASE WHEN value >= coalesce(max(value) OVER (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING "
          "AND 1 PRECEDING), value) THEN 1 ELSE 0 END AS best FROM events")
def d28(spark, d):
    e = Tables(spark, d).events.select("event_id", "ts", "value")
    chunk = F.floor(F.unix_timestamp("ts") / 86400)
    x = ordered.running_max(e, chunk, [F.col("ts"), F.col("event_id")], F.col("value"), "prev_max", inclusive=False)
    return x.select("event_id", F.when(F.col("value") >= F.coalesce("prev_max", "value"), 1).otherwise(0).alias("best"))


@register("d29_build_vocab",
          "SELECT token, CAST(row_number() OVER (ORDER BY conv_id, turn, pos) AS BIGINT) AS idx FROM ("
          "SELECT token, arg_min(conv_id, conv_id * 100000000 + turn * 100000 + pos) AS conv_id, "
          "arg_min(turn, conv_id * 100000000 + turn * 100000 + pos) AS turn, "
          "arg_min(pos, conv_id * 100000000 + turn * 100000 + pos) AS pos FROM ("
          "SELECT conv_id, turn, unnest(w) AS token, generate_subscripts(w, 1) AS pos FROM ("
          "SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z]+', 0) AS w FROM conversations WHERE role = 'user')) "
          "GROUP BY token)")
def d29(spark, d):
    c = Tables(spark, d).conversations.filter(F.col("role") == "user")
    x = c.select("conv_id", "turn", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0))
                 .alias("pos", "token"))
    first = x.groupBy("token").agg(F.min(F.struct("conv_id", "turn", "pos")).alias("f"))
    first = first.select("token", "f.conv_id", "f.turn", "f.pos")
    v = ordered.global_ordinal(first, F.floor(F.col("conv_id") / 64), [F.col("conv_id"), F.col("turn"), F.col("pos")], "idx")
    return v.select("token", "idx")
