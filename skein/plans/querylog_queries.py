"""Query-log family on the synthetic log QL: tokens (T*), scoring (E*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions.hashing import bucket
from skein.operators import score as sc
from skein.operators import tokens as tk
from skein.plans.catalog_queries import CAT_SQL
from skein.plans.querylog import conversation_queries, query_log, query_log_sql, with_ql
from skein.plans.registry import register
from skein.session import by_key, stored, Tables
from skein.sources.catalog import star_catalog

KEYS = ["query_id", "side"]


def _ql(spark, d):
    return query_log(spark, Tables(spark, d).events)


def _sides(ql):
    return ql.select("query_id", F.lit("gold").alias("side"), F.col("gold").alias("sql")).unionByName(
        ql.select("query_id", F.lit("pred").alias("side"), F.col("pred").alias("sql")))


# ---- SQL fragments of the oracle (tokenizer and token table) ----
_SQL_TOKS = r"""sides AS (
  SELECT query_id, 'gold' AS side, gold AS sql FROM ql UNION ALL SELECT query_id, 'pred', pred FROM ql),
norm AS (
  SELECT query_id, side, regexp_replace(replace(sql, '''', '"'), '([!<>])\s+=', '\1=', 'g') AS s FROM sides),
toks AS (
  SELECT query_id, side,
    CASE WHEN (length(s) - length(replace(s, '"', ''))) % 2 = 0 THEN
      list_transform(regexp_extract_all(s, '"[^"]*"|[!<>]=|[A-Za-z0-9_.#$]+|[^\s]', 0),
                     lambda t: CASE WHEN t LIKE '"%' THEN t ELSE lower(t) END) END AS toks
  FROM norm)"""

_CLAUSES = ", ".join(f"'{w}'" for w in tk.CLAUSE_WORDS)
_SQL_TT = f"""tt0 AS (
  SELECT query_id, side, unnest(toks) AS token, generate_subscripts(toks, 1) - 1 AS pos FROM toks WHERE toks IS NOT NULL),
tt1 AS (
  SELECT *, lag(token) OVER w AS prev_tok, lead(token) OVER w AS next_tok,
    sum(CASE WHEN token = '(' THEN 1 WHEN token = ')' THEN -1 ELSE 0 END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
      - CASE WHEN token = '(' THEN 1 ELSE 0 END AS depth
  FROM tt0 WINDOW w AS (PARTITION BY query_id, side ORDER BY pos)),
tt2 AS (
  SELECT *, (token = '(' AND coalesce(next_tok = 'select', false)) AS sub_open, token IN ('(', ')') AS is_paren FROM tt1),
tt3 AS (
  SELECT *, (token = ')' AND coalesce(lag(sub_open) OVER (PARTITION BY query_id, side, depth, is_paren ORDER BY pos), false)) AS sub_close
  FROM tt2),
tt4 AS (
  SELECT *, sum(CASE WHEN sub_open THEN 1 WHEN sub_close THEN -1 ELSE 0 END)
      OVER (PARTITION BY query_id, side ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
      - CASE WHEN sub_open THEN 1 ELSE 0 END AS sdepth
  FROM tt3),
tt5 AS (
  SELECT *, coalesce(last_value(CASE WHEN token = 'select' THEN pos END IGNORE NULLS)
      OVER (PARTITION BY query_id, side, sdepth ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -1) AS block
  FROM tt4),
tt AS (
  SELECT *, last_value(CASE WHEN token IN ({_CLAUSES}) THEN CASE WHEN token = 'join' THEN 'from' ELSE token END END IGNORE NULLS)
      OVER (PARTITION BY query_id, side, block ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS clause
  FROM tt5)"""


@register("ql_query_log", with_ql("SELECT query_id, shape, gold, pred FROM ql"))
def ql_query_log(spark, d):
    return _ql(spark, d)


@register("t01_tokenize", with_ql(
    "SELECT query_id, side, CAST(len(toks) AS BIGINT) AS n_tok, array_to_string(toks, ' ') AS toks, "
    "toks IS NULL AS tok_error FROM toks", _SQL_TOKS))
def t01(spark, d):
    x = tk.tokenize(_sides(_ql(spark, d)), "sql")
    return x.select(*KEYS, F.size("toks").cast("long").alias("n_tok"), F.array_join("toks", " ").alias("toks"),
                    F.col("toks").isNull().alias("tok_error")).withColumn(
        "n_tok", F.when(F.col("tok_error"), F.lit(None).cast("long")).otherwise(F.col("n_tok")))


@register("t11_segment", with_ql(
    "SELECT query_id, side, CAST(pos AS BIGINT) AS pos, token, CAST(depth AS BIGINT) AS depth, "
    "CAST(sdepth AS BIGINT) AS sdepth, CAST(block AS BIGINT) AS block, clause FROM tt", _SQL_TOKS, _SQL_TT))
def t11(spark, d):
    # each different text is segmented once; its tokens go to all its rows
    sides = _sides(_ql(spark, d))
    texts = sides.groupBy("sql").agg(F.min(F.struct("query_id", "side")).alias("k"))
    x = tk.tokenize(by_key(texts.select("sql", F.concat_ws(":", "k.query_id", "k.side").alias("k")), "k"), "sql").filter(F.col("toks").isNotNull())
    tt = tk.token_table(x.select("k", "sql", "toks"), ["k"])
    tt = sides.join(texts.select("sql", F.concat_ws(":", "k.query_id", "k.side").alias("k")), "sql").join(tt, "k")
    return tt.select(*KEYS, F.col("pos").cast("long"), "token", F.col("depth").cast("long"),
                     F.col("sdepth").cast("long"), F.col("block").cast("long"), "clause")


def _per_text(spark, d, analyse):
    """The rows that ``analyse`` makes of the log's different (gold, pred) texts, given to every query that has the texts.

    ``analyse`` takes (query_id, gold, pred) and returns rows with ``query_id``. Every text is analysed, in partitions of
    bounded size (see ``score.analyse``); the log itself only meets the results. The texts are stored once: the log is
    not made again for each use of them, and where they are few they are broadcast and the log's texts stay unshuffled. An id of several events goes in as
    often as it stands, so that its tokens meet each other, and its rows come back once.
    """
    ids = Tables(spark, d).events.groupBy("event_id").agg(F.count("*").alias("n_rows"))
    log = query_log(spark, ids, keep=["n_rows"])
    text = ["gold", "pred", "n_rows"]
    texts = stored(log.groupBy(*text).agg(F.min("query_id").alias("text_id")))
    rows = texts.select(F.col("text_id").alias("query_id"), "gold", "pred", F.explode(F.sequence(F.lit(1).cast("long"), "n_rows")).alias("copy")).drop("copy")
    found = analyse(rows)
    x = log.join(texts, text).select("query_id", "text_id").join(found.withColumnRenamed("query_id", "text_id"), "text_id")
    return x.select(*found.columns)


def _analysis(spark, d, read):
    """``read(unit table, stacked query rows)`` of the log."""
    cat = star_catalog(spark, d)
    return _per_text(spark, d, lambda ql: read(*sc.analyse(ql, "query_id", cat.columns)))


@register("t12_units")
def t12(spark, d):
    return _analysis(spark, d, lambda ut, _: sc.units(ut, "query_id").select(*KEYS, "block", "clause", "unit", "sig", "sig_left", "op", "conj"))


@register("e03_hardness")
def e03(spark, d):
    def read(ut, _):
        top = sc.blocks(ut, "query_id").filter((F.col("side") == "gold") & (F.col("sdepth") == 0) & (F.col("set_path") == ""))
        return top.select("query_id", sc.hardness_expr().alias("hardness"))
    return _analysis(spark, d, read)


@register("e04_keywords")
def e04(spark, d):
    def read(ut, _):
        top = sc.blocks(ut, "query_id").filter((F.col("sdepth") == 0) & (F.col("set_path") == ""))
        return top.select(*KEYS, F.array_join(sc.keyword_set(), " ").alias("keywords"))
    return _analysis(spark, d, read)


def _components(spark, d):
    cat = star_catalog(spark, d)
    rows = _per_text(spark, d, lambda ql: sc.score_rows(ql, "query_id", cat.columns, sc.fk_map(cat)))
    return sc.split_scores(rows, "query_id")


def _category(name):
    def fn(spark, d):
        _, pc = _components(spark, d)
        return pc.filter(F.col("category") == name).select("query_id", "label_total", "pred_total", "cnt", "f1")
    return fn


for _key, _cat in [("e05_match_select", "select"), ("e06_match_select_noagg", "select(no AGG)"),
                   ("e07_match_where", "where"), ("e08_match_where_noop", "where(no OP)"),
                   ("e09_match_group", "group(no Having)"), ("e10_match_group_having", "group"),
                   ("e11_match_order", "order"), ("e12_match_andor", "and/or"), ("e13_match_nested", "IUEN"),
                   ("e14_match_keywords", "keywords")]:
    register(_key)(_category(_cat))


@register("e15_all_or_nothing")
def e15(spark, d):
    _, pc = _components(spark, d)
    return pc.select("query_id", "category", "label_total", "pred_total", "cnt", "acc", "rec", "f1")


@register("e16_exact_match")
def e16(spark, d):
    pk, _ = _components(spark, d)
    return pk.select("query_id", "hardness", "exact")


@register("e17_score_report")
def e17(spark, d):
    cat = star_catalog(spark, d)
    return sc.score_report_dedup(_ql(spark, d), cat.columns, fks=sc.fk_map(cat))


@register("e18_empty_on_error")
def e18(spark, d):
    def read(ut, stacked):
        return sc.validity(ut, stacked, "query_id").groupBy("query_id").agg(
            F.max(F.when(F.col("side") == "gold", F.col("valid"))).alias("gold_valid"),
            F.max(F.when(F.col("side") == "pred", F.col("valid"))).alias("pred_valid"))
    return _analysis(spark, d, read)


@register("e24_string_em", with_ql(
    "SELECT query_id, CASE WHEN coalesce(g.toks = p.toks, false) THEN 1 ELSE 0 END AS string_em "
    "FROM (SELECT query_id, toks FROM toks WHERE side = 'gold') g JOIN (SELECT query_id, toks FROM toks WHERE side = 'pred') p "
    "USING (query_id)", _SQL_TOKS))
def e24(spark, d):
    return sc.string_em(_ql(spark, d))


# ------------------------------------------------------------ E1, E2, E23

_SQL_LIT = r'''(tt.token LIKE '"%' OR regexp_matches(tt.token, '^-?[0-9]+(\.[0-9]+)?$'))'''


@register("e01_mask_literals", with_ql(
    f"SELECT query_id, side, string_agg(CASE WHEN {_SQL_LIT} AND coalesce(clause, '') <> 'limit' THEN 'null' ELSE token END, ' ' ORDER BY pos) AS masked "
    "FROM tt GROUP BY query_id, side", _SQL_TOKS, _SQL_TT))
def e01(spark, d):
    """Literals of conditions become null at every depth; subqueries and LIMIT counts stay."""
    x = tk.tokenize(by_key(_sides(_ql(spark, d)), "query_id"), "sql").filter(F.col("toks").isNotNull())
    tt = tk.token_table(x, KEYS)
    t = F.when(tk.is_literal("token") & (F.coalesce("clause", F.lit("")) != "limit"), F.lit("null")).otherwise(F.col("token"))
    g = tt.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("pos", t.alias("t")))).alias("ts"))
    return g.select(*KEYS, F.array_join(F.transform("ts", lambda s: s["t"]), " ").alias("masked"))


_E02_SQL = f"""WITH RECURSIVE {query_log_sql()},
{_SQL_TOKS},
{_SQL_TT},
{CAT_SQL},
cls AS (
  SELECT node, min(label) AS rep FROM (
    WITH RECURSIVE e AS (SELECT column_id AS a, other_column_id AS b FROM lfks WHERE db_id = 'star' UNION SELECT other_column_id, column_id FROM lfks WHERE db_id = 'star'),
    r(node, label) AS (SELECT a, a FROM e UNION SELECT e.a, r.label FROM r JOIN e ON e.b = r.node) SELECT node, label FROM r) GROUP BY node),
cname AS (SELECT column_id, table_name, column_name, lower(table_name || '.' || column_name) AS name FROM lcat WHERE db_id = 'star'),
reps AS (SELECT x.name, y.name AS rep FROM cls JOIN cname x ON x.column_id = cls.node JOIN cname y ON y.column_id = cls.rep),
ft AS (SELECT DISTINCT query_id, side, block, token AS t FROM tt JOIN (SELECT DISTINCT table_name FROM cname) n ON n.table_name = tt.token
       WHERE clause = 'from' AND coalesce(prev_tok, '') <> 'as'),
al AS (SELECT query_id, side, next_tok AS a, arg_max(prev_tok, pos) AS t FROM tt WHERE token = 'as' AND clause = 'from' GROUP BY query_id, side, next_tok),
topb AS (SELECT query_id, side, min(pos) AS block FROM tt WHERE token = 'select' AND sdepth = 0 GROUP BY query_id, side),
hit AS (
  SELECT tt.query_id, tt.side, tt.pos, tt.sdepth, c.name FROM tt JOIN cname c ON c.column_name = tt.token
  JOIN ft ON ft.query_id = tt.query_id AND ft.side = tt.side AND ft.block = tt.block AND ft.t = c.table_name
  WHERE coalesce(tt.prev_tok, '') <> 'as'
  UNION ALL
  SELECT tt.query_id, tt.side, tt.pos, tt.sdepth, c.name FROM tt JOIN cname c ON c.column_name = split_part(tt.token, '.', 2)
  LEFT JOIN al ON al.query_id = tt.query_id AND al.side = tt.side AND al.a = split_part(tt.token, '.', 1)
  WHERE tt.token LIKE '%.%' AND tt.token NOT LIKE '"%' AND c.table_name = coalesce(al.t, split_part(tt.token, '.', 1)))
SELECT h.query_id, h.side, CAST(h.pos AS INTEGER) AS pos, h.name AS col, CASE WHEN h.sdepth = 0 AND r.rep IS NOT NULL AND ft.t IS NOT NULL THEN r.rep ELSE h.name END AS canonical
FROM hit h LEFT JOIN reps r ON r.name = h.name LEFT JOIN topb b ON b.query_id = h.query_id AND b.side = h.side
LEFT JOIN ft ON ft.query_id = h.query_id AND ft.side = h.side AND ft.block = b.block AND ft.t = split_part(h.name, '.', 1)"""


@register("e02_canonical_columns", _E02_SQL)
def e02(spark, d):
    """Every resolved column of the log with its representative, where its table stands in the top FROM."""
    cat = star_catalog(spark, d)

    def read(ql):
        ut, _ = sc.query_tokens(ql, "query_id", cat.columns)
        # norm drops separators and FROM words, so the column itself is put there before
        x = sc.canonical_columns(ut.filter(F.col("col_id").isNotNull() | (F.col("token") == "select")).withColumn("norm", F.col("col_id")), "query_id", sc.fk_map(cat))
        return x.filter(F.col("col_id").contains(".") & ~F.col("col_id").endswith("*")).select(*KEYS, F.col("pos").cast("int"), F.col("col_id").alias("col"), F.col("norm").alias("canonical"))
    return _per_text(spark, d, read)


@register("e23_partial_metric")
def e23(spark, d):
    """Metric over the turns of the conversations; a tenth of them is padding (turn -1) and is left out."""
    t = Tables(spark, d)
    cat = star_catalog(spark, d)
    link = conversation_queries(t.conversations, t.events)
    key = F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    rows = link.select("query_id", F.when(bucket("pad", key, 10) == 0, -1).otherwise(F.col("turn")).alias("turn_idx")).join(_ql(spark, d), "query_id")
    return sc.partial_metric(rows, cat.columns, fks=sc.fk_map(cat))
