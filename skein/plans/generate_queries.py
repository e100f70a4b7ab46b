"""Template statistics and generation (T16, G1-G7, G10, G12, G13, G17) on the query log."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions.hashing import bucket, sql_bucket
from skein.operators import catalog as co
from skein.operators import content as ct
from skein.operators import generate as gen
from skein.operators import rebuild as rb
from skein.operators import score as sc
from skein.plans.catalog_queries import CAT_SQL
from skein.plans.dialog_queries import turns
from skein.plans.querylog import conversation_queries, conversation_queries_sql, query_log, query_log_sql
from skein.plans.querylog_queries import _SQL_TOKS, _SQL_TT
from skein.plans.registry import register
from skein.session import Tables, by_key, cut_lineage, stored
from skein.sources.catalog import STAR_TABLE_ORDER, star_catalog, star_catalogs

KEYS = ["query_id", "side"]


def _text_templates(spark, d, texts):
    """``texts`` (query_id, gold, ...), each different gold query once, with their ``template``."""
    cat = star_catalog(spark, d)
    ut, _ = sc.query_tokens(texts, "query_id", cat.columns, sides=("gold",))
    nf = gen.no_from_tokens(ut, KEYS)
    return texts.join(gen.templatize(nf, KEYS, co.typed_columns(cat)).select("query_id", "template"), "query_id")


def gold_templates(spark, d):
    """(query_id, template) of every gold query of the log."""
    t = Tables(spark, d)
    ql = query_log(spark, t.events).select("query_id", "gold")
    # a log repeats its texts: each different one is analysed once
    texts = ql.groupBy("gold").agg(F.min("query_id").alias("query_id"))
    tpl = _text_templates(spark, d, texts)
    return cut_lineage(ql.join(tpl.select("gold", "template"), "gold").select("query_id", "template"))


def gold_template_stats(spark, d):
    """G3 over every gold query of the log: its different texts weigh as often as they occur, so no row of the log is stored.

    The log is made in as many tasks as a shuffle has, however few files the events lie in.
    """
    ids = Tables(spark, d).events.select("event_id")
    ids = ids.repartition(int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    texts = stored(query_log(spark, ids).groupBy("gold").agg(F.min("query_id").alias("query_id"), F.count("*").alias("n")))
    return gen.template_stats(_text_templates(spark, d, texts), "n")


_TPL_SQL = f"""{query_log_sql()},
{_SQL_TOKS},
{_SQL_TT},
{CAT_SQL},
starcols AS (
  SELECT l.table_name, l.column_name, CASE WHEN k.column_id IS NOT NULL THEN 'key' ELSE l.column_type END AS ctype
  FROM lcat l LEFT JOIN keycols k ON k.db_id = l.db_id AND k.column_id = l.column_id WHERE l.db_id = 'star'
  UNION ALL SELECT table_name, '*', '*' FROM dbt WHERE db_id = 'star'),
btab AS (
  SELECT query_id, side, block, arg_min(token, pos) AS first_table FROM tt
  WHERE clause = 'from' AND token IN (SELECT table_name FROM dbt WHERE db_id = 'star') AND coalesce(prev_tok, '') <> 'as'
  GROUP BY ALL),
nf AS (
  SELECT tt.query_id, tt.side, tt.pos,
    CASE WHEN tt.token = '*' AND coalesce(tt.prev_tok, '') IN ('(', ',', 'select', 'distinct') THEN b.first_table || '.*'
         WHEN c.column_name IS NOT NULL THEN lower(c.table_name || '.' || c.column_name)
         WHEN (tt.token LIKE '"%' OR regexp_matches(tt.token, '^-?[0-9]+(\\.[0-9]+)?$')) AND tt.clause = 'limit' THEN 'limit_value'
         WHEN tt.token LIKE '"%' OR regexp_matches(tt.token, '^-?[0-9]+(\\.[0-9]+)?$') THEN 'value'
         ELSE tt.token END AS ntok
  FROM tt LEFT JOIN btab b ON b.query_id = tt.query_id AND b.side = tt.side AND b.block = tt.block
  LEFT JOIN (SELECT table_name, column_name FROM lcat WHERE db_id = 'star') c
    ON c.column_name = CASE WHEN tt.token LIKE '%.%' AND NOT tt.token LIKE '"%' THEN split_part(tt.token, '.', 2) ELSE tt.token END
       AND tt.token NOT LIKE '"%'
  WHERE tt.side = 'gold' AND coalesce(tt.clause, '') NOT IN ('from', 'on')),
typed AS (
  SELECT nf.*, s.ctype FROM nf LEFT JOIN starcols s ON lower(s.table_name || '.' || s.column_name) = nf.ntok),
ranked AS (
  SELECT *, CASE WHEN ctype IS NOT NULL THEN dense_rank() OVER (PARTITION BY query_id, side, ctype ORDER BY fp) - 1 END AS idx
  FROM (SELECT *, CASE WHEN ctype IS NOT NULL THEN min(pos) OVER (PARTITION BY query_id, side, ntok) END AS fp FROM typed)),
tpl AS (
  SELECT query_id, string_agg(CASE WHEN ctype IS NOT NULL THEN ctype || '_col_' || CAST(idx AS VARCHAR) ELSE ntok END, ' '
                              ORDER BY pos) AS template
  FROM ranked GROUP BY query_id),
stats AS (
  SELECT template, count(*) AS n, count(*) / sum(count(*)) OVER () AS p FROM tpl GROUP BY template)"""


def gw(body: str, *extra: str) -> str:
    more = "".join(",\n" + e for e in extra)
    return f"WITH RECURSIVE {_TPL_SQL}{more}\n{body}"


@register("t16_canonical_no_from", gw("SELECT query_id, string_agg(ntok, ' ' ORDER BY pos) AS no_from FROM nf GROUP BY query_id"))
def t16(spark, d):
    t = Tables(spark, d)
    ql = query_log(spark, t.events)
    cat = star_catalog(spark, d)
    ut, _ = sc.query_tokens(ql.select("query_id", "gold"), "query_id", cat.columns, sides=("gold",))
    nf = gen.no_from_tokens(ut, KEYS)
    g = nf.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", "ntok"))).alias("ts"))
    return g.select("query_id", F.array_join(F.transform("ts", lambda s: s["ntok"]), " ").alias("no_from"))


@register("g01_templatize", gw("SELECT query_id, template FROM tpl"))
def g01(spark, d):
    return gold_templates(spark, d)


@register("g02_templatize_coarse", gw(f"""SELECT query_id, replace(array_to_string(list_transform(toks, lambda t: CASE WHEN list_contains(gens, t) THEN 'gen_col_' || CAST(list_position(gens, t) - 1 AS VARCHAR)
  WHEN t IN ({", ".join(f"'{x}'" for x in gen.COARSE_AGG)}) THEN 'agg' WHEN t IN ('asc', 'desc') THEN 'order' WHEN t IN ({", ".join(f"'{x}'" for x in gen.COARSE_OP)}) THEN 'op' ELSE t END), ' '), ' op op ', ' op ') AS template
FROM (SELECT query_id, toks, list_sort(list_distinct(list_filter(toks, lambda t: contains(t, '_col_') AND NOT contains(t, 'key') AND NOT contains(t, '*')))) AS gens
      FROM (SELECT query_id, string_split(template, ' ') AS toks FROM tpl))"""))
def g02(spark, d):
    return gen.templatize_coarse(gold_templates(spark, d), ["query_id"])


@register("g03_template_stats", gw("SELECT template, n, round(p, 9) AS p FROM stats"))
def g03(spark, d):
    return gen.template_stats(gold_templates(spark, d)).withColumn("p", F.round("p", 9))


@register("g04_transition_stats", gw(
    "SELECT prev, curr, n, round(p_prev, 9) AS p_prev, round(p_curr_given_prev, 9) AS p_curr_given_prev FROM ("
    "SELECT prev, curr, n, sum(n) OVER (PARTITION BY prev) / sum(n) OVER () AS p_prev, n / sum(n) OVER (PARTITION BY prev) "
    "AS p_curr_given_prev FROM (SELECT prev, curr, count(*) AS n FROM ("
    "SELECT coalesce(lag(t.template) OVER (PARTITION BY u.conv_id ORDER BY u.turn), 'none') AS prev, t.template AS curr "
    "FROM (SELECT c.conv_id, c.turn, cq.query_id FROM conversations c JOIN cq USING (conv_id, turn) WHERE c.role = 'user') u "
    "JOIN tpl t ON t.query_id = u.query_id) GROUP BY ALL))", conversation_queries_sql()))
def g04(spark, d):
    tpl = gold_templates(spark, d)
    tt = turns(spark, d).select("conv_id", "turn", "turn_idx")
    cq = __import__("skein.plans.querylog", fromlist=["x"]).conversation_queries(
        Tables(spark, d).conversations, Tables(spark, d).events)
    x = tt.join(cq, ["conv_id", "turn"]).join(tpl, "query_id").select("conv_id", "turn_idx", "template")
    s = gen.transition_stats(x)
    return s.select("prev", "curr", "n", F.round("p_prev", 9).alias("p_prev"),
                    F.round("p_curr_given_prev", 9).alias("p_curr_given_prev"))


_SUPPORT_SQL = """typed_all AS (
  SELECT l.db_id, CASE WHEN k.column_id IS NOT NULL THEN 'key' ELSE l.column_type END AS slot_type
  FROM lcat l LEFT JOIN keycols k ON k.db_id = l.db_id AND k.column_id = l.column_id
  UNION ALL SELECT db_id, '*' FROM dbt),
nslot AS (SELECT db_id, slot_type, count(*) AS n FROM typed_all GROUP BY ALL),
support AS (SELECT db_id, slot_type || '_col_' || CAST(i AS VARCHAR) AS slot FROM nslot, range(0, n) AS r(i)),
need AS (SELECT template, unnest(list_distinct(list_filter(string_split(template, ' '), lambda t: t LIKE '%\\_col\\_%' ESCAPE '\\'))) AS slot
         FROM stats),
supp AS (
  SELECT template, db_id FROM (SELECT n.template, s.db_id, count(*) AS have FROM need n JOIN support s USING (slot) GROUP BY ALL) h
  JOIN (SELECT template, count(*) AS need FROM need GROUP BY ALL) q USING (template) WHERE have = need)"""


def _support(spark, d):
    return co.slot_support(star_catalogs(spark, d))


@register("g06_supported", gw("SELECT template, db_id FROM supp", _SUPPORT_SQL))
def g06(spark, d):
    return gen.supported(gen.template_stats(gold_templates(spark, d)), _support(spark, d))


_G7_SQL = """cum AS (SELECT template, n, sum(n) OVER (ORDER BY template ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hi_n,
                   sum(n) OVER () AS total FROM stats),
seeds AS (SELECT event_id AS seed, ('0x' || substr(md5('g7:' || CAST(event_id AS VARCHAR)), 1, 8))::BIGINT AS h FROM events),
dbs AS (SELECT template, list_sort(list(db_id)) AS dbs FROM supp GROUP BY template),
draws AS (
  SELECT s.seed, c.template, d.dbs[1 + ((('0x' || substr(md5('g7db:' || CAST(s.seed AS VARCHAR)), 1, 8))::BIGINT) % len(d.dbs))] AS db_id,
         len(d.dbs) AS n_supported
  FROM seeds s JOIN cum c ON s.h * c.total >= (c.hi_n - c.n) * 4294967296 AND s.h * c.total < c.hi_n * 4294967296
  JOIN dbs d ON d.template = c.template)"""


def _draws(spark, d):
    stats = stored(gold_template_stats(spark, d))
    supp = stored(gen.supported(stats, _support(spark, d)))
    return gen.sample_template_first(by_key(_seeds(spark, d), "seed"), stats, supp)


@register("g07_sample_template_first", gw("SELECT seed, template, db_id, CAST(n_supported AS INTEGER) AS n_supported FROM draws",
                                          _SUPPORT_SQL, _G7_SQL))
def g07(spark, d):
    return _draws(spark, d).withColumn("n_supported", F.col("n_supported").cast("int"))


_G10_SQL = """tcols AS (
  SELECT l.db_id, lower(l.table_name || '.' || l.column_name) AS col, CASE WHEN k.column_id IS NOT NULL THEN 'key' ELSE l.column_type END AS ctype
  FROM lcat l LEFT JOIN keycols k ON k.db_id = l.db_id AND k.column_id = l.column_id
  UNION ALL SELECT db_id, lower(table_name) || '.*', '*' FROM dbt),
assign AS (
  SELECT d.seed, c.ctype || '_col_' || CAST(row_number() OVER (PARTITION BY d.seed, c.ctype
           ORDER BY md5('g10:' || CAST(d.seed AS VARCHAR) || '|' || c.col), c.col) - 1 AS VARCHAR) AS slot, c.col
  FROM draws d JOIN tcols c ON c.db_id = d.db_id)"""


@register("g10_assign_columns", gw("SELECT seed, slot, col FROM assign", _SUPPORT_SQL, _G7_SQL, _G10_SQL))
def g10(spark, d):
    draws = _draws(spark, d)
    return gen.assign_columns(draws, co.typed_columns(star_catalogs(spark, d))).select("seed", "slot", "col")


@register("g12_count_literal",
          "SELECT event_id AS seed, CAST(1 + ((('0x' || substr(md5('g12:' || CAST(event_id AS VARCHAR)), 1, 8))::BIGINT) % 9) "
          "AS VARCHAR) AS literal FROM events")
def g12(spark, d):
    return Tables(spark, d).events.select(F.col("event_id").alias("seed")).select("seed", gen.count_literal().alias("literal"))


# ------------------------------------------------ G8, G9, G11, G13, G14, G16, G17

_G8_SQL = """alldb AS (SELECT list_sort(list(DISTINCT db_id)) AS dbs FROM supp),
s8 AS (SELECT event_id AS seed, ('0x' || substr(md5('g8:' || CAST(event_id AS VARCHAR)), 1, 8))::BIGINT AS h,
  dbs[1 + ((('0x' || substr(md5('g8db:' || CAST(event_id AS VARCHAR)), 1, 8))::BIGINT) % len(dbs))] AS db_id FROM events, alldb),
c8 AS (SELECT s.db_id, s.template, st.n, sum(st.n) OVER (PARTITION BY s.db_id ORDER BY s.template ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hi_n,
  sum(st.n) OVER (PARTITION BY s.db_id) AS total FROM supp s JOIN stats st USING (template))"""


@register("g08_sample_db_first", gw("SELECT seed, db_id, template FROM s8 JOIN c8 USING (db_id) "
                                    "WHERE h * total >= (hi_n - n) * 4294967296 AND h * total < hi_n * 4294967296", _SUPPORT_SQL, _G8_SQL))
def g08(spark, d):
    stats = cut_lineage(gen.template_stats(gold_templates(spark, d)))
    return gen.sample_db_first(_seeds(spark, d), stats, cut_lineage(gen.supported(stats, _support(spark, d))))


def _seeds(spark, d):
    return Tables(spark, d).events.select(F.col("event_id").alias("seed"))


def _transitions(spark, d, tpl):
    t = Tables(spark, d)
    cq = conversation_queries(t.conversations, t.events)
    x = turns(spark, d).select("conv_id", "turn", "turn_idx").join(cq, ["conv_id", "turn"]).join(tpl, "query_id")
    return gen.transition_stats(x.select("conv_id", "turn_idx", "template"))


_G9_SQL = """pairs AS (SELECT prev, curr, count(*) AS n FROM (
  SELECT coalesce(lag(t.template) OVER (PARTITION BY u.conv_id ORDER BY u.turn), 'none') AS prev, t.template AS curr
  FROM (SELECT c.conv_id, c.turn, cq.query_id FROM conversations c JOIN cq USING (conv_id, turn) WHERE c.role = 'user') u JOIN tpl t ON t.query_id = u.query_id) GROUP BY ALL),
pp AS (SELECT prev, n, sum(n) OVER (ORDER BY prev ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hi_n, sum(n) OVER () AS total
       FROM (SELECT prev, sum(n) AS n FROM pairs GROUP BY prev)),
pc AS (SELECT prev, curr, n, sum(n) OVER (PARTITION BY prev ORDER BY curr ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hi_n, sum(n) OVER (PARTITION BY prev) AS total FROM pairs),
s9 AS (SELECT event_id AS seed, ('0x' || substr(md5('g9p:' || CAST(event_id AS VARCHAR)), 1, 8))::BIGINT AS hp, ('0x' || substr(md5('g9c:' || CAST(event_id AS VARCHAR)), 1, 8))::BIGINT AS hc FROM events),
d9 AS (SELECT template, list_sort(list(db_id)) AS dbs FROM supp GROUP BY template),
drawn AS (
  SELECT s.seed, pp.prev, pc.curr, CASE WHEN pp.prev = 'none' THEN c.dbs ELSE list_filter(c.dbs, lambda x: list_contains(coalesce(p.dbs, []), x)) END AS dbs
  FROM s9 s JOIN pp ON s.hp * pp.total >= (pp.hi_n - pp.n) * 4294967296 AND s.hp * pp.total < pp.hi_n * 4294967296
  JOIN pc ON pc.prev = pp.prev AND s.hc * pc.total >= (pc.hi_n - pc.n) * 4294967296 AND s.hc * pc.total < pc.hi_n * 4294967296
  JOIN d9 c ON c.template = pc.curr LEFT JOIN d9 p ON p.template = pp.prev)"""


@register("g09_sample_pairs", gw(
    "SELECT seed, prev, curr, dbs[1 + ((('0x' || substr(md5('g9db:' || CAST(seed AS VARCHAR)), 1, 8))::BIGINT) % len(dbs))] AS db_id, "
    "CAST(len(dbs) AS INTEGER) AS n_supported FROM drawn WHERE len(dbs) > 0", conversation_queries_sql(), _SUPPORT_SQL, _G9_SQL))
def g09(spark, d):
    tpl = gold_templates(spark, d)
    stats = cut_lineage(gen.template_stats(tpl))
    supp = cut_lineage(gen.supported(stats, _support(spark, d)))
    return gen.sample_pairs(_seeds(spark, d), cut_lineage(_transitions(spark, d, tpl)), supp)


def _content(spark, d):
    """Index over the content of every column of the star tables; a caller that reads the index more than once stores it."""
    t = Tables(spark, d)
    return ct.content_index(stored(ct.literals({n: getattr(t, n) for n in STAR_TABLE_ORDER})))


_LITERALS_SQL = "lits AS (SELECT col, literal, count(*) AS n FROM (\n" + " UNION ALL\n".join(
    f"SELECT '{n}.' || lower(name) AS col, split_part(value, '.', 1) AS literal FROM (UNPIVOT (SELECT COLUMNS(*)::VARCHAR FROM {n}) ON COLUMNS(*) INTO NAME name VALUE value)"
    for n in STAR_TABLE_ORDER) + """) WHERE literal <> '' GROUP BY ALL),
cont AS (SELECT col, literal, n, sum(n) OVER (PARTITION BY col ORDER BY substr(md5(literal), 1, 2), literal ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hi,
                sum(n) OVER (PARTITION BY col) AS total FROM lits),
tot AS (SELECT DISTINCT col, total FROM cont)"""


@register("g11_sample_value", f"""WITH {CAT_SQL}, {_LITERALS_SQL},
names AS (SELECT list(lower(table_name || '.' || column_name) ORDER BY column_id) AS names FROM lcat WHERE db_id = 'star'),
ty AS (SELECT lower(l.table_name || '.' || l.column_name) AS col, CASE WHEN k.column_id IS NOT NULL THEN 'key' ELSE l.column_type END AS ctype
       FROM lcat l LEFT JOIN keycols k ON k.db_id = l.db_id AND k.column_id = l.column_id WHERE l.db_id = 'star'),
d AS (SELECT event_id AS seed, names[CAST({sql_bucket('g11col', 'event_id', 'len(names)')} + 1 AS BIGINT)] AS col FROM events, names),
k AS (SELECT d.*, {sql_bucket('g11', 'd.seed', 'total')} AS k FROM d JOIN tot USING (col))
SELECT k.seed, k.col, CASE WHEN ty.ctype = 'number' THEN c.literal ELSE '''' || c.literal || '''' END AS literal
FROM k JOIN cont c ON c.col = k.col AND k.k >= c.hi - c.n AND k.k < c.hi JOIN ty ON ty.col = k.col""")
def g11(spark, d):
    """One literal for every seed, from a column drawn evenly among all of the star tables."""
    cat = star_catalog(spark, d)
    names = [f"{t}.{f.name}".lower() for t in STAR_TABLE_ORDER for f in getattr(Tables(spark, d), t).schema.fields]
    col = F.element_at(F.array(*[F.lit(n) for n in names]), (bucket("g11col", "seed", len(names)) + 1).cast("int"))
    index, sizes = _content(spark, d)
    x = ct.sample_values(_seeds(spark, d).withColumn("col", col), index, sizes, "seed")
    ty = co.typed_columns(cat).select(F.lower(F.concat_ws(".", "table_name", "column_name")).alias("col"), F.col("slot_type").alias("ctype"))
    return x.join(ty, "col").select("seed", "col", ct.quoted(F.col("literal"), F.col("ctype"), F.lit(None).cast("string")).alias("literal"))


def _typed(spark, d):
    """Typed columns of all databases; rows of ``*`` carry the table's first column."""
    cat = star_catalogs(spark, d)
    first = cat.columns.filter("column_id > 0").groupBy("db_id", "table_name").agg(F.min_by("column_name", "column_id").alias("first_column"))
    return co.typed_columns(cat).join(first, ["db_id", "table_name"], "left").withColumn("first_column", F.when(F.col("column_name") == "*", F.col("first_column")))


def _mapped(spark, d, draws=None):
    draws = _draws(spark, d) if draws is None else draws
    # assigning columns costs far more than the bytes of a draw tell the planner, which would give it to few tasks
    return gen.map_columns(by_key(draws, "seed"), co.typed_columns(star_catalogs(spark, d)))


_G13_SQL = f"""{_LITERALS_SQL},
mtok AS (
  SELECT seed, db_id, i - 1 AS i, t, CASE WHEN t LIKE '%\\_col\\_%' ESCAPE '\\' THEN regexp_extract(t, '^(.*)_col_', 1) END AS ctype
  FROM (SELECT seed, db_id, unnest(string_split(template, ' ')) AS t, generate_subscripts(string_split(template, ' '), 1) AS i FROM draws)),
mcol AS (SELECT m.*, a.col, coalesce(a.col, m.t) AS w FROM mtok m LEFT JOIN assign a ON a.seed = m.seed AND a.slot = m.t),
mop AS (SELECT *, CASE WHEN col IS NOT NULL THEN struct_pack(col := col, ctype := ctype, op := CASE WHEN lag(w) OVER s = '(' THEN lag(w, 2) OVER s END) END AS gov
        FROM mcol WINDOW s AS (PARTITION BY seed ORDER BY i)),
mlast AS (SELECT *, last_value(gov IGNORE NULLS) OVER (PARTITION BY seed ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM mop),
firstcol AS (SELECT lower(table_name) || '.*' AS star, lower(table_name || '.' || arg_min(column_name, column_id)) AS of FROM lcat WHERE db_id = 'star' GROUP BY table_name),
mval AS (SELECT m.seed, m.i, m.g.ctype AS ctype, m.g.op AS op, coalesce(f.of, m.g.col) AS col, CAST(m.seed AS VARCHAR) || ':' || CAST(m.i AS VARCHAR) AS key
         FROM mlast m LEFT JOIN firstcol f ON f.star = m.g.col WHERE m.t = 'value'),
val AS (
  SELECT seed, i, CAST(1 + {sql_bucket('g13c', 'key', 9)} AS VARCHAR) AS v FROM mval WHERE op = 'count'
  UNION ALL
  SELECT m.seed, m.i, CASE WHEN m.ctype IN ('id', 'number') OR coalesce(m.op, '') IN ('max', 'min', 'avg', 'sum') THEN c.literal ELSE '''' || c.literal || '''' END
  FROM (SELECT mval.*, {sql_bucket('g13', 'key', 'total')} AS k FROM mval JOIN tot USING (col) WHERE coalesce(op, '') <> 'count') m
  JOIN cont c ON c.col = m.col AND m.k >= c.hi - c.n AND m.k < c.hi)"""


@register("g13_fill_template", gw("""SELECT m.seed, m.db_id, string_agg(CASE WHEN m.t = 'value' THEN val.v WHEN m.t = 'limit_value' THEN '1' ELSE m.w END, ' ' ORDER BY m.i) AS filled
FROM mlast m LEFT JOIN val ON val.seed = m.seed AND val.i = m.i GROUP BY m.seed, m.db_id HAVING count(*) FILTER (m.t = 'value') = count(val.v)""",
                                  _SUPPORT_SQL, _G7_SQL, _G10_SQL, _G13_SQL))
def g13(spark, d):
    index, sizes = _content(spark, d)
    return ct.fill_template(_mapped(spark, d), _typed(spark, d), index, sizes).select("seed", "db_id", "filled")


def _case(choices, draw):
    upto, parts = 0, []
    for what, share in choices:
        upto += share
        parts.append(f"WHEN {draw} < {upto} THEN '{what}'")
    return f"CASE {' '.join(parts)} END"


_DRAW = "(('0x' || substr(md5('g14:' || CAST(seed AS VARCHAR) || ':' || CAST(i AS VARCHAR)), 1, 8))::BIGINT) % 1000"
_G14_SQL = f"""mtok AS (
  SELECT seed, db_id, i - 1 AS i, t FROM (SELECT seed, db_id, unnest(string_split(template, ' ')) AS t, generate_subscripts(string_split(template, ' '), 1) AS i FROM draws)),
mcol AS (SELECT m.seed, m.db_id, m.i, a.col, CASE WHEN a.col IS NULL THEN NULL WHEN regexp_extract(m.t, '^(.*)_col_', 1) IN ('number', 'time', '*') AND a.col LIKE '%phone%' THEN 'phone'
           ELSE regexp_extract(m.t, '^(.*)_col_', 1) END AS ctype,
         CASE WHEN a.col IS NOT NULL THEN a.col WHEN m.t IN ({", ".join(f"'{x}'" for x in gen.COARSE_AGG)}) THEN 'agg' WHEN m.t IN ('asc', 'desc') THEN 'order'
              WHEN m.t IN ({", ".join(f"'{x}'" for x in gen.COARSE_OP)}) THEN 'op' ELSE m.t END AS w
         FROM mtok m LEFT JOIN assign a ON a.seed = m.seed AND a.slot = m.t),
mnear AS (SELECT *, last_value(ctype IGNORE NULLS) OVER (PARTITION BY seed ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lastt,
          first_value(ctype IGNORE NULLS) OVER (PARTITION BY seed ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nextt,
          lead(w) OVER (PARTITION BY seed ORDER BY i) AS after FROM mcol),
mout AS (SELECT seed, db_id, i, CASE
  WHEN w = 'op' THEN CASE {" ".join(f"WHEN lastt = '{t}' THEN {_case(c, _DRAW)}" for t, c in ct.OP_CHOICES.items())} END
  WHEN w = 'order' AND coalesce(after, '') <> 'by' THEN {_case(ct.ORDER_CHOICES, _DRAW)}
  WHEN w = 'agg' THEN CASE {" ".join(f"WHEN nextt = '{t}' THEN {_case(c, _DRAW)}" for t, c in (ct.AGG_CHOICES | {"phone": ct.AGG_CHOICES["number"]}).items())} END ELSE w END AS o FROM mnear)"""


@register("g14_detemplatize", gw("SELECT seed, db_id, string_agg(o, ' ' ORDER BY i) AS mapped FROM mout GROUP BY seed, db_id HAVING count(*) = count(o)", _SUPPORT_SQL, _G7_SQL, _G10_SQL, _G14_SQL))
def g14(spark, d):
    """Coarse, column-mapped templates with comparisons, directions and aggregates chosen anew by type."""
    return ct.detemplatize(gen.coarse_tokens(_mapped(spark, d)), co.typed_columns(star_catalogs(spark, d)))


def goals(spark, d, draws, content=None):
    """(seed, db_id, sql): filled templates with FROM clauses and the drawn literals in place."""
    index, sizes = content or _content(spark, d)
    filled = ct.fill_template(_mapped(spark, d, draws), _typed(spark, d), index, sizes)
    cat = star_catalogs(spark, d)
    # slots go through the rebuild under a mark of their own: literals may hold blanks, and a column may be called value
    no_from = F.expr(f"array_join(transform(split(mapped, ' '), t -> case when t = 'value' then '{ct.SLOT}' when t = 'limit_value' then '1' else t end), ' ')")
    filled = stored(filled.select("seed", "db_id", no_from.alias("no_from"), "literals"))
    # draws repeat their texts, apart from the literals: each different one is rebuilt once
    texts = stored(filled.select("db_id", "no_from").distinct().withColumn("text_id", F.monotonically_increasing_id()))
    sql = stored(texts.join(rb.rebuild_from(by_key(texts, "text_id"), "text_id", "no_from", rb.fk_paths(cat)), "text_id").select("db_id", "no_from", "sql"))
    return ct.place_literals(filled.join(sql, ["db_id", "no_from"])).select("seed", "db_id", "sql")


@register("g17_goals")
def g17(spark, d):
    return goals(spark, d, _draws(spark, d)).select(F.col("seed").alias("goal_id"), "db_id", "sql")


@register("g16_top_up")
def g16(spark, d):
    """A tenth as many goals as there are events: drawn, filled and rebuilt until enough have at most four tables."""
    n = max(1, Tables(spark, d).events.count() // 10)
    stats = cut_lineage(gen.template_stats(gold_templates(spark, d)))
    supp = cut_lineage(gen.supported(stats, _support(spark, d)))
    index, sizes = _content(spark, d)
    content = stored(index), sizes

    def make(lo, hi):
        draws = cut_lineage(gen.sample_template_first(spark.range(lo, hi).select(F.col("id").alias("seed")), stats, supp))
        return goals(spark, d, draws, content).filter(~F.col("sql").contains(" as T5"))

    return gen.top_up(make, n).select(F.col("seed").alias("goal_id"), "db_id", "sql")


# --------------------------------------------------------------------- G5
# score of a gold query = string exact match of its pair (E24); softmax shifted by the largest weight
# (same probabilities, no overflow when counts grow)

@register("g05_error_weights", gw("""SELECT template, n, round(acc, 6) AS acc, round(w, 6) AS weight,
  round(e / sum(e) OVER (), 9) AS p, example
FROM (SELECT *, exp((w - max(w) OVER ()) / 20.0) AS e FROM (SELECT *, n * (1 - acc) AS w FROM ts WHERE acc < 0.98))""", """em AS (
  SELECT query_id, CASE WHEN coalesce(g.toks = p.toks, false) THEN 1 ELSE 0 END AS string_em
  FROM (SELECT query_id, toks FROM toks WHERE side = 'gold') g JOIN (SELECT query_id, toks FROM toks WHERE side = 'pred') p
  USING (query_id)),
ts AS (
  SELECT t.template, count(*) AS n, avg(em.string_em) AS acc, arg_max(ql.gold, t.query_id) AS example
  FROM tpl t JOIN em USING (query_id) JOIN ql USING (query_id) GROUP BY t.template HAVING count(*) > 2)"""))
def g05(spark, d):
    ql = query_log(spark, Tables(spark, d).events)
    x = gold_templates(spark, d).join(sc.string_em(ql), "query_id").join(ql.select("query_id", "gold"), "query_id")
    return gen.error_weights(x, "template", "string_em", "gold", "query_id")
