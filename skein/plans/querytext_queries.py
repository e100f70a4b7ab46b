"""Query-text rewrites (T2-T6, T8, T14, T18-T20) on both sides of the query log QL."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import querytext as qt
from skein.operators import tokens as tk
from skein.plans.querylog import with_ql
from skein.plans.querylog_queries import _SQL_TOKS, KEYS, _ql, _sides
from skein.plans.registry import register
from skein.session import by_key
from skein.sources.catalog import STAR_TABLE_ORDER, star_catalog

_FLOAT = qt.FLOAT_PATTERN.replace("'", "''")
_TABLES = ", ".join(f"'{t}'" for t in STAR_TABLE_ORDER)


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _replace_sql(expr: str, rules) -> str:
    for a, b in rules:
        expr = f"replace({expr}, {_lit(a)}, {_lit(b)})"
    return expr


def _toks(spark, d):
    """T1 tokens of both sides, valid rows only, hash-partitioned by query."""
    return tk.tokenize(by_key(_sides(_ql(spark, d)), "query_id"), "sql").filter(F.col("toks").isNotNull())


# --------------------------------------------------------------------- T2

def _mask_sql(dialect: str) -> str:
    s = "replace(regexp_replace(sql, ';+$', ''), '\"', '''')"
    if dialect == "cosql":
        s = _replace_sql(s, qt.COSQL_REPAIRS)
    s = _replace_sql(s, [(ch, f" {ch} ") for ch in qt.MASK_DELIMS[dialect]])
    split = f"""sp AS (
  SELECT query_id, side, flatten(list_transform(list_filter(string_split_regex({s}, '\\s+'), lambda t: t <> ''),
    lambda t: CASE WHEN suffix(t, '''') THEN [regexp_replace(t, '''+$', ''), '''']
                   WHEN contains(t, '.') AND starts_with(lower(t), 't') AND len(string_split(t, '.')) = 2
                     THEN [split_part(t, '.', 1), '.', split_part(t, '.', 2)]
                   ELSE [t] END)) AS toks
  FROM sides),
mt AS (SELECT query_id, side, unnest(toks) AS t, generate_subscripts(toks, 1) AS pos FROM sp)"""
    plain = f"CASE WHEN regexp_matches(t, '{_FLOAT}') THEN 'value' ELSE lower(t) END"
    if dialect == "cosql":
        # a quote token toggles the string state; any other token opening with a quote sets it
        state = f"""ms0 AS (
  SELECT *, sum(CASE WHEN t = '''' THEN 1 ELSE 0 END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
            - CASE WHEN t = '''' THEN 1 ELSE 0 END AS cq
  FROM mt WINDOW w AS (PARTITION BY query_id, side ORDER BY pos)),
ms1 AS (
  SELECT *, last_value(CASE WHEN starts_with(t, '''') AND t <> '''' THEN cq END IGNORE NULLS)
            OVER (PARTITION BY query_id, side ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cq_open
  FROM ms0),
ms AS (
  SELECT *, CASE WHEN cq_open IS NULL THEN cq % 2 = 1 ELSE (cq - cq_open) % 2 = 0 END AS ins FROM ms1),
me AS (
  SELECT query_id, side, pos, CASE WHEN starts_with(t, '''') AND NOT ins THEN NULL WHEN ins AND t = '''' THEN 'value'
                                   WHEN NOT ins THEN {plain} END AS e FROM ms)"""
    else:
        state = f"""ms AS (
  SELECT *, coalesce(last_value(CASE WHEN starts_with(t, '''') AND t <> '''' THEN true WHEN t = '''' THEN false END
            IGNORE NULLS) OVER (PARTITION BY query_id, side ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
            false) AS ins
  FROM mt),
me AS (
  SELECT query_id, side, pos, CASE WHEN starts_with(t, '''') AND t <> '''' THEN NULL WHEN ins AND t = '''' THEN 'value'
                                   WHEN NOT ins THEN {plain} END AS e FROM ms)"""
    body = ("SELECT sp.query_id, sp.side, array_to_string(sp.toks, ' ') AS toks, coalesce(m.masked, '') AS masked "
            "FROM sp LEFT JOIN (SELECT query_id, side, string_agg(e, ' ' ORDER BY pos) AS masked FROM me GROUP BY ALL) m "
            "USING (query_id, side)")
    sides = "sides AS (SELECT query_id, 'gold' AS side, gold AS sql FROM ql UNION ALL SELECT query_id, 'pred', pred FROM ql)"
    return with_ql(body, sides, split, state)


def _mask(dialect):
    def fn(spark, d):
        x = qt.mask_tokens(_sides(_ql(spark, d)), "sql", dialect)
        return x.select(*KEYS, F.array_join("toks", " ").alias("toks"), F.array_join("masked", " ").alias("masked"))
    return fn


register("t02_mask_tokens", _mask_sql("sparc"))(_mask("sparc"))
register("t02c_mask_tokens_conv", _mask_sql("cosql"))(_mask("cosql"))


# --------------------------------------------------------------------- T3

@register("t03_strip_values", with_ql(
    "SELECT query_id, side, array_to_string(list_transform(toks, lambda t: CASE WHEN regexp_matches(t, "
    f"'{_FLOAT}') OR (starts_with(t, '\"') AND suffix(t, '\"')) THEN 'value' ELSE lower(t) END), ' ') AS stripped "
    "FROM toks WHERE toks IS NOT NULL", _SQL_TOKS))
def t03(spark, d):
    return _toks(spark, d).select(*KEYS, F.array_join(qt.strip_values("toks"), " ").alias("stripped"))


# ----------------------------------------------------------------- T4, T5

_SQL_ALIAS = """a0 AS (
  SELECT query_id, side, toks, unnest(toks) AS token, generate_subscripts(toks, 1) AS pos FROM toks WHERE toks IS NOT NULL),
a1 AS (
  SELECT query_id, side, pos, toks[pos + 1] AS alias, CASE WHEN pos > 1 THEN toks[pos - 1] ELSE toks[-1] END AS table_name
  FROM a0 WHERE token = 'as'),
amap AS (
  SELECT query_id, side, alias, table_name FROM a1 WHERE alias IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY query_id, side, alias ORDER BY pos DESC) = 1)"""


@register("t04_alias_map", with_ql(
    f"SELECT query_id, side, alias, table_name, coalesce(alias IN ({_TABLES}), false) AS alias_is_table FROM amap",
    _SQL_TOKS, _SQL_ALIAS))
def t04(spark, d):
    names = star_catalog(spark, d).tables.select("table_name")
    return qt.alias_map(_toks(spark, d), KEYS, "toks", names)


_SQL_RESOLVE = f"""r1 AS (
  SELECT query_id, side, token AS t, pos, lag(token) OVER (PARTITION BY query_id, side ORDER BY pos) AS prev FROM a0),
rw AS (
  SELECT k.query_id, k.side, k.pos,
         CASE WHEN contains(k.t, '.') AND a.alias IS NOT NULL
              THEN a.table_name || '.' || substr(k.t, length(split_part(k.t, '.', 1)) + 2) ELSE k.t END AS t2
  FROM r1 k LEFT JOIN amap a ON a.query_id = k.query_id AND a.side = k.side AND a.alias = split_part(k.t, '.', 1)
  WHERE k.t <> 'as' AND (k.prev IS NULL OR k.prev <> 'as')),
res5 AS (
  SELECT query_id, side, {_replace_sql("string_agg(t2, ' ' ORDER BY pos)", qt.RESPACE_RULES)} AS resolved
  FROM rw GROUP BY query_id, side)"""


def _resolved(spark, d):
    return _toks(spark, d).select(*KEYS, qt.resolve_aliases("toks").alias("resolved"))


@register("t05_resolve_aliases", with_ql("SELECT query_id, side, resolved FROM res5", _SQL_TOKS, _SQL_ALIAS, _SQL_RESOLVE))
def t05(spark, d):
    return _resolved(spark, d)


# --------------------------------------------------------------------- T6

_SQL_SPLIT_DOTTED = r"""d1 AS (
  SELECT query_id, side,
    flatten(list_transform(toks, lambda t: CASE WHEN t <> '.' AND contains(t, '.')
      THEN list_filter(string_split_regex(replace(t, '.', ' . '), '\s+'), lambda p: p <> '') ELSE [t] END)) AS spl,
    len(list_filter(toks, lambda t: t <> '.' AND contains(t, '.'))) > 0 AS invalid
  FROM toks WHERE toks IS NOT NULL)"""


@register("t06_split_dotted", with_ql(r"""SELECT query_id, side, array_to_string(
  CASE WHEN from_at > 0 AND list_contains(spl[1:from_at - 1], '*') AND coalesce(n_all, 0) > coalesce(n_sel, 0)
       THEN list_transform(spl, lambda t, i: CASE WHEN i = star_at THEN least_alias || '.*' ELSE t END) ELSE spl END,
  ' ') AS toks, invalid
FROM d2 LEFT JOIN ag USING (query_id, side)""", _SQL_TOKS, _SQL_SPLIT_DOTTED, r"""d2 AS (
  SELECT *, coalesce(list_position(spl, 'from'), 0) AS from_at, coalesce(list_position(spl, '*'), 0) AS star_at FROM d1),
u AS (SELECT query_id, side, from_at, unnest(spl) AS t, generate_subscripts(spl, 1) AS pos FROM d2),
al AS (
  SELECT query_id, side, t, count(*) AS cnt, min(pos) AS first_pos, bool_or(from_at > 0 AND pos < from_at) AS in_sel
  FROM u WHERE regexp_matches(t, '^t\d+') GROUP BY ALL),
ag AS (
  SELECT query_id, side, count(*) AS n_all, count(*) FILTER (WHERE in_sel) AS n_sel,
         arg_min(t, cnt * 1000000 - first_pos) AS least_alias
  FROM al GROUP BY ALL)"""))
def t06(spark, d):
    x = _toks(spark, d).select(*KEYS, qt.split_dotted("toks").alias("s"))
    return x.select(*KEYS, F.array_join("s.toks", " ").alias("toks"), F.col("s.invalid").alias("invalid"))


# --------------------------------------------------------------------- T8

@register("t08_respace", with_ql(
    f"SELECT query_id, side, {_replace_sql('sql', qt.RESPACE_RULES)} AS respaced FROM sides", _SQL_TOKS))
def t08(spark, d):
    return _sides(_ql(spark, d)).select(*KEYS, qt.respace("sql").alias("respaced"))


# -------------------------------------------------------------------- T14
# post = T1 tokens with every literal replaced by the placeholder 1; values = the literals in order

_LITERAL_SQL = f"(starts_with(t, '\"') OR regexp_matches(t, '{tk.NUMBER_PATTERN}'))"
_PLACE = qt.PLACEHOLDER_PATTERN


@register("t14_fill_values", with_ql(f"""SELECT query_id, side, post,
  list_reduce(list_transform(vals, lambda v: replace(replace(v, ''' ', ''''), ' ''', '''')),
    lambda acc, v: CASE WHEN regexp_matches(acc, '{_PLACE}')
      THEN replace(substr(acc, 1, length(regexp_extract(acc, '^(?s)(.*?){_PLACE}', 1)))
                   || replace(regexp_extract(acc, '{_PLACE}', 0), '1', v)
                   || substr(acc, length(regexp_extract(acc, '^(?s)(.*?){_PLACE}', 1))
                                  + length(regexp_extract(acc, '{_PLACE}', 0)) + 1), '  ', ' ')
      ELSE acc END, post) AS filled
FROM (SELECT query_id, side,
        array_to_string(list_transform(toks, lambda t: CASE WHEN {_LITERAL_SQL} THEN '1' ELSE t END), ' ') AS post,
        list_filter(toks, lambda t: {_LITERAL_SQL}) AS vals
      FROM toks WHERE toks IS NOT NULL)""", _SQL_TOKS))
def t14(spark, d):
    x = _toks(spark, d)
    lit = lambda t: tk.is_literal(t)
    x = x.select(*KEYS, F.array_join(F.transform("toks", lambda t: F.when(lit(t), F.lit("1")).otherwise(t)), " ")
                 .alias("post"), F.filter("toks", lit).alias("vals"))
    return x.select(*KEYS, "post", qt.fill_values("post", "vals").alias("filled"))


# -------------------------------------------------------------------- T18

@register("t18_candidate_tables", with_ql(f"""SELECT query_id, side, array_to_string(tabs, ',') AS tables,
  len(list_filter(tabs, lambda t: t NOT IN ({_TABLES}))) = 0 AS all_known
FROM (SELECT query_id, side, list_sort(list_distinct(list_transform(
        list_filter(string_split_regex(resolved, '\\s+'), lambda t: contains(t, '.')),
        lambda t: split_part(t, '.', 1)))) AS tabs FROM res5)""", _SQL_TOKS, _SQL_ALIAS, _SQL_RESOLVE))
def t18(spark, d):
    names = [t.lower() for t in STAR_TABLE_ORDER]
    x = _resolved(spark, d).select(*KEYS, qt.candidate_tables("resolved").alias("tabs"))
    known = F.array(*[F.lit(n) for n in names])
    return x.select(*KEYS, F.array_join("tabs", ",").alias("tables"),
                    (F.size(F.array_except("tabs", known)) == 0).alias("all_known"))


# -------------------------------------------------------------------- T19

@register("t19_drop_table_star", with_ql(
    f"SELECT query_id, side, regexp_replace(resolved, '{qt.TABLE_STAR_PATTERN}', '', 'g') AS cleaned FROM res5",
    _SQL_TOKS, _SQL_ALIAS, _SQL_RESOLVE))
def t19(spark, d):
    return _resolved(spark, d).select(*KEYS, qt.drop_table_star("resolved").alias("cleaned"))


# -------------------------------------------------------------------- T20
# tokens = T1 -> T3 (values masked) -> dotted names split; known = decoder vocabulary + schema names

_VOCAB_SQL = ", ".join(f"({_lit(v)})" for v in qt.VOCAB_WITH_FROM)


@register("t20_oov_tokens", with_ql(f"""SELECT query_id, side, arg_min(t, pos) AS first_oov, count(*) AS n_oov
FROM (SELECT query_id, side, unnest(spl) AS t, generate_subscripts(spl, 1) - 1 AS pos FROM d1)
WHERE t NOT IN (SELECT v FROM (VALUES {_VOCAB_SQL}) AS vv(v))
  AND t NOT IN (SELECT lower(column_name) FROM information_schema.columns WHERE table_name IN ({_TABLES}))
  AND t NOT IN ({_TABLES}, '*')
GROUP BY query_id, side""", _SQL_TOKS, _SQL_SPLIT_DOTTED.replace(
    "FROM toks WHERE toks IS NOT NULL",
    f"FROM (SELECT query_id, side, list_transform(toks, lambda t: CASE WHEN regexp_matches(t, '{_FLOAT}') OR "
    "(starts_with(t, '\"') AND suffix(t, '\"')) THEN 'value' ELSE lower(t) END) AS toks FROM toks WHERE toks IS NOT NULL)")))
def t20(spark, d):
    x = _toks(spark, d).select(*KEYS, qt.split_names(qt.strip_values("toks")).alias("toks"))
    cat = star_catalog(spark, d).columns
    known = (spark.createDataFrame([(v,) for v in qt.VOCAB_WITH_FROM], "token string")
             .unionByName(cat.select(F.lower("column_name").alias("token")))
             .unionByName(cat.filter(F.col("table_name").isNotNull()).select(F.lower("table_name").alias("token"))))
    return qt.oov_tokens(x, KEYS, "toks", known).select(*KEYS, "first_oov", F.col("n_oov").cast("long"))
