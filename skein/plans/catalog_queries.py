"""Catalog family (S7, C1-C11) on the catalogs of the star tables and its logical databases."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import catalog as co
from skein.plans.registry import register
from skein.session import Tables
from skein.sources.catalog import (STAR_DATABASES, STAR_FOREIGN_KEYS, STAR_PRIMARY_KEYS, TRAIN_DATABASES,
                                   star_catalog, star_catalogs)

_DBT = ", ".join(f"('{db}', {i}, '{t}')" for db, ts in STAR_DATABASES.items() for i, t in enumerate(ts))
_PKS = ", ".join(f"'{c}'" for c in STAR_PRIMARY_KEYS)
_FKS = ", ".join(f"('{a}', '{b}')" for a, b in STAR_FOREIGN_KEYS)
_TYPE = """CASE WHEN c.data_type IN ('INTEGER','BIGINT','DOUBLE','FLOAT','SMALLINT','TINYINT','HUGEINT','REAL')
                   OR c.data_type LIKE 'DECIMAL%' THEN 'number'
              WHEN c.data_type = 'VARCHAR' THEN 'text' WHEN c.data_type = 'BOOLEAN' THEN 'boolean'
              WHEN c.data_type LIKE 'TIMESTAMP%' OR c.data_type = 'DATE' THEN 'time' ELSE 'others' END"""
# catalog of every logical database: column ids restart per database, 0 = '*'
CAT_SQL = f"""dbt AS (SELECT * FROM (VALUES {_DBT}) AS d(db_id, table_id, table_name)),
lcols AS (
  SELECT d.db_id, d.table_id, d.table_name, c.column_name, c.ordinal_position AS ord, {_TYPE} AS column_type,
         c.column_name IN ({_PKS}) AS is_pk
  FROM dbt d JOIN information_schema.columns c ON c.table_name = d.table_name),
lcat AS (
  SELECT db_id, CAST(row_number() OVER (PARTITION BY db_id ORDER BY table_id, ord) AS INTEGER) AS column_id,
         table_id, table_name, column_name, column_type, is_pk FROM lcols),
fkn AS (SELECT * FROM (VALUES {_FKS}) AS f(a, b)),
lfks AS (
  SELECT x.db_id, x.column_id, y.column_id AS other_column_id
  FROM fkn JOIN lcat x ON x.column_name = fkn.a JOIN lcat y ON y.column_name = fkn.b AND y.db_id = x.db_id),
keycols AS (
  SELECT db_id, column_id FROM lcat WHERE is_pk UNION SELECT db_id, column_id FROM lfks
  UNION SELECT db_id, other_column_id FROM lfks)"""


def w(body: str) -> str:
    return f"WITH RECURSIVE {CAT_SQL}\n{body}"


@register("s07_catalog_from_tables", w(
    "SELECT db_id, column_id, table_id, table_name, column_name, column_type, is_pk FROM lcat WHERE db_id = 'star' "
    "UNION ALL SELECT 'star', 0, -1, NULL, '*', 'text', false"))
def s07(spark, d):
    return star_catalog(spark, d).columns


@register("c01_column_ids", w(
    "SELECT db_id, 'column' AS kind, lower(table_name) || '.' || lower(column_name) AS key, column_id AS id "
    "FROM lcat WHERE db_id = 'star' UNION ALL SELECT 'star', 'column', '*', 0 "
    "UNION ALL SELECT db_id, 'table', lower(table_name), table_id FROM dbt WHERE db_id = 'star'"))
def c01(spark, d):
    return co.column_ids(star_catalog(spark, d))


@register("c02_typed_columns", w(
    "SELECT l.db_id, l.table_name, l.column_name, CASE WHEN k.column_id IS NOT NULL THEN 'key' ELSE l.column_type END "
    "AS slot_type FROM lcat l LEFT JOIN keycols k ON k.db_id = l.db_id AND k.column_id = l.column_id "
    "WHERE l.db_id = 'star' UNION ALL SELECT db_id, table_name, '*', '*' FROM dbt WHERE db_id = 'star'"))
def c02(spark, d):
    return co.typed_columns(star_catalog(spark, d))


_TYPED_ALL = """typed AS (
  SELECT l.db_id, CASE WHEN k.column_id IS NOT NULL THEN 'key' ELSE l.column_type END AS slot_type
  FROM lcat l LEFT JOIN keycols k ON k.db_id = l.db_id AND k.column_id = l.column_id
  UNION ALL SELECT db_id, '*' FROM dbt)"""


@register("c03_slot_support", w(
    ", " + _TYPED_ALL + ", n AS (SELECT db_id, slot_type, count(*) AS n FROM typed GROUP BY ALL) "
    "SELECT db_id, slot_type || '_col_' || CAST(i AS VARCHAR) AS slot FROM n, range(0, n) AS r(i)"))
def c03(spark, d):
    return co.slot_support(star_catalogs(spark, d))


@register("c03c_slot_support_coarse", w(
    ", " + _TYPED_ALL + ", n AS (SELECT db_id, CASE WHEN slot_type IN ('key', '*') THEN slot_type ELSE 'gen' END AS slot_type, count(*) AS n FROM typed GROUP BY ALL) "
    "SELECT db_id, slot_type || '_col_' || CAST(i AS VARCHAR) AS slot FROM n, range(0, n) AS r(i)"))
def c03c(spark, d):
    return co.slot_support(star_catalogs(spark, d), coarse=True)


@register("c04_fk_canonical", w(
    ", e AS (SELECT column_id AS a, other_column_id AS b FROM lfks WHERE db_id = 'star' "
    "UNION SELECT other_column_id, column_id FROM lfks WHERE db_id = 'star'), "
    "r(node, label) AS (SELECT a, a FROM e UNION SELECT e.a, r.label FROM r JOIN e ON e.b = r.node) "
    "SELECT 'star' AS db_id, node AS column_id, min(label) AS rep_id FROM r GROUP BY node"))
def c04(spark, d):
    return co.fk_canonical(star_catalog(spark, d))


@register("c05_join_path", w(
    ", te AS (SELECT DISTINCT x.table_name AS src, y.table_name AS dst FROM lfks f "
    "JOIN lcat x ON x.db_id = f.db_id AND x.column_id = f.column_id "
    "JOIN lcat y ON y.db_id = f.db_id AND y.column_id = f.other_column_id WHERE f.db_id = 'star'), "
    "ue AS (SELECT src, dst FROM te UNION SELECT dst, src FROM te), "
    "p(src, dst, hops, path) AS (SELECT src, dst, 1, src || ' ' || dst FROM ue UNION ALL "
    "SELECT p.src, ue.dst, p.hops + 1, p.path || ' ' || ue.dst FROM p JOIN ue ON ue.src = p.dst "
    "WHERE NOT list_contains(string_split(p.path, ' '), ue.dst)) "
    "SELECT 'star' AS db_id, src, dst, hops, path FROM (SELECT *, row_number() OVER "
    "(PARTITION BY src, dst ORDER BY hops, path) AS rn FROM p WHERE src <> dst) WHERE rn = 1"))
def c05(spark, d):
    return co.join_path(star_catalog(spark, d))


def _ser_sql(style_pete: bool, order: str) -> str:
    col_sep = " , " if style_pete else ", "
    ttext = ("' | ' || lower(table_name) || ' : ' || cols" if style_pete
             else "'Table: ' || lower(table_name) || '. Columns: ' || cols")
    head = "' | ' || db_id" if style_pete else "'Database: ' || db_id || '. '"
    tsep = "" if style_pete else ". "
    return w(f", pt AS (SELECT db_id, table_id, table_name, string_agg(lower(column_name), '{col_sep}' ORDER BY column_id) AS cols "
             "FROM lcat GROUP BY db_id, table_id, table_name) "
             f"SELECT db_id, {head} || string_agg({ttext}, '{tsep}' ORDER BY {order}, table_id) AS schema "
             "FROM pt GROUP BY db_id")


@register("c08_serialize_schema", _ser_sql(True, "table_id"))
def c08(spark, d):
    return co.serialize_schema(star_catalogs(spark, d))


@register("c08v_serialize_schema_verbose", _ser_sql(False, "table_id"))
def c08v(spark, d):
    return co.serialize_schema(star_catalogs(spark, d), style="verbose")


@register("c09_serialize_randomized",
          _ser_sql(True, "((('0x' || substr(md5('r1:' || table_name), 1, 8))::BIGINT) % 1073741824)"))
def c09(spark, d):
    return co.serialize_schema(star_catalogs(spark, d), randomized_seed="r1")


@register("c07_schema_maps", w(
    "SELECT db_id, count(*) AS n_cols, string_agg(column_name, ',' ORDER BY column_id) AS names, "
    "string_agg(column_type, ',' ORDER BY column_id) AS types, string_agg(table_name, ',' ORDER BY column_id) AS tables "
    "FROM lcat GROUP BY db_id"))
def c07(spark, d):
    m = co.schema_maps(star_catalogs(spark, d))
    ordered = lambda c: F.array_join(F.transform(F.array_sort(F.map_keys(c)), lambda k: F.col(c)[k]), ",")
    return m.select("db_id", F.size("id_to_name").cast("long").alias("n_cols"), ordered("id_to_name").alias("names"),
                    ordered("id_to_type").alias("types"), ordered("id_to_table").alias("tables"))


@register("c06_schemas_by_db", _ser_sql(False, "table_id"))
def c06(spark, d):
    cat = star_catalogs(spark, d)
    train = co.serialize_schema(cat).withColumn("priority", F.lit(0))
    dev = co.serialize_schema(cat, style="verbose").withColumn("priority", F.lit(1))
    return co.schemas_by_db(train.unionByName(dev))


_NUM_COLS = {"customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
             "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]}


def _num_sql():
    parts = []
    for t, cols in _NUM_COLS.items():
        for c in cols:
            parts.append(f"SELECT '{c}' AS column_name, coalesce(bool_and(try_cast(CAST({c} AS VARCHAR) AS DOUBLE) "
                         f"IS NOT NULL) FILTER (WHERE {c} IS NOT NULL), true) AS is_numeric, '{t}' AS table_name FROM {t}")
    return " UNION ALL ".join(parts)


@register("c10_numeric_profile", _num_sql())
def c10(spark, d):
    t = Tables(spark, d)
    return co.numeric_profile(t.customer, "customer").unionByName(co.numeric_profile(t.part, "part"))


_TRAIN = ", ".join(f"('{x}')" for x in TRAIN_DATABASES)


@register("c11_split_databases", w(
    f", tr AS (SELECT * FROM (VALUES {_TRAIN}) AS t(db_id)) "
    "SELECT DISTINCT db_id, CASE WHEN db_id IN (SELECT db_id FROM tr) THEN 'seen' ELSE 'unseen' END AS split FROM dbt"))
def c11(spark, d):
    dbs = star_catalogs(spark, d).tables.select("db_id").distinct()
    train = spark.createDataFrame([(x,) for x in TRAIN_DATABASES], "db_id string")
    return co.split_databases(dbs, train)
