"""Schema catalogs as DataFrames.

Three frames describe any set of databases:

* ``cat_tables(db_id, table_id, table_name)``
* ``cat_columns(db_id, column_id, table_id, table_name, column_name, column_type, is_pk)``
  -- column id 0 is ``*`` with table id -1, then columns in table order
* ``cat_fks(db_id, column_id, other_column_id)``

S7 reads them from DataFrame schemas (metadata only, sized by the number of
columns, never by the data); S8 reads the JSON catalog file format.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- fixed values: keys of the star schema (FIXTURES §2) ----
STAR_TABLE_ORDER = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]
STAR_PRIMARY_KEYS = ["r_regionkey", "n_nationkey", "c_custkey", "s_suppkey", "p_partkey", "o_orderkey", "event_id"]
STAR_FOREIGN_KEYS = [
    ("n_regionkey", "r_regionkey"), ("c_nationkey", "n_nationkey"), ("s_nationkey", "n_nationkey"),
    ("o_custkey", "c_custkey"), ("l_orderkey", "o_orderkey"), ("l_partkey", "p_partkey"), ("l_suppkey", "s_suppkey"),
]
# logical databases over the star tables and the training split (FIXTURES §2)
STAR_DATABASES = {
    "star": STAR_TABLE_ORDER,
    "geo": ["region", "nation"],
    "sales": ["customer", "orders", "lineitem"],
    "supply": ["supplier", "part", "nation"],
    "web": ["events"],
}
TRAIN_DATABASES = ["star", "sales"]


def spark_type_class(dt: T.DataType) -> str:
    """Column type lattice: number, text, boolean, time, others."""
    if isinstance(dt, T.NumericType):
        return "number"
    if isinstance(dt, (T.StringType, T.VarcharType, T.CharType)):
        return "text"
    if isinstance(dt, T.BooleanType):
        return "boolean"
    if isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "time"
    return "others"


@dataclass
class Catalog:
    tables: DataFrame
    columns: DataFrame
    fks: DataFrame


COLUMN_SCHEMA = ("db_id string, column_id int, table_id int, table_name string, column_name string, "
                 "column_type string, is_pk boolean")


def catalog_from_tables(spark: SparkSession, dfs: dict[str, DataFrame], db_id: str = "star",
                        primary_keys=(), foreign_keys=()) -> Catalog:
    """Catalog frames from DataFrame schemas (driver reads metadata only)."""
    trows, crows = [], [(db_id, 0, -1, None, "*", "text", False)]
    cid = 1
    name_to_id = {}
    for tid, (tname, df) in enumerate(dfs.items()):
        trows.append((db_id, tid, tname))
        for field in df.schema.fields:
            crows.append((db_id, cid, tid, tname, field.name, spark_type_class(field.dataType),
                          field.name in primary_keys))
            name_to_id[field.name] = cid
            cid += 1
    frows = [(db_id, name_to_id[a], name_to_id[b]) for a, b in foreign_keys if a in name_to_id and b in name_to_id]
    return Catalog(
        spark.createDataFrame(trows, "db_id string, table_id int, table_name string"),
        spark.createDataFrame(crows, COLUMN_SCHEMA),
        spark.createDataFrame(frows, "db_id string, column_id int, other_column_id int"),
    )


def star_catalog(spark: SparkSession, sf_dir: str, db_id: str = "star", tables=None) -> Catalog:
    """CAT: the catalog of the star tables (FIXTURES §2)."""
    from skein.session import read_table
    names = tables or STAR_TABLE_ORDER
    dfs = {t: read_table(spark, sf_dir, t) for t in names}
    return catalog_from_tables(spark, dfs, db_id, STAR_PRIMARY_KEYS, STAR_FOREIGN_KEYS)


def star_catalogs(spark: SparkSession, sf_dir: str) -> Catalog:
    """Catalog frames for every logical database of FIXTURES §2 (one db_id each)."""
    parts = [star_catalog(spark, sf_dir, db, tabs) for db, tabs in STAR_DATABASES.items()]
    out = parts[0]
    for p in parts[1:]:
        out = Catalog(out.tables.unionByName(p.tables), out.columns.unionByName(p.columns),
                      out.fks.unionByName(p.fks))
    return out


TABLES_JSON_SCHEMA = T.StructType([
    T.StructField("db_id", T.StringType()),
    T.StructField("table_names_original", T.ArrayType(T.StringType())),
    T.StructField("table_names", T.ArrayType(T.StringType())),
    T.StructField("column_names_original", T.ArrayType(T.ArrayType(T.StringType()))),
    T.StructField("column_names", T.ArrayType(T.ArrayType(T.StringType()))),
    T.StructField("column_types", T.ArrayType(T.StringType())),
    T.StructField("primary_keys", T.ArrayType(T.LongType())),
    T.StructField("foreign_keys", T.ArrayType(T.ArrayType(T.LongType()))),
])


def catalog_from_json(spark: SparkSession, path: str) -> Catalog:
    """The JSON catalog format (one array of databases) -> catalog frames."""
    raw = spark.read.schema(TABLES_JSON_SCHEMA).json(path, multiLine=True)
    tables = raw.select("db_id", F.posexplode("table_names_original").alias("table_id", "table_name"))
    cols = raw.select("db_id", "primary_keys",
                      F.posexplode(F.arrays_zip("column_names_original", "column_types")).alias("column_id", "c"))
    cols = cols.select("db_id", "column_id",
                       F.col("c.column_names_original")[0].cast("int").alias("table_id"),
                       F.col("c.column_names_original")[1].alias("column_name"),
                       F.col("c.column_types").alias("column_type"),
                       F.array_contains("primary_keys", F.col("column_id").cast("long")).alias("is_pk"))
    cols = cols.join(tables, ["db_id", "table_id"], "left").select(
        "db_id", "column_id", "table_id", "table_name", "column_name", "column_type", "is_pk")
    fks = raw.select("db_id", F.explode("foreign_keys").alias("fk")).select(
        "db_id", F.col("fk")[0].cast("int").alias("column_id"), F.col("fk")[1].cast("int").alias("other_column_id"))
    return Catalog(tables, cols, fks)


def star_catalog_sql() -> str:
    """CTE ``cat_columns`` for the oracle, built from information_schema in table order."""
    order = ", ".join(f"('{t}', {i})" for i, t in enumerate(STAR_TABLE_ORDER))
    pks = ", ".join(f"'{c}'" for c in STAR_PRIMARY_KEYS)
    return f"""cat_cols0 AS (
  SELECT c.table_name, c.column_name, c.data_type, o.tid AS table_id, c.ordinal_position AS ord
  FROM information_schema.columns c JOIN (VALUES {order}) AS o(tname, tid) ON c.table_name = o.tname),
cat_columns AS (
  SELECT 'star' AS db_id, 0 AS column_id, -1 AS table_id, CAST(NULL AS VARCHAR) AS table_name, '*' AS column_name,
         'text' AS column_type, false AS is_pk
  UNION ALL
  SELECT 'star', CAST(row_number() OVER (ORDER BY table_id, ord) AS INTEGER), table_id, table_name, column_name,
         CASE WHEN data_type IN ('INTEGER','BIGINT','DOUBLE','FLOAT','SMALLINT','TINYINT','HUGEINT','REAL')
                   OR data_type LIKE 'DECIMAL%' THEN 'number'
              WHEN data_type = 'VARCHAR' THEN 'text'
              WHEN data_type = 'BOOLEAN' THEN 'boolean'
              WHEN data_type LIKE 'TIMESTAMP%' OR data_type = 'DATE' THEN 'time' ELSE 'others' END,
         column_name IN ({pks})
  FROM cat_cols0)"""
