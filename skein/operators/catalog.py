"""Schema-catalog operators (C1-C11) over the catalog frames of ``skein.sources.catalog``.

Catalog frames are metadata (one row per column); their joins with data-sized
frames broadcast them. Iterative graph work on the foreign-key graph (C4, C5)
runs as frontier joins with a bounded number of rounds and a lineage cut per
round.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.functions.hashing import bucket
from skein.session import cut_lineage
from skein.sources.catalog import Catalog


def column_ids(cat: Catalog) -> DataFrame:
    """Canonical keys -> ids: ``table.column`` and ``*`` for columns, ``table`` for tables."""
    cols = cat.columns.select(
        "db_id", F.lit("column").alias("kind"),
        F.when(F.col("column_name") == "*", F.lit("*")).otherwise(
            F.concat(F.lower("table_name"), F.lit("."), F.lower("column_name"))).alias("key"),
        F.col("column_id").alias("id"))
    tabs = cat.tables.select("db_id", F.lit("table").alias("kind"), F.lower("table_name").alias("key"),
                             F.col("table_id").alias("id"))
    return cols.unionByName(tabs)


def key_columns(cat: Catalog) -> DataFrame:
    """Column ids that are a primary key or on either side of a foreign key."""
    pk = cat.columns.filter("is_pk").select("db_id", "column_id")
    fk = cat.fks.select("db_id", "column_id").unionByName(
        cat.fks.select("db_id", F.col("other_column_id").alias("column_id")))
    return pk.unionByName(fk).distinct()


def typed_columns(cat: Catalog) -> DataFrame:
    """Slot type per column: ``key`` for pk/fk columns, else its type; one ``t.*`` row of type ``*`` per table."""
    keys = key_columns(cat).withColumn("is_key", F.lit(True))
    cols = cat.columns.filter(F.col("column_id") > 0).join(keys, ["db_id", "column_id"], "left")
    typed = cols.select("db_id", "table_name", "column_name",
                        F.when(F.col("is_key"), F.lit("key")).otherwise(F.col("column_type")).alias("slot_type"))
    stars = cat.tables.select("db_id", "table_name", F.lit("*").alias("column_name"), F.lit("*").alias("slot_type"))
    return typed.unionByName(stars)


def slot_support(cat: Catalog, coarse: bool = False) -> DataFrame:
    """Per database the placeholder slots it can fill: ``{type}_col_{i}`` for i < count(type)."""
    t = typed_columns(cat)
    if coarse:
        t = t.withColumn("slot_type", F.when(F.col("slot_type").isin("key", "*"), F.col("slot_type"))
                         .otherwise(F.lit("gen")))
    n = t.groupBy("db_id", "slot_type").agg(F.count("*").alias("n"))
    x = n.select("db_id", "slot_type", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    return x.select("db_id", F.concat("slot_type", F.lit("_col_"), F.col("i").cast("string")).alias("slot"))


def fk_canonical(cat: Catalog) -> DataFrame:
    """C4: foreign-key equivalence classes; each column maps to the smallest id of its class.

    Connected components by iterated min-label propagation over undirected FK
    edges: each round joins labels along edges and keeps the minimum; stops at
    the fixpoint.
    """
    e = cat.fks.select("db_id", F.col("column_id").alias("a"), F.col("other_column_id").alias("b"))
    edges = e.unionByName(e.select("db_id", F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    labels = edges.select("db_id", F.col("a").alias("node")).distinct().withColumn("label", F.col("node"))
    while True:
        prop = edges.join(labels.withColumnRenamed("node", "b"), ["db_id", "b"]).select(
            "db_id", F.col("a").alias("node"), F.col("label").alias("cand"))
        new = labels.join(prop, ["db_id", "node"], "left").groupBy("db_id", "node").agg(
            F.least(F.min("label"), F.coalesce(F.min("cand"), F.min("label"))).alias("label"))
        new = cut_lineage(new)
        changed = new.join(labels.withColumnRenamed("label", "old"), ["db_id", "node"]) \
            .filter(F.col("label") != F.col("old")).limit(1).count()
        labels = new
        if changed == 0:
            break
    return labels.select("db_id", F.col("node").alias("column_id"), F.col("label").alias("rep_id"))


def table_edges(cat: Catalog) -> DataFrame:
    """Undirected table graph of the foreign keys (db_id, src, dst)."""
    c = cat.columns.select("db_id", "column_id", "table_name")
    e = cat.fks.join(c, ["db_id", "column_id"]).select("db_id", F.col("table_name").alias("src"), "other_column_id")
    e = e.join(c.withColumnRenamed("column_id", "other_column_id").withColumnRenamed("table_name", "dst"),
               ["db_id", "other_column_id"]).select("db_id", "src", "dst")
    return e.unionByName(e.select("db_id", F.col("dst").alias("src"), F.col("src").alias("dst"))) \
        .filter(F.col("src") != F.col("dst")).distinct()


def join_path(cat: Catalog) -> DataFrame:
    """Shortest FK path between every pair of tables (BFS by frontier joins).

    Ties go to the lexicographically smallest path text; pairs without a path
    are absent (the caller cross joins them). Output: db_id, src, dst, hops, path.
    """
    edges = cut_lineage(table_edges(cat))
    frontier = edges.select("db_id", "src", "dst", F.lit(1).alias("hops"),
                            F.concat_ws(" ", "src", "dst").alias("path"))
    best = frontier
    for hops in count(2):
        nxt_edges = edges.select("db_id", F.col("src").alias("dst"), F.col("dst").alias("nxt"))
        step = frontier.join(nxt_edges, ["db_id", "dst"]) \
            .filter(~F.array_contains(F.split("path", " "), F.col("nxt"))) \
            .select("db_id", "src", F.col("nxt").alias("dst"), F.lit(hops).alias("hops"),
                    F.concat_ws(" ", "path", "nxt").alias("path"))
        step = step.join(best.select("db_id", "src", "dst"), ["db_id", "src", "dst"], "left_anti")
        w = Window.partitionBy("db_id", "src", "dst").orderBy("path")
        step = cut_lineage(step.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r"))
        if step.limit(1).count() == 0:
            break
        best = best.unionByName(step)
        frontier = step
    w = Window.partitionBy("db_id", "src", "dst").orderBy("hops", "path")
    return best.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")


def serialize_schema(cat: Catalog, style: str = "pipe", with_db_id: bool = True,
                     randomized_seed: str | None = None) -> DataFrame:
    """One schema string per database.

    pipe: `` | db | table : col , col | table : ...``; verbose:
    ``Database: db. Table: t. Columns: a, b``. With a seed the table order is
    md5(seed || table) instead of table id (deterministic shuffle).
    """
    cols = cat.columns.filter(F.col("column_id") > 0)
    per_table = cols.groupBy("db_id", "table_id", "table_name").agg(
        F.array_sort(F.collect_list(F.struct("column_id", F.lower("column_name").alias("c")))).alias("cs"))
    sep = " , " if style == "pipe" else ", "
    col_text = F.array_join(F.transform("cs", lambda s: s["c"]), sep)
    if style == "pipe":
        ttext = F.concat(F.lit(" | "), F.lower("table_name"), F.lit(" : "), col_text)
    else:
        ttext = F.concat(F.lit("Table: "), F.lower("table_name"), F.lit(". Columns: "), col_text)
    order = bucket(randomized_seed, "table_name", 1 << 30) if randomized_seed else F.col("table_id")
    per_table = per_table.select("db_id", order.alias("o"), F.col("table_id"), ttext.alias("t"))
    per_db = per_table.groupBy("db_id").agg(
        F.array_sort(F.collect_list(F.struct("o", "table_id", "t"))).alias("ts"))
    tsep = "" if style == "pipe" else ". "
    body = F.array_join(F.transform("ts", lambda s: s["t"]), tsep)
    if with_db_id:
        head = F.concat(F.lit(" | "), F.col("db_id")) if style == "pipe" else \
            F.concat(F.lit("Database: "), F.col("db_id"), F.lit(". "))
        body = F.concat(head, body)
    return per_db.select("db_id", body.alias("schema"))


def schema_maps(cat: Catalog) -> DataFrame:
    """Per database id->name, id->type, id->table maps (star excluded) and table -> columns."""
    c = cat.columns.filter(F.col("column_id") > 0)
    return c.groupBy("db_id").agg(
        F.map_from_entries(F.collect_list(F.struct("column_id", "column_name"))).alias("id_to_name"),
        F.map_from_entries(F.collect_list(F.struct("column_id", "column_type"))).alias("id_to_type"),
        F.map_from_entries(F.collect_list(F.struct("column_id", "table_name"))).alias("id_to_table"))


def numeric_profile(df: DataFrame, table: str) -> DataFrame:
    """Is each column numeric (every non-null value casts to double)? Unpivot, then one aggregate."""
    cols = [f.name for f in df.schema.fields]
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"),
                                                  F.col(c).cast("string").alias("v")) for c in cols])).alias("x"))
    return long.groupBy(F.col("x.column_name").alias("column_name")).agg(
        F.min(F.when(F.col("x.v").isNull(), F.lit(True)).otherwise(
            F.expr("try_cast(x.v AS DOUBLE)").isNotNull())).alias("is_numeric")) \
        .withColumn("table_name", F.lit(table))


def split_databases(dbs: DataFrame, train: DataFrame) -> DataFrame:
    """C11: databases seen in training (semi join) and held out (anti join)."""
    seen = dbs.join(train, "db_id", "left_semi").withColumn("split", F.lit("seen"))
    unseen = dbs.join(train, "db_id", "left_anti").withColumn("split", F.lit("unseen"))
    return seen.unionByName(unseen)


def schemas_by_db(rows: DataFrame) -> DataFrame:
    """One schema per database; the row with the highest priority (later split) wins."""
    return rows.groupBy("db_id").agg(F.max_by("schema", "priority").alias("schema"))
