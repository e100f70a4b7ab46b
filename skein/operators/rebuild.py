"""FROM clauses rebuilt from the no-FROM form.

Each block's tables are those its ``table.column`` tokens name, in order of first appearance. One table stands alone
and its columns lose the prefix; several become a join tree: from the first table the shortest foreign-key path to each
further one, tables already joined left out. Aliases T1, T2, ... run on from block to block, in the order in which the
blocks begin. All of it is row-local: the tokens of a query are one array, a block's tree is a fold over its tables, and alias numbers
are a fold over the blocks. The foreign-key paths are one map per database (metadata), joined by ``db_id``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators import catalog as co
from skein.operators import tokens as tk
from skein.sources.catalog import Catalog

_STEP = "struct<t:string,prev:string,pcol:string,col:string>"


def fk_paths(cat: Catalog) -> DataFrame:
    """(db_id, tables, paths): per database its tables, and for ``src dst`` the tables after src on the shortest path,
    each with its predecessor and the two key columns (the first foreign key, where two tables have several)."""
    name = cat.columns.filter(F.col("column_id") > 0).select("db_id", "column_id", F.lower("table_name").alias("t"), F.lower("column_name").alias("c"))
    a, b = (name.select("db_id", F.col("column_id").alias(i), F.col("t").alias(f"t_{i}"), F.col("c").alias(f"c_{i}")) for i in ("column_id", "other_column_id"))
    one = cat.fks.join(a, ["db_id", "column_id"]).join(b, ["db_id", "other_column_id"])
    edges = one.select("db_id", "column_id", F.col("t_column_id").alias("x"), F.col("c_column_id").alias("xc"), F.col("t_other_column_id").alias("y"), F.col("c_other_column_id").alias("yc"))
    edges = edges.unionByName(edges.select("db_id", "column_id", F.col("y").alias("x"), F.col("yc").alias("xc"), F.col("x").alias("y"), F.col("xc").alias("yc")))
    edges = edges.groupBy("db_id", "x", "y").agg(F.min(F.struct("column_id", "xc", "yc")).alias("k"))
    hops = co.join_path(cat).select("db_id", F.lower("src").alias("src"), F.lower("dst").alias("dst"), F.split(F.lower("path"), " ").alias("p"))
    hops = hops.select("db_id", "src", "dst", "p", F.posexplode(F.slice("p", 2, F.size("p") - 1)).alias("i", "y")).withColumn("x", F.element_at("p", F.col("i") + 1))
    steps = hops.join(edges, ["db_id", "x", "y"]).groupBy("db_id", "src", "dst").agg(
        F.array_sort(F.collect_list(F.struct("i", F.struct(F.col("y").alias("t"), F.col("x").alias("prev"), F.col("k.xc").alias("pcol"), F.col("k.yc").alias("col")).alias("s")))).alias("s"))
    paths = steps.groupBy("db_id").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(" ", "src", "dst"), F.transform("s", lambda x: x["s"])))).alias("paths"))
    tables = cat.tables.groupBy("db_id").agg(F.array_sort(F.collect_set(F.lower("table_name"))).alias("tables"))
    return tables.join(paths, "db_id", "left").withColumn("paths", F.coalesce("paths", F.expr(f"cast(map() as map<string,array<{_STEP}>>)")))


#: Per block: its tables, the last token of its select list, and whether a derived table follows that list.
_BLOCKS = """transform(array_sort(array_distinct(transform(filter(ts, t -> t.block >= 0), t -> t.block))), b -> named_struct(
    'block', b,
    'named', array_distinct(transform(filter(ts, t -> t.block = b and t.token like '%.%' and array_contains(tables, split_part(t.token, '.', 1))), t -> split_part(t.token, '.', 1))),
    'derived', exists(ts, t -> t.block = b and t.derived),
    'last', array_max(transform(filter(ts, t -> t.block = b and t.clause = 'select' and not t.derived), t -> t.pos))))"""

#: The join tree of a block: the first table, then the new tables of each path from it.
_TREE = f"""transform(blocks, b -> named_struct('block', b.block, 'named', b.named, 'derived', b.derived, 'last', b.last, 'tree',
    if(size(b.named) < 2, cast(array() as array<{_STEP}>),
       aggregate(slice(b.named, 2, size(b.named)), array(named_struct('t', b.named[0], 'prev', cast(null as string), 'pcol', cast(null as string), 'col', cast(null as string))),
         (j, c) -> if(exists(j, x -> x.t = c), j,
           concat(j, filter(coalesce(try_element_at(paths, concat(b.named[0], ' ', c)), array(named_struct('t', c, 'prev', cast(null as string), 'pcol', cast(null as string), 'col', cast(null as string)))),
                            n -> not exists(j, x -> x.t = n.t))))))))"""

#: Alias numbers before each block, by an ordered fold.
_OFFSETS = """aggregate(trees, cast(array() as array<int>), (o, b) -> concat(o, array(if(size(o) = 0, 0, element_at(o, -1) + size(trees[size(o) - 1].tree)))))"""

_FROM = """map_from_entries(transform(arrays_zip(trees, offs), z -> struct(z.trees.block, named_struct('named', z.trees.named, 'last', z.trees.last, 'off', z.offs,
    'names', transform(z.trees.tree, x -> x.t),
    'clause', case when z.trees.derived or size(z.trees.named) = 0 then '' when size(z.trees.named) = 1 then concat(' from ', z.trees.named[0])
      else concat(' from ', array_join(transform(z.trees.tree, (x, i) -> concat(if(i = 0, '', 'join '), x.t, ' as T', z.offs + i + 1,
        if(x.prev is null, '', concat(' on T', z.offs + array_position(transform(z.trees.tree, y -> y.t), x.prev), '.', x.pcol, ' = T', z.offs + i + 1, '.', x.col)))), ' ')) end))))"""

_TEXT = """array_join(transform(ts, (t, i) -> concat(
    if(t.derived, 'from ', ''),
    case when t.token = 'value' or t.token = 'limit_value' then '1'
         when t.token like '%.%' and t.block >= 0 and array_contains(f[t.block].named, split_part(t.token, '.', 1)) then
           case when size(f[t.block].named) = 1 or (t.token like '%.*' and i > 1 and ts[i - 1].token = '(' and ts[i - 2].token = 'count') then split_part(t.token, '.', 2)
                else concat('T', f[t.block].off + array_position(f[t.block].names, split_part(t.token, '.', 1)), '.', split_part(t.token, '.', 2)) end
         else t.token end,
    if(t.block >= 0 and t.pos = f[t.block].last, f[t.block].clause, ''))), ' ')"""


def rebuild_from(qs: DataFrame, key: str, text: str, paths: DataFrame, out: str = "sql") -> DataFrame:
    """(key, out) for rows (key, db_id, text); the text is the space-separated no-FROM form of T16.

    A table without a foreign-key path to the block's first one is joined without ON. A block that names no table
    keeps no FROM; a derived table after a select list gets its FROM back. Slots ``value`` and ``limit_value`` become 1;
    ``count ( t.* )`` becomes ``count ( * )``. A null text stays null.
    """
    toks = qs.select(key, F.split(F.col(text), " ").alias("toks"))
    tt = tk.token_table(toks.where("toks is not null"), [key])
    prev = F.coalesce("prev_tok", F.lit(""))
    derived = F.col("sub_open") & (F.coalesce("clause", F.lit("")) == "select") & ~prev.isin("select", "distinct", ",", "(", "+", "-", "/", *tk.AGG_WORDS)
    ts = tt.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "token", "block", F.coalesce("clause", F.lit("")).alias("clause"), derived.alias("derived")))).alias("ts"))
    x = qs.select(key, "db_id").join(F.broadcast(paths), "db_id", "left").withColumn("tables", F.coalesce("tables", F.array().cast("array<string>"))).withColumn("paths", F.coalesce("paths", F.expr(f"cast(map() as map<string,array<{_STEP}>>)"))).join(ts, key, "left")
    for name, body in (("blocks", _BLOCKS), ("trees", _TREE), ("offs", _OFFSETS), ("f", _FROM), (out, _TEXT)):
        x = x.withColumn(name, F.expr(body))
    return x.select(key, out)
