"""Nested scopes of a query: which definition a name means.

A query's tokens become one array, and from it, row-locally:

* ``blocks``: every SELECT with the block around it (none for the outermost, for operands of set operations their
  left operand's) and whether it is a derived table;
* ``chain``: a block and the blocks around it, nearest first, by a fold from the outside in; a derived table sees only itself;
* ``items``: the tables and derived tables of each block's FROM under the names by which the block knows them.

``alias.column`` means the nearest block of the chain that defines the alias, so an inner definition hides an outer one.
A bare column belongs to the nearest block that has it, and must be in exactly one of that block's items. A derived table has
the columns its select list names; a star in that list stands for all columns of its tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators import tokens as tk

_KEYWORDS = ", ".join(f"'{w}'" for w in tk.KEYWORDS)
_IDENT = f"(t.token rlike '^[a-z_][a-z0-9_#$]*$' and t.token not in ({_KEYWORDS}))"

_BLOCKS = """transform(filter(ts, t -> t.token = 'select'), s -> named_struct('block', s.pos, 'around',
    element_at(concat(array(cast(null as struct<block:int,clause:string>)), transform(filter(ts, t -> t.sub_open and t.pos < s.pos and coalesce(t.close_pos, 1000000000) > s.pos),
      t -> struct(t.block as block, t.clause as clause))), -1)))"""

_CHAIN = """aggregate(blocks, cast(map() as map<int,array<int>>), (m, b) -> map_concat(m, map(b.block,
    concat(array(b.block), case when b.around is null or b.around.clause = 'from' then array() else coalesce(try_element_at(m, b.around.block), array()) end))))"""

#: FROM entries: the name by which they are known, the table or the block of a derived table.
_ITEMS = f"""filter(transform(ts, t -> case
    when t.clause = 'from' and t.sub_open then named_struct('block', t.block, 'pos', t.pos, 'derived', t.pos + 1, 'owner', cast(null as string),
      'name', if(get(ts, t.close_pos + 1).token = 'as', get(ts, t.close_pos + 2).token, cast(null as string)))
    when t.clause = 'from' and {_IDENT} and t.prev <> 'as' then named_struct('block', t.block, 'pos', t.pos, 'derived', cast(null as int), 'owner', t.token,
      'name', if(get(ts, t.pos + 1).token = 'as', get(ts, t.pos + 2).token, t.token))
    end), x -> x is not null)"""

#: Columns of each FROM entry; null for a table that the catalog lacks. Derived tables look one level in.
_COLUMNS = f"""transform(items, x -> named_struct('block', x.block, 'name', x.name, 'owner', x.owner, 'columns', if(x.derived is null, try_element_at(cols_of, x.owner),
    concat(transform(filter(ts, t -> t.block = x.derived and t.clause = 'select' and ({_IDENT} or (t.token like '%.%' and not t.token like '"%'))), t -> split_part(concat('.', t.token), '.', -1)),
      if(exists(ts, t -> t.block = x.derived and t.clause = 'select' and ((t.token = '*' and t.prev in ('select', 'distinct', ',')) or (t.token = '*' and t.prev like '%.'))),
         flatten(transform(filter(items, y -> y.block = x.derived and y.owner is not null), y -> coalesce(try_element_at(cols_of, y.owner), cast(array() as array<string>)))), cast(array() as array<string>))))))"""

#: The nearest definition of a qualifier, and the nearest block's number of entries with a bare column.
_NEAR = """element_at(concat(array(cast(null as struct<block:int,name:string,owner:string,columns:array<string>>)),
    reverse(flatten(transform(coalesce(try_element_at(chain, t.block), cast(array() as array<int>)), k -> filter(known, x -> x.block = k and x.name = split_part(t.token, '.', 1)))))), -1)"""
_COUNT = """coalesce(get(filter(transform(coalesce(try_element_at(chain, t.block), cast(array() as array<int>)),
    k -> size(filter(known, x -> x.block = k and array_contains(coalesce(x.columns, cast(array() as array<string>)), t.token)))), n -> n > 0), 0), 0)"""
_RULES = f"""filter(transform(ts, t -> case
    when t.token like '%.%' and not t.token like '"%' and not t.token rlike '{tk.NUMBER_PATTERN.replace(chr(92), chr(92) * 2)}' and t.clause is not null then (case
      when {_NEAR} is null then named_struct('rule', 'alias_not_in_scope', 'block', t.block, 'pos', t.pos, 'detail', t.token)
      when {_NEAR}.columns is null or split_part(t.token, '.', 2) = '' or array_contains({_NEAR}.columns, split_part(t.token, '.', 2)) then null
      when {_NEAR}.owner is null then named_struct('rule', 'derived_column_missing', 'block', t.block, 'pos', t.pos, 'detail', t.token)
      when {_NEAR}.owner = {_NEAR}.name then named_struct('rule', 'column_not_in_table', 'block', t.block, 'pos', t.pos, 'detail', t.token)
      else named_struct('rule', 'column_not_in_alias', 'block', t.block, 'pos', t.pos, 'detail', t.token) end)
    when {_IDENT} and t.clause not in ('from', 'limit') and coalesce(get(ts, t.pos + 1).token, '') <> '(' then (case
      when {_COUNT} = 1 then null
      when {_COUNT} > 1 then named_struct('rule', 'ambiguous_column', 'block', t.block, 'pos', t.pos, 'detail', t.token)
      else named_struct('rule', 'unresolved_column', 'block', t.block, 'pos', t.pos, 'detail', t.token) end)
    end), x -> x is not null)"""


def scope_findings(tt: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rule, block, pos, detail) of names that mean nothing or several things in their scope.

    ``tt`` is a token table with ``cols_of`` (table -> columns) on every row, as ``tokens.resolve`` gives it. One row per query is
    gathered by the keys that the token table is partitioned by; queries are short, so nothing grows with the log.
    """
    entry = F.struct(F.col("pos").cast("int").alias("pos"), "token", F.coalesce("prev_tok", F.lit("")).alias("prev"), F.col("block").cast("int").alias("block"), "clause",
                     F.coalesce("sub_open", F.lit(False)).alias("sub_open"), F.col("close_pos").cast("int").alias("close_pos"))
    x = tt.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("ts"), F.first("cols_of").alias("cols_of"))
    for name, body in (("blocks", _BLOCKS), ("chain", _CHAIN), ("items", _ITEMS), ("known", _COLUMNS), ("found", _RULES)):
        x = x.withColumn(name, F.expr(body))
    return x.select(*keys, F.explode("found").alias("f")).select(*keys, "f.rule", "f.block", "f.pos", "f.detail")
