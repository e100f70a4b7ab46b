"""Values drawn from real column content (G11), placed into templates.

A column's literals are its values as text, cut at the first point, empty ones dropped, as often as they occur. The
index holds each different literal of a column once, with the interval [lo, hi) that its occurrences take among the
column's N: a draw of k in [0, N) picks the literal whose interval holds k, so draws follow the frequencies.

* Numbering without one task: literals are dealt to 256 chunks by hash; the chunk totals (256 rows a column) give each
  chunk's offset, a window inside a chunk the rest.
* Counting without text: whole numbers, and fractions by their whole part, are counted as longs and written out once
  for each different one.
* Drawing by an equi-join: a column's numbers are cut into cells of N / (different literals), so a cell holds about one
  literal, and a literal that fills a third of the column spans a third of its cells. Neither a hot literal nor a
  long column meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from skein.functions.hashing import bucket
from skein.session import stored

NUMERIC_AGGS = ("max", "min", "avg", "sum")


def literal_text(col: Column, dt: T.DataType) -> Column:
    """Text of a value up to its first point; fractions are written out, never in powers of ten."""
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        col = col.cast("decimal(38,6)")
    return F.split_part(col.cast("string"), F.lit("."), F.lit(1))


def _literal_key(col: Column, dt: T.DataType) -> tuple[Column, Column]:
    """(whole, text) that stand for a value's literal: the long of which the literal is the text, or else the literal."""
    if isinstance(dt, T.IntegralType):
        return col.cast("long"), F.lit(None).cast("string")
    text = literal_text(col, dt)
    if not isinstance(dt, (T.FloatType, T.DoubleType)):
        return F.lit(None).cast("long"), text
    x = col.cast("double")
    # the whole part is cut off where rounding to six places can't carry into it; -0 and large numbers keep their text
    plain = ((x >= 0) | (x <= -1)) & (F.abs(x) < 1e8) & (F.abs(x) - F.floor(F.abs(x)) < 0.999999)
    number = text.try_cast("long")
    same = F.coalesce(number.cast("string") == text, F.lit(False))
    return F.when(plain, x.cast("long")).when(same, number), F.when(plain, F.lit(None)).when(same, F.lit(None)).otherwise(text)


def literals(tables: dict[str, DataFrame]) -> DataFrame:
    """(col, literal, n) of every column of every table; counted where a column is read, so repeats combine before the shuffle.

    Each column is read on its own: a row's cells as one array of texts cost many times as much.
    """
    names, cells = [], None
    for name, df in tables.items():
        for f in df.schema.fields:
            if isinstance(f.dataType, T.AtomicType):
                whole, text = _literal_key(F.col(f.name), f.dataType)
                one = df.select(F.lit(len(names)).alias("i"), whole.alias("whole"), text.alias("text"))
                cells = one if cells is None else cells.unionAll(one)
                names.append(f"{name}.{f.name}".lower())
    # null and empty literals count for nothing; a filter on them would be pushed down and compute the texts again
    counts = cells.groupBy("i", "whole", "text").agg(F.count(F.when(F.col("whole").isNotNull() | (F.col("text") != ""), 1)).alias("n")).where("n > 0")
    return counts.select(F.get(F.array(*[F.lit(n) for n in names]), F.col("i")).alias("col"), F.coalesce(F.col("whole").cast("string"), "text").alias("literal"), "n")


def content_index(lits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(index, sizes): index (col, cell, literal, lo, hi) and sizes (col, total, width), one row a column."""
    x = lits.withColumn("chunk", F.substring(F.md5("literal"), 1, 2))
    chunks = x.groupBy("col", "chunk").agg(F.sum("n").alias("t"), F.count("*").alias("k"))
    w = Window.partitionBy("col").orderBy("chunk")
    # 256 rows a column, read three times
    chunks = stored(chunks.withColumn("base", F.coalesce(F.sum("t").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    sizes = chunks.groupBy("col").agg(F.sum("t").alias("total"), F.greatest(F.lit(1), F.floor(F.sum("t") / F.sum("k"))).cast("long").alias("width"))
    inside = Window.partitionBy("col", "chunk").orderBy("literal").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("upto", F.sum("n").over(inside)).join(F.broadcast(chunks.join(sizes, "col").select("col", "chunk", "base", "width")), ["col", "chunk"])
    x = x.select("col", "literal", (F.col("base") + F.col("upto") - F.col("n")).alias("lo"), (F.col("base") + F.col("upto")).alias("hi"), "width")
    cells = F.sequence(F.floor(F.col("lo") / F.col("width")), F.floor((F.col("hi") - 1) / F.col("width")))
    return x.select("col", "literal", "lo", "hi", F.explode(cells).alias("cell")), sizes


def sample_values(draws: DataFrame, index: DataFrame, sizes: DataFrame, key: str, salt: str = "g11") -> DataFrame:
    """The rows of ``draws`` (key, col) with ``literal``; a column without content loses its rows."""
    x = draws.join(F.broadcast(sizes), "col").withColumn("k", bucket(salt, key, F.col("total")))
    x = x.withColumn("cell", F.floor(F.col("k") / F.col("width")))
    hit = x.join(index, ["col", "cell"]).where((F.col("k") >= F.col("lo")) & (F.col("k") < F.col("hi")))
    return hit.select(*draws.columns, "literal")


def quoted(literal: Column, ctype: Column, op: Column) -> Column:
    """Literals stand bare for numbers and after an aggregate, in quotes otherwise."""
    bare = ctype.isin("id", "number") | op.isin(*NUMERIC_AGGS)
    return F.when(F.coalesce(bare, F.lit(False)), literal).otherwise(F.concat(F.lit("'"), literal, F.lit("'")))


#: Fold over the tokens: the last column, its type and the aggregate that wraps it, kept for each ``value``.
_SLOTS = """aggregate(toks, struct(0 as pos, cast(null as string) as col, cast(null as string) as ctype, cast(null as string) as op, cast(array() as array<struct<pos:int,col:string,ctype:string,op:string>>) as slots),
  (s, t) -> case
    when map_contains_key(types, t) then struct(s.pos + 1 as pos, t as col, types[t] as ctype, if(s.pos >= 2 and toks[s.pos - 1] = '(', toks[s.pos - 2], null) as op, s.slots as slots)
    when t = 'value' then struct(s.pos + 1 as pos, s.col as col, s.ctype as ctype, s.op as op, concat(s.slots, array(struct(s.pos as pos, s.col as col, s.ctype as ctype, s.op as op))) as slots)
    else struct(s.pos + 1 as pos, s.col as col, s.ctype as ctype, s.op as op, s.slots as slots) end, s -> s.slots)"""


def fill_template(mapped: DataFrame, typed: DataFrame, index: DataFrame, sizes: DataFrame, salt: str = "g13") -> DataFrame:
    """(seed, db_id, mapped, filled, literals) of rows (seed, db_id, mapped), ``mapped`` a template whose slots are columns.

    The column before a ``value`` governs it: after ``count (`` the literal is 1 to 9, after another aggregate a
    bare value of the column, else a value of the column, quoted unless it is a number. ``t.*`` reads the table's first
    column. ``limit_value`` is 1. A row is rejected when one of its values has no column or the column no content.
    """
    types = typed.groupBy("db_id").agg(F.map_from_entries(F.collect_set(F.struct(F.lower(F.concat_ws(".", "table_name", "column_name")).alias("c"), F.col("slot_type").alias("t")))).alias("types"))
    x = mapped.join(F.broadcast(types), "db_id").withColumn("toks", F.split("mapped", " "))
    # read twice: stored, so that neither the draws nor their columns are made again; a row has a number of its own, for seeds may repeat
    x = stored(x.select(F.monotonically_increasing_id().alias("row"), "seed", "db_id", "mapped", F.expr(_SLOTS).alias("slots")))
    key = lambda pos: F.concat(F.col("seed").cast("string"), F.lit(":"), pos.cast("string"))
    slot = x.select("row", "seed", F.explode("slots").alias("s")).select("row", "s.*", key(F.col("s.pos")).alias("key"))
    first = typed.where("first_column is not null").select(F.lower(F.concat(F.col("table_name"), F.lit(".*"))).alias("col"), F.lower(F.concat_ws(".", "table_name", "first_column")).alias("of")).distinct()
    drawn = slot.where("coalesce(op, '') <> 'count' and col is not null").join(F.broadcast(first), "col", "left").withColumn("col", F.coalesce("of", "col")).drop("of")
    drawn = sample_values(drawn, index, sizes, "key", salt).select("row", "pos", quoted(F.col("literal"), F.col("ctype"), F.col("op")).alias("value"))
    drawn = drawn.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("pos", "value"))).alias("drawn"))
    value = lambda s: F.when(s["op"] == "count", (F.lit(1) + bucket(salt + "c", key(s["pos"]), 9)).cast("string")).otherwise(F.try_element_at("drawn", s["pos"]))
    vals = F.map_from_entries(F.transform("slots", lambda s: F.struct(s["pos"], value(s))))
    # the values are a generator's input, like the choices of G14: a filter on them would compute them again
    x = x.join(drawn, "row", "left").select("seed", "db_id", "mapped", "slots", F.explode(F.filter(F.array(vals), lambda m: ~F.exists(F.map_values(m), lambda v: v.isNull()))).alias("vals"))
    text = F.expr("array_join(transform(split(mapped, ' '), (t, i) -> case when t = 'value' then vals[i] when t = 'limit_value' then '1' else t end), ' ')")
    return x.select("seed", "db_id", "mapped", text.alias("filled"), F.expr("transform(slots, s -> vals[s.pos])").alias("literals"))


#: Mark of a literal's place in a text whose columns are named already.
SLOT = "#value"

#: Puts the literals of a row into its slots, the k-th into the k-th.
_PLACED = f"""array_join(aggregate(split(sql, ' '), struct(0 as k, cast(array() as array<string>) as out),
  (s, t) -> if(t = '{SLOT}', struct(s.k + 1 as k, concat(s.out, array(literals[s.k])) as out), struct(s.k as k, concat(s.out, array(t)) as out)), s -> s.out), ' ')"""


def place_literals(df: DataFrame) -> DataFrame:
    """``sql`` with its k-th slot replaced by the k-th of ``literals``; rows with a literal that itself holds a quote are rejected."""
    ends = F.exists("literals", lambda v: F.regexp_replace(v, "^'|'$", "").rlike("['\"]"))
    return df.where(~ends).withColumn("sql", F.expr(_PLACED))


# ------------------------------------------------------------------ G14

# ---- fixed values: choices by column type (thousandths) ----
OP_CHOICES = {
    "key": [("=", 1000)],
    "text": [("=", 700), ("< >", 200), ("like", 100)],
    "others": [("=", 700), ("< >", 200), ("like", 100)],
    "boolean": [("=", 600), ("< >", 400)],
    "number": [("=", 400), (">", 150), ("> =", 100), ("<", 150), ("< =", 100), ("< >", 100)],
    "time": [("=", 400), (">", 150), ("> =", 100), ("<", 150), ("< =", 100), ("< >", 100)],
    "*": [("=", 400), (">", 150), ("> =", 100), ("<", 150), ("< =", 100), ("< >", 100)],
    "phone": [("=", 700), ("< >", 300)],
}
ORDER_CHOICES = [("asc", 500), ("desc", 500)]
AGG_CHOICES = {
    "number": [("avg", 250), ("min", 250), ("max", 250), ("count", 50), ("sum", 200)],
    "time": [("avg", 250), ("min", 250), ("max", 250), ("count", 50), ("sum", 200)],
    **{t: [("count", 1000)] for t in ("key", "text", "*", "boolean", "others")},
}


def _choice_sql(choices: list[tuple[str, int]], draw: str) -> str:
    """CASE over running sums: the choice whose range holds ``draw`` in [0, 1000)."""
    parts, upto = [], 0
    for what, share in choices:
        upto += share
        parts.append(f"when {draw} < {upto} then '{what}'")
    return f"case {' '.join(parts)} end"


def _by_type(table: dict, kind: str, draw: str) -> str:
    return "case " + " ".join(f"when {kind} = '{t}' then {_choice_sql(c, draw)}" for t, c in table.items()) + " end"


def detemplatize(df: DataFrame, typed: DataFrame, salt: str = "g14") -> DataFrame:
    """(seed, db_id, mapped) with ``op``, ``order`` and ``agg`` of a column-mapped coarse template chosen.

    A comparison follows the type of the last column before it (columns named like phone only = and <>), an aggregate
    the type of the next column after it, a direction is even. Row-local: the tokens are one array, the last and next
    columns are looked up in it, and a draw is the md5 bucket of seed and place. Rows with an ``op`` or ``agg`` that no
    column governs are rejected.
    """
    types = typed.groupBy("db_id").agg(F.map_from_entries(F.collect_set(F.struct(F.lower(F.concat_ws(".", "table_name", "column_name")).alias("c"), F.col("slot_type").alias("t")))).alias("types"))
    x = df.join(F.broadcast(types), "db_id").withColumn("toks", F.split("mapped", " "))
    x = x.withColumn("ctype", F.expr("transform(toks, t -> if(map_contains_key(types, t), if(types[t] in ('number', 'time', '*') and lower(t) like '%phone%', 'phone', types[t]), null))"))
    x = x.withColumn("last", F.expr("aggregate(ctype, cast(array() as array<string>), (a, c) -> concat(a, array(coalesce(c, if(size(a) = 0, null, element_at(a, -1))))))"))
    x = x.withColumn("next", F.expr("reverse(aggregate(reverse(ctype), cast(array() as array<string>), (a, c) -> concat(a, array(coalesce(c, if(size(a) = 0, null, element_at(a, -1)))))))"))
    draw = f"pmod(cast(conv(substring(md5(concat('{salt}:', seed, ':', i)), 1, 8), 16, 10) as bigint), 1000)"
    agg = {**AGG_CHOICES, "phone": AGG_CHOICES["number"]}
    # the choices are a generator's input: a filter on them would be pushed down and compute last and next again for every token
    x = x.select("seed", "db_id", F.explode(F.filter(F.array(F.expr(f"""transform(toks, (t, i) -> case when t = 'op' then {_by_type(OP_CHOICES, "last[i]", draw)}
        when t = 'order' and coalesce(get(toks, i + 1), '') <> 'by' then {_choice_sql(ORDER_CHOICES, draw)} when t = 'agg' then {_by_type(agg, "next[i]", draw)} else t end)""")), lambda o: ~F.exists(o, lambda t: t.isNull()))).alias("out"))
    return x.select("seed", "db_id", F.array_join("out", " ").alias("mapped"))
