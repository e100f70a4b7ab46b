"""Document fingerprints as invertible Bloom lookup sketches, in DataFrame and SQL functions only.

A text's paragraphs (lines, cut further at sentence ends) are hashed to 64-bit digests; the distinct digests go
into a sketch of three tables of cells, each cell holding a count, the xor of its digests and the xor of their
check hashes. Two sketches subtract cell by cell; cells that then hold one digest are peeled, round by round, until
nothing is left and the differing digests are known: with D of them, likeness is (nA + nB - D) / (nA + nB + D),
the Jaccard index of the two digest sets. Where peeling stops early, larger sketches follow: the digests are dealt
into blocks, as many as the second moment of the counts asks for, each with three tables of its own; blocks that
still do not peel are dealt again, until every differing digest is known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cells of each of the three tables of the fingerprint and of each block.
CELLS = 16
ROUNDS = 10
#: Differing digests that a block is meant for, and the most blocks that one block is dealt into at a time.
LOAD, FAN = 14, 32
#: Times that blocks are dealt: each deals anew by other bits, at least in two, so that two digests stay together
#: through all of them with a probability of 2^-64.
DEALS = 64
#: Slices of the document order for each shuffle partition.
SLICES = 2

_CELL = "struct<c:int,k:bigint,h:bigint>"


def digests(text: Column) -> Column:
    """Distinct 64-bit digests of the paragraphs of a text."""
    parts = F.filter(F.split(text, r"\n+|(?<=[.!?]) +"), lambda p: p != "")
    return F.array_distinct(F.transform(parts, lambda p: F.xxhash64(p)))


def _slot(key: str, cells: int, table: int) -> str:
    """Cell of a digest in a table, among the cells of all tables: other bits for each table."""
    return f"(cast(shiftrightunsigned({key}, {16 * table}) & {cells - 1} as int) + {cells * table})"


def placed(keys: str, cells: int) -> str:
    """SQL: for each table an array of (cell, digest, check hash) of the digests."""
    return "array(" + ", ".join(f"transform({keys}, e -> struct({_slot('e', cells, t)} as s, e as k, xxhash64(e, 7L) as h))" for t in range(3)) + ")"


def sketch(at: str, cells: int) -> str:
    """SQL: cells of the three tables from ``placed`` digests."""
    return f"""flatten(transform({at}, (tab, t) -> transform(transform(sequence(t * {cells}, t * {cells} + {cells - 1}), i -> filter(tab, e -> e.s = i)),
        x -> cast(struct(size(x) as c, aggregate(x, 0L, (a, e) -> a ^ e.k) as k, aggregate(x, 0L, (a, e) -> a ^ e.h) as h) as {_CELL}))))"""


def _peeled(diff: str, cells: int) -> str:
    """SQL: (cells left, digests found) of a difference; each round finds the pure cells, then clears them."""
    spots = ", ".join(f"{_slot('y.k', cells, t)} as s{t}" for t in range(3))
    pure = f"transform(array_distinct(transform(filter(s.cells, x -> abs(x.c) = 1 and xxhash64(x.k, 7L) = x.h), x -> struct(x.c as c, x.k as k))), y -> struct(y.c as c, y.k as k, xxhash64(y.k, 7L) as h, {spots}))"
    clear = f"""transform(transform(s.cells, (x, i) -> struct(x as x, filter(s.pure, p -> p.s0 = i or p.s1 = i or p.s2 = i) as y)), z -> if(size(z.y) = 0, z.x, cast(struct(
        z.x.c - aggregate(z.y, 0, (a, p) -> a + p.c) as c, aggregate(z.y, z.x.k, (a, p) -> a ^ p.k) as k,
        aggregate(z.y, z.x.h, (a, p) -> a ^ p.h) as h) as {_CELL})))"""
    kind = f"struct<cells:array<{_CELL}>,pure:array<struct<c:int,k:bigint,h:bigint,s0:int,s1:int,s2:int>>,n:int,on:boolean>"
    return f"""aggregate(sequence(1, {2 * ROUNDS}), cast(struct({diff} as cells, array() as pure, 0 as n, true as on) as {kind}), (s, r) ->
        if(not s.on, s, if(r % 2 = 1, cast(struct(s.cells as cells, {pure} as pure, s.n as n, true as on) as {kind}),
        cast(struct({clear} as cells, array() as pure, s.n + size(s.pure) as n, size(s.pure) > 0 as on) as {kind}))))"""


def _minus(a: str, b: str) -> str:
    """SQL: difference of two sketches, cell by cell."""
    return f"zip_with({a}, {b}, (x, y) -> cast(struct(x.c - y.c as c, x.k ^ y.k as k, x.h ^ y.h as h) as {_CELL}))"


def _whole(peeled: str) -> str:
    """SQL: whether a peeling left nothing."""
    return f"forall({peeled}.cells, x -> x.c = 0 and x.k = 0 and x.h = 0)"


def _dealt(keys_a: str, keys_b: str, diff: str, deal: str) -> str:
    """SQL: two digest arrays dealt into blocks, as many as the second moment of the counts of their difference asks for."""
    moment = f"(aggregate({diff}, 0D, (m, x) -> m + cast(x.c as double) * x.c) / 3 - pow(size({keys_a}) - size({keys_b}), 2) / {CELLS}) / (1 - 1D / {CELLS})"
    fan = f"cast(greatest(2D, least({FAN}D, ceil(({moment}) / {LOAD}))) as int)"
    part = "filter({}, e -> pmod(xxhash64(e, {}), f) = j)"
    return f"flatten(transform(array({fan}), f -> transform(sequence(0, f - 1), j -> struct({part.format(keys_a, deal)} as a, {part.format(keys_b, deal)} as b))))"


def _differing(keys_a: str, keys_b: str, diff: str) -> str:
    """SQL: number of digests in one of two arrays only, by sketches of blocks; blocks that do not peel are dealt again."""
    kind = "struct<todo:array<struct<a:array<bigint>,b:array<bigint>>>,n:int>"
    minus = _minus(sketch(placed("g.a", CELLS), CELLS), sketch(placed("g.b", CELLS), CELLS))
    tried = f"transform(transform(v.todo, g -> struct(g.a as a, g.b as b, {minus} as d)), g -> struct(g.a as a, g.b as b, g.d as d, {_peeled('g.d', CELLS)} as p))"
    left = f"flatten(transform(filter(w, g -> not {_whole('g.p')}), g -> {_dealt('g.a', 'g.b', 'g.d', 'deal')}))"
    found = f"aggregate(filter(w, g -> {_whole('g.p')}), v.n, (m, g) -> m + g.p.n)"
    done = f"""aggregate(sequence(1, {DEALS}), cast(struct({_dealt(keys_a, keys_b, diff, '0')} as todo, 0 as n) as {kind}), (v, deal) ->
        if(size(v.todo) = 0, v, element_at(transform(array({tried}), w -> cast(struct({left} as todo, {found} as n) as {kind})), 1)))"""
    return f"element_at(transform(array({done}), v -> if(size(v.todo) = 0, v.n, cast(raise_error('digests left after all deals') as int))), 1)"


def _compare(df: DataFrame, name: str, a: str, b: str, keys_a: str, keys_b: str) -> DataFrame:
    """Adds column ``name``: likeness of the sketches in columns a and b over digest arrays keys_a and keys_b."""
    both = f"(size({keys_a}) + size({keys_b}))"
    out = df.withColumn("_d", F.expr(_minus(a, b)))
    out = out.withColumn("_p", F.expr(_peeled("_d", CELLS)))
    out = out.withColumn("_n", F.expr(f"if({_whole('_p')}, _p.n, {_differing(keys_a, keys_b, '_d')})"))
    return out.withColumn(name, F.expr(f"if({both} = 0, 1D, cast({both} - _n as double) / ({both} + _n))")).drop("_d", "_p", "_n")


def text_of(sk: str, keys: str) -> str:
    """SQL: a sketch as a string: number of digests, then the cells."""
    return f"concat(size({keys}), ':', array_join(transform({sk}, x -> if(x.c = 0, '', concat(x.c, '.', hex(x.k), '.', hex(x.h)))), ','))"


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(slice, doc_id, text, next_text): the text of the next row by (doc_id, text); the last row is followed by the first.

    Rows without doc_id come first. The order is cut into slices at sampled ids; the rows of a slice's first id also
    go to the slice before, and those of the very first id to the last one, so no window spans more than a slice.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    rows = docs.select(key.alias("key"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200")) * SLICES
    shares = [i / n for i in range(n)]
    found = rows.agg(F.percentile_approx("key", shares, 100 * n).alias("s"), F.min("key").alias("m")).first()
    cuts = sorted({*(found.s or []), *([found.m] if found.m is not None else [])})  # at most n + 1 ids
    at = F.lit(cuts or [0]).cast("array<bigint>")
    own = (F.size(F.filter(at, lambda c: c <= F.col("key"))) - 1).alias("slice")
    first = F.array_contains(at, F.col("key"))
    rows = rows.withColumn("slice", own).withColumn("guard", F.explode(F.when(first, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    rows = rows.withColumn("late", F.col("guard") & (F.col("slice") == 0)).withColumn("slice", F.when(~F.col("guard"), F.col("slice")).when(F.col("slice") == 0, len(cuts) - 1).otherwise(F.col("slice") - 1))
    w = Window.partitionBy("slice").orderBy("late", "key", "text", "guard")
    return rows.withColumn("next_text", F.lead("text").over(w)).where("not guard").select("slice", "doc_id", "text", "next_text")


def fingerprint(df: DataFrame, text_col: str, name: str) -> DataFrame:
    """Adds ``name`` (string), ``name_keys`` and ``name_cells`` of a text column without nulls."""
    out = df.withColumn(f"{name}_keys", digests(F.col(text_col)))
    out = out.withColumn(f"{name}_cells", F.expr(placed(f"{name}_keys", CELLS)))
    out = out.withColumn(f"{name}_cells", F.expr(sketch(f"{name}_cells", CELLS)))
    return out.withColumn(name, F.expr(text_of(f"{name}_cells", f"{name}_keys")))


def compare_versions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    edited: the text whose last floor(n / 4) characters gave way to the first as many (or all) of the next row's.
    Null and empty texts have no digest; two texts without digests are alike (1), one without and one with are not (0).
    A table of one row is its own next. An empty table gives an empty result.
    """
    df = with_next(docs, id_col, text_col).withColumn("n_chars", F.length("text").cast("long"))
    q = "cast(n_chars div 4 as int)"
    df = df.withColumn("edited", F.expr(f"concat(substring(text, 1, cast(n_chars - {q} as int)), substring(next_text, 1, {q}))"))
    for text, name in (("text", "fingerprint"), ("edited", "edited_fingerprint"), ("next_text", "next")):
        df = fingerprint(df, text, name)
    df = _compare(df, "near_edited", "fingerprint_cells", "edited_fingerprint_cells", "fingerprint_keys", "edited_fingerprint_keys")
    df = _compare(df, "near_next", "fingerprint_cells", "next_cells", "fingerprint_keys", "next_keys")
    return df.select("doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
