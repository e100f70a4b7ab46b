"""Template statistics and query generation (T16, G1-G10, G12, G16; G11, G13, G14 are in ``content``).

Templates are built from the resolved token table (one partitioning by query
key). Sampling is deterministic: every draw is an md5 bucket of (salt, seed).
Drawing a template by probability is a range join on the cumulative
distribution, made an equi-join by cutting [0, 1) into fixed buckets: a seed
only meets the few templates whose interval overlaps its bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.functions.hashing import bucket
from skein.operators import tokens as tk
from skein.session import cut_lineage, stored

N_BUCKETS = 1024


def no_from_tokens(rt: DataFrame, keys: list[str]) -> DataFrame:
    """The no-FROM form: FROM/JOIN/ON dropped, columns qualified as ``table.column``.

    ``*`` is qualified by the first table of its block; literals become
    ``value`` (``limit_value`` after LIMIT). Output keeps ``pos`` for order.
    """
    tok = F.col("token")
    derived = F.coalesce(F.col("sub_open") | F.col("sub_close"), F.lit(False))  # a derived table keeps its parentheses
    x = rt.filter(~F.col("clause").isin("from", "on") | F.col("clause").isNull() | derived)
    star = F.concat(F.try_element_at("block_tables", F.lit(1)), F.lit(".*"))
    out = (F.when(F.col("col_id") == "*", star)
           .when(F.col("col_id").isNotNull(), F.col("col_id"))
           .when(tk.is_literal(tok) & (F.col("clause") == "limit"), F.lit("limit_value"))
           .when(tk.is_literal(tok), F.lit("value"))
           .otherwise(tok))
    return x.select(*keys, "pos", "block", out.alias("ntok"), F.col("col_id").isNotNull().alias("is_col"))


def templatize(nf: DataFrame, keys: list[str], typed: DataFrame) -> DataFrame:
    """G1: each distinct column -> ``<type>_col_<i>`` by first appearance within its type.

    ``typed`` = C2 typed columns (metadata, broadcast after a size check).
    Output: keys + template.
    """
    tmap = (typed.select(F.lower(F.concat_ws(".", "table_name", "column_name")).alias("ntok"),
                                           F.col("slot_type").alias("ctype")))
    x = nf.join(tmap, "ntok", "left")
    wc = Window.partitionBy(*keys, "ntok")
    x = x.withColumn("first_pos", F.when(F.col("ctype").isNotNull(), F.min("pos").over(wc)))
    wt = Window.partitionBy(*keys, "ctype").orderBy("first_pos")
    x = x.withColumn("idx", F.when(F.col("ctype").isNotNull(), F.dense_rank().over(wt) - 1))
    t = F.when(F.col("ctype").isNotNull(), F.concat("ctype", F.lit("_col_"), F.col("idx").cast("string"))) \
        .otherwise(F.col("ntok"))
    x = x.withColumn("t", t)
    g = x.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "t"))).alias("ts"))
    return g.select(*keys, F.array_join(F.transform("ts", lambda s: s["t"]), " ").alias("template"))


COARSE_AGG = ["max", "min", "count", "sum", "avg"]
COARSE_OP = ["=", "!=", "<>", ">", "<", ">=", "<=", "like"]


def templatize_coarse(tpl: DataFrame, keys: list[str]) -> DataFrame:
    """Slots other than keys and stars -> ``gen_col_<i>``, numbered in the order of their names; aggregates -> ``agg``,
    asc/desc -> ``order``, comparisons -> ``op`` (two in a row are one)."""
    toks = F.split("template", " ")
    gens = F.array_sort(F.array_distinct(F.filter(toks, lambda t: t.contains("_col_") & ~t.contains("key") & ~t.contains("*"))))
    folded = F.transform(toks, lambda t: F.when(F.array_contains(gens, t), F.concat(F.lit("gen_col_"), (F.array_position(gens, t) - 1).cast("string")))
                         .when(t.isin(*COARSE_AGG), F.lit("agg")).when(t.isin("asc", "desc"), F.lit("order")).when(t.isin(*COARSE_OP), F.lit("op")).otherwise(t))
    return tpl.select(*keys, F.replace(F.array_join(folded, " "), F.lit(" op op "), F.lit(" op ")).alias("template"))


def template_stats(tpl: DataFrame, weight: str | None = None) -> DataFrame:
    """(template, n, p) relative frequencies (partial aggregation, one-row total)."""
    w = F.col(weight) if weight else F.lit(1)
    counts = tpl.groupBy("template").agg(F.sum(w).cast("long").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(total).select("template", "n", (F.col("n") / F.col("total")).alias("p"))


def transition_stats(turn_tpl: DataFrame) -> DataFrame:
    """p(prev) and p(curr | prev); prev = last valid template earlier in the dialogue, ``none`` first.

    ``turn_tpl``: (conv_id, turn_idx, template) with NULL for invalid turns.
    """
    w = Window.partitionBy("conv_id").orderBy("turn_idx").rowsBetween(Window.unboundedPreceding, -1)
    x = turn_tpl.withColumn("prev", F.coalesce(F.last("template", ignorenulls=True).over(w), F.lit("none"))) \
        .filter(F.col("template").isNotNull())
    pair = x.groupBy("prev", F.col("template").alias("curr")).agg(F.count("*").alias("n"))
    per_prev = pair.groupBy("prev").agg(F.sum("n").alias("n_prev"))
    total = per_prev.agg(F.sum("n_prev").alias("total"))
    return pair.join(per_prev, "prev").crossJoin(total).select(
        "prev", "curr", "n", (F.col("n_prev") / F.col("total")).alias("p_prev"),
        (F.col("n") / F.col("n_prev")).alias("p_curr_given_prev"))


def supported(stats: DataFrame, support: DataFrame) -> DataFrame:
    """(template, db_id) where the database has every placeholder slot (relational division)."""
    slots = stats.select("template", F.explode(F.array_distinct(F.filter(F.split("template", " "),
                                                                        lambda t: t.contains("_col_")))).alias("slot"))
    need = slots.groupBy("template").agg(F.count("*").alias("need"))
    have = slots.join(support, "slot").groupBy("template", "db_id").agg(F.count("*").alias("have"))
    no_slot = stats.select("template").join(need, "template", "left_anti").crossJoin(
        support.select("db_id").distinct())
    return have.join(need, "template").filter(F.col("have") == F.col("need")).select("template", "db_id") \
        .unionByName(no_slot.select("template", "db_id"))


def cumulative(stats: DataFrame, order: str = "template") -> DataFrame:
    """Cumulative integer intervals [lo_n, hi_n) of template counts, cut into equi-join buckets.

    A seed with 32-bit hash h draws the template whose interval holds
    h * total / 2^32 -- compared in exact integer arithmetic.
    """
    w = Window.orderBy(order)  # the stats table has one row per template
    c = stats.select("template", "n", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("hi_n"))
    total = c.agg(F.sum("n").alias("total"))
    c = c.crossJoin(total).withColumn("lo_n", F.col("hi_n") - F.col("n"))
    first = F.floor(F.col("lo_n") * N_BUCKETS / F.col("total")).cast("int")
    last = F.least(F.floor(F.col("hi_n") * N_BUCKETS / F.col("total")), F.lit(N_BUCKETS - 1)).cast("int")
    return c.select("*", F.explode(F.sequence(first, last)).alias("bkt"))


def _hash32(salt: str, key: str):
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt + ":"), F.col(key).cast("string"))), 1, 8), 16, 10).cast("long")


def sample_template_first(seeds: DataFrame, stats: DataFrame, supp: DataFrame, salt: str = "g7") -> DataFrame:
    """Template drawn by p, then a supporting database uniformly (sorted list, md5 index)."""
    s = seeds.select("seed", _hash32(salt, "seed").alias("h"))
    s = s.withColumn("bkt", F.shiftright("h", 22).cast("int"))  # 2^32 / N_BUCKETS
    cum = stored(cumulative(stats))  # of known size: seeds are not shuffled to meet a few templates
    pos = F.col("h") * F.col("total")
    x = s.join(cum, "bkt").filter((pos >= F.col("lo_n") * F.lit(1 << 32)) & (pos < F.col("hi_n") * F.lit(1 << 32)))
    dbs = supp.groupBy("template").agg(F.array_sort(F.collect_list("db_id")).alias("dbs"))
    x = x.join(dbs, "template")
    pick = F.element_at("dbs", (bucket(salt + "db", "seed", F.size("dbs")) + 1).cast("int"))
    return x.select("seed", "template", pick.alias("db_id"), F.size("dbs").alias("n_supported"))


def assign_columns(draws: DataFrame, typed: DataFrame, salt: str = "g10") -> DataFrame:
    """Random one-to-one placeholder -> column within type: rank columns by md5(seed || column).

    Row-local: a database's columns are metadata, one row of arrays by type; a seed sorts them in its own row. A seed that is
    drawn several times has each column that often; its draws are of one database.
    """
    x = draws.groupBy("seed", "db_id").agg(F.count("*").alias("times")).join(F.broadcast(_columns_by_type(typed)), "db_id")
    return x.select("seed", F.inline(_assigned("types", salt)))


def _columns_by_type(typed: DataFrame) -> DataFrame:
    """(db_id, types): per database its columns by slot type, one row of metadata."""
    col = F.struct(F.lower(F.concat_ws(".", "table_name", "column_name")).alias("col"), "table_name", "column_name")
    per_type = typed.groupBy("db_id", F.col("slot_type").alias("ctype")).agg(F.sort_array(F.collect_list(col)).alias("cols"))
    return per_type.groupBy("db_id").agg(F.sort_array(F.collect_list(F.struct("ctype", "cols"))).alias("types"))


def _assigned(types: str, salt: str):
    """Array of (slot, col, table_name, column_name, ctype): the columns of each of ``types`` in the seed's order, each ``times`` times."""
    return F.expr(f"""flatten(transform({types}, t -> transform(
        sort_array(flatten(transform(t.cols, c -> array_repeat(struct(md5(concat('{salt}:', seed, '|', c.col)) as h, c.col, c.table_name, c.column_name), int(times))))),
        (e, i) -> struct(concat(t.ctype, '_col_', i) as slot, e.col, e.table_name, e.column_name, t.ctype))))""")


def count_literal(seed_col: str = "seed", salt: str = "g12"):
    """The literal after ``count(``: 1..9."""
    return (F.lit(1) + bucket(salt, seed_col, 9)).cast("string")


def map_columns(draws: DataFrame, typed: DataFrame, salt: str = "g10") -> DataFrame:
    """(seed, db_id, mapped): the placeholders of a drawn template replaced by the columns that ``assign_columns`` gives them.

    In the draw's own row, for the types that its template holds; a draw of a database without columns is lost.
    """
    x = draws.withColumn("times", F.count("*").over(Window.partitionBy("seed", "db_id"))).join(F.broadcast(_columns_by_type(typed)), "db_id")
    x = x.withColumn("toks", F.split("template", " "))
    x = x.withColumn("held", F.expr("filter(types, t -> exists(toks, w -> startswith(w, concat(t.ctype, '_col_'))))"))
    cols = F.map_from_entries(F.transform(_assigned("held", salt), lambda e: F.struct(e["slot"], e["col"])))
    mapped = F.transform(F.array(F.struct("toks", cols.alias("cols"))), lambda z: F.array_join(
        F.transform(z["toks"], lambda t: F.coalesce(F.try_element_at(z["cols"], t), t)), " "))
    return x.select("seed", "db_id", F.element_at(mapped, 1).alias("mapped"))


def coarse_tokens(df: DataFrame) -> DataFrame:
    """``mapped`` with aggregates, directions and comparisons folded to ``agg``, ``order`` and ``op``."""
    t = F.transform(F.split("mapped", " "), lambda t: F.when(t.isin(*COARSE_AGG), "agg").when(t.isin("asc", "desc"), "order").when(t.isin(*COARSE_OP), "op").otherwise(t))
    return df.withColumn("mapped", F.array_join(t, " "))


def intervals(weights: DataFrame, group: list[str], item: str) -> DataFrame:
    """Intervals [lo_n, hi_n) of the items' counts ``n`` inside each group, cut into equi-join buckets as in ``cumulative``.

    One row per group and item (templates, databases): far smaller than the seeds that draw from it.
    """
    w = Window.partitionBy(*group).orderBy(item)
    c = weights.select(*group, item, "n", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("hi_n"),
                       F.sum("n").over(Window.partitionBy(*group)).alias("total")).withColumn("lo_n", F.col("hi_n") - F.col("n"))
    first = F.floor(F.col("lo_n") * N_BUCKETS / F.col("total")).cast("int")
    last = F.least(F.floor(F.col("hi_n") * N_BUCKETS / F.col("total")), F.lit(N_BUCKETS - 1)).cast("int")
    return c.select("*", F.explode(F.sequence(first, last)).alias("bkt"))


def draw_weighted(seeds: DataFrame, weights: DataFrame, group: list[str], item: str, salt: str) -> DataFrame:
    """``seeds`` (seed, group columns, ...) with one ``item`` of their group, drawn by its share of the group's counts."""
    s = seeds.withColumn("h", _hash32(salt, "seed")).withColumn("bkt", F.shiftright("h", 22).cast("int"))
    pos = F.col("h") * F.col("total")
    x = s.join(intervals(weights, group, item), [*group, "bkt"])
    x = x.filter((pos >= F.col("lo_n") * F.lit(1 << 32)) & (pos < F.col("hi_n") * F.lit(1 << 32)))
    return x.select(*seeds.columns, item)


def sample_db_first(seeds: DataFrame, stats: DataFrame, supp: DataFrame, salt: str = "g8") -> DataFrame:
    """A database drawn evenly, then a template among those it supports, by its share of their counts."""
    dbs = supp.agg(F.array_sort(F.collect_set("db_id")).alias("dbs"))  # one row, as long as there are databases
    s = seeds.select("seed").join(F.broadcast(dbs)).select("seed", F.element_at("dbs", (bucket(salt + "db", "seed", F.size("dbs")) + 1).cast("int")).alias("db_id"))
    return draw_weighted(s, supp.join(stats.select("template", "n"), "template"), ["db_id"], "template", salt)


def sample_pairs(seeds: DataFrame, transitions: DataFrame, supp: DataFrame, salt: str = "g9") -> DataFrame:
    """Previous template by p(prev), current one by p(curr | prev), then evenly a database that supports both.

    Two chained draws; support is looked up per template (arrays of databases) and intersected row by row, so
    templates never meet databases in pairs. ``none`` needs no support. Seeds without a common database are rejected.
    """
    prevs = transitions.groupBy("prev").agg(F.sum("n").alias("n"))
    x = draw_weighted(seeds.select("seed"), prevs, [], "prev", salt + "p")
    x = draw_weighted(x, transitions.select("prev", "curr", "n"), ["prev"], "curr", salt + "c")
    dbs = supp.groupBy("template").agg(F.array_sort(F.collect_list("db_id")).alias("dbs"))
    x = x.join(dbs.select(F.col("template").alias("curr"), F.col("dbs").alias("d_curr")), "curr")
    x = x.join(dbs.select(F.col("template").alias("prev"), F.col("dbs").alias("d_prev")), "prev", "left")
    both = F.when(F.col("prev") == "none", F.col("d_curr")).otherwise(F.array_intersect("d_curr", F.coalesce("d_prev", F.array().cast("array<string>"))))
    x = x.withColumn("both", both).filter(F.size("both") > 0)
    pick = F.element_at("both", (bucket(salt + "db", "seed", F.size("both")) + 1).cast("int"))
    return x.select("seed", "prev", "curr", pick.alias("db_id"), F.size("both").alias("n_supported"))


def top_up(make, n: int, first: int | None = None, rounds: int = 8) -> DataFrame:
    """Exactly ``n`` kept rows, those of the least seeds.

    ``make(lo, hi)`` draws the seeds lo <= seed < hi and returns the rows it keeps (with ``seed``). Each round asks for as many
    seeds as the share kept so far says, with a tenth more; after ``rounds`` rounds, or a round that keeps nothing, it raises.
    """
    kept, have, lo, size = None, 0, 0, first or max(64, n + n // 2)
    for _ in range(rounds):
        part = cut_lineage(make(lo, lo + size))
        kept = part if kept is None else kept.unionByName(part)
        found = part.count()
        have, lo = have + found, lo + size
        if have >= n:
            return kept.orderBy("seed").limit(n)
        if not found:
            break
        size = int(1.1 * (n - have) * lo / have) + 64
    raise ValueError(f"{have} of {n} rows were kept after {lo} draws")


def error_weights(scored: DataFrame, template: str, score: str, example: str, order: str,
                  min_n: int = 2, max_acc: float = 0.98, temperature: float = 20.0) -> DataFrame:
    """Templates seen more than ``min_n`` times with mean score below ``max_acc``;
    weight = n * (1 - acc), probability = softmax(weight / temperature); last example kept.

    The per-template aggregate combines map-side; the softmax normaliser is a
    scalar subquery over the (template-sized) result, not a one-partition window.
    """
    ts = scored.groupBy(template).agg(F.count("*").alias("n"), F.avg(score).alias("acc"),
                                      F.max_by(example, order).alias("example"))
    kept = ts.filter((F.col("n") > min_n) & (F.col("acc") < max_acc)).withColumn("w", F.col("n") * (1 - F.col("acc")))
    # template-sized: written once so the two scalar subqueries and the result do not recompute the scoring
    kept = cut_lineage(kept)
    top = kept.select(F.max("w")).scalar()
    total = kept.select(F.sum(F.exp((F.col("w") - top) / temperature))).scalar()
    p = F.exp((F.col("w") - top) / temperature) / total
    return kept.select(template, "n", F.round("acc", 6).alias("acc"), F.round("w", 6).alias("weight"),
                       F.round(p, 9).alias("p"), "example")
