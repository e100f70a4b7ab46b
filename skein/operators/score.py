"""Scoring predicted against gold queries.

Input: a frame of (key, gold, pred) query strings. Both sides go through the
same token -> unit -> block pipeline keyed by (key, side); gold and pred are
then paired by *grouping* on the key (multiset overlaps are counts inside one
row), so after the one repartition of the query rows nothing shuffles and
nothing is written until the tiny final report: tokens, units and blocks only
stream through windows and groups of one stage.

Semantics follow the ten-category component evaluator: all-or-nothing
category scores, literals and DISTINCT ignored, LIMIT value ignored, the
conjunction set compared as a set, set-operation operands compared by exact
match, unparsable predictions scored as the empty query, unparsable gold
rows skipped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.operators import catalog as co
from skein.operators import tokens as tk
from skein.session import by_key, cut_lineage

CATEGORIES = ["select", "select(no AGG)", "where", "where(no OP)", "group(no Having)", "group", "order",
              "and/or", "IUEN", "keywords"]
LEVELS = ["easy", "medium", "hard", "extra", "all"]
_AGG_RE = "^(" + "|".join(tk.AGG_WORDS) + ")$"


# ------------------------------------------------------------ unit table

def _keys(key: str) -> list[str]:
    return [key, "side", "mult"]


def query_tokens(qs: DataFrame, key: str, cat_columns: DataFrame, sides=("gold", "pred"), rows_per_part: int | None = None) -> DataFrame:
    """Stack the query sides, tokenize, build the resolved token table with units.

    ``qs`` has ``key`` and one string column per side. The query rows are
    repartitioned once by ``key``; every later window / aggregate is keyed by
    ``key`` first and reuses that partitioning. With ``rows_per_part`` the
    partitions grow in number with the rows, so that a partition's tokens are
    sorted in memory, and ``mult`` tells how many rows hold the key.
    """
    stacked = None
    for s in sides:
        part = qs.select(F.col(key), F.lit(s).alias("side"), F.col(s).alias("sql"))
        stacked = part if stacked is None else stacked.unionByName(part)
    stacked = tk.tokenize(by_key(stacked, key, rows_per_part=rows_per_part), "sql")
    keys = [key, "side"]
    if rows_per_part:
        stacked = stacked.withColumn("mult", F.count("*").over(Window.partitionBy(*keys)))
        keys = _keys(key)
    tt = tk.token_table(stacked.filter(F.col("toks").isNotNull()), keys)
    rt = tk.resolve(tt, keys, cat_columns).drop("cols_of")
    return tk.with_units(rt, keys), stacked.select(key, "side", "sql", "toks")


def fk_map(cat) -> DataFrame:
    """(col, rep): each column of a foreign-key class with more than one member -> the class's column of least id."""
    name = cat.columns.filter(F.col("column_id") > 0).select("db_id", "column_id", F.concat_ws(".", F.lower("table_name"), F.lower("column_name")).alias("name"))
    rep = name.select("db_id", F.col("column_id").alias("rep_id"), F.col("name").alias("rep"))
    return co.fk_canonical(cat).join(name, ["db_id", "column_id"]).join(rep, ["db_id", "rep_id"]).select(F.col("name").alias("fk_col"), F.col("rep").alias("fk_rep"))


def canonical_columns(ut: DataFrame, key: str, fks: DataFrame) -> DataFrame:
    """Columns become their class's representative in ``norm``, where the column's table stands in the FROM of the top block.

    Set-operation operands follow the top block's tables as well; nested queries keep their columns. ``fks`` is the map of
    one database (metadata). DISTINCT flags and literals are dropped by ``norm`` already (E1).
    """
    w = Window.partitionBy(key, "side").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.first(F.when((F.col("sdepth") == 0) & (F.col("set_path") == "") & (F.col("block") >= 0), F.col("block_tables")), ignorenulls=True).over(w)
    x = ut.withColumn("top_tables", first).join(F.broadcast(fks), F.col("col_id") == F.col("fk_col"), "left")
    swap = F.col("fk_rep").isNotNull() & (F.col("sdepth") == 0) & F.array_contains("top_tables", F.substring_index("col_id", ".", 1))
    return x.withColumn("norm", F.when((F.col("norm") == F.col("col_id")) & F.coalesce(swap, F.lit(False)), F.col("fk_rep")).otherwise(F.col("norm"))).drop("top_tables", "fk_col", "fk_rep")


def _valid_parts() -> list[Column]:
    """What parse validity needs of any group of a query's tokens; ``_merged_valid`` joins the groups' parts."""
    tok = F.col("token")
    at = F.struct("pos", "token")
    return [
        F.min(F.col("resolved").cast("int")).alias("r"),
        F.min("depth").alias("min_depth"),
        F.sum(F.when(tok == "(", 1).when(tok == ")", -1).otherwise(0)).alias("bal"),
        F.max(F.when((tok == "limit") & ~F.coalesce(F.col("next_tok"), F.lit("")).rlike("^[0-9]+$"), 1)
              .otherwise(0)).alias("bad_limit"),
        F.max(at).alias("last_at"),
        F.min(at).alias("first_at"),
        F.max(F.when(F.col("clause").isNull(), 1).otherwise(0)).alias("no_clause"),
        F.max(F.when(F.col("is_table") & (F.col("clause") == "from"), 1).otherwise(0)).alias("has_table"),
    ]


def _merged_valid(of=lambda c: c) -> Column:
    """Validity from parts; ``of`` turns an aggregate into a window expression where one is wanted.

    Unparsable = odd quotes, unbalanced parentheses, an unknown table or
    column, LIMIT without a number, not starting with SELECT, or ending in a
    keyword/operator.
    """
    tail = [*tk.CLAUSE_WORDS, *tk.CMP_WORDS, "and", "or", ",", "(", "by", "as", "not", "distinct"]
    return ((of(F.min("r")) == 1) & (of(F.min("min_depth")) >= 0) & (of(F.sum("bal")) == 0) & (of(F.max("bad_limit")) == 0)
            & (of(F.min("first_at"))["token"] == "select") & ~of(F.max("last_at"))["token"].isin(*tail)
            & (of(F.max("no_clause")) == 0) & (of(F.max("has_table")) == 1))


def validity(ut: DataFrame, stacked: DataFrame, key: str) -> DataFrame:
    """E18 helper: parse validity, one row per (key, side) and one more, invalid, per input row (odd quotes leave only that)."""
    keys = [key, "side"]
    per = ut.groupBy(*keys).agg(*_valid_parts()).groupBy(*keys).agg(F.coalesce(_merged_valid(), F.lit(False)).alias("valid"))
    return per.unionByName(stacked.select(*keys, F.lit(False).alias("valid")))


def unit_groups(ut: DataFrame, key: str) -> DataFrame:
    """Tokens by (key, side, block, clause, unit): the unit's signatures, the parts of validity and of ORDER BY's direction.

    A subquery's fingerprint is the md5 of its span's normalised tokens, read
    from the query's tokens gathered by a window.
    """
    keys = _keys(key)
    tok = F.col("token")
    fn = (F.when(F.col("sub_open"), F.lit("(")).when(F.col("sub_close"), F.lit(")"))
          .otherwise(F.coalesce("norm", F.lit(""))))
    wq = Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = ut.withColumn("all", F.collect_list(F.struct("pos", fn.alias("n"))).over(wq))
    span = F.filter("all", lambda s: (s["pos"] > F.col("pos")) & (s["pos"] < F.col("close_pos")) & (s["n"] != ""))
    fp = F.md5(F.array_join(F.transform(F.array_sort(span), lambda s: s["n"]), " "))
    # an open parenthesis without its match has no span; its fingerprint is that of no tokens at all
    x = x.withColumn("n", F.when(F.col("sub_open"), F.concat(F.lit("sub:"), fp)).otherwise(F.col("norm"))).drop("all")
    wu = Window.partitionBy(*keys, "block", "clause", "unit").orderBy("pos")
    x = x.withColumn("n_cmp_before", F.coalesce(F.sum(F.when(tok.isin(*tk.CMP_WORDS), 1).otherwise(0)).over(
        wu.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    entry = F.struct("pos", "n")
    left_entry = F.when((F.col("n_cmp_before") == 0) & ~tok.isin(*tk.CMP_WORDS, "not"), entry)
    ordered = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda s: s["n"]), " ")
    return x.groupBy(*keys, "block", "clause", "unit").agg(
        ordered(F.when(F.col("n").isNotNull() & ~tok.isin("asc", "desc"), entry)).alias("sig"),
        ordered(F.when(F.col("n").isNotNull(), left_entry)).alias("sig_left"),
        F.sum(F.when(tok.rlike(_AGG_RE) & (F.col("next_tok") == "("), 1).otherwise(0)).alias("n_agg"),
        F.max(F.when(tok == "not", 1).otherwise(0)).alias("has_not"),
        F.min(F.when(tok.isin(*tk.CMP_WORDS), F.struct("pos", "token")))["token"].alias("op"),
        F.max(F.when(F.col("sub_open"), 1).otherwise(0)).alias("has_sub"),
        F.max(F.when(F.col("is_sep"), tok)).alias("conj"),
        F.max(F.when(tok.isin("asc", "desc"), tok)).alias("dir"),
        F.max(F.when(tok.isin("asc", "desc"), F.struct("pos", "token"))).alias("dir_at"),
        F.max(F.when(F.col("is_table"), 1).otherwise(0)).alias("is_table_unit"),
        F.min("sdepth").alias("sdepth"),
        F.min(F.struct("pos", "set_path"))["set_path"].alias("set_path"),
        *_valid_parts(),
    )


def _is_unit() -> Column:
    return F.col("clause").isNotNull() & (F.col("block") >= 0) & (F.col("sig") != "")


def units(ut: DataFrame, key: str) -> DataFrame:
    """One row per (key, side, block, clause, unit) with comparison signatures.

    sig      -- normalised tokens of the unit (subqueries by fingerprint)
    sig_left -- the value unit before the comparison operator (where/having)
    n_agg    -- aggregate words in the unit; has_not / op / has_sub / conj
    """
    return unit_groups(ut, key).filter(_is_unit())


def blocks(ut: DataFrame, key: str) -> DataFrame:
    """Per (key, side, block): counts for hardness and keywords, lists for exact comparisons, validity of the query.

    ``sel``, ``sel_body`` (without the aggregate wrapper), ``whr``, ``whr_left`` and ``grp`` are the signatures of
    the block's units whose multisets are compared.
    """
    keys = _keys(key)
    g = unit_groups(ut, key)
    c = F.when(_is_unit(), F.col("clause"))
    is_cond = c.isin("where", "having", "on")
    srt = lambda cond, val: F.array_sort(F.collect_list(F.when(cond, F.struct(F.col("unit").alias("u"), val.alias("v")))))
    vals = lambda arr: F.transform(arr, lambda s: s["v"])
    listed = lambda cond, val: F.collect_list(F.when(cond, val))
    count = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    body = F.regexp_replace("sig", r"^(max|min|count|sum|avg) \( (.*) \)$", "$2")
    f = g.groupBy(*keys, "block").agg(
        F.max(_is_unit()).alias("is_block"),
        F.min(F.when(_is_unit(), F.col("sdepth"))).alias("sdepth"),
        F.min(F.when(_is_unit(), F.struct(F.col("first_at.pos").alias("pos"), "set_path")))["set_path"].alias("set_path"),
        count(c == "select").alias("n_select"),
        count(c == "where").alias("n_where"),
        count(c == "group").alias("n_group"),
        count(c == "having").alias("n_having"),
        count(c == "order").alias("n_order"),
        count(c == "limit").alias("n_limit"),
        count((c == "from") & ((F.col("is_table_unit") == 1) | (F.col("has_sub") == 1))).alias("n_tables"),
        count(is_cond & (F.col("conj") == "or")).alias("n_or"),
        count(is_cond & (F.col("op") == "like")).alias("n_like"),
        count(is_cond & (F.col("has_not") == 1)).alias("n_not"),
        count(is_cond & (F.col("op") == "in")).alias("n_in"),
        count(is_cond & (F.col("has_sub") == 1)).alias("n_sub_cond"),
        count((c == "select") & (F.col("n_agg") > 0)).alias("agg_select"),
        count((c == "where") & (F.col("has_not") == 1)).alias("agg_where_quirk"),
        F.sum(F.when(c == "order", F.col("n_agg")).otherwise(0)).alias("agg_order"),
        count((c == "having") & (F.col("has_not") == 1)).alias("agg_having_not"),
        count((c == "having") & F.col("conj").isNotNull()).alias("having_conj"),
        F.array_sort(F.collect_set(F.when((c == "where") & F.col("conj").isNotNull(), F.col("conj")))).alias("conjs"),
        vals(srt(c == "group", F.col("sig"))).alias("group_list"),
        vals(srt(c == "having", F.concat_ws(" ", F.coalesce("conj", F.lit("")), F.col("sig")))).alias("having_list"),
        vals(srt(c == "order", F.col("sig"))).alias("order_list"),
        # ORDER BY direction of the IR: the last asc/desc written in the clause, default asc
        F.max(F.when(F.col("clause") == "order", F.col("dir_at")))["token"].alias("order_dir"),
        F.array_sort(F.collect_list(F.when((c == "from") & ((F.col("is_table_unit") == 1) | (F.col("has_sub") == 1)),
                                           F.regexp_replace("sig", " .*$", "")))).alias("table_units"),
        listed(c == "select", F.col("sig")).alias("sel"),
        listed(c == "select", body).alias("sel_body"),
        listed(c == "where", F.col("sig")).alias("whr"),
        listed(c == "where", F.col("sig_left")).alias("whr_left"),
        listed(c == "group", F.substring_index("sig", ".", -1)).alias("grp"),
        F.min("r").alias("r"), F.min("min_depth").alias("min_depth"), F.sum("bal").alias("bal"),
        F.max("bad_limit").alias("bad_limit"), F.max("last_at").alias("last_at"), F.min("first_at").alias("first_at"),
        F.max("no_clause").alias("no_clause"), F.max("has_table").alias("has_table"),
    )
    w = Window.partitionBy(*keys)
    f = f.withColumn("valid", F.coalesce(_merged_valid(lambda a: a.over(w)), F.lit(False))).filter("is_block")
    # set-operation presence of a block = a child block right after it at its sdepth
    nxt = F.lead("set_path").over(Window.partitionBy(*keys, "sdepth").orderBy("block"))
    f = f.withColumn("next_path", nxt)
    kind = F.when(F.length("next_path") > F.length("set_path"), F.substring("next_path", F.length("next_path"), F.lit(1)))
    f = f.withColumn("next_kind", kind)
    for k in tk.SET_WORDS:
        f = f.withColumn(f"has_{k}", F.when(F.col("next_kind") == k[0], 1).otherwise(0))
    return f.drop("r", "min_depth", "bal", "bad_limit", "last_at", "first_at", "no_clause", "has_table", "is_block", "next_path", "next_kind")


def keyword_set(prefix: str = "") -> Column:
    """Keyword set of a block (columns read with an optional side prefix)."""
    def c(name):
        return F.coalesce(F.col(prefix + name), F.lit(0))

    def kw(cond, word):
        return F.when(cond, word if isinstance(word, Column) else F.lit(word))
    arr = F.array(
        kw(c("n_where") > 0, "where"), kw(c("n_group") > 0, "group"), kw(c("n_having") > 0, "having"),
        kw(c("n_order") > 0, "order"),
        kw(c("n_order") > 0, F.coalesce(F.col(prefix + "order_dir"), F.lit("asc"))),
        kw(c("n_limit") > 0, "limit"), kw(c("has_except") > 0, "except"),
        kw(c("has_union") > 0, "union"), kw(c("has_intersect") > 0, "intersect"),
        kw(c("n_or") > 0, "or"), kw(c("n_not") > 0, "not"), kw(c("n_in") > 0, "in"),
        kw(c("n_like") > 0, "like"))
    return F.array_sort(F.array_distinct(F.filter(arr, lambda x: x.isNotNull())))


def hardness_expr() -> Column:
    """Easy / medium / hard / extra from the three component counts."""
    c1 = (F.when(F.col("n_where") > 0, 1).otherwise(0) + F.when(F.col("n_group") > 0, 1).otherwise(0)
          + F.when(F.col("n_order") > 0, 1).otherwise(0) + F.when(F.col("n_limit") > 0, 1).otherwise(0)
          + F.greatest(F.col("n_tables") - 1, F.lit(0)) + F.col("n_or") + F.col("n_like"))
    c2 = F.col("n_sub_cond") + F.col("has_except") + F.col("has_union") + F.col("has_intersect")
    aggs = (F.col("agg_select") + F.col("agg_where_quirk") + F.col("agg_order") + F.col("agg_having_not")
            + F.col("having_conj"))
    c3 = (F.when(aggs > 1, 1).otherwise(0) + F.when(F.col("n_select") > 1, 1).otherwise(0)
          + F.when(F.col("n_where") > 1, 1).otherwise(0) + F.when(F.col("n_group") > 1, 1).otherwise(0))
    return (F.when((c1 <= 1) & (c3 == 0) & (c2 == 0), "easy")
            .when(((c3 <= 2) & (c1 <= 1) & (c2 == 0)) | ((c1 <= 2) & (c3 < 2) & (c2 == 0)), "medium")
            .when(((c3 > 2) & (c1 <= 2) & (c2 == 0)) | ((c1 > 2) & (c1 <= 3) & (c3 <= 2) & (c2 == 0))
                  | ((c1 <= 1) & (c3 == 0) & (c2 <= 1)), "hard")
            .otherwise("extra"))


#: query rows of a partition: their tokens (about 40 a row and some 300 bytes each) are sorted in memory
ROWS_PER_PART = 25_000


def analyse(qs: DataFrame, key: str, cat_columns: DataFrame, sides=("gold", "pred"), fks: DataFrame | None = None):
    """(unit table, stacked query rows) of every side: ``units``, ``blocks`` and ``validity`` read them.

    With ``fks`` (see ``fk_map``) columns are compared by their foreign-key class (E2). Nothing is written: a caller
    that reads one result of it once runs in one pass.
    """
    ut, stacked = query_tokens(qs, key, cat_columns, sides, ROWS_PER_PART)
    if fks is not None:
        ut = canonical_columns(ut, key, fks)
    return ut, stacked


# ------------------------------------------------------------------ pairs

def _multiset(gold: str, pred: str) -> tuple[Column, Column, Column]:
    """Sizes of two lists and of their multiset overlap."""
    equal = lambda c, v: F.size(F.filter(c, lambda e: e == v))
    both = F.aggregate(F.array_distinct(gold), F.lit(0), lambda n, v: n + F.least(equal(gold, v), equal(pred, v)))
    return F.size(gold), F.size(pred), both


def component_scores(f: DataFrame, key: str) -> DataFrame:
    """One row per key with the validity of both sides, the top gold block's hardness levels, ``exact_full`` and
    ``cats``: per category label_total, pred_total and cnt of the top path.

    Only sdepth-0 blocks are aligned (by their set-operation path); nested
    subqueries take part through their fingerprints. An unparsable prediction
    contributes nothing (the empty query).
    """
    g = F.col("side") == "gold"
    # an invalid prediction is the empty query
    takes = (F.col("sdepth") == 0) & (F.col("valid") | g)
    path = F.when(takes, F.col("set_path"))
    lists = ("sel", "sel_body", "whr", "whr_left", "grp")
    pair = f.withColumn("path", path).groupBy(key, "mult", "path").agg(
        *[F.max(F.when(g == (s == "gold"), F.col(c))).alias(f"{s}_{c}")
          for s in ("gold", "pred")
          for c in ("n_group", "group_list", "having_list", "n_order", "order_list", "order_dir", "n_limit",
                    "conjs", "has_intersect", "has_union", "has_except", "table_units", "n_where", "n_having",
                    "n_or", "n_not", "n_in", "n_like")],
        *[F.flatten(F.collect_list(F.when(g == (s == "gold"), F.col(c)))).alias(f"{s}_{c}") for s in ("gold", "pred") for c in lists],
        *[F.max(F.when(g == (s == "gold"), F.col("valid"))).alias(f"{s}_valid") for s in ("gold", "pred")],
        F.collect_list(F.when(g & (F.col("path") == ""), hardness_expr())).alias("hards"))
    pair = pair.withColumn("gold_kw", keyword_set("gold_")).withColumn("pred_kw", keyword_set("pred_"))

    gp = lambda c: F.coalesce(F.col(c), F.lit(0))
    has_g, has_p = gp("gold_n_group") > 0, gp("pred_n_group") > 0
    grp_eq = has_g & has_p & (F.col("gold_group_list") == F.col("pred_group_list")) & \
        (F.col("gold_having_list") == F.col("pred_having_list"))
    ord_g, ord_p = gp("gold_n_order") > 0, gp("pred_n_order") > 0
    ord_eq = ord_g & (F.col("gold_order_list") == F.col("pred_order_list")) & \
        (F.coalesce("gold_order_dir", F.lit("asc")) == F.coalesce("pred_order_dir", F.lit("asc"))) & \
        ((gp("gold_n_limit") > 0) == (gp("pred_n_limit") > 0))
    gc, pc = F.coalesce("gold_conjs", F.array()), F.coalesce("pred_conjs", F.array())
    ao_eq = gc == pc

    def cat(name, lt, pt, cnt, times=F.lit(1)):
        n = lambda c: F.coalesce(c.cast("long") * times, F.lit(0).cast("long"))
        return F.struct(F.lit(name).alias("category"), n(lt).alias("label_total"), n(pt).alias("pred_total"), n(cnt).alias("cnt"))

    cats = F.array(
        *[cat(name, *_multiset(f"gold_{c}", f"pred_{c}"), F.col("mult")) for name, c in zip(CATEGORIES[:5], lists)],
        cat("group", has_g, has_p, grp_eq),
        cat("order", ord_g, ord_p, ord_eq),
        cat("and/or", F.when(ao_eq, 1).otherwise(F.size(pc)), F.when(ao_eq, 1).otherwise(F.size(gc)),
            F.when(ao_eq, 1).otherwise(0)),
        cat("keywords", F.size("gold_kw"), F.size("pred_kw"), F.size(F.array_intersect("gold_kw", "pred_kw"))))
    # exact match per path without IUEN
    ok9 = F.forall("cats", lambda e: (e["pred_total"] == e["label_total"]) & (e["cnt"] == e["pred_total"]))
    tables_eq = (F.size(F.coalesce("gold_table_units", F.array())) == 0) | \
        F.coalesce(F.col("gold_table_units") == F.col("pred_table_units"), F.lit(False))
    flags = [F.coalesce(F.col(f"{s}_has_{k}"), F.lit(0)).cast("int").alias(f"{s}_{k}") for s in ("gold", "pred") for k in tk.SET_WORDS]
    pair = pair.withColumn("cats", cats)
    entry = F.struct((-F.length("path")).alias("rank"), "path", (ok9 & tables_eq).alias("ok"), *flags, "cats")
    m = pair.groupBy(key, "mult").agg(
        F.array_sort(F.collect_list(F.when(F.col("path").isNotNull(), entry))).alias("m"),
        F.flatten(F.collect_list("hards")).alias("hards"),
        *[F.coalesce(F.max(f"{s}_valid"), F.lit(False)).alias(f"{s}_valid") for s in ("gold", "pred")])
    return _iuen(m, key)


def _with_f(df: DataFrame) -> DataFrame:
    good = (F.col("pred_total") == F.col("label_total")) & (F.col("cnt") == F.col("pred_total"))
    v = F.when(good, 1).otherwise(0)
    return df.withColumn("acc", v).withColumn("rec", v).withColumn("f1", v)


def _iuen(m: DataFrame, key: str) -> DataFrame:
    """IUEN of the top block (added to ``cats``) and exact match of the whole query, per key.

    The set-operation blocks of one query, entries (path, ok, presence flags),
    are folded from the deepest to the top: an operand matches
    when its own components and operands match. A child's path is longer than
    its parent's, so its result is known before the parent needs it, whatever
    the depth.
    """
    def total(e, side: str):
        return sum((e[f"{side}_{k}"] for k in tk.SET_WORDS), F.lit(0))

    def matched(known, e):
        both = lambda k: (e[f"gold_{k}"] > 0) & (e[f"pred_{k}"] > 0)
        child = lambda k: F.coalesce(F.try_element_at(known, F.concat(e["path"], F.lit(k[0]))), F.lit(False))
        return sum((F.when(both(k) & child(k), 1).otherwise(0) for k in tk.SET_WORDS), F.lit(0))

    def step(known, e):
        lt, pt, cnt = total(e, "gold"), total(e, "pred"), matched(known, e)
        return F.map_concat(known, F.create_map(e["path"], e["ok"] & (lt == pt) & (cnt == pt)))

    known = F.aggregate("m", F.expr("cast(map() as map<string,boolean>)"), step)
    m = m.withColumn("known", known).withColumn("top", F.try_element_at(F.filter("m", lambda e: e["path"] == ""), F.lit(1)))
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    iuen = F.struct(F.lit("IUEN").alias("category"), none(total(F.col("top"), "gold")).alias("label_total"),
                    none(total(F.col("top"), "pred")).alias("pred_total"), none(matched(F.col("known"), F.col("top"))).alias("cnt"))
    cats = F.when(F.size("m") > 0, F.concat(F.coalesce("top.cats", F.array().cast("array<struct<category:string,label_total:long,pred_total:long,cnt:long>>")), F.array(iuen)))
    return m.select(key, "mult", "gold_valid", "pred_valid", "hards", F.coalesce(F.try_element_at("known", F.lit("")), F.lit(False)).alias("exact_full"), cats.alias("cats"))


# ---------------------------------------------------------------- reports

def score_rows(qs: DataFrame, key: str, cat_columns: DataFrame, fks: DataFrame | None = None) -> DataFrame:
    """One row per key with a parsable gold query: hardness levels, validity, exact match and all category counts."""
    ut, _ = analyse(qs, key, cat_columns, fks=fks)
    return component_scores(blocks(ut, key), key).filter(F.col("gold_valid") & F.col(key).isNotNull())


def split_scores(rows: DataFrame, key: str):
    """(per_key, per_category) frames of ``score_rows``."""
    once = rows
    # a key that several rows hold stands once for each pair of its rows, and its units once for each row
    rows = rows.withColumn("of", F.explode_outer("hards"))
    per_key = rows.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mult") * F.col("mult")))).select(
        key, F.col("of").alias("hardness"), "gold_valid", "pred_valid", F.when(F.col("exact_full"), 1).otherwise(0).alias("exact"))
    per_cat = _with_f(once.select(key, F.lit("").alias("path"), F.inline("cats")))
    return per_key, per_cat


def score_pairs(qs: DataFrame, key: str, cat_columns: DataFrame, fks: DataFrame | None = None):
    """Per key: hardness, validity, exact match and the ten category scores (path '' only).

    Returns (per_key, per_category) frames. Unparsable gold rows are dropped.
    """
    return split_scores(score_rows(qs, key, cat_columns, fks), key)


def score_report(qs: DataFrame, cat_columns: DataFrame, weight_col: str | None = None,
                 key: str = "query_id", fks: DataFrame | None = None) -> DataFrame:
    """By hardness level and ``all``: count, exact, and per category acc / rec / f1.

    acc averages over rows with pred_total > 0, rec over label_total > 0; f1
    of the two means, 1 when both are 0. With ``weight_col`` each row stands
    for that many identical (gold, pred) pairs (the report is computed on
    distinct pairs, see ``score_report_dedup``).
    """
    # both frames are read: one row per key is kept
    per_key, per_cat = split_scores(cut_lineage(score_rows(qs, key, cat_columns, fks)), key)
    w = F.col(weight_col) if weight_col else F.lit(1)
    wk = qs.select(key, w.alias("w"))
    pk = per_key.join(wk, key)
    pc = per_cat.join(pk.select(key, "hardness", "w"), key)
    lvl = F.explode(F.array(F.col("hardness"), F.lit("all"))).alias("level")
    head = pk.select(lvl, "w", "exact").groupBy("level").agg(
        F.sum("w").cast("long").alias("n"), (F.sum(F.col("w") * F.col("exact")) / F.sum("w")).alias("exact"))
    body = pc.select(lvl, "category", "w", "acc", "rec", "label_total", "pred_total").groupBy("level", "category").agg(
        (F.sum(F.when(F.col("pred_total") > 0, F.col("w") * F.col("acc")))
         / F.sum(F.when(F.col("pred_total") > 0, F.col("w")))).alias("acc"),
        (F.sum(F.when(F.col("label_total") > 0, F.col("w") * F.col("rec")))
         / F.sum(F.when(F.col("label_total") > 0, F.col("w")))).alias("rec"))
    body = body.fillna(0.0, ["acc", "rec"])
    f1 = F.when((F.col("acc") == 0) & (F.col("rec") == 0), F.lit(1.0)).otherwise(
        2.0 * F.col("acc") * F.col("rec") / (F.col("acc") + F.col("rec")))
    out = head.join(body, "level").select("level", "category", "n", F.round("exact", 6).alias("exact"),
                                          F.round("acc", 6).alias("acc"), F.round("rec", 6).alias("rec"),
                                          F.round(f1, 6).alias("f1"))
    return out


def dedup_pairs(ql: DataFrame, gold: str = "gold", pred: str = "pred", key: str = "query_id") -> DataFrame:
    """Distinct (gold, pred) pairs with their multiplicity (map-side combined).

    A hot pair (one text holding a third of the log) collapses to one row in
    the partial aggregate before the shuffle, so no task sees the hot group.
    """
    return ql.groupBy(F.col(gold).alias("gold"), F.col(pred).alias("pred")).agg(
        F.count("*").alias("mult"), F.min(key).alias(key))


def score_report_dedup(ql: DataFrame, cat_columns: DataFrame, key: str = "query_id", fks: DataFrame | None = None) -> DataFrame:
    """E17 over a log: scored once per distinct (gold, pred) pair, weighted by multiplicity."""
    d = dedup_pairs(ql, key=key)
    return score_report(d, cat_columns, weight_col="mult", key=key, fks=fks)


def partial_metric(qs: DataFrame, cat_columns: DataFrame, key: str = "query_id", turn: str = "turn_idx", fks: DataFrame | None = None) -> DataFrame:
    """(category, n, acc, rec, f1) and, as category ``exact``, the exact match rate, of the rows with ``turn`` >= 0.

    Rows with a negative turn are padding and count for nothing. Scored once per distinct pair of texts.
    """
    d = dedup_pairs(qs.filter(F.col(turn) >= 0), key=key)
    r = score_report(d, cat_columns, weight_col="mult", key=key, fks=fks).filter(F.col("level") == "all")
    exact = r.select(F.lit("exact").alias("category"), "n", F.col("exact").alias("acc"), F.col("exact").alias("rec"), F.col("exact").alias("f1")).distinct()
    return r.select("category", "n", "acc", "rec", "f1").unionByName(exact)


def string_em(qs: DataFrame, key: str = "query_id") -> DataFrame:
    """Equality of lower-cased token lists of gold and pred."""
    g = F.transform(tk.tokenize_expr("gold"), lambda t: F.lower(t))
    p = F.transform(tk.tokenize_expr("pred"), lambda t: F.lower(t))
    return qs.select(key, F.when(F.coalesce(g == p, F.lit(False)), 1).otherwise(0).alias("string_em"))
