"""Query lint: scope and type rules as findings.

A grammar checker rejects a query while parsing; here every rule is a
predicate or a small aggregate over the resolved token table, and each
violation becomes one row ``(key, rule, block, pos, detail)``. All rules
share the token table's partitioning (keys first); nothing shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.operators import tokens as tk
from skein.operators.scopes import scope_findings
from skein.session import cut_lineage

RULES = ["unknown_table", "column_not_in_table", "alias_not_in_scope", "column_not_in_alias", "ambiguous_column",
         "unresolved_column", "duplicate_alias", "duplicate_table", "derived_column_missing", "bad_aggregate_type", "bad_arithmetic_type",
         "bad_comparison_type", "bad_like_type", "setop_type_mismatch", "bad_alias_name", "literal_too_long"]
ALIAS_RE = r"^t[0-9]{1,10}$"
MAX_LITERAL = 64
MAX_LIMIT_DIGITS = 8


def _finding(df: DataFrame, keys: list[str], rule: str, cond: Column, detail: Column) -> DataFrame:
    return df.filter(cond).select(*keys, F.lit(rule).alias("rule"), "block", "pos", detail.alias("detail"))


def _operand_type(tok: Column, ctype: Column) -> Column:
    return (F.when(ctype.isNotNull(), ctype).when(tok.startswith('"'), F.lit("text"))
            .when(tok.rlike(tk.NUMBER_PATTERN), F.lit("number")))


def lint(rt: DataFrame, keys: list[str]) -> DataFrame:
    """All findings of the resolved token table ``rt`` (output of ``tokens.resolve``)."""
    tok = F.col("token")
    prev = F.coalesce(F.col("prev_tok"), F.lit(""))
    ident = tok.rlike(r"^[a-z_][a-z0-9_#$]*$") & ~tok.isin(*tk.KEYWORDS)
    w = Window.partitionBy(*keys).orderBy("pos")
    # every rule below reads the same resolved tokens: cut lineage once
    rt = cut_lineage(rt)
    x = rt.withColumn("next_ctype", F.lead("col_type").over(w)).withColumn("prev_ctype", F.lag("col_type").over(w)) \
        .withColumn("next2_tok", F.lead("token", 2).over(w)).withColumn("next2_ctype", F.lead("col_type", 2).over(w))
    out = []
    # L1 table in FROM that the catalog does not have
    out.append(_finding(x, keys, "unknown_table", (F.col("clause") == "from") & ident & (prev != "as")
                        & ~F.col("is_table"), tok))
    # Names against the nested scopes of the query
    out.append(scope_findings(rt, keys).select(*keys, "rule", F.col("block").cast(rt.schema["block"].dataType).alias("block"), F.col("pos").cast(rt.schema["pos"].dataType).alias("pos"), "detail"))
    # L7 / L8 same alias twice, same unaliased table twice in one FROM
    defs = x.filter((F.col("clause") == "from") & (prev == "as")).groupBy(*keys, "block", "token") \
        .agg(F.count("*").alias("n"), F.max("pos").alias("pos")).filter("n > 1")
    out.append(defs.select(*keys, F.lit("duplicate_alias").alias("rule"), "block", "pos", F.col("token").alias("detail")))
    unaliased = x.filter(F.col("is_table") & (F.col("clause") == "from") & (F.coalesce("next_tok", F.lit("")) != "as"))
    dup = unaliased.groupBy(*keys, "block", "token").agg(F.count("*").alias("n"), F.max("pos").alias("pos")).filter("n > 1")
    out.append(dup.select(*keys, F.lit("duplicate_table").alias("rule"), "block", "pos", F.col("token").alias("detail")))
    # L10 aggregate over a column of the wrong type
    arg_type = F.when(F.col("next2_tok") == "distinct", F.lit(None)).otherwise(F.col("next2_ctype"))
    agg_bad = ((tok.isin("sum", "avg") & ~arg_type.isin("number", "*"))
               | (tok.isin("min", "max") & ~arg_type.isin("number", "time", "*")))
    out.append(_finding(x, keys, "bad_aggregate_type", (F.col("next_tok") == "(") & agg_bad & arg_type.isNotNull(),
                        F.concat(tok, F.lit(":"), arg_type)))
    # L11 arithmetic between operands of different / non-arithmetic types
    lt = _operand_type(F.col("prev_tok"), F.col("prev_ctype"))
    rt_ = _operand_type(F.col("next_tok"), F.col("next_ctype"))
    arith = tok.isin("+", "-", "/") | ((tok == "*") & ~(F.col("col_id") == "*"))
    ok_pair = ((lt == "number") & (rt_ == "number")) | ((lt == "time") & (rt_ == "time")) | (lt == "*") | (rt_ == "*")
    out.append(_finding(x, keys, "bad_arithmetic_type", arith & lt.isNotNull() & rt_.isNotNull() & ~ok_pair,
                        F.concat_ws(":", lt, rt_)))
    # L12 / L13 comparison operands
    eq_bad = tok.isin("=", "!=", "<>") & (lt != rt_) & (lt != "*") & (rt_ != "*")
    ord_bad = tok.isin("<", ">", "<=", ">=", "between") & (~lt.isin("number", "time") | ~rt_.isin("number", "time"))
    out.append(_finding(x, keys, "bad_comparison_type", (eq_bad | ord_bad) & lt.isNotNull() & rt_.isNotNull(),
                        F.concat_ws(":", tok, lt, rt_)))
    out.append(_finding(x, keys, "bad_like_type", (tok == "like") & lt.isNotNull() & rt_.isNotNull()
                        & ((lt != "text") | (rt_ != "text")), F.concat_ws(":", lt, rt_)))
    # L14 select types differ across a set operation
    sel = x.filter(F.col("clause") == "select")
    unit_ord = F.sum(F.when(tok == ",", 1).otherwise(0)).over(
        Window.partitionBy(*keys, "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    sel = sel.withColumn("u", unit_ord)
    utype = sel.groupBy(*keys, "block", "u").agg(
        F.max(F.when(tok.isin("count", "sum", "avg"), F.lit("number"))).alias("agg_t"),
        F.max(F.when(tok != ",", F.col("col_type"))).alias("col_t"))
    btypes = utype.groupBy(*keys, "block").agg(F.array_sort(F.collect_list(
        F.struct("u", F.coalesce("agg_t", "col_t").alias("t")))).alias("ts"))
    btypes = btypes.select(*keys, "block", F.transform("ts", lambda s: s["t"]).alias("types"))
    kids = x.filter((tok == "select") & F.col("prev_tok").isin(*tk.SET_WORDS)).select(
        *keys, F.col("pos").alias("child"), "block")
    parent_of = x.filter(tok.isin(*tk.SET_WORDS)).select(*keys, F.col("block").alias("parent"),
                                                         F.col("pos").alias("setpos"))
    kid_par = kids.select(*keys, "child").join(parent_of, keys).filter(F.col("setpos") == F.col("child") - 1)
    mm = kid_par.join(btypes.withColumnRenamed("block", "parent").withColumnRenamed("types", "pt"), keys + ["parent"]) \
        .join(btypes.withColumnRenamed("block", "child").withColumnRenamed("types", "ct"), keys + ["child"]) \
        .filter(F.col("pt") != F.col("ct"))
    out.append(mm.select(*keys, F.lit("setop_type_mismatch").alias("rule"), F.col("child").alias("block"),
                         F.col("setpos").alias("pos"), F.concat_ws("|", F.array_join("pt", ","), F.array_join("ct", ","))
                         .alias("detail")))
    # L15 alias names must look like t<digits>
    out.append(_finding(x, keys, "bad_alias_name", (F.col("clause") == "from") & (prev == "as") & ~tok.rlike(ALIAS_RE), tok))
    # L16 literal length and LIMIT digits
    too_long = (tok.startswith('"') & (F.length(tok) - 2 > MAX_LITERAL)) | \
        ((F.col("clause") == "limit") & tok.rlike(r"^[0-9]+$") & (F.length(tok) > MAX_LIMIT_DIGITS))
    out.append(_finding(x, keys, "literal_too_long", too_long, F.length(tok).cast("string")))
    res = out[0]
    for o in out[1:]:
        res = res.unionByName(o)
    return res


# ---- fault injection for the lint test log: one fault class per rule plus clean (class 0) ----
FAULTS = [
    ("clean", None, None),
    ("unknown_table", r" from ([a-z_]+)", r" from zz_$1"),
    ("column_not_in_table", r"^select (.*) from ([a-z_]+)", r"select $2.zz_col , $1 from $2"),
    ("alias_not_in_scope", r"^select ", r"select t9.zz_col , "),
    ("unresolved_column", r"^select ", r"select zz_col , "),
    ("duplicate_alias", r" from ([a-z_]+)", r" from $1 as t7 join region as t7"),
    ("duplicate_table", r" from ([a-z_]+)", r" from $1 join $1"),
    ("bad_aggregate_type", r"^select ([a-z_.0-9]+) ", r"select sum($1) , $1 "),
    ("bad_comparison_type", r"^select ([a-z_.0-9]+) (.*) where ", r"select $1 $2 where $1 > 5 and "),
    ("bad_like_type", r" where ([a-z_.0-9]+) ", r" where $1 like '%5%' and $1 "),
    ("setop_type_mismatch", r"^select ([a-z_.0-9]+) (.*)$", r"select $1 $2 union select count(*) from region"),
    ("bad_alias_name", r" from ([a-z_]+)", r" from $1 as x"),
    ("literal_too_long", r"^select ", "select '" + "x" * 70 + "' , "),
    ("bad_arithmetic_type", r"^select ([a-z_.0-9]+) ", r"select $1 + 1 , $1 "),
    ("derived_column_missing", r"^select (.*?) from ([a-z_]+)( as t1)?", r"select t8.zz_col , $1 from ( select r_name from region ) as t8 join $2$3"),
]


def inject_faults(ql: DataFrame, salt: str = "f") -> DataFrame:
    """Lint test log: (query_id, fault, sql) with one fault class per query chosen by md5 bucket."""
    from skein.functions.hashing import bucket
    f = bucket(salt, "query_id", len(FAULTS))
    sql = F.col("gold")
    for i, (_, pat, rep) in enumerate(FAULTS):
        if pat is None:
            continue
        sql = F.when(f == i, F.regexp_replace(F.col("gold"), pat, rep)).otherwise(sql)
    names = F.element_at(F.array(*[F.lit(n) for n, _, _ in FAULTS]), (f + 1).cast("int"))
    return ql.select("query_id", names.alias("fault"), sql.alias("sql"))
