"""Query-log text operators: tokens, the token table and the unit table (T1, T11, T12 and helpers).

A query string becomes one row per token, keyed by the caller's key columns
plus ``pos``. Structure comes from window expressions over that key, never
from a parser:

* ``depth``   -- running sum of parentheses (a paren belongs to its outer level)
* ``sdepth``  -- the same, counting only parentheses that open a subquery; the
                 matching ``)`` is found with ``lag`` inside (key, depth), where
                 parentheses strictly alternate
* ``block``   -- position of the last ``select`` at the same ``sdepth``: the
                 innermost enclosing query block (set-operation words stay in
                 the left operand's block)
* ``clause``  -- last clause word inside (key, block)
* ``unit``    -- running count of separators inside (key, block, clause)

Every window is partitioned by the key columns first, so a single hash
partitioning by the leading key serves all of them: callers repartition the
*query rows* once (cheap) and the exploded tokens never shuffle again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# ---- fixed values: the covered SQL dialect ----
AGG_WORDS = ["max", "min", "count", "sum", "avg"]
CLAUSE_WORDS = {"select": "select", "from": "from", "join": "from", "on": "on", "where": "where",
                "group": "group", "having": "having", "order": "order", "limit": "limit",
                "intersect": "intersect", "union": "union", "except": "except"}
SET_WORDS = ["intersect", "union", "except"]
CMP_WORDS = ["=", "!=", "<>", ">", "<", ">=", "<=", "between", "in", "like", "is", "exists"]
UNIT_OP_WORDS = ["+", "-", "*", "/"]
KEYWORDS = sorted(set(CLAUSE_WORDS) | set(AGG_WORDS) | set(CMP_WORDS) |
                  {"by", "as", "and", "or", "not", "distinct", "asc", "desc", "null", "select"})
# tokenizer: a quoted string, a two-character comparison, a word (letters,
# digits, _ . # $), or any other single non-space character
TOKEN_PATTERN = r'"[^"]*"|[!<>]=|[A-Za-z0-9_.#$]+|[^\s]'
NUMBER_PATTERN = r"^-?[0-9]+(\.[0-9]+)?$"

_UNB = Window.unboundedPreceding
_UNF = Window.unboundedFollowing


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --------------------------------------------------------------------- T1

def tokenize_expr(sql) -> Column:
    """Token array of a query string; NULL when the quote count is odd.

    Quotes are unified to ``"``, quoted strings stay whole (case kept), the
    rest is lower-cased, ``! =`` / ``> =`` / ``< =`` are joined.
    """
    s = F.replace(_c(sql), F.lit("'"), F.lit('"'))
    s = F.regexp_replace(s, r"([!<>])\s+=", "$1=")
    quotes = F.length(s) - F.length(F.replace(s, F.lit('"'), F.lit("")))
    toks = F.transform(F.regexp_extract_all(s, F.lit(TOKEN_PATTERN), 0),
                       lambda t: F.when(t.startswith('"'), t).otherwise(F.lower(t)))
    return F.when(quotes % 2 == 0, toks)


def tokenize(df: DataFrame, sql_col: str, out: str = "toks") -> DataFrame:
    """Add ``out`` (array of tokens, NULL on an odd quote count)."""
    return df.withColumn(out, tokenize_expr(sql_col))


def is_literal(tok) -> Column:
    tok = _c(tok)
    return tok.startswith('"') | tok.rlike(NUMBER_PATTERN)


# -------------------------------------------------------------------- T11

def token_table(df: DataFrame, keys: Sequence[str], toks: str = "toks") -> DataFrame:
    """One row per token with depth, subquery depth, block and clause.

    Output: keys + pos, token, prev_tok, next_tok, depth, sdepth, sub_open,
    sub_close, close_pos (for '('), block, clause, set_path.
    ``df`` should already be hash-partitioned by ``keys[0]``.
    """
    keys = list(keys)
    x = df.select(*keys, F.posexplode(toks).alias("pos", "token"))
    w = Window.partitionBy(*keys).orderBy("pos")
    run = w.rowsBetween(_UNB, 0)
    tok = F.col("token")
    is_open, is_close = tok == "(", tok == ")"
    x = x.select("*", F.lag("token").over(w).alias("prev_tok"), F.lead("token").over(w).alias("next_tok"),
                 (F.sum(F.when(is_open, 1).when(is_close, -1).otherwise(0)).over(run)
                  - F.when(is_open, 1).otherwise(0)).alias("depth"))
    x = x.withColumn("sub_open", is_open & (F.col("next_tok") == "select"))
    x = x.withColumn("is_paren", is_open | is_close)
    # at one (key, depth) parentheses alternate ( ) ( ): neighbours match
    wp = Window.partitionBy(*keys, "depth", "is_paren").orderBy("pos")
    x = x.select("*",
                 (is_close & F.coalesce(F.lag("sub_open").over(wp), F.lit(False))).alias("sub_close"),
                 F.when(is_open, F.lead("pos").over(wp)).alias("close_pos"))
    x = x.withColumn("sdepth", F.sum(F.when(F.col("sub_open"), 1).when(F.col("sub_close"), -1).otherwise(0)).over(run)
                     - F.when(F.col("sub_open"), 1).otherwise(0))
    ws = Window.partitionBy(*keys, "sdepth").orderBy("pos").rowsBetween(_UNB, 0)
    x = x.select("*",
                 F.coalesce(F.last(F.when(tok == "select", F.col("pos")), ignorenulls=True).over(ws),
                            F.lit(-1)).alias("block"),
                 F.array_join(F.collect_list(F.when(tok.isin(*SET_WORDS), F.substring(tok, 1, 1))).over(ws), "")
                 .alias("set_path"))
    clause_word = F.when(tok.isin(*CLAUSE_WORDS),
                         F.when(tok == "join", F.lit("from")).otherwise(tok))
    wb = Window.partitionBy(*keys, "block").orderBy("pos").rowsBetween(_UNB, 0)
    x = x.withColumn("clause", F.last(clause_word, ignorenulls=True).over(wb))
    return x.drop("is_paren")


# ------------------------------------------------------- column resolution

def name_lookup(cat_columns: DataFrame) -> DataFrame:
    """Tiny lookup of table and column names (lower-case) for a broadcast join."""
    cols = cat_columns.filter(F.col("column_name") != "*").select(
        F.lower("column_name").alias("lookup"), F.lit("column").alias("kind"),
        F.lower("table_name").alias("l_table"), F.lower("column_name").alias("l_column"),
        F.col("column_type").alias("l_type"))
    tabs = cat_columns.filter(F.col("column_name") != "*").select(
        F.lower("table_name").alias("lookup"), F.lit("table").alias("kind"),
        F.lower("table_name").alias("l_table"), F.lit(None).cast("string").alias("l_column"),
        F.lit(None).cast("string").alias("l_type")).distinct()
    return cols.unionByName(tabs)


def resolve(tt: DataFrame, keys: Sequence[str], cat_columns: DataFrame) -> DataFrame:
    """Resolve table and column tokens against a catalog (one database).

    Adds ``is_table`` (a table named in FROM), ``alias_of`` (for alias
    definitions), ``col_id`` (``table.column``, ``*`` for star), ``col_type``
    and ``resolved`` (False for an identifier that names nothing in scope).
    Bare columns take the first table of the block's FROM list that has them;
    ``alias.col`` goes through the query's alias map (last definition wins).
    The name lookup is schema metadata (columns x tables of one catalog) and
    is broadcast; the token table keeps its partitioning.
    """
    keys = list(keys)
    tok = F.col("token")
    qualified = tok.contains(".") & ~is_literal(tok)
    lookup_key = F.when(qualified, F.substring_index(tok, ".", -1)).otherwise(tok)
    names = name_lookup(cat_columns)
    x = tt.withColumn("lookup_key", lookup_key).join(F.broadcast(names), F.col("lookup_key") == F.col("lookup"), "left")
    # table tokens in FROM (not the alias after AS)
    x = x.withColumn("cand_table", F.coalesce((F.col("kind") == "table") & (F.col("clause") == "from")
                                              & (F.coalesce(F.col("prev_tok"), F.lit("")) != "as") & ~qualified,
                                              F.lit(False)))
    wtok = Window.partitionBy(*keys, "pos")
    x = x.withColumn("is_table", F.coalesce(F.max(F.col("cand_table")).over(wtok), F.lit(False)))
    wblk = Window.partitionBy(*keys, "block").rowsBetween(_UNB, _UNF)
    x = x.withColumn("block_tables", F.array_sort(F.collect_set(
        F.when(F.col("cand_table"), F.struct(F.col("pos").alias("p"), F.col("l_table").alias("t")))).over(wblk)))
    x = x.withColumn("block_tables", F.transform("block_tables", lambda s: s["t"]))
    # alias map of the whole query: (alias, table) at every AS inside FROM
    wq = Window.partitionBy(*keys).rowsBetween(_UNB, _UNF)
    alias_entry = F.when((tok == "as") & (F.col("clause") == "from"),
                         F.struct(F.col("pos").alias("p"), F.col("next_tok").alias("a"), F.col("prev_tok").alias("t")))
    x = x.withColumn("aliases", F.array_sort(F.collect_set(alias_entry).over(wq)))
    qual = F.substring_index(tok, ".", 1)
    alias_hits = F.filter("aliases", lambda e: e["a"] == qual)
    qual_table = F.coalesce(F.try_element_at(alias_hits, F.lit(-1))["t"], qual)
    x = x.withColumn("want_table", F.when(qualified, qual_table))
    is_ident = tok.rlike(r"^[a-z_][a-z0-9_#$]*$") & ~tok.isin(*KEYWORDS)
    ok = (F.col("kind") == "column") & F.when(
        qualified, F.col("l_table") == F.col("want_table")
    ).otherwise(is_ident & F.array_contains("block_tables", F.col("l_table")) & ~F.col("is_table")
                & (F.coalesce(F.col("prev_tok"), F.lit("")) != "as"))
    rank = F.when(ok, F.array_position("block_tables", F.col("l_table"))).otherwise(F.lit(10 ** 6))
    wpos = Window.partitionBy(*keys, "pos")
    # a table joined twice (two aliases) offers the column twice: ambiguous
    hits = F.size(F.filter("block_tables", lambda t: t == F.col("l_table")))
    x = x.withColumn("n_cands", F.sum(F.when(ok & ~qualified, hits).otherwise(0)).over(wpos))
    x = x.withColumn("rk", F.row_number().over(wpos.orderBy(rank, "l_table")))
    x = x.filter(F.col("rk") == 1)
    star = tok == "*"
    star_col = star & (F.coalesce(F.col("prev_tok"), F.lit("")).isin("(", ",", "select", "distinct"))
    col_id = (F.when(star_col, F.lit("*"))
              .when(qualified & F.col("l_table").isNull() & tok.endswith(".*"), F.concat(qual_table, F.lit(".*")))
              .when(ok, F.concat(F.col("l_table"), F.lit("."), F.col("l_column"))))
    alias_def = (F.coalesce(F.col("prev_tok"), F.lit("")) == "as") & (F.col("clause") == "from")
    needs_col = (qualified | (is_ident & ~F.col("is_table") & ~alias_def)) & F.col("clause").isNotNull()
    # table -> columns, one metadata row; plans that do not read it prune it
    per_table = cat_columns.filter(F.col("column_name") != "*").groupBy(F.lower("table_name").alias("t")).agg(F.collect_set(F.lower("column_name")).alias("cs"))
    x = x.crossJoin(F.broadcast(per_table.agg(F.map_from_entries(F.collect_list(F.struct("t", "cs"))).alias("cols_of"))))
    x = x.select(*tt.columns, "is_table", "block_tables", "cols_of", "aliases", "want_table", "n_cands",
                 F.when(alias_def, F.col("prev_tok")).alias("alias_def_of"),
                 col_id.alias("col_id"),
                 F.when(star_col, F.lit("*")).when(ok, F.col("l_type")).alias("col_type"),
                 (~needs_col | col_id.isNotNull()).alias("resolved"))
    return x


# ------------------------------------------------------------------- T12

def with_units(rt: DataFrame, keys: Sequence[str]) -> DataFrame:
    """T12 part 1: separator flags, unit ordinal and the normalised token.

    ``norm`` is the comparison form of a token: literals become ``value``
    (numbers after LIMIT stay), columns become ``table.column``, aliases and
    AS vanish, DISTINCT vanishes (the evaluator ignores it), a subquery's
    parentheses become a placeholder filled with its fingerprint later.
    """
    keys = list(keys)
    tok = F.col("token")
    clause = F.col("clause")
    wc = Window.partitionBy(*keys, "block", "clause").orderBy("pos")
    # the AND of BETWEEN x AND y is not a separator
    last_op = F.last(F.when(tok.isin(*CMP_WORDS, "and", "or"), tok), ignorenulls=True).over(
        wc.rowsBetween(_UNB, -1))
    x = rt.withColumn("last_op", last_op)
    sep = (F.when(clause.isin("select", "group", "order"), tok == ",")
           .when(clause.isin("where", "having", "on"), tok.isin("and", "or") & (F.coalesce(F.col("last_op"), F.lit("")) != "between"))
           .when(clause == "from", tok == "join")
           .otherwise(F.lit(False)))
    x = x.withColumn("is_sep", sep & (F.col("sdepth") == F.col("sdepth")))
    x = x.withColumn("unit", F.sum(F.col("is_sep").cast("int")).over(wc.rowsBetween(_UNB, 0)))
    drop = (tok.isin("select", "from", "where", "group", "by", "having", "order", "limit", "on", "join", "as",
                     "distinct", "intersect", "union", "except")
            | F.col("is_sep") | F.col("alias_def_of").isNotNull() | F.col("sub_close"))
    norm = (F.when(drop, F.lit(None))
            .when(F.col("sub_open"), F.concat(F.lit("sub@"), F.col("pos").cast("string")))
            .when(is_literal(tok) & (clause != "limit"), F.lit("value"))
            .when(F.col("col_id").isNotNull(), F.col("col_id"))
            .otherwise(tok))
    return x.withColumn("norm", norm)


def block_fingerprints(ut: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fingerprint of every subquery: md5 of the normalised tokens of its span.

    The span of a subquery opened at ``pos`` is (pos, close_pos); nested
    subqueries are part of it, so equal fingerprints mean equal nested queries
    (up to literals, aliases and DISTINCT). One row per (key, open position);
    computed per query from its ordered normalised tokens (no cross-query
    work, no shuffle: grouped by the partitioning key).
    """
    keys = list(keys)
    per_query = ut.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("pos", F.coalesce("norm", F.lit("")).alias("n")))).alias("all"))
    opens = ut.filter(F.col("sub_open")).select(*keys, F.col("pos").alias("open_pos"), "close_pos",
                                                 F.col("block").alias("outer_block"), F.col("clause").alias("outer_clause"))
    j = opens.join(per_query, keys)
    span = F.filter(F.col("all"), lambda s: (s["pos"] > F.col("open_pos")) & (s["pos"] < F.col("close_pos")) & (s["n"] != ""))
    return j.select(*keys, "open_pos", "outer_block", "outer_clause",
                    F.md5(F.array_join(F.transform(span, lambda s: s["n"]), " ")).alias("fp"))
