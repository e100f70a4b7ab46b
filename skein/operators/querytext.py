"""Query-text rewrites over token arrays.

Every operator here is row-local: it maps one query string (or its token
array) to new columns with built-in array higher-order functions
(``transform``, ``filter``, ``exists``, ``aggregate``). Nothing shuffles, so
the work grows linearly with the log and runs inside whole-stage codegen
next to the scan. Where the reference walks tokens with a little state
machine (string literals in T2), the state is carried by ``aggregate``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values: what Python's float() accepts on a token without spaces ----
FLOAT_PATTERN = (r"(?i)^[+-]?(((\d(_?\d)*)(\.(\d(_?\d)*)?)?|\.\d(_?\d)*)([e][+-]?\d(_?\d)*)?"
                 r"|inf|infinity|nan)$")

# ---- fixed values: characters padded with spaces before splitting (T2) ----
MASK_DELIMS = {"sparc": "()!=", "cosql": "()!=><+"}
# ---- fixed values: the two repairs of the conversation dialect (T2), in order ----
COSQL_REPAIRS = [("2,1", "1"), ("whereclaim", "where claim")]

# ---- fixed values: spacing rules of the query normaliser (T8), applied in order ----
RESPACE_RULES = [("( ", "("), (" )", ")"), ("< =", "<="), ("> =", ">="), ("max (", "max("),
                 ("min (", "min("), ("avg (", "avg("), ("count (", "count(")]

TABLE_STAR_PATTERN = r"\s([0-9a-zA-Z_]+\.)\*\s"
PLACEHOLDER_PATTERN = r"\s+1(\s+|$)"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def bound(value: Column, f) -> Column:
    """``f(value)`` with ``value`` computed once: inside lambdas a plain reference is computed again for every element."""
    return F.element_at(F.transform(F.array(value), f), 1)


def is_float(tok) -> Column:
    return _c(tok).rlike(FLOAT_PATTERN)


def _replace_all(s: Column, rules) -> Column:
    for a, b in rules:
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


# --------------------------------------------------------------------- T2

def split_query(sql, dialect: str = "sparc") -> Column:
    """Whitespace tokens after padding delimiters; ``x'`` splits off its quote, ``t1.col`` into three."""
    s = F.replace(F.regexp_replace(_c(sql), ";+$", ""), F.lit('"'), F.lit("'"))
    if dialect == "cosql":
        s = _replace_all(s, COSQL_REPAIRS)
    s = _replace_all(s, [(ch, f" {ch} ") for ch in MASK_DELIMS[dialect]])
    parts = F.filter(F.split(s, r"\s+"), lambda t: t != "")

    def expand(t):
        dotted = t.contains(".") & F.lower(t).startswith("t") & (F.size(F.split(t, r"\.")) == 2)
        return (F.when(t.endswith("'"), F.array(F.regexp_replace(t, "'+$", ""), F.lit("'")))
                .when(dotted, F.array(F.substring_index(t, ".", 1), F.lit("."), F.substring_index(t, ".", -1)))
                .otherwise(F.array(t)))
    return F.flatten(F.transform(parts, expand))


def mask_values(toks, dialect: str = "sparc") -> Column:
    """Numbers and quoted strings become ``value``; the string state is an ``aggregate`` fold."""
    init = F.struct(F.lit(False).alias("ins"), F.array().cast("array<string>").alias("out"))

    def step(acc, t):
        ins = acc["ins"]
        if dialect == "cosql":
            opener = t.startswith("'") & ~ins
        else:
            opener = t.startswith("'") & (t != "'")
        close = ins & (t == "'")
        emit = (F.when(opener, F.lit(None)).when(close, F.lit("value"))
                .when(~ins, F.when(is_float(t), F.lit("value")).otherwise(F.lower(t))))
        new_ins = F.when(opener, F.lit(True)).when(close, F.lit(False)).otherwise(ins)
        out = F.when(emit.isNotNull(), F.array_append(acc["out"], emit)).otherwise(acc["out"])
        return F.struct(new_ins.alias("ins"), out.alias("out"))
    return F.aggregate(_c(toks), init, step, lambda acc: acc["out"])


def mask_tokens(df: DataFrame, sql_col: str, dialect: str = "sparc") -> DataFrame:
    """Add ``toks`` and ``masked`` (the dialect picks delimiters and string handling)."""
    return (df.withColumn("toks", split_query(sql_col, dialect))
            .withColumn("masked", mask_values("toks", dialect)))


# --------------------------------------------------------------------- T3

def strip_values(toks) -> Column:
    """Number or ``"..."`` token -> ``value``; others lower-cased."""
    return F.transform(_c(toks), lambda t: F.when(is_float(t) | (t.startswith('"') & t.endswith('"')),
                                                  F.lit("value")).otherwise(F.lower(t)))


# ----------------------------------------------------------------- T4, T5

def _alias_entries(toks) -> Column:
    """(pos, alias, table) for every ``x as a``; the last definition of an alias wins."""
    toks = _c(toks)
    idx = F.filter(F.sequence(F.lit(1), F.greatest(F.size(toks), F.lit(1))), lambda i: F.element_at(toks, i) == "as")
    # the token before ``as`` at the very start is the last token (negative index)
    ent = F.transform(idx, lambda i: F.struct(
        i.alias("pos"), F.element_at(toks, i + 1).alias("alias"),
        F.when(i > 1, F.element_at(toks, i - 1)).otherwise(F.element_at(toks, -1)).alias("table_name")))
    ent = F.filter(ent, lambda e: e["alias"].isNotNull())
    return bound(ent, lambda all_: F.filter(all_, lambda e: ~F.exists(all_, lambda o: (o["alias"] == e["alias"]) & (o["pos"] > e["pos"]))))


def alias_map(df: DataFrame, keys: list[str], toks: str, table_names: DataFrame) -> DataFrame:
    """T4: (keys, alias, table_name, alias_is_table).

    ``table_names`` (one column ``table_name``) is the catalog's table list:
    schema-sized, so the collision check is a broadcast join. Every table
    also maps to itself; T5 applies that identity with ``coalesce`` instead of
    materialising one row per (query, table).
    """
    x = df.select(*keys, F.explode(_alias_entries(toks)).alias("e"))
    x = x.select(*keys, "e.alias", "e.table_name")
    names = table_names.select(F.lower("table_name").alias("alias")).distinct().withColumn("alias_is_table", F.lit(True))
    return (x.join(names, "alias", "left")
            .select(*keys, "alias", "table_name", F.coalesce("alias_is_table", F.lit(False)).alias("alias_is_table")))


def resolve_aliases(toks) -> Column:
    """T5: drop ``as alias``, rewrite ``alias.col`` -> ``table.col`` (token-exact), then respace."""
    toks = _c(toks)
    n = F.size(toks)
    keep = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
                    lambda i: (i <= n) & (F.element_at(toks, i) != "as")
                    & ((i == 1) | (F.element_at(toks, F.greatest(i - 1, F.lit(1))) != "as")))

    def rewrite(ent, i):
        t = F.element_at(toks, i)
        pre = F.substring_index(t, ".", 1)
        hit = F.filter(ent, lambda e: e["alias"] == pre)
        return F.when(t.contains(".") & (F.size(hit) > 0),
                      F.concat(F.element_at(hit, 1)["table_name"], F.lit("."),
                               F.substring(t, F.length(pre) + 2, F.length(t)))).otherwise(t)
    return respace(F.array_join(bound(_alias_entries(toks), lambda ent: F.transform(keep, lambda i: rewrite(ent, i))), " "))


# --------------------------------------------------------------------- T6

ALIAS_TOKEN = r"^t\d+"


def split_names(toks) -> Column:
    """``a.b`` -> ``a . b`` for every token with a dot (other than ``.`` itself)."""
    return F.flatten(F.transform(_c(toks), lambda t: F.when((t != ".") & t.contains("."), F.filter(
        F.split(F.replace(t, F.lit("."), F.lit(" . ")), r"\s+"), lambda p: p != "")).otherwise(F.array(t))))


def split_dotted(toks) -> Column:
    """struct(toks, invalid): ``a.b`` -> ``a . b``; ``*`` goes to the least used alias."""
    toks = _c(toks)
    invalid = F.exists(toks, lambda t: (t != ".") & t.contains("."))
    return F.struct(bound(split_names(toks), _qualified_star).alias("toks"), invalid.alias("invalid"))


def _qualified_star(spl: Column) -> Column:
    """The split tokens with the ``*`` of the select list under the least used alias, where the list lacks one."""
    n = F.size(spl)
    from_at = F.array_position(spl, F.lit("from"))
    sel = F.slice(spl, 1, F.greatest(from_at - 1, F.lit(0)))
    idx = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    first = F.filter(idx, lambda i: (i <= n) & F.element_at(spl, i).rlike(ALIAS_TOKEN) & ~F.exists(
        F.sequence(F.lit(1), F.greatest(i - 1, F.lit(1))),
        lambda j: (j < i) & (F.element_at(spl, j) == F.element_at(spl, i))))
    stats = F.transform(first, lambda i: F.struct(
        F.size(F.filter(spl, lambda t: t == F.element_at(spl, i))).alias("cnt"), (-i).alias("neg_first"),
        F.element_at(spl, i).alias("alias")))
    n_sel = F.size(F.array_distinct(F.filter(sel, lambda t: t.rlike(ALIAS_TOKEN))))
    least = F.element_at(F.array_sort(stats), 1)["alias"]
    star_at = F.array_position(spl, F.lit("*"))
    fire = (from_at > 0) & F.array_contains(sel, F.lit("*")) & (F.size(first) > n_sel)
    starred = bound(F.struct(F.concat(least, F.lit(".*")).alias("to"), star_at.alias("at")), lambda z: F.transform(
        spl, lambda t, i: F.when(i + 1 == z["at"], z["to"]).otherwise(t)))
    return F.when(fire, starred).otherwise(spl)


# --------------------------------------------------------------------- T8

def respace(s, rules=None) -> Column:
    """Ordered literal replacements (default: the query normaliser's spacing rules)."""
    return _replace_all(_c(s), rules if rules is not None else RESPACE_RULES)


# -------------------------------------------------------------------- T14

def fill_values(post, values) -> Column:
    """The i-th value replaces the i-th `` 1 `` placeholder, left to right.

    A value's inner ``' `` / `` '`` spacing is closed up first; after each
    fill double spaces collapse; placeholders beyond the values stay ``1``.
    """
    vals = F.transform(_c(values), lambda v: F.replace(F.replace(v, F.lit("' "), F.lit("'")), F.lit(" '"), F.lit("'")))

    def step(acc, v):
        m = F.regexp_extract(acc, PLACEHOLDER_PATTERN, 0)
        at = F.regexp_instr(acc, F.lit(PLACEHOLDER_PATTERN))
        put = F.concat(F.substring(acc, 1, at - 1), F.replace(m, F.lit("1"), v),
                       F.substring(acc, at + F.length(m), F.length(acc)))
        return F.when(at > 0, F.replace(put, F.lit("  "), F.lit(" "))).otherwise(acc)
    return F.aggregate(vals, _c(post), step)


# -------------------------------------------------------------------- T18

def candidate_tables(sql) -> Column:
    """Sorted distinct prefixes of whitespace tokens that contain a dot."""
    toks = F.filter(F.split(_c(sql), r"\s+"), lambda t: t.contains("."))
    return F.array_sort(F.array_distinct(F.transform(toks, lambda t: F.substring_index(t, ".", 1))))


# -------------------------------------------------------------------- T19

def drop_table_star(s) -> Column:
    """Remove stray ``t.*`` tokens together with the blanks around them."""
    return F.regexp_replace(_c(s), TABLE_STAR_PATTERN, "")


# -------------------------------------------------------------------- T20

# ---- fixed values: output vocabulary of the query decoder (with FROM clause), in order ----
VOCAB_WITH_FROM = ['_UNK', '_EOS', '.', 't1', 't2', '=', 'select', 'from', 'as', 'value', 'join', 'on', ')', '(',
                   'where', 't3', 'by', ',', 'count', 'group', 'order', 'distinct', 't4', 'and', 'limit', 'desc', '>',
                   'avg', 'having', 'max', 'in', '<', 'sum', 't5', 'intersect', 'not', 'min', 'except', 'or', 'asc',
                   'like', '!', 'union', 'between', 't6', '-', 't7', '+', '/']


def oov_tokens(df: DataFrame, keys: list[str], toks: str, known: DataFrame) -> DataFrame:
    """Rows with a token outside ``known`` (vocabulary + schema tokens, one column ``token``).

    ``known`` is schema-sized and broadcast; only the out-of-vocabulary
    tokens reach the shuffle of the per-row aggregate.
    """
    x = df.select(*keys, F.posexplode(toks).alias("pos", "token"))
    x = x.join(known.select("token").distinct(), "token", "left_anti")
    return x.groupBy(*keys).agg(F.min_by("token", "pos").alias("first_oov"), F.count("*").alias("n_oov"))
