"""Lint family: findings on the fault-injected query log."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from skein.functions.hashing import sql_bucket
from skein.operators import lint as ln
from skein.operators import tokens as tk
from skein.plans.querylog import query_log, with_ql
from skein.plans.querylog_queries import _SQL_TOKS, _SQL_TT
from skein.plans.registry import register
from skein.session import by_key, Tables, cut_lineage
from skein.sources.catalog import STAR_TABLE_ORDER, star_catalog

KEYS = ["query_id", "side"]


def _texts(spark, d):
    """(log, texts, found): the fault log, its different texts with their least query and the findings of those."""
    t = Tables(spark, d)
    log = ln.inject_faults(query_log(spark, t.events))
    # a log repeats its texts: each different one is checked once, and its findings go to all its rows
    texts = log.groupBy("sql").agg(F.min("query_id").alias("k"))
    x = tk.tokenize(by_key(texts.withColumnRenamed("k", "query_id"), "query_id"), "sql").filter(F.col("toks").isNotNull()).withColumn("side", F.lit("q"))
    rt = tk.resolve(tk.token_table(x, KEYS), KEYS, star_catalog(spark, d).columns)
    return log, texts, ln.lint(rt, KEYS).drop("side").withColumnRenamed("query_id", "k")


def findings(spark, d, rule: str | None = None):
    """Findings of every query of the log, of one rule if named."""
    log, texts, found = _texts(spark, d)
    if rule:
        # only texts with a finding of the rule meet the log, and nothing is written
        return log.select("query_id", "sql").join(texts.join(found.filter(F.col("rule") == rule), "k").drop("k"), "sql").drop("sql")
    return cut_lineage(log.select("query_id", "sql").join(texts, "sql").join(found, "k").drop("k", "sql"))


@register("l00_lint_findings")
def l00(spark, d):
    return findings(spark, d)


def _rule(name):
    def fn(spark, d):
        return findings(spark, d, name)
    return fn


# ---- SQL of the rules that need no scopes or types: the fault log, its tokens, one predicate each ----
def _fault_log_sql() -> str:
    def text(x):
        return x.replace("'", "''")

    cases = " ".join(f"WHEN {i} THEN regexp_replace(gold, '{text(p)}', '{text(re.sub(chr(92) + '$([0-9])', chr(92) * 2 + chr(92) + '1', r))}', 'g')" for i, (_, p, r) in enumerate(ln.FAULTS) if p)
    return f"""flog AS (SELECT query_id, CASE {sql_bucket('f', 'query_id', len(ln.FAULTS))} {cases} ELSE gold END AS sql FROM ql),
sides AS (SELECT query_id, 'q' AS side, sql FROM flog),
{_SQL_TOKS[_SQL_TOKS.index('norm AS ('):]}"""


_STAR = ", ".join(f"'{t}'" for t in STAR_TABLE_ORDER)
_KEYS = ", ".join(f"'{k}'" for k in tk.KEYWORDS)
_IDENT = f"(regexp_matches(token, '^[a-z_][a-z0-9_#$]*$') AND token NOT IN ({_KEYS}))"
_IS_TABLE = f"(token IN ({_STAR}) AND clause = 'from' AND coalesce(prev_tok, '') <> 'as')"
_ROW = "SELECT query_id, '{rule}' AS rule, CAST(block AS INTEGER) AS block, CAST(pos AS INTEGER) AS pos, {detail} AS detail FROM tt WHERE {where}"
_GROUP = "SELECT query_id, '{rule}' AS rule, CAST(block AS INTEGER) AS block, CAST(max(pos) AS INTEGER) AS pos, token AS detail FROM tt WHERE {where} GROUP BY query_id, block, token HAVING count(*) > 1"
_RULE_SQL = {
    "unknown_table": _ROW.format(rule="unknown_table", detail="token", where=f"clause = 'from' AND {_IDENT} AND coalesce(prev_tok, '') <> 'as' AND NOT {_IS_TABLE}"),
    "duplicate_alias": _GROUP.format(rule="duplicate_alias", where="clause = 'from' AND prev_tok = 'as'"),
    "duplicate_table": _GROUP.format(rule="duplicate_table", where=f"{_IS_TABLE} AND coalesce(next_tok, '') <> 'as'"),
    "bad_alias_name": _ROW.format(rule="bad_alias_name", detail="token", where="clause = 'from' AND prev_tok = 'as' AND NOT regexp_matches(token, '^t[0-9]{1,10}$')"),
    "literal_too_long": _ROW.format(rule="literal_too_long", detail="CAST(length(token) AS VARCHAR)",
                                    where="(token LIKE '\"%' AND length(token) - 2 > 64) OR (clause = 'limit' AND regexp_matches(token, '^[0-9]+$') AND length(token) > 8)"),
}

for _i, _r in enumerate(ln.RULES, start=1):
    register(f"l{_i:02d}_{_r}", with_ql(_RULE_SQL[_r], _fault_log_sql(), _SQL_TT) if _r in _RULE_SQL else None)(_rule(_r))


@register("l99_fault_recall")
def l99(spark, d):
    """Per injected fault class: queries flagged with the matching rule (class clean: with any) / all queries of the class."""
    log, texts, found = _texts(spark, d)
    # queries of one text and class are flagged alike: they are counted before they meet the findings
    n = log.groupBy("sql", "fault").agg(F.count("*").alias("n"))
    f = texts.join(found.groupBy("k").agg(F.collect_set("rule").alias("rules")), "k").select("sql", "rules")
    hit = F.coalesce(F.array_contains("rules", F.col("fault")) | ((F.col("fault") == "clean") & (F.size("rules") > 0)), F.lit(False))
    return n.join(f, "sql", "left").groupBy("fault").agg(F.sum("n").alias("n"), F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("flagged"))
