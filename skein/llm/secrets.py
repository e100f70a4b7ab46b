"""Secret scans over an incremental blob ledger, in DataFrame and SQL functions only.

Every version of every path is addressed by the SHA-256 of its content. A ledger holds, for each blob, the rule
versions that have scanned it and what they found; a scan reads only pairs of blob and rule version that the ledger
does not hold, each blob once however many paths share it, and findings join back to all paths by blob.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import cut, unused


@dataclass(frozen=True)
class Rule:
    """kind: name in findings; pattern: leftmost non-overlapping matches; group, least: matches whose group has
    fewer characters are dropped; version: raise it when the rule changes, and blobs are scanned again for it."""

    kind: str
    pattern: str
    group: int
    least: int
    version: int = 1

    @property
    def tag(self) -> str:
        return f"{self.kind}@{self.version}"


#: The three base kinds, in their order, and one more.
BASE = (
    Rule("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
RULES = (*BASE, Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1))

_SPANS = "array<struct<start:int,stop:int>>"
LEDGER = f"blob binary, rules array<string>, findings array<struct<rule:string,spans:{_SPANS}>>"


def spans(text: Column, rule: Rule) -> Column:
    """(start, stop) in characters, stop exclusive, of the rule's matches, in order.

    What lies between matches comes from a split at the pattern; running lengths give the places.
    """
    p = F.lit(rule.pattern)
    parts = F.split(text, rule.pattern, -1)
    both = F.arrays_zip(parts.alias("gap"), F.regexp_extract_all(text, p, F.lit(0)).alias("hit"), F.regexp_extract_all(text, p, F.lit(rule.group)).alias("value"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("out"))

    def step(s, x):
        begin = s["at"] + F.length(x["gap"])
        stop = begin + F.coalesce(F.length(x["hit"]), F.lit(0))
        kept = x["hit"].isNotNull() & (F.length(x["value"]) >= rule.least)
        found = F.struct(begin.alias("start"), stop.alias("stop"))
        return F.struct(stop.alias("at"), F.when(kept, F.concat(s["out"], F.array(found))).otherwise(s["out"]).alias("out"))

    # a longer form of simple rules tells most texts apart at one look
    quick = rule.pattern[:-1] + "{%d,}" % (rule.least - (4 if rule.kind == "access" else 0)) if rule.group == 0 and rule.pattern.endswith("+") else rule.pattern
    return F.when(text.rlike(quick), F.aggregate(both, start, step, lambda s: s["out"])).otherwise(F.array().cast(_SPANS))


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Ledger rows (blob, rules, findings) of the pairs that ``ledger`` lacks, for (…, text) versions.

    The text column is ``text``; null is empty. Append the result to the ledger; a blob may have several rows there.
    """
    blobs = versions.select(F.unhex(F.sha2("text", 256)).alias("blob"), "text").groupBy("blob").agg(F.first("text").alias("text"))
    tags = F.array(*(F.lit(r.tag) for r in rules))
    if ledger is None:
        todo = blobs.withColumn("rules", tags)
    else:
        seen = ledger.select("blob", F.explode("rules").alias("rule")).where(F.col("rule").isin([r.tag for r in rules])).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        todo = blobs.join(seen, "blob", "left").withColumn("rules", F.array_except(tags, F.coalesce("seen", F.array().cast("array<string>")))).where(F.size("rules") > 0)
    each = [F.struct(F.lit(r.tag).alias("rule"), F.when(F.array_contains("rules", r.tag), spans(F.col("text"), r)).otherwise(F.array().cast(_SPANS)).alias("spans")) for r in rules]
    return todo.select("blob", "rules", F.filter(F.array(*each), lambda x: F.size(x["spans"]) > 0).alias("findings"))


def _of(found: Column, rule: Rule) -> Column:
    """Spans of one rule."""
    return F.flatten(F.transform(F.filter(found, lambda x: x["rule"] == rule.tag), lambda x: x["spans"]))


def _joined(found: Column, rules: Sequence[Rule]) -> Column:
    """kind:start:stop of all spans, by start and then by the rules' order, joined by commas."""
    def rows(i: int, rule: Rule) -> Column:
        return F.transform(_of(found, rule), lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("i"), s["stop"].alias("stop"), F.lit(rule.kind).alias("kind")))

    every = F.concat(*(rows(i, r) for i, r in enumerate(rules)))
    return F.array_join(F.transform(F.array_sort(every), lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def _count(found: Column, rule: Rule) -> Column:
    return F.size(_of(found, rule)).cast("long")


def findings(versions: DataFrame, ledger: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``versions`` (any columns and ``text``) without the text, with ``found``: findings of the ledger for the rules.

    Every path and version with a blob gets the blob's findings; versions without findings get an empty array.
    """
    kind = f"array<struct<rule:string,spans:{_SPANS}>>"
    blob = unused(versions, "blob")
    per = ledger.where(F.size("findings") > 0).select(F.col("blob").alias(blob), F.explode("findings").alias("f")).where(F.col("f.rule").isin([r.tag for r in rules]))
    per = per.groupBy(blob).agg(F.collect_set("f").alias("found"))  # one element a rule
    per = cut(per, "findings")  # so that the join below can split a blob that many paths share
    ids = versions.withColumn(blob, F.unhex(F.sha2("text", 256))).drop("text")
    return ids.join(per, blob, "left").drop(blob).withColumn("found", F.coalesce("found", F.array().cast(kind)))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """(doc_id, n_<kind> for each base kind, base_sha256, spans) of every row, over a ledger made for this call.

    Null texts are empty and hold nothing; rows with equal text share one scan; repeated rows and null ids stay.
    """
    versions = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ledger = cut(scan(versions, None, rules), "ledger")
    out = findings(versions, ledger, rules)
    base = [r for r in rules if r in BASE]
    return out.select("doc_id", *(_count(F.col("found"), r).alias(f"n_{r.kind}") for r in base), F.sha2(_joined(F.col("found"), base), 256).alias("base_sha256"), _joined(F.col("found"), rules).alias("spans"))


def without_secrets(docs: DataFrame, text_col: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """``docs`` with every found span of the text replaced by [SECRET]; overlapping spans are replaced together.

    All columns stay; a null text stays null. A column n_chars, where there is one, is set to the new length of
    the texts that changed.
    """
    blob, spots = unused(docs, "blob"), unused(docs, "spots")
    versions = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = cut(scan(versions, None, rules), "ledger").where(F.size("findings") > 0).select(F.col("blob").alias(blob), F.array_sort(F.flatten(F.transform("findings", lambda x: x["spans"]))).alias(spots))
    found = cut(found, "findings")
    out = docs.join(found, F.unhex(F.sha2(F.coalesce(docs[text_col].cast("string"), F.lit("")), 256)) == F.col(blob), "left")
    clear = F.expr(f"""aggregate(`{spots}`, struct(0 as at, '' as done), (s, x) -> if(x.stop <= s.at, s, struct(x.stop as at,
        if(x.start >= s.at, concat(s.done, substring(`{text_col}`, s.at + 1, x.start - s.at), '[SECRET]'), s.done) as done)),
        s -> concat(s.done, substring(`{text_col}`, s.at + 1, length(`{text_col}`))))""")
    text = F.when(F.col(spots).isNull(), docs[text_col]).otherwise(clear)
    new = {text_col: text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col(spots).isNull(), docs["n_chars"]).otherwise(F.length(text).cast(docs.schema["n_chars"].dataType))
    return out.select(*(new.get(c, docs[c]).alias(c) for c in docs.columns))


def _sql_kind(r: Rule, i: int) -> str:
    p = r.pattern.replace("'", "''")
    return f"""select doc_id, {i} as i, '{r.kind}' as kind, unnest(list_filter(list_transform(range(1, len(m) + 1), lambda k: struct_pack(
        s := list_sum(list_transform(p[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0), n := length(m[k]), v := length(v[k]))), lambda x: x.v >= {r.least})) as x
        from (select doc_id, regexp_extract_all(t, '{p}') m, regexp_extract_all(t, '{p}', {r.group}) v, string_split_regex(t, '{p}') p from d)"""


#: The same report in the oracle's SQL.
ORACLE = f"""with d as (select doc_id, coalesce(text, '') as t from documents), f as ({" union all ".join(_sql_kind(r, i) for i, r in enumerate(RULES))}),
    g as (select doc_id, count(*) filter (i = 0) n_assign, count(*) filter (i = 1) n_access, count(*) filter (i = 2) n_hex,
        coalesce(string_agg(kind || ':' || cast(x.s as bigint) || ':' || cast(x.s + x.n as bigint), ',' order by x.s, i) filter (i < 3), '') base,
        string_agg(kind || ':' || cast(x.s as bigint) || ':' || cast(x.s + x.n as bigint), ',' order by x.s, i) spans from f group by doc_id)
    select d.doc_id, coalesce(n_assign, 0) n_assign, coalesce(n_access, 0) n_access, coalesce(n_hex, 0) n_hex, sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans
    from d left join g using (doc_id)"""
