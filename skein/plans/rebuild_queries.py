"""FROM clauses: rebuilt join trees (T17) and the round trip query -> no-FROM -> rebuilt -> exact match."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions.hashing import bucket, sql_bucket
from skein.operators import generate as gen
from skein.operators import rebuild as rb
from skein.operators import score as sc
from skein.plans.catalog_queries import CAT_SQL
from skein.plans.querylog import query_log
from skein.plans.registry import register
from skein.session import Tables, by_key, cut_lineage, stored
from skein.sources.catalog import star_catalog

KEYS = ["query_id", "side"]
#: Salts of the six columns that an event's no-FROM text may name: four outside, two in a nested block.
SALTS = ["fa", "fb", "fc", "fd", "fe", "ff"]


def no_from_log(spark, d):
    """(query_id, db_id, no_from): one text per event over one to four columns of any star tables, a third of them with a nested block."""
    fields = [f"{t}.{f.name}".lower() for t in _tables(spark) for f in getattr(Tables(spark, d), t).schema.fields]
    names = F.array(*[F.lit(n) for n in fields])
    e = Tables(spark, d).events.select(F.col("event_id").alias("query_id"))
    e = e.select("query_id", (F.lit(1) + bucket("fm", "query_id", 4)).alias("m"), (bucket("fn", "query_id", 3) == 0).alias("nested"),
                 *[F.element_at(names, (bucket(s, "query_id", len(fields)) + 1).cast("int")).alias(s) for s in SALTS])
    star = F.concat(F.substring_index("fa", ".", 1), F.lit(".*"))
    inner = F.when(F.col("nested"), F.concat(F.lit("in ( select "), "fe", F.lit(" where "), "ff", F.lit(" = value )"))).otherwise(F.lit("= value"))
    part = lambda least, *c: F.when(F.col("m") >= least, F.concat(*c)).otherwise(F.lit(""))
    text = F.concat(F.lit("select "), "fa", F.lit(" , count ( "), star, F.lit(" )"), part(2, F.lit(" where "), F.col("fb"), F.lit(" "), inner),
                    part(3, F.lit(" group by "), F.col("fc")), part(4, F.lit(" order by "), F.col("fd"), F.lit(" desc limit limit_value")))
    return e.select("query_id", F.lit("star").alias("db_id"), text.alias("no_from"))


def _tables(spark):
    from skein.sources.catalog import STAR_TABLE_ORDER
    return STAR_TABLE_ORDER


_PICK = ", ".join(f"names[CAST({sql_bucket(s, 'event_id', 'len(names)')} + 1 AS BIGINT)] AS {s}" for s in SALTS)
_T17_SQL = f"""WITH RECURSIVE {CAT_SQL},
edge AS (
  SELECT x.table_name AS a, arg_min(x.column_name, f.column_id) AS ac, y.table_name AS b, arg_min(y.column_name, f.column_id) AS bc
  FROM lfks f JOIN lcat x ON x.db_id = f.db_id AND x.column_id = f.column_id
  JOIN lcat y ON y.db_id = f.db_id AND y.column_id = f.other_column_id WHERE f.db_id = 'star' GROUP BY x.table_name, y.table_name),
ue AS (SELECT a, ac, b, bc FROM edge UNION ALL SELECT b, bc, a, ac FROM edge),
p(src, dst, hops, path) AS (
  SELECT a, b, 1, a || ' ' || b FROM ue UNION ALL
  SELECT p.src, ue.b, p.hops + 1, p.path || ' ' || ue.b FROM p JOIN ue ON ue.a = p.dst WHERE NOT list_contains(string_split(p.path, ' '), ue.b)),
best AS (SELECT src, dst, path FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY hops, path) AS rn FROM p WHERE src <> dst) WHERE rn = 1),
names AS (SELECT list(lower(table_name || '.' || column_name) ORDER BY column_id) AS names FROM lcat WHERE db_id = 'star'),
log AS (
  SELECT event_id AS query_id, 1 + {sql_bucket('fm', 'event_id', 4)} AS m, {sql_bucket('fn', 'event_id', 3)} = 0 AS nested, {_PICK} FROM events, names),
-- columns in the order of their tokens, by block
used AS (
  SELECT query_id, 1 AS blk, 1 AS tok_at, fa AS c FROM log UNION ALL SELECT query_id, 1, 2, fb FROM log WHERE m >= 2
  UNION ALL SELECT query_id, 1, 3, fc FROM log WHERE m >= 3 UNION ALL SELECT query_id, 1, 4, fd FROM log WHERE m >= 4
  UNION ALL SELECT query_id, 2, 1, fe FROM log WHERE m >= 2 AND nested UNION ALL SELECT query_id, 2, 2, ff FROM log WHERE m >= 2 AND nested),
tabs AS (
  SELECT query_id, blk, t, row_number() OVER (PARTITION BY query_id, blk ORDER BY min(tok_at)) AS i
  FROM (SELECT *, split_part(c, '.', 1) AS t FROM used) GROUP BY query_id, blk, t),
start AS (SELECT query_id, blk, t AS src FROM tabs WHERE i = 1),
nodes AS (
  SELECT query_id, blk, 0 AS i, 0 AS hop, src AS t, NULL AS prev FROM start UNION ALL
  SELECT c.query_id, c.blk, c.i, h.hop, string_split(b.path, ' ')[h.hop + 1], string_split(b.path, ' ')[h.hop]
  FROM tabs c JOIN start s USING (query_id, blk) JOIN best b ON b.src = s.src AND b.dst = c.t, range(1, 20) AS h(hop)
  WHERE c.i > 1 AND h.hop < len(string_split(b.path, ' ')) UNION ALL
  SELECT c.query_id, c.blk, c.i, 1, c.t, NULL FROM tabs c JOIN start s USING (query_id, blk)
  WHERE c.i > 1 AND NOT EXISTS (SELECT 1 FROM best b WHERE b.src = s.src AND b.dst = c.t)),
tree AS (
  SELECT query_id, blk, t, arg_min(prev, i * 100 + hop) AS prev, row_number() OVER (PARTITION BY query_id, blk ORDER BY min(i * 100 + hop)) AS nr,
         count(*) OVER (PARTITION BY query_id, blk) AS size
  FROM nodes GROUP BY query_id, blk, t),
multi AS (SELECT query_id, blk, count(*) > 1 AS multi FROM tabs GROUP BY query_id, blk),
off AS (
  SELECT m.query_id, m.blk, m.multi, coalesce(sum(CASE WHEN m.multi THEN s.size ELSE 0 END) OVER (PARTITION BY m.query_id ORDER BY m.blk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
  FROM multi m JOIN (SELECT DISTINCT query_id, blk, size FROM tree) s USING (query_id, blk)),
named AS (SELECT t.*, 'T' || CAST(CAST(o.off AS BIGINT) + t.nr AS VARCHAR) AS alias, o.multi FROM tree t JOIN off o USING (query_id, blk)),
clause AS (
  SELECT n.query_id, n.blk, CASE WHEN any_value(n.multi) THEN ' from ' || string_agg(
      CASE WHEN n.nr = 1 THEN '' ELSE 'join ' END || n.t || ' as ' || n.alias ||
      CASE WHEN n.prev IS NULL THEN '' ELSE ' on ' || q.alias || '.' || e.ac || ' = ' || n.alias || '.' || e.bc END, ' ' ORDER BY n.nr)
    ELSE ' from ' || min(n.t) END AS f
  FROM named n LEFT JOIN named q ON q.query_id = n.query_id AND q.blk = n.blk AND q.t = n.prev LEFT JOIN ue e ON e.a = n.prev AND e.b = n.t
  GROUP BY n.query_id, n.blk),
col AS (
  SELECT u.query_id, u.blk, u.tok_at, CASE WHEN n.multi THEN n.alias || '.' ELSE '' END || split_part(u.c, '.', 2) AS c
  FROM used u JOIN named n ON n.query_id = u.query_id AND n.blk = u.blk AND n.t = split_part(u.c, '.', 1)),
wide AS (
  SELECT query_id, max(CASE WHEN blk = 1 AND tok_at = 1 THEN c END) AS a, max(CASE WHEN blk = 1 AND tok_at = 2 THEN c END) AS b, max(CASE WHEN blk = 1 AND tok_at = 3 THEN c END) AS c,
         max(CASE WHEN blk = 1 AND tok_at = 4 THEN c END) AS d, max(CASE WHEN blk = 2 AND tok_at = 1 THEN c END) AS e, max(CASE WHEN blk = 2 AND tok_at = 2 THEN c END) AS f FROM col GROUP BY query_id)
SELECT w.query_id, 'select ' || w.a || ' , count ( * )' || c1.f
  || CASE WHEN w.b IS NULL THEN '' ELSE ' where ' || w.b || CASE WHEN w.e IS NULL THEN ' = 1' ELSE ' in ( select ' || w.e || c2.f || ' where ' || w.f || ' = 1 )' END END
  || CASE WHEN w.c IS NULL THEN '' ELSE ' group by ' || w.c END || CASE WHEN w.d IS NULL THEN '' ELSE ' order by ' || w.d || ' desc limit 1' END AS sql
FROM wide w JOIN clause c1 ON c1.query_id = w.query_id AND c1.blk = 1 LEFT JOIN clause c2 ON c2.query_id = w.query_id AND c2.blk = 2"""


@register("t17_rebuild_from", _T17_SQL)
def t17(spark, d):
    log = no_from_log(spark, d)
    # texts repeat in a log: each different one is rebuilt once
    texts = log.groupBy("db_id", "no_from").agg(F.min("query_id").alias("k"))
    rebuilt = rb.rebuild_from(by_key(texts, "k"), "k", "no_from", rb.fk_paths(star_catalog(spark, d)))
    return log.join(texts.join(rebuilt, "k").select("db_id", "no_from", "sql"), ["db_id", "no_from"]).select("query_id", "sql")


def roundtrip(spark, d):
    """(query_id, gold, no_from, rebuilt) of the query log; each different gold text goes through once."""
    cat = star_catalog(spark, d)
    log = query_log(spark, Tables(spark, d).events)
    texts = stored(log.groupBy("gold").agg(F.min("query_id").alias("query_id")))
    ut, _ = sc.query_tokens(texts, "query_id", cat.columns, sides=("gold",))
    nf = gen.no_from_tokens(ut, KEYS).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", "ntok"))).alias("ts"))
    nf = cut_lineage(nf.select("query_id", F.lit("star").alias("db_id"), F.array_join(F.transform("ts", lambda s: s["ntok"]), " ").alias("no_from")))
    back = rb.rebuild_from(nf, "query_id", "no_from", rb.fk_paths(cat), out="rebuilt")
    return cut_lineage(texts.join(nf.select("query_id", "no_from"), "query_id").join(back, "query_id")), log


@register("d37_roundtrip_audit", """WITH audit AS (SELECT event_id AS query_id FROM events) SELECT query_id, 1 AS exact, true AS valid FROM audit""")
def d37(spark, d):
    """A log query is valid when its rebuilt form scores an exact match (E16) against it. The SQL states the audit's outcome: every query of the log survives."""
    once, log = roundtrip(spark, d)
    per, _ = sc.score_pairs(once.select("query_id", "gold", F.col("rebuilt").alias("pred")), "query_id", star_catalog(spark, d).columns)
    # stored, so that few texts are broadcast and the log is not shuffled
    flags = stored(once.select("query_id", "gold").join(per.select("query_id", "exact"), "query_id", "left").select("gold", F.coalesce("exact", F.lit(0)).alias("exact")))
    return log.join(flags, "gold").select("query_id", "exact", (F.col("exact") == 1).alias("valid"))
