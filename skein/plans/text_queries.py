"""Text family: BLEU over adjacent conversation turns."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.operators import bleu
from skein.plans.registry import register
from skein.session import Tables, by_key, stored


def bleu_inputs(spark, d):
    """Hypothesis = an assistant turn; references = the turns right before and after it."""
    c = Tables(spark, d).conversations.select("conv_id", "turn", "role", bleu.tokens("text").alias("toks"))
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = c.select("*", F.lag("toks").over(w).alias("prev"), F.lead("toks").over(w).alias("next"))
    a = c.filter(F.col("role") == "assistant").withColumn("pair_id", F.col("conv_id") * 1000 + F.col("turn"))
    hyp = a.select("pair_id", "toks")
    refs = a.select("pair_id", F.lit(0).alias("ref_id"), F.col("prev").alias("toks")).unionByName(
        a.select("pair_id", F.lit(1).alias("ref_id"), F.col("next").alias("toks"))).filter(F.col("toks").isNotNull())
    return hyp, refs


BLEU_SQL = r"""WITH c AS (
  SELECT conv_id, turn, role, list_filter(string_split_regex(lower(text), '\s+'), lambda s: s <> '') AS toks
  FROM conversations),
c2 AS (
  SELECT *, lag(toks) OVER w AS prev, lead(toks) OVER w AS nxt FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
a AS (SELECT conv_id * 1000 + turn AS pair_id, toks, prev, nxt FROM c2 WHERE role = 'assistant'),
hyp AS (SELECT pair_id, toks FROM a),
refs AS (SELECT pair_id, 0 AS ref_id, prev AS toks FROM a WHERE prev IS NOT NULL
         UNION ALL SELECT pair_id, 1, nxt FROM a WHERE nxt IS NOT NULL),
ng_h AS (SELECT pair_id, n, array_to_string(toks[i:i + n - 1], ' ') AS g
         FROM hyp, range(1, 5) AS r(n), LATERAL (SELECT unnest(range(1, CAST(greatest(len(toks) - n + 1, 0) AS BIGINT) + 1)) AS i)),
ng_r AS (SELECT pair_id, ref_id, n, array_to_string(toks[i:i + n - 1], ' ') AS g
         FROM refs, range(1, 5) AS r(n), LATERAL (SELECT unnest(range(1, CAST(greatest(len(toks) - n + 1, 0) AS BIGINT) + 1)) AS i)),
ch AS (SELECT pair_id, n, g, count(*) AS ch FROM ng_h GROUP BY ALL),
cr AS (SELECT pair_id, n, g, max(c) AS mr FROM (SELECT pair_id, ref_id, n, g, count(*) AS c FROM ng_r GROUP BY ALL) GROUP BY ALL),
pn0 AS (SELECT ch.pair_id, ch.n, sum(least(ch.ch, coalesce(cr.mr, 0))) AS num, sum(ch.ch) AS cnt
        FROM ch LEFT JOIN cr ON cr.pair_id = ch.pair_id AND cr.n = ch.n AND cr.g = ch.g GROUP BY ALL),
grid AS (SELECT pair_id, n FROM hyp, range(1, 5) AS r(n)),
mp AS (SELECT g.pair_id, g.n, CAST(coalesce(p.num, 0) AS BIGINT) AS num, CAST(greatest(coalesce(p.cnt, 0), 1) AS BIGINT) AS den
       FROM grid g LEFT JOIN pn0 p ON p.pair_id = g.pair_id AND p.n = g.n),
hl AS (SELECT pair_id, len(toks) AS hyp_len FROM hyp),
rl AS (SELECT h.pair_id, arg_min(len(r.toks), abs(len(r.toks) - h.hyp_len) * 1000000 + len(r.toks)) AS ref_len
       FROM hl h JOIN refs r ON r.pair_id = h.pair_id GROUP BY h.pair_id),
ln AS (SELECT h.pair_id, h.hyp_len, r.ref_len,
        CASE WHEN h.hyp_len > r.ref_len THEN 1.0 WHEN h.hyp_len = 0 THEN 0.0 ELSE exp(1.0 - r.ref_len / h.hyp_len) END AS bp
       FROM hl h LEFT JOIN rl r USING (pair_id))
"""


def _corpus_sql(methods):
    exprs = []
    for m in methods:
        ps = []
        zeros = "0"
        for n in range(1, 5):
            nu, de = f"num{n}", f"den{n}"
            if m == 0:
                ps.append(f"CASE WHEN {nu} <> 0 THEN {nu} / {de} ELSE 2.2250738585072014e-308 END")
            elif m == 1:
                ps.append(f"CASE WHEN {nu} <> 0 THEN {nu} / {de} ELSE ({nu} + 0.1) / {de} END")
            elif m == 2:
                ps.append(f"({nu} + 1.0) / ({de} + 1.0)")
            elif m == 3:
                ps.append(f"CASE WHEN {nu} <> 0 THEN {nu} / {de} ELSE 1.0 / (pow(2.0, {zeros} + 1) * {de}) END")
                zeros = f"{zeros} + CASE WHEN {nu} = 0 THEN 1 ELSE 0 END"
            elif m == 4:
                ps.append(f"CASE WHEN {nu} = 0 AND hyp_len <> 0 THEN ({n - 1}.0 + 5.0 / ln(hyp_len)) / {de} ELSE {nu} / {de} END")
        s = " + ".join(f"0.25 * ln({p})" for p in ps)
        exprs.append(f"CASE WHEN num1 = 0 THEN 0.0 ELSE bp * exp({s}) END AS bleu_m{m}")
    return exprs


def _corpus_query(methods):
    pooled = ", ".join([f"sum(CASE WHEN n = {n} THEN num END) AS num{n}" for n in range(1, 5)] +
                       [f"sum(CASE WHEN n = {n} THEN den END) AS den{n}" for n in range(1, 5)])
    return (BLEU_SQL + f", pooled AS (SELECT {pooled} FROM mp), "
            "tot AS (SELECT sum(hyp_len) AS hyp_len, sum(coalesce(ref_len, 0)) AS ref_len FROM ln), "
            "x AS (SELECT *, CASE WHEN hyp_len > ref_len THEN 1.0 WHEN hyp_len = 0 THEN 0.0 ELSE exp(1.0 - ref_len / hyp_len) END AS bp "
            "FROM pooled, tot) "
            "SELECT CAST(hyp_len AS BIGINT) AS hyp_len, CAST(ref_len AS BIGINT) AS ref_len, bp, "
            + ", ".join(f"num{n} / den{n} AS p{n}" for n in range(1, 5)) + ", " + ", ".join(_corpus_sql(methods)) + " FROM x")


@register("e26_corpus_bleu", _corpus_query([0]))
def e26(spark, d):
    return bleu.corpus_bleu(*bleu_inputs(spark, d), methods=(0,))


@register("e27_modified_precision", BLEU_SQL + "SELECT pair_id, n, num, den FROM mp")
def e27(spark, d):
    return bleu.modified_precision(*bleu_inputs(spark, d)).select("pair_id", F.col("n").cast("int"), "num", "den")


@register("e28_closest_ref_length", BLEU_SQL + "SELECT pair_id, hyp_len, ref_len FROM ln")
def e28(spark, d):
    return bleu.lengths(*bleu_inputs(spark, d)).select("pair_id", "hyp_len", "ref_len")


@register("e29_brevity_penalty", BLEU_SQL + "SELECT pair_id, round(bp, 6) AS bp FROM ln")
def e29(spark, d):
    return bleu.lengths(*bleu_inputs(spark, d)).select("pair_id", F.round("bp", 6).alias("bp"))


@register("e30_smooth_0_3", _corpus_query([0, 1, 2, 3]))
def e30(spark, d):
    return bleu.corpus_bleu(*bleu_inputs(spark, d), methods=(0, 1, 2, 3))


@register("e31_smooth_4", _corpus_query([4]))
def e31(spark, d):
    return bleu.corpus_bleu(*bleu_inputs(spark, d), methods=(4,))


def _sentence_sql():
    per = ", ".join([f"max(CASE WHEN n = {n} THEN num END) AS num{n}" for n in range(1, 5)] +
                    [f"max(CASE WHEN n = {n} THEN den END) AS den{n}" for n in range(1, 5)])
    return (BLEU_SQL + f", per AS (SELECT pair_id, {per} FROM mp GROUP BY pair_id) "
            "SELECT pair_id, " + ", ".join(_corpus_sql([0, 1])) + " FROM per JOIN ln USING (pair_id)")


@register("e32_sentence_bleu", _sentence_sql())
def e32(spark, d):
    return bleu.sentence_bleu(*bleu_inputs(spark, d), methods=(0, 1))


@register("e33_corpus_bleu_report", "SELECT round(bleu_m3 * 100, 4) AS bleu FROM (" + _corpus_query([3]) + ")")
def e33(spark, d):
    return bleu.corpus_bleu(*bleu_inputs(spark, d), methods=(3,)).select(F.round(F.col("bleu_m3") * 100, 4).alias("bleu"))


# ------------------------------------------------------------- value linking

from skein.operators import link as lk  # noqa: E402

LINK_TABLES = ["region", "nation", "customer", "supplier", "part", "orders"]
_TEXT_COLS = {"region": ["r_name"], "nation": ["n_name"], "customer": ["c_name", "c_mktsegment"],
              "supplier": ["s_name"], "part": ["p_name", "p_brand", "p_type"],
              "orders": ["o_orderstatus", "o_orderpriority"]}


def _picklist(spark, d):
    t = Tables(spark, d)
    return lk.picklist({n: getattr(t, n) for n in LINK_TABLES})


_PICK_SQL = " UNION ".join(f"SELECT DISTINCT '{t}' AS table_name, '{c}' AS column_name, {c} AS value FROM {t} "
                           f"WHERE {c} IS NOT NULL" for t, cs in _TEXT_COLS.items() for c in cs)
_STOP_SQL = ", ".join("'" + w.replace("'", "''") + "'" for w in lk.STOPWORDS)
_LINK_SQL = f"""WITH pl AS ({_PICK_SQL}),
vals AS (SELECT *, trim(lower(value)) AS v FROM pl),
cv AS (SELECT * FROM vals WHERE length(v) > 1 AND NOT regexp_matches(replace(v, ',', ''), '{lk.NUMBER_RE}')
       AND v NOT IN ('id') AND v NOT IN ({_STOP_SQL})),
mx AS (SELECT max(len(string_split_regex(trim(value), ' +'))) AS mn FROM pl),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '{lk.SEP_SPLIT.replace(chr(39), chr(39) * 2)}'), lambda x: x <> '') AS w FROM documents),
sp AS (SELECT doc_id, s - 1 AS start, n, array_to_string(w[s:s + n - 1], ' ') AS span
       FROM w, mx, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS s), LATERAL (SELECT unnest(range(1, mn + 1)) AS n)
       WHERE s - 1 + n <= len(w)),
ex AS (SELECT sp.doc_id, cv.table_name, cv.column_name, cv.value, sp.span, 1.0 AS score, length(sp.span) AS match_len
       FROM sp JOIN cv ON sp.span = cv.v WHERE sp.span NOT IN ({_STOP_SQL})),
lohi AS (SELECT min(length(v)) - 1 AS lo, max(length(v)) + 1 AS hi FROM cv),
sk AS (SELECT DISTINCT doc_id, start, n, span, unnest(list_distinct(list_concat([span], list_transform(range(1, length(span) + 1),
          lambda i: substr(span, 1, i - 1) || substr(span, i + 1))))) AS k
       FROM sp, lohi WHERE length(span) BETWEEN lo AND hi AND span NOT IN ({_STOP_SQL})),
vk AS (SELECT DISTINCT table_name, column_name, value, v, unnest(list_distinct(list_concat([v], list_transform(range(1, length(v) + 1),
          lambda i: substr(v, 1, i - 1) || substr(v, i + 1))))) AS k FROM cv),
cand AS (SELECT DISTINCT sk.doc_id, sk.start, sk.n, sk.span, vk.table_name, vk.column_name, vk.value, vk.v
         FROM sk JOIN vk USING (k)),
sc AS (SELECT *, 1.0 - (CASE WHEN span = v THEN 0 WHEN abs(length(span) - length(v)) = 1 THEN 1 ELSE 2 END)
                 / (length(span) + length(v)) AS score FROM cand),
fz0 AS (SELECT * FROM sc WHERE substr(ltrim(span), 1, 1) = substr(ltrim(v), 1, 1) AND score >= 0.85
        AND (NOT (v IN ('many', 'no', 'yes') OR upper(value) = value) OR score >= 1.0)),
fz AS (SELECT doc_id, table_name, column_name, value, span, score, length(span) AS match_len FROM (
        SELECT *, row_number() OVER (PARTITION BY doc_id, table_name, column_name, value
                                     ORDER BY score DESC, length(span) DESC, start) AS r FROM fz0) WHERE r = 1)
"""


def _spans(spark, d):
    """Spans near a value, and the values: both are read several times and stored, the values in as many files as a shuffle has parts."""
    pl = stored(by_key(_picklist(spark, d), "value"))
    return stored(lk.spans(Tables(spark, d).documents, "doc_id", "text", lk.max_value_words(pl), near=pl)), pl


@register("k01_picklist", _PICK_SQL)
def k01(spark, d):
    return _picklist(spark, d)


@register("k02_spans", _LINK_SQL + "SELECT doc_id, count(*) AS n_spans, count(DISTINCT span) AS n_distinct FROM sp GROUP BY doc_id")
def k02(spark, d):
    return lk.span_counts(Tables(spark, d).documents, "doc_id", "text", lk.max_value_words(_picklist(spark, d)))


@register("k03_link_exact", _LINK_SQL + "SELECT * FROM ex")
def k03(spark, d):
    sp, pl = _spans(spark, d)
    return lk.link_exact(sp, pl, "doc_id")


@register("k04_link_fuzzy", _LINK_SQL + "SELECT doc_id, table_name, column_name, value, span, round(score, 6) AS score, match_len FROM fz")
def k04(spark, d):
    sp, pl = _spans(spark, d)
    return lk.link_fuzzy(sp, pl, "doc_id").withColumn("score", F.round("score", 6))


@register("k06_link_top_k", _LINK_SQL + "SELECT doc_id, table_name, column_name, value, CAST(rank AS INTEGER) AS rank FROM ("
          "SELECT *, row_number() OVER (PARTITION BY doc_id, table_name, column_name ORDER BY score DESC, match_len DESC, value) AS rank "
          "FROM (SELECT * FROM ex UNION ALL SELECT * FROM fz)) WHERE rank <= 2")
def k06(spark, d):
    sp, pl = _spans(spark, d)
    links = lk.link_exact(sp, pl, "doc_id").unionByName(lk.link_fuzzy(sp, pl, "doc_id"))
    return lk.link_top_k(links, "doc_id").select("doc_id", "table_name", "column_name", "value", "rank")
