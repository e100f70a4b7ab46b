"""Chunked prefix helpers against pandas; fuzzy linking against brute force."""

import pandas as pd
from pyspark.sql import functions as F

from skein.functions import ordered
from skein.operators import link as lk


def test_global_ordinal_and_running(spark):
    pdf = pd.DataFrame({"k": [5, 1, 9000, 3, 12000, 7, 4097], "v": [1.0, 2.0, 3.0, 4.0, 5.0, 0.5, 9.0]})
    df = spark.createDataFrame(pdf)
    chunk = F.floor(F.col("k") / 4096)
    got = ordered.global_ordinal(df, chunk, [F.col("k")], "rn")
    got = ordered.running_sum(got, chunk, [F.col("k")], F.col("v"), "s")
    got = ordered.running_max(got, chunk, [F.col("k")], F.col("v"), "m", inclusive=False).toPandas().sort_values("k")
    exp = pdf.sort_values("k")
    assert list(got["rn"]) == list(range(1, len(pdf) + 1))
    assert list(got["s"]) == list(exp["v"].cumsum())
    prev_max = exp["v"].cummax().shift(1)
    assert [None if pd.isna(a) else a for a in got["m"]] == [None if pd.isna(b) else b for b in prev_max]


def _indel(a, b):
    # brute force: indel distance = len(a) + len(b) - 2 * LCS
    m = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            m[i + 1][j + 1] = m[i][j] + 1 if a[i] == b[j] else max(m[i][j + 1], m[i + 1][j])
    return len(a) + len(b) - 2 * m[len(a)][len(b)]


def test_fuzzy_links_match_brute_force(spark):
    docs = spark.createDataFrame([(1, "We flew to Germny and then to frnace, then Spain."),
                                  (2, "Nothing here but the Unitd Kingdom and spainn")], "doc_id long, text string")
    pl = spark.createDataFrame([("country", "name", v) for v in ["Germany", "France", "Spain", "United Kingdom"]],
                               "table_name string, column_name string, value string")
    sp = lk.spans(docs, "doc_id", "text", 2)
    got = {(r["doc_id"], r["value"]) for r in lk.link_fuzzy(sp, pl, "doc_id").collect()}
    expected = set()
    for r in sp.collect():
        for v in ["Germany", "France", "Spain", "United Kingdom"]:
            s, lv = r["span"], v.lower()
            d = _indel(s, lv)
            score = 1 - d / (len(s) + len(lv))
            if d <= 2 and s[0] == lv[0] and score >= 0.85:
                expected.add((r["doc_id"], v))
    assert got == expected
    assert (1, "Germany") in got and (2, "Spain") in got
