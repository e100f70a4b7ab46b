"""Importance resampling against a plain version and its SQL."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from skein.llm import queries, resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, longest):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(w), [" ".join(w[i:i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def plain(docs, target, share, least, buckets, longest, seed):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in docs for f in features(t, longest)[1])
    t = Counter(bucket(f) for x in target for f in features(x, longest)[1])
    sums, sumt = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (sums + buckets) / ((s[b] + 1) * (sumt + buckets)))) for b in s}
    rows = []
    for d, x in docs:
        n, f = features(x, longest)
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        w = sum(gain[bucket(g)] for g in f)
        rows.append((d, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    fit = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    drawn = math.floor(share * len(fit) / 100)
    out = [(*r[:4], i + 1) for i, r in enumerate(fit[:drawn])]
    left = Counter((*r[:4], None) for r in rows) - Counter((*r[:4], None) for r in fit[:drawn])
    return sorted(out + list(left.elements()), key=str)


DOCS = [(i, " ".join(f"w{(i * j) % 97} Äpfel x{j % (i % 13 + 1)}" for j in range(i % 40))) for i in range(400)]
DOCS += [(7, DOCS[7][1]), (7, DOCS[7][1]), (None, "a b c " * 30), (None, None), (401, None), (402, ""), (403, "--- !!"), (404, "Zahl 12 " * 90000)] + [(500 + i, DOCS[39][1]) for i in range(200)]
AIM = ["w3 w5 äpfel W9 w12", None, "", "x1 x2 x3 " * 50, "漢字 w0"]


@pytest.mark.parametrize("longest,share,least", [(1, 10, 20), (3, 37, 1), (2, 100, 0), (1, 0, 20)])
def test_equals_the_plain_version(spark, longest, share, least, monkeypatch):
    monkeypatch.setattr(resample, "SLICE", 1 << 10)
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").withColumn("row", F.lit("x")).withColumn("rank", F.lit(2)).withColumn("part", F.lit(3)).repartition(5)
    aim = spark.createDataFrame([(t,) for t in AIM], "text string")
    got = resample.resample(docs, aim, share, least, 500, longest, 9)
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in got.collect()), key=str) == plain(DOCS, AIM, share, least, 500, longest, 9)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resample.resample(none, none).count() == 0
    docs = spark.createDataFrame(DOCS[:30], "doc_id long, text string")
    got = resample.resample(docs, none.select("text"), least_words=1).collect()
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in got), key=str) == plain(DOCS[:30], [], 10, 1, 10_000, 1, 2024)


def test_brackets_are_widened_until_counts_agree(spark, monkeypatch):
    monkeypatch.setattr(resample, "WIDTH", 1e-9)
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") * 7919 % 5000 * 3).alias("score"), F.lit(0).cast("long").alias("n_features"), F.col("id").alias("row"))
    for wanted in (1, 2, 777, 4999, 5000):
        low, high, above = resample.bracket(rows, wanted, 5000)
        assert above < wanted <= rows.where(F.col("score") >= low).count() and above == rows.where(F.col("score") > high).count()
        assert resample.cutoff(rows, wanted, 5000)["score"] == 3 * (5000 - wanted)
    same = rows.withColumn("score", F.lit(4).cast("long"))
    assert resample.cutoff(same, 1234, 5000)["doc_id"] == 1233


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '/root/testdata/sf0.1/{t}.parquet'")
    want = con.execute(resample.ORACLE).fetchall()
    got = queries.op13_bracketed_resampling(spark, "/root/testdata/sf0.1")
    assert {t for _, t in got.dtypes} == {"bigint"}
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
