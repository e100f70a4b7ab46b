import random

import pytest
from pyspark.sql import functions as F

from skein.llm import jaccard
from skein.llm.components import components
from tests.llm import brute
from tests.llm.cases import documents


def run(spark, docs):
    out = jaccard.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))
    return {r.doc_id: (r.n_shingles, r.component_id) for r in out.collect()}


def edited(rnd, words, n):
    w = list(words)
    for _ in range(n):
        k = rnd.randrange(len(w))
        w[k] = f"e{rnd.randrange(10 ** 6)}"
    return w


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_brute_force(spark, seed):
    rnd = random.Random(seed)
    docs, d = [], 0
    passage = [f"p{i}" for i in range(40)]
    for _ in range(30):
        base = [f"w{rnd.randrange(3000)}" for _ in range(rnd.choice([2, 3, 5, 7, 9, 15, 30, 60, 200]))]
        if rnd.random() < 0.4:
            base += passage
        for _ in range(rnd.randint(1, 12)):
            docs.append((d * 7 % 1009, " ".join(edited(rnd, base, rnd.randint(0, 1 + len(base) // 20)))))
            d += 1
    big = [f"b{i}" for i in range(150)]
    docs += [(2000 + i, " ".join(edited(rnd, big, rnd.randint(0, 8)))) for i in range(120)]
    docs += [(3000, None), (3001, ""), (3002, " \n"), (3003, "A b C"), (3004, "a B\tc"), (3005, "a b")]
    assert run(spark, docs) == brute.near_components(docs)


def test_stored_documents(spark):
    docs = documents("sf0.01")
    assert run(spark, docs) == brute.near_components(docs)


def test_odd_tables(spark):
    rows = [(None, "a b c d e f g"), (9, "a b c d e f g"), (9, "a b c d e f g"), (10, "a b c d e f g"), (11, None), (11, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("rid", "n", "v", "root")})
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 3, 9), (9, 3, 9), (9, 3, 9), (10, 3, 9), (11, 0, 11), (11, 0, 11)], key=str)
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [9, 11, 11]
    assert jaccard.near_duplicates(df.limit(0)).count() == 0


def test_components_of_chains(spark):
    n = 200
    df = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (1001, 1000), (7, 7)], "a long, b long").repartition(4)
    got = {r.v: r.root for r in components(df).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 1000: 1000, 1001: 1000}


def test_boundary_follows_cost():
    assert jaccard.choose_boundary({5: 100, 40: 100}, 0.0) < 40
    assert jaccard.choose_boundary({5: 100, 10: 100, 500: 10}, 2.0) >= 10
