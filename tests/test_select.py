"""Reranking and numbering on hand cases."""

from pyspark.sql import functions as F

from skein.operators import select as se


def test_reranking(spark):
    rows = [(1, 0, ["a", "EOS", "z"], [-1.0, -1.0, 9.0], True, ["a"]), (1, 1, ["b", "EOS"], [-0.5, -0.5], True, ["a"]), (1, 2, ["c"], [0.0], False, ["a"]),
            (2, 0, ["a"], [-1.0], True, ["q"]), (2, 1, ["b"], [-1.0], True, ["q"]), (3, 0, ["a"], [0.0], False, ["a"]), (4, 0, [], [], True, ["a"])]
    b = spark.createDataFrame(rows, "k int, beam int, toks array<string>, scores array<double>, valid boolean, gold array<string>")
    assert sorted(map(tuple, se.rerank_max(b, "k").collect())) == [(1, 1, -0.5), (2, 0, -1.0)]
    assert sorted(map(tuple, se.rerank_oracle(b, "k", "gold").collect())) == [(1, 0, -1.0), (2, 0, -1.0)]


def test_numbers_run_on_over_ranges(spark):
    x = spark.range(1000).select(F.col("id").alias("i"), F.when(F.col("id") % 3 < 2, "hot").otherwise("cold").alias("db"))
    got = {r.i: r.number for r in se.number_interactions(x, "db", "i", width=64).collect()}
    for rest in ([i for i in range(1000) if i % 3 < 2], [i for i in range(1000) if i % 3 == 2]):
        assert [got[i] for i in rest] == list(range(1, len(rest) + 1))


def test_gold_order(spark):
    gold = spark.createDataFrame([("b", 0), ("a", 1), ("b", 2)], "db string, pos int")
    preds = spark.createDataFrame([("a", 2, 1), ("b", 9, 2), ("b", 9, 1), ("c", 1, 1), ("a", 1, 5)], "db string, conv long, turn int")
    out = se.order_like_gold(preds, gold, "db", "conv", "turn", "pos").orderBy("ordinal").collect()
    assert [(r.db, r.conv, r.turn) for r in out] == [("b", 9, 1), ("b", 9, 2), ("a", 1, 5), ("a", 2, 1), ("c", 1, 1)]
