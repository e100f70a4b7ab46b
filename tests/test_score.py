"""Metamorphic checks of the component scores."""

from skein.operators import score as sc
from skein.sources.catalog import star_catalog
from tests.conftest import SF_SMALL

GOLD = [
    "select count(*) from customer",
    "select c_mktsegment , count(*) from customer group by c_mktsegment having count(*) > 3 order by count(*) desc limit 2",
    "select T1.c_mktsegment from customer as T1 join nation as T2 on T1.c_nationkey = T2.n_nationkey where T2.n_name = 'x'",
    "select n_name from nation where n_nationkey > 3 intersect select n_name from nation where n_nationkey < 9",
    "select c_name from customer where c_acctbal > ( select avg(c_acctbal) from customer ) and c_nationkey = 3",
]


def _exact(spark, pairs):
    cat = star_catalog(spark, SF_SMALL)
    qs = spark.createDataFrame([(i, g, p) for i, (g, p) in enumerate(pairs)], "query_id long, gold string, pred string")
    pk, pc = sc.score_pairs(qs, "query_id", cat.columns)
    return {r["query_id"]: r["exact"] for r in pk.collect()}, pc


def test_identical_prediction_scores_one(spark):
    ex, pc = _exact(spark, [(g, g) for g in GOLD])
    assert all(v == 1 for v in ex.values()) and len(ex) == len(GOLD)
    assert pc.filter("f1 <> 1").count() == 0


def test_literals_and_order_of_units_do_not_matter(spark):
    pairs = [
        (GOLD[2], GOLD[2].replace("'x'", "'y'")),
        ("select c_name , c_acctbal from customer where c_acctbal > 1 and c_nationkey = 2",
         "select c_acctbal , c_name from customer where c_nationkey = 5 and c_acctbal > 7"),
    ]
    ex, _ = _exact(spark, pairs)
    assert ex == {0: 1, 1: 1}


def test_changed_operator_or_aggregate_breaks_exact_match(spark):
    pairs = [
        (GOLD[4], GOLD[4].replace("avg(", "min(")),
        (GOLD[3], GOLD[3].replace(" > ", " < ")),
        (GOLD[1], GOLD[1].replace(" limit 2", "")),
        (GOLD[0], GOLD[0][:-1]),
    ]
    ex, _ = _exact(spark, pairs)
    assert ex == {0: 0, 1: 0, 2: 0, 3: 0}


def test_set_operation_chains_of_any_length(spark):
    parts = [f"select n_name from nation where n_nationkey > {i}" for i in range(6)]
    chain = " intersect ".join(parts)
    other = " intersect ".join([*parts[:5], "select n_comment from nation where n_nationkey > 5"])
    ex, _ = _exact(spark, [(chain, chain), (chain, other)])
    assert ex == {0: 1, 1: 0}


def test_pairs_with_nulls_stay_apart(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, "a"), (3, "a", None)], "query_id long, gold string, pred string")
    got = {(r.gold, r.pred): (r.mult, r.query_id) for r in sc.dedup_pairs(df).collect()}
    assert got == {("a", None): (2, 1), (None, "a"): (1, 2)}


def test_scores_stream_in_one_pass(spark, monkeypatch):
    """Tokens, units and blocks are neither written nor shuffled: the query rows move once (before: four checkpoints)."""
    def written(_):
        raise AssertionError("scores wrote a table")
    monkeypatch.setattr(sc, "cut_lineage", written)
    cat = star_catalog(spark, SF_SMALL)
    qs = spark.createDataFrame([(i, g, g) for i, g in enumerate(GOLD)], "query_id long, gold string, pred string")
    for df in sc.score_pairs(qs, "query_id", cat.columns, sc.fk_map(cat)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert sum("Exchange hashpartitioning(query_id" in line for line in plan.splitlines()) == 1
        assert df.count() >= len(GOLD)


def test_repeated_keys_count_once_a_row(spark):
    qs = spark.createDataFrame([(1, GOLD[0], GOLD[0])] * 2 + [(2, GOLD[0], "select 'x")], "query_id long, gold string, pred string")
    ut, stacked = sc.analyse(qs, "query_id", star_catalog(spark, SF_SMALL).columns)
    assert {(r.query_id, r.mult) for r in ut.select("query_id", "mult").collect()} == {(1, 2), (2, 1)}
    valid = {(r.query_id, r.side): r.v for r in sc.validity(ut, stacked, "query_id").groupBy("query_id", "side").agg({"valid": "max"}).withColumnRenamed("max(valid)", "v").collect()}
    assert valid[2, "gold"] and not valid[2, "pred"]
