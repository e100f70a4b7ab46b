"""Rebuilt FROM clauses and foreign-key classes on hand cases."""

import pytest
from pyspark.sql import functions as F

from skein.operators import rebuild, score
from skein.sources.catalog import star_catalog
from tests.conftest import SF_SMALL

CASES = [
    ("select count ( customer.* )", "select count ( * ) from customer"),
    ("select customer.c_mktsegment where nation.n_name = value", "select T1.c_mktsegment from customer as T1 join nation as T2 on T1.c_nationkey = T2.n_nationkey where T2.n_name = 1"),
    ("select region.r_name , count ( region.* ) where lineitem.l_quantity > value order by count ( region.* ) desc limit limit_value",
     "select T1.r_name , count ( * ) from region as T1 join nation as T2 on T1.r_regionkey = T2.n_regionkey join supplier as T3 on T2.n_nationkey = T3.s_nationkey "
     "join lineitem as T4 on T3.s_suppkey = T4.l_suppkey where T4.l_quantity > 1 order by count ( * ) desc limit 1"),
    # aliases run on over a nested block and a set operand; blocks of one table have none
    ("select customer.c_name where customer.c_custkey not in ( select orders.o_custkey where part.p_name = value ) union select supplier.s_name where nation.n_name = value",
     "select c_name from customer where c_custkey not in ( select T1.o_custkey from orders as T1 join lineitem as T2 on T1.o_orderkey = T2.l_orderkey join part as T3 "
     "on T2.l_partkey = T3.p_partkey where T3.p_name = 1 ) union select T4.s_name from supplier as T4 join nation as T5 on T4.s_nationkey = T5.n_nationkey where T5.n_name = 1"),
    ("select count ( * ) ( select nation.n_name where region.r_name = value )",
     "select count ( * ) from ( select T1.n_name from nation as T1 join region as T2 on T1.n_regionkey = T2.r_regionkey where T2.r_name = 1 )"),
    ("select events.user_id , part.p_name", "select T1.user_id , T2.p_name from events as T1 join part as T2"),  # no path
    ("select 1", "select 1"), (None, None),
]


def test_from_clauses(spark):
    rows = [(i, "star", t) for i, (t, _) in enumerate(CASES)] + [(99, "unknown", CASES[0][0])]
    paths = rebuild.fk_paths(star_catalog(spark, SF_SMALL))
    got = dict(rebuild.rebuild_from(spark.createDataFrame(rows, "k long, db_id string, t string"), "k", "t", paths).collect())
    assert got == {**{i: want for i, (_, want) in enumerate(CASES)}, 99: CASES[0][0]}


@pytest.mark.parametrize("gold,pred,with_classes,without", [
    ("select T1.c_custkey from customer as T1 join orders as T2 on T1.c_custkey = T2.o_custkey", "select T2.o_custkey from customer as T1 join orders as T2 on T1.c_custkey = T2.o_custkey", 1, 0),
    ("select c_custkey from customer", "select o_custkey from orders", 0, 0),  # the tables differ
    ("select c_name from customer where c_custkey in ( select o_custkey from orders )", "select c_name from customer where c_custkey in ( select c_custkey from customer )", 0, 0),  # nested columns stay
    ("select c_name from customer where c_acctbal > 5", "select c_name from customer where c_acctbal > 77", 1, 1),
])
def test_foreign_key_twins(spark, gold, pred, with_classes, without):
    cat = star_catalog(spark, SF_SMALL)
    qs = spark.createDataFrame([(1, gold, pred)], "query_id long, gold string, pred string")
    for fks, want in ((score.fk_map(cat), with_classes), (None, without)):
        per, _ = score.score_pairs(qs, "query_id", cat.columns, fks)
        assert [r.exact for r in per.collect()] == [want]


def test_partial_metric_skips_padding(spark):
    cat = star_catalog(spark, SF_SMALL)
    rows = [(1, "select c_name from customer", "select c_name from customer", 0), (2, "select c_name from customer", "select c_acctbal from customer", 1), (3, "select c_name from customer", "nothing", -1)]
    qs = spark.createDataFrame(rows, "query_id long, gold string, pred string, turn_idx int")
    got = {r.category: r for r in score.partial_metric(qs, cat.columns).collect()}
    assert got["exact"].n == 2 and got["exact"].acc == 0.5 and got["select"].acc == 0.5 and got["where"].f1 == 1.0
