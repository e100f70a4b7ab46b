"""Names in nested scopes: correlated, shadowed and derived."""

import pytest

from skein.operators import lint as ln
from skein.operators import tokens as tk
from skein.sources.catalog import star_catalog
from tests.conftest import SF_SMALL

CASES = [
    # accepted
    ("select t1.c_name from customer as t1 where exists ( select t2.o_orderkey from orders as t2 where t2.o_custkey = t1.c_custkey )", set()),
    ("select c_name from customer where c_custkey in ( select o_custkey from orders where o_totalprice > c_acctbal )", set()),
    ("select t1.n_name from ( select n_name , n_regionkey from nation ) as t1 where t1.n_regionkey = 1", set()),
    ("select t1.n_name from ( select * from nation ) as t1", set()),
    ("select t1.c_name from customer as t1 where t1.c_custkey in ( select t1.o_custkey from orders as t1 )", set()),  # the inner t1 hides the outer
    ("select n_name from ( select n_name from nation ) as t1", set()),
    ("select c_name from customer union select s_name from supplier", set()),
    ("select t1.c_name from customer as t1 union select t1.s_name from supplier as t1", set()),
    # rejected
    ("select t2.o_orderkey from customer as t1 where t1.c_custkey in ( select t2.o_custkey from orders as t2 )", {"alias_not_in_scope"}),  # t2 lives inside only
    ("select t1.n_regionkey from ( select n_name from nation ) as t1", {"derived_column_missing"}),
    ("select t2.n_name from ( select t2.n_name from nation as t2 ) as t1", {"alias_not_in_scope"}),
    ("select t1.n_name from ( select t1.n_name from nation as t2 ) as t1", {"alias_not_in_scope"}),
    ("select t1.n_name from ( select t2.n_name from nation as t2 where t1.n_name = t2.n_name ) as t1", {"alias_not_in_scope"}),  # a derived table does not see its own alias
    ("select t1.n_name from ( select t2.n_name from nation as t2 ) as t1 where t1.n_name = t2.n_name", {"alias_not_in_scope"}),
    ("select t1.c_name from customer as t1 where t1.c_custkey in ( select t1.c_custkey from orders as t1 )", {"column_not_in_alias"}),
    ("select n_regionkey from ( select n_name from nation ) as t1", {"unresolved_column"}),
    ("select n_name from nation as t1 join ( select n_name from nation ) as t2", {"ambiguous_column"}),
    ("select c_name from customer union select c_name from supplier", {"unresolved_column"}),  # an operand does not see the other's tables
    ("select customer.o_orderkey from customer", {"column_not_in_table"}),
    ("select orders.o_orderkey from customer", {"alias_not_in_scope"}),
    ("select c_name from customer where c_custkey in ( select o_custkey from orders where o_orderkey in ( select l_orderkey from lineitem where l_quantity > c_acctbal and zz > 1 ) )", {"unresolved_column"}),
]
SCOPE = {"alias_not_in_scope", "column_not_in_alias", "column_not_in_table", "derived_column_missing", "unresolved_column", "ambiguous_column"}


@pytest.fixture(scope="module")
def findings(spark):
    keys = ["qid", "side"]
    x = tk.tokenize(spark.createDataFrame([(i, "q", q) for i, (q, _) in enumerate(CASES)], "qid long, side string, sql string"), "sql")
    rt = tk.resolve(tk.token_table(x, keys), keys, star_catalog(spark, SF_SMALL).columns)
    got = {}
    for r in ln.lint(rt, keys).collect():
        got.setdefault(r["qid"], []).append(r["rule"])
    return got


@pytest.mark.parametrize("i", range(len(CASES)))
def test_scopes(findings, i):
    assert {r for r in findings.get(i, []) if r in SCOPE} == CASES[i][1], CASES[i][0]
