"""One user-level query per construct of the dialect, on the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import relational as rel
from skein.plans.registry import register
from skein.session import Tables

# ---------------------------------------------------------------- projections


@register("r01_project", "select o_orderkey, o_totalprice from orders")
def r01(spark, d):
    return Tables(spark, d).orders.select("o_orderkey", "o_totalprice")


@register("r02_select_distinct", "select distinct c_mktsegment from customer")
def r02(spark, d):
    return Tables(spark, d).customer.select("c_mktsegment").distinct()


@register("r03_arith", "select l_orderkey, l_linenumber, l_extendedprice * l_discount as v from lineitem")
def r03(spark, d):
    li = Tables(spark, d).lineitem
    return li.select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") * F.col("l_discount")).alias("v"))


# -------------------------------------------------------------------- filters


@register("r04_filter_cmp", "select o_orderkey from orders where o_totalprice >= 100000 and o_orderstatus <> 'F'")
def r04(spark, d):
    o = Tables(spark, d).orders
    return o.filter((F.col("o_totalprice") >= 100000) & (F.col("o_orderstatus") != "F")).select("o_orderkey")


@register("r05_filter_between", "select p_partkey from part where p_size between 10 and 20")
def r05(spark, d):
    return Tables(spark, d).part.filter(F.col("p_size").between(10, 20)).select("p_partkey")


@register("r06_filter_like", "select p_partkey, p_name from part where p_name ilike '%WIDGET%'")
def r06(spark, d):
    return Tables(spark, d).part.filter(rel.like("p_name", "%WIDGET%")).select("p_partkey", "p_name")


@register("r06n_filter_not_like", "select p_partkey from part where not (p_type ilike 'economy%')")
def r06n(spark, d):
    return Tables(spark, d).part.filter(rel.not_like("p_type", "economy%")).select("p_partkey")


@register("r07_filter_in", "select n_nationkey from nation where n_name in ('NATION_1','NATION_2')")
def r07(spark, d):
    return Tables(spark, d).nation.filter(F.col("n_name").isin("NATION_1", "NATION_2")).select("n_nationkey")


@register("r08_filter_not", "select n_nationkey from nation where not (n_regionkey = 1)")
def r08(spark, d):
    return Tables(spark, d).nation.filter(~(F.col("n_regionkey") == 1)).select("n_nationkey")


@register("r09_filter_and_or",
          "select o_orderkey from orders where o_orderstatus = 'F' and o_totalprice > 200000 "
          "or o_orderpriority = '3-MEDIUM'")
def r09(spark, d):
    o = Tables(spark, d).orders
    cond = ((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 200000)) | (F.col("o_orderpriority") == "3-MEDIUM")
    return o.filter(cond).select("o_orderkey")


@register("r10_is_null",
          "select c_custkey from customer left join orders on o_custkey = c_custkey and o_totalprice > 300000 "
          "where o_orderkey is null")
def r10(spark, d):
    t = Tables(spark, d)
    big = t.orders.filter(F.col("o_totalprice") > 300000).select("o_custkey", "o_orderkey")
    j = t.customer.select("c_custkey").join(big, F.col("o_custkey") == F.col("c_custkey"), "left")
    return j.filter(F.col("o_orderkey").isNull()).select("c_custkey")


@register("r11_exists",
          "select c_custkey from customer c where exists (select 1 from orders o where o.o_custkey = c.c_custkey "
          "and o.o_totalprice > 400000)")
def r11(spark, d):
    t = Tables(spark, d)
    inner = t.orders.filter(F.col("o_totalprice") > 400000).select("o_custkey")
    return rel.exists_semi(t.customer.select("c_custkey"), inner, F.col("c_custkey") == F.col("o_custkey"))


# ---------------------------------------------------------------------- joins


@register("r12_join_equi", "select o_orderkey, c_mktsegment from orders join customer on o_custkey = c_custkey")
def r12(spark, d):
    t = Tables(spark, d)
    return (t.orders.select("o_orderkey", "o_custkey")
            .join(t.customer.select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
            .select("o_orderkey", "c_mktsegment"))


@register("r13_join_multiway",
          "select l_orderkey, l_linenumber, n_name from lineitem join orders on l_orderkey = o_orderkey "
          "join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey")
def r13(spark, d):
    t = Tables(spark, d)
    # The two dimension joins (customer, nation) are far smaller than the
    # fact join; AQE turns them into broadcast joins when their runtime size
    # is under the threshold, else they stay shuffled.
    return (t.lineitem.select("l_orderkey", "l_linenumber")
            .join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
            .join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
            .join(t.nation.select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
            .select("l_orderkey", "l_linenumber", "n_name"))


@register("r14_join_cross", "select r_name, n_name from region cross join nation")
def r14(spark, d):
    t = Tables(spark, d)
    # region (5 rows) and nation (25 rows) are fixed-size dimensions at every
    # scale factor; the product is 125 rows whatever the data volume.
    return t.region.select("r_name").crossJoin(t.nation.select("n_name"))


@register("r15_join_self",
          "select a.n_name as a, b.n_name as b from nation a join nation b on a.n_regionkey = b.n_regionkey "
          "and a.n_nationkey < b.n_nationkey")
def r15(spark, d):
    n = Tables(spark, d).nation
    a, b = n.alias("a"), n.alias("b")
    return (a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey")))
            .select(F.col("a.n_name").alias("a"), F.col("b.n_name").alias("b")))


@register("r16_join_theta",
          "select s_suppkey, c_custkey from supplier join customer on s_nationkey = c_nationkey "
          "and s_acctbal < c_acctbal")
def r16(spark, d):
    t = Tables(spark, d)
    s = t.supplier.select("s_suppkey", "s_nationkey", "s_acctbal")
    c = t.customer.select("c_custkey", "c_nationkey", "c_acctbal")
    return rel.theta_join(s, c, [("s_nationkey", "c_nationkey")], F.col("s_acctbal") < F.col("c_acctbal")) \
        .select("s_suppkey", "c_custkey")


# ----------------------------------------------------------------- subqueries


@register("r17_derived_table",
          "select t.c_mktsegment, t.n from (select c_mktsegment, cast(count(*) as bigint) as n from customer "
          "group by c_mktsegment) as t where t.n > 1")
def r17(spark, d):
    inner = Tables(spark, d).customer.groupBy("c_mktsegment").agg(F.count("*").alias("n")).alias("t")
    return inner.filter(F.col("t.n") > 1).select("t.c_mktsegment", "t.n")


@register("r18_scalar_subquery",
          "select o_orderkey from orders where o_totalprice > (select avg(o_totalprice) from orders)")
def r18(spark, d):
    o = Tables(spark, d).orders
    return o.filter(F.col("o_totalprice") > rel.scalar(o.select(F.avg("o_totalprice")))).select("o_orderkey")


@register("r19_in_subquery",
          "select c_custkey from customer where c_custkey in (select o_custkey from orders where o_totalprice > 300000)")
def r19(spark, d):
    t = Tables(spark, d)
    sub = t.orders.filter(F.col("o_totalprice") > 300000).select("o_custkey")
    return t.customer.filter(rel.in_subquery("c_custkey", sub)).select("c_custkey")


@register("r20_not_in_subquery",
          "select c_custkey from customer where c_custkey not in "
          "(select o_custkey from orders where o_totalprice > 300000)")
def r20(spark, d):
    t = Tables(spark, d)
    sub = t.orders.filter(F.col("o_totalprice") > 300000).select("o_custkey")
    return t.customer.filter(rel.not_in("c_custkey", sub)).select("c_custkey")


@register("r21_nested_in_deep",
          "select r_name from region where r_regionkey in (select n_regionkey from nation where n_nationkey in "
          "(select c_nationkey from customer where c_custkey in "
          "(select o_custkey from orders where o_totalprice > 300000)))")
def r21(spark, d):
    t = Tables(spark, d)
    s3 = t.orders.filter(F.col("o_totalprice") > 300000).select("o_custkey")
    s2 = t.customer.filter(rel.in_subquery("c_custkey", s3)).select("c_nationkey")
    s1 = t.nation.filter(rel.in_subquery("n_nationkey", s2)).select("n_regionkey")
    return t.region.filter(rel.in_subquery("r_regionkey", s1)).select("r_name")


# --------------------------------------------------------------- aggregation


@register("r22_agg_global",
          "select count(*) as n, min(o_totalprice) as mn, max(o_totalprice) as mx, "
          "round(sum(o_totalprice),2) as s, round(avg(o_totalprice),4) as a from orders")
def r22(spark, d):
    o = Tables(spark, d).orders
    return o.agg(F.count("*").alias("n"), F.min("o_totalprice").alias("mn"), F.max("o_totalprice").alias("mx"),
                 F.round(F.sum("o_totalprice"), 2).alias("s"), F.round(F.avg("o_totalprice"), 4).alias("a"))


@register("r23_agg_distinct", "select count(distinct o_custkey) as n from orders")
def r23(spark, d):
    return Tables(spark, d).orders.agg(F.count_distinct("o_custkey").alias("n"))


@register("r24_agg_expr", "select round(sum(l_extendedprice * l_discount),2) as s from lineitem")
def r24(spark, d):
    li = Tables(spark, d).lineitem
    return li.agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 2).alias("s"))


@register("r25_group_by",
          "select l_returnflag, l_linestatus, count(*) as n, round(avg(l_quantity),4) as a from lineitem "
          "group by l_returnflag, l_linestatus")
def r25(spark, d):
    li = Tables(spark, d).lineitem
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"),
                                                          F.round(F.avg("l_quantity"), 4).alias("a"))


@register("r26_group_bare_column",
          "select c_nationkey, min(c_name) as any_name, count(*) as n from customer group by c_nationkey")
def r26(spark, d):
    c = Tables(spark, d).customer
    return c.groupBy("c_nationkey").agg(rel.any_value_min("c_name").alias("any_name"), F.count("*").alias("n"))


@register("r27_having", "select o_custkey, count(*) as n from orders group by o_custkey having count(*) > 12")
def r27(spark, d):
    o = Tables(spark, d).orders
    return o.groupBy("o_custkey").agg(F.count("*").alias("n")).filter(F.col("n") > 12)


# -------------------------------------------------------------- sort / limit


@register("r28_order_by",
          "select p_partkey from part order by p_retailprice - p_size desc nulls last, p_partkey asc nulls last")
def r28(spark, d):
    p = Tables(spark, d).part
    return p.orderBy((F.col("p_retailprice") - F.col("p_size")).desc_nulls_last(),
                     F.col("p_partkey").asc_nulls_last()).select("p_partkey")


@register("r29_limit_top_k",
          "select o_orderkey, o_totalprice from orders order by o_totalprice desc nulls last, o_orderkey limit 10")
def r29(spark, d):
    o = Tables(spark, d).orders.select("o_orderkey", "o_totalprice")
    return rel.top_k(o, 10, [F.col("o_totalprice").desc_nulls_last(), F.col("o_orderkey").asc_nulls_first()])


@register("r30_top_group",
          "select o_custkey, count(*) as n from orders group by o_custkey order by count(*) desc, o_custkey limit 1")
def r30(spark, d):
    g = Tables(spark, d).orders.groupBy("o_custkey").agg(F.count("*").alias("n"))
    return rel.top_k(g, 1, [F.col("n").desc(), F.col("o_custkey").asc_nulls_first()])


# ------------------------------------------------------------ set operations


@register("r31_union", "select c_nationkey as k from customer union select s_nationkey from supplier")
def r31(spark, d):
    t = Tables(spark, d)
    return rel.set_union(t.customer.select(F.col("c_nationkey").alias("k")), t.supplier.select("s_nationkey"))


@register("r32_intersect",
          "select c_nationkey as k from customer where c_acctbal > 9500 intersect "
          "select s_nationkey from supplier where s_acctbal > 6000")
def r32(spark, d):
    t = Tables(spark, d)
    a = t.customer.filter(F.col("c_acctbal") > 9500).select(F.col("c_nationkey").alias("k"))
    b = t.supplier.filter(F.col("s_acctbal") > 6000).select("s_nationkey")
    return rel.set_intersect(a, b)


@register("r33_except",
          "select n_nationkey as k from nation except select s_nationkey from supplier where s_acctbal > 6000")
def r33(spark, d):
    t = Tables(spark, d)
    b = t.supplier.filter(F.col("s_acctbal") > 6000).select("s_nationkey")
    return rel.set_except(t.nation.select(F.col("n_nationkey").alias("k")), b)
