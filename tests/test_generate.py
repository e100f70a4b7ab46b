"""Content draws, filled templates, choices by type and topped-up goals."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from skein.operators import content as ct
from skein.operators import generate as gen
from skein.operators import lint as ln
from skein.operators import tokens as tk
from skein.plans import generate_queries as gq
from skein.sources.catalog import star_catalog
from tests.conftest import SF_SMALL

TYPED = [("d", "t", "name", "text", None), ("d", "t", "size", "number", None), ("d", "t", "id", "key", None), ("d", "t", "*", "*", "name"), ("d", "e", "none", "text", None),
         ("d", "t", "phone_no", "number", None), ("d", "t", "ok", "boolean", None), ("d", "t", "day", "time", None)]


@pytest.fixture(scope="module")
def typed(spark):
    return spark.createDataFrame(TYPED, "db_id string, table_name string, column_name string, slot_type string, first_column string")


@pytest.fixture(scope="module")
def store(spark):
    rows = [("hot", 2.5, i) for i in range(600)] + [(f"n{i % 50}.x", float(i), i) for i in range(300)] + [("", -0.25, 0), (None, None, None)]
    t = spark.createDataFrame(rows, "name string, size double, id int")
    lits = ct.literals({"t": t, "e": spark.createDataFrame([(None,), ("",), (".x",)], "none string")})
    return lits, *ct.content_index(lits)


def test_intervals_partition_each_column(store):
    lits, index, sizes = store
    assert {(r.col, r.literal): r.n for r in lits.collect()}["t.name", "hot"] == 600
    total = {r.col: r.total for r in sizes.collect()}
    assert total == {"t.name": 900, "t.size": 901, "t.id": 901} and lits.where("literal = '-0'").count() == 1
    spans = {}
    for r in index.collect():
        spans.setdefault(r.col, set()).add((r.lo, r.hi))
    for col, found in spans.items():
        ends = sorted(found)
        assert ends[0][0] == 0 and ends[-1][1] == total[col] and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))
    assert index.groupBy("col", "cell").count().agg(F.max("count")).first()[0] <= 40  # no cell gathers a column


def test_literals_are_counted_without_their_text(spark):
    odd = [0.9999994, 0.9999996, 0.99999951, 1.0, 4.9999999, -0.0, -0.0000004, -0.0000006, -0.25, -0.9999999, -1.0, -1.9999999, 2.5, 2.999999, 99999999.5, 1e8, 123456789.25, 5e17, -5e17, 2.0 ** 53, 1e20, None]
    rows = [(x, None if x is None else x / 3, i - 3, f"{i}.{i}" if i % 2 else "", i % 3 == 0) for i, x in enumerate(odd * 2)]
    t = spark.createDataFrame(rows, "a double, b float, c int, d string, e boolean").withColumn("f", F.expr("timestamp_micros(c * 500000L)")).withColumn("g", F.expr("cast(c / 8 as decimal(9,3))"))
    want = Counter()
    for f in t.schema.fields:
        for x in t.select(ct.literal_text(F.col(f.name), f.dataType).alias("x")).where("x <> ''").collect():
            want["t." + f.name, x.x] += 1
    lits = ct.literals({"t": t})
    got = lits.collect()
    assert {(r.col, r.literal): r.n for r in got} == want and len(got) == len(want)
    plan = lits._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "whole#" in plan  # before: each cell of a row was exploded as text


def test_draws_follow_frequencies(spark, store):
    _, index, sizes = store
    draws = spark.range(4000).select(F.col("id").alias("seed"), F.lit("t.name").alias("col"))
    got = Counter(r.literal for r in ct.sample_values(draws, index, sizes, "seed").collect())
    assert sum(got.values()) == 4000 and abs(got["hot"] / 4000 - 2 / 3) < 0.03 and len(got) == 51
    assert ct.sample_values(draws.withColumn("col", F.lit("e.none")), index, sizes, "seed").count() == 0


def test_the_last_column_governs_a_literal(spark, typed, store):
    rows = [(1, "select t.name where t.size > value and t.name = value"), (2, "select t.name group by t.name having count ( t.* ) > value"),
            (3, "select t.name having sum ( t.size ) > value limit limit_value"), (4, "select t.name where t.id = value"), (5, "select value"), (6, "select e.none where e.none = value"), (7, "select t.name")]
    mapped = spark.createDataFrame([(i, "d", t) for i, t in rows], "seed long, db_id string, mapped string")
    got = {r.seed: (r.filled, r.literals) for r in ct.fill_template(mapped, typed, *store[1:]).collect()}
    assert set(got) == {1, 2, 3, 4, 7} and got[7] == ("select t.name", [])
    a, b = got[1][1]
    assert a.lstrip("-").isdigit() and b.startswith("'") and got[1][0] == f"select t.name where t.size > {a} and t.name = {b}"
    assert got[2][1][0] in list("123456789") and got[3][1][0].lstrip("-").isdigit() and got[3][0].endswith("limit 1")
    assert got[4][1][0].startswith("'")


def test_choices_follow_their_tables(spark, typed):
    text = "select agg ( t.size ) , agg ( t.name ) where t.size op value and t.name op value and t.phone_no op value and t.ok op value and t.id op value order by t.day order"
    out = ct.detemplatize(spark.range(20000).select(F.col("id").alias("seed"), F.lit("d").alias("db_id"), F.lit(text).alias("mapped")), typed)
    rows = [r.mapped.replace("< >", "<>").replace("> =", ">=").replace("< =", "<=").split() for r in out.collect()]
    assert len(rows) == 20000 and all(len(r) == len(text.split()) for r in rows)
    at = {i: Counter(r[i] for r in rows) for i in range(len(rows[0]))}
    place = {w: [i for i, x in enumerate(text.split()) if x == w] for w in ("agg", "op", "order")}
    share = lambda table: {k.replace(" ", ""): v / 1000 for k, v in table}
    want = [(place["agg"][0], ct.AGG_CHOICES["number"]), (place["agg"][1], ct.AGG_CHOICES["text"]), *zip(place["op"], (ct.OP_CHOICES[t] for t in ("number", "text", "phone", "boolean", "key"))), (place["order"][1], ct.ORDER_CHOICES)]
    for i, table in want:
        assert set(at[i]) == set(share(table)) and all(abs(at[i][k] / 20000 - v) < 0.01 for k, v in share(table).items())
    assert at[place["order"][0]] == {"order": 20000}
    assert ct.detemplatize(spark.createDataFrame([(1, "d", "select op value"), (2, "d", "select agg ( x )")], "seed long, db_id string, mapped string"), typed).count() == 0


def test_top_up_returns_exactly_n_or_raises(spark):
    asked = []

    def make(lo, hi):
        asked.append((lo, hi))
        return spark.range(lo, hi).select(F.col("id").alias("seed")).where("seed % 7 = 3")

    got = [r.seed for r in gen.top_up(make, 50, first=100).collect()]
    assert got == [7 * i + 3 for i in range(50)] and len(asked) == 2 and asked[1][0] == asked[0][1]
    with pytest.raises(ValueError):
        gen.top_up(lambda lo, hi: spark.range(lo, hi).select(F.col("id").alias("seed")).where("seed < 5"), 6)


def test_goals_name_their_tables(spark):
    rows = gq.g16(spark, SF_SMALL)
    assert rows.count() == 100 and rows.select("goal_id").distinct().count() == 100
    x = tk.tokenize(rows.where("db_id = 'star'").select("goal_id", F.lit("q").alias("side"), "sql"), "sql").where("toks is not null")
    keys = ["goal_id", "side"]
    found = ln.lint(tk.resolve(tk.token_table(x, keys), keys, star_catalog(spark, SF_SMALL).columns), keys)
    scope = ["unknown_table", "column_not_in_table", "alias_not_in_scope", "column_not_in_alias", "unresolved_column", "ambiguous_column"]
    assert x.count() > 0 and [r for r in found.where(F.col("rule").isin(scope)).collect()] == []
