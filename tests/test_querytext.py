"""Query-text rewrites on hand-written cases (expected values worked out by hand)."""

from pyspark.sql import functions as F

from skein.operators import querytext as qt


def _one(spark, col, value, typ="string"):
    return spark.createDataFrame([(value,)], f"x {typ}").select(col.alias("y")).first()["y"]


def test_mask_sparc_string_and_number(spark):
    df = spark.createDataFrame([("SELECT name FROM t WHERE a = 'new york' AND T1.b > 3.5;",)], "sql string")
    r = qt.mask_tokens(df, "sql", "sparc").first()
    assert r["toks"] == ["SELECT", "name", "FROM", "t", "WHERE", "a", "=", "'new", "york", "'", "AND",
                         "T1", ".", "b", ">", "3.5"]
    assert r["masked"] == ["select", "name", "from", "t", "where", "a", "=", "value", "and", "t1", ".", "b", ">",
                           "value"]


def test_mask_cosql_quote_toggles(spark):
    # a bare quote opens a string in the conversation dialect, but is kept as a token in the other
    df = spark.createDataFrame([("select a from b where c = ' x ' and d = 1",)], "sql string")
    sp = qt.mask_tokens(df, "sql", "sparc").first()["masked"]
    co = qt.mask_tokens(df, "sql", "cosql").first()["masked"]
    assert sp == ["select", "a", "from", "b", "where", "c", "=", "", "'", "x", "", "'", "and", "d", "=", "value"]
    assert co == ["select", "a", "from", "b", "where", "c", "=", "", "value", "and", "d", "=", "value"]


def test_strip_values(spark):
    out = _one(spark, qt.strip_values(F.col("x")), ["SELECT", '"Ann"', "1e3", "inf", "x1"], "array<string>")
    assert out == ["select", "value", "value", "value", "x1"]


def test_resolve_aliases_token_exact(spark):
    toks = "select t1.name from singer as t1 join at1 as t2 on t1.id = t2.id".split()
    out = _one(spark, qt.resolve_aliases(F.col("x")), toks, "array<string>")
    assert out == "select singer.name from singer join at1 on singer.id = at1.id"


def test_split_dotted_attaches_star_to_least_used_alias(spark):
    toks = "select * from a as t1 join b as t2 on t1.x = t2.y where t1.z = 1".split()
    r = _one(spark, qt.split_dotted(F.col("x")), toks, "array<string>")
    assert r["invalid"] is True
    assert r["toks"][1] == "t2.*"


def test_fill_values_left_to_right(spark):
    df = spark.createDataFrame([("select a from t where b = 1 and c = 1 limit 1", ["' x '", "7"])],
                               "post string, vals array<string>")
    out = df.select(qt.fill_values("post", "vals").alias("y")).first()["y"]
    assert out == "select a from t where b = 'x' and c = 7 limit 1"


def test_drop_table_star_and_candidates(spark):
    assert _one(spark, qt.drop_table_star(F.col("x")), "select a , t1.* from b") == "select a ,from b"
    assert _one(spark, qt.candidate_tables(F.col("x")), "select b.x , a.y from a join b") == ["a", "b"]
