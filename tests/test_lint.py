"""Scope and type rules on the concert/singer schema used by the grammar checker's tests."""

import pytest
from pyspark.sql import functions as F

from skein.operators import lint as ln
from skein.operators import tokens as tk
from skein.sources.catalog import catalog_from_tables

# fixed test schema (n number, t text, o others)
SCHEMA = {
    "stadium": [("Stadium_ID", "bigint"), ("Location", "string"), ("Name", "string"), ("Capacity", "bigint"),
                ("Highest", "bigint"), ("Lowest", "bigint"), ("Average", "bigint")],
    "singer": [("Singer_ID", "bigint"), ("Name", "string"), ("Country", "string"), ("Song_Name", "string"),
               ("Song_release_year", "string"), ("Age", "bigint"), ("Is_male", "binary")],
    "concert": [("concert_ID", "bigint"), ("concert_Name", "string"), ("Theme", "string"), ("Stadium_ID", "bigint"),
                ("Year", "bigint")],
    "singer_in_concert": [("concert_ID", "bigint"), ("Singer_ID", "bigint")],
}

ACCEPTED = [
    "SELECT * FROM singer",
    "SELECT count(*) FROM singer",
    "SELECT T1.name FROM singer as T1",
    "SELECT T1.name, T1.country, T1.age FROM singer AS T1 ORDER BY T1.age DESC",
    "SELECT avg(age) ,  min(age) ,  max(age) FROM singer WHERE country  =  'France'",
    "SELECT song_name ,  song_release_year FROM singer ORDER BY age LIMIT 1",
    "SELECT DISTINCT country FROM singer WHERE age  >  20",
    "SELECT song_name FROM singer WHERE age  >  (SELECT avg(age) FROM singer)",
    "SELECT LOCATION ,  name FROM stadium WHERE capacity BETWEEN 5000 AND 10000",
    "SELECT count(*) FROM concert WHERE YEAR  =  2014 OR YEAR  =  2015",
    "SELECT T2.name ,  count(*) FROM concert AS T1 JOIN stadium AS T2 ON T1.stadium_id  =  T2.stadium_id GROUP BY T1.stadium_id",
    "SELECT name FROM stadium WHERE stadium_id NOT IN (SELECT stadium_id FROM concert)",
    "SELECT country FROM singer WHERE age  >  40 INTERSECT SELECT country FROM singer WHERE age  <  30",
    "SELECT name FROM stadium EXCEPT SELECT T2.name FROM concert AS T1 JOIN stadium AS T2 ON T1.stadium_id  =  T2.stadium_id WHERE T1.year  =  2014",
    "SELECT name ,  country FROM singer WHERE song_name LIKE '%Hey%'",
    "select count(*) from concert where stadium_id = (select stadium_id from stadium order by capacity desc limit 1)",
    "SELECT T2.name FROM singer AS T1 JOIN singer as T2",
]

REJECTED = [
    ("SELECT name", "unresolved_column"),
    ("SELECT name FROM concert", "unresolved_column"),
    ("SELECT name FROM invalid", "unknown_table"),
    ("SELECT * FROM concert JOIN concert", "duplicate_table"),
    ("SELECT * FROM concert as T1 JOIN concert as T1", "duplicate_alias"),
    ("SELECT name FROM singer AS T1 JOIN singer as T2", "ambiguous_column"),
    ("SELECT name FROM singer JOIN stadium", "ambiguous_column"),
    ("select _1.* from concert as _1", "bad_alias_name"),
    ("select t1.countryid from singer as t1", "column_not_in_alias"),
    ("SELECT homepage FROM singer WHERE name = 0", "unresolved_column"),
    ("SELECT name FROM singer WHERE name = 0", "bad_comparison_type"),
    ("SELECT sum(name) FROM singer", "bad_aggregate_type"),
    ("SELECT name FROM singer WHERE age LIKE '%1%'", "bad_like_type"),
    ("SELECT name, age FROM singer UNION SELECT age, name FROM singer", "setop_type_mismatch"),
]


@pytest.fixture(scope="module")
def findings(spark):
    dfs = {t: spark.createDataFrame([], ", ".join(f"{c} {ty}" for c, ty in cols)) for t, cols in SCHEMA.items()}
    cat = catalog_from_tables(spark, dfs, "concert_singer", ["Stadium_ID", "Singer_ID", "concert_ID"])
    rows = [(i, q) for i, q in enumerate(ACCEPTED + [q for q, _ in REJECTED])]
    qs = spark.createDataFrame(rows, "qid long, sql string").withColumn("side", F.lit("q"))
    x = tk.tokenize(qs, "sql")
    rt = tk.resolve(tk.token_table(x, ["qid", "side"]), ["qid", "side"], cat.columns)
    got = {}
    for r in ln.lint(rt, ["qid", "side"]).collect():
        got.setdefault(r["qid"], set()).add(r["rule"])
    return got


@pytest.mark.parametrize("i", range(len(ACCEPTED)))
def test_accepted_queries_are_clean(findings, i):
    assert findings.get(i, set()) == set(), ACCEPTED[i]


@pytest.mark.parametrize("j", range(len(REJECTED)))
def test_rejected_queries_are_flagged(findings, j):
    q, rule = REJECTED[j]
    assert rule in findings.get(len(ACCEPTED) + j, set()), (q, findings.get(len(ACCEPTED) + j))
