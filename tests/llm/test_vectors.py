"""Nearest neighbours and whitening against plain versions on small tables."""

from fractions import Fraction

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from skein.llm import queries, vptree, whitening

SCHEMA = "vec_id long, embedding array<double>"


def cosine_lists(rows, k=5):
    """Sorted (query_id, rank, vec_id, score) of rows [(vec_id, vector)] that take part."""
    own = sorted({(i, tuple(v)) for i, v in rows})
    m = np.array([v for _, v in own])
    m = m / np.abs(m).max(axis=1, keepdims=True)
    norms = np.sqrt((m * m).sum(axis=1))
    out = []
    for (i, _), x, n in zip(own, m, norms):
        if i % 50 == 0:
            s = (m * x).sum(axis=1) / (norms * n)
            best = sorted((-round(float(v), 12), j) for v, (j, _) in zip(s, own) if j != i)[:k]
            out += [(i, r + 1, j, -v) for r, (v, j) in enumerate(best)]
    return sorted(out)


def found(df):
    return sorted((r.query_id, r.rank, r.vec_id, round(r.score, 12)) for r in df.collect())


@pytest.mark.parametrize("rows", [8192, 60])
def test_exact_search_equals_all_pairs(spark, rows, monkeypatch):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 12))
    data = [(i, (centres[i % 6] + rng.normal(size=12) * (0.05 + 0.5 * (i % 2))).tolist()) for i in range(700)]
    data += [(1000 + i, data[50][1]) for i in range(300)]  # one vector for a third of all rows
    data += [data[100]] * 40 + [(100, data[7][1]), (-50, [-x for x in data[3][1]]), (2000, [x * 2.0 ** 600 for x in data[9][1]]), (2050, [x * 2.0 ** -600 for x in data[9][1]])]
    odd = [(50, None), (3000, [0.0] * 12), (3050, [float("nan")] * 12), (3100, [float("inf")] + [1.0] * 11), (3150, [None] + [1.0] * 11), (3200, [1.0] * 5), (3250, []), (None, data[0][1])]
    df = spark.createDataFrame(data + odd, SCHEMA).withColumn("cell", F.lit("x")).withColumn("rank", F.lit(1)).repartition(5)
    monkeypatch.setattr(vptree, "QUERIES", 4)
    assert found(vptree.nearest(df, F.col("vec_id") % 50 == 0, rows=rows)) == cosine_lists(data)


def test_few_or_no_candidates(spark):
    three = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [2.0, 2.0])]
    assert [x[:3] for x in found(vptree.nearest(spark.createDataFrame(three, SCHEMA), F.col("vec_id") % 50 == 0))] == [(0, 1, 1), (0, 2, 2)]
    for rows in ([], [(0, [1.0])], [(0, None)], [(0, [])]):
        assert vptree.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0).collect() == []


def test_relaxed_pruning_scans_less_and_finds_most():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16))
    points = np.concatenate([c + 0.25 * rng.normal(size=(200, 16)) for c in centres])
    tree = vptree.Tree(points, [[i] for i in range(len(points))])
    asked = list(range(0, len(points), 40))
    none = np.full(len(asked), -np.inf)
    scanned, share = [], []
    for factor in (0.0, 1.0, 1.5, 3.0):
        out = tree.search(points[asked], asked, 5, none, factor)
        scanned.append(tree.scanned)
        if not factor:
            want = out
        share.append(np.mean([len({v for _, v in a} & {v for _, v in b}) / 5 for a, b in zip(out, want)]))
    assert share[1] == 1 and scanned[0] == len(points) * len(asked)
    assert scanned[0] > scanned[1] > scanned[2] > scanned[3] and share[2] >= 0.9


def test_query_finds_all_neighbours(spark):
    got = queries.op11_vantage_point_trees(spark, "/root/testdata/sf0.1")
    con = duckdb.connect()
    con.execute("create view embeddings as select * from '/root/testdata/sf0.1/embeddings.parquet'")
    want = con.execute(vptree.ORACLE).fetchall()
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint", "int", "bigint", "double"]
    assert found(got) == sorted((q, r, v, round(s, 12)) for q, r, v, s in want)


# ------------------------------------------------------------------ whitening

def _scatter(x):
    n = len(x)
    x = x.astype(object)
    total = x.sum(axis=0)
    return [list(row) for row in n * (x.T @ x) - np.outer(total, total)]


def test_characteristic_polynomial_is_exact(spark):
    rng = np.random.default_rng(1)
    for d, rows in ((1, 3), (2, 5), (7, 30), (7, 4)):
        m = _scatter(rng.integers(-10 ** 6, 10 ** 6, (rows, d)))
        poly = whitening.characteristic_polynomial(spark, m)
        assert poly[-1] == 1 and len(poly) == d + 1

        def minor(a):  # determinant by fractions
            a, out = [[Fraction(v) for v in row] for row in a], Fraction(1)
            for k in range(len(a)):
                p = next((i for i in range(k, len(a)) if a[i][k]), None)
                if p is None:
                    return Fraction(0)
                if p != k:
                    a[k], a[p], out = a[p], a[k], -out
                out *= a[k][k]
                for i in range(k + 1, len(a)):
                    f = a[i][k] / a[k][k]
                    a[i] = [x - f * y for x, y in zip(a[i], a[k])]
            return out

        for t in (0, 1, -3, 10 ** 9):
            assert minor([[t * (i == j) - m[i][j] for j in range(d)] for i in range(d)]) == sum(c * t ** j for j, c in enumerate(poly))


def test_roots_with_multiplicity():
    roots = [9, 9, 9, 4, 4, 1, 0, 0]
    poly = [1]
    for r in roots:
        poly = [a - r * b for a, b in zip([0] + poly, poly + [0])]
    got = whitening.largest_roots(poly, sum(roots), 4)
    assert [m for _, m in got] == [3, 2] and all(abs(r - w) < Fraction(w, 1 << 199) for (r, _), w in zip(got, (9, 4)))
    assert [m for _, m in whitening.largest_roots(poly, sum(roots), 99)] == [3, 2, 1]
    near = [1]  # two roots that doubles cannot tell apart
    for r in (10 ** 30, 10 ** 30 + 1, 5):
        near = [a - r * b for a, b in zip([0] + near, near + [0])]
    assert [(round(r), m) for r, m in whitening.largest_roots(near, 3 * 10 ** 30, 3)] == [(10 ** 30 + 1, 1), (10 ** 30, 1), (5, 1)]


def check_rows(got, vectors):
    """got against numpy for vectors {vec_id: vector}, all distinct eigenvalues."""
    x = np.array([[int(np.floor(256 * c)) for c in v] for v in vectors.values()])
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(axis=0)
    cov = np.cov(fit.T, bias=True).reshape(x.shape[1], -1)
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1][:4], v[:, ::-1][:, :4]
    want = (x - total / n) @ v / np.sqrt(e)
    by = {(r.vec_id, r.component): r for r in got}
    assert len(got) == len(by) == len(vectors) * len(e)
    mine = np.array([[by[i, c + 1].whitened for c in range(len(e))] for i in vectors])
    assert np.abs(mine - want * np.sign((mine * want).sum(axis=0))).max() < 1e-9
    for i, row in zip(vectors, x):
        r = by[i, 1]
        assert r.n == n and int(r.deviation) == sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, total))
    assert all(abs(by[k].explained - e[k[1] - 1] / np.trace(cov)) < 1e-9 and by[k].identity_error <= 1e-9 for k in by)


def test_whitening_equals_numpy(spark):
    rng = np.random.default_rng(2)
    vectors = {i: (rng.normal(size=9) * np.arange(1, 10) / 9).tolist() for i in range(300)}
    vectors |= {1000 + i: vectors[4] for i in range(150)} | {5000 + i: vectors[i] for i in range(20)}
    odd = [(-1, None), (-2, [float("nan")] * 9), (-3, [float("-inf")] + [0.0] * 8), (-4, [None] + [0.5] * 8), (-5, [1.0, 2.0]), (-6, [])]
    df = spark.createDataFrame([*vectors.items(), *odd], SCHEMA).withColumn("x", F.lit(1)).withColumn("whitened", F.lit("y")).repartition(4)
    check_rows(whitening.whiten(df).collect(), vectors)


def test_whitening_of_repeated_eigenvalues(spark):
    rows = [(2 * i + s, [(1.0 if s else -1.0) * (i == j) * (3 if i < 2 else 1) for j in range(5)]) for i in range(5) for s in (0, 1)]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA), most=5).collect()
    white = np.zeros((10, 5))
    for r in got:
        white[r.vec_id, r.component - 1] = r.whitened
    assert np.abs(np.cov(white.T, bias=True) - np.eye(5)).max() < 1e-9
    assert np.allclose(sorted((r.component, round(r.explained, 12)) for r in got if r.vec_id == 0), [(1, 9 / 21), (2, 9 / 21), (3, 1 / 21), (4, 1 / 21), (5, 1 / 21)])


def test_whitening_of_odd_tables(spark):
    for rows in ([], [(1, None)], [(1, [])], [(1, [0.5, 0.25])], [(1, [0.5, 0.25])] * 9):
        assert whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect() == []
    line = [(i, [float(i), 2.0 * i, 0.0]) for i in range(6)] + [(None, [1.0, 2.0, 0.0])]  # rank one: one component
    got = whitening.whiten(spark.createDataFrame(line, SCHEMA)).collect()
    assert {r.component for r in got} == {1} and len(got) == 7 and abs(got[0].explained - 1) < 1e-12
    huge = [(i, [1e30 * ((-1) ** i), float(i * i), 1e15 * i]) for i in range(9)]  # beyond longs: the nearest long; sums beyond 64 bits
    got = whitening.whiten(spark.createDataFrame(huge, SCHEMA)).collect()
    assert len(got) == 27 and max(r.identity_error for r in got) < 1e-4


def test_query_equals_numpy(spark):
    t = pq.read_table("/root/testdata/sf0.1/embeddings.parquet")
    got = queries.op12_exact_whitening(spark, "/root/testdata/sf0.1")
    assert dict(got.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    check_rows(got.collect(), dict(zip(t["vec_id"].to_pylist(), t["embedding"].to_pylist())))
