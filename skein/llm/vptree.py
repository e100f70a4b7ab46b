"""Approximate nearest neighbours: a vantage-point tree per shard, pruned by a relaxed triangle inequality.

Cosine order on unit vectors is the order of Euclidean distance, which is a metric, so for a query q and a ball of
points whose distances to a vantage point v lie in [lo, hi], no point is nearer than max(d(q,v) - hi, lo - d(q,v)).
A subtree is skipped when ``factor`` times that bound exceeds the distance of the k-th neighbour found so far:
factor 1 is exact search, larger factors skip more.

* Distinct vectors: equal vectors have equal scores, so each keeps the k + 1 least ids of its rows; by score and id no
  other of its rows can be among k neighbours. A vector that a third of all rows share is one point.
* Shards: a top tree over at most ``SAMPLE`` sampled vectors (the ones of least hash) cuts the space into at most
  ``CELLS`` cells; every distinct vector goes to its cell, and cells of more than ``rows`` vectors are divided by hash. The
  sample decides which shard a vector is in and nothing else.
* Search: first every query goes to the shards of its own cell, then, with the k-th distance found there, to the
  cells that the cells' exact distance ranges do not rule out. A task gets a shard's points (at most about ``rows``), builds
  the tree and streams the queries through in batches; a shard with many queries is read by several tasks.

Scores are computed per pair in one fixed order of summation, so they do not depend on partitions.

Defined cases: vectors that are null, zero or hold null or non-finite entries take no part, nor do vectors of another
length than the most frequent one (ties: the longer) and rows without vec_id; a row repeated in id and vector counts once; rows that
share an id but not the vector are queries of their own, and no candidate has its query's id; fewer candidates than k: all of them;
ties go to the smaller vec_id; columns of other names are left behind.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import cut, small_batches
from skein.llm.vectors import common_length, finite, matrix

#: Vectors of the top tree's sample, its most cells, vectors of a shard, points of a leaf, queries that one task takes.
SAMPLE, CELLS, ROWS, LEAF, QUERIES = 16_384, 1_024, 8_192, 128, 16_384
#: Distances of unit vectors carry errors up to the root of double precision; bounds give way by this much.
SLACK = 1e-7
#: Scores by matrix product and by the fixed order differ by less.
BLUR = 1e-12


def units(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vectors scaled by a power of two so that squares neither overflow nor vanish, their norms, unit vectors)."""
    _, power = np.frexp(np.abs(raw).max(axis=1, initial=0))
    scaled = np.ldexp(raw, -power[:, None])
    norms = np.sqrt((scaled * scaled).sum(axis=1))
    return scaled, norms, scaled / norms[:, None]


def _distance(points: np.ndarray, one: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * (points @ one)))


class Tree:
    """Vantage-point tree over points (ids: a short list for each point) with batched k-nearest search."""

    def __init__(self, raw: np.ndarray, ids: list[list[int]]):
        self.scaled, self.norms, self.unit = units(raw)
        self.ids = ids
        self.order = np.arange(len(raw))
        self.nodes: list[tuple] = []  # (begin, end, vantage point, children [(node, lo, hi)])
        if len(raw):
            self._grow(0, len(raw))

    def _vantage(self, own: np.ndarray) -> int:
        """Of a few evenly spaced points, the one whose distances to others spread most."""
        some = own[:: max(1, len(own) // 64)]
        tried = own[:: max(1, len(own) // 5)][:5]
        return max(tried, key=lambda i: float(_distance(self.unit[some], self.unit[i]).std()))

    def _grow(self, begin: int, end: int) -> int:
        at = len(self.nodes)
        self.nodes.append((begin, end, None, []))
        if end - begin > LEAF:
            own = self.order[begin:end]
            vantage = self._vantage(own)
            far = _distance(self.unit[own], self.unit[vantage])
            place = np.argsort(far, kind="stable")
            self.order[begin:end], far = own[place], far[place]
            half = (end - begin) // 2
            children = [(self._grow(a, b), far[a - begin], far[b - 1 - begin]) for a, b in ((begin, begin + half), (begin + half, end))]
            self.nodes[at] = (begin, end, vantage, children)
        return at

    def search(self, raw: np.ndarray, own: list[int], k: int, least: np.ndarray, factor: float) -> list[list[tuple[float, int]]]:
        """Per query up to k (score, id), best first; ``least``: score that a k-th neighbour found elsewhere has, or -inf."""
        scaled, norms, unit = units(raw)
        found: list[list[tuple[float, int]]] = [[] for _ in own]
        least = least.copy()
        self.scanned = 0
        stack = [(0, np.arange(len(own)), np.zeros(len(own)))] if self.nodes and own else []
        while stack:
            node, active, bound = stack.pop()
            near = np.where(np.isfinite(least[active]), np.sqrt(np.maximum(0, 2 - 2 * least[active])) + SLACK, np.inf)
            keep = factor * bound <= near
            active, bound = active[keep], bound[keep]
            if not len(active):
                continue
            begin, end, vantage, children = self.nodes[node]
            if children:
                far = _distance(unit[active], self.unit[vantage])
                both = [(child, np.maximum(bound, np.maximum(far - hi, lo - far))) for child, lo, hi in children]
                both.sort(key=lambda x: -x[1].mean())  # the nearer child is taken first
                stack += [(child, active, b) for child, b in both]
                continue
            points = self.order[begin:end]
            self.scanned += len(active) * len(points)
            score = unit[active] @ self.unit[points].T
            floor = least[active]
            if len(points) > k + 1:  # of k + 1 points at least k are not the query's own
                floor = np.maximum(floor, np.partition(score, len(points) - k - 1, axis=1)[:, len(points) - k - 1])
            rows, cols = np.nonzero(score >= floor[:, None] - BLUR)
            q, p = active[rows], points[cols]
            exact = (scaled[q] * self.scaled[p]).sum(axis=1) / (norms[q] * self.norms[p])
            touched = set()
            for i, j, s in zip(q.tolist(), p.tolist(), exact.tolist(), strict=True):
                found[i] += [(s, v) for v in self.ids[j] if v != own[i]]
                touched.add(i)
            for i in touched:
                found[i] = sorted(found[i], key=lambda x: (-x[0], x[1]))[:k]
                if len(found[i]) == k:
                    least[i] = max(least[i], found[i][-1][0])
        return found


# ------------------------------------------------------------------ shards

def _kind(df: DataFrame, vec_col: str) -> str:
    """Vectors travel as floats if they are stored so, else as doubles."""
    return "array<float>" if df.schema[vec_col].dataType.simpleString() == "array<float>" else "array<double>"


def distinct_vectors(df: DataFrame, k: int, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """(vec, ids: the k + 1 least ids of its rows) of each vector that takes part, and the vectors' length."""
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast(_kind(df, vec_col)).alias("vec"))
    rows = rows.where(F.col("vec_id").isNotNull() & finite(F.col("vec"))).where(F.exists("vec", lambda c: c != 0))
    width = common_length(rows, "vec")
    rows = rows.where(F.size("vec") == width).distinct()
    least = F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))
    return rows.withColumn("n", least).where(F.col("n") <= k + 1).groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), width


class TopTree:
    """Cells of the space: a balanced tree of vantage points over a sample. Nodes are numbered as in a heap."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.depth = max(0, math.ceil(math.log2(max(1, cells))))
        unit = units(sample)[2] if len(sample) else sample
        self.vantage = np.zeros((max(1, (1 << self.depth) - 1), unit.shape[1]))
        self.radius = np.full(len(self.vantage), np.inf)
        groups = {0: np.arange(len(unit))}
        for node in range((1 << self.depth) - 1):
            own = groups.pop(node)
            if len(own):
                some = own[:: max(1, len(own) // 64)]
                best = max(own[:: max(1, len(own) // 5)][:5], key=lambda i: float(_distance(unit[some], unit[i]).std()))
                far = _distance(unit[own], unit[best])
                self.vantage[node], self.radius[node] = unit[best], np.median(far)
            else:
                far = np.zeros(0)
            inside = far <= self.radius[node]
            groups[2 * node + 1], groups[2 * node + 2] = own[inside], own[~inside]

    def route(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, distances to the vantage points on the way) of unit vectors."""
        node, path = np.zeros(len(unit), dtype=np.int64), np.zeros((len(unit), self.depth))
        for level in range(self.depth):
            far = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ij,ij->i", unit, self.vantage[node])))
            path[:, level] = far
            node = 2 * node + 1 + (far > self.radius[node])
        return node - ((1 << self.depth) - 1), path

    def way(self, cell: int) -> list[int]:
        """Nodes from the root to a cell, without the cell."""
        node, out = cell + (1 << self.depth) - 1, []
        while node:
            node = (node - 1) // 2
            out.append(node)
        return out[::-1]


def _routed(rows: DataFrame, top: TopTree, width: int) -> DataFrame:
    """Adds ``cell`` and ``path`` to rows with a column ``vec``."""
    names = rows.columns

    def route(batches):
        for batch in batches:
            cell, path = top.route(units(matrix(batch.column("vec"), width))[2])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(cell), pa.array(path.tolist(), pa.list_(pa.float64()))], names=[*names, "cell", "path"])

    return rows.mapInArrow(route, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", cell long, path array<double>")


def least_distances(unit: np.ndarray, top: TopTree, cells: list[tuple]) -> np.ndarray:
    """Queries x cells: least distance that any vector of a cell can have, by the cell's ranges."""
    far = np.sqrt(np.maximum(0, 2 - 2 * (unit @ top.vantage.T)))
    out = np.zeros((len(unit), len(cells)))
    for i, (cell, _, ranges) in enumerate(cells):
        for node, (lo, hi) in zip(top.way(cell), ranges, strict=True):
            out[:, i] = np.maximum(out[:, i], np.maximum(far[:, node] - hi, lo - far[:, node]))
    return out


class Shards:
    """Distinct vectors in cells and shards: table ``points`` (cell, sub, ids, vec), and per cell its shards and distance ranges."""

    def __init__(self, vectors: DataFrame, width: int, rows: int):
        self.width, self.rows = width, rows
        total = vectors.count()
        cells = min(CELLS, -(-total // rows))
        sample = vectors.select("vec").orderBy(F.xxhash64("vec"), "vec").limit(SAMPLE).toArrow() if cells > 1 else None
        self.top = TopTree(matrix(sample.column("vec").combine_chunks(), width) if sample is not None and len(sample) else np.zeros((0, width)), cells)
        routed = cut(_routed(vectors, self.top, width), "vptree-routed")
        depth = self.top.depth
        ends = [f(F.col("path")[i]).alias(f"{name}{i}") for i in range(depth) for name, f in (("lo", F.min), ("hi", F.max))]
        #: At most CELLS rows: (cell, number of shards, [(lo, hi)] to the vantage points on its way).
        self.cells = [(r["cell"], -(-r["n"] // rows), [(r[f"lo{i}"], r[f"hi{i}"]) for i in range(depth)]) for r in routed.groupBy("cell").agg(F.count("*").alias("n"), *ends).collect()]
        subs = F.broadcast(vectors.sparkSession.createDataFrame([(c, s) for c, s, _ in self.cells], "cell long, subs long"))
        self.points = routed.join(subs, "cell").select("cell", F.pmod(F.xxhash64("vec"), F.col("subs")).alias("sub"), "ids", "vec")

    def search(self, visits: DataFrame, k: int, factor: float) -> DataFrame:
        """visits (query, query_id, vec, least, cell) -> (query, query_id, vec_id, score): up to k for each query and shard."""
        width, spark = self.width, visits.sparkSession
        asked = dict(visits.groupBy("cell").count().collect())
        subs = F.broadcast(spark.createDataFrame([(c, s, -(-asked.get(c, 0) // QUERIES)) for c, s, _ in self.cells], "cell long, subs long, turns long"))
        each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
        queries = visits.join(subs, "cell").withColumn("turn", F.pmod(F.hash("query"), F.col("turns")))
        queries = queries.withColumn("sub", each(F.col("subs"))).select("cell", "sub", "turn", F.lit(1).alias("kind"), "query", "query_id", "least", F.lit(None).cast("array<long>").alias("ids"), "vec")
        points = self.points.join(subs, "cell").where("turns > 0").withColumn("turn", each(F.col("turns")))
        points = points.select("cell", "sub", "turn", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("query"), F.lit(None).cast("long").alias("query_id"), F.lit(None).cast("double").alias("least"), "ids", "vec")
        dealt = points.unionByName(queries).repartition("cell", "sub", "turn").sortWithinPartitions("cell", "sub", "turn", "kind", "query")

        def look(batches):
            key, tree, parts = None, None, []
            for batch in batches:
                keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "sub", "turn", "kind")], axis=1)
                starts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist()] if len(keys) else []
                for a, b in zip(starts, [*starts[1:], len(keys)], strict=True):
                    part, now = batch.slice(a, b - a), tuple(keys[a, :3])
                    raw = matrix(part.column("vec"), width)
                    if now != key:
                        key, tree, parts = now, None, []
                    if keys[a, 3] == 0:
                        parts.append((raw, part.column("ids").to_pylist()))
                        continue
                    if tree is None:
                        tree, parts = Tree(np.concatenate([np.zeros((0, width)), *[p[0] for p in parts]]), [i for p in parts for i in p[1]]), []
                    own = part.column("query_id").to_pylist()
                    found = tree.search(raw, own, k, part.column("least").to_numpy(zero_copy_only=False), factor)
                    names = part.column("query").to_pylist()
                    flat = [(names[i], own[i], v, s) for i, x in enumerate(found) for s, v in x]
                    if flat:
                        columns = list(zip(*flat, strict=True))
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query", "query_id", "vec_id", "score"])

        return dealt.mapInArrow(look, "query string, query_id long, vec_id long, score double")


def _first(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query, numbered."""
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def nearest(df: DataFrame, is_query: Column, k: int = 5, factor: float = 1.0, rows: int = ROWS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of each row for which ``is_query`` (a condition on vec_id) holds."""
    spark = df.sparkSession
    small_batches(spark)
    vectors, width = distinct_vectors(df, k, id_col, vec_col)
    if not width:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shards = Shards(cut(vectors, "vptree-vectors"), width, rows)
    asked = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast(_kind(df, vec_col)).alias("vec")).where(is_query)
    asked = asked.where(F.col("vec_id").isNotNull() & finite(F.col("vec")) & (F.size("vec") == width)).where(F.exists("vec", lambda c: c != 0)).distinct()
    asked = asked.select(F.concat_ws(":", "vec_id", F.sha2(F.col("vec").cast("string"), 256)).alias("query"), F.col("vec_id").alias("query_id"), "vec")
    queries = cut(_routed(asked, shards.top, width).drop("path"), "vptree-queries")
    home = cut(_first(shards.search(queries.withColumn("least", F.lit(float("-inf"))), k, factor), k), "vptree-home")
    found = home
    if len(shards.cells) > 1:
        last = home.where(F.col("rank") == k).select("query", F.col("score").alias("least"))
        near = queries.join(last, "query", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
        top, cells, names = shards.top, shards.cells, np.array([c for c, _, _ in shards.cells], dtype=np.int64)

        def visit(batches):
            for batch in batches:
                least = batch.column("least").to_numpy()
                near = np.where(np.isfinite(least), np.sqrt(np.maximum(0, 2 - 2 * least)) + SLACK, np.inf)
                open_ = factor * least_distances(units(matrix(batch.column("vec"), width))[2], top, cells) <= near[:, None]
                open_ &= names[None, :] != batch.column("cell").to_numpy()[:, None]
                row, cell = np.nonzero(open_)
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(row)) for c in ("query", "query_id", "vec", "least")], pa.array(names[cell])], names=["query", "query_id", "vec", "least", "cell"])

        visits = near.select("query", "query_id", "vec", "least", "cell").mapInArrow(visit, f"query string, query_id long, vec {_kind(df, vec_col)}, least double, cell long")
        rest = shards.search(cut(visits, "vptree-visits"), k, factor)
        found = _first(home.drop("rank").unionByName(rest), k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


#: The query's rows in DuckDB, every query against every row.
ORACLE = """
WITH v AS (SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
l AS (SELECT len(e) AS n FROM v GROUP BY 1 ORDER BY count(*) DESC, 1 DESC LIMIT 1),
own AS (SELECT v.* FROM v, l WHERE len(e) = n),
q AS (SELECT row_number() OVER () AS r, vec_id, e FROM own WHERE vec_id % 50 = 0),
s AS (SELECT r, q.vec_id AS query_id, own.vec_id, list_dot_product(q.e, own.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(own.e, own.e))) AS score FROM q, own WHERE own.vec_id <> q.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM k WHERE rank <= 5
"""
