"""Relational constructs of the covered SQL dialect (R1-R33), Spark-first.

Most constructs are plain DataFrame calls; the helpers here exist where the
dialect's semantics (SQLite) differ from Spark's defaults:

* ``like``  -- SQLite LIKE ignores ASCII case  -> ``ilike``
* ``not_in`` -- SQL ``NOT IN`` is null-aware   -> ``isin(subquery)`` negated,
  which Catalyst plans as a null-aware anti join (broadcast when small)
* ``any_value_min`` -- a bare column under GROUP BY picks "some row" in SQLite;
  we pin it to the deterministic ``min``
* ``int_div`` -- SQLite integer division truncates
* ``top_k`` -- ORDER BY ... LIMIT with an explicit tie-breaker so the result
  is deterministic (TakeOrderedAndProject, no global sort)
* ``set_union/set_intersect/set_except`` -- distinct set semantics
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.session import cut_lineage


def like(col: Column | str, pattern: str) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return col.ilike(pattern)


def not_like(col: Column | str, pattern: str) -> Column:
    return ~like(col, pattern)


def in_subquery(col: Column | str, sub: DataFrame) -> Column:
    """``col IN (SELECT ...)``: planned as a left-semi join."""
    col = F.col(col) if isinstance(col, str) else col
    return col.isin(sub)


def not_in(col: Column | str, sub: DataFrame) -> Column:
    """Null-aware ``col NOT IN (SELECT ...)``: one NULL in the subquery empties the result."""
    return ~in_subquery(col, sub)


def exists_semi(outer: DataFrame, inner: DataFrame, on) -> DataFrame:
    """``WHERE EXISTS (correlated subquery)`` as a left-semi join."""
    return outer.join(inner, on, "left_semi")


def scalar(sub: DataFrame) -> Column:
    """Scalar subquery (one row, one column) usable inside expressions."""
    return sub.scalar()


def any_value_min(col: str) -> Column:
    """SQLite's bare column under GROUP BY, made deterministic."""
    return F.min(col)


def int_div(a: Column, b: Column) -> Column:
    """SQLite integer division (truncates toward zero); x/0 is NULL."""
    return F.when(b != 0, (a / b).cast("bigint"))


def top_k(df: DataFrame, k: int, order: Sequence[Column]) -> DataFrame:
    """ORDER BY ... LIMIT k; callers pass a tie-breaker as the last key."""
    return df.orderBy(*order).limit(k)


def set_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def set_intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def set_except(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


#: pairs of rows that one cell of ``theta_join`` compares
PAIRS_PER_CELL = 20_000_000


def _grid_join(a: DataFrame, b: DataFrame, equi: Sequence[tuple[str, str]], residual: Column | None) -> DataFrame:
    keys = [f"_k{i}" for i in range(len(equi))]
    count = lambda df, side, n: df.groupBy(*[F.col(e[side]).alias(k) for e, k in zip(equi, keys)]).agg(F.count("*").alias(n))
    sizes = count(a, 0, "_na").join(count(b, 1, "_nb"), keys)
    cells = F.ceil(F.col("_na") * F.col("_nb") / PAIRS_PER_CELL)
    down = F.least(cells, F.greatest(F.lit(1), F.ceil(F.sqrt(cells * F.col("_na") / F.col("_nb")))))
    grid = cut_lineage(sizes.withColumn("_down", down).withColumn("_across", F.ceil(cells / F.col("_down"))).select(*keys, "_down", "_across"))
    n = max(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), grid.agg(F.sum(F.col("_down") * F.col("_across"))).first()[0] or 0)

    def dealt(df, side, own, other, at, along):
        x = df.join(grid, [df[e[side]] == grid[k] for e, k in zip(equi, keys)]).withColumn(at, F.pmod(F.xxhash64(*df.columns), F.col(own)))
        x = x.withColumn(along, F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1))).drop("_down", "_across")
        # an explicit count: the rows are few for their pairs, and would be coalesced into a few tasks
        return x.repartition(n, *keys, "_i", "_j")
    x = dealt(a, 0, "_down", "_across", "_i", "_j").join(dealt(b, 1, "_across", "_down", "_j", "_i"), [*keys, "_i", "_j"])
    return (x if residual is None else x.where(residual)).drop(*keys, "_i", "_j")


def theta_join(a: DataFrame, b: DataFrame, equi: Sequence[tuple[str, str]], residual: Column | None,
               how: str = "inner") -> DataFrame:
    """JOIN ... ON with an equality part (hash-partitioned) and a residual predicate.

    Keeping at least one equality lets Spark plan a shuffled hash / sort-merge
    join instead of a nested loop; the residual is evaluated per matched pair.
    An inner join is quadratic in a key's rows, so a key of more than
    ``PAIRS_PER_CELL`` pairs is cut into a grid: rows of either side are dealt
    to its rows or columns by their hash and stand in each cell there. Every
    pair meets in one cell, and there are as many tasks as cells.
    """
    if how == "inner" and equi:
        return _grid_join(a, b, equi, residual)
    cond = None
    for left, right in equi:
        c = a[left] == b[right]
        cond = c if cond is None else cond & c
    if residual is not None:
        cond = residual if cond is None else cond & residual
    return a.join(b, cond, how)
