"""Order-dependent computations without a single-partition window.

A window with no PARTITION BY moves every row to one task. For global row
numbers, running sums and running maxima we use a two-level prefix: rows are
grouped into chunks of a numeric ordering key, per-chunk totals are combined
map-side, the (small) chunk table gets its exclusive prefix, and each row adds
its chunk's offset to a window computed *inside* its chunk.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _chunk_table(df: DataFrame, chunk: Column, aggs: dict[str, Column]) -> DataFrame:
    return df.groupBy(chunk.alias("_chunk")).agg(*[v.alias(k) for k, v in aggs.items()])


def _attach(df: DataFrame, chunks: DataFrame) -> DataFrame:
    # one row per chunk of the key range: the planner broadcasts it under its own byte threshold
    return df.join(chunks, "_chunk")


def global_ordinal(df: DataFrame, chunk: Column, order: Sequence[Column], name: str = "ordinal") -> DataFrame:
    """1-based row number in ``order`` over the whole frame.

    ``chunk`` must be monotone in ``order`` (e.g. ``floor(id / 4096)``).
    """
    x = df.withColumn("_chunk", chunk)
    counts = _chunk_table(x, F.col("_chunk"), {"_n": F.count("*")})
    counts = counts.withColumn("_off", F.coalesce(F.sum("_n").over(
        Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    x = _attach(x, counts.select("_chunk", "_off"))
    rn = F.row_number().over(Window.partitionBy("_chunk").orderBy(*order))
    return x.withColumn(name, (F.col("_off") + rn).cast("long")).drop("_chunk", "_off")


def running_sum(df: DataFrame, chunk: Column, order: Sequence[Column], value: Column, name: str,
                inclusive: bool = True) -> DataFrame:
    """Running sum of ``value`` in ``order`` over the whole frame."""
    x = df.withColumn("_chunk", chunk).withColumn("_v", value)
    tot = _chunk_table(x, F.col("_chunk"), {"_s": F.sum("_v")})
    tot = tot.withColumn("_off", F.coalesce(F.sum("_s").over(
        Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    x = _attach(x, tot.select("_chunk", "_off"))
    hi = 0 if inclusive else -1
    inner = F.coalesce(F.sum("_v").over(Window.partitionBy("_chunk").orderBy(*order)
                                        .rowsBetween(Window.unboundedPreceding, hi)), F.lit(0))
    return x.withColumn(name, F.col("_off") + inner).drop("_chunk", "_off", "_v")


def running_max(df: DataFrame, chunk: Column, order: Sequence[Column], value: Column, name: str,
                inclusive: bool = True) -> DataFrame:
    """Running maximum of ``value`` in ``order`` (NULL before the first row when exclusive)."""
    x = df.withColumn("_chunk", chunk).withColumn("_v", value)
    tot = _chunk_table(x, F.col("_chunk"), {"_m": F.max("_v")})
    tot = tot.withColumn("_off", F.max("_m").over(
        Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)))
    x = _attach(x, tot.select("_chunk", "_off"))
    hi = 0 if inclusive else -1
    inner = F.max("_v").over(Window.partitionBy("_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, hi))
    both = F.greatest(F.col("_off"), inner)  # greatest ignores NULLs
    return x.withColumn(name, both).drop("_chunk", "_off", "_v")
