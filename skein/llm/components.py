"""Connected components of an edge table, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """(v, root): the least vertex reachable from each vertex of edges (a, b).

    Every round takes the least root among neighbours and then the root's own root, so long chains shorten by
    doubling; it ends with the round that changes nothing.
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct(), "edges")
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("root")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("v")).groupBy("a").agg(F.min("root").alias("m"))
        step = labels.join(near, F.col("v") == F.col("a"), "left").select("v", F.col("root").alias("old"), F.least("root", F.coalesce("m", "root")).alias("mid"))
        up = labels.select(F.col("v").alias("r"), F.col("root").alias("top"))
        new = cut(step.join(up, F.col("mid") == F.col("r"), "left").select("v", "old", F.least("mid", F.coalesce("top", "mid")).alias("root")), "labels")
        labels = new.select("v", "root")
        if not new.where("old <> root").limit(1).count():
            return labels
