"""Choosing among candidates and ordering what was chosen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.functions import ordered
from skein.operators import tokens as tk
from skein.operators.align import EOS


def mean_score(toks: str, scores: str) -> Column:
    """Mean token score up to the first EOS, that one included; without an EOS over all tokens; null for no token."""
    end = F.array_position(toks, EOS)
    upto = F.when(end > 0, F.slice(scores, 1, end.cast("int"))).otherwise(F.col(scores))
    return F.aggregate(upto, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(upto), F.lit(0))


def rerank_max(beams: DataFrame, key: str, order: Column | None = None) -> DataFrame:
    """(key, beam, score): of the valid beams (key, beam, toks, scores, valid) the one of the best mean score.

    Ties go to the smaller beam number. With ``order`` (D27: the exact match against gold) that comes before the score. One
    aggregate per key, combined before the shuffle; keys without a valid beam are left out.
    """
    x = beams.where("valid").withColumn("score", mean_score("toks", "scores"))
    first = F.lit(0) if order is None else order
    # a filter on the score would be pushed below it and compute every score twice: beams without one are null here
    best = x.groupBy(key).agg(F.max(F.when(F.col("score").isNotNull(), F.struct(first.alias("first"), "score", (-F.col("beam")).alias("back")))).alias("b"))
    return best.where("b is not null").select(key, (-F.col("b.back")).alias("beam"), F.col("b.score").alias("score"))


def rerank_oracle(beams: DataFrame, key: str, gold: str) -> DataFrame:
    """An exact token match with ``gold`` (an array) first, then the best mean score, among valid beams."""
    end = F.array_position("toks", EOS)
    own = F.when(end > 0, F.slice("toks", 1, (end - 1).cast("int"))).otherwise(F.col("toks"))
    return rerank_max(beams, key, F.coalesce((own == F.col(gold)).cast("int"), F.lit(0)))


def unaliased(toks: str) -> Column:
    """Does a token array name a column by a table instead of an alias T1, T2, ...?"""
    return F.exists(toks, lambda t: t.contains(".") & ~tk.is_literal(t) & ~t.rlike(r"^t[0-9]+\."))


def number_interactions(df: DataFrame, db: str, arrival: str, width: int = 4096) -> DataFrame:
    """``number``, from 1, of each row inside its database in order of ``arrival`` (distinct integers).

    Ranges of ``width`` arrivals are counted per database and only those counts are summed in order, so a database that
    holds a third of all rows is numbered by many tasks.
    """
    x = df.withColumn("_range", F.floor(F.col(arrival) / width))
    counts = x.groupBy(db, "_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(db).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    x = x.join(counts.select(db, "_range", before.alias("_before")), [db, "_range"])
    inside = F.row_number().over(Window.partitionBy(db, "_range").orderBy(arrival))
    return x.withColumn("number", (F.col("_before") + inside).cast("long")).drop("_range", "_before")


def order_like_gold(preds: DataFrame, gold: DataFrame, db: str, interaction: str, turn: str, pos: str, width: int = 4096) -> DataFrame:
    """``ordinal`` of each prediction: databases as they first appear in ``gold`` (by ``pos``), then interaction, then turn.

    Databases that gold lacks come last, by name.
    """
    first = gold.groupBy(db).agg(F.min(pos).alias("_p"))
    dbs = preds.select(db).distinct().join(first, db, "left").select(db, F.row_number().over(Window.orderBy(F.col("_p").asc_nulls_last(), db)).alias("_at"))  # a row per database
    x = preds.join(dbs, db)
    chunk = F.col("_at") * (1 << 40) + F.floor(F.col(interaction) / width)
    return ordered.global_ordinal(x, chunk, [F.col("_at"), F.col(interaction), F.col(turn)], "ordinal").drop("_at")
