"""BLEU as aggregates.

Input frames: hypotheses ``(pair_id, toks)`` and references
``(pair_id, ref_id, toks)``. N-grams are exploded per row, counted with one
aggregation keyed by ``pair_id`` first (clip = min(hyp count, max ref count)
in the same grouping, no join), then summed per pair and over the corpus.
Smoothing methods 0-4 of the usual BLEU toolkit are expressions over the
four pooled (numerator, denominator) pairs.
"""

from __future__ import annotations

import math
import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_N = 4
EPSILON, K = 0.1, 5  # fixed smoothing constants of the toolkit (epsilon, k)


def tokens(col) -> Column:
    """Lower-cased whitespace tokens."""
    c = F.col(col) if isinstance(col, str) else col
    return F.filter(F.split(F.lower(c), r"\s+"), lambda s: s != "")


def _ngrams(df: DataFrame, ids: list[str], max_n: int) -> DataFrame:
    x = df.select(*ids, "toks", F.explode(F.sequence(F.lit(1), F.lit(max_n))).alias("n"))
    x = x.select(*ids, "n", F.explode(F.sequence(F.lit(1), F.greatest(F.size("toks") - F.col("n") + 1, F.lit(0))))
                 .alias("i"), "toks")
    return x.select(*ids, "n", F.array_join(F.slice("toks", F.col("i"), F.col("n")), " ").alias("g"))


def modified_precision(hyp: DataFrame, refs: DataFrame, max_n: int = MAX_N) -> DataFrame:
    """Per (pair_id, n) clipped matches and max(1, hyp n-grams)."""
    h = _ngrams(hyp.filter(F.size("toks") > 0), ["pair_id"], max_n).select(
        "pair_id", "n", "g", F.lit(-1).alias("ref_id"))
    r = _ngrams(refs.filter(F.size("toks") > 0), ["pair_id", "ref_id"], max_n).select("pair_id", "n", "g", "ref_id")
    c = h.unionByName(r).groupBy("pair_id", "n", "g", "ref_id").agg(F.count("*").alias("c"))
    per_g = c.groupBy("pair_id", "n", "g").agg(
        F.sum(F.when(F.col("ref_id") == -1, F.col("c")).otherwise(0)).alias("ch"),
        F.max(F.when(F.col("ref_id") != -1, F.col("c")).otherwise(0)).alias("mr"))
    per_n = per_g.groupBy("pair_id", "n").agg(F.sum(F.least("ch", "mr")).alias("num"), F.sum("ch").alias("cnt"))
    # every (pair, n) exists, even when the hypothesis is shorter than n
    grid = hyp.select("pair_id", F.explode(F.sequence(F.lit(1), F.lit(max_n))).alias("n"))
    out = grid.join(per_n, ["pair_id", "n"], "left").fillna(0, ["num", "cnt"])
    return out.select("pair_id", "n", F.col("num").cast("long"), F.greatest(F.col("cnt"), F.lit(1)).cast("long").alias("den"))


def lengths(hyp: DataFrame, refs: DataFrame) -> DataFrame:
    """Hypothesis length, closest reference length (ties to the shorter), brevity penalty."""
    h = hyp.select("pair_id", F.size("toks").alias("hyp_len"))
    r = refs.select("pair_id", F.size("toks").alias("rl")).join(h, "pair_id")
    best = r.groupBy("pair_id").agg(F.min_by("rl", F.struct(F.abs(F.col("rl") - F.col("hyp_len")), F.col("rl")))
                                    .alias("ref_len"))
    out = h.join(best, "pair_id", "left")
    return out.withColumn("bp", brevity_penalty(F.col("ref_len"), F.col("hyp_len")))


def brevity_penalty(ref_len: Column, hyp_len: Column) -> Column:
    return (F.when(hyp_len > ref_len, F.lit(1.0)).when(hyp_len == 0, F.lit(0.0))
            .otherwise(F.exp(F.lit(1.0) - ref_len / hyp_len)))


def _smooth(num: list[Column], den: list[Column], method: int, hyp_len: Column) -> list[Column]:
    """Smoothed precisions p_1..p_4 (as doubles) for methods 0-4."""
    out = []
    zeros_before = F.lit(0)
    for i, (nu, de) in enumerate(zip(num, den)):
        p = nu / de
        if method == 0:
            out.append(F.when(nu != 0, p).otherwise(F.lit(sys.float_info.min)))
        elif method == 1:
            out.append(F.when(nu != 0, p).otherwise((nu + EPSILON) / de))
        elif method == 2:
            out.append((nu + 1) / (de + 1))
        elif method == 3:
            k = zeros_before + 1
            out.append(F.when(nu != 0, p).otherwise(F.lit(1.0) / (F.pow(F.lit(2.0), k) * de)))
            zeros_before = zeros_before + F.when(nu == 0, 1).otherwise(0)
        elif method == 4:
            # the toolkit computes i + 1*k/ln(len): precedence kept for parity
            inc = F.lit(float(i)) + F.lit(float(K)) / F.log(hyp_len)
            out.append(F.when((nu == 0) & (hyp_len != 0), inc / de).otherwise(p))
        else:
            raise ValueError(f"smoothing method {method} not supported")
    return out


def _score(num, den, bp, hyp_len, method: int) -> Column:
    ps = _smooth(num, den, method, hyp_len)
    s = sum((F.lit(1.0 / MAX_N) * F.log(p) for p in ps), F.lit(0.0))
    return F.when(num[0] == 0, F.lit(0.0)).otherwise(bp * F.exp(s))


def corpus_bleu(hyp: DataFrame, refs: DataFrame, methods=(0,)) -> DataFrame:
    """One row with pooled counts, brevity penalty and BLEU per smoothing method."""
    mp = modified_precision(hyp, refs)
    pooled = mp.groupBy().agg(*[F.sum(F.when(F.col("n") == n, F.col("num"))).alias(f"num{n}") for n in range(1, 5)],
                              *[F.sum(F.when(F.col("n") == n, F.col("den"))).alias(f"den{n}") for n in range(1, 5)])
    ln = lengths(hyp, refs).agg(F.sum("hyp_len").alias("hyp_len"), F.sum(F.coalesce("ref_len", F.lit(0))).alias("ref_len"))
    x = pooled.crossJoin(ln)  # two single-row aggregates
    bp = brevity_penalty(F.col("ref_len"), F.col("hyp_len"))
    num = [F.col(f"num{n}") for n in range(1, 5)]
    den = [F.col(f"den{n}") for n in range(1, 5)]
    cols = [F.col("hyp_len").cast("long"), F.col("ref_len").cast("long"), bp.alias("bp")]
    cols += [(F.col(f"num{n}") / F.col(f"den{n}")).alias(f"p{n}") for n in range(1, 5)]
    cols += [_score(num, den, bp, F.col("hyp_len"), m).alias(f"bleu_m{m}") for m in methods]
    return x.select(*cols)


def sentence_bleu(hyp: DataFrame, refs: DataFrame, methods=(0, 1)) -> DataFrame:
    """BLEU of every pair on its own."""
    mp = modified_precision(hyp, refs)
    per = mp.groupBy("pair_id").agg(*[F.max(F.when(F.col("n") == n, F.col("num"))).alias(f"num{n}") for n in range(1, 5)],
                                    *[F.max(F.when(F.col("n") == n, F.col("den"))).alias(f"den{n}") for n in range(1, 5)])
    ln = lengths(hyp, refs)
    x = per.join(ln, "pair_id")
    num = [F.col(f"num{n}") for n in range(1, 5)]
    den = [F.col(f"den{n}") for n in range(1, 5)]
    return x.select("pair_id", *[_score(num, den, F.col("bp"), F.col("hyp_len"), m).alias(f"bleu_m{m}")
                                 for m in methods])


def log_min() -> float:
    return math.log(sys.float_info.min)
