"""Alignments: literals to slots (T13), words to pointers (D30, D31), result frames to each other (E21), batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions import ordered
from skein.functions.hashing import bucket

# ------------------------------------------------------------------ T13

#: For each slot its tokens: of the spans with the same neighbours (from every start that fits to the nearest end that
#: fits) the shortest. The arrays and their lower-case forms are bound once as z, so that no element computes them again.
_SPANS = """element_at(transform(array(named_struct('no', transform({no}, t -> lower(t)), 'low', transform({yes}, t -> lower(t)), 'yes', {yes})), z ->
  transform(filter(transform(z.no, (t, i) -> if(t in ('value', 'limit_value'), i, -1)), i -> i >= 0), i ->
    transform(array(array_min(filter(transform(sequence(0, size(z.yes) - 1), j -> if(not ((j = 0 and i = 0) or (j > 0 and i > 0 and get(z.low, j - 1) = get(z.no, i - 1))), null,
      struct(array_min(filter(sequence(j, size(z.yes) - 1), k -> (k + 1 = size(z.yes) and i + 1 = size(z.no))
        or (k + 1 < size(z.yes) and i + 1 < size(z.no) and get(z.low, k + 1) = get(z.no, i + 1)))) - j as len, j as at))),
      s -> s is not null and s.len is not null))), s -> if(s is null, null, slice(z.yes, s.at + 1, s.len + 1)))[0])), 1)"""


def align_values(df: DataFrame, no: str, yes: str, out: str = "vals") -> DataFrame:
    """``out``, an array of token spans of ``yes``, one for each ``value`` or ``limit_value`` of ``no`` (both token arrays).

    A slot takes the shortest span between the same neighbours (letters' case aside), the leftmost of equals; a span has at
    least one token. Rows with a slot that nothing fits, or with a null or empty side, are rejected. Row-local; the spans are
    a generator's input, since a filter on them would be pushed down and compute them, and all they read, again.
    """
    spans = F.expr("if(size(`{no}`) > 0 and size(`{yes}`) > 0, ".replace("{no}", no).replace("{yes}", yes) + _SPANS.format(no=f"`{no}`", yes=f"`{yes}`") + ", null)")
    fits = F.filter(F.array(spans), lambda a: a.isNotNull() & ~F.exists(a, lambda s: s.isNull()))
    return df.select("*", F.explode(fits).alias(out))


# ------------------------------------------------------------------ D30, D31

EOS = "EOS"


def vocabulary(words: DataFrame, word: str) -> DataFrame:
    """(word, idx) of the distinct words, numbered from 0 in order of their text, and EOS."""
    v = words.select(F.col(word).alias("word")).where("word is not null").unionByName(words.sparkSession.createDataFrame([(EOS,)], "word string")).distinct()
    v = ordered.global_ordinal(v, F.conv(F.substring(F.hex(F.rpad("word", 2, "\0")), 1, 4), 16, 10).cast("long"), [F.col("word")], "idx")
    return v.select("word", (F.col("idx") - 1).alias("idx"))


def encode(df: DataFrame, key: str, toks: str, cands: str, vocab: DataFrame, size: int, skip_unseen: bool = False) -> DataFrame:
    """(key, pointer): each token's index in the vocabulary, or ``size`` plus its place in the row's candidates; EOS last.

    A token that neither has is tried with an s at its end; if that fails as well it is left out (``skip_unseen``), or the row is.
    Tokens meet the vocabulary by a join, so it may be as large as the corpus makes it.
    """
    x = df.select(key, F.col(cands).alias("cands"), F.posexplode(F.concat(F.col(toks), F.array(F.lit(EOS)))).alias("pos", "word"))
    at = lambda w: F.nullif(F.array_position("cands", w), F.lit(0)) + F.lit(size - 1)
    v = vocab.select("word", "idx")
    x = x.join(v, "word", "left").join(v.select(F.col("word").alias("plural"), F.col("idx").alias("plural_idx")), F.col("plural") == F.concat("word", F.lit("s")), "left")
    p = F.coalesce("idx", at(F.col("word")), F.col("plural_idx"), at(F.concat("word", F.lit("s")))).cast("long")
    g = x.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", p.alias("p")))).alias("ps")).select(key, F.transform("ps", lambda s: s["p"]).alias("pointer"))
    if skip_unseen:
        return g.withColumn("pointer", F.filter("pointer", lambda p: p.isNotNull()))
    return g.where(~F.exists("pointer", lambda p: p.isNull()))


def decode(df: DataFrame, key: str, pointer: str, cands: str, vocab: DataFrame, size: int) -> DataFrame:
    """(key, toks): the tokens that a pointer names, up to the first EOS. Indexes that name nothing make the token null."""
    x = df.select(key, F.col(cands).alias("cands"), F.posexplode_outer(F.col(pointer)).alias("pos", "p"))
    x = x.join(vocab.select(F.col("idx").alias("p"), "word"), "p", "left")
    own = F.when(F.col("p") >= size, F.get("cands", (F.col("p") - size).cast("int"))).otherwise(F.col("word"))
    g = x.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", own.alias("w"))))).alias("ws"))
    toks = F.transform("ws", lambda s: s["w"])
    end = F.array_position(toks, EOS)
    return g.select(key, F.when(end > 0, F.slice(toks, 1, (end - 1).cast("int"))).otherwise(toks).alias("toks"))


# ------------------------------------------------------------------ E21

def _signatures(df: DataFrame, cols: list[str]) -> list[tuple]:
    """Per column (values, nulls, sum of value hashes): a fingerprint of its multiset, by one aggregate."""
    aggs = []
    for c in cols:
        aggs += [F.count(c), F.sum(F.xxhash64(F.col(c).cast("string")).cast("decimal(38,0)")), F.sum(F.hash(F.col(c).cast("string"), F.lit(7)).cast("long"))]
    row = df.agg(F.count("*"), *aggs).first()
    return [(row[0], row[1 + 3 * i], row[2 + 3 * i] or 0, row[3 + 3 * i] or 0) for i in range(len(cols))]


def result_match(gold: DataFrame, pred: DataFrame, order: tuple[Column, Column] | None = None) -> bool:
    """Do two result frames hold the same rows, whatever the order and names of their columns?

    Without ``order`` as bags; with it (one row-number column each, not compared) in row order. Columns are paired by
    fingerprints of their multisets of values; where several columns of a frame hold the same multiset, the values of a row's
    equal columns are compared as a bag. Then every different row is counted on both sides: no pair of rows is ever formed.
    """
    def prepared(df, pos):
        cols = [c for c in df.columns]
        x = df if pos is None else df.withColumn("_pos", pos)
        return x, cols, _signatures(df, cols)

    (g, gc, gs), (p, pc, ps) = prepared(gold, order and order[0]), prepared(pred, order and order[1])
    if sorted(gs) != sorted(ps):
        return False

    def rows(x, cols, sigs, side):
        groups = [F.array_sort(F.array(*[F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")) for c, t in zip(cols, sigs, strict=True) if t == s])) for s in sorted(set(sigs))]
        key = [k.alias(f"k{i}") for i, k in enumerate(groups)] + ([] if order is None else [F.col("_pos").alias("kpos")])
        return x.select(*key, F.lit(1 if side else -1).alias("side"))

    both = rows(g, gc, gs, True).unionByName(rows(p, pc, ps, False))
    keys = [c for c in both.columns if c != "side"]
    return both.groupBy(*keys).agg(F.sum("side").alias("d")).where("d <> 0").limit(1).count() == 0


# ------------------------------------------------------------------ D22

def mix_batches(real: DataFrame, synth: DataFrame, key: str, share: float, batch: int, salt: str = "d22") -> DataFrame:
    """(batch, origin, slot, key): every batch holds int(share * batch) synthetic rows, drawn with replacement, beside real ones.

    Real rows are dealt in md5 order of their key, each once; the last batch may have fewer of them. A synthetic slot of a
    batch draws an ordinal by md5 bucket and meets its row by an equi-join, so no task holds all draws or all rows.
    Without synthetic rows the batches hold real ones alone.
    """
    own = int(share * batch)
    h = F.md5(F.concat(F.lit(salt + ":"), F.col(key).cast("string")))
    number = lambda df: ordered.global_ordinal(df.select(key, h.alias("_h")), F.conv(F.substring("_h", 1, 3), 16, 10).cast("long"), [F.col("_h"), F.col(key)], "nr")
    r = number(real).select(F.floor((F.col("nr") - 1) / (batch - own)).cast("long").alias("batch"), F.lit("real").alias("origin"),
                            F.pmod(F.col("nr") - 1, F.lit(batch - own)).cast("long").alias("slot"), key)
    n_real, n_synth = real.count(), synth.count()
    if not own or not n_synth:
        return r
    draws = real.sparkSession.range(-(-n_real // (batch - own)) * own).select((F.col("id") / own).cast("long").alias("batch"), F.pmod("id", F.lit(own)).alias("slot"))
    draws = draws.withColumn("nr", bucket(salt + "s", F.concat_ws(":", "batch", "slot"), n_synth) + 1)
    s = draws.join(number(synth).select("nr", key), "nr").select("batch", F.lit("synthetic").alias("origin"), "slot", key)
    return r.unionByName(s)
