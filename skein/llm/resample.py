"""Target-distribution importance resampling: hashed word runs, array-scored weights, a bracketed cutoff.

Every text is a bag of features (runs of consecutive words). A feature's bucket has a gain: how much likelier the bucket
is in the target texts than in the corpus, in thousandths of a nat. A document's weight is the sum of its features'
gains; with Gumbel noise that depends on doc_id alone, the highest scores are a draw without replacement in
proportion to the weights.

* Counts of buckets: numpy counts in tasks, one row per bucket and task, summed by Spark; the result is one array of
  ``buckets`` numbers for the corpus and one for the target (80 KB each at 10,000 buckets, whatever the input).
* Scores: one pass over the texts against the array of gains.
* Cutoff: ``percentile_approx`` over the scores brackets the k-th highest. Exact counts of the rows above and inside
  the bracket validate it, else it is widened; only its rows are dealt by range, counted and, in the one range that
  holds the k-th row, sorted.
* Ranks: the drawn rows are dealt by range; a row's rank is its number inside its range plus the rows before.

Defined cases: null and empty texts have no feature and weight 0; a null doc_id draws its noise from ``seed:`` and
comes last among ties; repeated rows count and are drawn each; empty tables give empty results, and without target
texts all buckets count alike; other columns of the input, whatever their names, are left behind. Texts of any length
are read in slices that end between words.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import cut, small_batches

#: Bytes of a word: all but ASCII bytes that are neither digits nor lower-case letters (texts are lower-cased before).
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
GAP = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
#: Bytes of text that are split into words at once, and words whose buckets a worker remembers.
SLICE, REMEMBERED = 1 << 20, 1 << 16
#: First half-width of the bracket as a share of the rows; it is a matter of cost, since counts validate it.
WIDTH = 1 / 1000


class _Buckets(dict):
    """Feature bytes to bucket, remembered."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[feature] = zlib.crc32(feature) % self.buckets
        return found


def slices(text: bytes):
    """Parts of at most about SLICE bytes that end before a byte that belongs to no word."""
    at = 0
    while len(text) - at > SLICE:
        gap = GAP.search(text, at + SLICE)
        if not gap:
            break
        yield text[at:gap.start()]
        at = gap.start()
    yield text[at:]


def feature_buckets(text: bytes, longest: int, bucket: _Buckets):
    """Arrays of the buckets of all features of a text (UTF-8), and its number of words with each array.

    Runs that cross a border of slices are counted with the later slice, by the last words of the slice before.
    """
    last: list[bytes] = []
    for part in slices(text.lower()):
        words = WORD.findall(part)
        joined = last + words
        found = [bucket[w] for w in words]
        for run in range(2, longest + 1):
            first = max(0, len(last) - run + 1)
            found += [bucket[b" ".join(joined[i:i + run])] for i in range(first, len(joined) - run + 1)]
        last = joined[-(longest - 1):] if longest > 1 else []
        yield np.array(found, dtype=np.int64), len(words)


def _column(batch: pa.RecordBatch, name: str):
    return batch.column(name).cast(pa.binary())


def bucket_counts(df: DataFrame, buckets: int, longest: int = 1, text_col: str = "text") -> np.ndarray:
    """Features of all texts by bucket; tasks count in an array, Spark sums the arrays' rows."""

    def count(batches):
        bucket, total = _Buckets(buckets), np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for text in _column(batch, "text"):
                for found, _ in feature_buckets(text.as_py() or b"", longest, bucket):
                    total += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    small_batches(df.sparkSession)
    rows = df.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "bucket long, n long")
    out = np.zeros(buckets, dtype=np.int64)
    for bucket, n in rows.groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the smoothed share in the target over that in the corpus, by bucket."""
    size = len(corpus)
    of_target = (target + 1).astype(float) * float(corpus.sum() + size)
    of_corpus = (corpus + 1).astype(float) * float(target.sum() + size)
    return np.floor(1000 * np.log(of_target / of_corpus)).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, longest: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight of every row."""
    buckets = len(gain)

    def score(batches):
        bucket = _Buckets(buckets)
        for batch in batches:
            n_words, n_features, weight = [], [], []
            for text in _column(batch, "text"):
                words = features = total = 0
                for found, n in feature_buckets(text.as_py() or b"", longest, bucket):
                    words, features, total = words + n, features + len(found), total + int(gain[found].sum())
                n_words.append(words)
                n_features.append(features)
                weight.append(total)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_features, pa.int64()), pa.array(weight, pa.int64())], names=["doc_id", "n_words", "n_features", "weight"])

    small_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return base.mapInArrow(score, "doc_id long, n_words long, n_features long, weight long")


def noisy(weighed: DataFrame, seed: int) -> DataFrame:
    """Adds ``score``: weight plus Gumbel noise in thousandths, drawn from sha256 of ``seed:doc_id``."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    return weighed.withColumn("score", F.col("weight") + noise)


#: The order of a draw: highest score first, ties to the smaller doc_id (null last), then by features and row.
def _order():
    return [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features").asc(), F.col("row").asc()]


def _ranged(rows: DataFrame, label: str) -> tuple[DataFrame, dict[int, int]]:
    """``rows`` dealt by range of the draw's order, with the range's number, and the rows of each range."""
    dealt = cut(rows.repartitionByRange(*_order()).withColumn("part", F.spark_partition_id()), label)
    return dealt, dict(dealt.groupBy("part").count().collect())


def bracket(rows: DataFrame, wanted: int, total: int) -> tuple[int, int, int]:
    """(low, high, above): exactly ``above`` < ``wanted`` scores lie over high, and at least ``wanted`` at low or over."""
    width = WIDTH
    while True:
        at = 1 - (wanted - 0.5) / total
        accuracy = int(min(4 / width, 1_000_000))
        low, high = rows.agg(F.percentile_approx("score", F.array(F.lit(max(0.0, at - width)), F.lit(min(1.0, at + width))), accuracy)).first()[0]
        above, reached = rows.agg(F.count_if(F.col("score") > high), F.count_if(F.col("score") >= low)).first()
        if above < wanted <= reached:
            return low, high, above
        if width >= 1:  # the sketch's ends may lie inside the values: take all
            low, high = rows.agg(F.min("score"), F.max("score")).first()
            return low, high, 0
        width *= 8


def cutoff(rows: DataFrame, wanted: int, total: int):
    """The ``wanted``-th row in the draw's order (score, doc_id, n_features, row)."""
    low, high, above = bracket(rows, wanted, total)
    inside, sizes = _ranged(rows.where(F.col("score").between(low, high)), "resample-bracket")
    left = wanted - above
    for part in sorted(sizes):
        if left <= sizes[part]:
            break
        left -= sizes[part]
    numbered = inside.where(F.col("part") == part).withColumn("number", F.row_number().over(Window.partitionBy("part").orderBy(*_order())))
    return numbered.where(F.col("number") == left).select("score", "doc_id", "n_features", "row").first()


def draw(scored: DataFrame, share: float, least_words: int) -> DataFrame:
    """Adds ``rank`` (from 1 in the draw's order, null if undrawn): floor(share of the rows with enough words)."""
    spark = scored.sparkSession
    scored = cut(scored.withColumn("row", F.monotonically_increasing_id()), "resample-scored")
    fit = scored.where(F.col("n_words") >= least_words)
    total = fit.count()
    wanted = int(np.floor(share * total / 100))
    if not wanted:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    last = cutoff(fit, wanted, total)
    tie = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "n_features", "row")
    at = F.struct(F.lit(last["doc_id"] is None).alias("none"), F.lit(last["doc_id"]).cast("long").alias("doc_id"), F.lit(last["n_features"]).cast("long").alias("n_features"), F.lit(last["row"]).cast("long").alias("row"))
    chosen = (F.col("n_words") >= least_words) & ((F.col("score") > last["score"]) | ((F.col("score") == last["score"]) & (tie <= at)))
    drawn, sizes = _ranged(scored.where(chosen), "resample-drawn")
    before, starts = 0, []
    for part in sorted(sizes):
        starts.append((part, before))
        before += sizes[part]
    offsets = F.broadcast(spark.createDataFrame(starts, "part int, before long"))  # a row per range, as many as shuffle partitions
    number = F.row_number().over(Window.partitionBy("part").orderBy(*_order())).cast("long")
    ranked = drawn.withColumn("number", number).join(offsets, "part").withColumn("rank", F.col("number") + F.col("before"))
    return ranked.select(*scored.columns, "rank").union(scored.where(~chosen).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, share: float = 10, least_words: int = 20, buckets: int = 10_000, longest: int = 1, seed: int = 2024) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, row, rank: ``share`` percent of the rows of at least ``least_words`` words,
    drawn towards the texts of ``target``."""
    gain = gains(bucket_counts(docs, buckets, longest), bucket_counts(target, buckets, longest))
    return draw(noisy(weigh(docs, gain, longest), seed), share, least_words)


#: The query's rows in DuckDB: crc32 by the bitwise rule over the bytes of each distinct word.
ORACLE = r"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
aim AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
ids AS (SELECT row_number() OVER () AS r, doc_id, words FROM split),
lone AS (SELECT r, unnest(words) AS word FROM ids),
byte AS (SELECT i, list_reduce([i] || list_transform(range(8), lambda x: 0), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS rest FROM (SELECT unnest(range(256)) AS i)),
rests AS (SELECT list(rest ORDER BY i) AS t FROM byte),
vocabulary AS (SELECT DISTINCT word FROM (SELECT word FROM lone UNION ALL SELECT word FROM aim)),
hexed AS (SELECT word, hex(encode(word)) AS h FROM vocabulary),
hashed AS (
  SELECT word, xor(list_reduce([4294967295] || list_transform(range(CAST(length(h) // 2 AS BIGINT)), lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)),
         lambda c, b: xor(c // 256, t[CAST(xor(c, b) & 255 AS BIGINT) + 1])), 4294967295) % 10000 AS bucket FROM hexed, rests),
s AS (SELECT bucket, count(*) AS n FROM lone JOIN hashed USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM aim JOIN hashed USING (word) GROUP BY bucket),
sums AS (SELECT coalesce((SELECT sum(n) FROM s), 0) AS s_all, coalesce((SELECT sum(n) FROM t), 0) AS t_all),
gain AS (
  SELECT s.bucket, floor(1000 * ln((CAST(coalesce(t.n, 0) + 1 AS DOUBLE) * CAST(s_all + 10000 AS DOUBLE)) / (CAST(s.n + 1 AS DOUBLE) * CAST(t_all + 10000 AS DOUBLE)))) AS g
  FROM s LEFT JOIN t ON s.bucket = t.bucket, sums),
sums_of AS (SELECT r, count(*) AS n_features, CAST(sum(g) AS BIGINT) AS weight FROM lone JOIN hashed USING (word) JOIN gain USING (bucket) GROUP BY r),
scored AS (
  SELECT doc_id, len(words) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS DOUBLE) + 0.5) / 4294967296))) AS BIGINT) AS score
  FROM ids LEFT JOIN sums_of ON ids.r = sums_of.r),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place, sum(CAST(n_words >= 20 AS BIGINT)) OVER () AS fit FROM scored)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN n_words >= 20 AND place <= floor(10 * fit / 100) THEN place END AS rank FROM placed
"""
