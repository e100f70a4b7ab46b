"""Value linking: words of a question <-> values of text columns (K1-K6).

* K1 picklist: unpivot text columns, distinct values
* K2 spans: word n-grams aligned at separator characters
* K3 exact links: equi-join of spans with lower-cased values
* K4 fuzzy links: candidates share a one-deletion key (so only pairs within
  indel distance 2 ever meet -- no pairwise comparison inside a block; spans
  near no value are not cut, and keys of no value, or of no span, are dropped
  by bitmaps before they are shuffled), then
  the indel ratio 1 - d/(len_a + len_b) and the first-letter rule decide
* K5 filters, K6 best k values per (question, column)

The picklist is schema-content sized; it is broadcast only after a row-count
check, otherwise the joins shuffle on the span text (AQE splits hot spans).
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.session import by_key, stored

SEPARATORS = "'\"()`,.?! "
SEP_SPLIT = r"""['"()`,.?! ]+"""
# ---- fixed values: English stop words of the linker ----
STOPWORDS = [
    "who", "ourselves", "down", "only", "were", "him", "at", "weren't", "has", "few", "it's", "m", "again",
    "d", "haven", "been", "other", "we", "an", "own", "doing", "ma", "hers", "all", "haven't", "in", "but",
    "shouldn't", "does", "out", "aren", "you", "you'd", "himself", "isn't", "most", "y", "below", "is",
    "wasn't", "hasn", "them", "wouldn", "against", "this", "about", "there", "don", "that'll", "a", "being",
    "with", "your", "theirs", "its", "any", "why", "now", "during", "weren", "if", "should", "those", "be",
    "they", "o", "t", "of", "or", "me", "i", "some", "her", "do", "will", "yours", "for", "mightn", "nor",
    "needn", "the", "until", "couldn't", "he", "which", "yourself", "to", "needn't", "you're", "because",
    "their", "where", "it", "didn't", "ve", "whom", "should've", "can", "shan't", "on", "had", "have",
    "myself", "am", "don't", "under", "was", "won't", "these", "so", "as", "after", "above", "each", "ours",
    "hadn", "having", "wasn", "s", "doesn", "hadn't", "than", "by", "that", "both", "herself", "his",
    "wouldn't", "into", "doesn't", "before", "my", "won", "more", "are", "through", "same", "how", "what",
    "over", "ll", "yourselves", "up", "mustn", "mustn't", "she's", "re", "such", "didn", "you'll", "shan",
    "when", "you've", "themselves", "mightn't", "she", "from", "isn", "ain", "between", "once", "here",
    "shouldn", "our", "and", "not", "too", "very", "further", "while", "off", "couldn", "hasn't", "itself",
    "then", "did", "just", "aren't",
]
# ---- fixed values: common words and column words of the linker ----
COMMON_WORDS = ["no", "yes", "many"]
COMMON_DB_TERMS = ["id"]


def picklist(tables: dict[str, DataFrame]) -> DataFrame:
    """K1: (table_name, column_name, value) for every distinct value of every text column."""
    out = None
    for name, df in tables.items():
        cols = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
        if not cols:
            continue
        long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value"))
                                             for c in cols])).alias("x"))
        part = long.select(F.lit(name).alias("table_name"), "x.column_name", "x.value") \
            .filter(F.col("value").isNotNull()).distinct()
        out = part if out is None else out.unionByName(part)
    return out


def _words(text_col: str) -> Column:
    return F.filter(F.split(F.lower(F.col(text_col)), SEP_SPLIT), lambda w: w != "")


def span_counts(df: DataFrame, id_col: str, text_col: str, max_n: int) -> DataFrame:
    """(id, n_spans, n_distinct) of the spans of ``spans``: a document's words meet once, its spans never leave their row."""
    x = df.select(id_col, _words(text_col).alias("w")).groupBy(id_col).agg(F.collect_list("w").alias("ws"))

    def of_length(w, n):
        starts = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda s: F.array_join(F.slice(w, s, n), " "))
    lengths = F.sequence(F.lit(1), F.lit(max_n))
    # spans of another number of words differ, for words hold no blank
    per = F.transform(lengths, lambda n: F.flatten(F.transform("ws", lambda w: of_length(w, n))))
    each = F.transform(per, lambda a: F.struct(F.size(a).cast("long").alias("n"), F.size(F.array_distinct(a)).cast("long").alias("d")))
    add = lambda f: F.aggregate("each", F.lit(0).cast("long"), lambda t, e: t + e[f])
    x = x.withColumn("each", each).select(id_col, add("n").alias("n_spans"), add("d").alias("n_distinct"))
    return x.where("n_spans > 0")


def spans(df: DataFrame, id_col: str, text_col: str, max_n: int, near: DataFrame | None = None) -> DataFrame:
    """K2: (id, start, n, span) word n-grams (n <= max_n) of the lower-cased text, split at separators.

    With ``near``, a picklist, spans that no value of it can be linked to (exactly or fuzzily) are left out: by their first letter
    and length before they are cut, then by their one-deletion keys. No span with a link is lost, few others stay.
    """
    if near is not None:
        return _spans_near(df, id_col, text_col, max_n, by_key(_clean_values(near).select("v"), "v").distinct())
    # cut inside the row: exploded words would each carry the whole text's words along
    def of(w):
        at = lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(max_n), F.size(w) - i)),
                                   lambda n: F.struct(i.alias("start"), n.alias("n"), F.array_join(F.slice(w, i + 1, n), " ").alias("span")))
        return F.when(F.size(w) > 0, F.flatten(F.transform(F.sequence(F.lit(0), F.size(w) - 1), at)))
    # the words are a lambda's variable, so that they are computed once
    x = df.select(id_col, F.explode(F.flatten(F.transform(F.array(_words(text_col)), lambda w: F.coalesce(of(w), F.expr("cast(array() as array<struct<start:int,n:int,span:string>>)"))))).alias("s"))
    return x.select(id_col, "s.*")


#: Bits that tell spans from values, in regions by (first letter, length): at most 1,024 broadcast rows of 2 KB.
REGIONS, REGION_BITS = 1 << 10, 1 << 14


def _regions(hashes: DataFrame) -> DataFrame:
    """(region, bits): the bits ``h`` in [0, REGIONS * REGION_BITS) as arrays of longs, one a region; regions without any are left out."""
    every = hashes.sparkSession.range(REGIONS * REGION_BITS // 64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    hit = hashes.select(F.shiftright("h", 6).alias("word"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("bits"))
    words = every.unionByName(hit).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    per = words.groupBy(F.floor(F.col("word") / (REGION_BITS // 64)).alias("region")).agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("ws"))
    return per.select("region", F.transform("ws", lambda w: w["bits"]).alias("bits")).where(F.exists("bits", lambda b: b != 0))


def _bit(h: Column) -> Column:
    at = F.get("bits", F.shiftright(h, 6).cast("int"))
    return F.call_function("shiftright", at, h.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1


def _without(c: Column, i: Column) -> Column:
    """``c`` without its i-th character; whole for 0."""
    return F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c)))


def _ends(c: Column) -> list[Column]:
    """First three and last character of ``c`` and of ``c`` without any one character (and some that belong to none)."""
    heads = [F.substring(c, 1, 3), F.concat(F.substring(c, 1, 2), F.substring(c, 4, 1)), F.concat(F.substring(c, 1, 1), F.substring(c, 3, 2)), F.substring(c, 2, 3)]
    return [F.concat(h, F.substring(c, at, 1)) for h in heads for at in (-1, -2)]


def _spans_near(df: DataFrame, id_col: str, text_col: str, max_n: int, vals: DataFrame) -> DataFrame:
    letter = lambda c: F.substring(F.ltrim(c), 1, 1)
    region = lambda c, n: F.pmod(F.xxhash64(letter(c), n), F.lit(REGIONS))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(REGION_BITS))
    keys = lambda c: F.transform(F.sequence(F.lit(0), F.length(c)), lambda i: place(_without(c, i)))
    # a link has the value's first letter and, with one character deleted in either, a length that differs by one at most
    ls = [F.length("v") + d for d in (-1, 0, 1)]
    around = vals.select("v", F.explode(F.array(*ls)).alias("l"))
    letters = around.groupBy("l").agg(F.array_join(F.array_sort(F.collect_set(letter(F.col("v")))), "").alias("a")).agg(F.map_from_entries(F.collect_list(F.struct("l", "a"))).alias("m"))
    letters = letters.where(F.size("m") > 0).select(F.transform(F.sequence(F.lit(0), F.array_max(F.map_keys("m"))), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(""))).alias("_letters"))
    hashes = vals.select(F.array(*[region(F.col("v"), n) for n in ls]).alias("rs"), F.explode(F.concat(keys(F.col("v")), F.array(*[place(e) for e in _ends(F.col("v"))]))).alias("p"))
    hashes = hashes.select(F.explode("rs").alias("r"), "p")
    regions = _regions(hashes.select((F.col("r") * REGION_BITS + F.col("p")).alias("h")))
    # the words are a generator's output, so that they are computed once and looked up by place
    x = df.select(id_col, F.explode(F.array(_words(text_col))).alias("_w")).where(F.size("_w") > 0).join(F.broadcast(letters))

    def of_length(n):
        def long(i):
            if n > 8:
                return F.aggregate(F.slice("_w", i + 1, F.lit(n)), F.lit(n - 1), lambda t, w: t + F.length(w))
            return sum((F.length(F.get("_w", i + j)) for j in range(1, n)), F.length(F.get("_w", i)) + (n - 1))
        starts = F.when(F.size("_w") >= n, F.sequence(F.lit(0), F.size("_w") - n)).otherwise(F.array().cast("array<int>"))
        some = F.filter(starts, lambda i: F.contains(F.get("_letters", long(i)), F.substring(F.get("_w", i), 1, 1)))
        return F.transform(some, lambda i: F.struct(i.alias("start"), F.lit(n).alias("n"), F.array_join(F.slice("_w", i + 1, F.lit(n)), " ").alias("span")))
    x = x.select(id_col, F.explode(F.concat(*[of_length(n) for n in range(1, max_n + 1)])).alias("s")).select(id_col, "s.*")
    x = x.withColumn("region", region(F.col("span"), F.length("span"))).join(F.broadcast(regions), "region")
    ends = [_bit(place(e)) for e in _ends(F.col("span"))]
    return x.where(reduce(or_, ends)).where(F.exists(keys(F.col("span")), _bit)).select(id_col, "start", "n", "span")


def _clean_values(pl: DataFrame) -> DataFrame:
    v = F.trim(F.lower("value"))
    return pl.withColumn("v", v).filter((F.length("v") > 1) & ~_is_number(F.col("v")) & ~F.col("v").isin(*COMMON_DB_TERMS)
                                        & ~F.col("v").isin(*STOPWORDS))


NUMBER_RE = r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"


def _is_number(c: Column) -> Column:
    return F.regexp_replace(c, ",", "").rlike(NUMBER_RE)


def max_value_words(pl: DataFrame) -> int:
    """Longest value in words (bounds the span n-gram order)."""
    n = pl.select(F.max(F.size(F.split(F.trim(F.col("value")), " +")))).first()[0]
    return int(n or 1)


#: Bits of the filter below, at most 8 MB of broadcast rows.
FILTER_BITS = 1 << 26


def _maybe_among(df: DataFrame, col: str, keys: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose ``col`` may be among ``keys``: none that is gets lost, few others stay."""
    return _by_bitmaps(df, col, keys, key)


def _by_bitmaps(df: DataFrame, col: str, keys: DataFrame, key: str) -> DataFrame:
    """The keys' hashes are bits of broadcast bitmaps, 4 KB each, so rows are dropped where they are made and not shuffled."""
    h = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    bits = keys.select(h(key).alias("h")).groupBy(F.bitmap_bucket_number("h").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("_bits"))
    x = df.withColumn("_h", h(col)).withColumn("_bucket", F.bitmap_bucket_number("_h")).join(F.broadcast(bits), "_bucket")
    at = F.bitmap_bit_position("_h").cast("int")
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    return x.where(F.call_function("shiftright", byte, at.bitwiseAND(7)).bitwiseAND(1) == 1).drop("_h", "_bucket", "_bits")


def link_exact(sp: DataFrame, pl: DataFrame, id_col: str) -> DataFrame:
    """K3 + K5: values equal to a span (score 1); numbers, ``id`` and stop words dropped."""
    vals = _clean_values(pl).select("table_name", "column_name", "value", "v")
    x = _maybe_among(sp.filter(~F.col("span").isin(*STOPWORDS)), "span", vals, "v").join(vals, F.col("span") == F.col("v"))
    return x.select(id_col, "table_name", "column_name", "value", "span", F.lit(1.0).alias("score"),
                    F.length("span").alias("match_len"))


def _deletions(c: Column) -> Column:
    """The string itself and every string with one character removed."""
    return F.array_union(F.array(c), F.transform(F.sequence(F.lit(1), F.length(c)),
                                                 lambda i: F.concat(F.substring(c, 1, i - 1), F.substring(c, i + 1, F.length(c)))))


def link_fuzzy(sp: DataFrame, pl: DataFrame, id_col: str, theta: float = 0.85) -> DataFrame:
    """K4 + K5: indel-ratio matches within two edits, same first letter, ratio >= theta.

    All-caps and common-word values need a perfect score.
    """
    vals = _clean_values(pl)
    lo_hi = vals.agg(F.min(F.length("v")), F.max(F.length("v"))).first()
    lo, hi = (lo_hi[0] or 0) - 1, (lo_hi[1] or 0) + 1
    s = sp.filter((F.length("span") >= lo) & (F.length("span") <= hi) & ~F.col("span").isin(*STOPWORDS))
    # the first letter must agree (see below) and the lengths differ by one at most: few spans come so far
    letter = lambda c: F.substring(F.ltrim(c), 1, 1)
    shapes = vals.select(letter(F.col("v")).alias("a"), F.explode(F.array(*[F.length("v") + d for d in (-1, 0, 1)])).alias("l")).distinct()
    s = s.join(F.broadcast(shapes), (letter(F.col("span")) == F.col("a")) & (F.length("span") == F.col("l")), "left_semi")
    s = s.select(id_col, "start", "n", "span", F.explode(_deletions(F.col("span"))).alias("k"))
    v = vals.select("table_name", "column_name", "value", "v", F.explode(_deletions(F.col("v"))).alias("k"))
    s = stored(_maybe_among(s, "k", v, "k").distinct())
    # as well the other way: few of the values' keys meet a span's, and the rest are not shuffled
    c = s.join(_by_bitmaps(v, "k", s, "k"), "k").drop("k").distinct()
    ls, lv = F.length("span"), F.length("v")
    indel = F.when(F.col("span") == F.col("v"), 0).when(F.abs(ls - lv) == 1, 1).otherwise(2)
    c = c.withColumn("score", F.lit(1.0) - indel / (ls + lv))
    first_ok = F.substring(F.ltrim(F.col("span")), 1, 1) == F.substring(F.ltrim(F.col("v")), 1, 1)
    strict = F.col("v").isin(*COMMON_WORDS) | (F.upper(F.col("value")) == F.col("value"))
    keep = first_ok & (F.col("score") >= theta) & (~strict | (F.col("score") >= 1.0))
    c = c.filter(keep)
    # one best (score, longest span) row per (question, value)
    w = Window.partitionBy(id_col, "table_name", "column_name", "value").orderBy(
        F.col("score").desc(), F.length("span").desc(), F.col("start"))
    c = c.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")
    return c.select(id_col, "table_name", "column_name", "value", "span", "score", F.length("span").alias("match_len"))


def link_top_k(links: DataFrame, id_col: str, k: int = 2) -> DataFrame:
    """K6: best k values per (question, column) by score, match length, then value."""
    w = Window.partitionBy(id_col, "table_name", "column_name").orderBy(
        F.col("score").desc(), F.col("match_len").desc(), F.col("value"))
    return links.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
