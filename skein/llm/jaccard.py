"""Exact similarity join of word-shingle sets (Jaccard of SIMILAR / 100 or more) by a size-aware heavy-light plan.

Copies are collapsed first: one vertex for each different set. Sets are put in one global order of shingles, the
more frequent the later: all shingles of all rows are counted by short hash, and the LISTED most frequent ones are
ordered by their count (the list only orders, so its length cannot change results). Two similar sets share at least c of the first n - t + c shingles of that order, t = ceil(0.8 n):

* a small set (at most ``boundary`` shingles) enumerates the 2-subsets of its first n - t + 2 shingles: small sets
  meet on two shingles at once, which hardly ever happens by accident;
* a large set posts its first n - t + 1 shingles to inverted lists; small sets large enough to be similar to a large
  one post there too. The boundary is the size with the least estimated cost over the histogram of set sizes.

Lists are not expanded into pairs. Each set is first compared with the head of its lists (the set in which the
list's shingle comes earliest). With that all pairs of a list's head are decided, so
lists of two are done; of longer ones only pairs without the head, still in different components, of neighbouring size classes
and within the length and position bounds are compared afterwards; all of them are, so no link between components is lost.
Every comparison is exact on the whole sets.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm import textnum as T
from skein.llm.common import cut, small_batches, texts, unused
from skein.llm.components import components

SHINGLE, SIMILAR = 5, 80
#: Shingles deduplicated together before all are counted, the count that makes one frequent, how many are listed at
#: most, and the bits of the short hashes that are counted (two that meet are ordered alike, no more).
BLOCK, OFTEN, LISTED, SHORT = 1 << 22, 2, 1 << 20, 48
#: Largest set that may count as small, and the cost of a comparison in postings.
MAX_SMALL, COMPARE = 64, 8.0


def sets(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes sorted inside each row, row offsets): distinct 5-word shingles, or the whole short sequence."""
    low = T.lower(data)
    s, e, row = T.words(low, offs)
    n = len(offs) - 1
    own = np.searchsorted(row, np.arange(n + 1))
    wh = T.spans_hash(T.prefix(low), s, e)
    g = T.grams(wh, SHINGLE)
    ok = row[:len(g)] == row[SHINGLE - 1:] if len(g) else np.zeros(0, bool)
    hashes, rows = [g[ok]], [row[:len(g)][ok]]
    size = np.diff(own)
    for k in range(1, SHINGLE):
        short = np.flatnonzero(size == k)
        if len(short):
            hashes.append(T.mix(T.grams(wh, k)[own[short]] + T.U(k)))
            rows.append(short)
    h, r = np.concatenate(hashes), np.concatenate(rows)
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return h[new], np.searchsorted(r[new], np.arange(n + 1))


def _needed(n):
    """Least overlap of a set of n shingles with any similar set."""
    return -(-SIMILAR * n // 100)


def _ranges(spark) -> int:
    """Ranges of short hashes that are counted apart: they follow the session's partition count, as tasks should."""
    return 1 << max(8, (16 * int(spark.conf.get("spark.sql.shuffle.partitions"))).bit_length())


def _statistics(ranges: int):
    """Histogram rows (kind 0: size, sets), the short hashes of each block by range (kind 1), repeats (kind 2, of kind 3)."""
    width = T.U(SHORT - ranges.bit_length() + 1)

    def run(batches):
        held, load, seen = [], 0, np.zeros(0, T.U)
        zip_ = zstandard.ZstdCompressor(level=1)

        def flush():
            h, n = np.unique(np.concatenate(held) >> T.U(64 - SHORT), return_counts=True)
            part, start = np.unique(h >> width, return_index=True)
            z = []
            for one in np.split(h, start[1:]):
                planes = np.diff(one, prepend=T.U(0)).view(np.uint8).reshape(-1, 8).T
                z.append(zip_.compress(np.ascontiguousarray(planes).tobytes()))
            kinds = np.concatenate([np.ones(len(part), np.int32), [2, 3]]).astype(np.int32)
            what = np.concatenate([part.astype(np.int64), [0, 0]])
            count = np.concatenate([np.zeros(len(part), np.int64), [int(n.sum()) - len(h), int(n.sum())]])
            return pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(what), pa.array(count), pa.array([*z, None, None], pa.binary())], ["kind", "what", "n", "z"])

        for batch in batches:
            data, offs = T.buffers(batch.column("text"))
            for i, j in T.chunks(offs):
                h, own = sets(data[offs[i]:offs[j]], offs[i:j + 1] - offs[i])
                size, n = np.unique(np.minimum(np.diff(own), 2 * MAX_SMALL), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(n), np.int32)), pa.array(size.astype(np.int64)), pa.array(n), pa.nulls(len(n), pa.binary())], ["kind", "what", "n", "z"])
                total = np.concatenate([np.zeros(1, T.U), np.cumsum(T.mix(h))])
                sid = total[own[1:]] - total[own[:-1]]
                fresh = np.zeros(len(sid), bool)  # copies count once in a block
                fresh[np.unique(sid, return_index=True)[1]] = True
                fresh &= ~np.isin(sid, seen)
                seen = np.union1d(seen, sid[fresh])
                h = h[np.repeat(fresh, np.diff(own))]
                held.append(h)
                load += len(h)
                if load >= BLOCK:
                    yield flush()
                    held, load, seen = [], 0, np.zeros(0, T.U)
        if load:
            yield flush()
    return run


def _count(batches):
    """Rows of ``_statistics`` sorted by kind and what: those of kind 1 become (short hash, blocks that hold it), from OFTEN on."""
    unzip = zstandard.ZstdDecompressor()
    held, last = [], None

    def flush():
        h, n = np.unique(np.concatenate(held), return_counts=True)
        often = n >= OFTEN
        return pa.RecordBatch.from_arrays([pa.array(np.ones(int(often.sum()), np.int32)), pa.array(T.signed(h[often])), pa.array(n[often])], ["kind", "what", "n"])

    for batch in batches:
        kind = np.asarray(batch.column("kind"))
        plain = batch.filter(pa.array(kind != 1))
        if plain.num_rows:
            yield plain.select(["kind", "what", "n"])
        for k in np.flatnonzero(kind == 1).tolist():
            part = batch.column("what")[k].as_py()
            if held and part != last:
                yield flush()
                held = []
            last = part
            planes = np.frombuffer(unzip.decompress(batch.column("z")[k].as_py()), np.uint8).reshape(8, -1)
            held.append(np.cumsum(np.ascontiguousarray(planes.T).view(T.U).ravel(), dtype=T.U))
    if held:
        yield flush()


def _bundle(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([np.asarray(batch.column(c)).astype(np.int64).tobytes()], pa.binary()) for c in ("what", "n")], ["hashes", "counts"])


def choose_boundary(histogram: dict[int, int], repeats: float) -> int:
    """Largest size that counts as small: least sum of subset keys, postings and expected comparisons."""
    first = lambda n: n - _needed(n) + 1
    post = {n: k * first(n) * (1 + repeats * COMPARE) for n, k in histogram.items() if n > 1}
    pair = {n: k * (first(n) + 1) * first(n) / 2 for n, k in histogram.items() if n > 1}
    cost = lambda b: sum(c for n, c in pair.items() if n <= b) + sum(c for n, c in post.items() if 100 * n >= SIMILAR * (b + 1))
    return min(range(MAX_SMALL + 1), key=lambda b: (cost(b), b))


def _members(batches):
    for batch in batches:
        data, offs = T.buffers(batch.column("text"))
        for i, j in T.chunks(offs):
            h, own = sets(data[offs[i]:offs[j]], offs[i:j + 1] - offs[i])
            n = np.diff(own)
            total = np.concatenate([np.zeros(1, T.U), np.cumsum(T.mix(h))])
            yield pa.RecordBatch.from_arrays([batch.column("rid").slice(i, j - i), batch.column("doc_id").slice(i, j - i), pa.array(n), pa.array(T.signed(T.mix(total[own[1:]] - total[own[:-1]] + n.astype(T.U))))], ["rid", "doc_id", "n", "sid"])


def _postings(frequent: np.ndarray, counts: np.ndarray, boundary: int):
    """Postings of the first shingles in order of (blocks that hold it, hash); ``frequent`` is sorted short hashes."""
    def run(batches):
        for batch in batches:
            data, offs = T.unpack(batch.column("z"))
            rid = np.asarray(batch.column("rid"))
            for i, j in T.chunks(offs):
                h, own = sets(data[offs[i]:offs[j]], offs[i:j + 1] - offs[i])
                if not len(h):
                    continue
                row = np.repeat(np.arange(j - i), np.diff(own))
                h = h[np.lexsort((h, _grade(h, frequent, counts), row))]
                n = np.diff(own)[row]
                rank = np.arange(len(h)) - own[row]
                post = (n > 1) & (100 * n >= SIMILAR * (boundary + 1)) & (rank <= n - _needed(n))
                key, who, at, size = [h[post]], [row[post]], [rank[post]], [n[post]]
                for k in np.flatnonzero((np.diff(own) > 1) & (np.diff(own) <= boundary)):
                    m = int(own[k + 1] - own[k])
                    first = h[own[k]:own[k] + min(m, m - _needed(m) + 2)]
                    two = np.array(list(combinations(range(len(first)), 2)))
                    key.append(T.grams(np.stack([first[two[:, 0]], first[two[:, 1]]], 1).ravel(), 2)[::2])
                    who.append(np.full(len(two), k))
                    at.append(np.full(len(two), -1))
                    size.append(np.full(len(two), m))
                yield pa.RecordBatch.from_arrays([pa.array(T.signed(np.concatenate(key))), pa.array(rid[i:j][np.concatenate(who)]), pa.array(np.concatenate(at).astype(np.int32)), pa.array(np.concatenate(size).astype(np.int32))], ["key", "v", "at", "n"])
    return run


def _grade(h: np.ndarray, frequent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Count of each shingle in the list of frequent ones; 0 for those outside it."""
    if not len(frequent):
        return np.zeros(len(h), np.int64)
    short = h >> T.U(64 - SHORT)
    at = np.minimum(np.searchsorted(frequent, short), len(frequent) - 1)
    return np.where(frequent[at] == short, counts[at], 0)


def _compare(batches):
    """Pairs (a, za, b, zb) sorted by a: those that are similar."""
    last, known = None, None
    for batch in batches:
        good_a, good_b = [], []
        a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
        da, oa = T.unpack(batch.column("za"))
        db, ob = T.unpack(batch.column("zb"))
        for k in range(len(a)):
            if a[k] != last:
                known = sets(da[oa[k]:oa[k + 1]], np.array([0, oa[k + 1] - oa[k]]))[0]
                last = a[k]
            other = sets(db[ob[k]:ob[k + 1]], np.array([0, ob[k + 1] - ob[k]]))[0]
            both = len(np.intersect1d(known, other, assume_unique=True))
            if 100 * both >= SIMILAR * (len(known) + len(other) - both):
                good_a.append(a[k])
                good_b.append(b[k])
        yield pa.RecordBatch.from_arrays([pa.array(good_a, pa.int64()), pa.array(good_b, pa.int64())], ["a", "b"])


def _similar(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    """The pairs (a, b) of vertices whose sets are similar."""
    z = bodies.select(F.col("rid"), F.col("z"))
    one = pairs.join(z, F.col("b") == F.col("rid")).select("a", "b", F.col("z").alias("zb"))
    two = one.join(z, F.col("a") == F.col("rid")).select("a", F.col("z").alias("za"), "b", "zb")
    return two.sortWithinPartitions("a").mapInArrow(_compare, "a long, b long")


def _bound(na, nb, ata=None, atb=None):
    """Length bound, and for a shingle at known ranks the position bound, of a pair.

    The position bound takes the shingle for the first one in common: a pair also meets on its first one, and
    there the bound holds, so no similar pair is lost.
    """
    ok = (F.least(na, nb) * 100 >= F.greatest(na, nb) * SIMILAR)
    if ata is None:
        return ok
    most = F.least(na - ata, nb - atb)
    return ok & ((ata < 0) | (most * (100 + SIMILAR) >= (na + nb) * SIMILAR))


def _band(n):
    """Class of a set's size; sizes of similar sets differ by a factor of at most 1.25, so by at most one class (1.26 leaves room for rounding)."""
    return F.floor(F.log(n.cast("double")) / F.lit(float(np.log(1.26)))).cast("int")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(rid, doc_id, n_shingles, component_id) of every row.

    Lower-cases A-Z; words are runs outside [\\x20\\x09-\\x0D]. Null, empty and blank texts have no shingle and are
    linked with nothing. component_id is the smallest doc_id of the component; rows without doc_id count as members
    but not for the smallest (null if there is no other). Repeated rows get equal results.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = texts(docs, id_col, text_col)
    counted = rows.select("text").mapInArrow(_statistics(_ranges(spark)), "kind int, what long, n long, z binary")
    counted = counted.repartition("kind", "what").sortWithinPartitions("kind", "what").mapInArrow(_count, "kind int, what long, n long")
    stats = cut(counted, "shingles")
    histogram = {r.what: r.n for r in stats.where("kind = 0").groupBy("what").agg(F.sum("n").alias("n")).collect()}  # at most 2 * MAX_SMALL + 1 rows
    again, total = (stats.where(F.col("kind") == k).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for k in (2, 3))
    often = stats.where("kind = 1").orderBy(F.desc("n"), "what").limit(LISTED).select("what", "n").mapInArrow(_bundle, "hashes binary, counts binary").collect()
    frequent = np.frombuffer(b"".join(r.hashes for r in often), T.U)  # at most 16 bytes x LISTED, with the counts
    counts = np.frombuffer(b"".join(r.counts for r in often), np.int64)
    frequent, counts = frequent[np.argsort(frequent)], counts[np.argsort(frequent)]
    boundary = choose_boundary(histogram, again / max(1, total))

    bodies = rows.mapInArrow(T.pack, "rid long, doc_id long, z binary").where("rid is not null").dropDuplicates(["rid"])
    members = cut(rows.mapInArrow(_members, "rid long, doc_id long, n long, sid long"), "members")
    vertices = members.where("n > 0").groupBy("sid", "n").agg(F.min("rid").alias("v"))
    posted = bodies.join(vertices.select("v"), F.col("rid") == F.col("v"), "left_semi").mapInArrow(_postings(frequent, counts, boundary), "key long, v long, at int, n int")
    w = Window.partitionBy("key")
    lists = posted.repartition("key").select("*", F.count("*").over(w).alias("size"), F.min(F.struct((F.col("at") / F.col("n")).alias("early"), "v", "n", "at")).over(w).alias("head")).where("size > 1").select("key", "v", "at", "n", "size", "head")
    lists = cut(lists, "lists")

    first = lists.where((F.col("v") != F.col("head.v")) & _bound(F.col("n"), F.col("head.n"), F.col("at"), F.col("head.at")))
    first = cut(first.select(F.col("head.v").alias("a"), F.col("v").alias("b")).distinct(), "pairs")
    links = cut(_similar(first, bodies), "links")
    roots = components(links)

    # pairs of a list without its head (all of whose pairs are decided) that are still in different components
    tagged = lists.where((F.col("size") > 2) & (F.col("v") != F.col("head.v"))).select("key", "v", "at", "n").join(roots, "v", "left").select("key", "v", "at", "n", F.coalesce("root", "v").alias("root"))
    open_ = tagged.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    left = tagged.join(open_, "key", "left_semi").withColumn("band", _band(F.col("n")))
    x, y = (left.select("key", "band", *(F.col(c).alias(f"{c}_{s}") for c in ("v", "at", "n", "root"))) for s in "xy")
    x = x.withColumn("band", F.explode(F.array(F.col("band"), F.col("band") + 1)))  # the smaller set meets its own band and the next
    later = (F.col("n_x") < F.col("n_y")) | ((F.col("n_x") == F.col("n_y")) & (F.col("v_x") < F.col("v_y")))
    rest = x.join(y, ["key", "band"]).where(later & (F.col("root_x") != F.col("root_y")) & _bound(F.col("n_x"), F.col("n_y"), F.col("at_x"), F.col("at_y")))
    rest = rest.select(F.least("v_x", "v_y").alias("a"), F.greatest("v_x", "v_y").alias("b")).distinct()
    tried = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = cut(_similar(rest.join(tried, ["a", "b"], "left_anti"), bodies), "links")
    if more.limit(1).count():
        roots = components(links.union(more))

    named = members.join(vertices, ["sid", "n"], "left").join(roots, "v", "left").select("rid", "doc_id", "n", F.coalesce("root", "v").alias("root"))
    least = named.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"))
    return named.join(least, "root", "left").select("rid", "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, all columns as they are, that stand for their component: the one of the smallest doc_id.

    Rows without shingles are linked with nothing and stay, and so do rows of components without any doc_id. Of
    several rows with the smallest doc_id one text stays, once.
    """
    found = cut(near_duplicates(docs, id_col, text_col).where("n_shingles > 0 and component_id is not null"), "groups")
    best = found.where("doc_id = component_id").groupBy("component_id").agg(F.min("rid").alias("best"), F.count("*").alias("rows"))
    rid, state = unused(docs, "rid"), unused(docs, "state")
    decided = found.select("rid", "component_id").distinct().join(best, "component_id").select(F.col("rid").alias(rid), F.when(F.col("rid") != F.col("best"), "drop").when(F.col("rows") > 1, "once").alias(state)).where(F.col(state).isNotNull())
    key = F.xxhash64(docs[id_col].cast("long"), F.coalesce(docs[text_col].cast("string"), F.lit("")))
    out = docs.join(decided, key == F.col(rid), "left")
    once = out.where(F.col(state) == "once").dropDuplicates([rid])
    return out.where(F.col(state).isNull()).unionByName(once).select(*docs.columns)
