"""Windows that repeat across documents: the part that word-level and byte-level substring dedup share.

Every window of ``window`` consecutive symbols (words or bytes) has one minimiser, the gram of least hash in it;
equal windows have equal minimisers at equal places. Runs of windows with one minimiser form a segment whose key
is the gram's hash. So:

1. segments of all documents meet by key, as numbers only (key, content id, document, place): one shuffle. A key
   of one document says nothing; a key with one content is answered by the first place of that content (unless a window stands
   twice in that content and places inside a document count);
2. only keys with several contents need the symbols: they return to their documents and come back as (key, content)
   rows, where equal contents of a chunk are merged before the shuffle and carry their first place;
3. rows with one key meet in one partition, sorted, and an engine finds for each window its first place among
   all of them, in blocks of whole keys. A key with more segments than a block holds is dealt out by content
   instead, and its windows meet by their own hashes, in aggregations that merge before the shuffle;
4. the runs found return to every occurrence by (key, content id), a join that adaptive execution may split, and
   the ranges to remove are collected per document (bounded by the document itself).

Exact copies of an earlier document are settled by one aggregation over text digests and ship no segment.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm import textnum as T
from skein.llm.common import small_batches

#: An engine gets distinct contents of whole keys with the first place of each, and returns the runs of first places
#: as arrays (content, first window, last window, doc_id, place of the window that opens the run), content ascending.
Engine = Callable[[list[bytes], np.ndarray, np.ndarray], tuple[np.ndarray, ...]]


#: Range splitters go to every task; more tasks than this share a range.
SPLITS = 256


@dataclass(frozen=True)
class Repeats:
    """Settings of one kind of window.

    unit: 'word' or 'byte'; window: symbols of a window; gram: symbols of a minimiser gram;
    within: whether an earlier place of the same document counts; block: symbols given to the engine at once;
    ranged: deal keys out by range splitters, quantiles of the wanted keys, instead of by hash.
    Keys with more than ``limit`` segments are not given to the engine.
    """

    unit: str
    window: int
    gram: int
    within: bool
    block: int
    engine: Engine
    ranged: bool = False

    @property
    def limit(self) -> int:
        return self.block // (2 * self.window)

    def symbols(self, data: np.ndarray, offs: np.ndarray):
        """Segments of a chunk: (first window, last window, key, row, loop), word spans and row offsets in symbols."""
        if self.unit == "byte":
            g = T.byte_grams(data, self.gram)
            a, b, at, row, loop = T.segments(offs, g, self.gram, self.window)
            return a, b, g[at] if len(at) else np.zeros(0, T.U), row, loop, None, offs
        s, e, r = T.words(data, offs)
        g = T.grams(T.spans_hash(T.prefix(data), s, e), self.gram)
        own = np.searchsorted(r, np.arange(len(offs)))
        a, b, at, row, loop = T.segments(own, g, self.gram, self.window)
        return a, b, g[at] if len(at) else np.zeros(0, T.U), row, loop, (s, e), own


def _content_ids(cfg: Repeats, d, a, b, spans):
    """Byte range and 64-bit digest of each segment's symbols."""
    if spans is None:
        return a, b + cfg.window, T.spans_hash(T.prefix(d), a, b + cfg.window)
    wh = T.spans_hash(T.prefix(d), *spans)
    up, down = T.powers(len(wh) + 1)
    pre = np.concatenate([np.zeros(1, T.U), np.cumsum(wh * up[:len(wh)])])
    return spans[0][a], spans[1][b + cfg.window - 1], T.mix((pre[b + cfg.window] - pre[a]) * down[a] + (b - a).astype(T.U))


def _places(cfg: Repeats) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One row for each segment of each document: key, content id, document, and as one number the first window (low
    32 bits) and twice the windows after it, plus one where a window may stand twice in it (high bits)."""
    def run(batches):
        for batch in batches:
            data, offs = T.unpack(batch.column("z"))
            rid, ids = np.asarray(batch.column("rid")), batch.column("doc_id")
            doc, named = np.asarray(pc.fill_null(ids, 0)), np.asarray(pc.is_valid(ids))
            for i, j in T.chunks(offs):
                d = data[offs[i]:offs[j]]
                a, b, key, row, loop, spans, own = cfg.symbols(d, offs[i:j + 1] - offs[i])
                ok = named[i:j][row]
                a, b, key, row, loop = a[ok], b[ok], key[ok], row[ok], loop[ok]
                if len(a):
                    cid = _content_ids(cfg, d, a, b, spans)[2]
                    yield pa.RecordBatch.from_arrays([pa.array(T.signed(key)), pa.array(T.signed(cid)), pa.array(rid[i:j][row]), pa.array(doc[i:j][row]), pa.array((2 * (b - a) + loop) << 32 | (a - own[row]))], ["key", "cid", "rid", "doc_id", "run"])
    return run


def _contents(cfg: Repeats) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Segments with the given keys: one row for each content of a chunk, with its first place and how often it stands there.

    salt: 0, but under hot keys a number of the content. part: place among the ``splits`` (high bits, under hot keys any
    that follows from the salt) and a hash to deal out the rows of one range.
    """
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            if cfg.ranged:
                parts = np.asarray(batch.column("splits")[0].values)
            data, offs = T.unpack(batch.column("z"))
            doc = np.asarray(batch.column("doc_id"))
            (koff, kval), (hoff, hval) = ((np.asarray(c.offsets), np.asarray(c.values).view(T.U)) for c in (batch.column("keys"), batch.column("hot_keys")))
            for i, j in T.chunks(offs):
                d = data[offs[i]:offs[j]]
                a, b, key, row, _, spans, own = cfg.symbols(d, offs[i:j + 1] - offs[i])
                wanted = np.unique(kval[koff[i]:koff[j]])
                if not len(a) or not len(wanted):
                    continue
                hit = wanted[np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)] == key
                a, b, key, row = a[hit], b[hit], key[hit], row[hit]
                if not len(a):
                    continue
                lo, hi, cid = _content_ids(cfg, d, a, b, spans)
                place, ids = a - own[row], doc[i:j][row]
                order = np.lexsort((place, ids, cid, key))
                k, c = key[order], cid[order]
                new = np.ones(len(k), bool)
                new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
                pick = order[new]
                times = np.diff(np.append(np.flatnonzero(new), len(k)))
                salt = np.where(np.isin(key[pick], hval[hoff[i]:hoff[j]]), cid[pick] | T.U(1), T.U(0))
                raw = d.tobytes()
                cut = [raw[x:y] for x, y in zip(lo[pick].tolist(), hi[pick].tolist(), strict=True)]
                if spans is not None:
                    cut = [b" ".join(x.split()) for x in cut]
                columns = [pa.array(T.signed(key[pick])), pa.array(T.signed(salt)), pa.array(T.signed(cid[pick])), pa.array(ids[pick]), pa.array(place[pick]), pa.array(times), pa.array(cut, pa.binary())]
                names = ["key", "salt", "cid", "doc_id", "place", "times", "content"]
                if cfg.ranged:
                    # past the splitters' own number, a range's keys are dealt on by hash; hot keys go by content
                    number = np.where(salt == 0, np.searchsorted(parts, T.signed(key[pick])), (salt >> T.U(32)) % T.U(len(parts) + 1)).astype(np.int64)
                    columns.append(pa.array(number << 32 | (np.where(salt == 0, key[pick], salt) >> T.U(8) & T.U(0x7FFFFFFF)).astype(np.int64)))
                    names.append("part")
                yield pa.RecordBatch.from_arrays(columns, names)
    return run


_RUNS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("doc", pa.int64()), ("at", pa.int64())]))


def _first_places(cfg: Repeats) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows sorted by (key, cid, doc_id, place): merge equal contents, give blocks of whole keys to the engine.

    A run that a content opens itself says nothing where that content stands nowhere else, and is left out.
    """
    def sizes(rows):
        text = rows.column("content")
        return np.asarray(pc.binary_length(text) if cfg.unit == "byte" else pc.count_substring(text, " "), np.int64) + (cfg.unit == "word")

    def answer(rows):
        key, cid = np.asarray(rows.column("key")), np.asarray(rows.column("cid"))
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (cid[1:] != cid[:-1])
        f = np.flatnonzero(new)
        times = np.add.reduceat(np.asarray(rows.column("times")), f)
        docs, places = np.asarray(rows.column("doc_id"))[f], np.asarray(rows.column("place"))[f]
        own, a, b, doc, at = cfg.engine(rows.column("content").take(pa.array(f)).to_pylist(), docs, places)
        use = (times[own] > 1) | (doc < docs[own]) | (at < places[own] + a if cfg.within else False)
        own, a, b, doc, at = own[use], a[use], b[use], doc[use], at[use]
        if not len(own):
            return
        runs = pa.StructArray.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(doc), pa.array(at)], fields=list(_RUNS.value_type))
        head = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        lists = pa.ListArray.from_arrays(pa.array(np.append(head, len(own)).astype(np.int32)), runs)
        yield pa.RecordBatch.from_arrays([pa.array(key[f][own[head]]), pa.array(cid[f][own[head]]), lists], ["key", "cid", "runs"])

    def run(batches):
        held, load = [], 0
        for batch in batches:
            batch = batch.filter(pc.equal(batch.column("salt"), 0))
            if not batch.num_rows:
                continue
            held.append(batch)
            load += sizes(batch).sum()
            if load <= cfg.block:
                continue
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            key, upto, done = np.asarray(rows.column("key")), np.append(0, np.cumsum(sizes(rows))), 0
            for i in (np.flatnonzero(key[1:] != key[:-1]) + 1).tolist():
                if upto[i] - upto[done] > cfg.block:
                    yield from answer(rows.slice(done, i - done))
                    done = i
            held, load = [rows.slice(done)], upto[-1] - upto[done]
        if held:
            yield from answer(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
    return run


def _windows(cfg: Repeats) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of hot keys, sorted as for ``_first_places``: one row for each window of each content, with its first place there."""
    def run(batches):
        last = None
        for batch in batches:
            batch = batch.filter(pc.not_equal(batch.column("salt"), 0))
            if not batch.num_rows:
                continue
            key, cid = np.asarray(batch.column("key")), np.asarray(batch.column("cid"))
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (cid[1:] != cid[:-1])
            new[0] = (key[0], cid[0]) != last
            last = key[-1], cid[-1]
            batch = batch.filter(pa.array(new))
            data, offs = T.buffers(batch.column("content"))
            for i, j in T.chunks(offs):
                d, o = data[offs[i]:offs[j]], offs[i:j + 1] - offs[i]
                if cfg.unit == "byte":
                    begin, n = o[:-1], np.diff(o)
                else:
                    s, e, r = T.words(d, o)
                    begin = np.searchsorted(r, np.arange(j - i))
                    n = np.bincount(r, minlength=j - i)
                count = n - cfg.window + 1
                row = np.repeat(np.arange(j - i), count)
                off = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                at = begin[row] + off
                h = T.spans_hash(T.prefix(d), at, at + cfg.window) if cfg.unit == "byte" else T.grams(T.spans_hash(T.prefix(d), s, e), cfg.window)[at]
                own = batch.select(["key", "cid", "doc_id", "place"]).slice(i, j - i).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([own.column("key"), own.column("cid"), pa.array(T.signed(h)), pa.array(off.astype(np.int32)), own.column("doc_id"), pc.add(own.column("place"), pa.array(off))], ["key", "cid", "hash", "off", "doc_id", "at"])
    return run


def packed(rows: DataFrame) -> DataFrame:
    """``texts()`` rows with compressed text, for the shuffle that brings texts and their repeated keys together."""
    return rows.mapInArrow(T.pack, "rid long, doc_id long, z binary").where("rid is not null")


def removed_ranges(rows: DataFrame, bodies: DataFrame, cfg: Repeats) -> DataFrame:
    """(rid, doc_id, copy, ranges): what to remove from each row of ``texts()`` that repeats something earlier.

    bodies: the same rows, ``packed``.

    copy: the text also stands under a smaller doc_id, so every window of it goes. ranges: first and last window
    to remove, as structs (a, b) in symbols from the document's start. Rows without either are left out.
    Rows with a null doc_id neither remove nor are compared.
    """
    small_batches(rows.sparkSession)
    digests = rows.where(F.col("doc_id").isNotNull()).select("rid", "doc_id", F.unhex(F.sha2("text", 256)).alias("sha"))
    first = digests.groupBy("sha").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n")).where("n > 1")
    copies = digests.join(first, "sha").where("doc_id > first_doc").select("rid", "doc_id").distinct().withColumn("copy", F.lit(True))

    # Uses of ``bodies`` share one exchange of the texts, uses of ``seen`` share one of the segments: the null filters
    # that joins would add stand below the exchanges already, and every use of ``seen`` needs all its columns (see
    # the filter), so that none is pruned from one exchange and not another.
    live = bodies.join(copies.select("rid", "copy"), "rid", "left").where("copy is null")
    seen = live.select("rid", "doc_id", "z").mapInArrow(_places(cfg), "key long, cid long, rid long, doc_id long, run long").where("key is not null").repartition("key")
    seen = seen.select("key", "cid", "rid", "doc_id", "run", F.col("run").bitwiseAND(0xFFFFFFFF).alias("place"), F.shiftright("run", 32).alias("span"))
    w = Window.partitionBy("key")
    again = (F.col("n") > 1) | (F.col("span") % 2 == 1) if cfg.within else F.col("hi_doc") > F.col("lo_doc")
    several = (F.col("lo") != F.col("hi")) | (F.col("span") % 2 == 1 if cfg.within else F.lit(False))
    seen = seen.select("*", F.min("cid").over(w).alias("lo"), F.max("cid").over(w).alias("hi"), F.count("*").over(w).alias("n"), F.min("doc_id").over(w).alias("lo_doc"), F.max("doc_id").over(w).alias("hi_doc"), F.min(F.struct("doc_id", "place")).over(w).alias("f"))
    seen = seen.where(again & F.col("rid").isNotNull() & (F.col("run") >= 0) & F.col("lo_doc").isNotNull() & F.col("cid").isNotNull())

    # One content under a key: its first place answers for all its windows.
    before = (F.col("f.doc_id") < F.col("doc_id")) | ((F.col("f.doc_id") == F.col("doc_id")) & (F.col("f.place") < F.col("place")) if cfg.within else F.lit(False))
    plain = seen.where(~several & before).select("rid", "doc_id", F.col("place").alias("a"), (F.col("place") + F.shiftright("span", 1)).alias("b"))

    # Several contents: they meet in one place and an engine compares their windows, or each window meets its equals.
    mixed = seen.where(several).select("key", "cid", "rid", "doc_id", F.col("place").cast("long").alias("place"), (F.col("n") > cfg.limit).alias("hot"))
    wanted = mixed.groupBy("rid").agg(F.collect_set("key").alias("keys"), F.collect_set(F.when(F.col("hot"), F.col("key"))).alias("hot_keys"))
    named, kind = ["rid", "doc_id", "z", "keys", "hot_keys"], "key long, salt long, cid long, doc_id long, place long, times long, content binary"
    at = bodies.join(wanted, "rid")
    if cfg.ranged:
        # Quantiles of the wanted keys: a range shuffle would draw its sample by cutting the contents out one time more.
        n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
        ranges, each = min(n, SPLITS), -(-n // SPLITS)
        keys = wanted.select(F.explode(F.concat("keys", "hot_keys")).alias("key"))
        splits = keys.agg(F.percentile_approx("key", [i / ranges for i in range(1, ranges)] or [0.5], 10_000).alias("splits"))
        at, named, kind = at.crossJoin(F.broadcast(splits)), [*named, "splits"], kind + ", part long"
    contents = at.select(*named).mapInArrow(_contents(cfg), kind)
    dealt = (contents.repartitionById((ranges + 1) * each, (F.shiftright("part", 32) * each + F.col("part").bitwiseAND(0x7FFFFFFF) % each).cast("int")) if cfg.ranged else contents.repartition("key", "salt")).sortWithinPartitions("key", "salt", "cid", "doc_id", "place")
    runs = dealt.mapInArrow(_first_places(cfg), "key long, cid long, runs array<struct<a:int,b:int,doc:long,at:long>>")
    windows = dealt.mapInArrow(_windows(cfg), "key long, cid long, hash long, off int, doc_id long, at long")
    firsts = windows.groupBy("key", "hash").agg(F.min(F.struct("doc_id", "at")).alias("f"))
    # One more column to join by than the aggregation has: both sides get exchanges that adaptive execution may split.
    both = F.xxhash64("key", "hash").alias("both")
    runs = runs.unionByName(windows.select("*", both).join(firsts.select("*", both), ["both", "key", "hash"]).groupBy("key", "cid").agg(F.collect_list(F.struct(F.col("off").alias("a"), F.col("off").alias("b"), F.col("f.doc_id").alias("doc"), F.col("f.at").alias("at"))).alias("runs")))
    earlier = lambda r: (r.doc < F.col("doc_id")) | ((r.doc == F.col("doc_id")) & (r["at"] < F.col("place") + r["a"]) if cfg.within else F.lit(False))
    hits = mixed.join(runs, ["key", "cid"]).select("rid", "doc_id", "place", F.explode(F.filter("runs", earlier)).alias("r")).select("rid", "doc_id", (F.col("place") + F.col("r.a")).alias("a"), (F.col("place") + F.col("r.b")).alias("b"))
    # flat rows are shuffled, and gathered behind the shuffle: a list of one or two ranges takes more room than they do
    ranges = plain.unionByName(hits).repartition("rid").groupBy("rid", "doc_id").agg(F.collect_list(F.struct("a", "b")).alias("ranges"))
    return ranges.withColumn("copy", F.lit(False)).unionByName(copies.withColumn("ranges", F.lit(None).cast("array<struct<a:long,b:long>>"))).select("rid", "doc_id", "copy", "ranges")


def join_ranges(bodies: DataFrame, ranges: DataFrame) -> DataFrame:
    """Every row with its ``copy`` and ``ranges`` (null and null where nothing repeats)."""
    r = ranges.withColumnRenamed("doc_id", "own_id")
    return bodies.join(r, "rid", "left").select("doc_id", "z", "copy", "ranges", "own_id").where("own_id is null or own_id = doc_id").drop("own_id")


def covered(n: int, window: int, copy, ranges) -> np.ndarray:
    """Mask of the n symbols that some removed window covers."""
    if copy:
        return np.full(n, n >= window)
    step = np.zeros(n + 1, np.int64)
    if ranges is not None:
        for r in ranges:
            step[r["a"]] += 1
            step[min(n, r["b"] + window)] -= 1
    return np.cumsum(step[:n]) > 0
