"""Benchmark decontamination by template canonicalisation.

Tokens are maximal runs of ASCII letters, digits and non-ASCII bytes, lower-cased. Two templates are kept for
each text: a literal one, where only numbers are typed, and a typed one, where capitalised words inside sentences
are names and unit words after a number are units. Windows of template tokens are joined by hash; a match counts
when along one alignment the same slot value of the item always meets the same slot value of the document, so
that an item with new numbers or names is caught and an accidental mixture is not. Windows of mostly numbers are
compared with the numbers as they are. Alignments that follow one another, as where words were put in or left out,
are joined.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm import textnum as T
from skein.llm.common import small_batches, texts, unused

WINDOW = 8
SHORTEST = 4
#: Share of an item's tokens that consistent windows must cover.
COVER = 0.5
#: Bits of the filter of benchmark window hashes that goes to every task: a fixed 2 MB whatever the benchmark's size.
FILTER_BITS = 24
#: Unit words.
UNITS = ["mm", "cm", "m", "km", "inch", "inches", "foot", "feet", "yard", "yards", "mile", "miles", "mg", "g", "kg", "gram", "grams", "kilogram", "kilograms", "ton", "tons", "pound", "pounds", "ounce", "ounces", "ml", "l", "liter", "liters", "litre", "litres", "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "dollar", "dollars", "cent", "cents", "euro", "euros", "percent", "degree", "degrees"]

_INK = np.zeros(256, bool)
_INK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?:\n"]] = True
_NUMBER, _NAME, _UNIT = T.U(0x1111), T.U(0x2222), T.U(0x3333)


def _unit_hashes() -> np.ndarray:
    data, offs = T.buffers(pa.array(UNITS))
    return np.sort(T.spans_hash(T.prefix(data), offs[:-1], offs[1:]))


def _tokens(data: np.ndarray, offs: np.ndarray):
    """Rows of tokens: (row, value hash, is number, is name, is unit)."""
    ink = _INK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    first, last = ink.copy(), ink.copy()
    first[1:] &= ~ink[:-1] | edge[1:-1]
    last[:-1] &= ~ink[1:] | edge[1:-1]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    row = np.searchsorted(offs, s, side="right") - 1
    low = T.lower(data)
    big = np.zeros(len(data), bool)  # U+00C0 to U+00DE, but the multiplication sign
    big[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    low = np.where(big, low + 32, low).astype(np.uint8)
    value = T.spans_hash(T.prefix(low), s, e)
    number = _DIGIT[data[s]]
    upper = (data[s] >= 65) & (data[s] <= 90) | (np.append(big, False)[s + 1] & (data[s] == 0xC3))
    stops = np.concatenate([[0], np.cumsum(_STOP[data])])
    opens = np.ones(len(s), bool)
    opens[1:] = (row[1:] != row[:-1]) | (stops[s[1:]] > stops[e[:-1]])
    units = _unit_hashes()
    unit = units[np.minimum(np.searchsorted(units, value), len(units) - 1)] == value
    unit[:1] = False
    unit[1:] &= number[:-1] & (row[1:] == row[:-1])
    return row, value, number, upper & ~opens & ~number, unit


def windows(data: np.ndarray, offs: np.ndarray, lengths, keep=None):
    """Template windows of a chunk: (hash, row, first token, length, slot values), both templates.

    keep: hashes to keep (a bit filter); windows with under half literal tokens are left out of the templates, those
    of which over half are numbers stand with their values.
    """
    if not len(data):
        return
    row, value, number, name, unit = _tokens(data, offs)
    if not len(row):
        return
    own = np.searchsorted(row, np.arange(len(offs)))
    literal = np.where(number, _NUMBER, value)
    typed = np.where(name, _NAME, np.where(unit, _UNIT, literal))
    soft = np.concatenate([[0], np.cumsum(name | unit)])
    for template, slot in ((literal, number), (typed, number | name | unit), (value, number)):
        free = np.concatenate([[0], np.cumsum(slot)])
        for n in lengths:
            if len(row) < n:
                continue
            h = T.grams(template + T.U(n + (WINDOW if template is value else 0)), n)
            at = np.arange(len(h))
            ok = (row[at] == row[at + n - 1]) & ((2 * (free[at + n] - free[at]) > n) == (template is value))
            if template is typed:  # without a name or unit the literal template says the same
                ok &= soft[at + n] > soft[at]
            if keep is not None:
                x = (h & T.U((1 << FILTER_BITS) - 1)).astype(np.int64)
                ok &= (keep[x >> 3] >> (x & 7).astype(np.uint8) & 1).astype(bool)
            at = at[ok]
            slots = [T.signed(value[i:i + n][slot[i:i + n]]).tolist() for i in at.tolist()]
            yield T.signed(h[at]), row[at], at - own[row[at]], np.full(len(at), n), slots


_SLOTS = pa.list_(pa.int64())


def _item_rows(lengths):
    """Windows of benchmark items; an item shorter than WINDOW is one window of its own length."""
    def run(batches):
        for batch in batches:
            data, offs = T.buffers(batch.column("text"))
            item = np.asarray(batch.column("item_id"))
            size = np.bincount(_tokens(data, offs)[0], minlength=len(item)) if len(data) else np.zeros(len(item), np.int64)
            for h, row, at, n, slots in windows(data, offs, lengths):
                ok = n == np.minimum(size[row], WINDOW)
                if ok.any():
                    yield pa.RecordBatch.from_arrays([pa.array(h[ok]), pa.array(item[row[ok]]), pa.array(at[ok]), pa.array(n[ok]), pa.array(size[row[ok]]), pa.array([s for s, k in zip(slots, ok.tolist(), strict=True) if k], _SLOTS)], ["h", "item_id", "item_at", "n", "item_tokens", "item_slots"])
    return run


def _doc_rows(lengths, keep):
    def run(batches):
        for batch in batches:
            data, offs = T.buffers(batch.column("text"))
            rid = np.asarray(batch.column("rid"))
            for i, j in T.chunks(offs):
                for h, row, at, _, slots in windows(data[offs[i]:offs[j]], offs[i:j + 1] - offs[i], lengths, keep):
                    if len(h):
                        yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(rid[i:j][row]), pa.array(at), pa.array(slots, _SLOTS)], ["h", "rid", "at", "slots"])
    return run


def _chain(size: int, shifts: list[dict]) -> int:
    """Most tokens of an item of ``size`` that consistent alignments cover which follow one another in the document.

    Between two of them at most ``size`` other tokens of the document may stand. Chains grow from their best
    beginnings, so where slots conflict between alignments another choice may cover more.
    """
    parts = []
    for s in shifts:
        tokens, bound = s["tokens"], {b["item_slots"]: b["slots"] for b in s["bound"]}
        cuts = [0, *(i for i in range(1, len(tokens)) if tokens[i] != tokens[i - 1] + 1), len(tokens)]
        parts += [(tokens[j - 1] + s["shift"], tokens[i], tokens[j - 1], s["shift"], bound) for i, j in zip(cuts, cuts[1:])]
    parts.sort(key=lambda x: x[:4])
    ends = [x[0] for x in parts]
    best: list[tuple[int, dict]] = []
    for i, (_, a, b, shift, bound) in enumerate(parts):
        most, slots = b - a + 1, bound
        for j in range(bisect_left(ends, a + shift - 1 - size), i):
            begin = max(a, parts[j][2] + 1, ends[j] + 1 - shift)
            covers = best[j][0] + b - begin + 1
            if begin <= b and begin + shift - ends[j] - 1 <= size and covers > most and all(best[j][1].get(k, v) == v for k, v in bound.items()):
                most, slots = covers, best[j][1] | bound
        best.append((most, slots))
    return max((n for n, _ in best), default=0)


def _chains(batches):
    for batch in batches:
        cover = []
        for size, shifts in zip(batch.column("item_tokens").to_pylist(), batch.column("shifts").to_pylist(), strict=True):
            most = max(len(s["tokens"]) for s in shifts)
            cover.append((most if most == size or len(shifts) == 1 else max(most, _chain(size, shifts))) / size)
        yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("item_id"), pa.array(cover, pa.float64())], ["rid", "item_id", "coverage"])


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(rid, item_id, coverage): consistent template matches that cover at least COVER of an item's tokens.

    rid is that of ``common.texts``. Items with fewer than SHORTEST tokens, null or empty texts match nothing;
    benchmark items with equal item_id are joined under that id; a null item_id is left out. Windows of which over
    half are slots are too general; those of which over half are numbers match only with equal numbers.
    """
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("item_id is not null").distinct()
    lengths = range(SHORTEST, WINDOW + 1)
    ours = items.mapInArrow(_item_rows(lengths), "h long, item_id long, item_at long, n long, item_tokens long, item_slots array<long>")
    found = ours.select(F.col("h").bitwiseAND((1 << FILTER_BITS) - 1).alias("x"), "n").distinct().collect()  # at most 2^FILTER_BITS x 5 small rows
    keep = np.zeros(1 << FILTER_BITS - 3, np.uint8)
    for r in found:
        keep[r.x >> 3] |= 1 << (r.x & 7)
    present = sorted({r.n for r in found})
    theirs = texts(docs, id_col, text_col).select("rid", "text")
    hits = theirs.mapInArrow(_doc_rows(present, keep), "h long, rid long, at long, slots array<long>").distinct()
    pairs = hits.join(ours, "h").where("size(slots) = size(item_slots)")
    one = pairs.groupBy("rid", "item_id", (F.col("at") - F.col("item_at")).alias("shift"), "item_tokens").agg(
        F.flatten(F.collect_set(F.sequence("item_at", F.expr("item_at + n - 1")))).alias("tokens"),
        F.array_distinct(F.flatten(F.collect_set(F.arrays_zip("item_slots", "slots")))).alias("bound"))
    ok = one.where(F.size("bound") == F.size(F.array_distinct(F.col("bound.item_slots"))))
    shifts = ok.groupBy("rid", "item_id", "item_tokens").agg(F.collect_list(F.struct("shift", F.array_sort(F.array_distinct("tokens")).alias("tokens"), "bound")).alias("shifts"))
    cover = shifts.mapInArrow(_chains, "rid long, item_id long, coverage double")
    return cover.groupBy("rid", "item_id").agg(F.max("coverage").alias("coverage")).where(F.col("coverage") >= COVER)


def flag(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, contaminated, n_items, best_item, coverage) of every row; repeated rows get equal results."""
    found = contaminated(docs, benchmark, id_col, text_col)
    best = found.groupBy("rid").agg(F.count("*").alias("n_items"), F.max("coverage").alias("coverage"), F.min_by("item_id", F.struct(-F.col("coverage"), "item_id")).alias("best_item"))
    return texts(docs, id_col, text_col).select("rid", "doc_id").join(best, "rid", "left").select("doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), "best_item", F.coalesce("coverage", F.lit(0.0)).alias("coverage"))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, that hold no benchmark item."""
    rid = unused(docs, "rid")
    found = contaminated(docs, benchmark, id_col, text_col).select(F.col("rid").alias(rid)).distinct()
    key = F.xxhash64(docs[id_col].cast("long"), F.coalesce(docs[text_col].cast("string"), F.lit("")))
    return docs.join(found, key == F.col(rid), "left_anti")
