"""Mixture-controlled packing into sequences of token ids.

Every source is a queue of documents. A window takes from each queue its quantum of tokens; the fraction that
whole tokens leave over is the queue's deficit and is carried to the next window, and with the window number it
runs on across partitions: after k windows a queue has given floor(k * quantum) tokens, which is what deficit
round-robin gives. So each token's place follows from its place in its queue alone:

1. a pass over the documents encodes them and numbers the tokens of each queue inside each partition; its result
   is a table in the shared folder (ids as 16-bit numbers where the vocabulary allows);
2. totals by (partition, source) become the place where the partition continues each queue;
3. a pass over that table cuts documents where windows and sequences end and gives each piece its place.

Only the last sequence can be short. By default the target proportions are the corpus's own, so every window has
the mixture of the whole; given targets hold until a queue runs dry, after which windows go on without it.
"""

from __future__ import annotations

import os
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import cut, small_batches, tokenizer_path

LENGTH = 2048
#: Sequences of a window: the mixture holds in every run of so many sequences.
WINDOW_SEQUENCES = 16
END = 1
#: Most sources: their totals (two numbers each) go to every task.
MAX_SOURCES = 100_000
#: Words, and word parts, kept by a worker before the table starts anew.
KEPT = 1_200_000
#: Fixed value: the vocabulary file's own rule for parts of a word, on lower-case text of ASCII and Latin-1 letters.
_PART = re.compile(r"[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|'s|'t|'re|'ve|'m|'ll|'d|[^\t-\r a-z0-9\xdf-\xf6\xf8-\xff]+")
#: Bytes of Latin-1 texts that the rule above covers: ASCII without the zero byte, and letters.
_COVERED = bytes(c for c in range(1, 256) if c < 128 or c >= 0xC0 and c not in (0xD7, 0xF7))

_ODD = re.compile("[\x1c-\x1f]")


def covered(text: str) -> bool:
    """Whether the parts of the text follow from _PART alone; special strings are left to the library."""
    if "<|" in text:
        return False
    try:
        return not text.encode("latin-1").translate(None, _COVERED)
    except UnicodeEncodeError:
        return False


class Encoder:
    """Ids of texts from those of their words: no merge crosses the parts of a word, so each is encoded once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already runs a worker for each core
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.wide = self.library.get_vocab_size() > 1 << 16
        self.kind = np.dtype("<u4" if self.wide else "<u2")
        self.ends = np.zeros(self.library.get_vocab_size(), bool)
        self.ends[[i for token, i in self.library.get_vocab().items() if token.endswith("</w>")]] = True
        self.end = np.array([END], self.kind).tobytes()
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _encode(self, words: list[str]) -> list[bytes]:
        """Ids of each word: words go to the library joined by blanks, and tokens return by where they start."""
        out: list[bytes] = []
        for i in range(0, len(words), 2000):
            some = words[i:i + 2000]
            size = np.array([len(w) + 1 for w in some])
            e = self.library.encode(" ".join(some), add_special_tokens=False)
            starts = np.fromiter((o[0] for o in e.offsets), np.int64, len(e.offsets))
            own = np.cumsum(size) - size
            out += self._sliced(e.ids, np.searchsorted(starts, np.append(own, own[-1] + size[-1])))
        return out

    def _encode_parts(self, parts: list[str]) -> list[bytes]:
        """Ids of each part: a part is one word to the library, and the last id of a word is of those that end one."""
        out: list[bytes] = []
        for i in range(0, len(parts), 2000):
            some = parts[i:i + 2000]
            ids = self.library.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids
            last = np.flatnonzero(self.ends[ids])
            if len(last) == len(some):
                out += self._sliced(ids, np.append(0, last + 1))
            else:
                out += self._encode(some)
        return out

    def _sliced(self, ids: list[int], at: np.ndarray) -> list[bytes]:
        raw, at = np.array(ids, self.kind).tobytes(), (at * self.kind.itemsize).tolist()
        return [raw[x:y] for x, y in zip(at[:-1], at[1:], strict=True)]

    def texts(self, texts: list[str]) -> list[bytes]:
        """Ids of each text and the end id: covered texts part by part, others word by word."""
        for kept in (self.words, self.parts):
            if len(kept) > KEPT:
                kept.clear()
        plain = [covered(t) for t in texts]
        out: list[bytes] = [b""] * len(texts)
        for kind, known, encode in ((True, self.parts, self._encode_parts), (False, self.words, self._encode)):
            rows = [i for i, c in enumerate(plain) if c is kind]
            if kind:
                split = [_PART.findall(texts[i].lower()) for i in rows]
            else:  # str.split() also parts at \x1c to \x1f, which the vocabulary file does not take for blanks
                split = [texts[i].split() if not _ODD.search(texts[i]) else re.split(r"[ \t\n\r]+", texts[i]) for i in rows]
            found = [list(map(known.get, ws)) for ws in split]
            miss = [[k for k, x in enumerate(f) if x is None] if None in f else [] for f in found]
            fresh = list({ws[k] for ws, at in zip(split, miss, strict=True) for k in at})
            known.update(zip(fresh, encode(fresh), strict=True))
            for i, ws, f, at in zip(rows, split, found, miss, strict=True):
                for k in at:
                    f[k] = known[ws[k]]
                out[i] = b"".join(f) + self.end
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _encode_rows(path: str):
    def run(batches):
        enc = encoder(path)
        part = TaskContext.get().partitionId()
        given: dict[str, int] = {}
        for batch in batches:
            texts, sources = batch.column("text").to_pylist(), batch.column("source").to_pylist()
            for i in range(0, len(texts), 256):
                ids = enc.texts(texts[i:i + 256])
                n = [len(x) // enc.kind.itemsize for x in ids]
                at = []
                for s, k in zip(sources[i:i + 256], n, strict=True):
                    at.append(given.get(s, 0))
                    given[s] = at[-1] + k
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, 256), batch.column("source").slice(i, 256), pa.array([part] * len(n)), pa.array(at), pa.array(n), pa.array(ids, pa.binary())], ["doc_id", "source", "part", "at", "n", "ids"])
    return run


class Schedule:
    """After k windows queue s has given taken(k)[s] tokens."""

    def __init__(self, totals: np.ndarray, quanta: np.ndarray | None):
        self.totals, self.quanta = totals, quanta
        size = LENGTH * WINDOW_SEQUENCES
        self.windows = max(1, -(-int(totals.sum()) // size)) if quanta is None else max(1, int((-(-totals // quanta)).max()))

    def taken(self, k) -> np.ndarray:
        if self.quanta is not None:
            return np.minimum(self.totals, k * self.quanta)
        return k * (self.totals // self.windows) + k * (self.totals % self.windows) // self.windows

    def window_of(self, s: int, x: int) -> int:
        """The window that gives token x of queue s: the greatest k with taken(k)[s] <= x among those that give any."""
        lo, hi = 0, self.windows - 1
        while lo < hi:
            mid = (lo + hi + 1) // 2
            if self.taken(mid)[s] <= x:
                lo = mid
            else:
                hi = mid - 1
        return lo


def _cut_rows(path: str, sources: list[str], totals: list[int], quanta: list[int] | None):
    def run(batches):
        enc = encoder(path)
        enc.words.clear()  # texts are encoded by now: the worker's tables go, other stages need the memory
        enc.parts.clear()
        kind = enc.kind
        plan = Schedule(np.array(totals, np.int64), None if quanta is None else np.array(quanta, np.int64))
        number = {s: i for i, s in enumerate(sources)}
        last: tuple[int, np.ndarray, np.ndarray] | None = None
        for batch in batches:
            rows: list[tuple] = []
            for doc, source, base, at, n, raw in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "source", "base", "at", "n", "ids")), strict=True):
                ids = np.frombuffer(raw, kind).astype("<u4")
                s, x = number[source], base + at
                done = 0
                k = -1
                while done < n:
                    if k < 0 or last is None or x + done >= last[2][s]:
                        k = plan.window_of(s, x + done) if last is None or k < 0 else k + 1
                        if last is None or last[0] != k:
                            last = (k, plan.taken(k), plan.taken(k + 1))
                        if x + done >= last[2][s]:
                            continue
                    k, before, after = last
                    place = int(before.sum() + (after - before)[:s].sum() + (x + done - before[s]))
                    here = int(min(n - done, after[s] - x - done))
                    while here:
                        size = min(here, LENGTH - place % LENGTH)
                        rows.append((doc, done, size, zlib.crc32(ids[done:done + size].tobytes()), n, place // LENGTH, place % LENGTH))
                        done, place, here = done + size, place + size, here - size
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 7)], names)
    return run


def pack(docs: DataFrame, targets: dict[str, float] | None = None, vocabulary: str = "word_bpe_49k.json", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    targets: wanted share of each source; sources it does not name keep their share of what is left over.
    Null and empty texts are the end id alone. Null sources are one queue. Repeated rows are packed as often as
    they stand. An empty table gives no piece.
    """
    spark = docs.sparkSession
    small_batches(spark)
    path = tokenizer_path(vocabulary)
    source = F.coalesce(F.col(source_col).cast("string"), F.lit("\0")) if source_col in docs.columns else F.lit("\0")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), source.alias("source"))
    done = cut(rows.mapInArrow(_encode_rows(path), "doc_id long, source string, part long, at long, n long, ids binary"), "packing")
    sums = done.groupBy("source", "part").agg(F.sum("n").alias("sum_n"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("source", "part", F.coalesce(F.sum("sum_n").over(before), F.lit(0)).alias("base"))
    found = sums.groupBy("source").agg(F.sum("sum_n").alias("n")).orderBy("source").limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"over {MAX_SOURCES} sources")
    names, totals = [r.source for r in found], [r.n for r in found]
    quanta = None
    if targets:
        rest = sum(t for s, t in zip(names, totals, strict=True) if s not in targets) or 1
        spare = max(0.0, 1 - sum(targets.values()))
        quanta = [max(1, round(LENGTH * WINDOW_SEQUENCES * (targets[s] if s in targets else spare * t / rest))) for s, t in zip(names, totals, strict=True)]
    return done.join(bases, ["source", "part"]).select("doc_id", "source", "base", "at", "n", "ids").mapInArrow(_cut_rows(path, names, totals, quanta), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
