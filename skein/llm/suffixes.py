"""Byte-level substring dedup by sorting suffixes.

Suffixes that begin a repeated 100-byte window are dealt out by their leading token (the minimiser gram, see
``repeats``) through range splitters from a quantile sketch, so equal leading tokens never straddle a border and the
comparison across borders of buckets is between different tokens. The gram has 32 bytes: shorter ones meet by chance
in unlike places, the more often the more text there is. Inside a bucket the window suffixes are sorted by multikey
quicksort with 8-byte characters: each round orders only the suffixes still tied on all characters before, and
neighbours still tied after the last character are equal windows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from skein.llm import textnum as T
from skein.llm.common import texts
from skein.llm.repeats import Repeats, covered, join_ranges, packed, removed_ranges

WINDOW = 100


def multikey_classes(eight: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """Class number of each window start: equal numbers for equal ``window``-byte strings.

    eight[i] is the big-endian number of the 8 bytes at i. Characters are taken at 0, 8, ... and the last one
    ends with the window.
    """
    steps = [*range(0, window - 7, 8)]
    if steps[-1] != window - 8:
        steps.append(window - 8)
    cls = np.zeros(len(at), np.int64)
    tied, fresh = np.arange(len(at)), 1
    for k in steps:
        if not len(tied):
            break
        c, g = eight[at[tied] + k], cls[tied]
        order = np.argsort(c)
        if k:  # characters by rank, so that class and character are one number
            rank = np.empty(len(c), np.int64)
            rank[order] = np.cumsum(np.append(False, c[order][1:] != c[order][:-1]))
            order = np.argsort(g * len(c) + rank)
        c, g = c[order], g[order]
        new = np.ones(len(c), bool)
        new[1:] = (c[1:] != c[:-1]) | (g[1:] != g[:-1])
        number = np.cumsum(new) - 1
        cls[tied[order]] = fresh + number
        fresh += int(number[-1]) + 1
        often = np.bincount(number)
        tied = tied[order][often[number] > 1]
    return cls


def _engine(contents, docs, places):
    sizes = np.array([len(c) for c in contents])
    data = np.frombuffer(b"".join(contents) + b"\0" * 8, np.uint8).astype(T.U)
    eight = np.zeros(len(data) - 7, T.U)
    for j in range(8):
        eight = (eight << T.U(8)) | data[j:j + len(eight)]
    begin = np.cumsum(sizes) - sizes
    count = sizes - WINDOW + 1
    own = np.repeat(np.arange(len(contents)), count)
    off = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
    cls = multikey_classes(eight, begin[own] + off, WINDOW)
    doc, at = docs[own], places[own] + off
    first = np.arange(len(own))
    often = np.flatnonzero(np.bincount(cls)[cls] > 1)
    order = often[np.lexsort((at[often], doc[often], cls[often]))]
    new = np.ones(len(order), bool)
    new[1:] = cls[order][1:] != cls[order][:-1]
    first[order] = order[new][np.cumsum(new) - 1]
    fdoc, fat = doc[first], at[first]
    cut = np.ones(len(own), bool)
    cut[1:] = (own[1:] != own[:-1]) | (fdoc[1:] != fdoc[:-1]) | (fat[1:] != fat[:-1] + 1)
    f = np.flatnonzero(cut)
    last = np.append(f[1:], len(own)) - 1
    return own[f], off[f], off[last], fdoc[f], fat[f]


CONFIG = Repeats(unit="byte", window=WINDOW, gram=32, within=True, block=1_000_000, engine=_engine, ranged=True)


def _strip(batches):
    for batch in batches:
        data, offs = T.unpack(batch.column("z"))
        copy, ranges = batch.column("copy"), batch.column("ranges")
        total, removed, spans, kept = [], [], [], []
        for i in range(batch.num_rows):
            d = data[offs[i]:offs[i + 1]]
            found = ranges[i].as_py()
            gone = covered(len(d), WINDOW, copy[i].as_py(), found)
            total.append(len(d))
            removed.append(int(gone.sum()))
            spans.append(int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()))
            kept.append(d[~gone].tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): bytes left when every 100-byte string keeps its first place.

    kept is binary: a cut may fall inside a character. Null and empty texts have no bytes; texts under 100 bytes
    keep all. Rows with equal doc_id but other text count as one document whose places overlap; repeated rows get
    equal results. Rows with a null doc_id keep everything. An empty table gives an empty result.
    """
    rows = texts(docs, id_col, text_col)
    bodies = packed(rows)
    return join_ranges(bodies, removed_ranges(rows, bodies, CONFIG)).mapInArrow(_strip, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
