"""Whole Arrow batches of text as numpy arrays: word spans, 64-bit hashes of words, byte grams and word n-grams,
sliding-window minima. No per-word Python code; every function works on the concatenated bytes of many documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.RandomState(20240607).randint(0, 1 << 63, 256, dtype=np.int64).astype(U) * U(2) + U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {"up": np.ones(1, U), "down": np.ones(1, U)}

#: Bits of a position inside a chunk; the rest of a packed 64-bit value is gram hash.
POS_BITS = 28


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i (mod 2^64) for i < n, kept for the next call."""
    if len(_powers["up"]) < n:
        size = max(n, 1 << 20)
        for name, b in (("up", _BASE), ("down", _INV)):
            steps = np.full(size, b, U)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 (in place on a fresh array)."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all rows, row offsets) of a string column; null rows are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    if len(col) == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    offs = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0]:offs[-1]], offs - offs[0]


def chunks(offs: np.ndarray, limit: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer row is a range of its own."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; other bytes unchanged."""
    return _LOWER[data]


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every maximal run outside [\\x20\\x09-\\x0D]; runs end at row borders."""
    if len(data) == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    ink = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    first = ink.copy()
    first[1:] &= ~ink[:-1] | edge[1:-1]
    last = ink.copy()
    last[:-1] &= ~ink[1:] | edge[1:-1]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    return s, e, np.searchsorted(offs, s, side="right") - 1


def prefix(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums: any span's hash follows from two of them."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, U)
    np.cumsum(_TABLE[data] * up[:len(data)], out=out[1:])
    return out


def spans_hash(pre: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, the same wherever the span lies."""
    _, down = powers(len(pre))
    h = (pre[e] - pre[s]) * down[s]
    return mix(h + (e - s).astype(U) * U(0xD6E8FEB86659FD93))


def grams(values: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash of each run of n values (rows are not told apart here)."""
    if len(values) < n:
        return np.zeros(0, U)
    size = len(values) - n + 1
    acc = np.zeros(size, U)
    for j in range(n):
        acc *= U(_BASE)
        acc += values[j:j + size]
    return mix(acc)


def byte_grams(data: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash of each run of n bytes."""
    if len(data) < n:
        return np.zeros(0, U)
    pre = prefix(data)
    _, down = powers(len(pre))
    return mix((pre[n:] - pre[:-n]) * down[:len(data) - n + 1])


def leftmost_minimum(values: np.ndarray, w: int) -> np.ndarray:
    """Position of the least of each w consecutive values (leading bits compared, leftmost of equals)."""
    size = len(values) - w + 1
    if size <= 0:
        return np.zeros(0, np.int64)
    keep = U((1 << POS_BITS) - 1)
    m = (values & ~keep) | np.arange(len(values), dtype=U)
    have = 1
    while have * 2 <= w:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    if have < w:
        m = np.minimum(m[:size], m[w - have:w - have + size])
    return (m[:size] & keep).astype(np.int64)


def segments(symbols_offs: np.ndarray, gram: np.ndarray, gram_len: int, window: int):
    """Windows of ``window`` symbols inside one row, joined into runs with the same least gram.

    symbols_offs: offsets of rows in the symbol array. Returns (first window, last window, place of that
    gram, row, whether the place moves, as it does where a run holds one window twice) of each run. Equal windows have equal least grams, hence the same key; runs are told apart
    by the gram, not its place, so a word or byte repeated without end is one run.
    """
    z = np.zeros(0, np.int64)
    at = leftmost_minimum(gram, window - gram_len + 1)
    if len(at) == 0:
        return z, z, z, z, z.astype(bool)
    starts = np.arange(len(at))
    row = np.searchsorted(symbols_offs, starts, side="right") - 1
    ok = starts + window <= symbols_offs[row + 1]
    starts, row, at = starts[ok], row[ok], at[ok]
    if len(starts) == 0:
        return z, z, z, z, z.astype(bool)
    new = np.ones(len(starts), bool)
    new[1:] = (gram[at[1:]] != gram[at[:-1]]) | (row[1:] != row[:-1])
    f = np.flatnonzero(new)
    last = np.append(f[1:], len(starts)) - 1
    return starts[f], starts[last], at[f], row[f], at[f] != at[last]


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rid, doc_id, text) -> (rid, doc_id, z): texts compressed, so that their one shuffle is smaller."""
    zip_ = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        z = [zip_.compress(x or b"") for x in batch.column("text").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("doc_id"), pa.array(z, pa.binary())], ["rid", "doc_id", "z"])


def unpack(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all rows, row offsets) of a column made by ``pack``."""
    unzip = zstandard.ZstdDecompressor()
    parts = [unzip.decompress(x) for x in col.to_pylist()]
    offs = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(x) for x in parts], out=offs[1:])
    return np.frombuffer(b"".join(parts), np.uint8), offs


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
