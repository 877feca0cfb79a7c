"""Vectorised word and shingle hashing on Arrow string buffers (numpy, inside tasks)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_POS = 256
_rng = np.random.Generator(np.random.PCG64(20240501))
_ZOBRIST = _rng.integers(0, 2**64, size=_POS * 256, dtype=np.uint64)
_FAR = np.uint64(0x9E3779B97F4A7C15)
_GRAM = _rng.integers(0, 2**64, size=64, dtype=np.uint64) | np.uint64(1)

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets of length n+1); null texts are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    offs = np.frombuffer(off, dtype=np.int64, count=n + 1 + col.offset)[col.offset :]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def bounded(batch: pa.RecordBatch, col: int, most: int = 3 << 20):
    """Slices of a batch whose texts in ``col`` have about ``most`` bytes at most (a longer text is a slice of its own)."""
    lengths = pc.fill_null(pc.binary_length(batch.column(col)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(lengths, dtype=np.int64) // most
    cut = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cut, cut[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def word_hashes(raw: np.ndarray, offs: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word, and the word offsets of each text.

    A word's hash is the sum of a random number for each (position, byte).
    """
    n = len(offs) - 1
    if raw.size == 0:
        return np.empty(0, np.uint64), np.zeros(n + 1, np.int64)
    if lower:
        raw = _LOWER[raw]
    inside = ~_IS_SPACE[raw]
    starts_here = inside.copy()
    starts_here[1:] &= ~inside[:-1]
    first = offs[:-1][(offs[1:] > offs[:-1])]
    starts_here[first] = inside[first]  # a word never spans two texts
    starts = np.flatnonzero(starts_here)
    if starts.size == 0:
        return np.empty(0, np.uint64), np.zeros(n + 1, np.int64)
    lengths = np.diff(np.append(starts, raw.size))
    pos = np.arange(starts[0], raw.size, dtype=np.int64) - np.repeat(starts, lengths)
    body = raw[starts[0] :]
    if lengths.max() <= _POS:
        vals = _ZOBRIST[(pos << 8) + body]
    else:
        vals = _ZOBRIST[((pos & (_POS - 1)) << 8) + body]
        far = pos >= _POS
        powers = np.multiply.accumulate(np.full(int(pos.max() >> 8) + 1, _FAR, np.uint64))
        vals[far] *= powers[pos[far] >> 8]
    vals[~inside[starts[0] :]] = 0
    sums = np.add.reduceat(vals, starts - starts[0])
    return sums, np.searchsorted(starts, offs)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word shingles of one text, in order; fewer words: the sequence as one."""
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    w = min(k, n)
    acc = np.full(n - w + 1, int(_GRAM[w]) * w & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for j in range(w):
        acc += words[j : n - w + 1 + j] * _GRAM[8 + j]
    return mix64(acc)
