"""Counting quotient filters: lossless, compact, sorted counters of fixed-width keys (numpy, inside tasks).

A key of ``2 * half`` bits (two halves of at most 64 bits) is permuted by a
Feistel network, which is invertible, so the permuted key is evenly spread
and still names its key.  Its leading bits are the quotient, the others the
full remainder.  A filter keeps, in the order of permuted keys, one bit for
every quotient (is it occupied), one bit for every entry (does it end its
quotient's run), the remainder and a counter of variable length.  Quotients
are never written.  Sorted filters of several shards merge in one pass.
"""

from __future__ import annotations

import numpy as np

from .shingles import mix64

_ROUNDS = [np.uint64(x) for x in (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89)]
_HEAD = 4  # uint64 words before a block's arrays
_ONE_BYTE = 255  # counters from here on are kept in the escape array


def _mask(bits: int) -> np.uint64:
    return np.uint64((1 << bits) - 1)


def permute(left: np.ndarray, right: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    for key in _ROUNDS:
        left, right = right, left ^ (mix64(right + key) & _mask(half))
    return left, right


def restore(left: np.ndarray, right: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """The inverse of :func:`permute`."""
    for key in reversed(_ROUNDS):
        left, right = right ^ (mix64(left + key) & _mask(half)), left
    return left, right


def pack(ids: list[np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(left, right, half): the n ids of ``bits`` bits each as one key of n * bits bits."""
    n, m = len(ids), len(ids) // 2
    b = np.uint64(bits)
    left = right = np.zeros(len(ids[0]), np.uint64)
    for x in ids[:m]:
        left = (left << b) | x.astype(np.uint64)
    for x in ids[n - m :]:
        right = (right << b) | x.astype(np.uint64)
    if n % 2:
        mid, s = ids[m].astype(np.uint64), np.uint64(bits // 2)
        left = (left << s) | (mid >> s)
        right = right | ((mid & _mask(bits // 2)) << np.uint64(m * bits))
    return left, right, n * bits // 2


def unpack(left: np.ndarray, right: np.ndarray, n: int, bits: int) -> list[np.ndarray]:
    m, mask = n // 2, _mask(bits)
    mid = []
    if n % 2:
        s = np.uint64(bits // 2)
        mid = [((left & _mask(bits // 2)) << s) | (right >> np.uint64(m * bits))]
        left, right = left >> s, right & _mask(m * bits)
    part = lambda x: [(x >> np.uint64(bits * (m - 1 - i))) & mask for i in range(m)]
    return [*part(left), *mid, *part(right)]


def summed(left: np.ndarray, right: np.ndarray, counts: np.ndarray | None, half: int):
    """Sorted distinct keys with their counts added; sorted runs in the input are merged, not sorted anew."""
    if len(left) == 0:
        return left, right, np.zeros(0, np.int64)
    if 2 * half <= 64:
        key = (left << np.uint64(half)) | right if half < 64 else right
        if counts is None:
            key = np.sort(key)
            order = None
        else:
            order = np.argsort(key, kind="stable")
            key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        left, right = key[first] >> np.uint64(half), key[first] & _mask(half)
    else:
        order = np.lexsort((right, left))
        left, right = left[order], right[order]
        first = np.flatnonzero(np.concatenate([[True], (left[1:] != left[:-1]) | (right[1:] != right[:-1])]))
        n, left, right = len(left), left[first], right[first]
        if counts is None:
            return left, right, np.diff(np.append(first, n))
    if counts is None:
        return left, right, np.diff(np.append(first, len(key)))
    return left, right, np.add.reduceat(counts[order], first)


def _narrow(x: np.ndarray, bits: int) -> bytes:
    """The low ``bits`` bits of each value in as many whole bytes."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : -(-bits // 8)]).tobytes()


def _widen(buf: memoryview, n: int, bits: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    width = -(-bits // 8)
    out[:, :width] = np.frombuffer(buf, np.uint8, n * width).reshape(n, width)
    return out.view("<u8").reshape(-1)


class QuotientFilter:
    """Sorted permuted keys with counters, all of whose first ``shared`` bits are the same (``prefix``)."""

    def __init__(self, left, right, counts, half: int, shared: int = 0, prefix: int = 0):
        self.left, self.right, self.counts = left, right, np.asarray(counts, np.int64)
        self.half, self.shared, self.prefix = half, shared, prefix

    @classmethod
    def of(cls, left, right, half: int, counts=None) -> QuotientFilter:
        """Counts the keys (not permuted yet)."""
        return cls(*summed(*permute(left, right, half), counts, half), half)

    def __len__(self) -> int:
        return len(self.left)

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        return restore(self.left, self.right, self.half)

    def at_least(self, least: int) -> QuotientFilter:
        keep = self.counts >= least
        return QuotientFilter(self.left[keep], self.right[keep], self.counts[keep], self.half, self.shared, self.prefix)

    def split(self, bits: int):
        """Filters of the keys that share their first ``bits`` bits, in order, empty ones left out."""
        if not len(self):
            return
        head = self.left >> np.uint64(self.half - bits)
        cut = [0, *(np.flatnonzero(np.diff(head)) + 1).tolist(), len(self)]
        for a, b in zip(cut, cut[1:]):
            yield QuotientFilter(self.left[a:b], self.right[a:b], self.counts[a:b], self.half, bits, int(head[a]))

    def to_bytes(self) -> bytes:
        n = len(self)
        q = max(0, min(n.bit_length() - 1, self.half - self.shared))  # about one entry a quotient
        low = self.half - self.shared - q
        quotient = ((self.left >> np.uint64(low)) & _mask(q)).astype(np.int64)
        occupied = np.zeros(1 << q, np.uint8)
        occupied[quotient] = 1
        ends = np.ones(n, np.uint8)
        ends[:-1] = quotient[1:] != quotient[:-1]
        small = np.minimum(self.counts, _ONE_BYTE).astype(np.uint8)
        head = np.array([n, q | self.half << 8 | self.shared << 16, self.prefix, 0], "<u8")
        return b"".join((
            head.tobytes(), np.packbits(occupied).tobytes(), np.packbits(ends).tobytes(),
            _narrow(self.left & _mask(low), low), _narrow(self.right, self.half), small.tobytes(), self.counts[small == _ONE_BYTE].astype("<i8").tobytes(),
        ))

    @classmethod
    def from_bytes(cls, raw) -> QuotientFilter:
        buf = memoryview(raw)
        head = np.frombuffer(buf[: 8 * _HEAD], "<u8")
        n, q, half, shared, prefix = int(head[0]), int(head[1]) & 255, int(head[1]) >> 8 & 255, int(head[1]) >> 16, int(head[2])
        low, at = half - shared - q, 8 * _HEAD

        def take(size: int) -> memoryview:
            nonlocal at
            at += size
            return buf[at - size : at]

        occupied = np.unpackbits(np.frombuffer(take(-(-(1 << q) // 8)), np.uint8), count=1 << q)
        ends = np.unpackbits(np.frombuffer(take(-(-n // 8)), np.uint8), count=n)
        remainder = _widen(take(n * -(-low // 8)), n, low)
        right = _widen(take(n * -(-half // 8)), n, half)
        counts = np.frombuffer(take(n), np.uint8).astype(np.int64)
        counts[counts == _ONE_BYTE] = np.frombuffer(buf[at:], "<i8")
        run = np.cumsum(ends, dtype=np.int64) - ends  # which of the occupied quotients an entry belongs to
        quotient = np.flatnonzero(occupied)[run].astype(np.uint64) if n else np.zeros(0, np.uint64)
        left = (np.uint64(prefix) << np.uint64(half - shared)) if shared else np.uint64(0)
        return cls(left | (quotient << np.uint64(low)) | remainder, right, counts, half, shared, prefix)


def merge(filters: list[QuotientFilter]) -> QuotientFilter:
    """One filter of all entries, counters of equal keys added."""
    f = filters[0]
    if len(filters) == 1:
        return f
    cat = [np.concatenate([getattr(x, c) for x in filters]) for c in ("left", "right", "counts")]
    return QuotientFilter(*summed(*cat, f.half), f.half, f.shared, f.prefix)
