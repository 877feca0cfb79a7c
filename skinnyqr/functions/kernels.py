"""Small dense kernels run inside Spark tasks (numpy / LAPACK).

Nothing here touches Spark: these are the per-block pieces that the
operators in :mod:`skinnyqr.operators` call from Arrow-fed Python
functions.  Every function works on one bounded block at a time.
"""

from __future__ import annotations

import numpy as np


def signed_qr(a: np.ndarray, want_q: bool = True):
    """Reduced Householder QR with a non-negative diagonal of R.

    ``a`` is m x n.  Returns ``(q, r)`` with q m x h and r h x n where
    h = min(m, n); ``q`` is None when ``want_q`` is false.  Fixing the
    signs makes R unique for a full-rank input, so any blocking or
    reduction order yields the same factor up to rounding.
    """
    a = np.asarray(a, dtype=np.float64)
    m, n = a.shape
    if m == 0:
        return (np.zeros((0, 0)) if want_q else None), np.zeros((0, n))
    if want_q:
        q, r = np.linalg.qr(a, mode="reduced")
    else:
        q, r = None, np.linalg.qr(a, mode="r")
    sg = np.where(np.diag(r) < 0.0, -1.0, 1.0)
    r = r * sg[:, None]
    if q is not None:
        q = q * sg[None, :]
    return q, r


def running_r(r: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Fold a new batch of rows into a running R: R' = R of [R; a]."""
    if a.shape[0] == 0:
        return r
    return signed_qr(np.vstack([r, a]), want_q=False)[1]


def stack_qr(rs: list[np.ndarray], want_q: bool = True):
    """QR of vertically stacked R factors.

    Returns ``(slices, r)``: ``slices[k]`` is the block of rows of the
    stacked Q that belongs to ``rs[k]`` (height of ``rs[k]`` x h), so
    that ``rs[k] = slices[k] @ r``.
    """
    stacked = np.vstack(rs)
    q, r = signed_qr(stacked, want_q=want_q)
    if not want_q:
        return None, r
    cuts = np.cumsum([x.shape[0] for x in rs])[:-1]
    return np.split(q, cuts, axis=0), r


def batched_matmul(lhs: list[np.ndarray], rhs: list[np.ndarray]) -> list[np.ndarray]:
    """Pairwise products ``lhs[i] @ rhs[i]``, vectorised per shape."""
    out: list[np.ndarray | None] = [None] * len(lhs)
    by_shape: dict[tuple, list[int]] = {}
    for i, (x, y) in enumerate(zip(lhs, rhs)):
        by_shape.setdefault((x.shape, y.shape), []).append(i)
    for idx in by_shape.values():
        prod = np.matmul(np.stack([lhs[i] for i in idx]), np.stack([rhs[i] for i in idx]))
        for k, i in enumerate(idx):
            out[i] = prod[k]
    return out  # type: ignore[return-value]


def topn_rows(scores: np.ndarray, items: np.ndarray, n: int, threshold: float, scaled: bool = True):
    """Per-row top-n of a score block.

    ``scores`` is users x items.  Keeps entries with score > threshold
    (NaN never passes), orders by score descending then item ascending,
    and returns ``(row_index, item, score / threshold, rank)`` arrays
    (rank starts at 1); the order is that of the raw scores, which are
    returned undivided when ``scaled`` is false.  Work is a few linear passes over the block plus
    a sort of about n candidates per row; every entry tied with a row's
    n-th best value is a candidate, so ties are broken by item exactly.
    """
    m, k = scores.shape
    if m == 0 or k == 0 or n <= 0:
        e = np.zeros(0)
        return e.astype(np.int64), e.astype(np.int64), e, e.astype(np.int32)
    key = np.where(scores > threshold, scores, -np.inf)
    if k > n:
        part = np.argpartition(key, k - n, axis=1)[:, k - n:]
        kth = np.take_along_axis(key, part, axis=1).min(axis=1)
        # rows with fewer than n kept entries: keep all finite ones
        kth = np.where(np.isneginf(kth), np.finfo(np.float64).min, kth)
        rows, cols = np.nonzero(key >= kth[:, None])
    else:
        rows, cols = np.nonzero(key > -np.inf)
    vals = key[rows, cols]
    its = np.asarray(items)[cols]
    order = np.lexsort((its, -vals, rows))
    rows, its, vals = rows[order], its[order], vals[order]
    starts = np.searchsorted(rows, np.arange(m))
    rank = np.arange(rows.size) - starts[rows] + 1
    sel = rank <= n
    return (
        rows[sel].astype(np.int64),
        its[sel].astype(np.int64),
        vals[sel] / threshold if scaled else vals[sel],
        rank[sel].astype(np.int32),
    )


def topn_pruned(u3: np.ndarray, v: np.ndarray, scale: np.ndarray, items: np.ndarray, n: int, threshold: float,
                mask=None, chunk: int = 1024, cells: int = 1 << 20):
    """Per-row top-n of ``u3 @ v.T``, leaving out items that cannot be among them.

    ``u3`` are user rows times ``scale`` (not negative), ``v`` item rows.  Items
    are visited in chunks by falling length of ``v * sqrt(scale)``.  By
    Cauchy-Schwarz a score is at most the product of that length and the
    user's; a user whose bound is below its n-th best score so far, or not
    above the threshold, is done.  Of the cells that are computed only those
    that reach the n-th best score so far are looked at again.  The result
    is that of :func:`topn_rows` (raw scores).  ``mask(scores, rows, items)``
    may set scores to -inf.  Returns (row, item, score, rank, computed cells).
    """
    m, root = u3.shape[0], np.sqrt(scale)
    if m == 0 or len(items) == 0 or n <= 0:
        e = np.zeros(0)
        return e.astype(np.int64), e.astype(np.int64), e, e.astype(np.int32), 0
    length = np.linalg.norm(v * root, axis=1)
    order = np.argsort(-length, kind="stable")
    v, items, length = v[order], np.asarray(items)[order], length[order]
    with np.errstate(divide="ignore", invalid="ignore"):
        user = np.linalg.norm(np.where(root > 0, u3 / root, 0.0), axis=1)
    user *= 1 + 1e-9  # above any rounding
    least = np.nextafter(threshold, np.inf)
    out, done, step = [], 0, max(1, cells // chunk)
    for lo in range(0, m, step):
        rows = np.arange(lo, min(m, lo + step))
        best = np.full((len(rows), n), -np.inf)
        limit = np.full(len(rows), least)
        active = np.arange(len(rows))
        for at in range(0, len(items), chunk):
            # a NaN bound (NaN factors) keeps its user: the cells decide
            active = active[~(user[rows[active]] * length[at] < limit[active])]
            if not len(active):
                break
            here = items[at : at + chunk]
            scores = u3[rows[active]] @ v[at : at + chunk].T
            done += scores.size
            if mask is not None:
                mask(scores, rows[active], here)
            r, c = np.nonzero(scores >= limit[active][:, None])
            if not len(r):
                continue
            if len(r) > 8 * n * len(active):
                r, it, val, _ = topn_rows(scores, here, n, threshold, scaled=False)
            else:
                it, val = here[c], scores[r, c]
            out.append((rows[active[r]], it, val))
            by = np.lexsort((-val, r))
            r, val = r[by], val[by]
            place = np.arange(len(r)) - np.searchsorted(r, r)
            new = np.full((len(active), n), -np.inf)
            new[r[place < n], place[place < n]] = val[place < n]
            touched = np.unique(r)
            both = np.concatenate([best[active[touched]], new[touched]], axis=1)
            best[active[touched]] = -np.partition(-both, n - 1, axis=1)[:, :n]
            limit[active[touched]] = np.maximum(least, best[active[touched]].min(axis=1))
    if not out:
        e = np.zeros(0)
        return e.astype(np.int64), e.astype(np.int64), e, e.astype(np.int32), done
    r, it, val = (np.concatenate(x) for x in zip(*out))
    by = np.lexsort((it, -val, r))
    r, it, val = r[by], it[by], val[by]
    rank = np.arange(len(r)) - np.searchsorted(r, r) + 1
    sel = rank <= n
    return r[sel].astype(np.int64), it[sel].astype(np.int64), val[sel], rank[sel].astype(np.int32), done


def omega_rows(seed: int, items: np.ndarray, kp: int) -> np.ndarray:
    """Rows of the random projection matrix for integer items: len(items) x kp numbers on [-1, 1).

    A counter-based generator: a 64-bit finaliser of (seed, item, column).
    """
    with np.errstate(over="ignore"):
        x = items.astype(np.int64).view(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
        x = x + (np.arange(kp, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(seed & 0xFFFFFFFFFFFFFFFF))[None, :]
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x = x ^ (x >> np.uint64(31))
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-52 - 1.0


def sums_by_key(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, sum of the rows of each key), keys ascending."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], (np.add.reduceat(rows[order], first, axis=0) if len(keys) else rows)
