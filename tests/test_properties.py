"""Property tests of the per-block kernels against brute force."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from skinnyqr.functions.kernels import running_r, signed_qr, topn_rows


@st.composite
def score_blocks(draw):
    m = draw(st.integers(1, 6))
    k = draw(st.integers(1, 9))
    # small integer values: many exact ties; some NaN
    vals = draw(st.lists(st.one_of(st.integers(-3, 6).map(float), st.just(float("nan"))), min_size=m * k,
                         max_size=m * k))
    items = draw(st.permutations(list(range(100, 100 + k))))
    n = draw(st.integers(1, k + 2))
    thr = draw(st.sampled_from([0.5, 1.0, 2.5]))
    return np.array(vals).reshape(m, k), np.array(items, dtype=np.int64), n, thr


@settings(max_examples=300, deadline=None)
@given(score_blocks())
def test_topn_rows_equals_brute_force(block):
    scores, items, n, thr = block
    rows, its, vals, ranks = topn_rows(scores, items, n, thr)
    got = {}
    for r, it, v, rk in zip(rows, its, vals, ranks):
        got.setdefault(int(r), []).append((int(rk), int(it), float(v)))
    for r in range(scores.shape[0]):
        cand = [(float(s), int(it)) for s, it in zip(scores[r], items) if s > thr]
        cand.sort(key=lambda x: (-x[0], x[1]))
        expect = [(i + 1, it, s / thr) for i, (s, it) in enumerate(cand[:n])]
        assert sorted(got.get(r, [])) == expect


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 6), st.lists(st.integers(1, 40), min_size=1, max_size=6), st.integers(0, 10_000))
def test_running_r_any_batching(n, sizes, seed):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=(sum(sizes), n))
    r = np.zeros((0, n))
    start = 0
    for size in sizes:
        r = running_r(r, a[start : start + size])
        start += size
    _, ref = signed_qr(a, want_q=False)
    assert r.shape == ref.shape
    assert np.allclose(r, ref, atol=1e-10)
    assert np.all(np.diag(r) >= 0)
