import numpy as np

from skinnyqr.functions.kernels import batched_matmul, running_r, signed_qr, stack_qr, topn_pruned, topn_rows


def test_signed_qr_diag_nonnegative_and_reconstructs():
    rng = np.random.default_rng(0)
    a = rng.normal(size=(50, 6))
    q, r = signed_qr(a)
    assert np.all(np.diag(r) >= 0)
    assert np.allclose(q @ r, a)
    assert np.allclose(q.T @ q, np.eye(6))


def test_short_block_gives_short_r():
    a = np.arange(6.0).reshape(2, 3) + 1
    q, r = signed_qr(a)
    assert r.shape == (2, 3) and q.shape == (2, 2)
    assert np.allclose(q @ r, a)


def test_running_r_equals_direct():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(300, 5))
    r = np.zeros((0, 5))
    for part in np.array_split(a, 7):
        r = running_r(r, part)
    _, r2 = signed_qr(a, want_q=False)
    assert np.allclose(r, r2)


def test_stack_qr_slices():
    rng = np.random.default_rng(2)
    rs = [signed_qr(rng.normal(size=(10, 4)), want_q=False)[1] for _ in range(3)]
    slices, r = stack_qr(rs)
    for x, s in zip(rs, slices):
        assert np.allclose(s @ r, x)


def test_batched_matmul_mixed_shapes():
    rng = np.random.default_rng(3)
    lhs = [rng.normal(size=(2, 3)), rng.normal(size=(3, 3)), rng.normal(size=(2, 3))]
    rhs = [rng.normal(size=(3, 4)), rng.normal(size=(3, 2)), rng.normal(size=(3, 4))]
    out = batched_matmul(lhs, rhs)
    for x, y, z in zip(lhs, rhs, out):
        assert np.allclose(x @ y, z)


def test_topn_rows_threshold_nan_ties():
    scores = np.array([[5.0, 7.0, 7.0, np.nan, 0.5], [0.1, 0.2, 0.3, 0.4, 0.5]])
    items = np.array([40, 30, 10, 20, 50])
    rows, it, sc, rk = topn_rows(scores, items, 2, threshold=1.0)
    # row 0: 7.0 at items 30 and 10 tie -> smaller item first; row 1: nothing above threshold
    assert rows.tolist() == [0, 0]
    assert it.tolist() == [10, 30]
    assert sc.tolist() == [7.0, 7.0]
    assert rk.tolist() == [1, 2]


def test_topn_rows_reports_score_over_threshold():
    rows, it, sc, rk = topn_rows(np.array([[4.0, 6.0]]), np.array([1, 2]), 5, threshold=2.0)
    assert it.tolist() == [2, 1] and sc.tolist() == [3.0, 2.0] and rk.tolist() == [1, 2]


def test_pruned_topn_equals_topn():
    rng = np.random.default_rng(7)
    for trial in range(60):
        m, items, k, n = rng.integers(1, 40), rng.integers(1, 300), rng.integers(1, 6), rng.integers(1, 7)
        scale = np.sort(rng.random(k))[::-1] * (rng.random(k) > 0.2)
        u = rng.integers(-3, 4, (m, k)).astype(float)  # many ties
        v = rng.integers(-3, 4, (items, k)).astype(float) * np.exp(rng.normal(size=(items, 1)) * (trial % 3)).round(1)
        if trial % 5 == 0:
            u[0] = np.nan
        ids = rng.permutation(10 * items)[:items]
        u3 = u * scale
        seen = rng.random((m, items)) < (0.3 if trial % 2 else 0.0)
        where = {int(x): i for i, x in enumerate(ids)}

        def mask(scores, rows, here):
            scores[seen[rows][:, [where[int(x)] for x in here]]] = -np.inf

        full = np.where(seen, -np.inf, u3 @ v.T)
        want = topn_rows(full, ids, n, 0.5, scaled=False)
        got = topn_pruned(u3, v, scale, ids, n, 0.5, mask, chunk=16, cells=64)
        key = lambda x: sorted(zip(x[0].tolist(), x[3].tolist(), np.round(x[2], 9).tolist()))
        assert key(got) == key(want)
        pairs = {(r, i): s for r, i, s in zip(*(x.tolist() for x in got[:3]))}
        assert len(pairs) == len(got[0]) and all(abs(full[r, where[i]] - s) < 1e-9 for (r, i), s in pairs.items())
        assert got[4] <= m * items


def test_pruning_leaves_out_most_items_of_a_popular_few():
    rng = np.random.default_rng(1)
    u, v = np.abs(rng.normal(size=(500, 8))), np.abs(rng.normal(size=(20_000, 8))) / np.arange(1, 20_001)[:, None]
    got = topn_pruned(u, v, np.ones(8), np.arange(20_000), 10, 1e-6)
    assert got[4] < 0.1 * 500 * 20_000
    want = topn_rows(u @ v.T, np.arange(20_000), 10, 1e-6, scaled=False)
    assert np.array_equal(got[0], want[0]) and np.array_equal(got[1], want[1])


def test_products_do_not_depend_on_the_batch():
    from skinnyqr.operators.tsqr import times

    rng = np.random.default_rng(0)
    for n, k in ((2, 1), (5, 3), (25, 25), (64, 8), (100, 60)):
        a, m = rng.normal(size=(700, n)), rng.normal(size=(n, k)) * 10.0 ** rng.integers(-6, 6, (n, 1))
        want = times(a, (m, np.eye(k)))
        assert np.allclose(want, a @ m, rtol=1e-9, atol=1e-6 * np.abs(a @ m).max())
        for lo in (1, 17, 255, 256, 699):
            assert np.array_equal(times(a[lo:], (m, np.eye(k))), want[lo:])
