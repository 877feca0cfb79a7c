import numpy as np
import pytest
from pyspark.sql import functions as F

from skinnyqr import (
    at_times_q,
    gram_matrix,
    merge_topn,
    random_projection,
    recommend,
    recommend_split,
    score_pairs,
    stochastic_svd,
    top_n,
)


def _ratings(rng, users=60, items=8, density=0.5, integer=True):
    rows = []
    for u in range(users):
        for i in range(items):
            if rng.random() < density:
                rows.append((u, 100 + i, float(rng.integers(1, 6)) if integer else float(rng.random())))
    return rows


def _dense(rows, users, items):
    a = np.zeros((users, items))
    for u, i, r in rows:
        a[u, i - 100] = r
    return a


def _uv(res):
    u = {r[0]: np.array(r[1]) for r in res.u.collect()}
    v = {r[0]: np.array(r[1]) for r in res.v.collect()}
    return u, v


@pytest.fixture(scope="module")
def small(spark):
    rng = np.random.default_rng(0)
    rows = _ratings(rng)
    df = spark.createDataFrame(rows, "user_id long, item_id long, rating double")
    return rows, df


def test_full_rank_svd_reconstructs(small):
    rows, df = small
    res = stochastic_svd(df, k=8, p=0, block_rows=16)
    a = _dense(rows, 60, 8)
    u, v = _uv(res)
    s = res.sigma[:8]
    assert np.allclose(sorted(np.linalg.svd(a, compute_uv=False), reverse=True), s)
    for uu, i, r in rows:
        assert abs(u[uu] @ np.diag(s) @ v[i] - r) < 1e-9


def test_oversampling_above_rank_has_no_nan(spark):
    # H8: k + p above the rank must not produce NaN factors
    rng = np.random.default_rng(1)
    b = rng.normal(size=(40, 2))
    a = b @ rng.normal(size=(2, 6))
    rows = [(u, 100 + i, float(a[u, i])) for u in range(40) for i in range(6)]
    df = spark.createDataFrame(rows, "user_id long, item_id long, rating double")
    res = stochastic_svd(df, k=4, p=2)
    u, v = _uv(res)
    assert all(np.isfinite(x).all() for x in list(u.values()) + list(v.values()))
    s = res.sigma
    assert np.sum(s > 1e-8 * s[0]) == 2
    for uu in range(40):
        for i in range(6):
            assert abs(u[uu] @ np.diag(s[:4]) @ v[100 + i] - a[uu, i]) < 1e-8


def test_half_sigma_and_flags(small):
    rows, df = small
    res = stochastic_svd(df, k=8, p=0, u_half_sigma=True, v_half_sigma=True)
    u, v = _uv(res)
    for uu, i, r in rows[:50]:
        assert abs(u[uu] @ v[i] - r) < 1e-9
    none = stochastic_svd(df, k=3, p=2, compute_u=False, compute_v=False)
    assert none.u is None and none.v is None and none.sigma.size == 5


def test_random_projection_with_table_and_hash(spark, small):
    rows, df = small
    om = spark.createDataFrame([(100 + i, [float(i + c) for c in range(3)]) for i in range(8)], "item_id long, w array<double>")
    y = {r[0]: r[1] for r in random_projection(df, 3, omega_table=om).collect()}
    a = _dense(rows, 60, 8)
    omega = np.array([[i + c for c in range(3)] for i in range(8)], dtype=float)
    for uu, vec in y.items():
        assert np.allclose(vec, a[uu] @ omega)
    yh = random_projection(df, 4, seed=5).collect()
    assert all(len(r["y"]) == 4 for r in yh)


def test_at_times_q_and_gram(spark, small):
    rows, df = small
    q = spark.createDataFrame([(u, [float(u), 1.0]) for u in range(60)], "user_id long, q array<double>")
    bt = {r[0]: np.array(r[1]) for r in at_times_q(df, q, 2).collect()}
    a = _dense(rows, 60, 8)
    qm = np.array([[u, 1.0] for u in range(60)])
    for i, vec in bt.items():
        assert np.allclose(vec, (a.T @ qm)[i - 100])
    g = gram_matrix(spark.createDataFrame([(i, [float(x) for x in a[i]]) for i in range(60)], "id long, x array<double>"), "x")
    assert np.allclose(g, a.T @ a)


def _brute_topn(scores, items, n, threshold):
    out = {}
    for u, row in scores.items():
        cand = [(s / threshold, it) for it, s in zip(items, row) if s > threshold and not np.isnan(s)]
        cand.sort(key=lambda x: (-x[0], x[1]))
        if cand:
            out[u] = [it for _, it in cand[:n]]
    return out


def test_recommenders_match_brute_force(small):
    rows, df = small
    res = stochastic_svd(df, k=8, p=0)
    u, v = _uv(res)
    s3 = res.sigma[:8] ** 3
    items = sorted(v)
    scores = {uu: [u[uu] @ (s3 * v[i]) for i in items] for uu in u}
    thr = float(np.median([x for r in scores.values() for x in r]))
    expect = _brute_topn(scores, items, 3, thr)
    got = {}
    for r in recommend(res.u, res.v, res.sigma, n=3, threshold=thr).orderBy("user_id", "rank").collect():
        got.setdefault(r["user_id"], []).append(r["item_id"])
    assert got == expect
    # forcing the split plan through the size check gives the same result
    forced = recommend(res.u, res.v, res.sigma, n=3, threshold=thr, max_broadcast_bytes=100)
    got2 = {}
    for r in forced.orderBy("user_id", "rank").collect():
        got2.setdefault(r["user_id"], []).append(r["item_id"])
    assert got2 == expect
    split = recommend_split(res.u, res.v, res.sigma, n=3, threshold=thr, n_splits=3, user_block_rows=7).collect()
    got3, empty = {}, set()
    for r in sorted(split, key=lambda r: (r["user_id"], r["rank"] or 0)):
        if r["item_id"] is None:
            empty.add(r["user_id"])
        else:
            got3.setdefault(r["user_id"], []).append(r["item_id"])
    assert got3 == expect
    assert empty == set(u) - set(expect)


def test_threshold_must_be_positive(small):
    _, df = small
    res = stochastic_svd(df, k=2, p=1)
    with pytest.raises(ValueError):
        recommend(res.u, res.v, res.sigma, threshold=0)


def test_score_pairs_equals_dense(small):
    rows, df = small
    res = stochastic_svd(df, k=8, p=0)
    a = _dense(rows, 60, 8)
    expect = a @ a.T @ a
    for r in score_pairs(res.u, res.v, res.sigma, df).collect():
        assert abs(r["score"] - expect[r["user_id"], r["item_id"] - 100]) < 1e-6 * max(1.0, abs(r["score"]))


def test_top_n_and_merge(spark):
    rows = [(u, e, float((u * 7 + e * 3) % 5)) for u in range(5) for e in range(20)]
    df = spark.createDataFrame(rows, "user_id long, event_id long, value double")
    full = top_n(df, "user_id", "value", 4, tiebreak="event_id")
    a = top_n(df.filter(F.col("event_id") < 10), "user_id", "value", 4, tiebreak="event_id")
    b = top_n(df.filter(F.col("event_id") >= 10), "user_id", "value", 4, tiebreak="event_id")
    merged = merge_topn(a, b, "user_id", "value", 4, tiebreak="event_id")
    key = lambda d: sorted((r["user_id"], r["event_id"], r["rank"]) for r in d.collect())
    assert key(full) == key(merged)
    for uu in range(5):
        mine = sorted([r for r in rows if r[0] == uu], key=lambda r: (-r[2], r[1]))[:4]
        got = sorted([r for r in full.collect() if r["user_id"] == uu], key=lambda r: r["rank"])
        assert [r[1] for r in mine] == [r["event_id"] for r in got]


def test_split_plan_with_many_partitions(spark, small):
    # regression: co-group sides must be co-partitioned when AQE cannot
    # coalesce everything into one partition
    rows, df = small
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        res = stochastic_svd(df.repartition(8), k=8, p=0, block_rows=8)
        u, v = _uv(res)
        s3 = res.sigma[:8] ** 3
        items = sorted(v)
        scores = {uu: [u[uu] @ (s3 * v[i]) for i in items] for uu in u}
        expect = _brute_topn(scores, items, 2, 1.0)
        got = {}
        rec = recommend_split(res.u.repartition(8), res.v, res.sigma, n=2, threshold=1.0, n_splits=3, user_block_rows=5)
        for r in rec.orderBy("user_id", "rank").collect():
            if r["item_id"] is not None:
                got.setdefault(r["user_id"], []).append(r["item_id"])
        assert got == expect
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_dense_svd_matches_numpy(spark):
    from skinnyqr import stochastic_svd_dense

    rng = np.random.default_rng(4)
    a = rng.normal(size=(150, 6)) @ np.diag([5.0, 3.0, 2.0, 1.0, 0.5, 0.1])
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(a)], "row_id long, v array<double>")
    res = stochastic_svd_dense(df, k=6, p=0, block_rows=40)
    assert np.allclose(res.sigma, np.linalg.svd(a, compute_uv=False))
    u = {r[0]: np.array(r[1]) for r in res.u.collect()}
    v = {r[0]: np.array(r[1]) for r in res.v.collect()}
    recon = np.array([u[i] for i in range(150)]) @ np.diag(res.sigma) @ np.array([v[j] for j in range(6)]).T
    assert np.allclose(recon, a)
    low = stochastic_svd_dense(df, k=2, p=3)
    assert np.allclose(low.sigma[:2], np.linalg.svd(a, compute_uv=False)[:2], rtol=1e-2)


def test_reliable_svd_checkpoints_and_matches(spark, small):
    rows, df = small
    plain = stochastic_svd(df, k=8, p=0)
    rel = stochastic_svd(df, k=8, p=0, reliable=True)
    assert np.allclose(plain.sigma, rel.sigma)
    a, b = _uv(plain), _uv(rel)
    for uu, i, r in rows[:40]:
        assert abs(b[0][uu] @ np.diag(rel.sigma[:8]) @ b[1][i] - r) < 1e-9


def test_exclude_seen_items(spark, small):
    rows, df = small
    res = stochastic_svd(df, k=8, p=0)
    u, v = _uv(res)
    s3 = res.sigma[:8] ** 3
    items = sorted(v)
    seen = {}
    for uu, i, _ in rows:
        seen.setdefault(uu, set()).add(i)
    expect = {}
    for uu in u:
        cand = [(float(u[uu] @ (s3 * v[i])), i) for i in items if i not in seen.get(uu, set())]
        cand = [(sc, i) for sc, i in cand if sc > 1.0]
        cand.sort(key=lambda x: (-x[0], x[1]))
        if cand:
            expect[uu] = [i for _, i in cand[:3]]

    def lists(d):
        out = {}
        for r in d.orderBy("user_id", "rank").collect():
            if r["item_id"] is not None:
                out.setdefault(r["user_id"], []).append(r["item_id"])
        return out

    assert lists(recommend(res.u, res.v, res.sigma, n=3, exclude=df)) == expect
    assert lists(recommend_split(res.u, res.v, res.sigma, n=3, n_splits=3, user_block_rows=9, exclude=df)) == expect


def test_svd_invariant_to_partitioning_and_blocks(spark, small):
    rows, df = small
    a = stochastic_svd(df.repartition(1), k=8, p=0)
    b = stochastic_svd(df.repartition(7), k=8, p=0, block_rows=9, schedule=[3, 1])
    assert np.allclose(a.sigma, b.sigma)
    ua, va = _uv(a)
    ub, vb = _uv(b)
    # factors are unique up to the sign convention, which is fixed
    for uu in ua:
        assert np.allclose(ua[uu], ub[uu], atol=1e-9)
    for i in va:
        assert np.allclose(va[i], vb[i], atol=1e-9)


def test_no_items_gives_no_recommendations(spark):
    u = spark.createDataFrame([(1, [1.0, 2.0]), (2, [0.5, 0.1])], "user_id long, u array<double>")
    v = spark.createDataFrame([], "item_id long, v array<double>")
    assert recommend(u, v, [3.0, 1.0], n=2).count() == 0
    rows = recommend_split(u, v, [3.0, 1.0], n=2).collect()
    assert sorted(r["user_id"] for r in rows) == [1, 2] and all(r["item_id"] is None for r in rows)
