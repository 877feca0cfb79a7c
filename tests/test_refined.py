"""Map-only refined QR, singular values from R of B^t, committed factor sets, stable text row ids, the block generator."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from skinnyqr import stochastic_svd, stochastic_svd_dense, tall_skinny_qr
from skinnyqr.operators import ssvd, tsqr
from skinnyqr.operators.ssvd import dense_at_times_q, svd_certificate
from skinnyqr.sinks import write_factors
from skinnyqr.sources import committed_versions, numbered_lines, read_dense_text, read_factors
from skinnyqr.sources.synthetic import PRIME, random_r_blocks, step

SIGMA = np.array([1e3, 10, 1, 1e-3, 1e-6, 0, 0, 0])


def _with_sigma(m, sigma, seed=0):
    rng = np.random.default_rng(seed)
    u, _ = np.linalg.qr(rng.normal(size=(m, len(sigma))))
    v, _ = np.linalg.qr(rng.normal(size=(len(sigma), len(sigma))))
    return u * sigma @ v.T


def _dense(spark, a, parts=5):
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(a)]
    return spark.createDataFrame(rows, "row_id long, v array<double>").repartition(parts)


def _coo(spark, a):
    rows = [(i, 10 * j, float(x)) for i, r in enumerate(a) for j, x in enumerate(r)]
    return spark.createDataFrame(rows, "user_id long, item_id long, rating double").repartition(4)


def _matrix(df, key, col, m):
    got = {r[key]: r[col] for r in df.collect()}
    return np.array([got[i] for i in m])


@pytest.mark.parametrize("condition", [1.0, 1e6, 1e10])
@pytest.mark.parametrize("schedule", [None, [3, 1]])
def test_refined_q_is_orthonormal(spark, condition, schedule):
    a = _with_sigma(300, np.geomspace(1, 1 / condition, 12))
    res = tall_skinny_qr(_dense(spark, a), "row_id", "v", method="refined", schedule=schedule)
    q, r = _matrix(res.q, "row_id", "q", range(300)), res.r_matrix()
    assert np.abs(q.T @ q - np.eye(12)).max() < 1e-13
    assert np.abs(q @ r - a).max() < 1e-13 * np.abs(a).max() * 12
    assert np.all(np.diag(r) >= 0) and np.allclose(r, np.triu(r))


def test_refined_q_never_moves_the_matrix(spark):
    a = np.random.default_rng(1).normal(size=(200, 5))
    res = tall_skinny_qr(_dense(spark, a).select("row_id", "v"), "row_id", "v")
    plan = res.q._jdf.queryExecution().executedPlan().toString()
    above_input = plan.split("MapInArrow", 1)[1].split("REPARTITION_BY_NUM")[0]  # the test's own repartition is the input
    assert above_input.count("Exchange") == 1 and "InMemoryTableScan" not in plan
    assert not res._held


def test_beyond_one_refinement_the_direct_tree_is_used(spark, monkeypatch):
    a = _with_sigma(120, np.geomspace(1, 1e-14, 6))
    calls = []
    monkeypatch.setattr(tsqr, "_refined_qr", lambda *x, f=tsqr._refined_qr: calls.append(f(*x)) or calls[-1])
    res = tall_skinny_qr(_dense(spark, a), "row_id", "v", block_rows=30, method="refined")
    q = _matrix(res.q, "row_id", "q", range(120))
    assert calls == [None] and np.abs(q.T @ q - np.eye(6)).max() < 1e-13
    badly_scaled = np.random.default_rng(3).normal(size=(100, 4)) * [1e150, 1, 1e-150, 1e-20]  # not ill-conditioned
    assert tsqr.scaled_inverse(np.linalg.qr(badly_scaled)[1]) is not None


@pytest.mark.parametrize("dense", [False, True])
def test_small_singular_values(spark, dense):
    a = _with_sigma(60, SIGMA)
    res = stochastic_svd_dense(_dense(spark, a), 8, 0) if dense else stochastic_svd(_coo(spark, a), 8, 0)
    assert np.abs(res.sigma - SIGMA).max() <= 1e-12 * SIGMA[0]
    assert (res.sigma[5:] == 0).all() and (res.sigma[:5] > 0).all()
    assert abs(res.sigma[4] - 1e-6) < 1e-9
    items = range(8) if dense else range(0, 80, 10)
    v = _matrix(res.v, "item_id", "v", items)
    u = _matrix(res.u, "row_id" if dense else "user_id", "u", range(60))
    want = np.diag([1.0] * 5 + [0.0] * 3)
    assert np.abs(v.T @ v - want).max() < 1e-12 and np.abs(u.T @ u - want).max() < 1e-12
    assert np.abs(u * res.sigma @ v.T - a).max() < 1e-10


def test_truncation_and_certificate(spark):
    a = _with_sigma(80, np.array([50.0, 20, 9, 4, 2, 1, 0.5, 0.2]))
    ratings = _coo(spark, a)
    res = stochastic_svd(ratings, 3, 5)
    rows = {r["j"]: r for r in svd_certificate(ratings, res).collect()}
    assert sorted(rows) == [0, 1, 2] and all(r["residual"] < 1e-10 and abs(r["length"] - 1) < 1e-12 for r in rows.values())
    wrong = stochastic_svd(ratings, 3, 0)  # three directions of eight: not the singular ones
    assert max(r["residual"] for r in svd_certificate(ratings, wrong).collect()) > 1e-6


def test_zero_and_empty_matrices(spark):
    zero = stochastic_svd(_coo(spark, np.zeros((5, 3))), 2, 1)
    assert (zero.sigma == 0).all() and all(x == [0.0, 0.0] for x in (r["u"] for r in zero.u.collect()))
    assert len(zero.v.first()["v"]) == 2
    with pytest.raises(ValueError):
        stochastic_svd(_coo(spark, np.zeros((0, 3))), 2, 1)


def test_dense_svd_reads_the_matrix_where_it_lies(spark):
    a = _dense(spark, _with_sigma(60, SIGMA)).select(F.col("v").alias("_v"))
    plan = dense_at_times_q(a, 8, (np.eye(8)[:, :3],), 3)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    below = plan.split("MapInArrow", 1)[1]
    assert below.count("Exchange") == 1  # the test's own repartition
    res = stochastic_svd_dense(_dense(spark, _with_sigma(60, SIGMA)), 3, 2)
    plan = res.u._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "InMemoryTableScan" not in plan and plan.count("Exchange") == 1


def test_factor_sets_are_committed_whole(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "set")
    frame = lambda x, key: spark.createDataFrame([(1, [x])], f"{key} long, f array<double>")
    with pytest.raises(FileNotFoundError):
        read_factors(spark, path)
    write_factors(spark, frame(1.0, "user_id"), frame(1.0, "item_id"), [1.0], path)
    u1, v1, _ = read_factors(spark, path)
    # a write that fails half-way (here: V raises) leaves the old set as it was
    bad = frame(2.0, "item_id").withColumn("f", F.raise_error(F.lit("lost")).cast("array<double>"))
    with pytest.raises(Exception, match="lost"):
        write_factors(spark, frame(2.0, "user_id"), bad, [2.0], path)
    u, v, sigma = read_factors(spark, path)
    assert (u.first()["f"], v.first()["f"], sigma.tolist()) == ([1.0], [1.0], [1.0])
    # from its own tables, and without U: U is absent afterwards, not the old one
    write_factors(spark, None, v.withColumn("f", F.transform("f", lambda x: x + 2)), [3.0, 2.0], path)
    u, v, sigma = read_factors(spark, path)
    assert u is None and v.first()["f"] == [3.0] and sigma.tolist() == [3.0, 2.0]
    assert u1.first()["f"] == [1.0] and v1.first()["f"] == [1.0]  # readers of the set before can finish
    for x in (4.0, 5.0):
        write_factors(spark, frame(x, "user_id"), None, [x], path)
    assert len(os.listdir(os.path.join(path, "versions"))) <= 3  # two kept sets and the one that was never committed
    assert committed_versions(spark, path)[0]["seq"] == 4
    with pytest.raises(FileExistsError):
        write_factors(spark, None, None, [1.0], path, mode="error")


@pytest.mark.parametrize("split", ["1k", "7k", "64m"])
def test_line_numbers_do_not_depend_on_splits(spark, tmpdir_path, split):
    rng = np.random.default_rng(4)
    want = []
    for name in ("a.txt", "b.txt", "c.txt"):
        lines = ["" if rng.random() < 0.1 else " ".join(str(x) for x in rng.integers(0, 99, rng.integers(1, 40))) for _ in range(400)]
        want += lines
        with open(os.path.join(tmpdir_path, name), "w") as f:
            f.write("\n".join(lines) + ("\n" if name != "c.txt" else ""))
    open(os.path.join(tmpdir_path, "empty.txt"), "w").close()
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, split)
    try:
        got = {r["line_id"]: r["value"] for r in numbered_lines(spark, tmpdir_path).collect()}
        assert [got[i] for i in range(len(want))] == want and len(got) == len(want)
        rows = {r["row_id"]: r["v"] for r in read_dense_text(spark, tmpdir_path, id_mode="line_number").collect()}
        assert rows == {i: [float(x) for x in t.split()] for i, t in enumerate(want) if t}
        late = numbered_lines(spark, tmpdir_path)
        spark.conf.set(key, "2500b")  # other splits than those counted
        with pytest.raises(Exception, match="was not counted"):
            late.count()
    finally:
        spark.conf.set(key, before)


def test_generator_is_a_counter(spark):
    assert len(set(step(np.arange(5000, dtype=np.int64)).tolist())) == 5000
    keys = [0, 1, -5, PRIME, PRIME + 1, 2**62, -(2**62)]
    df = spark.createDataFrame([(k,) for k in keys] + [(None,)], "k long").repartition(3)
    got = {r["node"]: r["r"] for r in random_r_blocks(df, "k", 3, seed=7).collect()}

    def f(x):
        return pow(x, 5, PRIME) * 48271 % PRIME

    for k in keys:
        x = f((f((f(8) + k % PRIME) % PRIME) + (k // PRIME) % PRIME) % PRIME)
        assert got[k] == [f((x + c) % PRIME) / PRIME if c % 3 >= c // 3 else 0.0 for c in range(9)]
    assert len(got) == len(keys)


def test_last_rating_of_equal_times_is_the_largest(spark):
    from skinnyqr.sources.ratings import dedupe_ratings

    df = spark.createDataFrame([(1, 1, 5.0, 9), (1, 1, 7.0, 9), (1, 1, 99.0, 3)], "user_id long, item_id long, rating double, t long").repartition(3)
    assert dedupe_ratings(df, "last", order_col="t").first()["rating"] == 7.0


def _random_ratings(spark, users=60, items=25, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(int(u) - 30, int(i) * 7, float(rng.integers(-4, 6))) for u in range(users) for i in range(items) if rng.random() < 0.3 or u == 5]
    return rows, spark.createDataFrame(rows, "user_id long, item_id long, rating double").repartition(6)


@pytest.mark.parametrize("heavy", [False, True])
def test_layout_svd_equals_numpy(spark, monkeypatch, heavy):
    """One exchange of cells; with salted users and tiny chunks too."""
    if heavy:
        monkeypatch.setattr(ssvd, "HEAVY_CELLS", 3)
        monkeypatch.setattr(ssvd, "LAYOUT_BYTES", 24 * 8)
        monkeypatch.setattr(ssvd, "CHUNK_CELLS", 4)
        monkeypatch.setattr(ssvd, "HELD_BYTES", 200)
    rows, df = _random_ratings(spark)
    a = np.zeros((60, 25))
    for u, i, r in rows:
        a[u + 30, i // 7] += r
    cells, salted = ssvd.user_layout(df, "user_id", "item_id", "rating")
    assert bool(salted) == heavy and cells.count() == len(rows)
    res = stochastic_svd(df, 25, 0)
    want = np.linalg.svd(a)[1]
    assert np.allclose(res.sigma, want, atol=1e-9)
    u = {r["user_id"]: r["u"] for r in res.u.collect()}
    v = {r["item_id"]: r["v"] for r in res.v.collect()}
    back = np.array([[np.dot(np.array(u[x - 30]) * res.sigma, v[7 * i]) if x - 30 in u and 7 * i in v else 0.0 for i in range(25)] for x in range(60)])
    assert np.abs(back - a).max() < 1e-9


def test_layout_svd_equals_joined_svd(spark):
    rows, df = _random_ratings(spark, seed=9)
    named = df.select(F.col("user_id").cast("string").alias("user_id"), "item_id", "rating")
    one, two = stochastic_svd(df, 25, 0), stochastic_svd(named, 25, 0)
    assert np.allclose(one.sigma, two.sigma, atol=1e-9)


def test_cells_are_exchanged_once(spark):
    _, df = _random_ratings(spark)
    cells, heavy = ssvd.user_layout(df, "user_id", "item_id", "rating")
    y = ssvd.layout_projection(cells, heavy, 4, 1, "user_id")
    plan = y._jdf.queryExecution().executedPlan().toString()
    assert "InMemoryTableScan" in plan and "Exchange" not in plan.split("InMemoryRelation")[0]
    bt = ssvd.layout_at_times_q(cells, {}, 4, 1, (np.eye(4),), 4, "item_id")
    above = bt._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]
    assert above.count("Exchange") == 1 and "Join" not in above  # the sums by item only
    assert "partial_sum" in above


def test_cells_with_nulls_are_none(spark):
    df = spark.createDataFrame([(1, 1, 2.0), (1, None, 5.0), (None, 1, 5.0), (2, 2, None), (3, 2, 1.0)], "user_id long, item_id long, rating double")
    res = stochastic_svd(df, 2, 0)
    assert np.allclose(res.sigma, [2.0, 1.0]) and sorted(r["user_id"] for r in res.u.collect()) == [1, 3]
