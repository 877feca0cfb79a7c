import numpy as np
import pytest
from pyspark.sql import functions as F

from skinnyqr import combine_r, qr_residual, tall_skinny_qr, tall_skinny_r
from skinnyqr.sources.synthetic import random_r_blocks


def _dense(spark, a, parts=4):
    rows = [(int(i), [float(x) for x in row]) for i, row in enumerate(a)]
    return spark.createDataFrame(rows, "row_id long, v array<double>").repartition(parts)


def _r_of(cells, n):
    r = np.zeros((n, n))
    for c in cells.collect():
        r[c["i"], c["j"]] = c["r"]
    return r


def _ref_r(a):
    r = np.linalg.qr(a, mode="r")
    return r * np.where(np.diag(r) < 0, -1.0, 1.0)[:, None]


def _q_of(res, m):
    q = dict((r[0], r[1]) for r in res.q.collect())
    return np.array([q[i] for i in range(m)])


@pytest.mark.parametrize("schedule", [None, [1], [4, 1], [16, 4, 1], [3]])
def test_r_matches_numpy_for_any_schedule(spark, schedule):
    a = np.random.default_rng(0).normal(size=(400, 5))
    r = _r_of(tall_skinny_r(_dense(spark, a, 7), "v", schedule=schedule, fanin=2), 5)
    assert np.allclose(r, _ref_r(a))


def test_r_from_numeric_columns_and_groups(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i % 3), float(x), float(y)) for i, (x, y) in enumerate(rng.normal(size=(300, 2)))]
    df = spark.createDataFrame(rows, "g int, x double, y double").repartition(5)
    cells = tall_skinny_r(df, ["x", "y"], by=["g"]).collect()
    for g in range(3):
        a = np.array([[x, y] for gg, x, y in rows if gg == g])
        r = np.zeros((2, 2))
        for c in cells:
            if c["g"] == g:
                r[c["i"], c["j"]] = c["r"]
        assert np.allclose(r, _ref_r(a))


@pytest.mark.parametrize("block_rows,schedule", [(16, None), (50, [4, 1]), (1000, None), (3, [2, 1])])
def test_direct_q_orthonormal_and_invariant(spark, block_rows, schedule):
    rng = np.random.default_rng(2)
    a = rng.normal(size=(200, 4))
    res = tall_skinny_qr(_dense(spark, a), "row_id", "v", block_rows=block_rows, schedule=schedule, fanin=3)
    q = _q_of(res, 200)
    r = res.r_matrix()
    assert np.allclose(q.T @ q, np.eye(4), atol=1e-12)
    assert np.allclose(q @ r, a, atol=1e-12)
    assert np.allclose(r, _ref_r(a))
    res.unpersist()


def test_direct_q_ill_conditioned_stays_orthonormal(spark):
    rng = np.random.default_rng(3)
    u, _ = np.linalg.qr(rng.normal(size=(300, 4)))
    a = u @ np.diag([1.0, 1e-4, 1e-8, 1e-11]) @ np.linalg.qr(rng.normal(size=(4, 4)))[0]
    res = tall_skinny_qr(_dense(spark, a), "row_id", "v", block_rows=40)
    q = _q_of(res, 300)
    assert np.abs(q.T @ q - np.eye(4)).max() < 1e-10


def test_one_block_and_fewer_rows_than_columns(spark):
    # H5: a single block; H7: block shorter than its column count
    a = np.random.default_rng(4).normal(size=(3, 5))
    res = tall_skinny_qr(_dense(spark, a, 1), "row_id", "v", block_rows=100)
    q = _q_of(res, 3)
    assert q.shape == (3, 3)
    assert np.allclose(q @ res.r_matrix()[:3], a)
    res2 = tall_skinny_qr(_dense(spark, np.vstack([a] * 4), 2), "row_id", "v", block_rows=2)
    assert np.allclose(_q_of(res2, 12) @ res2.r_matrix(), np.vstack([a] * 4))


def test_rank_deficient(spark):
    rng = np.random.default_rng(5)
    b = rng.normal(size=(100, 2))
    a = np.hstack([b, b[:, :1] * 2.0])
    res = tall_skinny_qr(_dense(spark, a), "row_id", "v", block_rows=17)
    q = _q_of(res, 100)
    assert np.allclose(q @ res.r_matrix(), a)


def test_indirect_matches_direct(spark):
    a = np.random.default_rng(6).normal(size=(150, 3))
    d = _dense(spark, a)
    q1 = _q_of(tall_skinny_qr(d, "row_id", "v", block_rows=20), 150)
    q2 = _q_of(tall_skinny_qr(d, "row_id", "v", method="indirect"), 150)
    assert np.allclose(q1, q2)


def test_empty_partitions_are_ignored(spark):
    # H6: partitions without rows produce no factor
    a = np.random.default_rng(7).normal(size=(5, 2))
    r = _r_of(tall_skinny_r(_dense(spark, a, 20), "v"), 2)
    assert np.allclose(r, _ref_r(a))


def test_empty_input_raises(spark):
    df = spark.createDataFrame([], "row_id long, v array<double>")
    with pytest.raises(ValueError):
        tall_skinny_qr(df, "row_id", "v")


def test_ragged_rows_raise(spark):
    # checked inside the block kernels, so the error surfaces when Q is computed
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0])], "row_id long, v array<double>")
    with pytest.raises(Exception, match="same length"):
        tall_skinny_qr(df, "row_id", "v").q.collect()
    with pytest.raises(Exception, match="same length|expected rows"):
        tall_skinny_r(df, "v").collect()


def test_residual_zero_and_detects_sign_errors(spark):
    a = np.random.default_rng(8).normal(size=(120, 3))
    d = _dense(spark, a)
    res = tall_skinny_qr(d, "row_id", "v", block_rows=30)
    r = res.r_matrix()
    out = qr_residual(d, res.q, r, "row_id", "v", block=F.floor(F.col("row_id") / 40), how="mean").collect()
    assert len(out) == 3 and max(x["residual"] for x in out) < 1e-12
    flipped = res.q.select("row_id", F.transform("q", lambda x: -x).alias("q"))
    bad = qr_residual(d, flipped, r, "row_id", "v", how="sum").collect()
    assert bad[0]["residual"] > 1.0


@pytest.mark.parametrize("schedule", [[1], [4, 1], [16, 4, 1]])
def test_combine_random_triangles_same_r(spark, schedule):
    keys = spark.range(0, 300).withColumnRenamed("id", "k")
    blocks = random_r_blocks(keys, "k", 6, seed=3)
    mats = [np.array(r["r"]).reshape(6, 6) for r in blocks.orderBy("node").collect()]
    assert all(np.allclose(m, np.triu(m)) for m in mats)
    assert all(((m >= 0) & (m < 1)).all() for m in mats)
    r = _r_of(combine_r(blocks, 6, schedule=schedule), 6)
    assert np.allclose(r, _ref_r(np.vstack(mats)))


def test_grouped_r_many_groups_flushes_partials(spark, monkeypatch):
    import skinnyqr.operators.tsqr as T

    # a tiny budget and small Arrow batches force many flushes per task
    monkeypatch.setattr(T, "PARTIAL_BYTES", 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    rng = np.random.default_rng(9)
    rows = [(int(i % 40), float(x), float(y), float(z)) for i, (x, y, z) in enumerate(rng.normal(size=(2000, 3)))]
    df = spark.createDataFrame(rows, "g int, x double, y double, z double").repartition(3)
    try:
        cells = tall_skinny_r(df, ["x", "y", "z"], by=["g"], fanin=3).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for g in (0, 17, 39):
        a = np.array([[x, y, z] for gg, x, y, z in rows if gg == g])
        r = np.zeros((3, 3))
        for c in cells:
            if c["g"] == g:
                r[c["i"], c["j"]] = c["r"]
        assert np.allclose(r, _ref_r(a))


def test_recompute_after_lost_cache_gives_same_q(spark):
    # losing cached blocks (as on executor loss) recomputes them from lineage;
    # blocks come from a hash of the row id, so the recomputed Q is the same
    a = np.random.default_rng(10).normal(size=(300, 4))
    res = tall_skinny_qr(_dense(spark, a, 6), "row_id", "v", block_rows=20, fanin=3)
    q1 = _q_of(res, 300)
    res.unpersist()
    spark.catalog.clearCache()
    q2 = _q_of(res, 300)
    assert np.allclose(q1, q2, atol=1e-13)
    assert np.allclose(q2 @ res.r_matrix(), a)


def test_sign_blind_residual_misses_sign_errors(spark):
    a = np.random.default_rng(11).normal(size=(50, 3))
    d = _dense(spark, a)
    res = tall_skinny_qr(d, "row_id", "v", block_rows=10)
    flipped = res.q.select("row_id", F.transform("q", lambda x: -x).alias("q"))
    blind = qr_residual(d, flipped, res.r_matrix(), "row_id", "v", how="sum", sign_blind=True).first()["residual"]
    assert blind < 1e-12


def test_duplicate_row_ids_rejected_on_request(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (0, [3.0, 4.0]), (1, [5.0, 7.0])], "row_id long, v array<double>")
    with pytest.raises(ValueError, match="unique"):
        tall_skinny_qr(df, "row_id", "v", check_unique=True)


def test_skewed_caller_blocks_are_split(spark):
    # one caller-defined block holds most rows: it is split by row-id hash
    a = np.random.default_rng(13).normal(size=(400, 3))
    rows = [(int(i), int(0 if i < 300 else i), [float(x) for x in r]) for i, r in enumerate(a)]
    df = spark.createDataFrame(rows, "row_id long, blk long, v array<double>")
    res = tall_skinny_qr(df, "row_id", "v", block_rows=50, block_col="blk")
    q = _q_of(res, 400)
    assert np.allclose(q.T @ q, np.eye(3))
    assert np.allclose(q @ res.r_matrix(), a)


@pytest.mark.parametrize("kind", ["plain", "cached", "union", "grouped"])
def test_factors_of_any_input_plan_under_default_confs(spark, kind):
    """R and both Q of inputs with and without an exchange below, with Spark's default for cached plans."""
    spark.conf.unset("spark.sql.optimizer.canChangeCachedPlanOutputPartitioning")
    base = spark.range(1000).select(
        F.col("id"), F.array((F.col("id") % 17).cast("double"), (F.col("id") % 5).cast("double") + 1).alias("v"))
    df = {
        "plain": base,
        "cached": base.repartition(7).cache(),
        "union": base.filter("id < 300").union(base.filter("id >= 300")),
        "grouped": base.groupBy("id").agg(F.first("v").alias("v")),
    }[kind]
    a = np.array([r["v"] for r in base.collect()])
    gram = a.T @ a
    cells = tall_skinny_r(df, "v").persist()
    assert cells.count() == 3
    r = np.zeros((2, 2))
    for c in cells.collect():
        r[c["i"], c["j"]] = c["r"]
    np.testing.assert_allclose(r.T @ r, gram, rtol=1e-9)
    for method in ("indirect", "direct"):
        q = np.array([x["q"] for x in tall_skinny_qr(df, "id", "v", method=method).q.collect()])
        assert q.shape == (1000, 2)
        np.testing.assert_allclose(q.T @ q, np.eye(2), atol=1e-9)
