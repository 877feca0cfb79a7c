"""A hot key holding a third of all rows must not change results (or need one giant group)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skinnyqr import recommend, recommend_split, score_pairs, stochastic_svd, tall_skinny_r, top_n
from skinnyqr.operators import ssvd
from skinnyqr.sources.ratings import dedupe_ratings, user_rows


@pytest.fixture()
def skew_conf(spark):
    keys = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.0",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
    }
    old = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def test_hot_user_svd_and_recommend(spark, skew_conf):
    rng = np.random.default_rng(0)
    items = 12
    events = []
    # user 0: every item, repeated -> a third of all events
    for rep in range(40):
        for i in range(items):
            events.append((0, 100 + i, 1.0 + (i % 3)))
    for u in range(1, 240):
        for i in rng.choice(items, size=4, replace=False):
            events.append((u, 100 + int(i), float(rng.integers(1, 5))))
    assert abs(sum(1 for e in events if e[0] == 0) / len(events) - 1 / 3) < 0.02
    df = spark.createDataFrame(events, "user_id long, item_id long, rating double").repartition(8)
    a = dedupe_ratings(df, "sum").persist()
    dense = np.zeros((240, items))
    for u, i, r in events:
        dense[u, i - 100] += r
    res = stochastic_svd(a, k=items, p=0)
    got = {(r["user_id"], r["item_id"]): r["score"] for r in score_pairs(res.u, res.v, res.sigma, a, power=1).collect()}
    for (u, i), val in got.items():
        assert abs(val - dense[u, i - 100]) < 1e-7 * max(1.0, dense.max())
    s = dense @ dense.T @ dense
    expect0 = sorted(range(items), key=lambda j: (-s[0, j], j))[:3]
    small = [r["item_id"] - 100 for r in recommend(res.u, res.v, res.sigma, n=3).filter("user_id = 0").orderBy("rank").collect()]
    split = [r["item_id"] - 100 for r in recommend_split(res.u, res.v, res.sigma, n=3, n_splits=3, user_block_rows=16)
             .filter("user_id = 0").orderBy("rank").collect()]
    assert small == expect0 and split == expect0


def test_hot_group_grouped_r_and_top_n(spark):
    rng = np.random.default_rng(1)
    rows = [(0 if i % 3 == 0 else int(rng.integers(1, 50)), float(x), float(y)) for i, (x, y) in
            enumerate(rng.normal(size=(3000, 2)))]
    df = spark.createDataFrame(rows, "g int, x double, y double").repartition(6)
    cells = {(c["i"], c["j"]): c["r"] for c in tall_skinny_r(df, ["x", "y"], by=["g"]).filter("g = 0").collect()}
    a0 = np.array([[x, y] for g, x, y in rows if g == 0])
    r0 = np.linalg.qr(a0, mode="r")
    r0 = r0 * np.where(np.diag(r0) < 0, -1, 1)[:, None]
    assert np.allclose([cells[(0, 0)], cells[(0, 1)], cells[(1, 1)]], [r0[0, 0], r0[0, 1], r0[1, 1]])
    ided = df.withColumn("id", F.monotonically_increasing_id())
    top = top_n(ided, "g", "x", 5, tiebreak="id").filter("g = 0").orderBy("rank").collect()
    assert [r["x"] for r in top] == sorted((x for g, x, y in rows if g == 0), reverse=True)[:5]


def test_user_rows_of_a_heavy_user_are_split(spark):
    """A user with a third of all ratings is dealt to segments; light users keep one row."""
    heavy = [(0, i, float(i)) for i in range(5000)]
    light = [(1 + u, i, 1.0) for u in range(200) for i in range(50)]
    df = spark.createDataFrame(heavy + light, "user_id long, item_id long, rating double").repartition(4)
    rows = user_rows(df, max_items=400).collect()
    mine = [r for r in rows if r["user_id"] == 0]
    assert len(mine) == 13 and max(len(r["items"]) for r in mine) < 500
    assert sorted(e["item_id"] for r in mine for e in r["items"]) == list(range(5000))
    assert len(rows) == 13 + 200 and all(r["segment"] == 0 for r in rows if r["user_id"])
    assert all([e["item_id"] for e in r["items"]] == sorted(e["item_id"] for e in r["items"]) for r in rows)


def test_gram_rounds(spark, monkeypatch):
    monkeypatch.setattr(ssvd, "GRAM_FANIN", 3)
    x = np.random.default_rng(0).normal(size=(500, 7))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "i long, x array<double>").repartition(23)
    assert np.allclose(ssvd.gram_matrix(df, "x"), x.T @ x)
    assert ssvd.gram_cells(df.filter("i < 0"), "x").count() == 0


def test_split_cogroup_scales_a_batch_of_users_at_a_time(spark):
    """A user block is held once: scaled copies are made of batches of SCORE_ROWS users."""
    from pyspark.sql import functions as F

    from skinnyqr.operators import recommend as R

    n = R.SCORE_ROWS * 5 // 2
    u = spark.range(n).select(F.col("id").alias("user_id"), F.array(F.lit(1.0), F.col("id") % 7 + 0.5).alias("u"))
    v = spark.createDataFrame([(1, [1.0, 0.5]), (2, [0.25, 2.0]), (3, [0.5, 0.5])], "item_id long, v array<double>")
    seen, score = spark.sparkContext.accumulator(0), R._score_block
    most = spark.sparkContext.accumulator(0)

    def counted(users, *args, **kw):
        seen.add(len(users))
        most.add(int(len(users) > R.SCORE_ROWS))
        return score(users, *args, **kw)

    R._score_block = counted
    try:
        skip = u.filter("user_id % 3 = 0").select("user_id", F.lit(2).cast("long").alias("item_id"))
        out = R.recommend_split(u, v, [2.0, 1.0], n=1, threshold=1e-9, n_splits=1, user_block_rows=n, exclude=skip)
        rows = {r["user_id"]: (r["item_id"], r["score"]) for r in out.collect()}
    finally:
        R._score_block = score
    assert seen.value == n and most.value == 0
    assert len(rows) == n
    for i in range(n):
        scores = {1: 8.0 + 0.5 * (i % 7 + 0.5), 2: 2.0 + 2.0 * (i % 7 + 0.5), 3: 4.0 + 0.5 * (i % 7 + 0.5)}
        if i % 3 == 0:
            del scores[2]
        item = max(scores, key=lambda x: (scores[x], -x))
        assert rows[i][0] == item and abs(rows[i][1] * 1e-9 - scores[item]) < 1e-9
