"""Nothing is lost, rounded or reordered without notice."""

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from skinnyqr.operators.recommend import recommend, recommend_split
from skinnyqr.operators.ssvd import random_projection
from skinnyqr.operators.tsqr import qr_residual, tall_skinny_qr
from skinnyqr.sources.dense import parse_dense_lines
from skinnyqr.sources.ratings import parse_rating_lines


def _lines(spark, *lines):
    return spark.createDataFrame([(x,) for x in lines], "value string")


def test_both_recommender_plans_rank_on_the_raw_score(spark):
    low = 6.1
    while low / 3 != np.nextafter(low, 9) / 3:  # two scores that the division makes equal
        low = np.nextafter(low, 9)
    low, high = float(low), float(np.nextafter(low, 9))
    u = spark.createDataFrame([(1, [1.0])], "user_id long, u array<double>")
    v = spark.createDataFrame([(1, [low]), (2, [high])], "item_id long, v array<double>")
    for out in (
        recommend(u, v, [1.0], n=1, threshold=3.0),
        recommend(u, v, [1.0], n=1, threshold=3.0, max_broadcast_bytes=1),
        recommend_split(u, v, [1.0], n=1, threshold=3.0, n_splits=2),
    ):
        assert [tuple(r)[:3] for r in out.collect()] == [(1, 2, high / 3)]
    for plan in (recommend, recommend_split):
        with pytest.raises(ValueError):
            plan(u, v, [1.0], n=0)


def test_exclude_with_items_that_v_lacks(spark):
    u = spark.createDataFrame([(1, [1.0])], "user_id long, u array<double>")
    v = spark.createDataFrame([(1, [2.0]), (2, [3.0])], "item_id long, v array<double>")
    seen = spark.range(5000).select(F.lit(1).cast("long").alias("user_id"), (F.col("id") + 2).alias("item_id"))
    for plan in (recommend, recommend_split):
        assert [(r["item_id"], r["score"]) for r in plan(u, v, [1.0], exclude=seen).collect()] == [(1, 2.0)]


def test_rating_lines_raise_by_default_and_drops_are_counted(spark):
    lines = _lines(spark, "\t1 2 3.0", "1|2|-3.5", "no numbers", "  ", "4 5")
    with pytest.raises(Exception, match="malformed"):
        parse_rating_lines(lines).collect()
    seen = Observation()
    got = parse_rating_lines(lines, on_bad="drop", observation=seen).collect()
    assert sorted(tuple(r) for r in got) == [(1, 2, -3.5), (1, 2, 3.0)]
    assert seen.get == {"bad_lines": 2}


def test_dense_ids_beyond_double_and_tabs_at_line_ends(spark):
    lines = _lines(spark, "9007199254740993\t1\t2\t", "9007199254740992 3 4", "\t5.0 6 7")
    got = parse_dense_lines(lines, id_mode="first_field", width=2).collect()
    assert sorted((r["row_id"], tuple(r["v"])) for r in got) == [(5, (6.0, 7.0)), (9007199254740992, (3.0, 4.0)), (9007199254740993, (1.0, 2.0))]
    with pytest.raises(Exception, match="malformed"):
        parse_dense_lines(_lines(spark, "1.5 2 3"), id_mode="first_field").collect()


def test_a_line_is_split_once(spark):
    lines = _lines(spark, "1 2 3")
    for df in (parse_dense_lines(lines, id_mode="first_field"), parse_rating_lines(lines)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("split(") == 1, plan


def test_an_item_that_the_omega_table_lacks_raises(spark):
    a = spark.createDataFrame([(1, 1, 1.0), (2, 9, 1.0)], "user_id long, item_id long, rating double")
    om = spark.createDataFrame([(1, [1.0, 2.0])], "item_id long, w array<double>")
    assert random_projection(a.filter("item_id = 1"), 2, omega_table=om).first()["y"] == [1.0, 2.0]
    with pytest.raises(Exception, match="Omega"):
        random_projection(a, 2, omega_table=om).collect()


def test_the_residual_reports_lost_rows(spark):
    rng = np.random.default_rng(3)
    a = spark.createDataFrame([(i, rng.normal(size=3).tolist()) for i in range(40)], "row_id long, v array<double>")
    res = tall_skinny_qr(a, "row_id", "v", block_rows=8)
    some = qr_residual(a, res.q.filter("row_id % 2 = 0"), res.r_matrix()).first()
    assert (some["n_rows"], some["missing"]) == (20, 20) and some["residual"] < 1e-12
    more = qr_residual(a.filter("row_id < 30"), res.q, res.r_matrix()).collect()
    assert {(r["block"], r["n_rows"], r["missing"]) for r in more} == {(0, 30, 0), (None, 0, 10)}
    none = qr_residual(a, res.q.filter("false"), res.r_matrix()).first()
    assert none["residual"] is None and none["missing"] == 40
