"""Regression guards for the physical plans the scale design relies on."""

import os
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from skinnyqr import random_projection, recommend, stochastic_svd, tall_skinny_qr
from skinnyqr.plans.tables import ratings

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")


def _plan(df) -> str:
    df.collect()  # final adaptive plan
    return df._jdf.queryExecution().executedPlan().toString()


def test_r_only_never_shuffles_the_matrix(spark):
    plan = _plan(E.queries()["qr_r"](spark, SF))
    # everything below the running-R MapInArrow is scan + project: no exchange of the rows
    below = plan.split("MapInArrow", 1)[1]
    assert "Exchange" not in below
    assert "ReadSchema: struct<l_quantity:double,l_discount:double,l_tax:double>" in plan


def test_direct_q_pass2_reads_cached_blocks_without_reshuffle(spark):
    emb = spark.read.parquet(f"{SF}/embeddings.parquet").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("v"))
    res = tall_skinny_qr(emb, "vec_id", "v", block_rows=64)
    plan = _plan(res.q)
    matrix_side = plan.split("FlatMapCoGroupsInArrow", 1)[1].split("InMemoryTableScan", 1)[0]
    assert "Exchange" not in matrix_side  # only Sort between the co-group and the cached copy
    res.unpersist()


def test_projection_aggregates_partially_before_shuffle(spark):
    plan = _plan(random_projection(ratings(spark, SF, persist=False), 3))
    assert re.search(r"HashAggregate\(keys=\[user_id#\d+L?\], functions=\[partial_sum", plan)
    assert "xxhash64" in plan  # Omega computed inline, not joined


def test_topn_is_limited_before_the_shuffle(spark):
    plan = _plan(E.queries()["merge_topn"](spark, SF))
    assert "WindowGroupLimit" in plan and "Partial" in plan and "Final" in plan


def test_text_scan_reads_only_the_text_column(spark):
    plan = _plan(E.queries()["text_contains_count"](spark, SF))
    assert "ReadSchema: struct<text:string>" in plan


def test_small_v_scoring_is_map_only(spark):
    res = stochastic_svd(ratings(spark, SF), 5, 2)
    plan = _plan(recommend(res.u, res.v, res.sigma, n=3))
    top = plan.split("MapInArrow", 1)[0]
    assert "Exchange" not in top  # the scoring itself adds no shuffle


def test_join_of_line_items_is_dealt_by_its_rows(spark, monkeypatch):
    """However few partitions the session asks for, no task joins much more than JOIN_ROWS rows."""
    from skinnyqr.plans import tables

    want = {tuple(r) for r in ratings(spark, SF, persist=False).collect()}
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    monkeypatch.setattr(tables, "JOIN_ROWS", 300)
    spark.conf.set(key, "-1")
    try:
        ev = tables.rating_events(spark, SF, spread_rows=True)
        joined = ev.collect()
        assert "REPARTITION_BY_NUM" in ev._jdf.queryExecution().executedPlan().toString()
        assert {tuple(r) for r in ratings(spark, SF, persist=False).collect()} == want
    finally:
        spark.conf.set(key, before)
    assert len(joined) == 6000
    plan = ev._jdf.queryExecution().executedPlan().toString()
    assert max(int(x) for x in re.findall(r"hashpartitioning\(l_orderkey#\d+L, (\d+)\)", plan)) >= 7500 // 300
