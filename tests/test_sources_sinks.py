import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from skinnyqr import recommend, stochastic_svd
from skinnyqr.operators.text import count_lines_containing
from skinnyqr.sinks import recommendation_lines, write_factors, write_recommendations_text
from skinnyqr.sources import (
    bad_rating_lines,
    block_sizes,
    dedupe_ratings,
    dense_to_coo,
    read_dense_text,
    read_factors,
    read_ratings_text,
    user_rows,
)


def _write(path, name, text):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, name), "w") as f:
        f.write(text)


def test_dense_text_two_files_blank_lines_keep_last_column(spark, tmpdir_path):
    _write(tmpdir_path, "a.txt", "1 2 3\n\n4 5 6\n")
    _write(tmpdir_path, "b.txt", "  7\t8   9  \n")
    df = read_dense_text(spark, tmpdir_path)
    rows = sorted(tuple(r["v"]) for r in df.collect())
    assert rows == [(1.0, 2.0, 3.0), (4.0, 5.0, 6.0), (7.0, 8.0, 9.0)]
    assert df.select("row_id").distinct().count() == 3


def test_dense_text_bad_lines(spark, tmpdir_path):
    _write(tmpdir_path, "a.txt", "1 2 3\n1 x 3\n1 2\n")
    assert read_dense_text(spark, tmpdir_path, on_bad="drop", width=3).count() == 1
    with pytest.raises(Exception):
        read_dense_text(spark, tmpdir_path, on_bad="raise", width=3).collect()


def test_dense_text_first_field_ids(spark, tmpdir_path):
    _write(tmpdir_path, "a.txt", "10 1.5 2\n11 3 4\n")
    df = read_dense_text(spark, tmpdir_path, id_mode="first_field")
    assert sorted((r["row_id"], tuple(r["v"])) for r in df.collect()) == [(10, (1.5, 2.0)), (11, (3.0, 4.0))]


def test_rating_lines_delimiters_signs_and_bad(spark, tmpdir_path):
    _write(tmpdir_path, "r.txt", "108 123 3.5\n108,123,-3.5\n108::124::4\n7\t9\t1 extra\n\nbad line here\n1 2\n")
    df = read_ratings_text(spark, tmpdir_path, on_bad="drop")
    got = sorted(tuple(r) for r in df.collect())
    assert got == [(7, 9, 1.0), (108, 123, -3.5), (108, 123, 3.5), (108, 124, 4.0)]
    assert bad_rating_lines(spark.read.text(tmpdir_path)).count() == 2
    with pytest.raises(Exception):
        read_ratings_text(spark, tmpdir_path).collect()


def test_dedupe_modes(spark):
    df = spark.createDataFrame([(1, 2, 1.0, 0), (1, 2, 3.0, 1), (1, 3, 5.0, 0)], "user_id long, item_id long, rating double, o int")
    get = lambda d: sorted(tuple(r) for r in d.collect())
    assert get(dedupe_ratings(df, "sum")) == [(1, 2, 4.0), (1, 3, 5.0)]
    assert get(dedupe_ratings(df, "avg")) == [(1, 2, 2.0), (1, 3, 5.0)]
    assert get(dedupe_ratings(df, "max")) == [(1, 2, 3.0), (1, 3, 5.0)]
    assert get(dedupe_ratings(df, "last", order_col="o")) == [(1, 2, 3.0), (1, 3, 5.0)]


def test_user_rows_and_blocks_lossless(spark):
    df = spark.createDataFrame([(u, i, float(i)) for u in range(10) for i in range(u % 4 + 1)], "user_id long, item_id long, rating double")
    rows = user_rows(df).collect()
    assert sum(len(r["items"]) for r in rows) == df.count()
    ids = spark.range(0, 1000).withColumnRenamed("id", "row_id")
    sizes = block_sizes(ids, "row_id", 64).collect()
    assert sum(r["n_rows"] for r in sizes) == 1000 and max(r["n_rows"] for r in sizes) == 64


def test_dense_to_coo(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0, 2.0])], "row_id long, v array<double>")
    assert sorted(tuple(r) for r in dense_to_coo(df).collect()) == [(0, 0, 1.0), (0, 2, 2.0)]


def test_factors_round_trip_and_text_sink(spark, tmpdir_path):
    rng = np.random.default_rng(0)
    rows = [(u, 100 + i, float(rng.integers(1, 5))) for u in range(30) for i in range(5) if rng.random() < 0.7]
    df = spark.createDataFrame(rows, "user_id long, item_id long, rating double")
    res = stochastic_svd(df, k=5, p=0)
    path = os.path.join(tmpdir_path, "factors")
    write_factors(spark, res.u, res.v, res.sigma, path)
    write_factors(spark, res.u, res.v, res.sigma, path)  # overwrite works
    u, v, sigma = read_factors(spark, path)
    assert np.allclose(sigma, res.sigma)
    a = recommend(res.u, res.v, res.sigma, n=2).orderBy("user_id", "rank").collect()
    b = recommend(u, v, sigma, n=2).orderBy("user_id", "rank").collect()
    assert [(r[0], r[1]) for r in a] == [(r[0], r[1]) for r in b]
    lines = recommendation_lines(spark.createDataFrame(
        [(1, 5, 2.5, 1), (1, 7, 1.5, 2), (2, None, None, None)], "user_id long, item_id long, score double, rank int"))
    got = sorted(r["value"] for r in lines.collect())
    assert got == ["1\t[5:2.5,7:1.5,]", "2\t[]"]
    out = os.path.join(tmpdir_path, "rec_text")
    write_recommendations_text(spark.createDataFrame([(1, 5, 2.5, 1)], "user_id long, item_id long, score double, rank int"), out)
    assert spark.read.text(out).first()["value"] == "1\t[5:2.5,]"


def test_text_contains_count(spark):
    df = spark.createDataFrame([("apple\nberry\ncherry",), ("a b\nxyz",)], "text string")
    r = count_lines_containing(df, ("a", "b")).first()
    assert (r["lines_with_a"], r["lines_with_b"]) == (2, 2)
    r2 = count_lines_containing(df.select(F.col("text")), ("a",), split_lines=False).first()
    assert r2["lines_with_a"] == 2


def test_user_rows_segments_lossless(spark):
    df = spark.createDataFrame([(1, i, float(i)) for i in range(50)], "user_id long, item_id long, rating double")
    rows = user_rows(df, segments=4).collect()
    assert len(rows) <= 4 and all(r["user_id"] == 1 for r in rows)
    assert sorted(e["item_id"] for r in rows for e in r["items"]) == list(range(50))
