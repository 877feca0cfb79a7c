"""The registered queries: one per operator group of the inventory.

Every query reads the driver's tables (or data Spark derives from
them) in full and returns a DataFrame whose column names and rounding
match its oracle SQL in :mod:`skinnyqr.plans.oracles`.  Float results
are rounded to the grid of the exact values (integer ratings -> whole
numbers) and ``-0.0`` is folded into ``0.0`` so value hashes compare.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skinnyqr.functions.columns import clean_round
from skinnyqr.operators.recommend import recommend, recommend_split, score_pairs
from skinnyqr.operators.ssvd import at_times_q, gram_cells, random_projection, stochastic_svd, stochastic_svd_dense, svd_certificate
from skinnyqr.operators.text import count_lines_containing
from skinnyqr.operators.topn import merge_topn, top_n
from skinnyqr.operators.tsqr import combine_r, qr_residual, tall_skinny_qr, tall_skinny_r
from skinnyqr.plans.tables import rating_events, ratings, table
from skinnyqr.session import scratch_path
from skinnyqr.sinks import recommendation_lines, write_factors, write_q
from skinnyqr.sources.dense import block_of, block_sizes, dense_lines, parse_dense_lines, read_dense_text
from skinnyqr.sources.factors import read_factors
from skinnyqr.sources.ratings import dedupe_ratings, parse_rating_lines, user_row_text, user_rows
from skinnyqr.sources.synthetic import random_r_blocks

LINEITEM_COLS = ["l_quantity", "l_discount", "l_tax"]
# k + p equals the rank of the customer x brand matrix (25 brands), so the
# stochastic SVD is exact and its products have SQL oracles
SVD_K, SVD_P = 25, 0
TOP_N = 3
SPLIT_THRESHOLD = 1e9


def _cells_out(cells: DataFrame, digits: int, value: str = "r") -> DataFrame:
    return cells.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"),
                        clean_round(F.col(value), digits).alias(value))


def _embeddings(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))


# --------------------------------------------------------------------------- text / sources


def q_text_contains_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_lines_containing(table(spark, sf_dir, "documents"), ("a", "b"), "text")


def q_parse_dense_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = dense_lines(_embeddings(spark, sf_dir), "vec_id", "v", with_id=True)
    rows = parse_dense_lines(lines, "value", id_mode="first_field", width=64)
    return rows.select(F.col("row_id"), F.posexplode("v").alias("j", "v")).select(
        "row_id", F.col("j").cast("long").alias("j"), "v")


def q_block_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_sizes(table(spark, sf_dir, "embeddings"), "vec_id", 64)


def _rating_lines(spark, sf_dir) -> DataFrame:
    ev = rating_events(spark, sf_dir, spread_rows=True)
    # three delimiter styles the parser accepts, chosen per line
    sep = F.when(F.pmod(F.col("l_linenumber"), F.lit(3)) == 0, F.lit(","))\
        .when(F.pmod(F.col("l_linenumber"), F.lit(3)) == 1, F.lit("::")).otherwise(F.lit("\t"))
    return ev.select(F.concat_ws("", F.col("user_id").cast("string"), sep, F.col("item_id").cast("string"), sep,
                                 F.col("rating").cast("string")).alias("value"))


def q_parse_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_rating_lines(_rating_lines(spark, sf_dir), "value", on_bad="raise")


def q_dedupe_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe_ratings(parse_rating_lines(_rating_lines(spark, sf_dir), "value"), how="sum")


def q_user_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_row_text(user_rows(ratings(spark, sf_dir, persist=False)))


# --------------------------------------------------------------------------- QR


def q_qr_r(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells_out(tall_skinny_r(table(spark, sf_dir, "lineitem"), LINEITEM_COLS), 6)


def q_qr_r_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells_out(tall_skinny_r(table(spark, sf_dir, "lineitem"), LINEITEM_COLS, schedule=[4, 1]), 6)


def q_combine_r(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_flag = tall_skinny_r(table(spark, sf_dir, "lineitem"), LINEITEM_COLS, by=["l_returnflag"], as_cells=False)
    blocks = per_flag.select(F.xxhash64("l_returnflag").alias("node"), "r")
    return _cells_out(combine_r(blocks, 3, schedule=[2, 1]), 6)


def _q_cells(spark, sf_dir, method):
    res = tall_skinny_qr(_embeddings(spark, sf_dir), "vec_id", "v", block_rows=64, fanin=4, method=method)
    cells = res.q.select("vec_id", F.posexplode("q").alias("j", "q"))
    return cells.select("vec_id", F.col("j").cast("long").alias("j"), clean_round(F.col("q"), 7).alias("q"))


def q_qr_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _q_cells(spark, sf_dir, "direct")


def q_qr_q_indirect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _q_cells(spark, sf_dir, "indirect")


def q_qr_q_refined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _q_cells(spark, sf_dir, "refined")


def _qr_full(spark, sf_dir):
    emb = _embeddings(spark, sf_dir)
    return emb, tall_skinny_qr(emb, "vec_id", "v", block_rows=64, schedule=[4, 1])


def q_qr_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb, res = _qr_full(spark, sf_dir)
    out = qr_residual(emb, res.q, res.r_matrix(), "vec_id", "v", block=block_of("vec_id", 64), how="mean")
    return out.select("block", clean_round(F.col("residual"), 6).alias("residual"), "n_rows", "missing")


def q_qr_residual_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb, res = _qr_full(spark, sf_dir)
    out = qr_residual(emb, res.q, res.r_matrix(), "vec_id", "v", block=block_of("vec_id", 64), how="sum")
    return out.select("block", clean_round(F.col("residual"), 6).alias("residual"), "n_rows", "missing")


def q_qr_orthogonality(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, res = _qr_full(spark, sf_dir)
    return _cells_out(gram_cells(res.q, "q"), 9, "g")


def q_qr_q_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1, K6: another matrix's Q is written, then replaced by this one's and read back."""
    path, emb = scratch_path(spark, "q"), _embeddings(spark, sf_dir)
    write_q(tall_skinny_qr(emb.withColumn("v", F.slice("v", 1, 2)).withColumn("vec_id", -F.col("vec_id")), "vec_id", "v").q, path)
    write_q(tall_skinny_qr(emb, "vec_id", "v").q, path)
    cells = spark.read.parquet(path).select("vec_id", F.posexplode("q").alias("j", "q"))
    return cells.select("vec_id", F.col("j").cast("long").alias("j"), clean_round(F.col("q"), 7).alias("q"))


def q_qr_refined_orthogonality(spark: SparkSession, sf_dir: str) -> DataFrame:
    res = tall_skinny_qr(_embeddings(spark, sf_dir), "vec_id", "v", method="refined")
    return _cells_out(gram_cells(res.q, "q"), 9, "g")


def q_random_r_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return random_r_blocks(table(spark, sf_dir, "part"), "p_partkey", 8, seed=7)


def q_random_r_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = random_r_blocks(table(spark, sf_dir, "part"), "p_partkey", 8, seed=7)
    return _cells_out(combine_r(blocks, 8, schedule=[16, 4, 1]), 6)


# --------------------------------------------------------------------------- SVD building blocks


def q_random_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    kp = 5
    a = ratings(spark, sf_dir, persist=False)
    om = a.select("item_id").distinct().select(
        "item_id", F.explode(F.sequence(F.lit(0), F.lit(kp - 1))).alias("c"))
    om = om.withColumn("w", (F.pmod(F.col("item_id") * 7 + F.col("c") * 3, F.lit(11)) - 5) / F.lit(5.0))
    y = random_projection(a, kp, omega_table=om)
    return y.select("user_id", F.posexplode("y").alias("c", "y")).select(
        "user_id", F.col("c").cast("long").alias("c"), clean_round(F.col("y"), 6).alias("y"))


def q_at_times_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    kp = 4
    a = ratings(spark, sf_dir, persist=False)
    q = a.select("user_id").distinct().select(
        "user_id",
        F.transform(F.sequence(F.lit(0), F.lit(kp - 1)),
                    lambda c: (F.pmod(F.col("user_id") * 3 + c * 5, F.lit(13)) - 6) / F.lit(6.0)).alias("q"))
    bt = at_times_q(a, q, kp)
    return bt.select("item_id", F.posexplode("b").alias("c", "b")).select(
        "item_id", F.col("c").cast("long").alias("c"), clean_round(F.col("b"), 6).alias("b"))


def q_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells_out(gram_cells(_embeddings(spark, sf_dir), "v"), 9, "g")


# --------------------------------------------------------------------------- SVD


def _svd(spark, sf_dir, **kw):
    a = ratings(spark, sf_dir)
    return a, stochastic_svd(a, SVD_K, SVD_P, **kw)


def q_ssvd_sigma_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, res = _svd(spark, sf_dir, compute_u=False, compute_v=False)
    s2 = float((res.sigma ** 2).sum())
    s4 = float((res.sigma ** 4).sum())
    df = spark.createDataFrame([(s2, s4)], "s2 double, s4 double")
    return df.select(clean_round(F.col("s2"), 0).alias("sum_sigma2"),
                     clean_round(F.col("s4") / F.lit(1e9), 0).alias("sum_sigma4_e9"))


def q_ssvd_dense_sigma_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    # dense entry point: all 64 embedding columns, k + p = 64 = rank
    res = stochastic_svd_dense(_embeddings(spark, sf_dir), 64, 0, id_col="vec_id", vec="v",
                               compute_u=False, compute_v=False)
    s2 = float((res.sigma ** 2).sum())
    s4 = float((res.sigma ** 4).sum())
    df = spark.createDataFrame([(s2, s4)], "s2 double, s4 double")
    return df.select(clean_round(F.col("s2"), 6).alias("sum_sigma2"), clean_round(F.col("s4"), 6).alias("sum_sigma4"))


def q_ssvd_rank10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank 10 with oversampling 15: each of the ten columns certified as an eigenvector of A^t A, sigma descending."""
    a = ratings(spark, sf_dir)
    res = stochastic_svd(a, 10, 15, compute_u=False)
    sure = svd_certificate(a, res)
    later = [bool(x >= y) for x, y in zip(res.sigma[:10], res.sigma[1:11])]
    in_order = F.element_at(F.array(*map(F.lit, later)), F.col("j") + 1)
    return sure.select(F.col("j").cast("long").alias("j"), clean_round(F.col("residual"), 6).alias("residual"),
                       clean_round(F.col("length"), 9).alias("length"), in_order.alias("in_order"),
                       clean_round(F.lit(float((res.sigma**2).sum())), 0).alias("sum_all_sigma2"))


def q_ssvd_rank_deficient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item twice: half of the singular values are 0, with zero columns; the others are orthonormal."""
    a = ratings(spark, sf_dir)
    twice = a.select("user_id", F.explode(F.array(F.col("item_id"), F.col("item_id") + 1000)).alias("item_id"), "rating")
    res = stochastic_svd(twice, 2 * SVD_K, 0)
    length2 = lambda df, c: float(df.agg(F.sum(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))).first()[0])
    unit, off = gram_cells(res.v, "v").agg(
        F.count_if((F.col("i") == F.col("j")) & (F.abs(F.col("g") - 1) < 1e-12)),
        F.max(F.when(F.col("i") != F.col("j"), F.abs("g")))).first()
    row = (float((res.sigma**2).sum()), int((res.sigma == 0).sum()), length2(res.u, "u"), length2(res.v, "v"), unit, off)
    out = spark.createDataFrame([row], "sum_sigma2 double, n_zero long, u_length2 double, v_length2 double, v_unit long, v_off_diagonal double")
    digits = {"sum_sigma2": 0, "u_length2": 6, "v_length2": 6, "v_off_diagonal": 9}
    return out.select(*[clean_round(F.col(c), digits[c]).alias(c) if c in digits else F.col(c) for c in out.columns])


def q_ssvd_reconstruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, res = _svd(spark, sf_dir)
    out = score_pairs(res.u, res.v, res.sigma, a, power=1)
    return out.select("user_id", "item_id", clean_round(F.col("score"), 0).alias("value"))


def q_ssvd_half_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, res = _svd(spark, sf_dir, u_half_sigma=True, v_half_sigma=True)
    out = score_pairs(res.u, res.v, res.sigma, a, power=0)
    return out.select("user_id", "item_id", clean_round(F.col("score"), 0).alias("value"))


# --------------------------------------------------------------------------- recommender


def _rec_out(rec: DataFrame, digits: int) -> DataFrame:
    return rec.select("user_id", "item_id", clean_round(F.col("score"), digits).alias("score"),
                      F.col("rank").cast("long").alias("rank"))


def q_cf_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, res = _svd(spark, sf_dir)
    out = score_pairs(res.u, res.v, res.sigma, a, power=3)
    return out.select("user_id", "item_id", clean_round(F.col("score"), 0).alias("score"))


def q_recommend_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, res = _svd(spark, sf_dir)
    return _rec_out(recommend(res.u, res.v, res.sigma, n=TOP_N, threshold=1.0), 0)


def q_recommend_topn_nan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """users whose factors hold a NaN get no items, though NaN sorts above every number."""
    _, res = _svd(spark, sf_dir)
    nan = F.when(F.pmod(F.col("user_id"), F.lit(7)) == 0, F.transform("u", lambda x: x * F.lit(float("nan")))).otherwise(F.col("u"))
    return _rec_out(recommend(res.u.withColumn("u", nan), res.v, res.sigma, n=TOP_N, threshold=1.0), 0)


def q_recommend_topn_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    # already-rated items are removed before ranking (optional; the reference keeps them)
    a, res = _svd(spark, sf_dir)
    return _rec_out(recommend(res.u, res.v, res.sigma, n=TOP_N, threshold=1.0, exclude=a), 0)


def q_recommend_topn_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, res = _svd(spark, sf_dir)
    rec = recommend_split(res.u, res.v, res.sigma, n=TOP_N, threshold=SPLIT_THRESHOLD, n_splits=2,
                          keep_empty=True)
    return _rec_out(rec, 9)


def q_recommend_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, res = _svd(spark, sf_dir)
    path = scratch_path(spark, "factors")
    write_factors(spark, res.u, res.v, res.sigma, path)
    u, v, sigma = read_factors(spark, path)
    return _rec_out(recommend(u, v, sigma, n=TOP_N, threshold=1.0), 0)


def q_recommend_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, res = _svd(spark, sf_dir)
    rec = recommend(res.u, res.v, res.sigma, n=TOP_N, threshold=1.0)
    score = F.round(F.col("score")).cast("long").cast("string")
    return recommendation_lines(rec, score=score)


def q_factors_rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2, K3, K6, L19: a factor set is written, then replaced by one of other ratings and without U, and read once."""
    a = ratings(spark, sf_dir)
    path = scratch_path(spark, "factors")
    first = stochastic_svd(a, SVD_K, SVD_P)
    write_factors(spark, first.u, first.v, first.sigma, path)
    second = stochastic_svd(a.withColumn("rating", F.col("rating") * 3), SVD_K, SVD_P, compute_u=False)
    write_factors(spark, second.u, second.v, second.sigma, path)
    u, v, sigma = read_factors(spark, path)
    return v.agg(F.count(F.lit(1)).alias("n_v")).select(
        "n_v", F.lit(u is None).alias("u_is_absent"), clean_round(F.lit(float((sigma**2).sum())), 0).alias("sum_sigma2"))


def q_text_row_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1, L3: a text matrix is written and read with line numbers as row ids, under two split sizes."""
    path, key = scratch_path(spark, "matrix"), "spark.sql.files.maxPartitionBytes"
    emb = _embeddings(spark, sf_dir)
    ordered = emb.repartitionByRange(4, "vec_id").sortWithinPartitions("vec_id")
    dense_lines(ordered, "vec_id", "v", with_id=True).write.text(path)
    before, out = spark.conf.get(key), []
    for name, size in (("small", "64k"), ("large", "128m")):
        spark.conf.set(key, size)
        try:
            rows = read_dense_text(spark, path, id_mode="line_number", width=65)
            done = scratch_path(spark, f"rows-{name}")
            rows.select(F.col("v")[0].cast("long").alias("vec_id"), F.col("row_id").alias(f"id_{name}_splits")).write.parquet(done)
        finally:
            spark.conf.set(key, before)
        out.append(spark.read.parquet(done))
    return out[0].join(out[1], "vec_id")


def q_merge_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select("user_id", "event_id", "value", "event_type")
    # two halves that together hold every row (a NULL type goes to the second)
    in_first = F.coalesce(F.col("event_type") < F.lit("m"), F.lit(False))
    first = ev.filter(in_first)
    second = ev.filter(~in_first)
    a = top_n(first.drop("event_type"), "user_id", "value", TOP_N, tiebreak="event_id")
    b = top_n(second.drop("event_type"), "user_id", "value", TOP_N, tiebreak="event_id")
    out = merge_topn(a, b, "user_id", "value", TOP_N, tiebreak="event_id")
    return out.select("user_id", "event_id", "value", F.col("rank").cast("long").alias("rank"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "text_contains_count": q_text_contains_count,
    "parse_dense_rows": q_parse_dense_rows,
    "block_counts": q_block_counts,
    "parse_ratings": q_parse_ratings,
    "dedupe_ratings": q_dedupe_ratings,
    "user_rows": q_user_rows,
    "qr_r": q_qr_r,
    "qr_r_schedule": q_qr_r_schedule,
    "combine_r": q_combine_r,
    "qr_q": q_qr_q,
    "qr_q_indirect": q_qr_q_indirect,
    "qr_q_refined": q_qr_q_refined,
    "qr_residual": q_qr_residual,
    "qr_residual_sum": q_qr_residual_sum,
    "qr_orthogonality": q_qr_orthogonality,
    "qr_q_saved": q_qr_q_saved,
    "qr_refined_orthogonality": q_qr_refined_orthogonality,
    "random_r_blocks": q_random_r_blocks,
    "random_r_combined": q_random_r_combined,
    "random_projection": q_random_projection,
    "at_times_q": q_at_times_q,
    "gram": q_gram,
    "ssvd_sigma_moments": q_ssvd_sigma_moments,
    "ssvd_dense_sigma_moments": q_ssvd_dense_sigma_moments,
    "ssvd_rank10": q_ssvd_rank10,
    "ssvd_rank_deficient": q_ssvd_rank_deficient,
    "factors_rewritten": q_factors_rewritten,
    "text_row_ids": q_text_row_ids,
    "ssvd_reconstruct": q_ssvd_reconstruct,
    "ssvd_half_sigma": q_ssvd_half_sigma,
    "cf_scores": q_cf_scores,
    "recommend_topn": q_recommend_topn,
    "recommend_topn_nan": q_recommend_topn_nan,
    "recommend_topn_unseen": q_recommend_topn_unseen,
    "recommend_topn_split": q_recommend_topn_split,
    "recommend_saved": q_recommend_saved,
    "recommend_text": q_recommend_text,
    "merge_topn": q_merge_topn,
}
