"""End-to-end jobs over files.

Each function takes the caller's SparkSession (the caller owns it: no
context is created, stopped or restarted here), reads its input with
the readers in :mod:`skinnyqr.sources`, runs the operators, writes with
:mod:`skinnyqr.sinks` (replacing the output) and releases what it kept.
What a job returns is read back from what it wrote.

============================  ==========================================
job                           function
============================  ==========================================
QR of a text matrix           :func:`qr_text_job`
SVD of a text matrix          :func:`ssvd_text_job`
SVD of rating lines           :func:`ssvd_job`
recommendations, small V      :func:`recommend_job` (``n_splits=None``)
recommendations, V in parts   :func:`recommend_job` (``n_splits=k``)
from saved factors            :func:`recommend_saved_job`
============================  ==========================================
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession

from skinnyqr.operators.recommend import recommend, recommend_split
from skinnyqr.operators.ssvd import SSVDResult, stochastic_svd, stochastic_svd_dense
from skinnyqr.operators.tsqr import QRResult, tall_skinny_qr
from skinnyqr.sinks import write_factors, write_q, write_recommendations_text
from skinnyqr.sources.dense import read_dense_text
from skinnyqr.sources.factors import read_factors
from skinnyqr.sources.ratings import dedupe_ratings, read_ratings_text


@dataclass
class SavedFactors:
    """Factors as a job saved them (U or V is None if it was not computed), and the rating lines it dropped."""

    u: DataFrame | None
    v: DataFrame | None
    sigma: np.ndarray
    bad_lines: int = 0


def _ratings(spark: SparkSession, path: str, dedupe: str, on_bad: str) -> tuple[DataFrame, Observation | None]:
    """Ratings parsed once and kept; the observation counts the lines dropped."""
    seen = Observation() if on_bad == "drop" else None
    kept = dedupe_ratings(read_ratings_text(spark, path, on_bad, seen), how=dedupe).persist(StorageLevel.MEMORY_AND_DISK)
    return kept, seen


def _save(spark: SparkSession, res: SSVDResult, path: str, seen: Observation | None = None) -> SavedFactors:
    write_factors(spark, res.u, res.v, res.sigma, path)
    res.unpersist()
    return SavedFactors(*read_factors(spark, path), bad_lines=seen.get["bad_lines"] if seen else 0)


def qr_text_job(spark: SparkSession, input_path: str, output_path: str, block_rows: int | None = None,
                schedule=None, id_mode: str = "generated") -> QRResult:
    """Read a dense text matrix, factor it (direct TSQR) and save Q as Parquet."""
    a = read_dense_text(spark, input_path, id_mode=id_mode)
    res = tall_skinny_qr(a, "row_id", "v", block_rows=block_rows, schedule=schedule)
    write_q(res.q, output_path)
    return res


def ssvd_text_job(spark: SparkSession, input_path: str, output_path: str, k: int, p: int = 15,
                  seed: int | None = None, u_half_sigma: bool = False, v_half_sigma: bool = False,
                  compute_u: bool = True, compute_v: bool = True, schedule=None,
                  id_mode: str = "line_number") -> SavedFactors:
    """Dense text matrix -> stochastic SVD -> U, V and sigma saved under ``output_path``.

    The text is read once per pass of the dense SVD: nothing of it is kept.
    V is keyed by the column number.
    """
    kw = {} if seed is None else {"seed": seed}
    rows = read_dense_text(spark, input_path, id_mode=id_mode)
    res = stochastic_svd_dense(rows, k, p, compute_u=compute_u, compute_v=compute_v, u_half_sigma=u_half_sigma,
                               v_half_sigma=v_half_sigma, schedule=schedule, **kw)
    return _save(spark, res, output_path)


def ssvd_job(spark: SparkSession, input_path: str, output_path: str, k: int, p: int = 15,
             seed: int | None = None, u_half_sigma: bool = False, v_half_sigma: bool = False,
             compute_u: bool = True, compute_v: bool = True, block_rows: int | None = None, schedule=None,
             dedupe: str = "sum", on_bad: str = "raise") -> SavedFactors:
    """Rating text -> stochastic SVD -> U, V and sigma saved under ``output_path``.

    ``on_bad='drop'`` skips malformed lines instead of failing and reports
    their number as ``bad_lines``.
    """
    ratings, seen = _ratings(spark, input_path, dedupe, on_bad)
    kw = {} if seed is None else {"seed": seed}
    res = stochastic_svd(ratings, k, p, compute_u=compute_u, compute_v=compute_v, u_half_sigma=u_half_sigma,
                         v_half_sigma=v_half_sigma, block_rows=block_rows, schedule=schedule, **kw)
    saved = _save(spark, res, output_path, seen)
    ratings.unpersist()
    return saved


def recommend_job(spark: SparkSession, input_path: str, output_path: str, k: int, p: int = 15,
                  n: int = 10, threshold: float = 1.0, n_splits: int | None = None,
                  factors_path: str | None = None, block_rows: int | None = None, dedupe: str = "sum",
                  exclude_seen: bool = False, on_bad: str = "raise", seed: int | None = None, schedule=None,
                  u_half_sigma: bool = False, v_half_sigma: bool = False) -> DataFrame:
    """Rating text -> SVD -> top-n per user, written as ``user<TAB>[item:score,...,]`` text.

    ``n_splits=None`` uses the small-V plan (users without items are
    dropped); an integer uses the split-V plan with that many parts
    (users without items are kept with ``[]``).  With ``factors_path``
    the factors are saved there too.  ``exclude_seen`` drops items the
    user already rated before ranking.  The half-sigma flags scale the factors
    that are saved and scored alike (scores are then those of
    U sqrt(Sigma) and V sqrt(Sigma)).  ``on_bad='drop'`` skips malformed lines
    instead of failing.  Returns the written lines.
    """
    ratings, _ = _ratings(spark, input_path, dedupe, on_bad)
    kw = {} if seed is None else {"seed": seed}
    res = stochastic_svd(ratings, k, p, block_rows=block_rows, schedule=schedule, u_half_sigma=u_half_sigma, v_half_sigma=v_half_sigma, **kw)
    if factors_path:
        write_factors(spark, res.u, res.v, res.sigma, factors_path)
    rec = _recommend(res.u, res.v, res.sigma, n, threshold, n_splits, ratings if exclude_seen else None)
    write_recommendations_text(rec, output_path)
    res.unpersist()
    ratings.unpersist()
    return spark.read.text(output_path)


def recommend_saved_job(spark: SparkSession, factors_path: str, output_path: str, n: int = 10,
                        threshold: float = 1.0, n_splits: int | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """Recommend from factors saved earlier, without factoring again.

    ``exclude`` (user_id, item_id) removes pairs before ranking, such as the ratings.
    """
    u, v, sigma = read_factors(spark, factors_path)
    if u is None or v is None:
        raise ValueError("the saved set lacks U or V")
    rec = _recommend(u, v, sigma, n, threshold, n_splits, exclude)
    write_recommendations_text(rec, output_path)
    return spark.read.text(output_path)


def _recommend(u, v, sigma, n, threshold, n_splits, exclude=None):
    if n_splits is None:
        return recommend(u, v, sigma, n=n, threshold=threshold, exclude=exclude)
    return recommend_split(u, v, sigma, n=n, threshold=threshold, n_splits=n_splits, exclude=exclude)
