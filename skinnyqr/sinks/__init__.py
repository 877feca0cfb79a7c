"""Writers (K1-K6): Q, factors, sigma and recommendations.

All writes replace their target (K6) and go through the DataFrame writer, so
they are safe under task retries and speculation (no files are written from
inside tasks).  Plain tables are overwritten.  Factor sets consist of several
tables and are committed as one: see :func:`write_factors`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skinnyqr.sources.factors import SIGMA_SCHEMA, committed_versions


def write_q(q: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K1: save Q rows as Parquet."""
    q.write.mode(mode).parquet(path)


def write_factors(spark: SparkSession, u: DataFrame | None, v: DataFrame | None, sigma, path: str,
                  mode: str = "overwrite", keep: int = 2) -> str:
    """K2/K3: save U, V and all k + p singular values as one committed set; returns its version.

    U and V go to a fresh folder ``versions/<version>``.  Then one file is
    added to the table ``sigma``: the singular values with the version and
    which factors it has.  That file commits the set; readers follow the
    newest one.  A run that fails before leaves the old set as it was, a set
    may be written while it is read (even from its own tables), and a factor
    that the new set lacks is absent, not the old one.  Folders of versions
    older than the newest ``keep`` are deleted after the commit; as the set
    before stays (``keep`` >= 2), plans that already read it can finish.
    ``mode='error'`` refuses a path that holds a committed set.
    """
    if mode not in ("overwrite", "error"):
        raise ValueError("mode must be 'overwrite' or 'error'")
    base, old = path.rstrip("/"), committed_versions(spark, path)
    if old and mode == "error":
        raise FileExistsError(f"{base} holds a factor set already")
    version = uuid.uuid4().hex
    for name, df in (("U", u), ("V", v)):
        if df is not None:
            df.write.parquet(f"{base}/versions/{version}/{name}")
    seq = (old[0]["seq"] if old else 0) + 1
    rows = [(i, float(s), seq, version, u is not None, v is not None) for i, s in enumerate(sigma)]
    spark.createDataFrame(rows, SIGMA_SCHEMA).coalesce(1).write.mode("append").parquet(f"{base}/sigma")
    for row in old[max(1, keep) - 1 :]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/versions/{row['version']}")
        folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)
    return version


def recommendation_lines(rec: DataFrame, user: str = "user_id", item: str = "item_id", score=None) -> DataFrame:
    """K5: ``user<TAB>[item:score,item:score,]`` lines (note the trailing comma).

    ``score`` is the column expression printed for each entry (default:
    the score as Spark prints a double).  Users whose row has a NULL item
    (kept empty by the split plan) print ``[]``.
    """
    sc = F.col("score").cast("string") if score is None else score
    entry = F.when(F.col(item).isNotNull(), F.struct(F.col("rank").alias("rank"),
                   F.concat(F.col(item).cast("string"), F.lit(":"), sc, F.lit(",")).alias("txt")))
    per_user = rec.groupBy(user).agg(F.array_sort(F.collect_list(entry)).alias("_e"))
    body = F.array_join(F.transform("_e", lambda e: e["txt"]), "")
    return per_user.select(user, F.concat(F.col(user).cast("string"), F.lit("\t["), body, F.lit("]")).alias("value"))


def write_recommendations_text(rec: DataFrame, path: str, mode: str = "overwrite", **kwargs) -> None:
    """K5: save recommendations as text lines."""
    recommendation_lines(rec, **kwargs).select("value").write.mode(mode).text(path)


__all__ = [
    "recommendation_lines",
    "write_factors",
    "write_q",
    "write_recommendations_text",
]
