"""Saved factors (S4): committed sets of U, V and sigma written by :mod:`skinnyqr.sinks`."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession

#: One file of this table commits one factor set.
SIGMA_SCHEMA = "idx int, sigma double, seq long, version string, has_u boolean, has_v boolean"


def committed_versions(spark: SparkSession, path: str) -> list[Row]:
    """(seq, version, has_u, has_v) of the committed sets below ``path``, newest first."""
    table = f"{path.rstrip('/')}/sigma"
    folder = spark._jvm.org.apache.hadoop.fs.Path(table)
    if not folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(folder):
        return []
    rows = spark.read.schema(SIGMA_SCHEMA).parquet(table).select("seq", "version", "has_u", "has_v").distinct().collect()
    return sorted(rows, key=lambda r: (r["seq"], r["version"]), reverse=True)


def read_factors(spark: SparkSession, path: str) -> tuple[DataFrame | None, DataFrame | None, np.ndarray]:
    """``(U, V, sigma)`` of the newest committed set; a factor it was saved without is None.

    U and V stay DataFrames; sigma (k + p numbers) comes to the driver.
    """
    base = path.rstrip("/")
    sets = committed_versions(spark, path)
    if not sets:
        raise FileNotFoundError(f"{base} holds no committed factor set")
    new = sets[0]
    rows = spark.read.schema(SIGMA_SCHEMA).parquet(f"{base}/sigma").filter(f"version = '{new['version']}'").orderBy("idx").collect()
    u, v = (spark.read.parquet(f"{base}/versions/{new['version']}/{name}") if new[flag] else None for name, flag in (("U", "has_u"), ("V", "has_v")))
    return u, v, np.array([r["sigma"] for r in rows], dtype=np.float64)
