"""Session-level helpers: shared scratch folder, materialisation, spreading
single-split inputs, and shipping the package to Python workers."""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared checkpoint folder the cluster names, or None.

    Read from ``spark.checkpoint.dir`` (or the SparkContext's directory
    if it was set programmatically).  Never invents a machine-local path.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d
    try:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        return jdir.get() if jdir.isDefined() else None
    except Exception:  # pragma: no cover - Connect sessions have no SparkContext
        return None


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder (for written tables)."""
    base = checkpoint_dir(spark)
    if not base:
        raise RuntimeError(
            "spark.checkpoint.dir is not set; set it to a shared folder (HDFS/S3/...) "
            "to write intermediate tables"
        )
    return f"{base.rstrip('/')}/skinnyqr-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, reliable: bool = False, eager: bool = True) -> DataFrame:
    """Compute ``df`` once and keep it.

    Intermediate results read more than once (Y, Q, B^t, the block copy of
    a matrix, reduction rounds that carry Q slices) are persisted
    MEMORY_AND_DISK: if an executor is lost, Spark recomputes only the
    lost partitions from lineage.  With ``reliable=True`` the
    result is checkpointed into ``spark.checkpoint.dir`` instead, which
    cuts the lineage (used where recomputation would be costly); an unset
    folder is an error, never a silent local fallback.
    With ``eager=False`` the data is only marked for persistence and is
    computed by the first job that reads it.
    """
    spark = df.sparkSession
    ship_package(spark)
    if reliable:
        if not checkpoint_dir(spark):
            raise RuntimeError("reliable=True needs spark.checkpoint.dir (a shared folder)")
        sc = spark.sparkContext
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(checkpoint_dir(spark))
        return df.checkpoint(eager=True)
    out = df.persist(StorageLevel.MEMORY_AND_DISK)
    if eager:
        out.count()
    return out


#: Input bytes per core below which an input counts as too small to be split by its files.
SPREAD_BYTES = 64 << 20


def spread(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Repartition inputs that the optimizer estimates at under SPREAD_BYTES per core.

    Inputs read as a single split (a one-row-group file, a one-block
    result) would otherwise run their CPU-heavy per-row work in one task.
    Larger inputs have enough splits, so this is a no-op for them (no extra
    shuffle at scale).  Only plan statistics are read: nothing is executed.
    Rows are hash-partitioned on ``cols`` (deterministic on retry, no sort);
    pass only the columns the query needs so scans stay pruned.
    """
    par = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(par, *(cols or df.columns)) if size < par * SPREAD_BYTES else df


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``skinnyqr`` importable in Python workers (once per SparkContext).

    Equivalent to ``spark-submit --py-files skinnyqr.zip``: the package
    source is zipped and registered with ``addPyFile`` so executors fetch
    it from the driver.  A no-op when the package is already shipped.
    """
    import os
    import tempfile
    import zipfile

    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    if sc.getConf().get("spark.skinnyqr.shipPackage", "true").lower() == "false":
        # the package is installed on the executors already (or passed with --py-files)
        _SHIPPED.add(key)
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    fd, path = tempfile.mkstemp(prefix="skinnyqr-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as zf:
        for dirpath, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    zf.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    _SHIPPED.add(key)
