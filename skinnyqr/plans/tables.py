"""Loading the driver tables and deriving the rating matrix from them."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of both sides in a partition of the join of line items and orders: a task sorts them and adds up their ratings.
JOIN_ROWS = 3 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table (Parquet; projections and filters are pushed into the scan)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def brand_number(col: str = "p_brand"):
    """``Brand#17`` -> 17 (the item id of the derived rating matrix)."""
    return F.substring(F.col(col), 7, 16).cast("long")


def rating_events(spark: SparkSession, sf_dir: str, spread_rows: bool = False) -> DataFrame:
    """One (customer, brand, quantity) triple per line item.

    lineitem joins orders on the order key and part on the part key;
    only the four needed columns are read (the scans prune the rest).
    With ``spread_rows`` line items are dealt by order key to as many
    partitions as there are cores, and to more where a task's share of the
    join would exceed JOIN_ROWS: neither the session's partition count nor
    the compressed size of a shuffle bounds the rows that a task sorts.
    The rows are counted first (from the files' footers).
    """
    li_cols = ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity"]
    li = table(spark, sf_dir, "lineitem").select(*li_cols)
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    if spread_rows:
        par = spark.sparkContext.defaultParallelism
        parts = -(-(li.count() + o.count()) // JOIN_ROWS)
        li = li.repartition(max(par, parts), "l_orderkey")
        if parts > par:
            o = o.repartition(parts, "o_orderkey")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return (
        li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(p, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.col("o_custkey").alias("user_id"),
            brand_number().alias("item_id"),
            F.col("l_quantity").alias("rating"),
            F.col("l_linenumber"),
        )
    )


def ratings(spark: SparkSession, sf_dir: str, persist: bool = True) -> DataFrame:
    """Customer x brand rating matrix in COO form: summed quantities.

    Persisted (MEMORY_AND_DISK) because the SVD reads it twice (for Y and
    for B^t); lost blocks are recomputed from the scans.
    """
    df = (
        rating_events(spark, sf_dir, spread_rows=True)
        .groupBy("user_id", "item_id")
        .agg(F.sum("rating").alias("rating"))
    )
    return df.persist(StorageLevel.MEMORY_AND_DISK) if persist else df
