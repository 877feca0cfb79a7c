"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

#: White space of the word definition ``[^\x20\x09-\x0D]+``, as a character class.
SPACE = r"[ \t\n\x0B\f\r]"


def words_of(text: Column) -> Column:
    """array<string> of the words ``[^\\x20\\x09-\\x0D]+``; null text: no words."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def _write(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below ``spark.checkpoint.dir`` and read it back.

    Cuts the lineage with a table that every executor sees; nothing is
    recomputed after the loss of an executor but that executor's tasks.
    """
    return _write(df, scratch_path(df.sparkSession, name))


def save_counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """:func:`save`, and the number of rows, counted while they are written.

    A count of its own is one or two jobs more, and each job costs the
    driver a plan, broadcasts and threads however few rows there are.
    """
    seen = Observation()
    out = save(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
    return out, seen.get["n"]


class Scratch:
    """Tables of one run of an operator, deleted when it ends.

    What the operator returns must be written by :func:`save` before.  The
    tables are deleted through Hadoop's file system, so any shared store will do.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(self.spark, name)
        self.paths.append(path)
        return _write(df, path)

    def save_counted(self, df: DataFrame, name: str) -> tuple[DataFrame, int]:
        """The table and its number of rows, counted while they are written."""
        seen = Observation()
        out = self.save(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
        return out, seen.get["n"]

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsparkSession.sessionState().newHadoopConf()
        for p in self.paths:
            path = jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(conf).delete(path, True)
        self.paths.clear()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def window_hashes(hashes: Column, size: int) -> Column:
    """Hash of every window of ``size`` elements of an array of longs; null if it has fewer.

    Windows double: those of 2 from neighbours, of 4 from those of 2 and so
    on, then the powers of two that make up ``size`` are joined.  A slice per
    window would copy the whole array for each of its elements.
    """
    pair = lambda a, b: F.xxhash64(a, b)

    def grow(width: int, held: dict[int, Column]) -> Column:
        if 2 * width <= size:
            x = held[width]
            m = F.size(x) - width
            return _let(F.zip_with(F.slice(x, F.lit(1), m), F.slice(x, F.lit(width + 1), m), pair), lambda h: grow(2 * width, {**held, 2 * width: h}))
        parts = [p for p in sorted(held, reverse=True) if size & p]
        count, out, at = F.size(held[1]) - (size - 1), None, 0
        for p in parts:
            piece = F.slice(held[p], F.lit(at + 1), count)
            out = piece if out is None else F.zip_with(out, piece, pair)
            at += p
        return F.transform(out, lambda h: F.xxhash64(F.lit(size), h))

    return F.when(F.size(hashes) >= size, _let(hashes, lambda h: grow(1, {1: h})))


def broadcast_if_small(df: DataFrame, max_rows: int, n: int | None = None) -> DataFrame:
    """Broadcast ``df`` only if it has at most ``max_rows`` rows; it is counted unless its ``n`` rows are known."""
    return F.broadcast(df) if (df.count() if n is None else n) <= max_rows else df


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a variant that is no column of ``df`` (case-insensitive)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
