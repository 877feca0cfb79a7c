"""Dense matrices from text (S1) and row blocking (S2).

A dense text matrix has one row per line, numbers separated by
whitespace.  Parsing is a pure column expression (split + try_cast), so
it runs inside whole-stage codegen and never leaves the JVM.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skinnyqr.session import ship_package

_SPACES = r"\s+"
_BLANKS = " \t\n\r\f\v"
#: Integers up to here are exact as DOUBLE.
_EXACT = float(1 << 53)


def parse_dense_lines(lines: DataFrame, text_col: str = "value", id_mode: str = "generated",
                      on_bad: str = "raise", width: int | None = None) -> DataFrame:
    """Lines of numbers -> dense rows ``(row_id BIGINT, v ARRAY<DOUBLE>)``.

    ``id_mode='first_field'`` takes the first number of each line as the
    row id, read as BIGINT (a whole number written as a decimal or with
    an exponent counts up to 2^53); ``'line_number'`` takes the column
    ``line_id`` of :func:`numbered_lines`; ``'generated'`` assigns
    ``monotonically_increasing_id`` (unique, but another number for another
    packing of the input into tasks).  Blank lines are skipped.  A line
    with a non-numeric token, or whose length differs from ``width`` when
    given, raises (``on_bad='raise'``) or is dropped (``'drop'``).  Unlike
    the reference's reader, the last column is kept.
    """
    if id_mode not in ("generated", "first_field", "line_number"):
        raise ValueError("id_mode must be 'generated', 'first_field' or 'line_number'")
    if on_bad not in ("raise", "drop"):
        raise ValueError("on_bad must be 'raise' or 'drop'")
    text = F.btrim(F.col(text_col), F.lit(_BLANKS))
    # a generator's output is an attribute: filters above it never repeat the split
    tokens = F.array(F.split(text, _SPACES))
    parsed = F.transform(tokens, lambda t: F.struct(t[0].alias("_first"), F.transform(t, lambda x: x.try_cast("double")).alias("_n")))
    kept = ["line_id"] if id_mode == "line_number" else []
    df = lines.filter(F.length(text) > 0).select(*kept, F.inline(parsed))
    if id_mode == "first_field":
        as_double = F.col("_n")[0]
        whole = (as_double == F.floor(as_double)) & (F.abs(as_double) <= _EXACT)
        rid = F.coalesce(F.col("_first").try_cast("long"), F.when(whole, as_double).cast("long"))
        vec = F.slice(F.col("_n"), 2, F.size(F.col("_n")) - 1)
        bad = rid.isNull()
    else:
        rid = F.col("line_id") if kept else F.monotonically_increasing_id()
        vec = F.col("_n")
        bad = F.lit(False)
    bad = bad | F.exists(vec, lambda x: x.isNull())
    if width is not None:
        bad = bad | (F.size(vec) != F.lit(int(width)))
    df = df.select(rid.cast("long").alias("row_id"), vec.alias("v"), bad.alias("_bad"))
    if on_bad == "drop":
        df = df.filter(~F.col("_bad"))
    else:
        df = df.withColumn("_bad", F.when(F.col("_bad"), F.raise_error(F.lit("malformed matrix line"))).otherwise(F.lit(False)))
        df = df.filter(~F.col("_bad"))
    return df.drop("_bad")


def numbered_lines(spark: SparkSession, path) -> DataFrame:
    """``(line_id, path, value)``: the lines of text files, numbered from 0 through the files in the order of their names.

    The number of a line does not depend on how files are split or packed
    into tasks.  Two reads: the lines of each split (file and first byte) are
    counted, the counts are summed up in order, and the second read counts
    on from its split's sum.  Blank lines count.  The driver and each task
    hold two numbers a split.  If the split size is changed between the two
    reads, the second one raises.
    """
    ship_package(spark)
    meta = (F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
    lines = spark.read.text(path).select(*meta, "value")
    counts = sorted(tuple(r) for r in lines.groupBy("path", "start").count().collect())
    before, total = {}, 0
    for file, start, n in counts:
        before[file, start] = total
        total += n
    shipped = spark.sparkContext.broadcast(before)

    def run(batches):
        seen: dict = {}
        for b in batches:
            ids = np.empty(b.num_rows, np.int64)
            files, starts = b.column(0).dictionary_encode(), b.column(1).to_numpy()
            code, names = files.indices.to_numpy(), files.dictionary.to_pylist()
            cut = np.flatnonzero((code[1:] != code[:-1]) | (starts[1:] != starts[:-1])) + 1
            for i, j in zip([0, *cut], [*cut, b.num_rows]):
                if j == i:
                    continue
                split = names[code[i]], int(starts[i])
                if split not in seen:
                    if split not in shipped.value:
                        raise RuntimeError(f"split {split} was not counted: the files or the split size have changed")
                    seen[split] = shipped.value[split]
                ids[i:j] = np.arange(seen[split], seen[split] + j - i)
                seen[split] += j - i
            yield pa.RecordBatch.from_arrays([pa.array(ids), b.column(0), b.column(2)], names=["line_id", "path", "value"])

    return lines.mapInArrow(run, "line_id long, path string, value string")


def read_dense_text(spark: SparkSession, path: str, id_mode: str = "generated", **kwargs) -> DataFrame:
    """Read a dense text matrix (one or many files / a folder); ``id_mode='line_number'`` gives stable row ids."""
    lines = numbered_lines(spark, path) if id_mode == "line_number" else spark.read.text(path)
    return parse_dense_lines(lines, "value", id_mode=id_mode, **kwargs)


def dense_lines(df: DataFrame, id_col: str = "row_id", vec: str = "v", with_id: bool = False) -> DataFrame:
    """Inverse of :func:`parse_dense_lines`: rows -> text lines (``value``)."""
    nums = F.transform(F.col(vec).cast("array<double>"), lambda x: x.cast("string"))
    if with_id:
        nums = F.concat(F.array(F.col(id_col).cast("string")), nums)
    return df.select(F.array_join(nums, " ").alias("value"))


def block_of(id_col: Column | str, block_rows: int) -> Column:
    """Block id ``row_id div block_rows`` (S2): contiguous ids share a block."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.floor(c / F.lit(int(block_rows))).cast("long")


def block_sizes(df: DataFrame, id_col: str, block_rows: int) -> DataFrame:
    """Rows per block ``(block, n_rows)`` for contiguous blocking; no row is lost."""
    return df.groupBy(block_of(id_col, block_rows).alias("block")).agg(F.count(F.lit(1)).alias("n_rows"))


def dense_to_coo(df: DataFrame, id_col: str = "row_id", vec: str = "v", keep_zeros: bool = False) -> DataFrame:
    """Dense rows -> COO cells ``(row_id, col, value)`` via posexplode."""
    cells = df.select(F.col(id_col).alias("row_id"), F.posexplode(F.col(vec).cast("array<double>")).alias("col", "value"))
    return cells if keep_zeros else cells.filter(F.col("value") != 0.0)
