"""Substring filter and count over text lines (F4, A6)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def text_lines(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Whole texts -> one row per line (``line``), splitting on newlines."""
    return df.select(F.explode(F.split(F.col(text_col), "\n")).alias("line"))


def count_lines_containing(df: DataFrame, needles=("a", "b"), text_col: str = "text",
                           split_lines: bool = True) -> DataFrame:
    """One row with, per needle, the number of lines that contain it.

    All counts come from a single scan (``count_if`` per needle).
    Columns are ``lines_with_<needle>`` for alphanumeric needles, else
    ``lines_with_<index>``.
    """
    lines = text_lines(df, text_col) if split_lines else df.select(F.col(text_col).alias("line"))
    aggs = []
    for i, nd in enumerate(needles):
        name = f"lines_with_{nd}" if str(nd).isalnum() else f"lines_with_{i}"
        aggs.append(F.count_if(F.col("line").contains(F.lit(nd))).alias(name))
    return lines.agg(*aggs)
