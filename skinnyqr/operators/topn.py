"""Bounded top-n per key (T1) and merging of partial top-n lists (T2).

``row_number() <= n`` over a window partitioned by the key is planned by
Catalyst as a ``WindowGroupLimit`` before the shuffle and again after it,
so each task forwards at most n rows per key; a hot key costs n rows per
map task, not its full size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_n(df: DataFrame, by, score: str, n: int, tiebreak: str | None = None, rank_col: str = "rank",
          ascending_score: bool = False) -> DataFrame:
    """Keep the n best rows per ``by`` (score descending, then ``tiebreak`` ascending).

    A tie on score keeps the row with the smaller ``tiebreak`` value,
    like a bounded list that only displaces an entry on a strictly
    better score and is offered items in ascending order.
    """
    if n < 1:
        raise ValueError("n must be >= 1")
    by = [by] if isinstance(by, str) else list(by)
    order = [F.col(score).asc() if ascending_score else F.col(score).desc()]
    if tiebreak is not None:
        order.append(F.col(tiebreak).asc())
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= n)


def merge_topn(a: DataFrame, b: DataFrame, by, score: str, n: int, tiebreak: str | None = None,
               rank_col: str = "rank") -> DataFrame:
    """Merge two top-n lists of the same keys into one top-n list.

    Both inputs are long form (one row per kept entry).  An existing rank
    column is dropped and recomputed.
    """
    cols = [c for c in a.columns if c != rank_col]
    both = a.select(*cols).unionByName(b.select(*cols))
    return top_n(both, by, score, n, tiebreak, rank_col)
