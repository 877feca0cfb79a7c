"""Rating triples (S3), user rows (A1), duplicate handling (A3).

A rating line is ``<user> <item> <rating>``; fields are separated by
whitespace or any other characters that no number holds (``,``, ``;``,
``|``, ``::``), and signs are kept.  Extra fields are ignored.
Everything is a column expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_DELIMS = r"[^0-9A-Za-z.^+\-]+"
_BLANKS = " \t\n\r\f\v"


def _fields(text: Column) -> Column:
    """array of one struct (user_id, item_id, rating), null where a field is no number."""
    def read(t):
        return F.struct(
            F.try_element_at(t, F.lit(1)).try_cast("long").alias("user_id"),
            F.try_element_at(t, F.lit(2)).try_cast("long").alias("item_id"),
            F.try_element_at(t, F.lit(3)).try_cast("double").alias("rating"),
        )

    return F.transform(F.array(F.split(text, _DELIMS)), read)


def _is_bad() -> Column:
    return F.col("user_id").isNull() | F.col("item_id").isNull() | F.col("rating").isNull()


def parse_rating_lines(lines: DataFrame, text_col: str = "value", on_bad: str = "raise",
                       observation: Observation | None = None) -> DataFrame:
    """Lines -> ``(user_id BIGINT, item_id BIGINT, rating DOUBLE)``.

    Blank lines are skipped.  Lines with fewer than three fields or a
    field that is not a number raise (``on_bad='raise'``) or are dropped
    (``'drop'``); an ``observation`` then reports their number as
    ``bad_lines``.  Item ids are BIGINT (the reference required int).
    """
    if on_bad not in ("raise", "drop"):
        raise ValueError("on_bad must be 'raise' or 'drop'")
    text = F.btrim(F.col(text_col), F.lit(_BLANKS))
    # a generator's output is an attribute: filters above it never repeat the split
    df = lines.filter(F.length(text) > 0).select(F.inline(_fields(text)))
    if on_bad == "raise":
        return df.filter(~F.when(_is_bad(), F.raise_error(F.lit("malformed rating line"))).otherwise(F.lit(False)))
    if observation is not None:
        df = df.observe(observation, F.count_if(_is_bad()).alias("bad_lines"))
    return df.filter(~_is_bad())


def read_ratings_text(spark: SparkSession, path: str, on_bad: str = "raise",
                      observation: Observation | None = None) -> DataFrame:
    """Read rating text files (one or many)."""
    return parse_rating_lines(spark.read.text(path), "value", on_bad, observation)


def bad_rating_lines(lines: DataFrame, text_col: str = "value") -> DataFrame:
    """The non-blank lines that :func:`parse_rating_lines` would drop."""
    text = F.btrim(F.col(text_col), F.lit(_BLANKS))
    # rows that the generator adds are named after the parsed fields
    out = lines.filter(F.length(text) > 0).select(F.struct("*").alias("_line"), F.inline(_fields(text)))
    return out.filter(_is_bad()).select("_line.*")


def dedupe_ratings(df: DataFrame, how: str = "sum", order_col: str | None = None, user: str = "user_id",
                   item: str = "item_id", rating: str = "rating") -> DataFrame:
    """One rating per (user, item): ``sum``, ``avg``, ``max`` or ``last``.

    ``last`` keeps the rating of the row with the largest ``order_col``, of
    those with the same one the largest rating (the reference kept whichever duplicate came last in shuffle order,
    which is not reproducible).  Partial aggregation runs before the
    shuffle, so a hot (user, item) pair costs one row per map task.
    """
    r = F.col(rating).cast("double")
    if how == "sum":
        agg = F.sum(r)
    elif how == "avg":
        agg = F.avg(r)
    elif how == "max":
        agg = F.max(r)
    elif how == "last":
        if order_col is None:
            raise ValueError("how='last' needs order_col")
        agg = F.max_by(r, F.struct(F.col(order_col), r))
    else:
        raise ValueError("how must be sum, avg, max or last")
    return df.groupBy(user, item).agg(agg.alias(rating))


def user_rows(df: DataFrame, user: str = "user_id", item: str = "item_id", rating: str = "rating",
              segments: int | None = None, max_items: int = 100_000) -> DataFrame:
    """A1: sparse rows ``(user, segment, items ARRAY<STRUCT<item_id, rating>>)``, items sorted within a row.

    A user has one row (segment 0) unless it has more than ``max_items``
    ratings: ratings are counted per user first, and those of a heavier user
    are dealt by a hash of the item to as many segments as it takes, so no
    row or task gets a user's ratings whole however many there are (an item
    rated again and again stays in one segment: ``dedupe_ratings`` first).
    ``segments`` deals every user to that many instead.  Nothing is dropped.
    The matrix operators use the COO form directly and never need these rows.
    """
    entry = F.struct(F.col(item).alias("item_id"), F.col(rating).alias("rating"))
    if segments is not None:
        parts = F.lit(max(1, int(segments)))
    else:
        counts = df.groupBy(F.col(user).alias("_heavy")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > max_items)
        heavy = counts.select("_heavy", F.ceil(F.col("_n") / max_items).cast("int").alias("_parts"))
        df = df.join(heavy, F.col(user).eqNullSafe(F.col("_heavy")), "left")
        parts = F.coalesce("_parts", F.lit(1))
    seg = F.when(parts > 1, F.pmod(F.xxhash64(F.col(item)), parts)).otherwise(F.lit(0)).cast("int").alias("segment")
    return df.groupBy(user, seg).agg(F.array_sort(F.collect_list(entry)).alias("items"))


def user_row_text(rows: DataFrame, user: str = "user_id") -> DataFrame:
    """``(user, n_items, items_text)`` with text ``item:rating,item:rating`` for each user row (segment)."""
    pairs = F.transform("items", lambda s: F.concat(s["item_id"].cast("string"), F.lit(":"), s["rating"].cast("string")))
    return rows.select(user, F.size("items").cast("long").alias("n_items"), F.array_join(pairs, ",").alias("items_text"))
