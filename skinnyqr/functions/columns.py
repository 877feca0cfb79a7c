"""Column-expression helpers (JVM side, whole-stage codegen friendly)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# 2**63: xxhash64 / 2**63 is uniform on [-1, 1)
_TWO_POW_63 = 9223372036854775808.0


def vector_column(df: DataFrame, cols) -> Column:
    """An ``ARRAY<DOUBLE>`` column from one array column or a list of numeric columns."""
    if isinstance(cols, str):
        dt = df.schema[cols].dataType
        if isinstance(dt, T.ArrayType):
            c = F.col(cols)
            return c if isinstance(dt.elementType, T.DoubleType) else c.cast("array<double>")
        return F.array(F.col(cols).cast("double"))
    return F.array(*[F.col(c).cast("double") for c in cols])


def omega(seed: int, item: Column, c: int) -> Column:
    """Entry (item, c) of the random projection matrix, uniform on [-1, 1).

    Computed from a hash of (seed, item, c), so the matrix is never
    stored or shipped; every task regenerates exactly the entries it needs.
    """
    return F.xxhash64(F.lit(int(seed)).cast("long"), item, F.lit(int(c))).cast("double") / F.lit(_TWO_POW_63)


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def omega_sum_array(seed: int, item: str, weight: str, kp: int) -> Column:
    """``array(sum(weight * omega(seed, item, c)) for c < kp)`` as one aggregate expression.

    Built as a single SQL expression (one parse instead of kp separate
    column objects); the plan is the same kp partial/final sums.
    """
    sums = ", ".join(
        f"sum({_q(weight)} * (cast(xxhash64({int(seed)}L, {_q(item)}, {c}) as double) / {_TWO_POW_63!r}))"
        for c in range(kp)
    )
    return F.expr(f"array({sums})")


def weighted_sum_array(weight: str, vec: str, kp: int) -> Column:
    """``array(sum(weight * vec[c]) for c < kp)`` as one aggregate expression."""
    sums = ", ".join(f"sum({_q(weight)} * {_q(vec)}[{c}])" for c in range(kp))
    return F.expr(f"array({sums})")


def clean_round(c: Column, digits: int) -> Column:
    """Round and fold -0.0 into 0.0 (for exact comparisons of float results)."""
    return F.round(c, digits) + F.lit(0.0)
