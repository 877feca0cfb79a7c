"""Per-block numpy kernels, Arrow/numpy conversions and column helpers."""

from skinnyqr.functions.columns import clean_round, omega, vector_column
from skinnyqr.functions.kernels import (
    batched_matmul,
    running_r,
    signed_qr,
    stack_qr,
    topn_pruned,
    topn_rows,
)

__all__ = [
    "batched_matmul",
    "clean_round",
    "omega",
    "running_r",
    "signed_qr",
    "stack_qr",
    "topn_pruned",
    "topn_rows",
    "vector_column",
]
