"""Readers: dense text matrices, rating triples, saved factors, random blocks."""

from skinnyqr.sources.dense import (
    block_of,
    block_sizes,
    dense_lines,
    dense_to_coo,
    numbered_lines,
    parse_dense_lines,
    read_dense_text,
)
from skinnyqr.sources.factors import committed_versions, read_factors
from skinnyqr.sources.ratings import (
    bad_rating_lines,
    dedupe_ratings,
    parse_rating_lines,
    read_ratings_text,
    user_row_text,
    user_rows,
)
from skinnyqr.sources.synthetic import random_r_blocks

__all__ = [
    "bad_rating_lines",
    "block_of",
    "block_sizes",
    "committed_versions",
    "dedupe_ratings",
    "dense_lines",
    "dense_to_coo",
    "numbered_lines",
    "parse_dense_lines",
    "parse_rating_lines",
    "random_r_blocks",
    "read_dense_text",
    "read_factors",
    "read_ratings_text",
    "user_row_text",
    "user_rows",
]
