"""Registered queries over the driver tables and their DuckDB oracles."""

from skinnyqr.plans.catalog import QUERIES
from skinnyqr.plans.oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]
