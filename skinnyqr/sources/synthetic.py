"""Random upper-triangular blocks (S6), one per key of a driving table.

The generator is a counter: entry (i, j) of the block for key k depends on
(seed, k, i, j) alone, by integer arithmetic modulo the prime 2^31 - 1 that
any SQL engine can repeat.  One step is a permutation of the residues:
``x -> (x^5 mod p) * 48271 mod p``.  The entry is ``x / p`` for

    x = step(step(step(step(seed + 1) + k mod p) + k div p mod p) + i * size + j)

(sums mod p) where j >= i, and 0 below the diagonal.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skinnyqr.session import ship_package

#: Fixed values of the generator: modulus and multiplier.
PRIME, FACTOR = 2147483647, 48271
#: Bytes of blocks a task generates at a time.
_BYTES = 8 << 20


def step(x: np.ndarray) -> np.ndarray:
    """A permutation of 0 .. PRIME - 1 (5 has no common divisor with PRIME - 1)."""
    fourth = np.square(np.square(x) % PRIME) % PRIME
    return fourth * x % PRIME * FACTOR % PRIME


def uniform(seed: int, key: np.ndarray, counter: np.ndarray) -> np.ndarray:
    """len(key) x len(counter) numbers on [0, 1)."""
    key = key.astype(np.int64)
    x = step(np.array([(seed + 1) % PRIME], np.int64))
    x = step((x + key % PRIME) % PRIME)
    x = step((x + key // PRIME % PRIME) % PRIME)
    return step((x[:, None] + counter[None, :]) % PRIME) / PRIME


def random_r_blocks(keys: DataFrame, key_col: str, size: int, seed: int = 0) -> DataFrame:
    """One ``size`` x ``size`` upper-triangular block per key: ``(node, r)``; map-only.

    Rows with a null key are left out.
    """
    if size < 1:
        raise ValueError("size must be >= 1")
    ship_package(keys.sparkSession)
    rows = max(1, _BYTES // (8 * size * size))

    def run(batches):
        cells = np.arange(size * size, dtype=np.int64)
        upper = (cells % size >= cells // size).astype(np.float64)
        for b in batches:
            for at in range(0, b.num_rows, rows):
                key = b.column(0).slice(at, rows)
                block = uniform(seed, key.to_numpy(), cells) * upper
                offsets = np.arange(len(key) + 1, dtype=np.int32) * size * size
                yield pa.RecordBatch.from_arrays([key, pa.ListArray.from_arrays(pa.array(offsets), pa.array(block.reshape(-1)))], names=["node", "r"])

    key = F.col(key_col).cast("long")
    return keys.select(key.alias("node")).filter("node IS NOT NULL").mapInArrow(run, "node long, r array<double>")
