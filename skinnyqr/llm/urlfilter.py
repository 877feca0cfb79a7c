"""URL filters: a blocked Bloom filter in front of an exact hash join.

Listed entries are (host, path prefix) pairs.  A url is looked up under
every host suffix and path prefix of a shape that the list holds; most
lookups end in the Bloom filter (one cache line each), and only its hits go
to the exact join, which removes false positives.  The longest rule wins.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import save

#: 64-bit words of a block, and bits set for an entry.
BLOCK, BITS = 8, 6
#: Bits per entry and the largest filter, in blocks of 64 bytes; a longer list has a higher rate of false positives.
BITS_PER_ENTRY, MAX_BLOCKS = 16, 1 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    at = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(at, UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


class BlockedBloom:
    """Bloom filter whose bits of one entry all lie in one 64-byte block."""

    def __init__(self, entries: int):
        need = -(-max(entries, 1) * BITS_PER_ENTRY // (64 * BLOCK))
        self.blocks = min(1 << max(0, (need - 1).bit_length()), MAX_BLOCKS)

    def masks(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word index, bit) of each hash's bits, shape (n, BITS)."""
        h = h.astype(np.uint64)
        block = (h >> np.uint64(40)) & np.uint64(self.blocks - 1)
        step = (h & np.uint64(0xFFFF)) | np.uint64(1)
        g = (h >> np.uint64(16))[:, None] + np.arange(BITS, dtype=np.uint64) * step[:, None] * np.uint64(0x9E37)
        bit = (g ^ (g >> np.uint64(9))) & np.uint64(64 * BLOCK - 1)
        return (block[:, None] * np.uint64(BLOCK) + (bit >> np.uint64(6))).astype(np.int64), np.uint64(1) << (bit & np.uint64(63))

    def build(self, keys: DataFrame) -> np.ndarray:
        """The filter of a column of hashes: each task's part is merged by OR, word by word."""
        ship_package(keys.sparkSession)
        me = self

        def run(it):
            words = np.zeros(me.blocks * BLOCK, np.uint64)
            for b in it:
                if b.num_rows:
                    at, bit = me.masks(b.column(0).to_numpy(zero_copy_only=False))
                    np.bitwise_or.at(words, at.ravel(), bit.ravel())
            at = np.flatnonzero(words)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(words[at].view(np.int64))], names=["at", "word"])

        got = keys.mapInArrow(run, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
        words = np.zeros(self.blocks * BLOCK, np.uint64)
        words[got["at"].to_numpy()] = got["word"].to_numpy().view(np.uint64)
        return words


def _key(host: Column, path: Column) -> Column:
    return F.xxhash64(F.concat(host, F.lit(" "), path))


def judge(
    pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page.

    ``rules``: (host, path, verdict).  A rule fits its host and all
    subdomains if the url's path starts with the rule's path; the longest
    rule wins, then the longer host, then ``block``.  Without one, rule is
    null and the verdict is ``default``.  Null urls and urls without ``://``
    have an empty host and path and fit no rule; null parts of rules are
    empty; rules that repeat count once.  Rows and ids may repeat; other
    columns are ignored.  With no rules every page gets the default.
    """
    spark = pages.sparkSession
    ship_package(spark)
    clean = rules.select(F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"), F.col("verdict").alias("r_verdict"))
    clean = save(
        clean.filter("r_host <> ''").groupBy("r_host", "r_path").agg(F.max("r_verdict").alias("r_verdict"))
        .withColumn("r_key", _key(F.col("r_host"), F.col("r_path"))), "rules",
    )
    # shapes: labels of hosts and lengths of paths that occur in the list; distinct, so few
    shapes = clean.select(F.size(F.split("r_host", r"\.")).alias("labels"), F.length("r_path").alias("chars")).distinct()
    shapes = shapes.groupBy("labels").agg(F.sort_array(F.collect_set("chars")).alias("chars")).collect()
    bloom = BlockedBloom(clean.count())
    filt = spark.sparkContext.broadcast(bloom.build(clean.select("r_key")))  # at most 64 MB

    @F.pandas_udf("boolean")
    def may_hold(h):
        import pandas as pd

        at, bit = bloom.masks(h.to_numpy())
        return pd.Series(((filt.value[at] & bit) == bit).all(axis=1))

    url = F.col(url_col).cast("string")
    seen = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    if not shapes:
        return seen.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    # a page of its own row, judged by distinct (host, path): popular urls are looked up once
    distinct = seen.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    looks = []
    for s in shapes:
        suffix = F.array_join(F.slice(labels, -s["labels"], s["labels"]), ".")
        for n in s["chars"]:
            fits = (F.size(labels) >= s["labels"]) & (F.length("path") >= n) & (F.col("host") != "")
            looks.append(F.when(fits, F.struct(suffix.alias("h"), F.substring("path", 1, n).alias("p"))))
    look = distinct.select("host", "path", F.explode(F.array(*looks)).alias("x")).filter("x IS NOT NULL")
    look = look.select("host", "path", F.col("x.h").alias("h"), F.col("x.p").alias("p"), _key(F.col("x.h"), F.col("x.p")).alias("key"))
    hits = look.filter(may_hold("key"))
    exact = hits.join(clean, (F.col("key") == F.col("r_key")) & (F.col("h") == F.col("r_host")) & (F.col("p") == F.col("r_path")))
    rule = F.concat("r_host", "r_path")
    best = exact.groupBy("host", "path").agg(F.max(F.struct(F.length(rule).alias("n"), F.length("r_host").alias("m"), (F.col("r_verdict") == "block").alias("b"), rule.alias("rule"), "r_verdict")).alias("w"))
    best = best.select("host", "path", "w.rule", F.col("w.r_verdict").alias("verdict"))
    return seen.join(best, ["host", "path"], "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
