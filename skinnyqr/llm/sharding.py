"""Sharding by a minimax contiguous partition of ordered atomic groups.

Groups (rows of equal text) are ordered by the MD5 of their text.  The
smallest capacity for which a greedy pass needs at most n shards is found by
binary search, and the order is cut there.  The driver sees sums over ranges
of the order only: 4,096 at first; then those that a pass at the smallest
capacity still possible cuts in are split, 256 ways at a time, until capacity
and cuts are settled between single groups.  So at any size, and also where
one group outweighs all others, it holds some ten thousand numbers, and what
it finds is exact.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save

FIRST_DIGITS, MORE_DIGITS = 3, 2
#: Ranges split at a time for each shard, and ranges that a cut may fall into before others are split first.
SPLIT, WIDE = 8, 16
#: Parts of a shard within which rows are numbered by one task each.
PARTS = 512

LEAST, MOST = 0, 1


@dataclass(frozen=True)
class Range:
    """Groups whose key starts with ``prefix``: their size, the largest and their number."""

    prefix: str
    size: int
    largest: int
    groups: int


class Order:
    """What is known of passes over single groups from the sums of ranges of them.

    Places are sums of sizes from the start.  The ends of the groups inside a
    range are not known, so each pass is made twice: one never gets further
    than the true pass (``LEAST``), the other never less far (``MOST``).
    Both are the true pass once no place asked for is inside a range of several groups.
    """

    def __init__(self, ranges: list[Range]):
        self.ranges = ranges
        self.ends = [0, *accumulate(r.size for r in ranges)]
        self.total = self.ends[-1]

    def end_before(self, place: int, side: int) -> int:
        """The last end of a group that is not after ``place``."""
        i = bisect_right(self.ends, place) - 1
        if i == len(self.ranges) or self.ends[i] == place or self.ranges[i].groups == 1:
            return self.ends[i]
        return place if side == MOST else max(self.ends[i], place - self.ranges[i].largest + 1)

    def end_after(self, place: int, side: int) -> int:
        """The first end of a group that is not before ``place``."""
        i = bisect_left(self.ends, max(place, 0))
        if self.ends[i] == max(place, 0) or self.ranges[i - 1].groups == 1:
            return self.ends[i]
        return place if side == LEAST else min(self.ends[i], place + self.ranges[i - 1].largest - 1)

    def greedy(self, capacity: int, shards: int, side: int) -> tuple[bool, list[int]]:
        """Whether a greedy pass gets to the end, and the places it asks for."""
        at, asked = 0, []
        for _ in range(shards):
            asked.append(at + capacity)
            at = self.end_before(at + capacity, side)
        return at == self.total, asked

    def capacity(self, shards: int) -> tuple[int, int]:
        """Bounds of the smallest capacity for which a greedy pass gets to the end."""

        def least(side: int) -> int:
            low, high = max(-(-self.total // shards), max(r.largest for r in self.ranges)), self.total
            while low < high:
                mid = (low + high) // 2
                low, high = (low, mid) if self.greedy(mid, shards, side)[0] else (mid + 1, high)
            return low

        return least(MOST), least(LEAST)

    def even_cuts(self, capacity: tuple[int, int], shards: int, side: int) -> tuple[list[int], list[int]]:
        """Cuts within the capacity, each at an even share of what is left where the rest still fits; the places asked for.

        ``capacity`` has bounds.  The rest fits from the cut of a greedy pass from the end on.
        """
        fits, asked = [self.total], []
        for _ in range(shards - 1):
            asked.append(fits[-1] - capacity[1 - side])
            fits.append(self.end_after(asked[-1], side))
        at, out = 0, []
        for left in range(shards, 1, -1):
            share, most = at + -(-(self.total - at) // left), at + capacity[side]
            asked += [share, most]
            at = min(max(self.end_after(share, side), fits[left - 1]), self.end_before(most, side))
            out.append(at)
        return out, asked

    def inside(self, first: int, last: int) -> list[Range]:
        """Ranges of several groups that have a place from first to last inside, ``WIDE`` + 1 at most."""
        out, i = [], max(bisect_right(self.ends, first) - 1, 0)
        while i < len(self.ranges) and self.ends[i] < last and len(out) <= WIDE:
            if self.ranges[i].groups > 1:
                out.append(self.ranges[i])
            i += 1
        return out


def _ranges(groups: DataFrame, prefixes: list[str] | None) -> list[Range]:
    """The first ranges, or those that the ranges of the prefixes split into."""
    if prefixes is None:
        prefix = F.substring("key", 1, FIRST_DIGITS)
    else:
        by_length = defaultdict(list)
        for p in prefixes:
            by_length[len(p)].append(p)
        prefix = F.coalesce(*(F.when(F.substring("key", 1, n).isin(p), F.substring("key", 1, n + MORE_DIGITS)) for n, p in by_length.items()))
    sums = (
        groups.withColumn("prefix", prefix)
        .filter("prefix IS NOT NULL")
        .groupBy("prefix")
        .agg(F.sum("size").alias("size"), F.max("size").alias("largest"), F.count("*").alias("groups"), F.min("key").alias("first"))
    )
    return [Range(r["first"] if r["groups"] == 1 else r["prefix"], int(r["size"]), int(r["largest"]), int(r["groups"])) for r in sums.collect()]


def find_cuts(ask: Callable[[list[str] | None], list[Range]], shards: int) -> tuple[int, list[str]]:
    """:func:`minimax_cuts` of the groups whose ranges ``ask`` tells, all or those of given prefixes split."""
    ranges = sorted(ask(None), key=lambda r: r.prefix)
    if not ranges:
        return 0, []
    while True:
        order = Order(ranges)
        low, high = order.capacity(shards)
        (cuts, least), (cuts_most, most) = (order.even_cuts((low, high), shards, side) for side in (LEAST, MOST))
        if low == high and cuts == cuts_most and set(cuts) <= set(order.ends):
            break
        places = list(zip(least, most))
        if low < high:
            places += zip(order.greedy(low, shards, LEAST)[1], order.greedy(low, shards, MOST)[1])
        asked = sorted(filter(None, (order.inside(*p) for p in places)), key=len)  # never empty: the passes differ
        some = {r for found in asked if len(found) <= max(WIDE, len(asked[0])) for r in found}
        split = {r.prefix for r in sorted(some, key=lambda r: (-r.size, r.prefix))[: SPLIT * shards]}
        ranges = sorted([r for r in ranges if r.prefix not in split] + ask(sorted(split)), key=lambda r: r.prefix)
    return low, [ranges[i].prefix if i < len(ranges) else "g" for i in (bisect_left(order.ends, c) for c in cuts)]


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[int, list[str]]:
    """(smallest capacity, keys at which shards 1.. begin) for groups (key: 32 hex digits, size)."""
    return find_cuts(lambda prefixes: _ranges(groups, prefixes), shards)


def shard_documents(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row; the law is ``bytes``.

    size is the UTF-8 length of the text plus 1; null texts count as empty,
    and share the empty texts' group.  Rows of equal text stay together; the
    largest shard is as small as contiguous cuts allow.  slot numbers a
    shard's rows from 0 without gaps.  Repeated rows get slots of their own.
    grown_shard is null (only a law by key has it).  Other columns are
    ignored; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = save(
        docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("key")),
        "rows",
    )
    groups = save(rows.groupBy("key").agg(F.sum("size").alias("size")), "groups")
    _, cuts = minimax_cuts(groups, shards)
    shard = F.lit(0)
    for c in cuts:
        shard = shard + (F.col("key") >= c).cast("int")
    part = F.pmod(F.xxhash64("doc_id", "key"), F.lit(PARTS)).cast("int")
    placed = rows.select("*", shard.alias("shard"), part.alias("part"))
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))  # at most shards * PARTS rows
    first = counts.selectExpr("shard", "part", "sum(n) OVER (PARTITION BY shard ORDER BY part) - n AS first")
    numbered = placed.selectExpr("*", "row_number() OVER (PARTITION BY shard, part ORDER BY key, doc_id) AS nth")
    return numbered.join(F.broadcast(first), ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("nth") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
