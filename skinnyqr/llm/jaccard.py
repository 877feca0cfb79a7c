"""N-gram Jaccard self-join by vertical partitioning (operator 4).

The global order of the n-grams is the order of their 64-bit hashes.  The
order is cut into fragments; a text's sorted n-gram set is cut at the same
places into segments.

* Candidates.  Linked sets of sizes up to M differ in at most
  D = (1-t)/(1+t) * 2M n-grams, so with 5/4 D + 3 fragments at least a fifth
  of the segments is equal in both.  A hash of (length band, fragment, segment)
  is a key; a set shares with every partner at least as many keys as it has
  segments beyond D.  Sets that share fewer keys with anyone are left out, and
  so are keys that then stand alone, round after round: documents that only
  hold a common passage drop out here, before any pairs are made.
  Sets with so few segments that all equal ones could be empty
  also emit their prefix n-grams (prefix filter), so no link is lost.
* Verification.  Each candidate pair's overlap is counted per fragment of
  the order and the partial counts are summed per pair.
* Large groups.  Equal sets are one class.  In a few rounds, a bucket's
  members are checked against the member with most shared segments only
  (linear), and components merge.  After that, only
  members of different components in a bucket are compared, behind an exact
  lower bound of the difference (sizes and 1024-bit parity sketches), so a
  group of copies never becomes all its pairs.
Sets are named by 128-bit digests, never by ids, which may repeat.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package
from .common import Scratch, broadcast_if_small, free_name, save, save_counted
from .components import connected_components
from .shingles import bounded, mix64, shingle_hashes, text_bytes, word_hashes

VERIFY_FRAGMENTS = 8
SKETCH = 16  # longs
#: Rounds of leaving out sets with too few shared keys (any number is exact).
PEELS = 3
#: Digests a task remembers, so that copies of a text emit their keys once.
SEEN = 1_000_000
#: Rounds in which a bucket's members are checked against one of them only.
STAR_ROUNDS = 3
#: Rows of doc ids that may be broadcast (8 bytes each).
MAX_BROADCAST_IDS = 4_000_000


def length_bands(n_max: int, num: int, den: int) -> list[int]:
    """Lower ends of the length bands: linked sets lie in the same or in neighbouring bands."""
    ends = [1]
    while ends[-1] <= n_max:
        ends.append(ends[-1] * den // num + 1)
    return [*ends, ends[-1] * den // num + 1]


class Signer:
    """Segment keys of one sorted set of n-gram hashes."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.ends = num, den, length_bands(1, num, den)

    def max_difference(self, total: int) -> int:
        """Largest symmetric difference of linked sets whose sizes sum to ``total``."""
        return (self.den - self.num) * total // (self.den + self.num)

    def schemes(self, n: int):
        """(scheme, largest set, D, fragments, largest difference to any partner) of the band pairs of a set of n."""
        if self.ends[-3] <= n:
            self.ends = length_bands(2 * n, self.num, self.den)
        band = int(np.searchsorted(self.ends, n, side="right")) - 1
        for scheme in (band - 1, band):  # pairs of bands (scheme, scheme + 1)
            if scheme < 0:
                continue
            largest = self.ends[scheme + 2] - 1
            d = self.max_difference(2 * largest)
            if d:  # else only equal sets link
                yield scheme, largest, d + 3 + d // 4, self.max_difference(n + min(largest, n * self.den // self.num))

    def needs(self, h: np.ndarray) -> tuple[int, int]:
        """By parity of the scheme: how many segment keys a set shares at least with each partner."""
        out = [0, 0]
        for scheme, _, m, mine in self.schemes(len(h)):
            frag = ((h >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
            out[scheme & 1] = max(0, 1 + int((frag[1:] != frag[:-1]).sum()) - mine)
        return out[0], out[1]

    def keys(self, h: np.ndarray) -> np.ndarray:
        """Segment keys; the lowest bit is the parity of the scheme, the next one marks n-grams of the prefix."""
        out = []
        n = len(h)
        mixed = np.concatenate([[np.uint64(0)], np.cumsum(mix64(h ^ np.uint64(0x5851F42D4C957F2D)))])
        for scheme, _, m, mine in self.schemes(n):
            frag = ((h >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
            cut = np.flatnonzero(np.diff(frag)) + 1
            at = np.concatenate([[0], cut, [n]])
            sums = mixed[at[1:]] - mixed[at[:-1]]
            salt = mix64(np.array([scheme], np.uint64) + np.uint64(77))
            tag = lambda x, b, p=scheme & 1: (x & ~np.uint64(3)) | np.uint64(p + 2 * b)
            out.append(tag(mix64(sums + mix64(frag[at[:-1]] + salt)), 0))
            if len(at) - 1 <= mine:
                prefix = n - -(-n * self.num // self.den) + 1
                out.append(tag(mix64(h[:prefix] ^ mix64(salt + np.uint64(1))), 1))
        return np.concatenate(out) if out else np.empty(0, np.uint64)


def _sets(batch: pa.RecordBatch, col: int, k: int) -> Iterator[np.ndarray]:
    for part in bounded(batch, col):
        words, at = word_hashes(*text_bytes(part.column(col)))
        for i in range(part.num_rows):
            yield np.unique(shingle_hashes(words[at[i] : at[i + 1]], k))


def _digests(h: np.ndarray, seed: int) -> tuple[int, int]:
    s = np.uint64(2 * seed + 1)
    return tuple(
        int(x.sum(dtype=np.uint64).astype(np.int64)) for x in (mix64(h + s), mix64((h ^ np.uint64(0xA5A5A5A55A5A5A5A)) * (s | np.uint64(1))))
    )


def _sketch(h: np.ndarray) -> list[int]:
    """Parity bits of 256 buckets: bits that differ need a difference in that bucket."""
    bits = np.bincount((mix64(h + np.uint64(11)) & np.uint64(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64).tolist()


def shingle_sets(docs: DataFrame, k: int, num: int, den: int, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h, n_shingles, d1, d2, need0, need1, s0..): hash of the text; size, 128-bit digest, needs and sketch of its set."""
    ship_package(docs.sparkSession)

    def run(it):
        signer = Signer(num, den)
        for b in it:
            rows = []
            for h in _sets(b, 2, k):
                rows.append((len(h), *_digests(h, seed), *signer.needs(h), *_sketch(h)))
            cols = list(zip(*rows)) if rows else [[]] * (5 + SKETCH)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, pa.int64()) for c in cols)], names=names)

    names = ["doc_id", "h", "n_shingles", "d1", "d2", "need0", "need1", *(f"s{i}" for i in range(SKETCH))]
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long"), F.xxhash64(text), text).mapInArrow(run, ", ".join(f"{x} long" for x in names))


def segment_keys(docs: DataFrame, k: int, num: int, den: int, seed: int = 0, text_col: str = "text") -> DataFrame:
    """(key, node): the segment keys of the texts' sets, named by digest; a task emits those of copies once."""
    ship_package(docs.sparkSession)

    def run(it):
        signer, seen = Signer(num, den), set()
        for b in it:
            keys, nodes, n = [], [], 0
            for h in _sets(b, 0, k):
                node = _digests(h, seed)[0]
                if not len(h) or node in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(node)
                s = signer.keys(h)
                keys.append(s)
                nodes.append(np.full(len(s), node, np.int64))
                n += len(s)
                if n > 500_000:
                    yield _pairs(keys, nodes)
                    keys, nodes, n = [], [], 0
            if n:
                yield _pairs(keys, nodes)

    def _pairs(keys, nodes):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(nodes))], names=["key", "node"])

    return docs.select(F.col(text_col).cast("string")).mapInArrow(run, "key long, node long")


def _segments(docs: DataFrame, k: int, seed: int) -> DataFrame:
    """(node, frag, seg): each text's set, named by digest, cut into VERIFY_FRAGMENTS segments of the global order."""

    def run(it):
        seen = set()
        for b in it:
            for part in bounded(b, 0):
                node, frag, seg = [], [], []
                for h in _sets(part, 0, k):
                    name = _digests(h, seed)[0]
                    if name in seen:
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(name)
                    cut = np.searchsorted(h, (np.arange(1, VERIFY_FRAGMENTS, dtype=np.uint64) << np.uint64(61)))
                    for f, s in enumerate(np.split(h, cut)):
                        node.append(name)
                        frag.append(f)
                        seg.append(s.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(frag, pa.int32()), pa.array(seg, pa.binary())], names=["node", "frag", "seg"])

    return docs.mapInArrow(run, "node long, frag int, seg binary")


@F.pandas_udf(T.LongType())
def _overlap(a, b):
    """Partial overlap of two sorted segments."""
    out = np.empty(len(a), np.int64)
    for i, (x, y) in enumerate(zip(a, b)):
        x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        if len(x) > len(y):
            x, y = y, x
        if not len(x):
            out[i] = 0
            continue
        at = np.searchsorted(y, x)
        at[at == len(y)] = 0
        out[i] = int((y[at] == x).sum())
    import pandas as pd

    return pd.Series(out)


def verify_pairs(pairs: DataFrame, reps: DataFrame, docs: DataFrame, keep: Scratch, k: int, num: int, den: int, seed: int, id_col: str, text_col: str) -> DataFrame:
    """Linked pairs (a, b) of candidate pairs (a, b, na, nb) of digests: partial overlaps per fragment, summed per pair.

    ``reps`` (node, rep) names an id whose row has the set; another text under
    that id is left out by its digest.
    """
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    ids, n_ids = keep.save_counted(nodes.join(reps, "node").select("rep").distinct(), "ids")
    src = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).cast("string").alias("text"))
    rows = src.join(broadcast_if_small(ids, MAX_BROADCAST_IDS, n_ids), "rep", "left_semi").select("text")
    segs = keep.save(_segments(rows, k, seed), "segments").dropDuplicates(["node", "frag"])
    frags = F.explode(F.array(*(F.lit(i) for i in range(VERIFY_FRAGMENTS)))).alias("frag")
    both = (
        pairs.select("a", "b", "na", "nb", frags)
        .join(segs.select(F.col("node").alias("a"), "frag", F.col("seg").alias("sa")), ["a", "frag"])
        .join(segs.select(F.col("node").alias("b"), "frag", F.col("seg").alias("sb")), ["b", "frag"])
        .select("a", "b", "na", "nb", _overlap("sa", "sb").alias("part"))
    )
    inter = both.groupBy("a", "b", "na", "nb").agg(F.sum("part").alias("i"))
    return inter.filter(F.lit(den) * F.col("i") >= F.lit(num) * (F.col("na") + F.col("nb") - F.col("i"))).select("a", "b")


def _may_link(x: str, y: str, num: int, den: int):
    """Exact necessary condition: a lower bound of the difference is within what linked sets allow."""
    col = lambda s, c: F.col(f"{s}{c}")
    differ = reduce(lambda p, q: p + q, (F.bit_count(col(x, f"s{i}").bitwiseXOR(col(y, f"s{i}"))) for i in range(SKETCH)))
    low = F.greatest(differ, F.abs(col(x, "n") - col(y, "n")))
    return low * (den + num) <= (den - num) * (col(x, "n") + col(y, "n"))


def _peeled(rows: DataFrame, needs: DataFrame, other: Column, keep: Scratch) -> DataFrame:
    """Rows of buckets (key, node, ...) that hold more than one ``other``, of nodes with as many of them as they need."""
    return _peel(rows, None, needs, other, keep)[0]


def _peel(rows: DataFrame, n: int | None, needs: DataFrame, other: Column, keep: Scratch) -> tuple[DataFrame, int | None]:
    """The rows that :func:`_peeled` leaves, and their number; n: the number of ``rows``, if known.

    A set shares at least need segment keys with each partner (need0 or need1
    by the key's scheme), so one with fewer open buckets has none; keys of
    prefix n-grams need one.  Linear in the rows, round after round; a round
    that takes no row is the last, as the next would do the same.
    """
    by_key, parity = Window.partitionBy("key"), F.col("key").bitwiseAND(3)
    for _ in range(PEELS):
        rows = rows.withColumn("lo", F.min(other).over(by_key)).withColumn("hi", F.max(other).over(by_key)).filter("lo <> hi").drop("lo", "hi")
        enough = rows.groupBy("node", parity.alias("p")).agg(F.count("*").alias("c")).join(needs, "node")
        enough = enough.filter((F.col("p") > 1) | (F.col("c") >= F.when(F.col("p") == 0, F.col("need0")).otherwise(F.col("need1"))))
        if n == 0:
            break
        before = n
        rows, n = keep.save_counted(rows.withColumn("p", parity).join(enough.select("node", "p"), ["node", "p"], "left_semi").drop("p"), "open")
        if n == before:
            break
    return rows, n


def set_components(docs: DataFrame, k: int, num: int, den: int, keep: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h, n_shingles, node, component, component_id) of every row.

    h is the hash of the text, node the digest of its set, component the
    smallest digest that links reach, component_id the smallest id of its rows.
    """
    for seed in range(8):
        sets = keep.save(shingle_sets(docs, k, num, den, seed, id_col, text_col), "sets")
        full = sets.filter("n_shingles > 0")
        same = ["need0", "need1", *(f"s{i}" for i in range(SKETCH))]
        classes = full.groupBy("d1").agg(
            F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n"), *(F.min(c).alias(c) for c in same),
            F.min("d2").alias("lo"), F.max("d2").alias("hi"),
        )
        classes = keep.save(classes.withColumnRenamed("d1", "node"), "classes")
        if classes.filter("lo <> hi").isEmpty():  # else two different sets share a digest: take other digests
            break
    named = classes.filter("rep IS NOT NULL")
    needs, reps = named.select("node", "need0", "need1"), named.select("node", "rep")
    keys = segment_keys(docs, k, num, den, seed, text_col)
    by_key = Window.partitionBy("key")
    shared = keys.withColumn("c0", F.min("node").over(by_key)).withColumn("c1", F.max("node").over(by_key)).filter("c0 <> c1")
    shared, n = keep.save_counted(shared.select("key", "node").distinct(), "buckets")
    buckets, n = _peel(shared, n, needs, F.col("node"), keep)
    # the member of a bucket that shares most segments is the likeliest to be near the others
    degree = buckets.groupBy("node").agg(F.count("*").alias("degree"))
    buckets = buckets.join(degree, "node")

    own = named.select("node", "n", *(f"s{i}" for i in range(SKETCH)))
    labels = tested = None
    side = lambda p: own.toDF(*(f"{p}{c}" for c in own.columns))
    swap = lambda c: F.when(F.col("xnode") < F.col("ynode"), F.col(f"x{c}")).otherwise(F.col(f"y{c}"))
    other = lambda c: F.when(F.col("xnode") < F.col("ynode"), F.col(f"y{c}")).otherwise(F.col(f"x{c}"))

    def checked(df: DataFrame) -> None:
        """Merge the components of links among the candidate pairs (columns x*, y*) not checked before."""
        nonlocal tested, labels
        new = df.select(swap("node").alias("a"), other("node").alias("b"), swap("n").alias("na"), other("n").alias("nb")).filter("a <> b").distinct()
        if tested is not None:
            new = new.join(tested, ["a", "b"], "left_anti")
        new, n_new = keep.save_counted(new, "candidates")
        if not n_new:
            return
        more = keep.save(verify_pairs(new, reps, docs, keep, k, num, den, seed, id_col, text_col), "links")
        tested = new.select("a", "b") if tested is None else tested.unionByName(new.select("a", "b"))
        tree = labels.select(F.col("node").alias("a"), F.col("component").alias("b")).filter("a <> b") if labels is not None else None
        labels = connected_components(more if tree is None else tree.unionByName(more), keep=keep)

    def still_open(rows: DataFrame, n: int | None = None) -> tuple[DataFrame, int]:
        """Rows (key, node, degree, comp) of buckets that hold members of different components, and their number."""
        if labels is not None:
            rows = rows.join(labels, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
        else:
            rows = rows.withColumn("comp", F.col("node"))
        return _peel(rows, n, needs, F.col("comp"), keep)

    for i in range(STAR_ROUNDS):
        rows, n = still_open(buckets, None if i else n)
        if not n:  # no bucket holds members of different components
            break
        rows = keep.save(rows.withColumn("top", F.max(F.struct("degree", "node", "comp")).over(by_key)), "stars")
        star = rows.filter("comp <> top.comp").select(F.col("node").alias("xnode"), F.col("top.node").alias("ynode")).distinct()
        checked(star.join(side("x"), "xnode").join(side("y"), "ynode").filter(_may_link("x", "y", num, den)))
        buckets = rows.filter("node <> top.node").select("key", "node", "degree")  # the top's pairs are all done
    else:  # what is left: members of different components that share a segment
        rows, n = still_open(buckets)
        rows = rows.select("key", "comp", "node").join(own, "node")
        pre = lambda p: rows.toDF(*(f"{p}{c}" for c in rows.columns))
        if n:
            checked(pre("x").join(pre("y"), (F.col("xkey") == F.col("ykey")) & (F.col("xcomp") < F.col("ycomp")) & _may_link("x", "y", num, den)))
    if labels is None:
        labels = docs.sparkSession.createDataFrame([], "node long, component long")

    where = classes.join(labels, "node", "left").select("node", "rep", F.coalesce("component", "node").alias("component"))
    least = where.groupBy("component").agg(F.min("rep").alias("component_id"))
    where = where.drop("rep").join(least, "component")
    rows = sets.select("doc_id", "h", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("d1")).alias("node"))
    return rows.join(where, "node", "left").withColumn("component_id", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")))


def similar_components(
    docs: DataFrame, k: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row, as a written table.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a text's set
    holds its distinct k-word shingles (fewer words: the sequence as one).
    Two texts link when den * intersection >= num * union; component_id is
    the smallest doc_id reachable by links.  Null and empty texts have
    size 0 and link with nothing; repeated rows and equal ids share the
    component of their text (different texts under one id are apart); a null
    id gets the component of its text too, but never names one.  An empty
    table gives no rows; long texts are hashed in bounded slices; other
    columns are ignored.
    """
    with Scratch(docs.sparkSession) as keep:
        rows = set_components(docs, k, num, den, keep, id_col, text_col)
        return save(rows.select("doc_id", "n_shingles", "component_id"), "components")


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near copies, with all its columns; nothing goes but for a link or an equal text.

    Of a group the rows with the smallest id stay, of those the ones whose
    text has the smallest hash, and of equal rows of one id and text the first
    one.  Rows without an id cannot be named and stay; so do null, empty and
    blank texts, which are copies of nothing.
    """
    gone, which, nth = (free_name(docs, x) for x in ("gone_id", "gone_text", "nth"))
    ident, text = F.col(id_col).cast("long"), F.xxhash64(F.col(text_col).cast("string"))
    with Scratch(docs.sparkSession) as keep:
        groups = keep.save(set_components(docs, k, num, den, keep, id_col, text_col).filter("doc_id IS NOT NULL AND n_shingles > 0"), "groups")
        copies = groups.filter("doc_id <> component_id").select("doc_id", "h")
        repeated, again = keep.save_counted(groups.filter("doc_id = component_id").groupBy("component", "doc_id").agg(F.count("*").alias("c"), F.min("h").alias("first")).filter("c > 1"), "repeated")
        if again:
            more = groups.join(repeated, ["component", "doc_id"]).filter("h <> first").select("doc_id", "h")
            copies = copies.unionByName(more)
        copies, n = save_counted(copies.distinct().toDF(gone, which), "copies")
        firsts = save(repeated.select(F.col("doc_id").alias(gone), F.col("first").alias(which)), "firsts") if again else None
    out = docs.join(broadcast_if_small(copies, MAX_BROADCAST_IDS, n), (ident == F.col(gone)) & (text == F.col(which)), "left_anti")
    if firsts is not None:  # rows of one id and text: number those only
        out = out.join(broadcast_if_small(firsts.withColumn(nth, F.lit(True)), MAX_BROADCAST_IDS, again), (ident == F.col(gone)) & (text == F.col(which)), "left").drop(gone, which)
        alone = out.filter(F.col(nth).isNull()).drop(nth)
        rest = out.filter(F.col(nth)).withColumn(nth, F.row_number().over(Window.partitionBy(id_col, text_col).orderBy(id_col)))
        out = alone.unionByName(rest.filter(F.col(nth) == 1).drop(nth))
    return out
