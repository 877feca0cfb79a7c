"""Item-based collaborative filtering from SVD factors.

Scores are S = U diag(sigma^3) V^t (for exact factors of the rating
matrix A this is A A^t A: ratings times item-item co-occurrence).  Per
user, items with score > threshold are kept (as score / threshold), NaN
scores are dropped and the n best are returned, ties broken by the
smaller item id.

Two physical plans, as in the reference:

* :func:`recommend` ("small V"): V is collected once - only after its
  size has been checked against ``max_broadcast_bytes`` - and broadcast;
  a single map-only pass over U scores every user against all items in
  bounded chunks and emits only top-n rows.  Users without any kept item
  are dropped.  If V is over the limit the split plan is used instead.
* :func:`recommend_split` ("split V"): V is hashed into ``n_splits``
  parts and U into blocks of ``user_block_rows`` users; each
  (user block, V part) pair is one co-group whose dense score block is
  computed with BLAS and reduced to top-n per user at once.  Partial
  lists are merged with a window top-n.  Users without any kept item
  are kept with a NULL item.

No plan emits a row per (user, item) pair: only top-n rows leave a task.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.accumulators import AccumulatorParam
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skinnyqr.functions.arrow import list_to_matrix
from skinnyqr.functions.kernels import topn_pruned
from skinnyqr.operators.topn import top_n
from skinnyqr.operators.tsqr import _to_arrow
from skinnyqr.session import ship_package, spread

# every Python worker holds its own copy of V, so this counts once per core
DEFAULT_MAX_BROADCAST_BYTES = 32 << 20
# factor bytes per (user block, V part) co-group side in the split plan; every Python worker holds a co-group
GROUP_BYTES = 64 << 20
# users of a co-group scored at a time
SCORE_ROWS = 1 << 14
# co-groups up to which each gets a partition of its own
MAX_EVEN_KEYS = 4096


def _sigma_cubed(sigma, k: int) -> np.ndarray:
    s = np.asarray(sigma, dtype=np.float64)[:k]
    return s * s * s


def _out_schema(user_field: T.StructField, item_field: T.StructField) -> T.StructType:
    return T.StructType(
        [
            T.StructField(user_field.name, user_field.dataType, False),
            T.StructField(item_field.name, item_field.dataType, False),
            T.StructField("score", T.DoubleType(), False),
            T.StructField("rank", T.IntegerType(), False),
        ]
    )


def _mask_seen(scores: np.ndarray, items: np.ndarray, offsets: np.ndarray, values: np.ndarray) -> None:
    """Set scores of already-seen items to -inf, vectorised.

    Row r of ``scores`` has seen items ``values[offsets[r]:offsets[r+1]]``
    (the flat buffers of an Arrow list column).
    """
    lens = np.diff(offsets)
    if lens.sum() == 0 or len(items) == 0:
        return
    flat = values[offsets[0] : offsets[-1]]
    rows = np.repeat(np.arange(len(lens)), lens)
    order = np.argsort(items, kind="stable")
    sorted_items = items[order]
    pos = np.minimum(np.searchsorted(sorted_items, flat), len(sorted_items) - 1)
    hit = sorted_items[pos] == flat
    scores[rows[hit], order[pos[hit]]] = -np.inf


def _score_block(users, u3: np.ndarray, scale: np.ndarray, items: np.ndarray, vmat: np.ndarray, n: int, threshold: float,
                 seen=None, scaled: bool = True, cells=None):
    """Top-n per user of (u3 @ vmat^t), pruned by bounds of the scores.

    ``seen`` (optional ``(offsets, values)`` of an Arrow list column, one
    list of item ids per user row) removes those items from the user's
    candidates before ranking.  ``cells``, an accumulator of pairs, counts
    the scores computed and those of all user-item pairs.
    """
    mask = None
    if seen is not None:
        offsets, values = seen

        def mask(scores, rows, here):
            lens = offsets[rows + 1] - offsets[rows]
            start = np.concatenate([[0], np.cumsum(lens)])
            pick = np.arange(start[-1]) - np.repeat(start[:-1], lens) + np.repeat(offsets[rows], lens)
            _mask_seen(scores, here, start, values[pick])

    rows, it, sc, rk, done = topn_pruned(u3, vmat, scale, items, n, threshold, mask)
    if cells is not None:
        cells.add(np.array([done, u3.shape[0] * len(items)], dtype=np.int64))
    return np.asarray(users)[rows], it, sc / threshold if scaled else sc, rk


class _Pairs(AccumulatorParam):
    def zero(self, value):
        return np.zeros(2, dtype=np.int64)

    def addInPlace(self, a, b):
        return a + b


def scored_cells(spark):
    """An accumulator for ``cells=``: (scores computed, user-item pairs), filled by the tasks that ran."""
    return spark.sparkContext.accumulator(np.zeros(2, dtype=np.int64), _Pairs())


def _even_keys(spark, count: int, parts: int) -> list[int]:
    """``count`` keys that hash partitioning deals to ``count`` different ones of ``parts`` partitions."""
    rows = spark.range(parts * 64).groupBy(F.pmod(F.hash("id"), F.lit(parts)).alias("p")).agg(F.min("id").alias("id")).collect()
    keys = [r["id"] for r in sorted(rows, key=lambda r: r["p"])]
    used = set(keys)
    return (keys + [i for i in range(parts * 64, parts * 64 + count) if i not in used])[:count]


def _or_empty(col: str):
    return F.coalesce(F.col(col), F.array().cast("array<bigint>"))


def _seen_of(batch) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, values) of the non-null ``_seen`` list column of an Arrow batch or table."""
    arr = batch.column("_seen")
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    return arr.offsets.to_numpy(), arr.values.to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


def _check_threshold(threshold: float) -> float:
    threshold = float(threshold)
    if not threshold > 0:
        raise ValueError("threshold must be > 0 (scores are reported as score / threshold)")
    return threshold


def _check_n(n: int) -> int:
    if n < 1:
        raise ValueError("n must be >= 1")
    return int(n)


def recommend(
    u: DataFrame,
    v: DataFrame,
    sigma,
    n: int = 10,
    threshold: float = 1.0,
    user: str = "user_id",
    item: str = "item_id",
    u_col: str = "u",
    v_col: str = "v",
    max_broadcast_bytes: int = DEFAULT_MAX_BROADCAST_BYTES,
    exclude: DataFrame | None = None,
    cells=None,
) -> DataFrame:
    """Top-n items per user, small-V plan (users with no item are dropped).

    Returns ``(user, item, score, rank)``.  ``sigma`` holds at least k
    singular values (k = length of the factor rows).  ``exclude`` (pairs
    ``(user, item)``, e.g. the ratings) removes already-seen items before
    ranking; the reference does not, so it is off by default.  Pairs whose
    item is not in V are left out first, so a user's list holds at most
    V's item count, which the size check bounds.  Both plans rank on the
    raw score and divide by the threshold last.  Items that cannot reach a
    user's list are not scored (``topn_pruned``); ``cells``
    (:func:`scored_cells`) tells how many were.
    """
    threshold, n = _check_threshold(threshold), _check_n(n)
    spark = u.sparkSession
    ship_package(spark)
    # one pass: item count and factor width, checked before anything is collected
    stats = v.agg(F.count(F.lit(1)).alias("m"), F.max(F.size(v_col)).alias("k")).first()
    n_items, k = int(stats["m"]), int(stats["k"] or 0)
    if n_items == 0:
        return spark.createDataFrame([], _out_schema(u.schema[user], v.schema[item]))
    if n_items * (k * 8 + 16) > max_broadcast_bytes:
        # V is not provably small: score against hashed parts of V instead
        parts = math.ceil(n_items * (k * 8 + 16) / max_broadcast_bytes)
        return recommend_split(u, v, sigma, n, threshold, user, item, u_col, v_col, n_splits=parts,
                               keep_empty=False, exclude=exclude, cells=cells)
    vpd = v.select(item, F.col(v_col).cast("array<double>").alias("_v")).toArrow()
    items = vpd.column(item).to_numpy().astype(np.int64)
    vmat = list_to_matrix(vpd.column("_v"), k) if len(items) else np.zeros((0, k))
    bc = spark.sparkContext.broadcast((items, vmat))
    s3 = _sigma_cubed(sigma, k)
    schema = _out_schema(u.schema[user], v.schema[item])
    out_schema = _to_arrow(schema)

    with_seen = exclude is not None

    def fn(batches):
        its, vm = bc.value
        for rb in batches:
            if rb.num_rows == 0:
                continue
            u3 = list_to_matrix(rb.column("_u"), k) * s3[None, :]
            users = rb.column(user).to_numpy()
            uu, ii, ss, rr = _score_block(users, u3, s3, its, vm, n, threshold, _seen_of(rb) if with_seen else None, cells=cells)
            if len(uu):
                yield pa.RecordBatch.from_pydict({user: uu, item: ii, "score": ss, "rank": rr}, schema=out_schema)

    users = u.select(user, F.col(u_col).cast("array<double>").alias("_u"))
    if with_seen:
        known = F.broadcast(v.select(item))  # its size was checked above
        seen = exclude.join(known, item, "left_semi").groupBy(F.col(user)).agg(F.collect_set(F.col(item).cast("long")).alias("_seen"))
        users = users.join(seen, user, "left").withColumn("_seen", _or_empty("_seen"))
    return spread(users, [user]).mapInArrow(fn, schema)


def recommend_split(
    u: DataFrame,
    v: DataFrame,
    sigma,
    n: int = 10,
    threshold: float = 1.0,
    user: str = "user_id",
    item: str = "item_id",
    u_col: str = "u",
    v_col: str = "v",
    n_splits: int | None = 2,
    user_block_rows: int | None = None,
    keep_empty: bool = True,
    exclude: DataFrame | None = None,
    cells=None,
) -> DataFrame:
    """Top-n items per user, split-V plan.

    V is hashed into ``n_splits`` parts (None: parts of about
    ``GROUP_BYTES``), U into blocks of about ``user_block_rows`` users
    (None: blocks of about ``GROUP_BYTES``).  Requested values are raised
    (parts) or lowered (block rows) when a side of a co-group would
    exceed ``GROUP_BYTES``; the result does not depend on them.  Each (user block, V part)
    co-group holds one block of U and one part of V, so task memory is
    bounded by these sizes, not by the data.  U is shipped once per V part
    and V once per user block; sizing blocks by bytes keeps the number of
    V copies near the number of task slots rather than growing with the
    user count.  With ``keep_empty`` every user of U appears, users
    without any kept item with NULL item/score/rank.  ``exclude`` pairs
    are grouped by (user, V part), so a user's excluded list in one
    co-group never exceeds the items of that part (pairs whose item is
    not in V are left out first).
    """
    threshold, n = _check_threshold(threshold), _check_n(n)
    spark = u.sparkSession
    ship_package(spark)
    vstats = v.agg(F.count(F.lit(1)).alias("m"), F.max(F.size(v_col)).alias("k")).first()
    n_items, k = int(vstats["m"]), int(vstats["k"] or 0)
    if n_items == 0:
        empty = spark.createDataFrame([], _out_schema(u.schema[user], v.schema[item]))
        return u.select(user).join(empty, user, "left") if keep_empty else empty
    row_bytes = k * 8 + 16
    if n_splits is not None and n_splits < 1:
        raise ValueError("n_splits must be >= 1")
    # never fewer parts than the byte budget allows (results do not depend on it)
    n_splits = max(n_splits or 1, math.ceil(n_items * row_bytes / GROUP_BYTES), 1)
    n_users = u.count()
    if user_block_rows is None:
        n_blocks = max(1, math.ceil(n_users * row_bytes / GROUP_BYTES))
        # more blocks to fill the cores, while the extra copies of V stay
        # cheaper than one pass over U (or 1 GB)
        want = math.ceil(spark.sparkContext.defaultParallelism / n_splits)
        if want > n_blocks and want * n_items * row_bytes <= max(n_users * row_bytes, 1 << 30):
            n_blocks = want
    else:
        block = max(1, min(user_block_rows, GROUP_BYTES // row_bytes))
        n_blocks = max(1, math.ceil(n_users / block))
    s3 = _sigma_cubed(sigma, k)
    schema = _out_schema(u.schema[user], v.schema[item])
    out_schema = _to_arrow(schema)

    # co-group keys must have identical types on both sides: the two sides
    # are hash-partitioned independently, and INT and BIGINT hash differently
    u_rep = u.select(
        user,
        F.col(u_col).cast("array<double>").alias("_u"),
        F.pmod(F.xxhash64(F.col(user)), F.lit(n_blocks)).cast("long").alias("_ub"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_splits - 1).cast("long"))).alias("_vp"),
    )
    v_rep = v.select(
        item,
        F.col(v_col).cast("array<double>").alias("_v"),
        F.pmod(F.xxhash64(F.col(item)), F.lit(n_splits)).cast("long").alias("_vp"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))).alias("_ub"),
    )

    with_seen = exclude is not None
    if with_seen:
        seen = exclude.join(v.select(item), item, "left_semi").select(
            F.col(user), F.col(item).cast("long").alias("_it"),
            F.pmod(F.xxhash64(F.col(item)), F.lit(n_splits)).cast("long").alias("_vp"),
        ).groupBy(user, "_vp").agg(F.collect_set("_it").alias("_seen"))
        u_rep = u_rep.join(seen, [user, "_vp"], "left").withColumn("_seen", _or_empty("_seen"))

    def fn(ut: pa.Table, vt: pa.Table) -> pa.Table:
        if ut.num_rows == 0 or vt.num_rows == 0:
            return out_schema.empty_table()
        vm, items = list_to_matrix(vt.column("_v"), k), vt.column(item).to_numpy().astype(np.int64)
        best = []
        # batches of the block, so that its rows are held once and only a batch is scaled
        for rb in ut.to_batches(max_chunksize=SCORE_ROWS):
            u3 = list_to_matrix(rb.column("_u"), k) * s3[None, :]
            uu, ii, ss, rr = _score_block(rb.column(user).to_numpy(), u3, s3, items, vm, n, threshold,
                                          _seen_of(rb) if with_seen else None, scaled=False, cells=cells)
            best.append(pa.table({user: uu, item: ii, "score": ss, "rank": rr}, schema=out_schema))
        return pa.concat_tables(best)

    # scoring cost is users x items per co-group, not its input bytes: pin the
    # partition count so AQE does not merge co-groups into fewer tasks, and
    # name the co-groups so that each hashes to a partition of its own
    # (both sides use the same key and count, so the co-group adds no exchange)
    pairs = n_blocks * n_splits
    parts = max(pairs, spark.sparkContext.defaultParallelism)
    group = F.col("_ub") * n_splits + F.col("_vp")
    if pairs <= MAX_EVEN_KEYS:
        names = F.array(*[F.lit(x).cast("long") for x in _even_keys(spark, pairs, parts)])
        group = F.element_at(names, (group + 1).cast("int"))
    u_rep = u_rep.withColumn("_g", group).drop("_ub", "_vp").repartition(parts, "_g")
    v_rep = v_rep.withColumn("_g", group).drop("_ub", "_vp").repartition(parts, "_g")
    partial = u_rep.groupBy("_g").cogroup(v_rep.groupBy("_g")).applyInArrow(fn, schema)
    merged = top_n(partial.drop("rank"), user, "score", n, tiebreak=item)
    merged = merged.withColumn("score", F.col("score") / F.lit(threshold))
    if not keep_empty:
        return merged
    users = u.select(user)
    return users.join(merged, user, "left")


def score_pairs(
    u: DataFrame,
    v: DataFrame,
    sigma,
    pairs: DataFrame,
    user: str = "user_id",
    item: str = "item_id",
    u_col: str = "u",
    v_col: str = "v",
    power: int = 3,
) -> DataFrame:
    """Scores u diag(sigma^power) v^t at the given (user, item) pairs only.

    power=3 gives the recommender's scores, power=1 the reconstruction
    U Sigma V^t, power=0 the product of half-sigma factors.  Two
    equi-joins and a JVM-side dot product: the cost is linear in the
    number of pairs, never users x items.
    """
    first = v.select(F.size(v_col).alias("k")).take(1)
    k = int(first[0]["k"]) if first else 0
    sp = [float(x) ** power for x in np.asarray(sigma, dtype=np.float64)[:k]]
    uu = u.select(user, F.col(u_col).cast("array<double>").alias("_u"))
    vv = v.select(item, F.col(v_col).cast("array<double>").alias("_v"))
    # a fixed-length sum of products keeps the projection inside whole-stage codegen
    terms = [F.col("_u")[c] * F.col("_v")[c] * F.lit(sp[c]) for c in range(k)]
    score = sum(terms[1:], terms[0]) if terms else F.lit(0.0)
    return (
        pairs.select(user, item)
        .join(uu, user)
        .join(vv, item)
        .select(user, item, score.alias("score"))
    )
