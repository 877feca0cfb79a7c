"""Stochastic SVD of a sparse (COO) or dense matrix on top of TSQR.

A (users x items, COO rows ``(user, item, rating)``) ~= U diag(sigma) V^t:

0. The cells are dealt to partitions by user once (:func:`user_layout`) and
   kept; users with very many cells are salted over several partitions.  This
   is the only exchange of cells.
1. Y = A Omega (users x kp, kp = k + p), row by row inside the partitions.
   Omega's entries come from a counter, so Omega is never stored or shipped.
   Rows of salted users are partial and added up on their own.
2. An orthonormal basis Q of the columns of Y (:func:`range_basis`): the SVD
   of R1 (R of Y, one streaming pass) gives the directions that Y has and a
   kp x r matrix M1 that makes them orthonormal up to rounding; R2 of Y M1
   (a second pass) refines them.  Q = (Y M1) M2 is a map-only plan of Y.
3. B^t = A^t Q: the tasks that hold a user's cells compute its row of Q again
   and add up cell times row by item; a task emits each of its items once
   (bounded, else several times), and one aggregation adds the tasks up.
   Neither Q nor the cells are shuffled for it.
4. R of B^t by TSQR, and the SVD of that small R: singular values are right
   to about 1e-16 of the largest, where the roots of the eigenvalues of the
   Gram matrix B B^t are lost below 1e-8 of it.
5. U = Q W and V = B^t W / sigma, refined like Q so that its columns stay
   orthonormal: map-only passes with small matrices in the task closure.

With keys that are no integers, or with a table of Omega, steps 1 and 3 are
``groupBy(user)`` sums (:func:`random_projection`) and a join of A with Q on the
user key (:func:`at_times_q`).

Dense rows ``(row_id, v ARRAY<DOUBLE>[n])`` use :func:`stochastic_svd_dense`:
every step is a streaming pass over A that recomputes (a Omega) M1 M2 where it
is needed.  A is neither shuffled, nor joined with Q, nor cached; tasks emit
n rows of partial sums of B^t.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skinnyqr.functions.arrow import list_to_matrix, matrix_to_list
from skinnyqr.functions.columns import omega_sum_array, weighted_sum_array
from skinnyqr.functions.kernels import omega_rows, sums_by_key
from skinnyqr.operators.tsqr import _to_arrow, _width, map_rows, r_on_driver, times
from skinnyqr.session import materialize, ship_package

DEFAULT_SEED = 7919


def random_projection(
    ratings: DataFrame,
    kp: int,
    seed: int = DEFAULT_SEED,
    user: str = "user_id",
    item: str = "item_id",
    rating: str = "rating",
    omega_table: DataFrame | None = None,
) -> DataFrame:
    """Y = A Omega as dense rows ``(user, y ARRAY<DOUBLE>)`` of length kp.

    Without ``omega_table`` the entries of Omega are uniform on [-1, 1)
    from a hash of (seed, item, c).  ``omega_table`` may instead give
    Omega explicitly, either as ``(item_id, w ARRAY<DOUBLE>)`` or in long
    form ``(item_id, c, w)``; it is joined on the item key, and a rated
    item that the table lacks raises.
    """
    a = ratings.select(user, item, F.col(rating).cast("double").alias("_r"))
    if omega_table is None:
        return a.groupBy(user).agg(omega_sum_array(seed, item, "_r", kp).alias("y"))
    om = _omega_arrays(omega_table, kp, item)
    lacking = F.raise_error(F.concat(F.lit("item not in the Omega table: "), F.col(item).cast("string")))
    a = a.join(om, item, "left").withColumn("_w", F.coalesce("_w", lacking.cast("array<double>")))
    return a.groupBy(user).agg(weighted_sum_array("_r", "_w", kp).alias("y"))


def _omega_arrays(omega_table: DataFrame, kp: int, item: str) -> DataFrame:
    cols = omega_table.columns
    if "c" in cols:
        w = [F.coalesce(F.max(F.when(F.col("c") == c, F.col("w").cast("double"))), F.lit(0.0)) for c in range(kp)]
        return omega_table.groupBy(F.col(item)).agg(F.array(*w).alias("_w"))
    return omega_table.select(F.col(item), F.col("w").cast("array<double>").alias("_w"))


def at_times_q(
    ratings: DataFrame,
    q: DataFrame,
    kp: int,
    user: str = "user_id",
    item: str = "item_id",
    rating: str = "rating",
    q_col: str = "q",
) -> DataFrame:
    """B^t = A^t Q as rows ``(item, b ARRAY<DOUBLE>)``.

    A and Q are matched on the user key (never by position).  The join
    is a plain equi-join: Catalyst/AQE pick broadcast or sort-merge and
    split skewed user partitions; the sum per item is partially
    aggregated before its shuffle.
    """
    joined = ratings.select(user, item, F.col(rating).cast("double").alias("_r")).join(
        q.select(F.col(user), F.col(q_col).cast("array<double>").alias("_q")), user
    )
    return joined.groupBy(item).agg(weighted_sum_array("_r", "_q", kp).alias("b"))


#: Partial Gram matrices that one group of a round adds up.
GRAM_FANIN = 64


def gram_cells(df: DataFrame, vec: str) -> DataFrame:
    """Gram matrix X^t X of the rows of ``vec`` as cells ``(i, j, g)``.

    Each task folds its Arrow batches into one partial Gram matrix and emits
    its upper triangle as one row; rounds of at most ``GRAM_FANIN`` rows a
    group add these up, so a round moves as many rows as there are tasks
    before it.  The last row is spread into cells of both triangles.
    """
    ship_package(df.sparkSession)
    schema = T.StructType([T.StructField("node", T.LongType(), False), T.StructField("g", T.ArrayType(T.DoubleType(), False), False)])
    packed = _to_arrow(schema)

    def fold(batches):
        from pyspark import TaskContext

        g = None
        for rb in batches:
            if rb.num_rows == 0:
                continue
            x = list_to_matrix(rb.column("_x"))
            part = x.T @ x
            g = part if g is None else g + part
        if g is not None:
            upper = g[np.triu_indices(g.shape[0])][None, :]
            yield pa.RecordBatch.from_pydict({"node": [TaskContext.get().partitionId()], "g": matrix_to_list(upper)}, schema=packed)

    def add(tbl: pa.Table) -> pa.Table:
        tbl = tbl.sort_by("node")  # one order of addition, whatever arrives first
        total = list_to_matrix(tbl.column("g")).sum(axis=0)[None, :]
        return pa.table({"node": tbl.column("_parent").slice(0, 1), "g": matrix_to_list(total)}, schema=packed)

    cell_schema = T.StructType([T.StructField("i", T.IntegerType(), False), T.StructField("j", T.IntegerType(), False),
                                T.StructField("g", T.DoubleType(), False)])
    cells = _to_arrow(cell_schema)

    def spread_out(batches):
        for rb in batches:
            if rb.num_rows == 0:
                continue
            upper = list_to_matrix(rb.column("g"))[0]
            k = int((np.sqrt(8 * upper.size + 1) - 1) / 2 + 0.5)
            g = np.zeros((k, k))
            g[np.triu_indices(k)] = upper
            g = np.triu(g) + np.triu(g, 1).T
            ii, jj = np.indices((k, k), dtype=np.int32)
            yield pa.RecordBatch.from_pydict({"i": ii.reshape(-1), "j": jj.reshape(-1), "g": g.reshape(-1)}, schema=cells)

    level = materialize(df.select(F.col(vec).cast("array<double>").alias("_x")).mapInArrow(fold, schema), eager=False)
    most, groups = level.count(), 0
    while most > 1:
        groups = -(-most // GRAM_FANIN)
        parent = F.pmod(F.col("node"), F.lit(groups)) if groups > 1 else F.lit(0).cast("long")
        level = level.withColumn("_parent", parent).groupBy("_parent").applyInArrow(add, schema)
        most = groups
    return level.mapInArrow(spread_out, cell_schema)


def gram_matrix(df: DataFrame, vec: str, k: int | None = None) -> np.ndarray:
    """X^t X collected to the driver (k x k numbers)."""
    cells = gram_cells(df, vec).collect()
    size = k if k is not None else (max((c["i"] for c in cells), default=-1) + 1)
    g = np.zeros((size, size))
    for c in cells:
        g[c["i"], c["j"]] = c["g"]
    return g


#: Singular values at or below this share of the largest count as zero.
ZERO_SHARE = 1e-12


def range_basis(y: DataFrame, n: int, mats=(), width: int | None = None, schedule=None) -> tuple[np.ndarray, np.ndarray]:
    """(M1, M2) so that the rows ``_v`` of ``y``, times ``mats``, M1 and M2, are an orthonormal basis of its columns.

    Works at any rank: directions with at most ZERO_SHARE of the largest
    singular value are left out (a zero matrix keeps one zero column).
    """
    w = n if width is None else width
    r1 = r_on_driver(y, n, mats, w, schedule)
    _, s, vt = np.linalg.svd(r1)
    r = int((s > ZERO_SHARE * s[0]).sum()) if s.size and s[0] > 0 else 0
    if r == 0:
        return np.zeros((w, 1)), np.eye(1)
    m1 = vt[:r].T / s[:r]
    r2 = r_on_driver(y, n, (*mats, m1), r, schedule)
    return m1, np.linalg.inv(r2)


#: Bytes of cells per partition of the layout (24 a cell).
LAYOUT_BYTES = 64 << 20
#: A user with more cells than this, and than twice a partition's share, is salted.
HEAVY_CELLS = 1_000_000
#: Cells multiplied at a time, and bytes of sums by item that a task holds before it emits them.
CHUNK_CELLS, HELD_BYTES = 1 << 15, 64 << 20


def user_layout(a: DataFrame, user: str, item: str, rating: str, reliable: bool = False) -> tuple[DataFrame, list[int]]:
    """(cells dealt by user and sorted in each partition, kept; the salted users).

    Cells of a salted user are dealt on by a hash of the item.  There are at
    most as many salted users as partitions.  Cells with a null are none.
    """
    a = a.select(F.col(user).cast("long").alias("u"), F.col(item).cast("long").alias("i"), F.col(rating).cast("double").alias("r")).dropna()
    counts = materialize(a.groupBy("u").agg(F.count(F.lit(1)).alias("n")), eager=False)
    total = int(counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    par = a.sparkSession.sparkContext.defaultParallelism
    parts = max(1, min(par, total // 1000 + 1), -(-total * 24 // LAYOUT_BYTES))
    limit = max(HEAVY_CELLS, 2 * total // parts)
    heavy = [(r["u"], -(-r["n"] // limit)) for r in counts.filter(F.col("n") > limit).collect()]
    counts.unpersist()
    salt = F.lit(0)
    if heavy:
        shares = a.sparkSession.createDataFrame(heavy, "u long, parts long")
        a = a.join(F.broadcast(shares), "u", "left")
        salt = F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("i"), F.col("parts"))).otherwise(0)
    cells = a.withColumn("s", salt).repartition(parts, "u", "s").sortWithinPartitions("u", "i", "r").select("u", "i", "r")
    return materialize(cells, reliable, eager=reliable), sorted(u for u, _ in heavy)


def _whole_users(batches):
    """(users, first cell of each, items, ratings) of sorted batches of cells; a user is never cut."""
    held: list = []

    def flush(parts):
        u, i, r = (np.concatenate(x) for x in zip(*parts))
        first = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
        return u[first], first, i, r

    for rb in batches:
        if rb.num_rows == 0:
            continue
        u, i, r = (rb.column(c).to_numpy() for c in range(3))
        cut = int(np.searchsorted(u, u[-1]))  # where the last user starts
        if cut or (held and held[-1][0][-1] != u[0]):
            held.append((u[:cut], i[:cut], r[:cut]))
            yield flush(held)
            held = []
        held.append((u[cut:], i[cut:], r[cut:]))
    if held:
        yield flush(held)


def _projected(first: np.ndarray, items: np.ndarray, ratings: np.ndarray, seed: int, kp: int) -> np.ndarray:
    """Rows of A Omega of whole users, a bounded number of cells at a time."""
    y = np.zeros((len(first), kp))
    for lo in range(0, len(items), CHUNK_CELLS):
        hi = min(len(items), lo + CHUNK_CELLS)
        kinds, at = np.unique(items[lo:hi], return_inverse=True)
        part = omega_rows(seed, kinds, kp)[at] * ratings[lo:hi, None]
        a = int(np.searchsorted(first, lo, side="right")) - 1  # the user of cell lo
        b = int(np.searchsorted(first, hi))
        y[a:b] += np.add.reduceat(part, np.maximum(first[a:b] - lo, 0), axis=0)
    return y


def layout_projection(cells: DataFrame, heavy: list[int], kp: int, seed: int, user: str) -> DataFrame:
    """Y = A Omega as rows ``(user, y)``: map-only, but for the partial rows of salted users."""
    ship_package(cells.sparkSession)
    schema = T.StructType([T.StructField(user, T.LongType(), False), T.StructField("y", T.ArrayType(T.DoubleType(), False), False)])
    out_schema = _to_arrow(schema)

    def run(only_heavy):
        def fn(batches):
            for u, first, i, r in _whole_users(batches):
                keep = np.isin(u, heavy) == only_heavy
                if not keep.any():
                    continue
                y = _projected(first, i, r, seed, kp)[keep]
                yield pa.RecordBatch.from_pydict({user: u[keep], "y": matrix_to_list(y)}, schema=out_schema)

        return fn

    light = cells.mapInArrow(run(False), schema)
    if not heavy:
        return light
    partial = cells.filter(F.col("u").isin(heavy)).mapInArrow(run(True), schema).withColumn("_one", F.lit(1.0))
    return light.unionByName(partial.groupBy(user).agg(weighted_sum_array("_one", "y", kp).alias("y")))


def layout_at_times_q(cells: DataFrame, known: dict[int, np.ndarray], kp: int, seed: int, basis, width: int, item: str) -> DataFrame:
    """B^t = A^t Q as rows ``(item, b)``; ``known`` holds the rows of Y of salted users."""
    spark = cells.sparkSession
    ship_package(spark)
    names = np.array(sorted(known), dtype=np.int64)
    shipped = spark.sparkContext.broadcast(np.array([known[x] for x in names.tolist()]).reshape(-1, kp))  # at most a row a partition
    schema = T.StructType([T.StructField(item, T.LongType(), False), T.StructField("b", T.ArrayType(T.DoubleType(), False), False)])
    out_schema = _to_arrow(schema)

    def fn(batches):
        held, rows = [], 0  # sums by item; the first entry is the merged one

        def merged():
            return sums_by_key(*(np.concatenate(x) for x in zip(*held)))

        for u, first, i, r in _whole_users(batches):
            y = _projected(first, i, r, seed, kp)
            salted = np.isin(u, names)
            if salted.any():
                y[salted] = shipped.value[np.searchsorted(names, u[salted])]
            q = times(y, basis)
            of = np.repeat(np.arange(len(u)), np.diff(np.append(first, len(i))))
            for lo in range(0, len(i), CHUNK_CELLS):
                s = slice(lo, lo + CHUNK_CELLS)
                held.append(sums_by_key(i[s], q[of[s]] * r[s, None]))
                rows += len(held[-1][0])
                if rows > 2 * len(held[0][0]) + 4 * CHUNK_CELLS:
                    held = [merged()]
                    rows = len(held[0][0])
                    if held[0][1].nbytes > HELD_BYTES:
                        yield pa.RecordBatch.from_pydict({item: held[0][0], "b": matrix_to_list(held[0][1])}, schema=out_schema)
                        held, rows = [], 0
        if held:
            keys, sums = merged()
            yield pa.RecordBatch.from_pydict({item: keys, "b": matrix_to_list(sums)}, schema=out_schema)

    parts = cells.mapInArrow(fn, schema).withColumn("_one", F.lit(1.0))
    return parts.groupBy(item).agg(weighted_sum_array("_one", "b", width).alias("b"))


@dataclass
class SSVDResult:
    """Factors of A ~= U diag(sigma[:k]) V^t.

    ``u``: (user, u ARRAY<DOUBLE>[k]); ``v``: (item, v ARRAY<DOUBLE>[k]);
    ``sigma``: all k + p singular values, largest first.
    """

    u: DataFrame | None
    v: DataFrame | None
    sigma: np.ndarray
    k: int
    user: str
    item: str
    _held: list = field(default_factory=list, repr=False)

    def sigma_df(self, spark) -> DataFrame:
        return spark.createDataFrame([(i, float(s)) for i, s in enumerate(self.sigma)], "idx int, sigma double")

    def unpersist(self) -> None:
        for d in self._held:
            d.unpersist()
        self._held.clear()


def stochastic_svd(
    ratings: DataFrame,
    k: int,
    p: int = 15,
    seed: int = DEFAULT_SEED,
    user: str = "user_id",
    item: str = "item_id",
    rating: str = "rating",
    compute_u: bool = True,
    compute_v: bool = True,
    u_half_sigma: bool = False,
    v_half_sigma: bool = False,
    block_rows: int | None = None,
    schedule=None,
    omega_table: DataFrame | None = None,
    reliable: bool = False,
) -> SSVDResult:
    """Rank-k stochastic SVD with oversampling p of a COO matrix.

    Exact (up to rounding) when k + p >= rank(A).  Singular values at or
    below 1e-12 * sigma_max count as zero and give zero U/V columns
    instead of NaN; the other columns are orthonormal.  With integer keys
    (INT, BIGINT; returned as BIGINT) the cells are exchanged once; cells with
    a null are none.
    ``u_half_sigma`` / ``v_half_sigma`` return
    U sqrt(Sigma) / V sqrt(Sigma) instead of U / V.  ``reliable=True``
    checkpoints Y and B^t (users x kp and items x kp, small next to A)
    into ``spark.checkpoint.dir`` so that a lost executor never sends the
    job back to the rating scan.  ``block_rows`` is accepted for older
    callers: the basis of Y needs no row blocks.
    """
    if k < 1 or p < 0:
        raise ValueError("need k >= 1 and p >= 0")
    ship_package(ratings.sparkSession)
    kp = k + p
    held: list[DataFrame] = []
    whole = all(isinstance(ratings.schema[c].dataType, T.IntegralType) for c in (user, item))
    if whole and omega_table is None:
        cells, heavy = user_layout(ratings, user, item, rating, reliable)
        held.append(cells)
        y = layout_projection(cells, heavy, kp, seed, user)
    else:
        a = ratings.select(F.col(user), F.col(item), F.col(rating).cast("double").alias(rating))
        y = random_projection(a, kp, seed, user, item, rating, omega_table)
    y = materialize(y, reliable, eager=reliable)
    held.append(y)
    rows = y.select(user, F.col("y").alias("_v"))
    basis = range_basis(rows, kp, schedule=schedule)
    width = basis[1].shape[0]
    if whole and omega_table is None:
        known = {r[user]: np.array(r["y"]) for r in y.filter(F.col(user).isin(heavy)).collect()} if heavy else {}
        bt = layout_at_times_q(cells, known, kp, seed, basis, width, item)
    else:
        bt = at_times_q(a, map_rows(rows, user, kp, basis, user, "q", width), width, user, item, rating)
    bt = materialize(bt, reliable, eager=reliable)
    held.append(bt)
    return _finish_svd(rows, kp, basis, bt, width, k, kp, user, item, compute_u, compute_v, u_half_sigma, v_half_sigma, held, schedule)


def svd_certificate(ratings: DataFrame, res: SSVDResult, user: str = "user_id", item: str = "item_id", rating: str = "rating") -> DataFrame:
    """How far the columns of V are from eigenvectors of A^t A: ``(j, sigma, residual, length)`` for each of the k columns.

    residual = |A^t A v_j - sigma_j^2 v_j| / sigma_j^2 and length = |v_j|; both
    by joins, without another factorisation.  With V^t V = I (``gram_cells``)
    residuals near 0 prove sigma_j^2 to be k eigenvalues of A^t A; a column
    with sigma_j = 0 has a null residual.
    """
    k = res.k
    v = res.v.select(F.col(item), F.col("v"))
    a = ratings.select(F.col(user), F.col(item), F.col(rating).cast("double").alias("_r"))
    av = a.join(v, item).groupBy(user).agg(weighted_sum_array("_r", "v", k).alias("q"))
    back = at_times_q(ratings, av, k, user, item, rating)
    both = v.join(back, item, "left")
    cell = both.select(F.posexplode("v").alias("j", "x"), F.col("b"))
    sigma = F.element_at(F.array(*[F.lit(float(s)) for s in res.sigma[:k]]), F.col("j") + 1)
    miss = F.coalesce(F.element_at("b", F.col("j") + 1), F.lit(0.0)) - sigma * sigma * F.col("x")
    sums = cell.withColumn("s", sigma).withColumn("d", miss).groupBy("j", "s").agg(F.sum(F.col("d") * F.col("d")).alias("d2"), F.sum(F.col("x") * F.col("x")).alias("x2"))
    residual = F.when(F.col("s") > 0, F.sqrt("d2") / (F.col("s") * F.col("s")))
    return sums.select("j", F.col("s").alias("sigma"), residual.alias("residual"), F.sqrt("x2").alias("length"))


# ---------------------------------------------------------------------------
# dense input: rows (row_id, v ARRAY<DOUBLE>[n]); columns play the role of items


def _dense_omega(seed: int, n: int, kp: int) -> np.ndarray:
    """n x kp projection, uniform on [-1, 1), identical in every task (PCG64 stream)."""
    return np.random.default_rng(int(seed)).uniform(-1.0, 1.0, size=(n, kp))


def dense_projection(df: DataFrame, id_col: str, vec: str, kp: int, seed: int = DEFAULT_SEED) -> DataFrame:
    """Y = A Omega for dense rows, map-only: ``(id_col, y ARRAY<DOUBLE>[kp])``.

    Each task rebuilds the n x kp matrix from the seed (n is the row
    length, so it is bounded by the matrix width, not the data) and
    multiplies whole Arrow batches at once.
    """
    ship_package(df.sparkSession)
    first = df.select(F.size(vec).alias("n")).take(1)
    n = int(first[0]["n"]) if first else 0
    schema = T.StructType([df.schema[id_col], T.StructField("y", T.ArrayType(T.DoubleType(), False), False)])
    out_schema = _to_arrow(schema)

    def fn(batches):
        om = _dense_omega(seed, n, kp)
        for rb in batches:
            if rb.num_rows == 0:
                continue
            a = list_to_matrix(rb.column("_a"), n)
            yield pa.RecordBatch.from_pydict({id_col: rb.column(id_col), "y": matrix_to_list(a @ om)}, schema=out_schema)

    return df.select(id_col, F.col(vec).cast("array<double>").alias("_a")).mapInArrow(fn, schema)


def dense_at_times_q(a: DataFrame, n: int, mats, width: int) -> DataFrame:
    """B^t = A^t Q for dense rows ``_v``, with Q = the rows times ``mats``: ``(item_id INT, b ARRAY<DOUBLE>)``.

    q is recomputed from the row where a^t q is added up, so A is read once
    and never joined; a task emits n rows of partial sums of ``width`` numbers.
    """
    ship_package(a.sparkSession)
    schema = T.StructType([T.StructField("item_id", T.IntegerType(), False), T.StructField("b", T.ArrayType(T.DoubleType(), False), False)])
    out_schema = _to_arrow(schema)

    def fn(batches):
        ms = [m() if callable(m) else m for m in mats]
        acc = None
        for rb in batches:
            if rb.num_rows == 0:
                continue
            rows = list_to_matrix(rb.column("_v"), n)
            part = rows.T @ times(rows, ms)
            acc = part if acc is None else acc + part
        if acc is not None:
            yield pa.RecordBatch.from_pydict({"item_id": pa.array(np.arange(n, dtype=np.int32)), "b": matrix_to_list(acc)}, schema=out_schema)

    parts = a.select("_v").mapInArrow(fn, schema).withColumn("_one", F.lit(1.0))
    return parts.groupBy("item_id").agg(weighted_sum_array("_one", "b", width).alias("b"))


def stochastic_svd_dense(
    df: DataFrame,
    k: int,
    p: int = 15,
    id_col: str = "row_id",
    vec: str = "v",
    seed: int = DEFAULT_SEED,
    compute_u: bool = True,
    compute_v: bool = True,
    u_half_sigma: bool = False,
    v_half_sigma: bool = False,
    block_rows: int | None = None,
    schedule=None,
    reliable: bool = False,
) -> SSVDResult:
    """Stochastic SVD of a dense tall matrix given as rows ``(id_col, vec)``.

    Same algorithm as :func:`stochastic_svd`; Y = A Omega is map-only.
    ``u`` is keyed by ``id_col`` and ``v`` by ``item_id`` = column index of A.
    """
    if k < 1 or p < 0:
        raise ValueError("need k >= 1 and p >= 0")
    kp = k + p
    a = df.select(F.col(id_col).cast("long").alias(id_col), F.col(vec).cast("array<double>").alias("_v"))
    n = _width(a)

    def om():  # rebuilt from the seed in every task
        return _dense_omega(seed, n, kp)

    m1, m2 = range_basis(a, n, (om,), kp, schedule)
    basis, width = (om, m1, m2), m2.shape[0]
    bt = materialize(dense_at_times_q(a, n, basis, width), reliable, eager=reliable)
    return _finish_svd(a, n, basis, bt, width, k, kp, id_col, "item_id", compute_u, compute_v, u_half_sigma, v_half_sigma, [bt], schedule)


def _finish_svd(rows, n, basis, bt, width, k, kp, user, item, compute_u, compute_v, u_half_sigma, v_half_sigma, held, schedule):
    """Sigma from R of B^t; U and V as map-only plans of the rows and of B^t."""
    b_rows = bt.select(item, F.col("b").alias("_v"))
    sigma = np.zeros(width)
    _, s, wt = np.linalg.svd(r_on_driver(b_rows, width, (), width, schedule))
    sigma[: s.size], w = s, wt.T
    sigma[sigma <= ZERO_SHARE * sigma[0]] = 0.0
    # deterministic column signs: largest-magnitude entry positive
    w = w * np.where(w[np.argmax(np.abs(w), axis=0), np.arange(width)] < 0, -1.0, 1.0)
    r = int((sigma[:k] > 0).sum())
    root = np.sqrt(sigma[:r])
    u_df = v_df = None
    if compute_u:
        u_df = map_rows(rows, user, n, (*basis, w[:, :r] * (root if u_half_sigma else 1.0)), user, "u", k)
    if compute_v:
        m1 = w[:, :r] / sigma[:r]
        m2 = np.linalg.inv(r_on_driver(b_rows, width, (m1,), r, schedule)) if r else np.zeros((0, 0))
        v_df = map_rows(b_rows, item, width, (m1, m2 * (root if v_half_sigma else 1.0)), item, "v", k)
    sigma = np.concatenate([sigma, np.zeros(kp - width)]) if width < kp else sigma
    return SSVDResult(u=u_df, v=v_df, sigma=sigma, k=k, user=user, item=item, _held=held)
