"""Sparse matrices as edge tables (src, dst, w): kernels on distances, symmetrising, transition matrices, orientation.

Row statistics are windows over ``src``; a neighbour table is already partitioned by src, so they need no further exchange.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashrand import uniform
from ..functions.ordered import numbered
from ..functions.quantiles import exact_quantiles
from ..functions.scalars import with_scalars
from ..sources.shared import written

#: kernel -> (statistic, weight from distance d and statistic s). Global statistics: of all distances; row: of a source's list.
KERNELS = {
    "se": ("median", lambda d, s: F.exp(-d * d / (2 * s * s))),
    "se0": ("median", lambda d, s: F.exp(-d * d / s)),
    "lap": ("median", lambda d, s: F.exp(-d / s)),
    "exp": ("median", lambda d, s: F.exp(-d / (2 * s * s))),
    "expm": ("max", lambda d, s: F.exp(-d / s)),
    "expmr": ("row_max", lambda d, s: F.exp(-d / s)),
    "expmer": ("row_median", lambda d, s: F.exp(-d / s)),
    "expmer2": ("row_median", lambda d, s: F.exp(-d / (2 * s))),
    "semr": ("row_max", lambda d, s: F.exp(-d * d / s)),
    "semer": ("row_median", lambda d, s: F.exp(-d * d / (s * s))),
    "semer0": ("row_median", lambda d, s: F.exp(-d / s)),
    "semer2": ("row_median", lambda d, s: F.exp(-d * d / (2 * s * s))),
    "expsigma": ("sigma", lambda d, s: F.exp(-d / s)),
}
#: On symmetrised distances semer0 divides the squared distance.
SYMMETRIC = {k: KERNELS[k] for k in ("expmr", "expmer", "expmer2", "semr", "semer", "semer2")} | {"semer0": ("row_median", lambda d, s: F.exp(-d * d / s))}


def distances(lists: DataFrame) -> DataFrame:
    return lists.select("src", "dst", F.col("dist").alias("w"))


def kernel(edges: DataFrame, name: str = "semer", epsilon: float | None = None, table: dict = KERNELS) -> DataFrame:
    """Distances (src, dst, w) to similarities. A statistic of 0 gives 1 at distance 0 and 0 beyond it; the statistic sigma is
    bisected so that a list of n distances sums to log2(n)."""
    stat, f = table[name]
    w = Window.partitionBy("src")
    if epsilon is not None:
        edges = edges.withColumn("s", F.lit(float(epsilon)))
    elif stat == "row_max":
        edges = edges.withColumn("s", F.max("w").over(w))
    elif stat == "row_median":
        edges = edges.withColumn("s", F.percentile("w", 0.5).over(w))
    elif stat == "sigma":
        from .points import sigma

        edges = edges.join(sigma(edges.select("src", F.col("w").alias("dist"))).withColumnRenamed("sigma", "s"), "src")
    elif stat == "max":
        edges = with_scalars(edges, edges.agg(F.max("w").alias("s")))
    else:
        edges = with_scalars(edges, exact_quantiles(edges, [], "w", [0.5]).select(F.col("q").alias("s")))
    out = F.when(F.col("s") > 0, f(F.col("w"), F.when(F.col("s") > 0, F.col("s")))).otherwise(F.when(F.col("w") == 0, 1.0).otherwise(0.0))
    return edges.select("src", "dst", out.alias("w"))


def _swapped(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")


def symmetrize(edges: DataFrame, mode: str = "max") -> DataFrame:
    """max (a missing side keeps the other), min (a missing side counts as 0), mean, prob (row-normalised p + p' - p p') or none."""
    if mode == "none":
        return edges
    if mode == "prob":
        p = row_normalize(edges)
        both = p.withColumn("q", F.lit(0.0)).unionByName(_swapped(p).withColumnRenamed("w", "q").withColumn("w", F.lit(0.0)))
        return both.groupBy("src", "dst").agg(F.sum("w").alias("p"), F.sum("q").alias("q")).select("src", "dst", (F.col("p") + F.col("q") - F.col("p") * F.col("q")).alias("w"))
    both = edges.unionByName(_swapped(edges)).groupBy("src", "dst")
    if mode == "mean":
        return both.agg((F.sum("w") / 2).alias("w"))
    if mode == "min":
        return both.agg(F.min("w").alias("w"), F.count("*").alias("n")).where("n > 1").drop("n")
    return both.agg(F.max("w").alias("w"))


def row_normalize(edges: DataFrame) -> DataFrame:
    total = F.sum("w").over(Window.partitionBy("src"))
    return edges.select("src", "dst", F.try_divide("w", total).alias("w")).where("w is not null")


def with_diagonal(edges: DataFrame, value: float) -> DataFrame:
    own = edges.select("src").union(edges.select("dst")).distinct().select("src", F.col("src").alias("dst"), F.lit(float(value)).alias("w"))
    return edges.where("src <> dst").unionByName(own)


def similarity(lists: DataFrame, name: str = "semer", sym: str = "max", epsilon: float | None = None) -> DataFrame:
    """Kernel of the listed distances, symmetrised by max, mean, prob or not (none); with "min" the distances are symmetrised
    first (a missing side keeps the other) and each row of that ragged table gets its own kernel, which isn't symmetric."""
    if sym == "min":
        return kernel(symmetrize(distances(lists), "max"), name, epsilon, SYMMETRIC if name in SYMMETRIC else KERNELS)
    return symmetrize(kernel(distances(lists), name, epsilon), sym)


def transition_matrix(lists: DataFrame, name: str = "semer", sym: str = "max", diagonal: float | None = None, normalize: bool = True, epsilon: float | None = None) -> DataFrame:
    k = similarity(lists, name, sym, epsilon)
    k = k if diagonal is None else with_diagonal(k, diagonal)
    return row_normalize(k) if normalize else k


def laplacian(lists: DataFrame, name: str = "semer") -> DataFrame:
    """D^-1/2 K D^-1/2 of the max-symmetrised kernel with unit diagonal."""
    k = with_diagonal(symmetrize(kernel(distances(lists), name)), 1.0)
    d = k.groupBy("src").agg(F.sum("w").alias("d"))
    e = d.select(F.col("src").alias("dst"), F.col("d").alias("e"))
    return k.join(d, "src").join(e, "dst").select("src", "dst", (F.col("w") / F.sqrt(F.col("d") * F.col("e"))).alias("w"))


def rank_bins(pt: DataFrame, breaks: int) -> DataFrame:
    """(id, t, bin): equal-width bins of the dense rank of pt; the ranks number the distinct values."""
    r = numbered(pt.select("pt").distinct(), [], [F.col("pt")], "r")
    top = r.agg(F.count("*").alias("top"))
    r = with_scalars(r, top).select("pt", "r", F.greatest(F.lit(1), F.ceil(F.try_divide((F.col("r") - 1) * F.lit(float(breaks)), F.col("top") - 1))).alias("bin"))
    return pt.join(r, "pt").select("id", F.col("r").alias("t"), "bin")


def orient(edges: DataFrame, pt: DataFrame, breaks: int | None = None, base: float = 2.0) -> DataFrame:
    """Keeps edges that go forward in pseudotime (id, pt), optionally weighs them down by base^(bins passed), row-normalised."""
    bins = rank_bins(pt, breaks or 1)
    a = bins.select(F.col("id").alias("src"), F.col("t").alias("t1"), F.col("bin").alias("b1"))
    b = bins.select(F.col("id").alias("dst"), F.col("t").alias("t2"), F.col("bin").alias("b2"))
    go = edges.join(a, "src").join(b, "dst").where("t1 < t2")
    w = F.col("w") if breaks is None else F.col("w") / F.pow(F.lit(float(base)), F.col("b2") - F.col("b1"))
    return row_normalize(go.select("src", "dst", w.alias("w")))


def backward(edges: DataFrame, pt: DataFrame) -> DataFrame:
    """Edges that go strictly back in pseudotime."""
    a, b = pt.select(F.col("id").alias("src"), F.col("pt").alias("t1")), pt.select(F.col("id").alias("dst"), F.col("pt").alias("t2"))
    return edges.join(a, "src").join(b, "dst").where("t1 > t2").select("src", "dst", "w")


def stationary(edges: DataFrame, steps: int = 30, every: int = 5) -> DataFrame:
    """(id, p): power iteration of the row-normalised matrix from its column sums; lineage is cut every few steps."""
    p = written(row_normalize(edges), "transition")
    v = p.groupBy("dst").agg(F.sum("w").alias("v")).select(F.col("dst").alias("src"), "v")
    total = v.agg(F.sum("v")).first()[0] or 1.0
    v = v.withColumn("v", F.col("v") / total)
    for i in range(steps):
        v = p.join(v, "src").groupBy("dst").agg(F.sum(F.col("w") * F.col("v")).alias("v")).select(F.col("dst").alias("src"), "v")
        if (i + 1) % every == 0:
            v = written(v, "power")
    return v.select(F.col("src").alias("id"), F.col("v").alias("p"))


def sparse_times_vectors(edges: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """(id, x): rows of the edge table times the vectors (id, x)."""
    both = edges.join(vectors.select(F.col("id").alias("dst"), "x"), "dst")
    return both.groupBy("src").agg(F.array(*[F.sum(F.col("x")[i] * F.col("w")) for i in range(dim)]).alias("x")).withColumnRenamed("src", "id")


#: Edges up to which a matrix is brought together on the driver.
LOCAL_EDGES = 2_000_000


def local_matrix(edges: DataFrame, limit: int = LOCAL_EDGES):
    """(ids, row numbers, column numbers, weights) on the driver, or None if the table is larger than the limit."""
    if edges.limit(limit + 1).count() > limit:
        return None
    t = edges.select("src", "dst", "w").toArrow()
    s, d, w = (t.column(c).to_numpy() for c in ("src", "dst", "w"))
    ids = np.unique(np.r_[s, d])
    return ids, np.searchsorted(ids, s), np.searchsorted(ids, d), w


#: Rows up to which eigenvectors are found densely, and the residual |A v - lambda v| at which iterations stop.
DENSE_ROWS, RESIDUAL = 2000, 1e-9


def leading_eigenvectors(edges: DataFrame, count: int, steps: int = 5000, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, values, vectors) of a symmetric edge table in memory: dense up to DENSE_ROWS rows, else block subspace iteration with
    a sparse product until every residual is below RESIDUAL; an error after ``steps`` steps without that."""
    got = local_matrix(edges)
    if got is None:
        raise ValueError(f"over {LOCAL_EDGES} edges: use table_eigenvectors")
    ids, i, j, w = got
    n = len(ids)
    if n <= DENSE_ROWS:
        a = np.zeros((n, n))
        np.add.at(a, (i, j), w)
        lam, v = np.linalg.eigh((a + a.T) / 2)
        o = np.argsort(-lam)[:count]
        return ids, lam[o], v[:, o]
    rng = np.random.default_rng(seed)
    q = np.linalg.qr(rng.normal(size=(n, count + 8)))[0]
    order = np.argsort(i, kind="stable")
    i, j, w = i[order], j[order], w[order]
    at = np.searchsorted(i, np.arange(n))

    def times(x):
        y = np.add.reduceat(np.r_[w[:, None] * x[j], np.zeros((1, x.shape[1]))], np.minimum(at, len(w)), axis=0)
        y[np.diff(np.r_[at, len(w)]) == 0] = 0
        return y

    for step in range(steps):
        y = times(q)
        if step % 20 == 19:
            lam, u = np.linalg.eigh(q.T @ y)
            o = np.argsort(-lam)[:count]
            if np.abs((y @ u - q @ u * lam)[:, o]).max() < RESIDUAL:
                return ids, lam[o], q @ u[:, o]
        q = np.linalg.qr(y + q)[0]  # shifted by 1, so that the largest and not the most negative value leads
    raise ValueError(f"no eigenvectors after {steps} steps")


def table_eigenvectors(edges: DataFrame, count: int, steps: int = 500, seed: int = 0, residual: float = 1e-6) -> tuple[np.ndarray, DataFrame]:
    """Values, and (id, x) with the leading vectors' entries, of a symmetric edge table of any size: the same iteration with the
    block as a table; only its small products with itself reach the driver."""
    width, e = count + 8, written(edges.select("src", "dst", "w").repartition("src"), "matrix")
    q = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct().select("id", F.array(*[uniform(seed + i, "id") - 0.5 for i in range(width)]).alias("x"))

    def outer(a: str, b: str) -> list:
        return [F.sum(F.col(a)[i] * F.col(b)[j]) for i in range(width) for j in range(width)]

    def turned(x: str, by: np.ndarray):
        return F.array(*[sum((F.col(x)[i] * float(by[i, j]) for i in range(len(by))), F.lit(0.0)) for j in range(by.shape[1])])

    def basis(t: DataFrame, x: str) -> np.ndarray:
        return np.linalg.inv(np.linalg.cholesky(np.array(t.agg(*outer(x, x)).first(), float).reshape(width, width))).T

    q = written(q, "block")
    q = written(q.withColumn("x", turned("x", basis(q, "x"))), "block")
    for step in range(steps):
        both = written(q.join(sparse_times_vectors(e, q, width).withColumnRenamed("x", "y"), "id", "left").withColumn("y", F.coalesce("y", F.array(*[F.lit(0.0)] * width))), "product")
        if step % 10 == 9:
            m = np.array(both.agg(*outer("x", "y")).first(), float).reshape(width, width)
            lam, u = np.linalg.eigh((m + m.T) / 2)
            o = np.argsort(-lam)[:count]
            lam, u = lam[o], u[:, o]
            off = both.select(turned("x", u).alias("v"), turned("y", u).alias("av"))
            worst = off.agg(F.max(F.greatest(*[F.abs(F.col("av")[i] - float(lam[i]) * F.col("v")[i]) for i in range(count)], F.lit(0.0)))).first()[0]
            if worst is None or worst < residual:
                return lam, both.select("id", turned("x", u).alias("x"))
        moved = both.select("id", F.zip_with("x", "y", lambda a, b: a + b).alias("x"))
        q = written(moved.withColumn("x", turned("x", basis(moved, "x"))), "block")
    raise ValueError(f"no eigenvectors after {steps} steps")


def diffusion_map(lists: DataFrame, axes: int = 2, t: float = 0.0, name: str = "semer", count: int | None = None) -> DataFrame:
    """(id, x): coordinates psi * lambda / (1 - lambda) for t <= 0, psi * lambda^t otherwise, psi = v / v1."""
    m = laplacian(lists, name)
    if m.limit(LOCAL_EDGES + 1).count() > LOCAL_EDGES:
        lam, v = table_eigenvectors(m, count or axes + 1)
        scale = lam[1:] / (1 - lam[1:]) if t <= 0 else lam[1:] ** t
        return v.select("id", F.array(*[F.col("x")[i + 1] / F.col("x")[0] * float(scale[i]) for i in range(axes)]).alias("x"))
    ids, lam, v = leading_eigenvectors(m, count or axes + 1)
    psi = v / v[:, :1]
    scale = lam[1:] / (1 - lam[1:]) if t <= 0 else lam[1:] ** t
    x = (psi[:, 1:] * scale)[:, :axes]
    spark = lists.sparkSession
    import pyarrow as pa

    return spark.createDataFrame(pa.table({"id": ids, "x": pa.array(x.tolist(), pa.list_(pa.float64()))}))
