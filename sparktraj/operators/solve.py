"""Linear systems of graph Laplacians: expected hitting time and distance from an origin, label propagation.

(D - A) x = b on all vertices but the origin, x = 0 there. The matrix is scaled to unit diagonal; up to ``exact`` unknowns it is
solved directly, above by conjugate gradients, MINRES or BiCGSTAB. Graphs up to LOCAL_EDGES edges are solved in memory; larger
ones by the same methods over tables of vectors, whose products are joins and sums of DataFrames, with a written table each
step. Vertices that have no way to the origin have no finite value and get null.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from .components import connected
from .sparse import LOCAL_EDGES, local_matrix
from .walks import ancestors

EXACT, STEPS, EPS = 1000, 1500, 1e-12


class Coo:
    def __init__(self, i, j, w, n):
        o = np.argsort(i, kind="stable")
        self.i, self.j, self.w, self.n = i[o], j[o], w[o], n

    def __call__(self, x):
        return np.bincount(self.i, self.w * x[self.j], self.n)

    def dense(self):
        a = np.zeros((self.n, self.n))
        np.add.at(a, (self.i, self.j), self.w)
        return a


def cg(a, b, x=None, steps: int = STEPS, eps: float = EPS):
    """Conjugate gradients for symmetric positive matrices; returns x, steps, relative residual."""
    x = np.zeros_like(b) if x is None else x.copy()
    r = b - a(x)
    p, rr, norm = r.copy(), r @ r, max(np.linalg.norm(b), 1e-300)
    for n in range(steps):
        if math.sqrt(rr) <= eps * norm:
            return x, n, math.sqrt(rr) / norm
        ap = a(p)
        alpha = rr / (p @ ap)
        x += alpha * p
        r -= alpha * ap
        new = r @ r
        p, rr = r + new / rr * p, new
    return x, steps, math.sqrt(rr) / norm


def minres(a, b, x=None, steps: int = STEPS, eps: float = EPS):
    """Minimal residuals for symmetric matrices, by Lanczos vectors and Givens rotations."""
    x = np.zeros_like(b) if x is None else x.copy()
    r = b - a(x)
    beta, norm = np.linalg.norm(r), max(np.linalg.norm(b), 1e-300)
    if beta == 0:
        return x, 0, 0.0
    v_old, v, d_old, d = np.zeros_like(b), r / beta, np.zeros_like(b), np.zeros_like(b)
    c_old, c, s_old, s, eta, rest = 1.0, 1.0, 0.0, 0.0, beta, beta
    beta = 0.0
    for n in range(1, steps + 1):
        u = a(v) - beta * v_old
        alpha = v @ u
        u -= alpha * v
        beta_new = np.linalg.norm(u)
        delta, r2, r3 = c * alpha - c_old * s * beta, s * alpha + c_old * c * beta, s_old * beta
        r1 = math.hypot(delta, beta_new) or 1e-300
        c_old, c, s_old, s = c, delta / r1, s, beta_new / r1
        d_new = (v - r3 * d_old - r2 * d) / r1
        x += c * eta * d_new
        rest *= abs(s)
        eta *= -s
        d_old, d, v_old = d, d_new, v
        if rest <= eps * norm or beta_new < 1e-300:
            return x, n, rest / norm
        v, beta = u / beta_new, beta_new
    return x, steps, rest / norm


def bicgstab(a, b, x=None, steps: int = STEPS, eps: float = EPS):
    """Stabilised biconjugate gradients for matrices that aren't symmetric."""
    x = np.zeros_like(b) if x is None else x.copy()
    r = b - a(x)
    shadow, rho, alpha, omega = r.copy(), 1.0, 1.0, 1.0
    v, p, norm = np.zeros_like(b), np.zeros_like(b), max(np.linalg.norm(b), 1e-300)
    for n in range(steps):
        if np.linalg.norm(r) <= eps * norm:
            return x, n, np.linalg.norm(r) / norm
        new = shadow @ r
        if abs(new) < 1e-300:
            shadow, new, p, v, rho, alpha, omega = r.copy(), r @ r, np.zeros_like(b), np.zeros_like(b), 1.0, 1.0, 1.0
        p = r + new / rho * alpha / omega * (p - omega * v)
        rho = new
        v = a(p)
        alpha = rho / (shadow @ v)
        s = r - alpha * v
        t = a(s)
        omega = (t @ s) / max(t @ t, 1e-300)
        x += alpha * p + omega * s
        r = s - omega * t
    return x, steps, np.linalg.norm(r) / norm


METHODS = {"cg": cg, "minres": minres, "bicgstab": bicgstab}


def _reached(i, j, n, start):
    seen = np.zeros(n, bool)
    seen[start] = True
    while True:
        new = seen.copy()
        new[i[seen[j]]] = True
        if (new == seen).all():
            return seen
        seen = new


def _solve(i, j, w, n, rhs, fixed, values, method, exact, steps, eps, guess=None):
    """(D - A) x = rhs off the fixed vertices, x = values on them; null (NaN) where no fixed vertex is connected."""
    d = np.bincount(i, w, n)
    ok = _reached(i, j, n, fixed) & (d > 0)
    free = ok.copy()
    free[fixed] = False
    x = np.full(n, np.nan)
    x[fixed] = values
    at = np.cumsum(free) - 1
    known = np.where(np.isnan(x), 0, x)
    b = rhs + np.bincount(i, w * known[j], n)
    inside = free[i] & free[j]
    root = np.sqrt(d[free])
    m = int(free.sum())
    if not m:
        return x, 0, 0.0
    off = Coo(at[i[inside]], at[j[inside]], -w[inside] / (np.sqrt(d[i[inside]]) * np.sqrt(d[j[inside]])), m)
    scaled = b[free] / root
    if m <= exact:
        y, done, error = np.linalg.solve(np.eye(m) + off.dense(), scaled), 0, 0.0
    else:
        y, done, error = METHODS[method](lambda v: v + off(v), scaled, None if guess is None else guess[free] * root, steps, eps)
    x[free] = y / root
    return x, done, error


def hitting(similarity: DataFrame, origin: int, distances: DataFrame | None = None, method: str = "cg", exact: int = EXACT, steps: int = STEPS, eps: float = EPS, targets: dict[int, float] | None = None, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(id, pt): expected hitting time of the walk on the similarity, or with ``distances`` the expected distance. ``targets`` are
    further vertices with given values. Above ``local_edges`` edges the system stays distributed, with the same arguments."""
    if distances is not None:
        edges = similarity.join(distances.withColumnRenamed("w", "d"), ["src", "dst"]).select("src", "dst", "w", (F.col("w") * F.col("d")).alias("c"))
    else:
        edges = similarity.select("src", "dst", "w", F.col("w").alias("c"))
    got = local_matrix(edges, local_edges)
    fixed = {int(origin): 0.0} | (targets or {})
    if got is None:
        at = similarity.sparkSession.createDataFrame([(int(k), float(v)) for k, v in fixed.items()], "id long, value double")
        return distributed(edges, at, method, exact, steps, eps)
    t = edges.select("src", "dst", "w", "c").toArrow()
    ids = got[0]
    i, j = np.searchsorted(ids, t.column("src").to_numpy()), np.searchsorted(ids, t.column("dst").to_numpy())
    w, rhs = t.column("w").to_numpy(), np.bincount(i, t.column("c").to_numpy(), len(ids))
    where = np.searchsorted(ids, list(fixed))
    x, _, _ = _solve(i, j, w, len(ids), rhs, where, np.array(list(fixed.values())), method, exact, steps, eps)
    return similarity.sparkSession.createDataFrame(pa.table({"id": ids, "pt": pa.array(x, mask=np.isnan(x))}))


class Vectors:
    """The vectors of an iteration as columns of one table (id, ...). A product with the matrix 1 - off is a join and a sum, and
    writes the table; updates between two products stay expressions."""

    def __init__(self, off: DataFrame, table: DataFrame):
        self.off, self.t = off, table

    def put(self, **columns) -> None:
        self.t = self.t.withColumns({k: v if not isinstance(v, (int, float)) else F.lit(float(v)) for k, v in columns.items()})

    def times(self, out: str, of: str) -> None:
        s = self.off.join(self.t.select(F.col("id").alias("dst"), F.col(of).alias("_q")), "dst").groupBy(F.col("src").alias("id")).agg(F.sum(F.col("w") * F.col("_q")).alias("_s"))
        self.t = written(self.t.drop(out).join(s, "id", "left").withColumn(out, F.col(of) - F.coalesce("_s", F.lit(0.0))).drop("_s"), "vectors")

    def dots(self, *pairs: str) -> list[float]:
        row = self.t.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{i}") for i, (a, b) in enumerate(p.split() for p in pairs)]).first()
        return [float(v or 0.0) for v in row]


def _table_cg(s: Vectors, steps: int, eps: float) -> None:
    c = F.col
    s.put(x=0, r=c("b"), p=c("b"))
    rr = first = s.dots("b b")[0]
    for _ in range(steps):
        if rr <= eps * eps * first:
            return
        s.times("ap", "p")
        alpha = rr / s.dots("p ap")[0]
        s.put(x=c("x") + alpha * c("p"), r=c("r") - alpha * c("ap"))
        new = s.dots("r r")[0]
        s.put(p=c("r") + new / rr * c("p"))
        rr = new


def _table_minres(s: Vectors, steps: int, eps: float) -> None:
    c = F.col
    norm = math.sqrt(s.dots("b b")[0])
    s.put(x=0)
    if not norm:
        return
    s.put(v_old=0, v=c("b") / norm, dir_old=0, dir=0)
    beta, c_old, c_now, s_old, s_now, eta, rest = 0.0, 1.0, 1.0, 0.0, 0.0, norm, norm
    for _ in range(steps):
        s.times("av", "v")
        alpha = s.dots("v av")[0] - beta * s.dots("v v_old")[0]
        s.put(u=c("av") - beta * c("v_old") - alpha * c("v"))
        beta_new = math.sqrt(s.dots("u u")[0])
        delta, r2, r3 = c_now * alpha - c_old * s_now * beta, s_now * alpha + c_old * c_now * beta, s_old * beta
        r1 = math.hypot(delta, beta_new) or 1e-300
        c_old, c_now, s_old, s_now = c_now, delta / r1, s_now, beta_new / r1
        s.put(dir_new=(c("v") - r3 * c("dir_old") - r2 * c("dir")) / r1)
        s.put(x=c("x") + c_now * eta * c("dir_new"), dir_old=c("dir"), dir=c("dir_new"))
        rest, eta = rest * abs(s_now), -eta * s_now
        if rest <= eps * norm or beta_new < 1e-300:
            return
        s.put(v_old=c("v"), v=c("u") / beta_new)
        beta = beta_new


def _table_bicgstab(s: Vectors, steps: int, eps: float) -> None:
    c = F.col
    s.put(x=0, r=c("b"), shadow=c("b"), p=0, v=0)
    rho = alpha = omega = 1.0
    first = s.dots("b b")[0]
    for _ in range(steps):
        rr, new = s.dots("r r", "shadow r")
        if rr <= eps * eps * first:
            return
        if abs(new) < 1e-300:
            s.put(shadow=c("r"), p=0, v=0)
            new, rho, alpha, omega = rr, 1.0, 1.0, 1.0
        s.put(p=c("r") + new / rho * alpha / omega * (c("p") - omega * c("v")))
        rho = new
        s.times("v", "p")
        alpha = rho / s.dots("shadow v")[0]
        s.put(s=c("r") - alpha * c("v"))
        s.times("t", "s")
        ts, tt = s.dots("t s", "t t")
        omega = ts / max(tt, 1e-300)
        s.put(x=c("x") + alpha * c("p") + omega * c("s"), r=c("s") - omega * c("t"))


TABLE_METHODS = {"cg": _table_cg, "minres": _table_minres, "bicgstab": _table_bicgstab}


def distributed(edges: DataFrame, fixed: DataFrame, method: str = "cg", exact: int = EXACT, steps: int = STEPS, eps: float = EPS) -> DataFrame:
    """(id, pt): the same system over tables, for edges (src, dst, w, c) and fixed (id, value) of any number. Which vertices have a
    way to a fixed one is told by components (cg and minres, whose matrices are symmetric) or by a search backwards."""
    e, fixed = written(edges.select("src", "dst", "w", "c"), "edges"), written(fixed.select("id", "value"), "fixed")
    if method == "bicgstab":
        reached = ancestors(e, fixed)
    else:
        root = connected(e.select(F.col("src").alias("u"), F.col("dst").alias("v")))
        reached = root.join(root.join(fixed.withColumnRenamed("id", "node"), "node").select("root").distinct(), "root", "left_semi").select(F.col("node").alias("id"))
    d = e.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("d"), F.sum("c").alias("c")).where("d > 0")
    known = e.join(fixed.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.sum(F.col("w") * F.col("value")).alias("k"))
    free = d.join(reached, "id", "left_semi").join(fixed, "id", "left_anti").join(known, "id", "left")
    free = written(free.select("id", "d", ((F.col("c") + F.coalesce("k", F.lit(0.0))) / F.sqrt("d")).alias("b")), "free")
    size = free.select("id", "d")
    off = e.join(size.withColumnRenamed("id", "src").withColumnRenamed("d", "d1"), "src").join(size.withColumnRenamed("id", "dst").withColumnRenamed("d", "d2"), "dst")
    off = written(off.select("src", "dst", (F.col("w") / F.sqrt(F.col("d1") * F.col("d2"))).alias("w")).repartition("src"), "scaled")
    spark, m = edges.sparkSession, free.count()
    if m <= exact:  # at most exact^2 entries
        t, a = free.toArrow(), off.groupBy("src", "dst").agg(F.sum("w").alias("w")).toArrow()
        ids = t.column("id").to_numpy()
        o = np.argsort(ids)
        dense = np.eye(m)
        np.add.at(dense, (o[np.searchsorted(ids[o], a.column("src").to_numpy())], o[np.searchsorted(ids[o], a.column("dst").to_numpy())]), -a.column("w").to_numpy()) if m else None
        x = np.linalg.solve(dense, t.column("b").to_numpy()) / np.sqrt(t.column("d").to_numpy())
        inner = spark.createDataFrame(pa.table({"id": ids, "pt": x}))
    else:
        s = Vectors(off, free)
        TABLE_METHODS[method](s, steps, eps)
        inner = s.t.select("id", (F.col("x") / F.sqrt("d")).alias("pt"))
    inner = written(inner.unionByName(fixed.withColumnRenamed("value", "pt")), "solved")
    every = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
    return every.join(inner, "id", "left").select("id", "pt")


def directed_graph(lists: DataFrame, origin: int, name: str = "exp", directed: bool = True) -> DataFrame:
    """(src, dst, w): the max-symmetrised similarity of neighbour lists, with ``directed`` only the edges that lead away from the origin
    by expected hitting time; weights are not normalised."""
    from .sparse import distances, kernel, symmetrize

    k = written(symmetrize(kernel(distances(lists), name)), "similarity")
    if not directed:
        return k
    t = hitting(k, origin)
    go = k.join(t.select(F.col("id").alias("src"), F.col("pt").alias("a")), "src").join(t.select(F.col("id").alias("dst"), F.col("pt").alias("b")), "dst")
    return go.where("a < b").select("src", "dst", "w")


def residuals(similarity: DataFrame, pt: DataFrame, cost: DataFrame | None = None) -> DataFrame:
    """(id, residual): |sum_j w_ij (x_i - x_j - c_ij)| relative to the row's terms, c_ij 1 or the given cost."""
    e = similarity.withColumn("c", F.lit(1.0)) if cost is None else similarity.join(cost.withColumnRenamed("w", "c"), ["src", "dst"])
    a, b = pt.select(F.col("id").alias("src"), F.col("pt").alias("x")), pt.select(F.col("id").alias("dst"), F.col("pt").alias("y"))
    r = e.join(a, "src").join(b, "dst").groupBy("src").agg(F.sum(F.col("w") * (F.col("x") - F.col("y") - F.col("c"))).alias("r"), F.sum(F.col("w") * (F.abs("x") + F.abs("y") + F.col("c"))).alias("s"))
    return r.select(F.col("src").alias("id"), (F.abs("r") / F.col("s")).alias("residual"))


def label_scores(similarity: DataFrame, seeds: DataFrame, exact: int = EXACT, steps: int = STEPS, eps: float = 1e-10, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(id, label, score): harmonic extension of seed labels (id, label), one solve per label; null where no seed is connected."""
    got = local_matrix(similarity, local_edges)
    spark = similarity.sparkSession
    if got is None:
        seeds, out = written(seeds.select("id", "label"), "seeds"), None
        for (c,) in seeds.select("label").distinct().orderBy("label").collect():  # a solve per label
            at = seeds.select("id", (F.col("label") == c).cast("double").alias("value"))
            one = distributed(similarity.select("src", "dst", "w", F.lit(0.0).alias("c")), at, "cg", exact, steps, eps).select("id", F.lit(c).alias("label"), F.col("pt").alias("score"))
            out = one if out is None else out.unionByName(one)
        return out
    ids, i, j, w = got
    s = seeds.toPandas()
    s = s[s["id"].isin(ids)].sort_values("id")
    names, where = sorted(s["label"].unique()), np.searchsorted(ids, s["id"])
    score = [_solve(i, j, w, len(ids), np.zeros(len(ids)), where, (s["label"] == c).to_numpy(float), "cg", exact, steps, eps)[0] for c in names]
    flat = np.concatenate(score) if score else np.empty(0)
    return spark.createDataFrame(pa.table({"id": np.tile(ids, len(names)), "label": pa.array(np.repeat(np.array(names, dtype=object), len(ids)), pa.string()), "score": pa.array(flat, mask=np.isnan(flat))}))


def propagate_labels(similarity: DataFrame, seeds: DataFrame, **options) -> DataFrame:
    """(id, label, score): the label of highest score, the first by name of those that agree to 9 digits."""
    s = label_scores(similarity, seeds, **options)
    best = F.struct(-F.coalesce(F.round("score", 9), F.lit(-1.0)), "label")
    return s.groupBy("id").agg(F.min_by(F.struct("label", "score"), best).alias("r")).select("id", "r.*")
