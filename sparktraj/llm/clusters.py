"""Problem 3: groups of mutually similar records, by a Gaussian mixture fitted with expectation maximisation.

Features are standardised and reduced to their leading principal axes; means, covariances and all expectation steps are sums
over every row. Several numbers of components are fitted in the same passes (started on a bounded sample) and the Bayesian
information criterion chooses. Covariances are regularised. Rows of the highest density represent their component.

``linked_groups`` divides further: rows within ``radius`` of each other are linked and connected sets are clusters. The
components are the blocks of that search: a row also goes to every component that could be the likeliest for a row within the
radius (a bound on how fast the difference of two log densities can change), so no link is lost.

Defined cases: unusable points are left out; infinities count as +-1e150; equal vectors are linked; fewer rows than components
give fewer components; an empty table gives no rows.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import connected
from .blocks import kd_route, local_sets
from .common import DIM, hash_sample, matrix, materialize, split_copies, usable_points
from .knn import exchange, goes_to, in_blocks

#: Numbers of components tried, axes kept, rows of the sample that starts the fit, share of the variance added.
COMPONENTS, AXES, SAMPLE_ROWS, RIDGE = (4, 8, 16, 24), 8, 6_000, 0.05
#: A fit has converged when a pass over all rows raises the log likelihood per row by less. As the ridge bounds every density, the
#: likelihood is bounded, and so is the number of passes.
CONVERGED = 0.05


def mapped_sum(points: DataFrame, f, dim: int) -> np.ndarray | None:
    """Sum over all rows of f(matrix) -> vector: one vector a task, added by position on the executors."""

    def run(batches):
        total = None
        for b in batches:
            if b.num_rows:
                v = f(matrix(b.column(0), dim))
                total = v if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["i", "v"])

    t = points.select("x").mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow().sort_by("i")
    return t.column("v").to_numpy() if t.num_rows else None


class Mixture:
    """x -> z = a (x - mean); log density up to a constant: const_k - (z - mu_k)' p_k (z - mu_k) / 2."""

    def __init__(self, mean, a, weight, mu, cov):
        self.mean, self.a, self.weight, self.mu, self.cov = mean, a, weight, mu, cov
        self.p = np.linalg.inv(cov)
        self.const = np.log(weight) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * mu.shape[1] * math.log(2 * math.pi)
        self.trees = [[(None, 0, -1, -1)] for _ in weight]

    def z(self, x):
        return np.clip((x - self.mean) @ self.a.T, -1e8, 1e8)

    def scores(self, z):
        out = np.empty((len(z), len(self.mu)))
        for k in range(len(self.mu)):
            d = z - self.mu[k]
            out[:, k] = self.const[k] - 0.5 * np.einsum("ij,ij->i", d @ self.p[k], d)
        return out

    def sums(self, z) -> np.ndarray:
        """Log likelihood, then per component: mass, sums and outer products of its share of the rows."""
        s = self.scores(z)
        top = s.max(1, keepdims=True)
        e = np.exp(s - top)
        total = e.sum(1, keepdims=True)
        share = e / total
        q = z.shape[1]
        parts = [np.array([float((top + np.log(total)).sum())]), share.sum(0), (share.T @ z).ravel()]
        parts += [((z * share[:, k : k + 1]).T @ z).ravel() for k in range(len(self.mu))]
        return np.concatenate(parts)

    def updated(self, s: np.ndarray, ridge: float) -> "Mixture":
        k, q = self.mu.shape
        n = s[1 : 1 + k]
        keep = n > q + 2
        if not keep.any():
            return self
        sx, sxx = s[1 + k : 1 + k + k * q].reshape(k, q)[keep], s[1 + k + k * q :].reshape(k, q, q)[keep]
        n = n[keep]
        mu = sx / n[:, None]
        cov = sxx / n[:, None, None] - mu[:, :, None] * mu[:, None]
        cov = (cov + cov.transpose(0, 2, 1)) / 2
        w, v = np.linalg.eigh(cov)
        cov = np.einsum("kij,kj,klj->kil", v, np.maximum(w, 0) + ridge, v)
        return Mixture(self.mean, self.a, n / n.sum(), mu, cov)

    def parameters(self) -> int:
        k, q = self.mu.shape
        return k * (1 + q + q * (q + 1) // 2) - 1

    def bends(self):
        """How fast the difference of two log densities can turn, needed before rows are routed."""
        slopes = [self.a.T @ p @ self.a for p in self.p]
        self.bend = np.array([[max(0.0, np.linalg.eigvalsh(b - c)[-1]) for c in slopes] for b in slopes])
        return self

    def route(self, x, r):
        """Yields (block, row numbers) so that any two rows within r meet in a block: with h = score_j - score_i, a row whose
        best is i has a neighbour whose best is j only if h + r |grad h| + r^2 / 2 max curvature of h reaches 0."""
        to = np.zeros((len(x), len(self.mu)), bool)
        for s in range(0, len(x), 1024):
            y = x[s : s + 1024]
            z = self.z(y)
            score = self.scores(z)
            i = score.argmax(1)
            grad = np.stack([-(z - self.mu[k]) @ (self.p[k] @ self.a) for k in range(len(self.mu))], 1)
            steep = np.sqrt(((grad - grad[np.arange(len(y)), i][:, None]) ** 2).sum(2))
            h = score - score[np.arange(len(y)), i][:, None] + r * steep + 0.5 * r * r * self.bend[i]
            turn = goes_to(len(self.mu))[i]
            go = (h >= -1e-6 * (1 + np.abs(score))) & turn
            # rows so far out that z was clipped have no bound: they go everywhere
            far = (np.abs(z) >= 0.9e8).any(1)
            go[far] = turn[far]
            go[np.arange(len(y)), i] = True
            to[s : s + 1024] = go
        for j in np.nonzero(to.any(0))[0]:
            idx = np.nonzero(to[:, j])[0]
            for leaf, sub in kd_route(self.trees[j], x[idx], r):
                yield int(j) << 20 | leaf, idx[sub]


def _start(z: np.ndarray, k: int, mean, a, ridge: float, seed: int) -> Mixture:
    """k-means++ centres and a few expectation steps on the sample."""
    rng = np.random.default_rng(seed)
    c = [z[rng.integers(len(z))]]
    d = ((z - c[0]) ** 2).sum(1)
    for _ in range(k - 1):
        d_ = np.minimum(d, np.quantile(d, 0.99)) + 1e-12
        c.append(z[rng.choice(len(z), p=d_ / d_.sum())])
        d = np.minimum(d, ((z - c[-1]) ** 2).sum(1))
    mu = np.array(c)
    m = Mixture(mean, a, np.full(k, 1 / k), mu, np.repeat(np.diag(z.var(0) * 0.25 + ridge)[None], k, 0))
    for _ in range(12):
        m = m.updated(m.sums(z), ridge)
    return m


def fit(points: DataFrame, dim: int = DIM, components=COMPONENTS, axes: int = AXES, seed: int = 5) -> tuple[Mixture, np.ndarray, int]:
    """The mixture chosen by the information criterion over all rows, the sample, and the number of rows."""
    points = points.select("id", "x")

    def moments(x):
        x = np.clip(x, -1e6, 1e6)
        return np.r_[len(x), x.sum(0), (x.T @ x).ravel()]

    s = mapped_sum(points, moments, dim)
    if s is None:
        return Mixture(np.zeros(dim), np.eye(min(axes, dim), dim), np.ones(1), np.zeros((1, min(axes, dim))), np.eye(min(axes, dim))[None]), np.empty((0, dim)), 0
    n = int(s[0])
    mean = s[1 : 1 + dim] / n
    cov = s[1 + dim :].reshape(dim, dim) / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    _, v = np.linalg.eigh(cov / np.outer(sd, sd))
    a = v[:, ::-1][:, : min(axes, dim)].T / sd
    x = np.clip(matrix(hash_sample(points, n, SAMPLE_ROWS, ["x"]).column("x"), dim), -1e6, 1e6)
    z = (x - mean) @ a.T
    ridge = RIDGE
    models = [_start(z, k, mean, a, ridge, seed) for k in components if len(z) >= 10 * k] or [_start(z, 1, mean, a, ridge, seed)]
    likelihood, open_ = [-np.inf] * len(models), list(range(len(models)))
    while open_:
        some = [models[i] for i in open_]
        sizes = [1 + len(m.mu) * (1 + m.mu.shape[1] + m.mu.shape[1] ** 2) for m in some]
        s = mapped_sum(points, lambda x, ms=some: np.concatenate([m.sums(m.z(x)) for m in ms]), dim)
        each, go_on = np.split(s, np.cumsum(sizes)[:-1]), []
        for i, p in zip(open_, each):
            if p[0] - likelihood[i] >= CONVERGED * n:
                go_on.append((i, p))
            likelihood[i] = max(likelihood[i], p[0])
        for i, p in go_on:
            models[i] = models[i].updated(p, ridge)
        open_ = [i for i, _ in go_on]
    bic = [-2 * v + m.parameters() * math.log(max(2, n)) for m, v in zip(models, likelihood)]
    return models[int(np.argmin(bic))], x, n


def assignments(points: DataFrame, model: Mixture, dim: int = DIM) -> DataFrame:
    """(id, component, density): the likeliest component of every row and the log density there."""

    def run(batches):
        for b in batches:
            s = model.scores(model.z(matrix(b.column(1), dim)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s.argmax(1)), pa.array(s.max(1))], ["id", "component", "density"])

    return points.select("id", "x").mapInArrow(run, "id long, component long, density double")


def describe(assigned: DataFrame, typical: int = 5) -> DataFrame:
    """(component, size, typical_ids): the ids of highest density, taken first within 32 salts of a component."""
    part = Window.partitionBy("component", F.pmod(F.xxhash64("id"), F.lit(32))).orderBy(F.desc("density"), "id")
    whole = Window.partitionBy("component").orderBy(F.desc("density"), "id")
    best = assigned.withColumn("n", F.row_number().over(part)).where(F.col("n") <= typical).withColumn("n", F.row_number().over(whole)).where(F.col("n") <= typical)
    best = best.groupBy("component").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "id"))), lambda s: s["id"]).alias("typical_ids"))
    return assigned.groupBy("component").agg(F.count("*").alias("size")).join(best, "component")


def linked_groups(points: DataFrame, radius: float, least: int = 3, dim: int = DIM) -> DataFrame:
    """(cluster_key, id): connected sets of at least ``least`` points linked within the radius; the key is the smallest id."""
    points = points.select("id", "x").persist()
    model = fit(points, dim)[0].bends()
    reps, others, copies = split_copies(points)

    def sets(ids, x, side):
        label = local_sets(x, radius, side)
        low = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(low, label, ids)
        many = np.bincount(label, minlength=len(ids))[label] > 1
        return ids[many], low[label[many]]

    local = in_blocks(exchange(reps, model, radius, dim), sets, "id long, root long", dim).distinct()
    if copies:
        local = local.unionByName(others.select("id", F.col("rep").alias("root"))).unionByName(others.select(F.col("rep").alias("id"), F.col("rep").alias("root")).distinct())
    local = materialize(local, "local")
    low = local.groupBy("id").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    # sets of different blocks that share a point are the same set
    edges = local.join(low.where("low <> high"), "id").where("root <> low").select(F.col("root").alias("u"), F.col("low").alias("v"))
    roots = connected(edges)
    whole = low.join(roots, low.low == roots.node, "left").select("id", F.coalesce("root", "low").alias("cluster_key"))
    whole = materialize(whole, "whole")
    large = whole.groupBy("cluster_key").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return whole.join(large, "cluster_key").select("cluster_key", "id")


def p3_found(spark, d: str) -> DataFrame:
    return linked_groups(usable_points(spark.read.parquet(f"{d}/points.parquet")), 0.4)


def p3_clusters(spark, d: str) -> DataFrame:
    """Each component with size and most typical ids, beside the earlier clusters and metaclusters of its members."""
    points = usable_points(spark.read.parquet(f"{d}/points.parquet")).select("id", "x").persist()
    assigned = materialize(assignments(points, fit(points)[0]), "assigned")
    old = spark.read.parquet(f"{d}/cluster_assign.parquet").where("id is not null")
    old = old.groupBy("id").agg(F.max_by(F.struct("clusters", "metaclusters"), F.struct("assigned_at", F.xxhash64("clusters", "metaclusters"))).alias("r")).select("id", "r.*")
    both = assigned.join(old, "id")

    def share(column):
        c = both.where(F.col(column).isNotNull()).groupBy("component", column).count()
        return c.groupBy("component").agg(F.max_by(column, F.struct("count", -F.col(column))).alias(f"main_{column}"), (F.max("count") / F.sum("count")).alias(f"share_{column}"))

    return describe(assigned).join(share("clusters"), "component", "left").join(share("metaclusters"), "component", "left")
