"""Clustering of clouds and graphs: k-means from given seeds, grids, Louvain communities, clique percolation."""
from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import numbered
from .complexes import cliques
from .components import connected
from .points import farthest_points
from .vectors import avg_vector, matrix


def assign(points: DataFrame, codes: np.ndarray) -> DataFrame:
    """(id, cluster): nearest code (k x dim, on every task), the smallest number on ties; clusters from 1."""

    def run(batches):
        for b in batches:
            x = matrix(b.column(1), codes.shape[1])
            d = (codes**2).sum(1)[None] - 2 * x @ codes.T
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array((np.round(d, 9).argmin(1) + 1).astype(np.int64))], ["id", "cluster"])

    return points.select("id", "x").mapInArrow(run, "id long, cluster long")


def kmeans(points: DataFrame, k: int, rounds: int | None = None, seeds: np.ndarray | None = None) -> tuple[DataFrame, np.ndarray]:
    """Lloyd's rounds from farthest-point seeds: per task one sum per code; empty codes are dropped. Returns assignments, codes."""
    points = points.select("id", "x").persist()
    if seeds is None:
        picked = farthest_points(points, k)
        t = points.join(F.broadcast(picked), "id").orderBy("pick").toArrow()  # k rows
        seeds = matrix(t.column("x"))
    codes = np.asarray(seeds, float)
    dim = codes.shape[1]
    for _ in range(rounds or k):

        def sums(batches, codes=codes):
            n, s = np.zeros(len(codes)), np.zeros_like(codes)
            for b in batches:
                x = matrix(b.column(0), dim)
                c = np.round((codes**2).sum(1)[None] - 2 * x @ codes.T, 9).argmin(1)
                n += np.bincount(c, minlength=len(codes))
                np.add.at(s, c, x)
            keep = np.nonzero(n)[0]
            yield pa.RecordBatch.from_arrays([pa.array(keep), pa.array(n[keep]), pa.array(s[keep].tolist(), pa.list_(pa.float64()))], ["c", "n", "s"])

        got = points.select("x").mapInArrow(sums, "c long, n double, s array<double>").groupBy("c").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[i]) for i in range(dim)]).alias("s")).orderBy("c").toArrow()
        new = matrix(got.column("s"), dim) / got.column("n").to_numpy()[:, None]
        done = new.shape == codes.shape and np.allclose(new, codes, atol=1e-12)
        codes = new
        if done:
            break
    return assign(points, codes), codes


def given_clusters(points: DataFrame, clustering: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
    """A user's clustering (id, cluster) renumbered without gaps, and its codes (cluster, x)."""
    used = numbered(clustering.where("cluster is not null").select("cluster").distinct(), [], [F.col("cluster")], "c")
    a = clustering.join(used, "cluster").select("id", F.col("c").cast("long").alias("cluster"))
    return a, avg_vector(points.join(a, "id"), ["cluster"], dim)


def grid_triangulation(spark, xdim: int, ydim: int, k: int = 10) -> DataFrame:
    """(a, b): edges between units of an xdim x ydim grid not farther (city blocks) than the (k + 1)-th smallest distance from
    the corner. Units are numbered from 1 by columns."""
    u = spark.range(xdim * ydim).select((F.col("id") + 1).alias("u"), (F.col("id") % xdim).alias("x"), F.floor(F.col("id") / xdim).alias("y"))
    reach = sorted(i % xdim + i // xdim for i in range(xdim * ydim))[min(k, xdim * ydim - 1)]
    steps = [(dx, dy) for dx in range(-reach, reach + 1) for dy in range(-reach, reach + 1) if 0 < abs(dx) + abs(dy) <= reach]
    s = F.explode(F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in steps])).alias("s")
    moved = u.select("u", "x", "y", s).select(F.col("u").alias("a"), (F.col("x") + F.col("s.dx")).alias("x"), (F.col("y") + F.col("s.dy")).alias("y"))
    return moved.join(u.select(F.col("u").alias("b"), "x", "y"), ["x", "y"]).where("a < b").select("a", "b")


def grid_complex(codes: DataFrame, xdim: int, ydim: int, k: int = 10) -> DataFrame:
    """The filtration of a grid's edges and triangles, valued as an alpha complex by the units' codes (cluster, x)."""
    from .complexes import expand, skeleton

    edges = grid_triangulation(codes.sparkSession, xdim, ydim, k)
    marks = codes.select(F.col("cluster").alias("id"), "x")
    return skeleton(expand(marks.select(F.col("id").alias("v")), edges), marks, 2)


def clara(points: DataFrame, k: int, samples: int = 5, rows: int | None = None, seed: int = 1) -> tuple[DataFrame, np.ndarray]:
    """Clusters around k medoids: each of a few bounded samples (40 + 2k rows by default) is solved by swaps, and the medoids with the
    least total distance over all rows win. Returns (id, cluster) and the medoids."""
    points, size = points.select("id", "x"), rows or 40 + 2 * k
    best, least = np.empty((0, 1)), np.inf
    for s in range(samples):
        x = matrix(points.orderBy(F.xxhash64("id", F.lit(seed + s)), "id").limit(size).toArrow().column("x"))
        if not len(x):
            return assign(points, np.zeros((1, 1))).limit(0), best
        d = np.sqrt(np.maximum(((x[:, None] - x[None]) ** 2).sum(2), 0))
        med = [int(d.sum(1).argmin())]
        while len(med) < min(k, len(x)):
            gain = np.maximum(d[med].min(0)[None] - d, 0).sum(1)
            gain[med] = -1
            med.append(int(gain.argmax()))
        while True:
            now, swap = d[med].min(0).sum(), None
            for i in range(len(med)):
                rest = [m for j, m in enumerate(med) if j != i]
                cost = np.minimum(d[rest].min(0)[None] if rest else np.inf, d).sum(1)
                if cost.min() < now - 1e-9:
                    now, swap = cost.min(), (i, int(cost.argmin()))
            if swap is None:
                break
            med[swap[0]] = swap[1]
        codes = x[med]

        def total(batches, codes=codes):
            for b in batches:
                y = matrix(b.column(0))
                d2 = (y**2).sum(1)[:, None] + (codes**2).sum(1)[None] - 2 * y @ codes.T
                yield pa.RecordBatch.from_arrays([pa.array([float(np.sqrt(np.maximum(d2.min(1), 0)).sum())])], ["t"])

        t = points.select("x").mapInArrow(total, "t double").agg(F.sum("t")).first()[0]
        if t < least:
            best, least = codes, t
    return assign(points, best), best


def cluster_labels(points: DataFrame, k: int, method: str = "CLARA") -> DataFrame:
    """(id, label): clusters that stand in for labels where rows are to be drawn evenly, by CLARA or kmeans."""
    if method not in ("CLARA", "kmeans"):
        raise ValueError(f"unknown method {method}: CLARA or kmeans")
    a = (clara if method == "CLARA" else kmeans)(points, k)[0]
    return a.select("id", F.col("cluster").cast("string").alias("label"))


def louvain(edges: DataFrame, rounds: int = 20) -> DataFrame:
    """(id, mc): communities of an undirected weighted edge table by greedy modularity, vertices in order of id, communities
    merged level by level and numbered by size. In memory, up to LOCAL_EDGES edges."""
    from .sparse import local_matrix

    e = edges.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.max("w").alias("w")).where("src <> dst")
    got = local_matrix(e)
    if got is None:
        raise ValueError("the graph is too large for communities in memory")
    ids, i, j, w = got
    group = np.arange(len(ids))
    n = len(ids)
    loops = np.zeros(n)
    for _ in range(rounds):
        near: list[dict[int, float]] = [{} for _ in range(n)]
        for a, b, c in zip(i.tolist(), j.tolist(), w.tolist()):
            near[a][b] = near[a].get(b, 0.0) + c
            near[b][a] = near[b].get(a, 0.0) + c
        degree = np.array([sum(x.values()) for x in near]) + 2 * loops
        total = degree.sum() or 1.0
        part, weight, moved = np.arange(n), degree.copy(), False
        while True:
            changed = 0
            for v in range(n):
                links: dict[int, float] = {}
                for u, c in near[v].items():
                    links[part[u]] = links.get(part[u], 0.0) + c
                own = part[v]
                weight[own] -= degree[v]
                best, gain = own, links.get(own, 0.0) - weight[own] * degree[v] / total
                for p in sorted(links):
                    g = links[p] - weight[p] * degree[v] / total
                    if g > gain + 1e-12:
                        best, gain = p, g
                weight[best] += degree[v]
                if best != own:
                    part[v] = best
                    changed += 1
            moved |= changed > 0
            if not changed:
                break
        if not moved:
            break
        _, part = np.unique(part, return_inverse=True)
        group = part[group]
        m = int(part.max()) + 1
        a, b = part[i], part[j]
        inner = a == b
        new = np.bincount(part, loops, m) + np.bincount(a[inner], w[inner], m)
        key = np.minimum(a, b)[~inner] * m + np.maximum(a, b)[~inner]
        u, at = np.unique(key, return_inverse=True)
        i, j, w, n, loops = u // m, u % m, np.bincount(at, w[~inner], len(u)), m, new
    size = np.bincount(group)
    rank = np.empty(len(size), np.int64)
    rank[np.lexsort((np.arange(len(size)), -size))] = np.arange(1, len(size) + 1)
    return edges.sparkSession.createDataFrame(pa.table({"id": ids, "mc": rank[group]}))


def clique_communities(edges: DataFrame, k: int = 3) -> DataFrame:
    """(community, id): unions of k-cliques that reach each other over shared (k-1)-subsets; the community is the smallest
    clique number. Cliques meet on their subsets, never pair by pair."""
    c = cliques(edges, k)
    c = c.withColumn("q", F.xxhash64("verts"))
    faces = c.select("q", "verts", F.explode("verts").alias("out")).select("q", F.array_remove(F.col("verts"), F.col("out")).alias("face"))
    low = faces.groupBy("face").agg(F.min("q").alias("v"))
    star = faces.join(low, "face").select(F.col("q").alias("u"), "v").where("u <> v")
    roots = connected(star)
    named = c.join(roots, c.q == roots.node, "left").select(F.coalesce("root", "q").alias("community"), F.explode("verts").alias("id")).distinct()
    first = named.groupBy("community").agg(F.min("id").alias("least"), F.count("*").alias("size"))
    return named.join(first, "community").select("community", "least", "size", "id")
