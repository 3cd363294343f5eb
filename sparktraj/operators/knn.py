"""k nearest neighbours of a point cloud: exact in blocks, approximate by a forest of random projections; neighbour-list algebra.

A neighbour table has (src, dst, rnk, dist), the point itself left out, rnk from 1; ties in distance go to the smaller id.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .vectors import matrix

#: Rows of a block of either side.
BLOCK = 8192
NEIGHBOURS = "src long, dst long, dist double"


def _nearest(qi, qx, pi, px, k, metric):
    """Directed candidates of each query among the points of a block."""
    out = []
    if metric == "cosine":
        qx, px = qx / np.maximum(np.linalg.norm(qx, axis=1, keepdims=True), 1e-300), px / np.maximum(np.linalg.norm(px, axis=1, keepdims=True), 1e-300)
    take = min(k + 1, len(pi))
    for s in range(0, len(qi) if take else 0, 512):
        q = qx[s : s + 512]
        if metric == "cosine":
            d = np.abs(1 - q @ px.T)
        else:
            d = (px**2).sum(1)[None] - 2 * (q @ px.T)
        # every candidate not farther than the last one taken, so that equal distances stay for the final ranking
        edge = np.partition(d, take - 1, axis=1)[:, take - 1 : take]
        i, j = np.nonzero(d <= edge + 1e-9 * (1 + np.abs(edge)))
        exact = d[i, j] if metric == "cosine" else np.sqrt(((q[i] - px[j]) ** 2).sum(1))
        out.append((qi[s + i], pi[j], exact))
    if not out:
        return pa.table({"src": pa.array([], pa.int64()), "dst": pa.array([], pa.int64()), "dist": pa.array([], pa.float64())})
    a, b, c = map(np.concatenate, zip(*out))
    keep = a != b
    return pa.table({"src": a[keep], "dst": b[keep], "dist": c[keep]})


def top_neighbours(candidates: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("src").orderBy("dist", "dst")
    return candidates.withColumn("rnk", F.row_number().over(w)).where(F.col("rnk") <= k).select("src", "dst", "rnk", "dist")


def nearest(queries: DataFrame, points: DataFrame, k: int, metric: str = "euclid") -> DataFrame:
    """Exact: every query against every block of the points; a block keeps k candidates a query, so memory is bounded by blocks.

    The work is the product of both sides by nature; ``knn(method="forest")`` is the way for large clouds.
    """
    n, m = points.count(), queries.count()
    blocks, parts = max(1, math.ceil(n / BLOCK)), max(1, math.ceil(m / BLOCK))
    left = queries.select("id", "x", F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
    right = points.select(F.col("id").alias("pid"), F.col("x").alias("px"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).alias("block_"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part_"))

    def run(q, p):
        if not q.num_rows or not p.num_rows:
            return _nearest(np.empty(0, np.int64), np.empty((0, 1)), np.empty(0, np.int64), np.empty((0, 1)), k, metric)
        return _nearest(q.column("id").to_numpy(), matrix(q.column("x")), p.column("pid").to_numpy(), matrix(p.column("px")), k, metric)

    return top_neighbours(left.groupBy("part", "block").cogroup(right.groupBy("part_", "block_")).applyInArrow(run, NEIGHBOURS), k)


def forest(points: DataFrame, k: int, trees: int = 24, leaf: int = 400, sample: int = 10_000, seed: int = 1) -> DataFrame:
    """Approximate: each tree cuts space at medians along random directions (learned on a bounded sample); neighbours are sought
    within leaves and the best of all trees kept. Leaves that grow beyond four times their size are searched in blocks of
    pairs, so no row is dropped."""
    n = points.count()
    keep = min(1_000_000, int(sample / max(n, 1) * 1_000_000) + 1)
    x = matrix(points.where(F.pmod(F.xxhash64("id", F.lit(2)), F.lit(1_000_000)) < keep).select("x").toArrow().column("x"))
    depth = max(0, math.ceil(math.log2(max(1, n) / leaf)))
    rng = np.random.default_rng(seed)

    def grow(x, level):
        if level == 0 or len(x) < 4:
            return None
        a, b = x[rng.integers(len(x))], x[rng.integers(len(x))]
        v = a - b if (a != b).any() else rng.normal(size=x.shape[1])
        v = v / np.linalg.norm(v)
        t = x @ v
        m = float(np.median(t))
        return v, m, grow(x[t < m], level - 1), grow(x[t >= m], level - 1)

    roots = [grow(x, depth) for _ in range(trees if depth else 1)]

    def leaves(batches):
        for b in batches:
            x = matrix(b.column(1))
            for t, root in enumerate(roots):
                code = np.ones(len(x), np.int64)
                stack = [(root, np.arange(len(x)))]
                while stack:
                    node, idx = stack.pop()
                    if node is None or not len(idx):
                        continue
                    right = x[idx] @ node[0] >= node[1]
                    code[idx] = code[idx] * 2 + right
                    stack += [(node[2], idx[~right]), (node[3], idx[right])]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(code), b.column(0), b.column(1)], ["tree", "leaf", "id", "x"])

    coded = points.select("id", "x").mapInArrow(leaves, "tree int, leaf long, id long, x array<double>")
    sizes = coded.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / (4.0 * leaf)).alias("m"))
    coded = coded.join(sizes, ["tree", "leaf"]).withColumn("own", F.pmod(F.xxhash64("id"), F.col("m")))
    asked = coded.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)))
    key = ["tree", "leaf", "own", "other"]
    there = asked.select(*[F.col(c).alias(n + "_") for c, n in zip(["tree", "leaf", "other", "own"], key)], F.col("id").alias("pid"), F.col("x").alias("px"))

    def run(q, p):
        if not q.num_rows or not p.num_rows:
            return _nearest(np.empty(0, np.int64), np.empty((0, 1)), np.empty(0, np.int64), np.empty((0, 1)), k, "euclid")
        return _nearest(q.column("id").to_numpy(), matrix(q.column("x")), p.column("pid").to_numpy(), matrix(p.column("px")), k, "euclid")

    near = asked.select(*key, "id", "x").groupBy(*key).cogroup(there.groupBy(*[c + "_" for c in key])).applyInArrow(run, NEIGHBOURS)
    return top_neighbours(near.dropDuplicates(["src", "dst"]), k)


def knn(points: DataFrame, k: int, method: str = "exact", metric: str = "euclid", **options) -> DataFrame:
    if method == "forest":
        if metric != "euclid":
            raise ValueError("the forest searches by Euclidean distance")
        return forest(points, k, **options)
    return nearest(points, points, k, metric)


def with_self(lists: DataFrame) -> DataFrame:
    """Adds the point itself as rank 0, as raw neighbour matrices have it."""
    own = lists.select("src").distinct().select("src", F.col("src").alias("dst"), F.lit(0).alias("rnk"), F.lit(0.0).alias("dist"))
    return lists.unionByName(own)


def first_k(lists: DataFrame, k: int) -> DataFrame:
    """Keeps the k nearest of each list; lists shorter than k stay as they are."""
    return lists.where(F.col("rnk") <= k)


def reorder(lists: DataFrame) -> DataFrame:
    """Ranks every list anew by its distances."""
    w = Window.partitionBy("src").orderBy("dist", "dst")
    return lists.withColumn("rnk", F.row_number().over(w))


def continuous_scale(lists: DataFrame) -> DataFrame:
    """dist / sqrt(d_k(src) d_k(dst)), d_k the distance to the last neighbour of a list."""
    last = lists.groupBy("src").agg(F.max("dist").alias("dk"))
    far = last.select(F.col("src").alias("dst"), F.col("dk").alias("dk2"))
    return lists.join(last, "src").join(far, "dst").select("src", "dst", "rnk", (F.col("dist") / (F.sqrt("dk") * F.sqrt("dk2"))).alias("dist"))


def jaccard(lists: DataFrame, k: int) -> DataFrame:
    """(src, dst, w): for each listed pair the shared members of both lists u, as u / (2k - u) / 2; pairs that share none drop out."""
    sets = lists.groupBy("src").agg(F.collect_list("dst").alias("s"))  # k ids
    other = sets.select(F.col("src").alias("dst"), F.col("s").alias("t"))
    both = lists.select("src", "dst").join(sets, "src").join(other, "dst").withColumn("u", F.size(F.array_intersect("s", "t")))
    return both.where("u > 0").select("src", "dst", (F.col("u") / (2.0 * k - F.col("u")) / 2.0).alias("w"))


def jaccard_graph(lists: DataFrame, k: int) -> DataFrame:
    """(a, b, n): undirected edges between lists that share members, with the number of directed ones."""
    j = jaccard(lists, k)
    return j.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count("*").alias("n"))
