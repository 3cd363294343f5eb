"""Problem 2: most similar vectors for every vector, by learned partitions.

A neighbour graph of a bounded sample is cut into balanced parts; a small linear classifier learns the parts and gives every
row of the whole collection its part (the index). Two searches use it:

* ``search``: a query goes to its most probable parts, until their probabilities reach ``mass``, and all rows there are ranked
  by exact distance. Approximate; the recall against brute force is measured in the tests and the README.
* ``near_lists``: every row is a query, for neighbours within a radius. Besides its own part a row goes to the other parts that
  are probable enough to be its neighbours': those whose score could win within the radius. The scores are linear, so that
  bound on the probability is strict and the lists are exact. A part that holds more than a block of rows is cut by a tree
  learned on a bounded sample of its own rows, and its leaves again, until all blocks fit.

Defined cases: unusable points (x null, of another length, with null or NaN inside) are left out; infinities count as +-1e150;
equal vectors are different points at distance 0; ties in distance go to the smaller id; an empty table gives no rows; columns
other than those named are ignored. Groups of equal vectors are searched once and expanded after.
"""
from __future__ import annotations

import math
import pickle
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import kd_build, kd_extend, kd_route, links_top_k
from .common import DIM, hash_sample, matrix, materialize, pack, small_side, split_copies, unpack, usable_points

#: Rows that the partition is learned on, at most a quarter more.
SAMPLE_ROWS = 8_000
#: Rows aimed at for a part, and the most parts; a part that grows beyond is cut further inside.
PART_ROWS, MAX_PARTS = 12_000, 256
#: A block with more rows is cut by a tree on a sample of its rows; one that can't be cut is searched as pairs of sub-blocks.
BLOCK_ROWS, BLOCK_SAMPLE = 24_000, 4_000
#: The most parts and rows of a block of ``near_lists``: every cut copies the rows within the radius of it, those of a tree along the
#: widest directions fewer than those between many parts.
LIST_PARTS, LIST_ROWS = 16, 150_000


def neighbour_graph(x: np.ndarray, k: int = 10) -> np.ndarray:
    """k nearest rows of every row, by brute force over the bounded sample."""
    sq = (x**2).sum(1)
    out = np.empty((len(x), min(k, len(x) - 1)), np.int32)
    for s in range(0, len(x), 1000):
        d = sq[None] - 2 * (x[s : s + 1000] @ x.T)
        d[np.arange(len(d)), np.arange(s, s + len(d))] = np.inf
        out[s : s + 1000] = np.argpartition(d, out.shape[1] - 1, axis=1)[:, : out.shape[1]]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 8, slack: float = 1.1) -> np.ndarray:
    """Cut the neighbour graph into parts of nearly equal size with few edges between them.

    Starts from halvings along principal directions; then rows move to the part that most of their neighbours are in, those
    that gain most first, as long as the part has room.
    """
    part = np.zeros(len(x), np.int64)

    def halve(idx: np.ndarray, lo: int, n: int) -> None:
        if n == 1:
            part[idx] = lo
            return
        c = x[idx] - x[idx].mean(0)
        t = c @ np.linalg.eigh(c.T @ c)[1][:, -1]
        o, a = np.argsort(t, kind="stable"), n // 2
        cut = len(idx) * a // n
        halve(idx[o[:cut]], lo, a)
        halve(idx[o[cut:]], lo + a, n - a)

    halve(np.arange(len(x)), 0, parts)
    room = int(math.ceil(slack * len(x) / parts))
    size = np.bincount(part, minlength=parts)
    rows = np.arange(len(x))
    for _ in range(rounds):
        votes = np.zeros((len(x), parts), np.int32)
        np.add.at(votes, (np.repeat(rows, graph.shape[1]), part[graph.ravel()]), 1)
        best = votes.argmax(1)
        gain = votes[rows, best] - votes[rows, part]
        moved = 0
        for i in np.argsort(-gain, kind="stable")[: int((gain > 0).sum())]:
            if size[best[i]] < room:
                size[best[i]] += 1
                size[part[i]] -= 1
                part[i] = best[i]
                moved += 1
        if not moved:
            break
    return part


class PartRouter:
    """The classifier: part of x = argmax(w x + b), probabilities by softmax; ``trees`` cut parts that are too large."""

    def __init__(self, w: np.ndarray, b: np.ndarray):
        self.w, self.b, self.trees = w, b, [[(None, 0, -1, -1)] for _ in b]

    @classmethod
    def fit(cls, x: np.ndarray, n: int, steps: int = 120, seed: int = 3, most: int = MAX_PARTS) -> "PartRouter":
        """``x``: the bounded sample; ``n``: rows of the whole collection, which set the number of parts, up to ``most``."""
        dim = x.shape[1] if x.ndim == 2 and x.size else DIM
        parts = int(min(most, math.ceil(n / PART_ROWS), max(1, len(x) // 40)))
        x = np.clip(x, -1e6, 1e6)
        if parts < 2:
            return cls(np.zeros((1, dim)), np.zeros(1))
        graph = neighbour_graph(x)
        part = balanced_parts(x, graph, parts)
        mean, sd = np.median(x, 0), np.maximum(np.quantile(np.abs(x - np.median(x, 0)), 0.7, axis=0), 1e-6)
        z = np.clip((x - mean) / sd, -6, 6)
        near = np.zeros((len(x), parts))
        np.add.at(near, (np.repeat(np.arange(len(x)), graph.shape[1]), part[graph.ravel()]), 0.5 / graph.shape[1])
        near[np.arange(len(x)), part] += 0.5
        rng = np.random.default_rng(seed)
        w, b = rng.normal(0, 0.01, (parts, dim)), np.zeros(parts)
        m, v = np.zeros((parts, dim + 1)), np.zeros((parts, dim + 1))
        for t in range(1, steps + 1):
            rows = rng.choice(len(x), min(len(x), 4000), replace=False)
            s = z[rows] @ w.T + b
            p = np.exp(s - s.max(1, keepdims=True))
            g = (p / p.sum(1, keepdims=True) - near[rows]) / len(rows)
            grad = np.c_[g.T @ z[rows] + 1e-5 * w, g.sum(0)]
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
            w, b = w - step[:, :-1], b - step[:, -1]
        return cls(w / sd, b - (w / sd) @ mean)

    def home(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.w.T + self.b).argmax(1)

    def likely(self, x: np.ndarray, mass: float):
        """(row, part) for the most probable parts of each row up to ``mass``."""
        s = x @ self.w.T + self.b
        p = np.exp(s - s.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        o = np.argsort(-p, axis=1)
        before = np.cumsum(np.take_along_axis(p, o, 1), 1) - np.take_along_axis(p, o, 1)
        i, j = np.nonzero(before < mass)
        return i, o[i, j]

    def route(self, x: np.ndarray, r: float):
        """Yields (block, row numbers) so that any two rows within r meet in a block.

        A neighbour y of x with home part j has s_j(y) >= s_l(y) for every part l, hence s_j(x) >= s_l(x) - r |w_l - w_j|. Of two
        rows with different homes one goes to the other's (see ``goes_to``).
        """
        s = x @ self.w.T + self.b
        i = s.argmax(1)
        gap = r * np.sqrt(np.maximum(0, ((self.w[:, None] - self.w[None]) ** 2).sum(2))) + 1e-9
        lacks = s[np.arange(len(x)), i][:, None] - s
        to = (lacks <= gap[i] + 1e-9 * np.abs(s).max(1, keepdims=True)) & goes_to(len(self.b))[i]
        a, j = np.nonzero(to)
        to[a, j] = (s[a] - s[a, j][:, None] <= gap[j] + 1e-9 * np.abs(s[a]).max(1, keepdims=True)).all(1)
        to[np.arange(len(x)), i] = True
        for j in np.nonzero(to.any(0))[0]:
            idx = np.nonzero(to[:, j])[0]
            for leaf, sub in kd_route(self.trees[j], x[idx], r):
                yield int(j) << 20 | leaf, idx[sub]


def goes_to(parts: int) -> np.ndarray:
    """[i, j]: of two near rows with homes i and j the one at home in i goes to j. The part that receives is the larger number if
    their sum is even, else the smaller, so that no part receives from all its neighbours."""
    i, j = np.arange(parts)[:, None], np.arange(parts)[None]
    return np.where((i + j) % 2 == 0, j > i, j < i) | (i == j)


def blocks_and_rows(routed: list) -> tuple[np.ndarray, np.ndarray]:
    """(block, row number) of all that a batch is routed to, so that it leaves as one batch and not as one a block."""
    if not routed:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.repeat(np.array([k for k, _ in routed], np.int64), [len(i) for _, i in routed]), np.concatenate([i for _, i in routed])


def cut_large(points: DataFrame, router, r: float, dim: int = DIM, block_rows: int = BLOCK_ROWS) -> tuple[dict[int, int], int]:
    """Grows the router's trees until no block holds more than ``block_rows`` rows; returns the blocks (and their sizes) that do and
    that no tree cuts, as their rows lie too close together, and the number of blocks. A round counts all rows and draws BLOCK_SAMPLE of every large
    block, by a hash of id; trees are grown on the executors, a vector for every two blocks."""

    def count(batches):
        for b in batches:
            x = matrix(b.column(1), dim)
            got = [(k, len(i)) for k, i in router.route(x, r)] if len(x) else []
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in got], pa.int64()), pa.array([n for _, n in got], pa.int64())], ["block", "n"])

    points, whole = points.select("id", "x"), {}
    while True:
        blocks = points.mapInArrow(count, "block long, n long").groupBy("block").agg(F.sum("n").alias("n"))
        got = blocks.agg(F.count("*").alias("all"), F.collect_list(F.when(F.col("n") > block_rows, F.struct("block", "n"))).alias("large")).first()
        size = {a["block"]: a["n"] for a in got["large"]}
        whole = {k: n for k, n in size.items() if k in whole}
        open_ = {k: n for k, n in size.items() if k not in whole}
        if not open_:
            return whole, got["all"]

        def draw(batches, open_=open_):
            for b in batches:
                x, h = matrix(b.column(1), dim), b.column(2).to_numpy()
                got = [(k, i[h[i] < BLOCK_SAMPLE / open_[k]]) for k, i in router.route(x, r) if k in open_] if len(x) else []
                k, i = blocks_and_rows(got)
                yield pa.RecordBatch.from_arrays([pa.array(k), pack(x[i])], ["block", "x"])

        def grow(key, t):
            x, n = unpack(t.column("x"), np.float64, dim), open_[key[0].as_py()]
            # a leaf aims at three quarters of a block, and stands on 40 rows of the sample at least
            return pa.table({"block": [key[0].as_py()], "tree": pa.array([pickle.dumps(kd_build(x, r, max(40, int(len(x) * block_rows * 0.75 / n))))], pa.binary())})

        hashed = points.withColumn("h", F.pmod(F.xxhash64("id", F.lit(13)), F.lit(1 << 30)) / float(1 << 30))
        trees = hashed.mapInArrow(draw, "block long, x binary").groupBy("block").applyInArrow(grow, "block long, tree binary").collect()
        grown = {t["block"]: pickle.loads(t["tree"]) for t in trees}
        for k, n in open_.items():
            tree = grown.get(k, [(None, 0, -1, -1)])
            if len(tree) == 1:
                whole[k] = n
            else:
                router.trees[k >> 20] = kd_extend(router.trees[k >> 20], k & 0xFFFFF, tree)


def exchange(points: DataFrame, router, r: float, dim: int = DIM, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(block, s, t, side, id, x as binary): each row in its blocks. Blocks over ``block_rows`` rows that no tree cuts are split by a
    hash of id into m sub-blocks, and every pair (s, t) of them becomes a task of its own; nothing is capped or dropped. Blocks are
    spread over twice as many partitions as there are, so that a task reads a block or a few small ones at any size."""
    large, blocks = cut_large(points, router, r, dim, block_rows)
    parts = max(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * (blocks + sum((2 * n // block_rows + 1) ** 2 // 2 for n in large.values())))

    def send(batches):
        for b in batches:
            x = matrix(b.column(1), dim)
            ids = b.column(0).to_numpy(zero_copy_only=False)
            k, i = blocks_and_rows(list(router.route(x, r)) if len(x) else [])
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(ids[i]), pack(x[i])], ["block", "id", "x"])

    points = points.select("id", "x")
    sent = points.mapInArrow(send, "block long, id long, x binary")
    if not large:
        return sent.select("block", F.lit(0).alias("s"), F.lit(0).alias("t"), F.lit(0).alias("side"), "id", "x").repartition(parts, "block", "s", "t")
    split = points.sparkSession.createDataFrame([(k, -(-n * 2 // block_rows)) for k, n in large.items()], "block long, m long")
    sent = sent.join(small_side(split)[0], "block", "left").withColumn("m", F.coalesce("m", F.lit(1)))
    sent = sent.withColumn("side", F.pmod(F.xxhash64("id", F.lit(5)), F.col("m")).cast("int"))
    sent = sent.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("m").cast("int") - 1)))
    return sent.select("block", F.least("side", "o").alias("s"), F.greatest("side", "o").alias("t"), "side", "id", "x").repartition(parts, "block", "s", "t")


def in_blocks(sent: DataFrame, kernel: Callable, schema: str, dim: int = DIM) -> DataFrame:
    """kernel(ids, x, side or None) -> arrays of the schema's columns, for each block or pair of sub-blocks."""
    names = [c.split()[0] for c in schema.split(",")]

    def run(key, t):
        x = unpack(t.column("x"), np.float64, dim)
        side = None if key[1].as_py() == key[2].as_py() else t.column("side").to_numpy()
        return pa.table(dict(zip(names, map(pa.array, kernel(t.column("id").to_numpy(), x, side)))))

    return sent.groupBy("block", "s", "t").applyInArrow(run, schema)


def fit_router(points: DataFrame, dim: int = DIM, most: int = MAX_PARTS) -> tuple[PartRouter, np.ndarray, int]:
    n = points.count()
    x = matrix(hash_sample(points, n, SAMPLE_ROWS, ["x"]).column("x"), dim)
    return PartRouter.fit(x, n, most=most), x, n


def _smallest(members: DataFrame, k: int) -> DataFrame:
    """(rep, dst): the k smallest ids of every group of copies, first within 32 salts of a group, so that no task holds a hot one."""
    w = Window.partitionBy("rep", F.pmod(F.xxhash64("id"), F.lit(32))).orderBy("id")
    some = members.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k)
    w = Window.partitionBy("rep").orderBy("id")
    return some.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).select("rep", F.col("id").alias("dst"))


def near_lists(points: DataFrame, r: float, k: int, dim: int = DIM) -> DataFrame:
    """(src, dst, rnk, dist): for every point its k nearest others as far as they lie within r, exact. points: id, x, usable."""
    points = points.select("id", "x").persist()
    router, _, _ = fit_router(points, dim, LIST_PARTS)
    reps, others, copies = split_copies(points)
    links = in_blocks(exchange(reps, router, r, dim, LIST_ROWS), lambda i, x, s: links_top_k(i, x, r, k, s), "src long, dst long, dist double", dim)
    links = links.dropDuplicates(["src", "dst"])
    if copies:
        w = Window.partitionBy("src").orderBy("dist", "dst")
        links = materialize(links.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).drop("n"), "links")
        groups = others.select("rep").distinct()
        members = others.unionByName(groups.select(F.col("rep").alias("id"), "rep"))
        first = materialize(_smallest(members, k + 1), "first")
        links = links.unionByName(groups.select(F.col("rep").alias("src"), F.col("rep").alias("dst"), F.lit(0.0).alias("dist")))
        links = links.join(first.withColumnRenamed("dst", "to"), links.dst == first.rep, "left").select("src", F.coalesce("to", "dst").alias("dst"), "dist")
        links = links.join(members, links.src == members.rep, "left").select(F.coalesce("id", "src").alias("src"), "dst", "dist").where("src <> dst")
    w = Window.partitionBy("src").orderBy("dist", "dst")
    return links.withColumn("rnk", F.row_number().over(w)).where(F.col("rnk") <= k).select("src", "dst", "rnk", "dist")


def search(points: DataFrame, queries: DataFrame, k: int, mass: float = 0.999, dim: int = DIM, router: PartRouter | None = None, chunk_rows: int = 20_000) -> DataFrame:
    """(src, dst, rnk, dist): for every query (id, x) its k nearest points other than itself, from its most probable parts."""
    points, queries = points.select("id", "x"), queries.select("id", "x")
    if router is None:
        points = points.persist()
        router = fit_router(points, dim)[0]

    def index(batches):
        for b in batches:
            x = matrix(b.column(1), dim)
            yield pa.RecordBatch.from_arrays([pa.array(router.home(x).astype(np.int64)), b.column(0), pack(x)], ["part", "id", "x"])

    def ask(batches):
        for b in batches:
            x = matrix(b.column(1), dim)
            i, part = router.likely(x, mass)
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int64)), b.column(0).take(pa.array(i)), pack(x[i])], ["part", "id", "x"])

    indexed = points.mapInArrow(index, "part long, id long, x binary")
    # at most MAX_PARTS rows
    sizes = points.sparkSession.createDataFrame(indexed.groupBy("part").agg(F.ceil(F.count("*") / chunk_rows).alias("m")).collect(), "part long, m long")
    indexed = indexed.join(F.broadcast(sizes), "part").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("m"))).drop("m")
    asked = queries.mapInArrow(ask, "part long, id long, x binary").join(F.broadcast(sizes), "part")
    asked = asked.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1))).drop("m")

    def rank(q, p):
        qi, pi = q.column("id").to_numpy(), p.column("id").to_numpy()
        qx, px = unpack(q.column("x"), np.float64, dim), unpack(p.column("x"), np.float64, dim)
        src, dst, dist = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        sq, take = (px**2).sum(1), min(k + 1, len(pi))
        for s in range(0, len(qi) if len(pi) else 0, 256):
            d = sq[None] - 2 * (qx[s : s + 256] @ px.T)
            near = np.argpartition(d, take - 1, axis=1)[:, :take]
            exact = np.sqrt(((qx[s : s + 256, None] - px[near]) ** 2).sum(2))
            src.append(np.repeat(qi[s : s + 256], take))
            dst.append(pi[near].ravel())
            dist.append(exact.ravel())
        a, b, c = map(np.concatenate, (src, dst, dist))
        return pa.table({"src": a[a != b], "dst": b[a != b], "dist": c[a != b]})

    near = asked.groupBy("part", "chunk").cogroup(indexed.groupBy("part", "chunk")).applyInArrow(rank, "src long, dst long, dist double")
    w = Window.partitionBy("src").orderBy("dist", "dst")
    return near.withColumn("rnk", F.row_number().over(w)).where(F.col("rnk") <= k).select("src", "dst", "rnk", "dist")


def p2_found(spark, d: str) -> DataFrame:
    """Pairs at 0.4 or less of which one is among the 5 nearest of the other."""
    near = near_lists(usable_points(spark.read.parquet(f"{d}/points.parquet")), 0.4, 5)
    return near.select(F.least("src", "dst").alias("id_a"), F.greatest("src", "dst").alias("id_b")).distinct()


def p2_knn(spark, d: str) -> DataFrame:
    """The 10 nearest of every usable point whose id is divisible by 100, against all usable points."""
    points = usable_points(spark.read.parquet(f"{d}/points.parquet")).select("id", "x").persist()
    return search(points, points.where("id % 100 = 0"), 10)
