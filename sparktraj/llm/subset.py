"""Problem 1: a varied subset, by tournaments of rank-revealing QR with row pivoting.

A row stands for its feature vector under a Gaussian kernel of ``width``; the pivoted QR of these vectors needs only kernel
values (its coefficients are the columns of a pivoted Cholesky factor). Each task nominates rows that are linearly independent
up to a tolerance, largest residual first; pairs of nominations are merged and pivoted again up a tree, so no task holds more
than two nominations. The winners are kept, their span is deflated from what remains, and the next round begins.

* ``varied_subset``: rounds until k rows are chosen. Deflation is the projection onto all rows chosen so far. Where every residual
  has run out before, the kernel is narrowed, to half the greatest distance to a chosen row at most, and the rounds go on.
* ``cover``: no row is farther than ``radius`` from a chosen one, rows within it of a pick being deflated to nothing. The first
  tournament is over all rows. As the size of a cover follows the data, what it leaves open is cut into regions, as many as that
  needs, and the next rounds are a tournament in each, all at once, until no row is open.

Equal residuals go to the row that stands for more rows, then to the smaller id. Defined cases: unusable points are left out;
infinities count as +-1e150; if k exceeds what is there, all distinct rows come first and then copies are left out (rows within
1e-150 of each other are copies); an empty table gives no rows; equal vectors at different ids are covered by
one of them.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import kd_build, kd_reach, kd_route
from .common import DIM, hash_sample, matrix, materialize, pack, small_side, unpack, usable_points

#: Rows that a nomination holds at most, and rows of a chunk inside a task.
WIDTH, CHUNK = 512, 4096
#: Squared residual under which a row counts as dependent.
TOLERANCE = 1e-6
#: The kernel of a subset begins this many times as wide as the spread: wide enough that rows of a dense group depend on each other,
#: while lone ones don't; it narrows where that has nothing more to say.
START = 8.0
#: Rows that the tree of space is learned on, and rows aimed at for a leaf.
TREE_SAMPLE, LEAF_ROWS = 8_000, 20_000
NOMINEES = "node long, id long, weight double, x binary"
#: Open rows of a region; a weight of 0 marks the rows that were chosen there before.
REGIONAL = "region long, node long, id long, weight double, x binary"


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """From the products; those that cancel are taken again from the differences, so that copies, and only they, are at 0."""
    both = (a**2).sum(1)[:, None] + (b**2).sum(1)[None]
    d2 = both - 2 * (a @ b.T)
    i, j = np.nonzero(d2 <= 1e-6 * both)
    for s in range(0, len(i), 65536):
        p, q = i[s : s + 65536], j[s : s + 65536]
        d2[p, q] = ((a[p] - b[q]) ** 2).sum(1)
    return d2


def kernel(a: np.ndarray, b: np.ndarray, width: float) -> np.ndarray:
    return np.exp(-squared_distances(a, b) / (2 * width * width))


def pivot(ids, x, weight, most: int, width: float, radius: float | None, chosen: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers picked by the pivoted factorisation, and how many rows (by weight) each stands for.

    With ``radius`` rows within it of a pick are deflated wholly. ``chosen``: the rows chosen before, with the inverse of the Cholesky
    factor of their kernel, whose span is projected out first.
    """
    n = len(ids)
    left = np.ones(n)
    before = np.zeros((n, 0))
    if chosen is not None and len(chosen[0]):
        before = kernel(x, chosen[0], width) @ chosen[1].T
        left = 1 - (before**2).sum(1)
    rows, cols = [], np.zeros((n, min(most, n)))
    order = np.lexsort((ids, -weight))
    gain = np.zeros(min(most, n))
    owner, best = np.zeros(n, np.int64), np.full(n, -1.0)
    open_ = np.ones(n, bool)
    for t in range(min(most, n)):
        score = np.where(open_, np.round(left, 6), -1)[order]
        i = order[int(score.argmax())]
        if not open_[i] or left[i] <= TOLERANCE:
            break
        d2 = ((x - x[i]) ** 2).sum(1)
        k = np.exp(-d2 / (2 * width * width))
        c = (k - cols[:, :t] @ cols[i, :t] - before @ before[i]) / math.sqrt(left[i])
        cols[:, t] = c
        left = left - c * c
        left[i] = 0
        closer = k > best
        owner[closer], best[closer] = t, k[closer]
        rows.append(i)
        open_[i] = False
        if radius is not None:
            open_ &= d2 > radius * radius
    np.add.at(gain, owner, weight)
    return np.array(rows, np.int64), gain[: len(rows)]


class _Rounds:
    def __init__(self, width: float, radius: float | None, most: int, dim: int):
        self.width, self.radius, self.most, self.dim = width, radius, most, dim

    def best(self, ids, x, weight, chosen):
        o = np.argsort(ids, kind="stable")
        ids, x, weight = ids[o], x[o], weight[o]
        i, gain = pivot(ids, x, weight, self.most, self.width, self.radius, chosen)
        return ids[i], x[i], gain

    def tournament(self, rows: DataFrame, chosen: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and x of the winners among rows (id, x as binary); at most ``most`` of them reach the driver."""
        dim, best, radius = self.dim, self.best, self.radius
        names = ["node", "id", "weight", "x"]

        def nominate(batches):
            held = (np.empty(0, np.int64), np.empty((0, dim)), np.empty(0))
            node = TaskContext.get().partitionId()
            for b in batches:
                ids, x = b.column(0).to_numpy(), unpack(b.column(1), np.float64, dim)
                for s in range(0, len(ids), CHUNK):
                    i, y = ids[s : s + CHUNK], x[s : s + CHUNK]
                    if radius is not None:  # rows within the radius of a nominee are deflated, and count for it
                        owner = covered(y, held[1], radius)
                        np.add.at(held[2], owner[owner >= 0], 1.0)
                        i, y = i[owner < 0], y[owner < 0]
                    if len(i):
                        held = best(np.r_[held[0], i], np.r_[held[1], y], np.r_[held[2], np.ones(len(i))], chosen)
            if len(held[0]):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(held[0]), node)), pa.array(held[0]), pa.array(held[2]), pack(held[1])], names)

        def merge(t):
            got = best(t.column("id").to_numpy(), unpack(t.column("x"), np.float64, dim), t.column("weight").to_numpy(), chosen)
            return pa.table([pa.array(np.full(len(got[0]), t.column("node")[0].as_py())), pa.array(got[0]), pa.array(got[2]), pack(got[1])], names=names)

        nodes = max(1, rows.rdd.getNumPartitions())
        up = rows.mapInArrow(nominate, NOMINEES)
        while nodes > 1:
            nodes = -(-nodes // 2)
            up = up.withColumn("node", F.shiftright("node", 1)).groupBy("node").applyInArrow(merge, NOMINEES)
        t = up.toArrow()
        o = np.arange(t.num_rows)
        return t.column("id").to_numpy()[o], unpack(t.column("x"), np.float64, dim)[o]


def _packed(points: DataFrame, dim: int) -> DataFrame:
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pack(matrix(b.column(1), dim))], ["id", "x"])

    return points.select("id", "x").mapInArrow(run, "id long, x binary")


def spread_width(rows: DataFrame, dim: int) -> float:
    """Kernel width: half the root of the summed median absolute deviations squared, medians by mergeable sketches over all rows.

    Where more than half the rows agree in every channel, the mean absolute deviations of clipped values stand in for the medians.
    """

    def deviations(middle):
        def run(batches):
            for b in batches:
                x = np.abs(unpack(b.column(1), np.float64, dim) - middle) if middle is not None else unpack(b.column(1), np.float64, dim)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in x.T.copy()], names)

        return rows.mapInArrow(run, ", ".join(f"{c} double" for c in names))

    names = [f"c{i}" for i in range(dim)]
    middle = deviations(None).agg(*[F.percentile_approx(c, 0.5, 10_000) for c in names]).first()
    if middle[0] is None:
        return 1.0
    off = deviations(np.array(middle, float))
    spread = np.array(off.agg(*[F.percentile_approx(c, 0.5, 10_000) for c in names]).first(), float)
    if not spread.any():
        spread = np.array(off.agg(*[F.avg(F.least(c, F.lit(1e3))) for c in names]).first(), float)
    return 0.5 * math.sqrt(float((spread**2).sum())) or 1.0


def farthest(rows: DataFrame, chosen: np.ndarray, dim: int) -> float:
    """The greatest distance of a row to the nearest of ``chosen``; 0 if all rows are copies of these."""

    def run(batches):
        for b in batches:
            x, far = unpack(b.column(1), np.float64, dim), 0.0
            for s in range(0, len(x), CHUNK):
                far = max(far, float(squared_distances(x[s : s + CHUNK], chosen).min(1).max()))
            yield pa.RecordBatch.from_arrays([pa.array([far])], ["d2"])

    return math.sqrt(rows.mapInArrow(run, "d2 double").agg(F.max("d2")).first()[0] or 0.0)


def covered(x: np.ndarray, by: np.ndarray, radius: float) -> np.ndarray:
    """For each row the first of ``by`` within the radius, or -1; distances near the radius are taken from the differences."""
    out = np.full(len(x), -1)
    for s in range(0, len(x) if len(by) else 0, 1024):
        y = x[s : s + 1024]
        d2 = squared_distances(y, by)
        i, j = np.nonzero(np.abs(d2 - radius * radius) <= 1e-9 * ((y**2).sum(1)[:, None] + (by**2).sum(1)[None]))
        d2[i, j] = ((y[i] - by[j]) ** 2).sum(1)
        hit = d2 <= radius * radius
        out[s : s + 1024] = np.where(hit.any(1), hit.argmax(1), -1)
    return out


def inverse_factor(x: np.ndarray, width: float) -> np.ndarray:
    return np.linalg.inv(np.linalg.cholesky(kernel(x, x, width) + 1e-9 * np.eye(len(x))))


def _regional(region: int, node: int, ids, weight, x) -> pa.Table:
    arrays = [pa.array(np.full(len(ids), region)), pa.array(np.full(len(ids), node)), pa.array(ids), pa.array(np.asarray(weight, float)), pack(x)]
    return pa.table(arrays, names=["region", "node", "id", "weight", "x"])


def _split(t: pa.Table, dim: int) -> tuple:
    """Of a group of REGIONAL its open rows (ids, weight, x) by id, and the rows chosen before (ids, x), each once."""
    ids, weight, x = t.column("id").to_numpy(), t.column("weight").to_numpy(), unpack(t.column("x"), np.float64, dim)
    o = np.argsort(ids, kind="stable")
    o = o[weight[o] > 0]
    was, first = np.unique(np.where(weight > 0, -1, np.arange(len(ids))), return_index=True)
    first = first[was >= 0]
    first = first[np.unique(ids[first], return_index=True)[1]]
    return ids[o], weight[o], x[o], ids[first], x[first]


def _space(rows: DataFrame, dim: int) -> tuple[list, int]:
    """A tree of cuts learned on a bounded sample, and the number of rows."""
    n = rows.count()
    t = hash_sample(rows, n, TREE_SAMPLE, ["x"])
    x = np.clip(unpack(t.column("x"), np.float64, dim), -1e6, 1e6)
    return kd_build(x, 0.0, max(8, int(len(x) * LEAF_ROWS / max(1, n)))), n


def regional_round(state: DataFrame, last: int, radius: float, before: np.ndarray, dim: int) -> DataFrame:
    """(region, id, x): the winners of a tournament in every region, nodes 0 to ``last`` at most. What was chosen before goes up the
    tree with the nominations, so that its span is projected out at every step. Where that leaves nothing the kernel is narrowed, so
    a region with open rows has a winner."""

    def best(t):
        ids, weight, x, was, wx = _split(t, dim)
        span, width, rows = np.r_[before, wx], radius / 2, np.empty(0, np.int64)
        while len(ids) and not len(rows):
            touched = span[kernel(x, span, width).max(0) > 1e-6] if len(span) else span
            rows, gain = pivot(ids, x, weight, WIDTH, width, radius, (touched, inverse_factor(touched, width)) if len(touched) else None)
            width /= 2
        won = (ids[rows], gain, x[rows]) if len(rows) else (ids, weight, x)
        return _regional(t.column("region")[0].as_py(), t.column("node")[0].as_py(), np.r_[won[0], was], np.r_[won[1], np.zeros(len(was))], np.r_[won[2], wx])

    up = state.groupBy("region", "node").applyInArrow(best, REGIONAL)
    while last:
        last >>= 1
        up = up.withColumn("node", F.shiftright("node", 1)).groupBy("region", "node").applyInArrow(best, REGIONAL)
    return up.where("weight > 0").select("region", "id", "x")


def cover(points: DataFrame, radius: float, dim: int = DIM) -> tuple[DataFrame, DataFrame, list]:
    """Chosen rows (id, x as binary) such that every usable point lies within the radius of one; all rows packed; the tree."""
    rows = materialize(_packed(points, dim), "packed")
    tree, _ = _space(rows, dim)
    ids, first = _Rounds(radius / 2, radius, WIDTH, dim).tournament(rows, None)
    chosen = points.sparkSession.createDataFrame(pa.table({"id": ids, "x": pack(first)}), "id long, x binary")

    def still_open(batches):
        for b in batches:
            o = np.nonzero(covered(unpack(b.column(1), np.float64, dim), first, radius) < 0)[0]
            yield b.take(pa.array(o))

    left = materialize(rows.mapInArrow(still_open, "id long, x binary"), "open")
    n = left.count()
    if not n:
        return chosen, rows, tree
    t = hash_sample(left, n, TREE_SAMPLE, ["x"])
    x = np.clip(unpack(t.column("x"), np.float64, dim), -1e6, 1e6)
    regions = kd_build(x, 0.0, max(8, int(len(x) * 4 * WIDTH / n)))

    def home(batches):
        for b in batches:
            x = unpack(b.column(1), np.float64, dim)
            region = np.zeros(len(x), np.int64)
            for leaf, i in kd_route(regions, x, None) if len(x) else ():
                region[i] = leaf
            yield pa.RecordBatch.from_arrays([pa.array(region), b.column(0), pa.array(np.ones(len(x))), b.column(1)], ["region", "id", "weight", "x"])

    def uncovered(t):
        ids, weight, x, was, wx = _split(t, dim)
        o = np.nonzero(covered(x, wx, radius) < 0)[0]
        if not len(o):
            was, wx = was[:0], wx[:0]
        return _regional(t.column("region")[0].as_py(), t.column("node")[0].as_py(), np.r_[ids[o], was], np.r_[weight[o], np.zeros(len(was))], np.r_[x[o], wx])

    at = left.mapInArrow(home, "region long, id long, weight double, x binary")
    sizes = small_side(at.groupBy("region").agg(F.ceil(F.count("*") / CHUNK).alias("m")))[0]  # a row per region
    state = materialize(at.join(sizes, "region").withColumn("node", F.pmod(F.xxhash64("id"), F.col("m"))).select("region", "node", "id", "weight", "x"), "state")
    while True:
        last = state.agg(F.max("node")).first()[0]
        if last is None:
            return chosen, rows, tree
        won = materialize(regional_round(state, last, radius, first, dim), "won")
        chosen = materialize(chosen.unionByName(won.select("id", "x")), "chosen")
        told = state.select("region", "node").distinct().join(won, "region").withColumn("weight", F.lit(0.0))
        state = materialize(state.unionByName(told).groupBy("region", "node").applyInArrow(uncovered, REGIONAL), "state")


def varied_subset(points: DataFrame, k: int, width: float | None = None, dim: int = DIM, most: int = 256) -> DataFrame:
    """(id, pick): k rows in the order of their choice."""
    rows = materialize(_packed(points, dim), "packed")
    width = width or START * spread_width(rows, dim)
    ids, xs = np.empty(0, np.int64), np.empty((0, dim))
    while len(ids) < k:
        before = (xs, inverse_factor(xs, width)) if len(ids) else None  # once a round
        got, x = _Rounds(width, None, min(most, k - len(ids)), dim).tournament(rows, before)
        new = ~np.isin(got, ids)
        if not new.any():
            far = farthest(rows, xs, dim) if len(ids) else 0.0
            if far < 1e-150:
                break
            width = min(width, far) / 2
            continue
        ids, xs = np.r_[ids, got[new]], np.r_[xs, x[new]]
    return points.sparkSession.createDataFrame(pa.table({"id": ids, "pick": np.arange(1, len(ids) + 1)}))


def isolated(chosen: DataFrame, rows: DataFrame, tree: list, radius: float, dim: int = DIM) -> DataFrame:
    """The chosen ids with no other row within the radius. A row goes to its own leaf, a chosen one to every leaf that has points
    within the radius of it; leaves that hold many rows are split by a hash of id, each split seeing all chosen ones of the leaf."""

    def home(batches):
        for b in batches:
            x = unpack(b.column(1), np.float64, dim)
            for leaf, i in kd_route(tree, x, None) if len(x) else ():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), leaf)), b.column(0).take(pa.array(i)), pack(x[i])], ["leaf", "id", "x"])

    def ask(batches):
        for b in batches:
            x = unpack(b.column(1), np.float64, dim)
            for leaf, i in kd_reach(tree, x, radius) if len(x) else ():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), leaf)), b.column(0).take(pa.array(i)), pack(x[i])], ["of", "cid", "cx"])

    at = rows.mapInArrow(home, "leaf long, id long, x binary")
    sizes = small_side(at.groupBy("leaf").agg(F.ceil(F.count("*") / (2.0 * LEAF_ROWS)).alias("m")))[0]  # a row per leaf
    at = at.join(sizes, "leaf").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("m"))).drop("m")
    asked = chosen.select("id", "x").mapInArrow(ask, "of long, cid long, cx binary").join(sizes.withColumnRenamed("leaf", "of"), "of")
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1))).drop("m")

    def near(t, c):
        hit = np.zeros(c.num_rows, bool)
        if t.num_rows and c.num_rows:
            ids, x, ci, cx = t.column("id").to_numpy(), unpack(t.column("x"), np.float64, dim), c.column("cid").to_numpy(), unpack(c.column("cx"), np.float64, dim)
            for s in range(0, len(ids), 1024):
                open_ = np.nonzero(~hit)[0]
                if not len(open_):
                    break
                y = x[s : s + 1024]
                a, j = np.nonzero((y**2).sum(1)[:, None] + (cx[open_] ** 2).sum(1)[None] - 2 * (y @ cx[open_].T) <= radius * radius * (1 + 1e-6) + 1e-6 * (y**2).sum(1)[:, None])
                j = open_[j]
                other = ids[s + a] != ci[j]
                a, j = a[other], j[other]
                hit[j[((y[a] - cx[j]) ** 2).sum(1) <= radius * radius]] = True
            return pa.table({"id": ci[hit]})
        return pa.table({"id": pa.array([], pa.int64())})

    got = at.groupBy("leaf", "salt").cogroup(asked.groupBy("of", "part")).applyInArrow(near, "id long")
    return chosen.select("id").join(got.distinct(), "id", "left_anti")


def p1_found(spark, d: str) -> DataFrame:
    """The points that every cover of radius 8.0 must contain: those of the cover chosen here without another point that near."""
    return isolated(*cover(usable_points(spark.read.parquet(f"{d}/points.parquet")), 8.0), 8.0)


def p1_subset(spark, d: str) -> DataFrame:
    """500 rows that cover the spread of the data, with their file and source event."""
    points = usable_points(spark.read.parquet(f"{d}/points.parquet")).persist()
    return points.join(F.broadcast(varied_subset(points, 500)), "id").select("id", "file_id", "events_sel", "pick")
