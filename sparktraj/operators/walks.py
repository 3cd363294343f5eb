"""Random walks on oriented transition tables and sequence operators on walks (walk_id, step, v), steps from 1 without gaps."""
from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashrand import uniform
from ..functions.ordered import numbered
from ..sources.shared import written
from .vectors import avg_vector, matrix

#: Edges of the origin up to which they are broadcast.
MANY_EDGES = 100_000


def by_step():
    return Window.partitionBy("walk_id").orderBy("step")


def cumulative(edges: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(src, dst, w, lo, hi): shares of each row (of each group ``by``) as intervals of [0, 1) in order of dst."""
    keys = [*(by or []), "src"]
    w = Window.partitionBy(*keys).orderBy("dst")
    total = Window.partitionBy(*keys)
    e = edges.where("w > 0").withColumn("hi", F.sum("w").over(w) / F.sum("w").over(total)).withColumn("w", F.col("w") / F.sum("w").over(total))
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("dst"))) == 1
    e = e.withColumn("hi", F.when(last, 1.0).otherwise(F.col("hi")))
    return e.withColumn("lo", F.coalesce(F.lag("hi").over(w), F.lit(0.0)))


def simulate(edges: DataFrame, origin: int, n: int, seed: int = 1, most_steps: int | None = None, every: int = 8, starts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """n walks from the origin until a vertex without out-edges (or ``most_steps`` vertices): the steps and (walk_id, len, gprob).

    With ``starts`` (walk_id, fate) the edges have a column fate too, and a walk takes those of its fate.

    All walks move together: one join a step; u(walk, step) picks the edge whose interval holds it. gprob is the geometric mean
    of the step probabilities. A walk's row carries its last few steps, so that each block of steps is one chain of joins,
    written at its end. All walks begin at the same vertex: its edges, where they are few, are broadcast for the first step."""
    fate = ["fate"] if starts is not None else []
    table = written(cumulative(edges.select(*fate, "src", "dst", "w"), fate).repartition(*fate, "src"), "edges")
    first = table.where(F.col("src") == int(origin))
    first = F.broadcast(first) if first.limit(MANY_EDGES + 1).count() <= MANY_EDGES else first
    at = F.struct(F.col("step"), F.col("v"), F.lit(None).cast("double").alias("p"))
    front = starts if starts is not None else edges.sparkSession.range(1, n + 1).withColumnRenamed("id", "walk_id")
    front = front.select("walk_id", *fate, F.lit(1).alias("step"), F.lit(int(origin)).cast("long").alias("v")).withColumn("trail", F.array(at))
    done, step = [], 1
    while True:
        for _ in range(every if most_steps is None else min(every, most_steps - step)):
            e = (first if step == 1 else table).select(*[F.col(c).alias("of") for c in fate], "src", "dst", F.col("w").alias("p"), "lo", "hi")
            meet = (F.col("v") == F.col("src")) & (F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))
            front = front.withColumn("u", uniform(seed, "walk_id", "step")).join(e, meet & (F.col("fate") == F.col("of")) if fate else meet, "left")
            moved = F.struct((F.col("step") + 1).alias("step"), F.col("dst").alias("v"), "p")
            trail = F.when(F.col("dst").isNull(), F.col("trail")).otherwise(F.concat("trail", F.array(moved)))
            front = front.select("walk_id", *fate, (F.col("step") + 1).alias("step"), F.col("dst").alias("v"), trail.alias("trail"))
            step += 1
        front = written(front, "walks")
        done.append(front.select("walk_id", F.explode("trail").alias("t")).select("walk_id", "t.*"))
        front = front.where("v is not null").withColumn("trail", F.array().cast(front.schema["trail"].dataType))
        if (most_steps is not None and step >= most_steps) or front.isEmpty():
            break
    steps = written(functools.reduce(DataFrame.unionByName, done), "walks")
    stats = steps.groupBy("walk_id").agg(F.count("*").alias("len"), F.exp(F.avg(F.log("p"))).alias("gprob"))
    return steps.select("walk_id", "step", "v"), stats


def tunnelling(edges: DataFrame, times: DataFrame, origin: int, n: int, beta: list[float], gamma: float = 1.0, seed: int = 1, every: int = 8) -> DataFrame:
    """(walk_id, step, v): walks that may move back in time (id, pt), one proposal for each beta.

    A proposal that isn't earlier than the present vertex is taken. An earlier one is taken if exp(-(lost(s) - lost(t)) / beta_i)
    exceeds a uniform, lost(y) = 1 - exp(-gamma * (m - y)), m the latest time proposed so far, refused ones too, 0 at first; at
    beta 0 never. A refused proposal leaves no step; a walk ends at a vertex without out-edges. Vertices without a time aren't
    proposed."""
    ts = times.where("pt is not null").select("id", F.col("pt").alias("to_t"))
    to = ts.withColumnRenamed("id", "dst")
    table = written(cumulative(edges.join(to, "dst", "left_semi")).join(to, "dst").repartition("src"), "edges")
    start = ts.where(F.col("id") == int(origin)).first()
    at = F.struct(F.col("step"), F.col("v"))
    front = edges.sparkSession.range(1, n + 1).select(F.col("id").alias("walk_id"), F.lit(1).alias("i"), F.lit(1).alias("step"), F.lit(int(origin)).cast("long").alias("v"), F.lit(start["to_t"] if start else 0.0).alias("t"), F.lit(0.0).alias("m")).withColumn("trail", F.array(at))
    empty, done = F.array().cast("array<struct<step:int,v:bigint>>"), []
    for i, b in enumerate(beta, 1):
        e = table.select("src", "dst", "to_t", "lo", "hi")
        front = front.withColumn("u", uniform(seed, "walk_id", "i")).join(e, (F.col("v") == F.col("src")) & (F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi")), "left")
        front = front.withColumn("m", F.greatest("m", "to_t"))
        lost = lambda y: 1 - F.exp(-gamma * (F.col("m") - F.col(y)))
        back = F.exp(-(lost("to_t") - lost("t")) / b) > uniform(seed + 1, "walk_id", "i") if b else F.lit(False)
        front = front.withColumn("take", F.col("dst").isNotNull() & ((F.col("to_t") >= F.col("t")) | back))
        moved = F.struct((F.col("step") + 1).alias("step"), F.col("dst").alias("v"))
        # without a proposal the walk is over: its vertex becomes null
        v = F.when(F.col("dst").isNotNull(), F.when(F.col("take"), F.col("dst")).otherwise(F.col("v")))
        front = front.select("walk_id", F.lit(i + 1).alias("i"), (F.col("step") + F.col("take").cast("int")).alias("step"), v.alias("v"), F.when(F.col("take"), F.col("to_t")).otherwise(F.col("t")).alias("t"), "m", F.when(F.col("take"), F.concat("trail", F.array(moved))).otherwise(F.col("trail")).alias("trail"))
        if i % every == 0 or i == len(beta):
            front = written(front, "front")
            done.append(front.select("walk_id", F.explode("trail").alias("s")).select("walk_id", "s.*"))
            front = front.where("v is not null").withColumn("trail", empty)
    return functools.reduce(DataFrame.unionByName, done) if done else front.select("walk_id", "step", "v")


def fates(edges: DataFrame) -> DataFrame:
    """(id): vertices without out-edges."""
    return edges.select(F.col("dst").alias("id")).distinct().join(edges.select(F.col("src").alias("id")).distinct(), "id", "left_anti")


def ancestors(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """(id): vertices from which a target (id) can be reached, the targets included; breadth first, written each round."""
    back = written(edges.select(F.col("dst").alias("id"), F.col("src").alias("up")).distinct(), "back")
    seen = front = written(targets.select("id").distinct(), "seen")
    while True:
        front = written(back.join(front, "id").select(F.col("up").alias("id")).distinct().join(seen, "id", "left_anti"), "front")
        if front.isEmpty():
            return seen
        seen = written(seen.unionByName(front), "seen")


def ancestors_of(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """(fate, id): for every target (id) the vertices from which it can be reached, itself included; one search for all."""
    back = written(edges.select(F.col("dst").alias("id"), F.col("src").alias("up")).distinct(), "back")
    seen = front = written(targets.select(F.col("id").alias("fate"), "id").distinct(), "seen")
    while True:
        front = written(back.join(front, "id").select("fate", F.col("up").alias("id")).distinct().join(seen, ["fate", "id"], "left_anti"), "front")
        if front.isEmpty():
            return seen
        seen = written(seen.unionByName(front), "seen")


def walks_to(edges: DataFrame, origin: int, targets: DataFrame, n: int, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """n walks to every target (id) that can be reached from the origin, simulated together, each on the subgraph of its target's
    ancestors with the weights renormalised there: the steps (fate, walk_id, step, v) and (walk_id, len, gprob). Targets in
    order of id take the walk ids n at a time."""
    a = ancestors_of(edges, targets)
    a = written(a.join(a.where(F.col("id") == int(origin)).select("fate"), "fate", "left_semi"), "ancestors")
    inside = edges.select("src", "dst", "w").join(a.withColumnRenamed("id", "src"), "src").join(a.withColumnRenamed("id", "dst"), ["fate", "dst"])
    ends = numbered(a.select("fate").distinct(), [], [F.col("fate")], "k")
    starts = written(ends.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(n)))).select(((F.col("k") - 1) * n + F.col("i")).alias("walk_id"), "fate"), "starts")
    steps, stats = simulate(inside, origin, n, seed, starts=starts)
    return starts.join(steps, "walk_id").select("fate", "walk_id", "step", "v"), stats


def select_walks(walks: DataFrame, chosen: DataFrame) -> DataFrame:
    return walks.join(chosen.select("walk_id").distinct(), "walk_id", "left_semi")


def contract(walks: DataFrame, clusters: DataFrame) -> DataFrame:
    """Vertices to clusters (id, cluster), equal consecutive clusters become one step; vertices without a cluster drop out."""
    c = walks.join(clusters.select(F.col("id").alias("v"), "cluster"), "v").where("cluster is not null")
    c = c.withColumn("before", F.lag("cluster").over(by_step())).where("before is null or before <> cluster")
    return c.select("walk_id", F.row_number().over(by_step()).alias("step"), F.col("cluster").alias("v"))


def remove_cycles(walks: DataFrame) -> DataFrame:
    """Loop erasure: for each vertex visited again everything after its first visit up to its last is cut, left to right; two
    adjacent equal vertices alone are no loop. If the tail vanishes the last vertex is put back."""
    by = Window.partitionBy("walk_id", "v")
    w = walks.withColumn("first", F.min("step").over(by)).withColumn("last", F.max("step").over(by))
    reach = F.when((F.col("step") == F.col("first")) & (F.col("last") > F.col("first") + 1), F.col("last"))
    w = w.withColumn("cut", F.max(reach).over(by_step().rowsBetween(Window.unboundedPreceding, -1)))
    w = w.withColumn("keep", F.coalesce(F.col("cut") < F.col("step"), F.lit(True)))
    kept = w.where("keep")
    ends = walks.groupBy("walk_id").agg(F.max_by("v", "step").alias("end"), F.max("step").alias("step"))
    tail = kept.groupBy("walk_id").agg(F.max_by("v", "step").alias("tail"))
    back = ends.join(tail, "walk_id").where("end <> tail").select("walk_id", "step", F.col("end").alias("v"))
    out = kept.select("walk_id", "step", "v").unionByName(back)
    return out.select("walk_id", F.row_number().over(by_step()).alias("step"), "v")


def termini(walks: DataFrame) -> DataFrame:
    return walks.groupBy("walk_id").agg(F.max_by("v", "step").alias("v"))


def add_terminus(walks: DataFrame, end: int) -> DataFrame:
    """Every walk that doesn't end there gets one more step at ``end``."""
    more = walks.groupBy("walk_id").agg(F.max_by("v", "step").alias("last"), (F.max("step") + 1).alias("step")).where(F.col("last") != end)
    return walks.select("walk_id", "step", "v").unionByName(more.select("walk_id", "step", F.lit(end).cast("long").alias("v")))


def pairs(walks: DataFrame) -> DataFrame:
    """(walk_id, step, src, dst) of consecutive vertices."""
    w = walks.withColumn("dst", F.lead("v").over(by_step())).where("dst is not null")
    return w.select("walk_id", "step", F.col("v").alias("src"), "dst")


def neighbourhood(walks: DataFrame, edges: DataFrame, factor: float = 1.0) -> DataFrame:
    """(walk_id, id): a walk's vertices, and of every position the graph neighbours over edges not longer than factor times the mean
    length of the path edges into and out of that position (the one there is at an end, or where the other isn't in the graph; a
    position with neither adds its vertex alone). Of several visits the one with the largest mean counts, as its neighbours
    include those of the others."""
    p = pairs(walks).join(edges.select("src", "dst", "w"), ["src", "dst"]).select("walk_id", "step", "src", "dst", "w")
    beside = p.select("walk_id", "step", F.col("src").alias("v"), "w").unionByName(p.select("walk_id", F.col("step") + 1, F.col("dst"), "w").toDF("walk_id", "step", "v", "w"))
    most = beside.groupBy("walk_id", "step", "v").agg((F.avg("w") * factor).alias("most")).groupBy("walk_id", "v").agg(F.max("most").alias("most"))
    near = most.join(edges.select(F.col("src").alias("v"), "dst", "w"), "v").where("w <= most").select("walk_id", F.col("dst").alias("id"))
    return near.unionByName(walks.select("walk_id", F.col("v").alias("id"))).distinct()


def kmers(walks: DataFrame, k: int) -> DataFrame:
    """(walk_id, step, kmer): every run of k consecutive vertices."""
    w = walks.withColumn("kmer", F.collect_list("v").over(by_step().rowsBetween(0, k - 1)))
    return w.where(F.size("kmer") == k).select("walk_id", "step", "kmer")


def covered_kmers(km: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b): distinct k-mers, every vertex of a being one of b's or a listed neighbour (src -> dst) of one. A k-mer that repeats a
    vertex is covered by none, as sets are compared with its length. Candidates meet on the first vertex of a."""
    d = written(km.select("kmer").distinct(), "kmers")
    reach = d.select(F.col("kmer").alias("b"), F.explode("kmer").alias("src"))
    near = reach.join(edges.select("src", "dst"), "src").select("b", "dst").unionByName(reach.select("b", F.col("src").alias("dst"))).distinct()
    a = d.where(F.size(F.array_distinct("kmer")) == F.size("kmer")).select(F.col("kmer").alias("a"))
    both = a.withColumn("dst", F.col("a")[0]).join(near, "dst").where("a <> b").select("a", "b")
    rest = both.select("a", "b", F.explode(F.slice("a", 2, F.greatest(F.size("a") - 1, F.lit(1)))).alias("dst")).join(near, ["b", "dst"])
    full = rest.groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") == F.size("a") - 1).select("a", "b")
    return full.unionByName(both.where(F.size("a") == 1))


def similar_kmers(km: DataFrame, edges: DataFrame, rule: str = "either") -> DataFrame:
    """(a, b): distinct k-mers that count as the same: the vertices of one, as a set, lie among the other's vertices and their
    neighbours, whichever way round (either, a < b), or those of a among b's (first, a and b in either order). Asking that each
    vertex of a is near one of b, or one of b's and near a, comes to the same as first, a vertex being near itself."""
    cover = covered_kmers(km, edges)
    if rule == "either":
        return cover.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    if rule == "first":
        return cover
    raise ValueError(f"unknown rule {rule}: either or first")


def kmer_nodes(km: DataFrame, edges: DataFrame) -> DataFrame:
    """(kmer): k-mers that are like none kept before them, in order of their first (walk_id, step).

    Each round keeps the undecided k-mers that have no undecided one like them before, and drops those like a kept one; the
    result is that of going through all in order, in as many rounds as the longest chain of dependent decisions."""
    order = km.groupBy("kmer").agg(F.min(F.struct("walk_id", "step")).alias("at"))
    like = similar_kmers(km, edges)
    both = like.unionByName(like.select(F.col("b").alias("a"), F.col("a").alias("b")))
    at = order.withColumnRenamed("kmer", "a")
    both = both.join(at, "a").join(at.select(F.col("a").alias("b"), F.col("at").alias("at_b")), "b").where("at_b < at").select("a", "b")
    before, open_, kept = written(both, "before"), written(order.select("kmer"), "open"), []
    while not open_.isEmpty():
        undecided = open_.withColumnRenamed("kmer", "b")
        waits = before.join(undecided, "b", "left_semi").select(F.col("a").alias("kmer")).distinct()
        new = written(open_.join(waits, "kmer", "left_anti"), "nodes")
        kept.append(new)
        out = before.join(new.withColumnRenamed("kmer", "b"), "b", "left_semi").select(F.col("a").alias("kmer")).distinct()
        open_ = written(open_.join(new, "kmer", "left_anti").join(out, "kmer", "left_anti"), "open")
    return functools.reduce(DataFrame.unionByName, kept) if kept else order.select("kmer")


def kmer_graph(km: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, n): transitions between consecutive k-mers of walks, each replaced by the first kept k-mer like it."""
    nodes = written(kmer_nodes(km, edges), "nodes")
    like = similar_kmers(km, edges)
    both = like.unionByName(like.select(F.col("b").alias("a"), F.col("a").alias("b")))
    at = km.groupBy("kmer").agg(F.min(F.struct("walk_id", "step")).alias("at")).join(nodes, "kmer", "left_semi")
    names = both.join(nodes.withColumnRenamed("kmer", "a"), "a", "left_anti").join(at.withColumnRenamed("kmer", "b"), "b").groupBy(F.col("a").alias("kmer")).agg(F.min_by("b", "at").alias("node"))
    named = km.join(names, "kmer", "left").select("walk_id", "step", F.coalesce("node", "kmer").alias("v"))
    p = named.withColumn("dst", F.lead("v").over(by_step())).where("dst is not null and dst <> v")
    return p.groupBy(F.col("v").alias("src"), "dst").agg(F.count("*").alias("n"))


def path_points(walks: DataFrame, points: DataFrame) -> DataFrame:
    return walks.join(points.select(F.col("id").alias("v"), "x"), "v").select("walk_id", F.row_number().over(by_step()).alias("step"), "v", "x")


def on_grid(walks: DataFrame, points: DataFrame, times: DataFrame, grid: int = 101) -> DataFrame:
    """(walk_id, g, x): each walk's coordinates interpolated linearly in pseudotime at g / (grid - 1) of its own range; ends are
    carried on."""
    p = walks.join(points.select(F.col("id").alias("v"), "x"), "v").join(times.select(F.col("id").alias("v"), "pt"), "v")
    p = p.groupBy("walk_id", "pt").agg(F.max_by("x", "step").alias("x"))
    w = Window.partitionBy("walk_id").orderBy("pt")
    p = p.withColumn("pt2", F.lead("pt").over(w)).withColumn("x2", F.lead("x").over(w)).withColumn("first", F.row_number().over(w) == 1)
    s = F.sequence(F.lit(0), F.lit(grid - 1))
    at = F.col("g") / (grid - 1)
    inside = (at >= F.when(F.col("first"), F.lit(float("-inf"))).otherwise(F.col("pt"))) & (at < F.coalesce("pt2", F.lit(float("inf"))))
    r = p.withColumn("g", F.explode(s)).where(inside)
    f = F.when(F.col("pt2").isNull() | (at <= F.col("pt")), F.lit(0.0)).otherwise((at - F.col("pt")) / (F.col("pt2") - F.col("pt")))
    x = F.when(f == 0.0, F.col("x")).otherwise(F.zip_with("x", "x2", lambda a, b: a + (b - a) * F.col("f")))
    return r.withColumn("f", f).select("walk_id", "g", x.alias("x"))


#: Walks of a block of the distance matrix.
WALK_BLOCK = 256


def path_distances(gridded: DataFrame, metric: str = "max", end_penalty: float = 0.0) -> DataFrame:
    """(a, b, dist) of all pairs of the walks given, a < b, the walks being on one grid. Over all coordinates of all grid positions
    the largest absolute difference (max), the sum of absolute differences (sum), the root of the sum of squares (euclid) or
    the absolute value of the plain sum (abs_sum); plus end_penalty times the same of the last position (for abs_sum the
    Euclidean distance there). The result is itself a pairwise matrix, computed in blocks of WALK_BLOCK walks."""
    if metric not in ("max", "sum", "euclid", "abs_sum"):
        raise ValueError(f"unknown metric {metric}")
    flat = gridded.groupBy("walk_id").agg(F.array_sort(F.collect_list(F.struct("g", "x"))).alias("s"))  # a grid of points
    flat = flat.select("walk_id", F.flatten(F.transform("s", lambda p: p["x"])).alias("x"), F.size(F.element_at("s", -1)["x"]).alias("dim"))
    flat = written(flat, "flat")
    blocks = max(1, -(-flat.count() // WALK_BLOCK))
    every = F.sequence(F.lit(0), F.lit(blocks - 1))
    own = F.pmod(F.xxhash64("walk_id"), F.lit(blocks)).cast("int")
    left = flat.withColumn("p", own).withColumn("q", F.explode(every))
    right = flat.select(F.col("walk_id").alias("other"), F.col("x").alias("y"), own.alias("q_")).withColumn("p_", F.explode(every))

    def total(d, axis):
        if metric == "max":
            return np.abs(d).max(axis)
        if metric == "sum":
            return np.abs(d).sum(axis)
        return np.sqrt((d * d).sum(axis))

    def run(s, t):
        none = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "dist": pa.array([], pa.float64())})
        if not s.num_rows or not t.num_rows:
            return none
        a, b, x, y, dim = s.column("walk_id").to_numpy(), t.column("other").to_numpy(), matrix(s.column("x")), matrix(t.column("y")), s.column("dim")[0].as_py()
        out = [none]
        for i in range(len(a)):
            later = np.nonzero(b > a[i])[0]
            d = x[i][None] - y[later]
            whole = np.abs(d.sum(1)) if metric == "abs_sum" else total(d, 1)
            dist = whole + end_penalty * total(d[:, -dim:], 1) if len(later) else whole
            out.append(pa.table({"a": np.full(len(later), a[i]), "b": b[later], "dist": dist}))
        return pa.concat_tables(out)

    return left.groupBy("p", "q").cogroup(right.groupBy("p_", "q_")).applyInArrow(run, "a long, b long, dist double")


def resample(walks: DataFrame, points: DataFrame, coef: float) -> DataFrame:
    """(walk_id, step, k, x): each segment in round(coef * length) equal parts, and the last point."""
    p = path_points(walks, points)
    p = p.withColumn("x2", F.lead("x").over(by_step()))
    length = F.sqrt(F.aggregate(F.zip_with("x", "x2", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
    p = p.withColumn("parts", F.when(F.col("x2").isNull(), 1).otherwise(F.greatest(F.lit(1), F.round(coef * length).cast("int"))))
    p = p.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    x = F.when(F.col("x2").isNull(), F.col("x")).otherwise(F.zip_with("x", "x2", lambda a, b: a + (b - a) * F.col("k") / F.col("parts")))
    return p.select("walk_id", "step", "k", x.alias("x"))


def _spline(y: np.ndarray, n: int) -> np.ndarray:
    """Cubic spline through equally spaced rows (end slopes from cubics through the first and last four points), at n places."""
    m = len(y)
    if m < 4:
        at = np.linspace(0, m - 1, n)
        return np.stack([np.interp(at, np.arange(m), y[:, c]) for c in range(y.shape[1])], 1)
    a, b = np.zeros((m, m)), np.zeros_like(y)
    for i in range(1, m - 1):
        a[i, i - 1 : i + 2] = 1, 4, 1
        b[i] = 3 * (y[i + 1] - y[i - 1])
    a[0, 0] = a[-1, -1] = 1
    b[0] = (-11 * y[0] + 18 * y[1] - 9 * y[2] + 2 * y[3]) / 6
    b[-1] = (11 * y[-1] - 18 * y[-2] + 9 * y[-3] - 2 * y[-4]) / 6
    s = np.linalg.solve(a, b)
    at = np.linspace(0, m - 1, n)
    i = np.minimum(at.astype(int), m - 2)
    t = (at - i)[:, None]
    return (2 * t**3 - 3 * t**2 + 1) * y[i] + (t**3 - 2 * t**2 + t) * s[i] + (3 * t**2 - 2 * t**3) * y[i + 1] + (t**3 - t**2) * s[i + 1]


def smooth(paths: DataFrame, dim: int, factor: int = 3, n: int | None = None) -> DataFrame:
    """(walk_id, step, x): spline with ``factor`` times the points, resampled evenly along the steps to n if that is given."""

    def run(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("step")
        y = np.array(t["x"].tolist(), float)
        fine = _spline(y, factor * len(y))
        m = n or len(fine)
        at = np.linspace(0, len(fine) - 1, m)
        out = np.stack([np.interp(at, np.arange(len(fine)), fine[:, c]) for c in range(y.shape[1])], 1)
        return pd.DataFrame({"walk_id": t["walk_id"].iloc[0], "step": np.arange(1, m + 1), "x": out.tolist()})

    return paths.groupBy("walk_id").applyInPandas(run, "walk_id long, step int, x array<double>")


def consensus(paths: DataFrame, classes: DataFrame, dim: int, n: int | None = None) -> DataFrame:
    """(class, step, x): mean of the smoothed paths of each class (walk_id, class) at n equal positions, three times as many as the
    longest walk of the class has steps if no number is given."""
    sizes = paths.groupBy("walk_id").agg(F.count("*").alias("len")).join(classes.select("walk_id", "class"), "walk_id")
    goal = sizes.groupBy("class").agg((F.max("len") * 3).alias("n"))
    fine = smooth(paths, dim).join(classes.select("walk_id", "class"), "walk_id").join(goal, "class").withColumn("n", F.lit(n).cast("long") if n else F.col("n"))
    # resampled where the spline's points lie on either side of a position
    fine = fine.withColumn("m", F.max("step").over(Window.partitionBy("class", "walk_id"))).withColumn("x2", F.lead("x").over(Window.partitionBy("class", "walk_id").orderBy("step")))
    scale = (F.col("n") - 1) / F.greatest(F.col("m") - 1, F.lit(1))
    first = F.ceil((F.col("step") - 1) * scale - 1e-9).cast("long")
    last = F.when(F.col("x2").isNull(), F.col("n") - 1).otherwise(F.ceil(F.col("step") * scale - 1e-9).cast("long") - 1)
    fine = fine.where(first <= last).withColumn("k", F.explode(F.sequence(first, last)))
    f = F.col("k") / scale - (F.col("step") - 1)
    x = F.when(F.col("x2").isNull(), F.col("x")).otherwise(F.zip_with("x", "x2", lambda a, b: a + (b - a) * F.col("f")))
    at = fine.withColumn("f", F.greatest(f, F.lit(0.0))).select("class", (F.col("k") + 1).cast("int").alias("step"), x.alias("x"))
    return avg_vector(at, ["class", "step"], dim)


def pathways(walks: DataFrame, classes: DataFrame) -> DataFrame:
    """Walks beside their class (walk_id, class)."""
    return walks.join(classes.select("walk_id", "class"), "walk_id").select("class", "walk_id", "step", "v")


def index_edges(walks: DataFrame, simplices: DataFrame) -> DataFrame:
    """(walk_id, step, sidx): the edge simplex (sidx, verts) of every step that has one."""
    e = simplices.where(F.size("verts") == 2).select("sidx", F.col("verts")[0].alias("a"), F.col("verts")[1].alias("b"))
    p = pairs(walks).withColumn("a", F.least("src", "dst")).withColumn("b", F.greatest("src", "dst"))
    return p.join(e, ["a", "b"]).select("walk_id", "step", "sidx")


def reachability(edges: DataFrame, waypoints: DataFrame) -> DataFrame:
    """(a, b), a < b: waypoints (id) of which one can be reached from the other along edges; frontiers of (start, vertex), written
    each round until there is none."""
    e = written(edges.select("src", "dst").distinct(), "edges")
    seen = front = written(waypoints.select(F.col("id").alias("start"), F.col("id").alias("src")), "seen")
    while True:
        front = written(front.join(e, "src").select("start", F.col("dst").alias("src")).distinct().join(seen, ["start", "src"], "left_anti"), "front")
        if front.isEmpty():
            break
        seen = written(seen.unionByName(front), "seen")
    ways = waypoints.select(F.col("id").alias("src"))
    return seen.join(ways, "src").where("start <> src").select(F.least("start", "src").alias("a"), F.greatest("start", "src").alias("b")).distinct()
