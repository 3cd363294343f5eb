"""Problem 6: collapse runs of identical or nearly identical consecutive events into one event with count and duration.

The current steps are sorted by (walk_id, step) into range partitions of even size, whatever the length of a walk. The
dissimilarity of consecutive vertices is 0 for the same vertex, their distance where both points are usable and near, and
unbounded otherwise; distances are computed once per distinct vertex pair, and only for pairs that a projection onto a few
channels leaves possible. Every walk is then cut by dynamic programming with pruning: least dissimilarity inside runs plus a
penalty per run.

* ``collapse``: dissimilarity of neighbours, penalty radius^2, the setting in which near-identical means near the one before. Runs
  that meet at a partition border are joined after; the costs are sums over neighbours, so the joined cut is optimal.
* ``mean_runs``: dissimilarity to the run's mean, penalty radius^2 / 2. A run can't drift away from its representative.

Defined cases: of several rows of a step the latest logged_at counts (null is oldest; ties by content); rows with null
walk_id or step are dropped, steps whose current v is null are dropped and don't separate; missing numbers don't separate; an
unusable point is near itself only; a walk of one row is one run of duration 0; the duration is null where a bounding
visited_at is null; an empty table gives no rows.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import running_sum
from .common import matrix, materialize, small_side, usable_points

RADIUS = 0.4
#: Channels that the first, compact comparison uses.
SKETCH = 8
RUNS = "walk_id long, first_step int, last_step int, n_steps long, first_at long, last_at long, first_v long, part int, at_start boolean, at_end boolean, joins boolean"


class Chain:
    """Dissimilarity within a run: the sum of squared dissimilarities of neighbours. Its optimum joins neighbours where that of the two
    alone does not exceed the penalty, so p6_found, whose definition asks about neighbours only, is this programme's result."""

    def __init__(self, d2: np.ndarray):
        self.upto = np.r_[0.0, np.cumsum(np.r_[0.0, d2[1:]])]

    def __call__(self, starts: np.ndarray, t: int) -> np.ndarray:
        return self.upto[t] - self.upto[starts + 1]


class Mean:
    """Dissimilarity within a run: the sum of squared distances to the run's mean, its representative, each row counting ``weight``
    times. A slow drift, whose neighbours are all near, is cut where the ends differ too much from their mean."""

    def __init__(self, x: np.ndarray, weight: np.ndarray):
        x = x - x.mean(0)  # sums of squares then don't cancel
        self.n, self.s = np.r_[0.0, np.cumsum(weight)], np.vstack([np.zeros(x.shape[1]), np.cumsum(x * weight[:, None], 0)])
        self.q = np.r_[0.0, np.cumsum((x * x).sum(1) * weight)]

    def __call__(self, starts: np.ndarray, t: int) -> np.ndarray:
        n, s = self.n[t] - self.n[starts], self.s[t] - self.s[starts]
        return np.maximum(self.q[t] - self.q[starts] - (s * s).sum(1) / n, 0.0)


def segment(n: int, cost, penalty: float) -> list[int]:
    """Starts of the runs of n rows: least sum of cost(start, end) over runs plus ``penalty`` per run.

    best[t] = min over s < t of best[s] + cost(s, t) + penalty. A start s is pruned for good as soon as best[s] + cost(s, t) exceeds
    best[t], since the cost of a run is no less than that of its two parts. Ties go to the earlier start: the longer run."""
    best, back, alive = np.zeros(n + 1), np.zeros(n + 1, np.int64), np.zeros(1, np.int64)
    for t in range(1, n + 1):
        c = best[alive] + cost(alive, t)
        i = int(c.argmin())
        best[t], back[t] = c[i] + penalty, alive[i]
        alive = np.r_[alive[c <= best[t] + 1e-12], t]
    cuts, t = [], n
    while t > 0:
        t = int(back[t])
        cuts.append(t)
    return cuts[::-1]


def current_steps(walks: DataFrame) -> DataFrame:
    kind = walks.schema["logged_at"].dataType
    order = F.struct(F.coalesce("logged_at", F.lit("0001-01-01").cast("timestamp_ntz").cast(kind)), F.xxhash64("v", "visited_at"))
    cur = walks.where("walk_id is not null and step is not null").groupBy("walk_id", "step").agg(F.max_by(F.struct("v", F.unix_micros(F.col("visited_at").cast("timestamp")).alias("at")), order).alias("r"))
    return cur.select("walk_id", "step", "r.v", "r.at").where("v is not null")


def ordered_steps(steps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(part, row, walk_id, step, v, at, pv): steps in order, with the v before within the walk; and the border rows' links.

    The first row of a partition finds its predecessor among the last rows of the partitions, one per partition.
    """

    def number(batches):
        part, row, last = TaskContext.get().partitionId(), 0, None
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            w, v = b.column(0).to_numpy(), b.column(2).to_numpy()
            before_w, before_v = np.r_[last[0] if last else w[0], w[:-1]], np.r_[last[1] if last else 0, v[:-1]]
            same = before_w == w
            if last is None:
                same[0] = False
            last = (w[-1], v[-1])
            pv = pa.array(before_v, mask=~same)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array(np.arange(row, row + n)), *b.columns, pv], ["part", "row", *b.schema.names, "pv"])
            row += n

    sorted_ = steps.repartitionByRange("walk_id", "step").sortWithinPartitions("walk_id", "step")
    rows = materialize(sorted_.mapInArrow(number, "part int, row long, walk_id long, step int, v long, at long, pv long"), "steps")
    ends = rows.groupBy("part").agg(F.max_by(F.struct("walk_id", "v"), "row").alias("last"), F.min_by(F.struct("walk_id", "v"), "row").alias("first")).orderBy("part").collect()  # one row per partition
    links = [(b["part"], a["last"]["v"]) for a, b in zip(ends, ends[1:]) if a["last"]["walk_id"] == b["first"]["walk_id"]]
    border = rows.sparkSession.createDataFrame(links, "part int, bv long").withColumn("row", F.lit(0).cast("long"))
    rows = rows.join(F.broadcast(border), ["part", "row"], "left").withColumn("pv", F.coalesce("pv", "bv")).drop("bv")
    return rows, border


def near_pairs_of(rows: DataFrame, points: DataFrame, radius: float) -> DataFrame:
    """(pv, v, d2) of the distinct consecutive pairs of different vertices whose points lie within the radius."""
    pairs = rows.where("pv is not null and pv <> v").select("pv", "v").distinct()
    cut = radius * radius + 1e-4
    q = [F.col("x")[i].cast("float") for i in range(SKETCH)]
    sketch = points.select("id", F.array(*q).alias("q"))
    one = pairs.join(sketch.select(F.col("id").alias("pv"), F.col("q").alias("qa")), "pv")
    two = one.join(sketch.select(F.col("id").alias("v"), F.col("q").alias("qb")), "v")
    gap = sum(((F.col("qa")[i] - F.col("qb")[i]) * (F.col("qa")[i] - F.col("qb")[i]) for i in range(1, SKETCH)), (F.col("qa")[0] - F.col("qb")[0]) * (F.col("qa")[0] - F.col("qb")[0]))
    # float32 rounding of large coordinates widens the bound
    size = F.array_max(F.transform(F.concat("qa", "qb"), F.abs)) * 1e-6
    maybe = materialize(two.where(gap <= cut + size * (size + 1.0)).select("pv", "v"), "maybe")
    full = points.select("id", "x")
    both = maybe.join(full.select(F.col("id").alias("pv"), F.col("x").alias("a")), "pv").join(full.select(F.col("id").alias("v"), F.col("x").alias("b")), "v")
    d2 = F.aggregate(F.zip_with("a", "b", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d)
    return both.select("pv", "v", d2.alias("d2")).where(F.sqrt("d2") <= radius)


def collapse(walks: DataFrame, points: DataFrame, radius: float = RADIUS) -> DataFrame:
    """(walk_id, first_step, last_step, n_steps, v, seconds): every current step in exactly one run, in order."""
    rows, _ = ordered_steps(current_steps(walks))
    near, _ = small_side(near_pairs_of(rows, points.select("id", "x"), radius))
    rows = rows.join(near, ["pv", "v"], "left")
    rows = rows.withColumn("d2", F.when(F.col("pv").isNull(), None).when(F.col("pv") == F.col("v"), 0.0).otherwise(F.coalesce("d2", F.lit(float("inf")))))
    # range partitions of even size again; whatever they are, links to the row before are known
    rows = rows.select("walk_id", "step", "v", "at", "d2").repartitionByRange("walk_id", "step").sortWithinPartitions("walk_id", "step")
    penalty = radius * radius * (1 + 1e-12)

    def cut(batches):
        """Runs of the stretches of a task's rows. A stretch begins where a row can't belong with the one before; one that goes on over
        batches is held in pieces until it ends."""
        part, held, first = TaskContext.get().partitionId(), [], True
        names = [c.split()[0] for c in RUNS.split(", ")]

        def runs(cols, at_start, at_end):
            w, step, v, at, d2 = cols
            n = len(w)
            near = d2 <= penalty * 4
            near[0] = False
            start = np.ones(n, bool)
            inner = np.nonzero(near)[0]
            if len(inner):
                begins = inner[np.r_[True, np.diff(inner) > 1]] - 1
                ends = np.r_[inner[:-1][np.diff(inner) > 1], inner[-1]] + 1
                for s, e in zip(begins, ends):
                    start[s + 1 : e] = False
                    start[s + np.array(segment(e - s, Chain(d2[s:e]), penalty))] = True
            a = np.nonzero(start)[0]
            z = np.r_[a[1:], n] - 1
            one, last = np.zeros(len(a), bool), np.zeros(len(a), bool)
            one[0], last[-1] = at_start, at_end
            joins = one & (d2[a] <= penalty)
            return pa.RecordBatch.from_arrays(
                [pa.array(w[a]), pa.array(step[a]), pa.array(step[z]), pa.array((z - a + 1).astype(np.int64)), pa.array(at[a], from_pandas=True).cast(pa.int64()), pa.array(at[z], from_pandas=True).cast(pa.int64()), pa.array(v[a]), pa.array(np.full(len(a), part, np.int32)), pa.array(one), pa.array(last), pa.array(joins)],
                names,
            )

        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            cols[3], cols[4] = cols[3].astype(float), cols[4].astype(float)  # null at the start of a walk becomes NaN: never near
            breaks = np.nonzero(~(cols[4] <= penalty * 4))[0]
            if not len(breaks):
                held.append(cols)
                continue
            if held or breaks[0]:
                held.append([c[: breaks[0]] for c in cols])
            s = breaks[-1]  # the last stretch may go on
            whole = [np.concatenate(c) for c in zip(*held, [c[breaks[0] : s] for c in cols])] if held else [c[:s] for c in cols]
            if len(whole[0]):
                yield runs(whole, first, False)
                first = False
            held = [[c[s:] for c in cols]]
        if held:
            yield runs([np.concatenate(c) for c in zip(*held)], first, True)

    runs = materialize(rows.mapInArrow(cut, RUNS), "runs")
    # at most two runs of a partition touch its borders; those that belong together across borders are added up
    border = runs.where("at_start or at_end").collect()
    border.sort(key=lambda r: (r["part"], not r["at_start"]))
    merged: list[list] = []
    for r in border:
        if r["joins"] and merged and merged[-1][0] == r["walk_id"]:
            m = merged[-1]
            m[2], m[3], m[5] = r["last_step"], m[3] + r["n_steps"], r["last_at"]
        else:
            merged.append([r["walk_id"], r["first_step"], r["last_step"], r["n_steps"], r["first_at"], r["last_at"], r["first_v"]])
    names = ["walk_id", "first_step", "last_step", "n_steps", "first_at", "last_at", "first_v"]
    joined = runs.sparkSession.createDataFrame(merged, "walk_id long, first_step int, last_step int, n_steps long, first_at long, last_at long, first_v long")
    every = runs.where("not (at_start or at_end)").select(*names).unionByName(joined)
    return every.select("walk_id", "first_step", "last_step", "n_steps", F.col("first_v").alias("v"), ((F.col("last_at") - F.col("first_at")) / 1e6).alias("seconds"))


def mean_runs(walks: DataFrame, points: DataFrame, radius: float = RADIUS) -> DataFrame:
    """(walk_id, first_step, last_step, n_steps, v, seconds): runs whose rows lie near the run's mean: least sum of squared distances to
    the means plus radius^2 / 2 per run, so that two rows alone are joined up to the radius.

    No best cut has neighbours in one run whose squared distance exceeds 6 penalties: taking both out costs 3 more runs and saves half
    of it at least. Between such neighbours, stretches are independent, and equal neighbours, which no best cut parts, are one
    weighted row; a stretch of such rows is what a task holds. An unusable point is near itself only."""
    penalty = radius * radius / 2
    points = points.select("id", "x")
    rows, _ = ordered_steps(current_steps(walks))
    near, _ = small_side(near_pairs_of(rows, points, math.sqrt(6 * penalty)).select("pv", "v"))
    near = near.withColumn("near", F.lit(True))
    rows = rows.select("walk_id", "step", "v", "at", "pv").join(near, ["pv", "v"], "left")
    same = F.coalesce(F.col("pv") == F.col("v"), F.lit(False))
    rows = rows.withColumn("fold", F.when(same, 0).otherwise(1)).withColumn("cut", F.when(same | F.col("near"), 0).otherwise(1))
    numbered = running_sum(rows.select("walk_id", "step", "v", "at", "cut", "fold"), [], [F.col("walk_id"), F.col("step")], "fold", "dwell")
    at = F.struct("step", "at")
    dwell = numbered.groupBy("walk_id", "dwell").agg(F.min(at).alias("a"), F.max(at).alias("z"), F.count("*").alias("n"), F.min_by("v", "step").alias("v"), F.max("cut").alias("cut"))
    dwell = running_sum(dwell.select("walk_id", F.col("a.step").alias("first_step"), F.col("z.step").alias("last_step"), F.col("a.at").alias("first_at"), F.col("z.at").alias("last_at"), "n", "v", "cut"), [], [F.col("walk_id"), F.col("first_step")], "cut", "stretch")
    dwell = materialize(dwell, "dwell")
    many = dwell.groupBy("stretch").agg(F.count("*").alias("rows")).where("rows > 1").select("stretch")
    alone = dwell.join(many, "stretch", "left_anti")
    both = dwell.join(many, "stretch").join(points.withColumnRenamed("id", "v"), "v")
    names = ["walk_id", "first_step", "last_step", "n_steps", "first_at", "last_at", "v"]

    def cut(t):
        t = t.sort_by("first_step")
        n = t.column("n").to_numpy()
        a = np.array(segment(len(n), Mean(matrix(t.column("x"), len(t.column("x")[0])), n.astype(float)), penalty))
        z = np.r_[a[1:], len(n)] - 1
        first, last = t.take(pa.array(a)), t.take(pa.array(z))
        return pa.table([first.column("walk_id"), first.column("first_step"), last.column("last_step"), pa.array(np.add.reduceat(n, a)), first.column("first_at"), last.column("last_at"), first.column("v")], names=names)

    done = both.groupBy("stretch").applyInArrow(cut, "walk_id long, first_step int, last_step int, n_steps long, first_at long, last_at long, v long")
    every = done.unionByName(alone.select("walk_id", "first_step", "last_step", F.col("n").alias("n_steps"), "first_at", "last_at", "v"))
    return every.select("walk_id", "first_step", "last_step", "n_steps", "v", ((F.col("last_at") - F.col("first_at")) / 1e6).alias("seconds"))


def p6_segments(spark, d: str) -> DataFrame:
    return mean_runs(spark.read.parquet(f"{d}/walks.parquet"), usable_points(spark.read.parquet(f"{d}/points.parquet")))


def p6_runs(spark, d: str) -> DataFrame:
    return collapse(spark.read.parquet(f"{d}/walks.parquet"), usable_points(spark.read.parquet(f"{d}/points.parquet")))


def p6_found(spark, d: str) -> DataFrame:
    return p6_runs(spark, d).where("n_steps >= 2").select("walk_id", "first_step", "last_step", F.col("n_steps").cast("int").alias("n_steps"))
