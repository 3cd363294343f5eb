"""Homology over two elements of landmark complexes, and walks as cycles in them.

Reducing a boundary matrix is sequential by nature; a landmark complex is small by construction and stands in one task. The
reduced matrix then travels with the tasks that represent walks.
"""
from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import numbered
from ..functions.scalars import with_scalars
from ..sources.shared import written
from .walks import pairs

#: Simplices up to which a complex is reduced.
MAX_SIMPLICES = 5_000_000
REDUCED = "col int, low int, dim int, entries array<int>"


def reduce_columns(columns: dict[int, set[int]], dims: dict[int, int]) -> dict[int, set[int]]:
    """Nonempty reduced columns. Higher dimensions go first, and a column that is the low of another is cleared unread."""
    out: dict[int, set[int]] = {}
    low_of: dict[int, int] = {}
    for dim in sorted(set(dims.values()), reverse=True):
        for j in sorted(c for c in columns if dims[c] == dim):
            if j in low_of:
                continue
            col = set(columns[j])
            while col and (p := low_of.get(max(col))) is not None:
                col ^= out[p]
            if col:
                out[j] = col
                low_of[max(col)] = j
    return out


def reduce_boundary(boundary: DataFrame) -> DataFrame:
    """(col, low, dim, entries) of the nonempty reduced columns of boundary (sidx, dim, faces); dim is that of the class born,
    one less than the column's simplex."""

    def run(t: pd.DataFrame) -> pd.DataFrame:
        if len(t) > MAX_SIMPLICES:
            raise ValueError(f"more than {MAX_SIMPLICES} simplices")
        dims = dict(zip(t["sidx"], t["dim"]))
        got = reduce_columns({s: set(map(int, f)) for s, f in zip(t["sidx"], t["faces"]) if len(f)}, {s: d for s, d in dims.items() if d > 0})
        return pd.DataFrame({"col": list(got), "low": [max(v) for v in got.values()], "dim": [dims[c] - 1 for c in got], "entries": pd.Series([sorted(v) for v in got.values()], dtype=object)})

    return boundary.groupBy(F.lit(0).alias("one")).applyInPandas(run, REDUCED)


def pairs_of(reduced: DataFrame, simplices: DataFrame, zero: bool = False) -> DataFrame:
    """(dim, birth_idx, death_idx, birth, death) of classes that live for some time (all of them with ``zero``)."""
    s = simplices.select("sidx", "value")
    p = reduced.join(s.select(F.col("sidx").alias("low"), F.col("value").alias("birth")), "low").join(s.select(F.col("sidx").alias("col"), F.col("value").alias("death")), "col")
    p = p.select("dim", F.col("low").alias("birth_idx"), F.col("col").alias("death_idx"), "birth", "death")
    return p if zero else p.where("birth <> death")


def essential(reduced: DataFrame, simplices: DataFrame) -> DataFrame:
    """(dim, sidx, birth): simplices that neither kill nor are killed."""
    used = reduced.select(F.col("col").alias("sidx")).union(reduced.select("low"))
    return simplices.join(used, "sidx", "left_anti").select("dim", "sidx", F.col("value").alias("birth"))


def with_essential(finite: DataFrame, infinite: DataFrame) -> DataFrame:
    """Essential classes get places beyond the finite ones, in order of (birth, sidx): deaths spread evenly from m to m + (m - l) / 2,
    m and l being 1.01 times the largest and the least finite death; births such that death / birth is 1.5 times the largest
    finite ratio (0 if a finite birth is 0). Without finite classes deaths are 1.01 and ratios 1.5."""
    at = finite.agg(F.coalesce(1.01 * F.max("death"), F.lit(1.01)).alias("m"), F.coalesce(1.01 * F.min("death"), F.lit(1.01)).alias("l"), F.min("birth").alias("least"), F.max(F.try_divide("death", "birth")).alias("r"))
    e = numbered(with_scalars(infinite.select("dim", "sidx", "birth"), at), [], [F.col("birth"), F.col("sidx")], "n")
    e = with_scalars(e, infinite.agg(F.count("*").alias("of")))
    death = F.col("m") + 0.5 * (F.col("m") - F.col("l")) * F.coalesce(F.try_divide(F.col("n") - 1, F.col("of") - 1), F.lit(0.0))
    birth = F.when(F.col("least") <= 0, 0.0).otherwise(death / (1.5 * F.coalesce("r", F.lit(1.0))))
    rows = e.select("dim", F.col("sidx").alias("birth_idx"), F.lit(None).cast("int").alias("death_idx"), birth.alias("birth"), death.alias("death"))
    return finite.unionByName(rows)


def diagram(classes: DataFrame, ratio: bool = False, death_on_x: bool = False) -> DataFrame:
    """(dim, birth_idx, death_idx, x, y): x the death or the middle, y the ratio or half the difference; positive dimensions."""
    x = F.col("death") if death_on_x else (F.col("birth") + F.col("death")) / 2
    y = F.try_divide("death", "birth") if ratio else (F.col("death") - F.col("birth")) / 2
    return classes.where("dim > 0").select("dim", "birth_idx", "death_idx", x.alias("x"), y.alias("y"))


def chain_sum(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Symmetric difference of two chains (keys..., e)."""
    both = first.select(*keys, "e").unionByName(second.select(*keys, "e"))
    return both.groupBy(*keys, "e").agg(F.count("*").alias("n")).where("n % 2 = 1").select(*keys, "e")


def is_cycle(chains: DataFrame, boundary: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., cycle): whether the boundary of each chain (keys..., e) vanishes."""
    f = chains.join(boundary.select(F.col("sidx").alias("e"), F.explode("faces").alias("f")), "e").groupBy(*keys, "f").agg((F.count("*") % 2).alias("odd"))
    return f.groupBy(*keys).agg((F.max("odd") == 0).alias("cycle"))


def shortest_path(near: dict, a: int, b: int) -> list[int] | None:
    dist, back, heap = {a: 0.0}, {}, [(0.0, a)]
    while heap:
        d, u = heapq.heappop(heap)
        if u == b:
            path = [b]
            while path[-1] != a:
                path.append(back[path[-1]])
            return path[::-1]
        if d > dist[u]:
            continue
        for v, w in near.get(u, ()):
            if d + w < dist.get(v, np.inf):
                dist[v], back[v] = d + w, u
                heapq.heappush(heap, (d + w, v))
    return None


def triangulate(walks: DataFrame, simplices: DataFrame, landmarks: DataFrame) -> DataFrame:
    """(walk_id, e): edge simplices of every walk over landmarks, a step without its edge going by the shortest path; edges
    passed an even number of times cancel. Distinct steps are looked up once."""
    from .complexes import landmark_coordinates

    ids, x = landmark_coordinates(landmarks)
    at = dict(zip(ids.tolist(), x))
    t = simplices.where("dim = 1").select("sidx", "verts").toArrow()
    edge, near = {}, {}
    for s, (a, b) in zip(t.column("sidx").to_pylist(), t.column("verts").to_pylist()):
        edge[a, b] = edge[b, a] = s
        w = float(np.sqrt(((at[a] - at[b]) ** 2).sum()))
        near.setdefault(a, []).append((b, w))
        near.setdefault(b, []).append((a, w))

    def ways(batches):
        for b in batches:
            rows = []
            for u, v in zip(b["src"], b["dst"]):
                path = [u, v] if (u, v) in edge else shortest_path(near, u, v)
                rows += [(u, v, edge[p]) for p in zip(path or [], (path or [])[1:])]
            yield pd.DataFrame(rows, columns=["src", "dst", "e"])

    steps = pairs(walks)
    found = steps.select("src", "dst").distinct().mapInPandas(ways, "src long, dst long, e int")
    return steps.join(found, ["src", "dst"]).groupBy("walk_id", "e").agg(F.count("*").alias("n")).where("n % 2 = 1").select("walk_id", "e")


def cycles_against(chains: DataFrame, reference: int) -> DataFrame:
    """(walk_id, e): every walk's chain plus that of the reference walk, modulo two. The edges of a walk are bounded by those of the
    complex, so a chain is one array and the reference's chain a constant."""
    ref = chains.where(F.col("walk_id") == reference).agg(F.collect_set("e").alias("ref"))
    own = with_scalars(chains.where(F.col("walk_id") != reference).groupBy("walk_id").agg(F.collect_set("e").alias("own")), ref)
    both = F.concat(F.array_except("own", "ref"), F.array_except("ref", "own"))
    return own.select("walk_id", F.explode(both).alias("e"))


class Representation:
    """Cycles as sums of reduced columns. Where no column ends at the largest entry, the entry starts an essential class: it is
    noted as -entry and kept as a column of its own, so that later cycles of the same class are told by the same name."""

    def __init__(self, reduced: pd.DataFrame):
        self.by_low = {int(low): (int(c), set(map(int, e))) for c, low, e in zip(reduced["col"], reduced["low"], reduced["entries"])}
        self.new: dict[int, set[int]] = {}

    def go_on(self, cycle: set[int], out: list[int]) -> set[int]:
        """Reduces until nothing is left, or until the largest entry is an essential class not yet known: what is left then."""
        cycle = set(cycle)
        while cycle:
            low = max(cycle)
            if low in self.by_low:
                col, entries = self.by_low[low]
                cycle ^= entries
                out.append(col)
            elif low in self.new:
                cycle ^= self.new[low]
                out.append(-low)
            else:
                break
        return cycle

    def of(self, cycle: set[int], update: bool = True) -> list[int]:
        out: list[int] = []
        left = self.go_on(cycle, out)
        if left:
            out.append(-max(left))
            if update:
                self.new[max(left)] = left
        return sorted(out)


def represent(cycles: DataFrame, reduced: DataFrame) -> DataFrame:
    """(walk_id, classes): every cycle in terms of reduced columns and essential classes, as if they were taken in order of walk_id and
    each named the essential classes it met first.

    Distinct cycles are reduced in parallel as far as the known classes reach; of those that stop the one of the smallest walk names
    its class, and the rest go on: a round for every essential class met, whose number the complex bounds."""
    r = Representation(reduced.toPandas())
    each = written(cycles.groupBy("walk_id").agg(F.array_sort(F.collect_set("e")).alias("cycle")), "cycles")  # edges of the complex
    state = each.groupBy("cycle").agg(F.min("walk_id").alias("walk_id")).select("cycle", "walk_id", F.array().cast("array<int>").alias("found"), F.col("cycle").alias("left"))
    schema = "cycle array<int>, walk_id long, found array<int>, left array<int>"

    def reduce(batches):
        for t in batches:
            rows = []
            for cycle, walk, found, left in zip(t["cycle"], t["walk_id"], t["found"], t["left"]):
                found = list(found)
                rest = sorted(r.go_on(set(map(int, left)), found)) if len(left) else []
                rows.append((list(cycle), walk, found, rest))
            yield pd.DataFrame(rows, columns=["cycle", "walk_id", "found", "left"])

    while True:
        state = written(state.mapInPandas(reduce, schema), "classes")
        stopped = state.where(F.size("left") > 0).agg(F.min_by("left", "walk_id").alias("left")).first()["left"]
        if stopped is None:
            break
        r.new[max(stopped)] = set(stopped)
    return each.join(state.select("cycle", F.array_sort("found").alias("classes")), "cycle").select("walk_id", "classes")


def restrict(classes: DataFrame, chosen: DataFrame) -> DataFrame:
    """Representations restricted to chosen classes (c)."""
    kept = classes.select("walk_id", F.explode("classes").alias("c")).join(chosen.select("c").distinct(), "c", "left_semi")
    kept = kept.groupBy("walk_id").agg(F.sort_array(F.collect_list("c")).alias("classes"))
    return classes.select("walk_id").join(kept, "walk_id", "left").select("walk_id", F.coalesce("classes", F.array().cast("array<int>")).alias("classes"))


def dendrogram(classes: DataFrame, order: dict[int, float], percent: float = 0.0) -> DataFrame:
    """(walk_id, leaf): walks split class by class, the longest living first, into those with and without it; a split ends at
    groups of at most percent of the walks. A leaf's name is the path to it. Walks with equal classes move as one row; every class
    of ``order`` is a round of counts per leaf."""
    t = classes.select("walk_id", F.array_sort(F.array_distinct("classes")).alias("classes"))
    sets = written(t.groupBy("classes").agg(F.count("*").alias("n")), "sets")
    total = sets.agg(F.sum("n")).first()[0] or 0
    least = int(np.ceil(total * percent / 100)) if percent else 1
    sets = sets.select("classes", "n", F.lit("ROOT").alias("leaf"), F.lit(True).alias("open"))
    for i, c in enumerate(sorted(order, key=lambda c: (-order[c], c))):
        has = F.array_contains("classes", F.lit(int(c)))
        size = sets.groupBy("leaf").agg(F.sum("n").alias("all"), F.sum(F.when(has, F.col("n")).otherwise(0)).alias("yes"))
        sets = sets.join(size, "leaf")
        parts = F.col("open") & (F.col("yes") > 0) & (F.col("yes") < F.col("all"))
        name = F.when(parts & (F.col("all") > least), F.concat("leaf", F.when(has, F.lit(f"_{c}")).otherwise(F.lit(f"_-{c}")))).otherwise(F.col("leaf"))
        sets = sets.select("classes", "n", name.alias("leaf"), (F.col("open") & ~(parts & (F.col("all") <= least))).alias("open"))
        if i % 4 == 3:
            sets = written(sets, "sets")
    return t.join(sets.select("classes", "leaf"), "classes").select("walk_id", "leaf")
