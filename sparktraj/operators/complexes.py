"""Simplicial complexes as tables (verts, value): witness, Rips and graph complexes, filtration values, faces and boundaries.

``verts`` is a sorted array of vertex ids. An indexed filtration adds sidx, 0-based in order of (value, dim, verts). Vertices are
landmarks, at most MAX_LANDMARKS, so their coordinates may travel with the tasks.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import numbered
from .vectors import matrix

MAX_LANDMARKS = 20_000


def landmark_coordinates(landmarks: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    t = landmarks.select("id", "x").limit(MAX_LANDMARKS + 1).toArrow()
    if t.num_rows > MAX_LANDMARKS:
        raise ValueError(f"more than {MAX_LANDMARKS} landmarks")
    o = np.argsort(t.column("id").to_numpy())
    return t.column("id").to_numpy()[o], matrix(t.column("x"))[o]


def _edges_of(lists: DataFrame) -> DataFrame:
    """Pairs of landmarks in a witness's list (src: witness, dst: landmark), the nearer one first."""
    a = lists.select("src", F.col("dst").alias("a"), F.col("rnk").alias("ra"), F.col("dist").alias("da"))
    b = lists.select("src", F.col("dst").alias("b"), F.col("rnk").alias("rb"), F.col("dist").alias("db"))
    first = lists.groupBy("src").agg(F.min("dist").alias("d1"), F.min(F.when(F.col("rnk") == 2, F.col("dist"))).alias("d2"))
    return a.join(b, "src").where("ra < rb").join(first, "src")


def witness_vertices(lists: DataFrame, alpha: float) -> DataFrame:
    """(v): landmarks within alpha of some witness's nearest."""
    d1 = F.min("dist").over(Window.partitionBy("src"))
    return lists.withColumn("d1", d1).where(F.col("dist") <= F.col("d1") + alpha).select(F.col("dst").alias("v")).distinct()


def witness_edges(lists: DataFrame, alpha: float) -> DataFrame:
    """(a, b), a < b: edges of the weak witness complex. An edge needs a witness whose farther end is not more than alpha beyond
    the nearest landmark outside the edge."""
    e = _edges_of(lists)
    outside = F.when((F.col("ra") == 1) & (F.col("rb") == 2), F.col("db")).when(F.col("ra") == 1, F.col("d2")).otherwise(F.col("d1"))
    e = e.where(F.col("db") <= outside + alpha).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    v = witness_vertices(lists, alpha)
    return e.join(v.withColumnRenamed("v", "a"), "a", "left_semi").join(v.withColumnRenamed("v", "b"), "b", "left_semi")


def strong_witness_edges(lists: DataFrame, alpha: float) -> DataFrame:
    """(a, b, value): both ends nearer than alpha beyond the nearest landmark; value the least excess over witnesses."""
    e = _edges_of(lists).where(F.col("db") < F.col("d1") + alpha)
    return e.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min(F.col("db") - F.col("d1")).alias("value"))


def strong_witness(lists: DataFrame, alpha: float) -> DataFrame:
    """(verts, value) of the strong witness complex to triangles: sets of landmarks that one witness has all nearer than alpha
    beyond its nearest; value the least excess of the farthest over witnesses."""
    d1 = F.min("dist").over(Window.partitionBy("src"))
    near = lists.withColumn("over", F.col("dist") - d1).where(F.col("over") < alpha).select("src", F.col("dst").alias("v"), "over")
    one = near.select(F.array("v").alias("verts"), F.col("over").alias("value"))
    two = near.select("src", F.col("v").alias("a"), F.col("over").alias("oa")).join(near.select("src", F.col("v").alias("b"), F.col("over").alias("ob")), "src").where("a < b")
    two = two.select("src", "a", "b", F.greatest("oa", "ob").alias("o"))
    three = two.join(near.select("src", F.col("v").alias("c"), F.col("over").alias("oc")), "src").where("b < c")
    rows = one.unionByName(two.select(F.array("a", "b").alias("verts"), F.col("o").alias("value"))).unionByName(three.select(F.array("a", "b", "c").alias("verts"), F.greatest("o", "oc").alias("value")))
    return rows.groupBy("verts").agg(F.min("value").alias("value"))


def clique_complex(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(verts, value) of vertices (v, value) and edges (a, b, value) with the triangles these enclose, at the largest of their edges."""
    t = triangles(edges)
    for p, q in (("a", "b"), ("a", "c"), ("b", "c")):
        t = t.join(edges.select(F.col("a").alias(p), F.col("b").alias(q), F.col("value").alias(f"w{p}{q}")), [p, q])
    out = vertices.select(F.array("v").alias("verts"), "value").unionByName(edges.select(F.array("a", "b").alias("verts"), "value"))
    return out.unionByName(t.select(F.array("a", "b", "c").alias("verts"), F.greatest("wab", "wac", "wbc").alias("value")))


def triangles(edges: DataFrame) -> DataFrame:
    """(a, b, c): 3-cliques of edges (a, b), a < b."""
    e = edges.select("a", "b")
    two = e.join(e.select(F.col("a"), F.col("b").alias("c")), "a").where("b < c")
    return two.join(e.select(F.col("a").alias("b"), F.col("b").alias("c")), ["b", "c"], "left_semi").select("a", "b", "c")


def cliques(edges: DataFrame, k: int) -> DataFrame:
    """(verts): k-cliques, grown one vertex at a time."""
    e = edges.select("a", "b")
    out = e.select(F.array("a", "b").alias("verts"))
    for n in range(2, k):
        grown = out.withColumn("a", F.element_at("verts", -1)).join(e, "a").select("verts", F.col("b").alias("new"))
        links = grown.withColumn("m", F.explode("verts")).join(e.select(F.col("a").alias("m"), F.col("b").alias("new")), ["m", "new"])
        ok = links.groupBy("verts", "new").agg(F.count("*").alias("c")).where(F.col("c") == n)
        out = ok.select(F.concat("verts", F.array("new")).alias("verts"))
    return out


def expand(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(verts): vertices, edges and triangles of a 1-skeleton."""
    t = triangles(edges)
    return vertices.select(F.array("v").alias("verts")).unionByName(edges.select(F.array("a", "b").alias("verts"))).unionByName(t.select(F.array("a", "b", "c").alias("verts")))


def rips(distances: DataFrame, threshold: float) -> DataFrame:
    """(verts, value) of the Rips complex to triangles of sparse distances (src, dst, w); the smaller of both directions counts."""
    e = distances.where((F.col("w") <= threshold) & (F.col("src") != F.col("dst")))
    e = e.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.min("w").alias("w"))
    v = distances.select(F.col("src").alias("v")).union(distances.select("dst")).distinct()
    t = triangles(e)
    for p, q in (("a", "b"), ("a", "c"), ("b", "c")):
        t = t.join(e.select(F.col("a").alias(p), F.col("b").alias(q), F.col("w").alias(f"w{p}{q}")), [p, q])
    out = v.select(F.array("v").alias("verts"), F.lit(0.0).alias("value")).unionByName(e.select(F.array("a", "b").alias("verts"), F.col("w").alias("value")))
    return out.unionByName(t.select(F.array("a", "b", "c").alias("verts"), F.greatest("wab", "wac", "wbc").alias("value")))


def graph_complex(edges: DataFrame) -> DataFrame:
    """(verts, value): vertices at 0 and edges at their weight."""
    e = edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.min("w").alias("value")).where("a <> b")
    v = e.select(F.col("a").alias("v")).union(e.select("b")).distinct()
    return v.select(F.array("v").alias("verts"), F.lit(0.0).alias("value")).unionByName(e.select(F.array("a", "b").alias("verts"), "value"))


def _valued(simplices: DataFrame, landmarks: DataFrame, f) -> DataFrame:
    ids, x = landmark_coordinates(landmarks)

    def run(batches):
        for b in batches:
            verts = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(f(verts, lambda v: x[np.searchsorted(ids, v)], ids, x), pa.float64())], ["verts", "value"])

    return simplices.select("verts").mapInArrow(run, "verts array<long>, value double")


def circumradius2(p: np.ndarray) -> np.ndarray:
    """Squared circumradius of triangles (n, 3, dim), infinite for degenerate ones."""
    a2, b2, c2 = (((p[:, i] - p[:, j]) ** 2).sum(1) for i, j in ((0, 1), (0, 2), (1, 2)))
    sixteen = 2 * (a2 * b2 + a2 * c2 + b2 * c2) - (a2 * a2 + b2 * b2 + c2 * c2)
    return np.where(sixteen > 1e-18, a2 * b2 * c2 / np.maximum(sixteen, 1e-300), np.inf)


def alpha_values(simplices: DataFrame, landmarks: DataFrame) -> DataFrame:
    """(verts, value): vertices 0; triangles their squared circumradius; edges half their length squared if no other vertex lies
    nearer to their middle, else the least value of their triangles (their own if they have none)."""

    def f(verts, at, ids, x):
        out = [0.0] * len(verts)
        two, three = [i for i, v in enumerate(verts) if len(v) == 2], [i for i, v in enumerate(verts) if len(v) == 3]
        if three:
            for i, r in zip(three, circumradius2(np.stack([at(verts[i]) for i in three]))):
                out[i] = float(r)
        for s in range(0, len(two), 2000):
            part = two[s : s + 2000]
            p = np.stack([at(verts[i]) for i in part])
            mid, r2 = p.mean(1), ((p[:, 0] - p[:, 1]) ** 2).sum(1) / 4
            near = ((mid[:, None] - x[None]) ** 2).sum(2).min(1) if len(x) * len(part) < 5e6 else np.array([((m - x) ** 2).sum(1).min() for m in mid])
            for i, r, n in zip(part, r2, near):
                out[i] = float(r) if n >= r * (1 - 1e-9) else -float(r)  # negative: not Gabriel
        return out

    own = _valued(simplices, landmarks, f)
    up = own.where(F.size("verts") == 3)
    faces = up.select(F.explode(F.array(*[F.array(F.col("verts")[i], F.col("verts")[j]) for i, j in ((0, 1), (0, 2), (1, 2))])).alias("verts"), F.col("value").alias("up"))
    low = faces.groupBy("verts").agg(F.min("up").alias("up"))
    both = own.join(low, "verts", "left")
    return both.select("verts", F.when(F.col("value") >= 0, F.col("value")).otherwise(F.coalesce("up", F.abs("value"))).alias("value"))


def rips_values(simplices: DataFrame, landmarks: DataFrame, threshold: float = float("inf")) -> DataFrame:
    """(verts, value): edges their length if within the threshold, else 0; triangles the largest face, 0 if a face is 0."""

    def f(verts, at, ids, x):
        out = []
        for v in verts:
            if len(v) < 2:
                out.append(0.0)
                continue
            p = at(v)
            d = [float(np.sqrt(((p[i] - p[j]) ** 2).sum())) for i in range(len(v)) for j in range(i)]
            out.append(0.0 if max(d) > threshold or min(d) == 0 else max(d))
        return out

    return _valued(simplices, landmarks, f)


def pairwise_values(simplices: DataFrame, landmarks: DataFrame) -> DataFrame:
    """(verts, value): largest pairwise distance; triangles 1e-7 later than their edges."""

    def f(verts, at, ids, x):
        out = []
        for v in verts:
            p = at(v)
            out.append(max([0.0, *(float(np.sqrt(((p[i] - p[j]) ** 2).sum())) for i in range(len(v)) for j in range(i))]) + (1e-7 if len(v) > 2 else 0.0))
        return out

    return _valued(simplices, landmarks, f)


def index(simplices: DataFrame) -> DataFrame:
    """(sidx, verts, dim, value) in order of (value, dim, verts), numbered in range partitions."""
    s = numbered(simplices.withColumn("dim", F.size("verts") - 1), [], [F.col("value"), F.col("dim"), F.col("verts")], "n")
    return s.select((F.col("n") - 1).cast("int").alias("sidx"), "verts", "dim", "value")


def skeleton(simplices: DataFrame, landmarks: DataFrame, k: int, kind: str = "alpha", threshold: float = float("inf")) -> DataFrame:
    kept = simplices.where(F.size("verts") <= k + 1)
    return index(alpha_values(kept, landmarks) if kind == "alpha" else rips_values(kept, landmarks, threshold))


def facets(simplices: DataFrame) -> DataFrame:
    """(sidx, face): each simplex with the vertex sets of its facets."""
    s = simplices.where(F.size("verts") > 1).select("sidx", "verts", F.explode("verts").alias("out"))
    return s.select("sidx", F.array_remove(F.col("verts"), F.col("out")).alias("face"))


def boundary(simplices: DataFrame) -> DataFrame:
    """(sidx, dim, faces): sorted indices of the facets, empty for vertices."""
    f = facets(simplices).join(simplices.select(F.col("verts").alias("face"), F.col("sidx").alias("f")), "face")
    f = f.groupBy("sidx").agg(F.sort_array(F.collect_list("f")).alias("faces"))  # dim + 1 entries
    return simplices.join(f, "sidx", "left").select("sidx", "dim", F.coalesce("faces", F.array().cast("array<int>")).alias("faces"))


def cofaces(simplices: DataFrame) -> DataFrame:
    """(sidx, coface): the simplices one dimension up, -1 where there are none."""
    up = facets(simplices).join(simplices.select(F.col("verts").alias("face"), F.col("sidx").alias("f")), "face").select(F.col("f").alias("down"), F.col("sidx").alias("coface"))
    return simplices.select("sidx").join(up, F.col("sidx") == F.col("down"), "left").select("sidx", F.coalesce("coface", F.lit(-1)).alias("coface"))


def union(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both filtrations, a vertex set once with the first's value; indexed anew."""
    both = first.select("verts", "value", F.lit(1).alias("n")).unionByName(second.select("verts", "value", F.lit(2).alias("n")))
    both = both.withColumn("verts", F.array_sort("verts")).groupBy("verts").agg(F.min_by("value", "n").alias("value"))
    return index(both)


def relative(simplices: DataFrame, vertices: DataFrame) -> DataFrame:
    """Simplices whose vertices all belong to the set (v)."""
    out = simplices.select("sidx", F.explode("verts").alias("v")).join(vertices.select("v").distinct(), "v", "left_anti").select("sidx").distinct()
    return simplices.join(out, "sidx", "left_anti")


def reindex(simplices: DataFrame, names: DataFrame) -> DataFrame:
    """Vertices renamed by (v, name)."""
    e = simplices.select("sidx", F.explode("verts").alias("v")).join(names, "v").groupBy("sidx").agg(F.sort_array(F.collect_list("name")).alias("verts"))
    return simplices.drop("verts").join(e, "sidx")


def lower_bound(reduced: DataFrame, threshold: int) -> DataFrame:
    """Entries up to the threshold dropped from reduced columns, lows anew, empty columns left out."""
    e = reduced.withColumn("entries", F.filter("entries", lambda v: v > threshold)).where(F.size("entries") > 0)
    return e.withColumn("low", F.array_max("entries"))


def time_slices(points: DataFrame, times: DataFrame, breaks: list[float]) -> dict[float, DataFrame]:
    """break -> points with pt at least the break (superlevel sets)."""
    rows = points.join(times.select("id", "pt"), "id")
    return {b: rows.where(F.col("pt") >= b).drop("pt") for b in breaks}
