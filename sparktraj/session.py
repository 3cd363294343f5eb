"""A fluent handle over the operators: one cloud with its labels, and what each verb derives from it.

Verbs return the handle itself; tables are immutable, so ``copy`` is cheap.
"""
from __future__ import annotations

import copy as _copy

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.ordered import numbered
from .functions.scalars import with_scalars
from .operators import cluster, complexes, flow, homology, knn, points, solve, sparse, walks
from .operators.layout import Layouts
from .sources import io
from .sources.shared import written


class Trajectory:
    def __init__(self, cloud: DataFrame, labels: DataFrame, dim: int, name: str = "trajectory"):
        self.points, self.labels = io.construct(cloud, labels, dim)
        self.dim, self.name = dim, name
        self.origin: dict[str, int] = {}
        self.lists = self.denoised = self.clusters = self.codes = self.simplices = self.boundary = self.reduced = self.communities = None
        self.pseudotime: dict[str, DataFrame] = {}
        self.walks: dict[str, DataFrame] = {}
        self.walk_stats: dict[str, DataFrame] = {}
        self.fates: dict[str, DataFrame] = {}
        self.layouts = Layouts()
        self.show_all_fates = True

    def copy(self) -> "Trajectory":
        other = _copy.copy(self)
        for k in ("origin", "pseudotime", "walks", "walk_stats", "fates"):
            setattr(other, k, dict(getattr(self, k)))
        other.layouts = Layouts()
        other.layouts.tables = dict(self.layouts.tables)
        return other

    def summary(self) -> DataFrame:
        return io.summary(self.points, self.labels)

    def label_set(self, labels_name: str) -> DataFrame:
        return self.labels.where(F.col("labels_name") == labels_name).select("id", "label")

    def set_origin(self, label: str | int, labels_name: str = "default", origin_name: str | None = None) -> "Trajectory":
        if isinstance(label, int):
            self.origin[origin_name or "default"] = label
            return self
        row = points.set_origin(self.points, self.label_set(labels_name).where(F.col("label") == label), self.dim).first()
        if row is None:
            raise ValueError(f"no point is labelled {label} in {labels_name}")
        self.origin[origin_name or label] = row["id"]
        return self

    def knn(self, k: int = 100, method: str = "forest", denoised: bool = False, **options) -> "Trajectory":
        self.lists = written(knn.knn(self.denoised if denoised and self.denoised is not None else self.points, k, method, **options), "knn")
        return self

    def _lists(self, k: int | None) -> DataFrame:
        if self.lists is None:
            raise ValueError("run knn first")
        return self.lists if k is None else knn.first_k(self.lists, k)

    def denoise(self, k: int = 30, rounds: int = 1, method: str = "KNN", kernel: str = "semer", sym: str = "max") -> "Trajectory":
        n = self._lists(k)
        p = sparse.transition_matrix(n, kernel, sym) if method == "MAGIC" else None
        self.denoised = written(points.denoise_verb(self.points.select("id", "x"), n, self.dim, method, p, rounds), "denoised")
        return self

    def cluster(self, k: int = 625, clustering: DataFrame | None = None) -> "Trajectory":
        if clustering is not None:
            self.clusters, self.codes = cluster.given_clusters(self.points, clustering, self.dim)
        else:
            a, codes = cluster.kmeans(self.points, k)
            self.clusters = written(a, "clusters")
            self.codes = self.points.sparkSession.createDataFrame([(i + 1, c.tolist()) for i, c in enumerate(codes)], "cluster long, x array<double>")
        return self

    def som(self, xdim: int = 25, ydim: int = 25) -> "Trajectory":
        """Clusters by k-means with a code for every unit of a grid."""
        return self.cluster(xdim * ydim)

    def grid_filtration(self, xdim: int, ydim: int, k: int = 10) -> "Trajectory":
        """The filtration of the grid of codes in place of a witness complex."""
        return self._reduce(cluster.grid_complex(self.codes, xdim, ydim, k))

    def filtration(self, k: int = 30, alpha: float | None = None) -> "Trajectory":
        marks = written(self.codes.select(F.col("cluster").alias("id"), "x"), "codes")
        shifted = self.points.select((F.col("id") + 10**15).alias("id"), "x")  # points and codes must not be taken for each other
        near = written(knn.nearest(shifted, marks, k), "witness")
        if alpha is None:
            alpha = near.groupBy("src").agg(F.max("dist").alias("d")).agg(F.avg("d")).first()[0]
        c = written(complexes.expand(complexes.witness_vertices(near, alpha), complexes.witness_edges(near, alpha)), "complex")
        return self._reduce(complexes.skeleton(c, marks, 2))

    def _reduce(self, simplices: DataFrame) -> "Trajectory":
        self.simplices = written(simplices, "simplices")
        self.boundary = written(complexes.boundary(self.simplices), "boundary")
        self.reduced = written(homology.reduce_boundary(self.boundary), "reduced")
        return self

    def similarity(self, k: int | None = 30, kernel: str = "semer", sym: str = "max", epsilon: float | None = None) -> DataFrame:
        return sparse.similarity(self._lists(k), kernel, sym, epsilon)

    def solve_pseudotime(self, origin_name: str | None = None, k: int = 30, kernel: str = "semer", sym: str = "max", weighted: bool = True, method: str | None = None, **options) -> "Trajectory":
        name = origin_name or next(iter(self.origin))
        sim = written(self.similarity(k, kernel, sym), "similarity")
        cost = sparse.symmetrize(sparse.distances(self._lists(k)), "max") if weighted else None
        method = method or ("bicgstab" if sym in ("none", "min") else "cg")
        self.pseudotime[name] = written(solve.hitting(sim, self.origin[name], cost, method, **options), "pseudotime")
        return self

    def simulate_walks(self, n: int = 1000, origin_name: str | None = None, breaks: int = 100, base: float = 1.5, k: int = 30, kernel: str = "semer", sym: str = "max", to: str | None = None, labels_name: str = "default", equinumerous: bool = False, add: bool = False, seed: int = 1) -> "Trajectory":
        name = origin_name or next(iter(self.origin))
        pt = self.pseudotime[name].where("pt is not null")
        go = written(sparse.orient(self.similarity(k, kernel, sym), pt, breaks, base), "oriented")
        ends = walks.fates(go)
        if to is not None:
            ends = points.set_origin(self.points, self.label_set(labels_name).where(F.col("label") == to), self.dim).select("id")
        if to is not None or equinumerous:
            steps, stats = walks.walks_to(go, self.origin[name], ends, n, seed)
            steps = steps.select("walk_id", "step", "v")
        else:
            steps, stats = walks.simulate(go, self.origin[name], n, seed)
        if add and name in self.walks:
            top = self.walks[name].agg(F.max("walk_id")).first()[0] or 0
            shift = F.col("walk_id") + top
            steps = self.walks[name].unionByName(steps.withColumn("walk_id", shift))
            if stats is not None and self.walk_stats.get(name) is not None:
                stats = self.walk_stats[name].unionByName(stats.withColumn("walk_id", shift))
        self.walks[name], self.fates[name] = steps, ends
        if stats is not None:
            self.walk_stats[name] = stats
        return self

    def dim_red(self, method: str = "diffuse", layout: DataFrame | None = None, axes: int = 2, k: int = 30) -> "Trajectory":
        self.layouts.add(method, self.points, self._lists(k) if method == "diffuse" else None, layout, axes)
        return self

    def down_sample(self, n: int = 10_000, k: int = 10, d: float = 2.0, method: str = "default", e: float = 1.0, seed: int = 7) -> "Trajectory":
        """Keeps a sample of the points and forgets everything derived. method: default (boundary of the density^e), naive (weights
        dist^e, dist to entry k of the list) or exp (weights exp(dist^e))."""
        if method == "default":
            kept = points.down_sample(self._lists(None), n, k, d, e, seed)
        else:
            kept = points.sparse_sample(self._lists(None), n, k, e, method, seed)
        kept = written(kept, "kept")
        return Trajectory(self.points.join(kept, "id", "left_semi"), self.labels.join(kept, "id", "left_semi"), self.dim, self.name)

    def find_communities(self, k: int = 30, weight: str = "distance") -> "Trajectory":
        e = sparse.symmetrize(sparse.distances(self._lists(k)), "max") if weight == "distance" else self.similarity(k)
        self.communities = written(cluster.louvain(e), "communities")
        return self

    def connectome(self, origin_name: str | None = None, labels_name: str = "default", layout: str | None = None, k: int = 30, **options) -> tuple[DataFrame, DataFrame]:
        name = origin_name or next(iter(self.origin))
        if self.communities is None:
            self.find_communities(k)
        at = self.layouts.tables[layout or next(iter(self.layouts.tables))]
        o = self.points.sparkSession.createDataFrame([(self.origin[name],)], "id long")
        return flow.connectome(self.walks[name], self.communities, self.label_set(labels_name), at, o, **options)

    def classify_walks(self, origin_name: str | None = None, termini: list[int] | None = None, reference: int | None = None, marked: DataFrame | None = None, extra_edges: bool = False) -> DataFrame:
        """(walk_id, classes): walks over clusters (all, those that end in the given vertices, or a marked subset (walk_id)) as classes of
        the filtration relative to the first of them.

        Where they end in several vertices, each is led on to the cluster of the end with the latest pseudotime. With ``extra_edges``
        an edge from each other end to that cluster is added for this call; as nothing fills it, each is an essential class."""
        name = origin_name or next(iter(self.origin))
        w = self.walks[name]
        if termini is not None:
            ends = walks.termini(w)
            w = walks.select_walks(w, ends.where(F.col("v").isin(*termini)))
        if marked is not None:
            w = walks.select_walks(w, marked)
        ends = walks.termini(w).select(F.col("v").alias("id")).distinct()
        late = F.struct(F.coalesce("pt", F.lit(-1.0)), -F.col("id"))
        last = ends.join(self.clusters, "id").join(self.pseudotime[name], "id", "left").agg(F.max_by("cluster", late).alias("c"), F.count("*").alias("n")).first()
        w = written(walks.remove_cycles(written(walks.contract(w, self.clusters), "contracted")), "acyclic")
        simplices = self.simplices
        if last["n"] > 1:
            if extra_edges:
                at = F.least("v", F.lit(last["c"])), F.greatest("v", F.lit(last["c"]))
                more = walks.termini(w).where(F.col("v") != last["c"]).select(F.array(*at).alias("verts")).distinct().join(simplices, "verts", "left_anti")
                top = simplices.agg(F.max("sidx").alias("top"), F.max("value").alias("value"))
                more = numbered(with_scalars(more, top), [], [F.col("verts")], "n").select((F.col("top") + F.col("n")).cast("int").alias("sidx"), "verts", F.lit(1).alias("dim"), "value")
                simplices = written(simplices.unionByName(more), "simplices")
            w = written(walks.add_terminus(w, last["c"]), "ended")
        chains = written(homology.triangulate(w, simplices, self.codes.select(F.col("cluster").alias("id"), "x")), "chains")
        ref = reference if reference is not None else w.agg(F.min("walk_id")).first()[0]
        return homology.represent(homology.cycles_against(chains, ref), self.reduced)

    def toggle_fates(self, show: bool | None = None) -> "Trajectory":
        self.show_all_fates = not self.show_all_fates if show is None else show
        return self

    TABLES = ("points", "labels", "lists", "denoised", "clusters", "codes", "simplices", "boundary", "reduced", "communities")
    NAMED = ("pseudotime", "walks", "walk_stats", "fates")

    def save(self, path: str) -> None:
        """Every table of the handle, its origins, layouts and names, to be opened again by ``load``."""
        tables = {k: getattr(self, k) for k in self.TABLES}
        tables |= {f"{k}/{n}": v for k in self.NAMED for n, v in getattr(self, k).items()} | {f"layouts/{n}": v for n, v in self.layouts.tables.items()}
        io.save({k: v for k, v in tables.items() if v is not None}, path, {"dim": self.dim, "name": self.name, "origin": self.origin, "show_all_fates": self.show_all_fates})

    @classmethod
    def load(cls, spark, path: str) -> "Trajectory":
        tables, about = io.load(spark, path)
        t = cls(tables["points"], tables["labels"], about["dim"], about["name"])
        t.origin, t.show_all_fates = about["origin"], about["show_all_fates"]
        for k, v in tables.items():
            slot, _, name = k.partition("/")
            if slot == "layouts":
                t.layouts.tables[name] = v
            elif name:
                getattr(t, slot)[name] = v
            else:
                setattr(t, slot, v)
        return t
