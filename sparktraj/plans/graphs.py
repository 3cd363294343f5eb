"""Queries of neighbour tables, kernels, sparse matrices and linear systems, over the embeddings."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import with_scalars
from ..operators import knn as N
from ..operators import points as P
from ..operators import solve as L
from ..operators import sparse as M
from ..sources import tables as t
from .base import emb_knn, knn_sql

K, KG = 30, 10  # neighbours of the neighbour queries, and of the graphs


def r(df, *names):
    for n in names:
        df = df.withColumn(n, F.round(n, 6))
    return df


def edges_q(f, k=KG):
    return lambda s, d: r(f(emb_knn(s, d, k)).select("src", "dst", "w"), "w")


BASE = t.with_(t.EMB, knn_sql(KG)) + ", "
SYM = "sd as (select src, dst, max(dist) as dist from (select src, dst, dist from knn union all select dst, src, dist from knn) group by all)"

STAT_SQL = {
    "median": "(select quantile_cont(dist, 0.5) from {e})",
    "max": "(select max(dist) from {e})",
    "row_max": "max(dist) over (partition by src)",
    "row_median": "quantile_cont(dist, 0.5) over (partition by src)",
}
WEIGHT_SQL = {
    "se": "exp(-dist * dist / (2 * s * s))",
    "se0": "exp(-dist * dist / s)",
    "lap": "exp(-dist / s)",
    "exp": "exp(-dist / (2 * s * s))",
    "expm": "exp(-dist / s)",
    "expmr": "exp(-dist / s)",
    "expmer": "exp(-dist / s)",
    "expmer2": "exp(-dist / (2 * s))",
    "semr": "exp(-dist * dist / s)",
    "semer": "exp(-dist * dist / (s * s))",
    "semer0": "exp(-dist / s)",
    "semer2": "exp(-dist * dist / (2 * s * s))",
    "expsigma": "exp(-dist / s)",
}


def sigma_cte(lists: str, target: str = "log2(len(ds))") -> str:
    """sig(src, s): the bisection of a list's width, 64 halvings at most."""
    return f"""bis as (select src, ds, 0.0::double as lo, 'inf'::double as hi, 1.0::double as mid, 0 as i from (select src, list(dist) as ds from {lists} group by src)
  union all select src, ds, case when s > t then lo else mid end, case when s > t then mid else hi end, case when s > t then (lo + mid) / 2 when hi = 'inf' then mid * 2 else (mid + hi) / 2 end, i + 1
    from (select *, {target} as t, list_sum(list_transform(ds, lambda d: case when d > 0 then exp(-d / mid) else 1.0::double end)) as s from bis where i < 64) where abs(s - t) >= 1e-5),
sig as (select src, arg_max(mid, i) as s from bis group by src)"""


def kernel_cte(name: str, source: str = "knn", out: str = "ker", sym: bool = False) -> str:
    f = "exp(-dist * dist / s)" if sym and name == "semer0" else WEIGHT_SQL[name]
    if name == "expsigma":
        return sigma_cte(source) + f", {out} as (select src, dst, {f} as w from {source} join sig using (src))"
    return f"{out} as (select src, dst, {f} as w from (select *, {STAT_SQL[M.KERNELS[name][0]].format(e=source)} as s from {source}))"


MAXSYM = "k as (select src, dst, max(w) as w from (select src, dst, w from ker union all select dst, src, w from ker) group by all)"
SEMER = BASE + kernel_cte("semer") + ", " + MAXSYM
NORM = "p as (select src, dst, w / sum(w) over (partition by src) as w from k)"

QUERIES = {
    "knn_exact_euclid": lambda s, d: r(emb_knn(s, d, K), "dist"),
    "knn_cosine": lambda s, d: r(N.knn(t.embedding_cloud(s, d), K, metric="cosine"), "dist"),
    "knn_top_k": lambda s, d: r(N.first_k(emb_knn(s, d, K), 5), "dist"),
    "knn_with_self": lambda s, d: r(N.with_self(emb_knn(s, d, KG)), "dist"),
    "knn_reordered": lambda s, d: r(N.reorder(emb_knn(s, d, KG).withColumn("dist", F.col("dist") * F.col("dist"))), "dist"),
    "knn_cknn_scaled": lambda s, d: r(N.continuous_scale(emb_knn(s, d, KG)), "dist"),
    "knn_jaccard": edges_q(lambda n: N.jaccard(n, K), K),
    "knn_jaccard_graph": lambda s, d: N.jaccard_graph(emb_knn(s, d, KG), KG),
    "sym_max": edges_q(lambda n: M.symmetrize(M.distances(n), "max")),
    "sym_min": edges_q(lambda n: M.symmetrize(M.distances(n), "min")),
    "sym_mean": edges_q(lambda n: M.symmetrize(M.distances(n), "mean")),
    "sym_prob": edges_q(lambda n: M.symmetrize(M.kernel(M.distances(n)), "prob")),
    "transition_matrix": edges_q(M.transition_matrix),
    "transition_min": edges_q(lambda n: M.transition_matrix(n, sym="min")),
    "transition_diagonal": edges_q(lambda n: M.transition_matrix(n, diagonal=1.0, normalize=False)),
    "laplacian_sym": edges_q(M.laplacian),
}
SQL = {
    "knn_exact_euclid": t.with_(t.EMB, knn_sql(K)) + "select src, dst, rnk, round(dist, 6) as dist from knn",
    "knn_cosine": t.with_(t.EMB, knn_sql(K, metric="cosine")) + "select src, dst, rnk, round(dist, 6) as dist from knn",
    "knn_top_k": t.with_(t.EMB, knn_sql(5)) + "select src, dst, rnk, round(dist, 6) as dist from knn",
    "knn_with_self": t.with_(t.EMB, knn_sql(KG)) + "select src, dst, rnk, round(dist, 6) as dist from knn union all select id, id, 0, 0.0 from emb",
    "knn_reordered": t.with_(t.EMB, knn_sql(KG)) + "select src, dst, rnk, round(dist * dist, 6) as dist from knn",
    "knn_cknn_scaled": BASE + "l as (select src, max(dist) as dk from knn group by src) select k.src, k.dst, k.rnk, round(k.dist / (sqrt(a.dk) * sqrt(b.dk)), 6) as dist from knn k join l a on a.src = k.src join l b on b.src = k.dst",
    "knn_jaccard": t.with_(t.EMB, knn_sql(K)) + f", s as (select src, list(dst) as s from knn group by src) select k.src, k.dst, round(len(list_intersect(a.s, b.s)) / (2.0 * {K} - len(list_intersect(a.s, b.s))) / 2.0, 6) as w from knn k join s a on a.src = k.src join s b on b.src = k.dst where len(list_intersect(a.s, b.s)) > 0",
    "knn_jaccard_graph": BASE + "s as (select src, list(dst) as s from knn group by src) select least(k.src, k.dst) as a, greatest(k.src, k.dst) as b, count(*) as n from knn k join s a on a.src = k.src join s b on b.src = k.dst where len(list_intersect(a.s, b.s)) > 0 group by 1, 2",
    "sym_max": BASE + SYM + " select src, dst, round(dist, 6) as w from sd",
    "sym_min": BASE + "u as (select src, dst, dist from knn union all select dst, src, dist from knn) select src, dst, round(min(dist), 6) as w from u group by all having count(*) > 1",
    "sym_mean": BASE + "u as (select src, dst, dist from knn union all select dst, src, dist from knn) select src, dst, round(sum(dist) / 2, 6) as w from u group by src, dst",
    "sym_prob": BASE + kernel_cte("semer") + ", q as (select src, dst, w / sum(w) over (partition by src) as p from ker), u as (select src, dst, sum(p) as p, sum(q) as q from (select src, dst, p, 0.0::double as q from q union all select dst, src, 0.0::double, p from q) group by all) select src, dst, round(p + q - p * q, 6) as w from u",
    "transition_matrix": SEMER + ", " + NORM + " select src, dst, round(w, 6) as w from p",
    "transition_min": BASE + SYM + ", " + kernel_cte("semer", "sd") + " select src, dst, round(w / sum(w) over (partition by src), 6) as w from ker",
    "transition_diagonal": SEMER + " select src, dst, round(w, 6) as w from k union all select id, id, 1.0 from emb",
    "laplacian_sym": SEMER + ", f as (select * from k union all select id, id, 1.0 from emb), g as (select src, sum(w) as d from f group by src) select f.src, f.dst, round(f.w / sqrt(a.d * b.d), 6) as w from f join g a on a.src = f.src join g b on b.src = f.dst",
}
for _k in M.KERNELS:
    QUERIES[f"kernel_{_k}"] = edges_q(lambda n, _k=_k: M.kernel(M.distances(n), _k))
    SQL[f"kernel_{_k}"] = BASE + kernel_cte(_k) + " select src, dst, round(w, 6) as w from ker"
for _k in M.SYMMETRIC:
    QUERIES[f"kernel_sym_{_k}"] = edges_q(lambda n, _k=_k: M.kernel(M.symmetrize(M.distances(n)), _k, table=M.SYMMETRIC))
    SQL[f"kernel_sym_{_k}"] = BASE + SYM + ", " + kernel_cte(_k, "sd", sym=True) + " select src, dst, round(w, 6) as w from ker"


def forest_recall(s, d):
    """(src, enough): whether the approximate lists, from leaves of 50 rows, hold at least 0.9 of each exact one."""
    p = t.embedding_cloud(s, d)
    true, near = N.knn(p, KG), N.knn(p, KG, "forest", trees=60, leaf=50)
    hit = true.join(near.select("src", "dst", F.lit(1).alias("hit")), ["src", "dst"], "left").groupBy("src").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
    return hit.select("src", (F.col("recall") >= 0.9).alias("enough"))


QUERIES["knn_forest_recall"] = forest_recall
SQL["knn_forest_recall"] = "select vec_id as src, true as enough from embeddings"

# Pseudotime stand-in that SQL can compute: distance to the point with the smallest id, rounded to thousandths so that ties occur.
ORIGIN_DIST = "pt as (select a.id, round(list_distance(a.x, b.x), 3) as pt from emb a, emb b where b.id = (select min(id) from emb))"


def origin_distance(s, d):
    e = t.embedding_cloud(s, d)
    first = e.agg(F.min_by("x", "id").alias("o"))
    from ..operators.vectors import distance

    return with_scalars(e, first).select("id", F.round(distance("x", "o"), 3).alias("pt"))


def oriented(s, d, breaks=100, base=1.5):
    k = M.symmetrize(M.kernel(M.distances(emb_knn(s, d, KG))))
    return M.orient(k, origin_distance(s, d), breaks, base)


ORIENTED = (
    SEMER
    + ", "
    + ORIGIN_DIST
    + """, rk as (select id, dense_rank() over (order by pt) as t from pt),
bn as (select id, t, greatest(1, ceil((t - 1) * 100.0::double / ((select max(t) from rk) - 1)))::bigint as bin from rk),
ori as (select src, dst, w / sum(w) over (partition by src) as w from (select k.src, k.dst, k.w / pow(1.5::double, b.bin - a.bin) as w from k join bn a on a.id = k.src join bn b on b.id = k.dst where a.t < b.t))"""
)
QUERIES |= {
    "rank_bins": lambda s, d: M.rank_bins(origin_distance(s, d), 100).select("id", F.col("t").cast("long").alias("t"), F.col("bin").cast("long").alias("bin")),
    "oriented_transition": lambda s, d: r(oriented(s, d), "w"),
    "backward_edges": lambda s, d: r(M.backward(M.symmetrize(M.kernel(M.distances(emb_knn(s, d, KG)))), origin_distance(s, d)), "w"),
    "stationary_distribution": lambda s, d: M.stationary(M.symmetrize(M.kernel(M.distances(emb_knn(s, d, KG)))), 8).select("id", F.round(F.col("p") * 1000, 6).alias("p")),
}
SQL |= {
    "rank_bins": ORIENTED + " select id, t, bin from bn",
    "oriented_transition": ORIENTED + " select src, dst, round(w, 6) as w from ori",
    "backward_edges": SEMER + ", " + ORIGIN_DIST + " select k.src, k.dst, round(k.w, 6) as w from k join pt a on a.id = k.src join pt b on b.id = k.dst where a.pt > b.pt",
    "stationary_distribution": SEMER + ", " + NORM + """, v0 as (select dst as id, sum(w) / (select sum(w) from p) as v from p group by dst),
it as (select 0 as n, id, v from v0 union all select n, id, v from (select it.n + 1 as n, p.dst as id, sum(p.w * it.v) as v from it join p on p.src = it.id where it.n < 8 group by 1, 2))
select id, round(v * 1000, 6) as p from it where n = 8""",
}


def _solved(weighted, method="cg", exact=L.EXACT):
    def q(s, d):
        from ..sources.shared import written

        n = written(emb_knn(s, d, KG), "knn")
        k = written(M.symmetrize(M.kernel(M.distances(n))), "kernel")
        cost = M.symmetrize(M.distances(n)) if weighted else None
        origin = k.agg(F.min("src")).first()[0]
        pt = L.hitting(k, origin, cost, method, exact)
        # evidence per vertex: the equation holds; the origin's own row is its boundary value
        res = L.residuals(k, pt, cost).where(F.col("id") != origin).select("id", F.when(F.col("residual") < 1e-6, 0.0).otherwise(F.round("residual", 6)).alias("residual"))
        return res.unionByName(pt.where(F.col("id") == origin).select("id", F.abs("pt").alias("residual")))

    return q


for _name, _args in {"pseudotime_time_residual": (False,), "pseudotime_distance_residual": (True,), "solver_cg_residual": (False, "cg", 10), "solver_minres_residual": (False, "minres", 10), "solver_bicgstab_residual": (True, "bicgstab", 10)}.items():
    QUERIES[_name] = _solved(*_args)
    SQL[_name] = "select vec_id as id, 0.0::double as residual from embeddings"


def labels_propagated(s, d):
    """Labels of the points nearest to their label's mean, spread over the graph, by evidence per point and label: a seed has 1 for
    its label and 0 for others, any other point the weighted mean of its neighbours; the scores of a point sum to 1."""
    from ..sources.shared import written

    e = t.embedding_cloud(s, d)
    k = written(M.symmetrize(M.kernel(M.distances(emb_knn(s, d, KG)))), "kernel")
    seeds = written(P.set_origin(e, e.select("id", "label"), t.EMBEDDING_DIM), "seeds")
    got = written(L.label_scores(k, seeds), "scores")
    mean = k.join(got.select(F.col("id").alias("dst"), "label", "score"), "dst").groupBy(F.col("src").alias("id"), "label").agg((F.sum(F.col("w") * F.col("score")) / F.sum("w")).alias("mean"))
    own = seeds.select("id", F.col("label").alias("own"))
    both = got.join(mean, ["id", "label"]).join(own, "id", "left")
    off = F.abs(F.col("score") - F.when(F.col("own").isNull(), F.col("mean")).otherwise((F.col("own") == F.col("label")).cast("double")))
    rows = both.select("id", "label", F.when(off < 1e-7, 0.0).otherwise(F.round(off, 6)).alias("residual"))
    return rows.join(got.groupBy("id").agg(F.round(F.sum("score"), 6).alias("total")), "id")


def diffusion_coordinates(s, d):
    """Evidence per point: each coordinate is carried by the row-normalised kernel into its multiple by the eigenvalue that the
    scaling lambda / (1 - lambda) says, the coordinates being weighted by degree of length 1 before it."""
    from ..sources.shared import written

    n = written(emb_knn(s, d, KG), "knn")
    x = written(M.diffusion_map(n), "map")
    k = written(M.with_diagonal(M.symmetrize(M.kernel(M.distances(n))), 1.0), "kernel")
    moved = M.sparse_times_vectors(M.row_normalize(k), x, 2).withColumnRenamed("x", "y").join(x, "id")
    deg = k.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("deg"))
    both = written(moved.join(deg, "id"), "moved")
    total = both.agg(F.sum("deg")).first()[0]
    out = both
    for a in range(2):
        xa, ya = F.col("x")[a], F.col("y")[a]
        xx, xy = both.agg(F.sum(F.col("deg") * xa * xa), F.sum(F.col("deg") * xa * ya)).first()
        lam = xy / xx
        unit = xx / total * ((1 - lam) / lam) ** 2
        out = out.withColumn(f"axis_{a}", (F.abs(ya - lam * xa) < 1e-6 * (xx / total) ** 0.5) & F.lit(abs(unit - 1) < 1e-6))
    return out.select("id", "axis_0", "axis_1")


def diffusion_residual(s, d):
    """Per eigenpair of the Laplacian: |A v - lambda v| vanishes."""
    import numpy as np

    k = M.laplacian(emb_knn(s, d, KG))
    ids, lam, v = M.leading_eigenvectors(k, 3)
    _, i, j, w = M.local_matrix(k)
    err = [float(np.abs(np.bincount(i, w * v[j, c], len(ids)) - lam[c] * v[:, c]).max()) for c in range(3)]
    return s.createDataFrame([(c, err[c] < 1e-6) for c in range(3)], "axis int, holds boolean")


QUERIES |= {
    "label_propagation": labels_propagated,
    "diffusion_eigenpairs": diffusion_residual,
    "diffusion_map": diffusion_coordinates,
}
SQL |= {
    "label_propagation": "select vec_id as id, l.label, 0.0::double as residual, 1.0::double as total from embeddings, (select distinct label::varchar as label from embeddings) l",
    "diffusion_eigenpairs": "select unnest([0, 1, 2])::int as axis, true as holds",
    "diffusion_map": "select vec_id as id, true as axis_0, true as axis_1 from embeddings",
}
