"""Queries of point-wise transforms and sampling, over the points (25 channels) and the embeddings."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashrand import uniform_sql
from ..operators import knn as N
from ..operators import points as P
from ..operators import sparse as M
from ..operators.vectors import explode_dims
from ..sources import tables as t
from .base import emb_knn, knn_sql
from .graphs import KG, NORM, SEMER, r, sigma_cte

DIMS = t.with_(t.CLOUD) + ", dims as (select id, (c - 1)::int as dim, x[c] as value from (select id, x, unnest(range(1, 26)) as c from pts))"


def main_labels(s, d):
    return t.labels(s, d).where("labels_name = 'default'").select("id", "label")


MAIN = "ml as (select id, label from lab where labels_name = 'default')"
EKNN = t.with_(t.EMB, knn_sql(KG))

QUERIES = {
    "asinh_transform": lambda s, d: r(explode_dims(P.asinh_transform(t.cloud(s, d)), "id"), "value"),
    "normalize_percentile": lambda s, d: r(P.normalize_percentile(t.cloud(s, d)), "value"),
    "zscore": lambda s, d: r(P.zscore(t.cloud(s, d)), "value"),
    "layout_minmax": lambda s, d: r(P.min_max(t.cloud(s, d)), "value"),
    "denoise_knn": lambda s, d: r(explode_dims(P.denoise_verb(t.embedding_cloud(s, d), emb_knn(s, d, KG), 64), "id"), "value"),
    "magic_1": lambda s, d: r(explode_dims(P.magic(t.embedding_cloud(s, d), M.transition_matrix(emb_knn(s, d, KG)), 64, 1), "id"), "value"),
    "magic_2": lambda s, d: r(explode_dims(P.magic(t.embedding_cloud(s, d), M.transition_matrix(emb_knn(s, d, KG)), 64, 2), "id"), "value"),
    "data_core": lambda s, d: P.core_points(emb_knn(s, d, KG), 0.8),
    "density_downsample": lambda s, d: P.down_sample(emb_knn(s, d, KG), 200, KG, 2.0),
    "density_values": lambda s, d: r(P.densities(emb_knn(s, d, KG), KG), "dens"),
    "upsample_labels": lambda s, d: P.upsample_labels(main_labels(s, d), 40, "ungated").select("id", "label", F.col("draw").cast("long").alias("draw")),
    "sample_labels_without_replacement": lambda s, d: P.upsample_labels(main_labels(s, d), 40, None, False).select("id", "label", F.col("draw").cast("long").alias("draw")),
    "unique_points": lambda s, d: P.unique_points(t.cloud(s, d)),
    "origin_medoid": lambda s, d: P.set_origin(t.cloud(s, d), main_labels(s, d), 25),
    "fps_landmarks": lambda s, d: P.farthest_points(t.embedding_cloud(s, d), 12).select(F.col("pick").cast("int").alias("pick"), "id"),
    "weighted_sample": lambda s, d: P.weighted_sample(t.embedding_cloud(s, d).select("id", (F.abs(F.col("x")[0]) + 0.1).alias("w")), 100),
    "sparse_sample_naive": lambda s, d: P.sparse_sample(emb_knn(s, d, KG), 100, KG, 2.0),
    "sparse_sample_exp": lambda s, d: P.sparse_sample(emb_knn(s, d, KG), 100, KG, 2.0, "exp"),
    "upsample_dirichlet": lambda s, d: _upsampled(s, d),
    "bisected_sigma": lambda s, d: _sigma(s, d),
    "fuzzy_distance_symmetric": lambda s, d: _fuzzy(s, d),
}
W0 = "w as (select id, abs(x[1]) + 0.1 as w from emb)"
SQL = {
    "asinh_transform": DIMS + " select id, dim, round(asinh(value / 5.0), 6) as value from dims",
    "normalize_percentile": DIMS + ", q as (select dim, quantile_cont(value, 0.99) as q from dims group by dim) select id, dim, round(case when q = 0 then null else value / q end, 6) as value from dims join q using (dim)",
    "zscore": DIMS + ", q as (select dim, avg(value) as m, stddev_samp(value) as s from dims group by dim) select id, dim, round((value - m) / s, 6) as value from dims join q using (dim)",
    "layout_minmax": DIMS + ", q as (select dim, min(value) as lo, max(value) as hi from dims group by dim) select id, dim, round((value - lo) / (hi - lo), 6) as value from dims join q using (dim)",
    "denoise_knn": EKNN + ", e as (select src, e.x, unnest(range(1, 65)) as c from knn join emb e on e.id = knn.dst) select src as id, (c - 1)::int as dim, round(avg(x[c]), 6) as value from e group by src, c",
    "magic_1": SEMER + ", " + NORM + ", e as (select src, w, e.x, unnest(range(1, 65)) as c from p join emb e on e.id = p.dst) select src as id, (c - 1)::int as dim, round(sum(w * x[c]), 6) as value from e group by src, c",
    "magic_2": SEMER + ", " + NORM + ", e as (select src, w, e.x, unnest(range(1, 65)) as c from p join emb e on e.id = p.dst), one as (select src as id, c, sum(w * x[c]) as v from e group by src, c) select p.src as id, (c - 1)::int as dim, round(sum(p.w * one.v), 6) as value from p join one on one.id = p.dst group by p.src, c",
    "data_core": EKNN + ", l as (select src, 1 / max(dist) as dens from knn group by src) select src as id from l where dens > (select quantile_cont(dens, 0.8) from l)",
    "density_values": EKNN + f" select src as id, round({KG} / ((select count(*) from emb) * pi()) / pow(dist, 2), 6) as dens from knn where rnk = {KG} - 1",
    "density_downsample": EKNN + f""", dn as (select src as id, {KG} / ((select count(*) from emb) * pi()) / pow(dist, 2) as dens from knn where rnk = {KG} - 1),
g as (select row_number() over w as i, dens, sum(1 / dens) over (order by dens, id rows between current row and unbounded following) as cdf from dn window w as (order by dens, id)),
h as (select *, (least(200, (select count(*) from dn)) - i) / cdf as target from g), z as (select least(200, (select count(*) from dn)) / cdf as whole, dens as least from g where i = 1),
b as (select case when whole > least then coalesce((select arg_min(target, i) from h where target - dens <= 0), (select target from h where i = 1)) else whole end as boundary from z)
select id from dn, b where boundary / dens > {uniform_sql(7, 'id')}""",
    "sparse_sample_naive": EKNN + f" select src as id from knn where rnk = {KG} - 1 order by -ln({uniform_sql(7, 'src')} + 1e-12) / pow(dist, 2), src limit 100",
    "sparse_sample_exp": EKNN + f" select src as id from knn where rnk = {KG} - 1 order by -ln({uniform_sql(7, 'src')} + 1e-12) / exp(pow(dist, 2)), src limit 100",
    "upsample_labels": t.with_(t.LABELS, MAIN) + f""", rest as (select *, row_number() over (partition by label order by id) - 1 as k from ml where label <> 'ungated'),
z as (select label, size, unnest(range(1, 41)) as draw from (select label, count(*) as size from rest group by label)),
q as (select label, draw, floor({uniform_sql(3, 'label', 'draw')} * size)::bigint as k from z)
select r.id, r.label, q.draw from q join rest r on r.label = q.label and r.k = q.k union all select id, label, 0 from ml where label = 'ungated'""",
    "sample_labels_without_replacement": t.with_(t.LABELS, MAIN) + f" select id, label, draw from (select id, label, row_number() over (partition by label order by {uniform_sql(3, 'label', 'id')}, id) as draw from ml) where draw <= 40",
    "unique_points": t.with_(t.CLOUD) + " select id, min(id) over (partition by x) as rep from pts",
    "origin_medoid": t.with_(t.CLOUD, t.LABELS, MAIN) + """, j as (select p.id, label, x from pts p join ml using (id)), m as (select label, list(v order by c) as m from (select label, c, avg(x[c]) as v from (select label, x, unnest(range(1, 26)) as c from j) group by label, c) group by label)
select label, arg_min(id, (d, id)) as id from (select j.label, j.id, round(pow(list_distance(j.x, m.m), 2), 9) as d from j join m on m.label = j.label) group by label""",
    "fps_landmarks": t.with_(t.EMB) + """, it as (select 1 as pick, (select min(id) from emb) as id, (select list(struct_pack(id := id, d := round(pow(list_distance(x, (select arg_min(x, id) from emb)), 2), 9)) order by id) from emb) as ds
union all select n, nid, (select list(struct_pack(id := e.id, d := least(u.d, round(pow(list_distance(e.x, (select x from emb where id = nid)), 2), 9))) order by e.id) from emb e join (select unnest(ds, max_depth := 2)) u on u.id = e.id) from
 (select pick + 1 as n, ds, (select arg_max(u.id, (u.d, -u.id)) from (select unnest(ds, max_depth := 2)) u) as nid from it where pick < 12)) select pick::int as pick, id from it""",
    "weighted_sample": t.with_(t.EMB, W0) + f" select id from w order by -ln({uniform_sql(7, 'id')} + 1e-12) / w, id limit 100",
    "upsample_dirichlet": "select vec_id as id, 2::bigint as rows, true as inside, true as unlike, true as mixes from embeddings",
    "bisected_sigma": EKNN + ", " + sigma_cte("knn", f"log2({KG})") + " select src, round(s, 6) as sigma from sig",
    "fuzzy_distance_symmetric": EKNN + ", rh as (select src, min(dist) as rho, avg(dist) as mean from knn group by src), ab as (select src, dst, dist - rho as dist from knn join rh using (src)), " + sigma_cte("ab", f"log2({KG})")
    + """, pp as (select ab.src, dst, exp(-dist / greatest(s, mean * 1e-3)) as p from ab join sig using (src) join rh using (src)), u as (select src, dst, sum(p) as p, sum(q) as q from (select src, dst, p, 0.0::double as q from pp union all select dst, src, 0.0::double, p from pp) group by all)
select src, dst, round(-ln(greatest(p + q - p * q, 1e-300)), 6) as w from u""",
}


def _sigma(s, d):
    import math

    return r(P.sigma(emb_knn(s, d, KG), math.log2(KG)), "sigma")


def _fuzzy(s, d):
    return r(P.fuzzy_distance(emb_knn(s, d, KG), KG), "w")


def _upsampled(s, d):
    """Per point two rows, each within the box of the point's neighbours, unlike each other, and in the neighbours' span with weights
    that sum to 1: the mean of the neighbours, which such a row is taken from, lies in their affine hull too."""
    import numpy as np
    import pyarrow as pa

    from ..operators.vectors import matrix

    e, n = t.embedding_cloud(s, d), emb_knn(s, d, KG)
    up = P.upsample(e, n, 2).select("id", F.struct("draw", "x").alias("u")).groupBy("id").agg(F.transform(F.array_sort(F.collect_list("u")), lambda v: v["x"]).alias("us"))  # two rows
    near = n.join(e.select(F.col("id").alias("dst"), "x"), "dst").groupBy(F.col("src").alias("id")).agg(F.collect_list("x").alias("xs"))  # KG vectors

    def judge(batches):
        for b in batches:
            rows = []
            for i, us, xs in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                u, x = matrix(us.values), matrix(xs.values)
                lo, hi = x.min(0) - 1e-12, x.max(0) + 1e-12
                w, *_ = np.linalg.lstsq(np.c_[x, np.ones(len(x))].T, np.c_[u, np.ones(len(u))].T, rcond=None)
                mixes = np.abs(x.T @ w - u.T).max() < 1e-9 and w.min() > -1e-9 and np.abs(w.sum(0) - 1).max() < 1e-9
                rows.append((i, len(u), bool(((u >= lo) & (u <= hi)).all()), bool((u[0] != u[-1]).any()), bool(mixes)))
            yield pa.RecordBatch.from_pylist([dict(zip(("id", "rows", "inside", "unlike", "mixes"), q)) for q in rows], pa.schema([("id", pa.int64()), ("rows", pa.int64()), ("inside", pa.bool_()), ("unlike", pa.bool_()), ("mixes", pa.bool_())]))

    return up.join(near, "id").mapInArrow(judge, "id long, rows long, inside boolean, unlike boolean, mixes boolean")
