"""Queries of clustering, simplicial complexes and homology, over the first three dimensions of all embeddings.

The queries named ``_whole`` take all dimensions, every SHARE-th id as landmark and the lists and alpha of the reference.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.ordered import numbered
from ..functions.scalars import with_scalars
from ..operators import cluster as C
from ..operators import complexes as X
from ..operators import homology as G
from ..operators import knn as N
from ..operators import points as P
from ..operators import sparse as M
from ..operators import walks as W
from ..sources import tables as t
from ..sources.shared import written
from .base import emb_knn, knn_sql
from .graphs import KG, SYM, r
from .sequences import ACYCLIC, CONTRACT, N_WALKS, SIM, oriented, simulated

LANDMARKS, KW, ALPHA, REACH = 16, 8, 0.02, 0.16
#: Of the whole complexes: a landmark in so many ids, and landmarks in a list.
SHARE, KWHOLE = 10, 30


def cloud3(s, d):
    return t.embedding_cloud(s, d).select("id", F.slice("x", 1, 3).alias("x"))


def landmarks(s, d):
    p = cloud3(s, d)
    return written(p.join(F.broadcast(P.farthest_points(p, LANDMARKS)), "id").select("id", "x"), "landmarks")  # LANDMARKS rows


def lists(s, d, marks):
    """Every point's nearest landmarks; a landmark's own entry, at distance 0, included."""
    near = N.nearest(cloud3(s, d), marks, KW)
    own = marks.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0).alias("rnk"), F.lit(0.0).alias("dist"))
    both = near.unionByName(own)
    return written(N.reorder(both).where(F.col("rnk") <= KW), "lists")


def whole(s, d):
    """Landmarks and lists in all dimensions, and alpha, the mean distance to the last landmark of a list."""
    p = t.embedding_cloud(s, d).select("id", "x")
    marks = written(p.where(F.col("id") % SHARE == 0), "landmarks")
    own = marks.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0).alias("rnk"), F.lit(0.0).alias("dist"))
    n = written(N.reorder(N.nearest(p, marks, KWHOLE).unionByName(own)).where(F.col("rnk") <= KWHOLE), "lists")
    alpha = n.groupBy("src").agg(F.max("dist").alias("m")).agg(F.round(F.avg("m"), 6)).first()[0]
    return marks, n, alpha


def whole_rips(s, d):
    m, _, alpha = whole(s, d)
    return X.rips(pair_distances(m, m.count() - 1), alpha)


def pair_distances(marks, n=LANDMARKS - 1):
    return N.knn(marks, n).select("src", "dst", F.col("dist").alias("w"))


def verts(df):
    return df.withColumn("verts", F.array_join(F.transform("verts", lambda v: v.cast("string")), ","))


def witness(s, d):
    m = landmarks(s, d)
    n = lists(s, d, m)
    return m, written(X.expand(X.witness_vertices(n, ALPHA), X.witness_edges(n, ALPHA)), "complex")


def filtration(s, d):
    m, c = witness(s, d)
    return m, written(X.skeleton(c, m, 2), "filtration")


BASE = t.with_(t.EMB, "e3 as (select id, x[1:3] as x from emb)", f"""fps as (select 1 as pick, (select min(id) from emb) as cur, id, round(pow(list_distance(x, (select arg_min(x, id) from e3)), 2), 9) as d from e3
  union all select pick + 1, nid, q.id, least(q.d, round(pow(list_distance(a.x, b.x), 2), 9)) from (select *, arg_max(id, (d, -id)) over () as nid from fps where pick < {LANDMARKS}) q join e3 a on a.id = q.id join e3 b on b.id = q.nid)""", "lm as (select id, x from e3 where id in (select cur from fps))") + ", "
WIT = BASE + f"""wl as (select * from (select p.id as w, l.id as l, list_distance(p.x, l.x) as dist, row_number() over (partition by p.id order by list_distance(p.x, l.x), l.id) as rnk from e3 p, lm l) where rnk <= {KW}),
wd as (select *, min(dist) over (partition by w) as d1, min(case when rnk = 2 then dist end) over (partition by w) as d2 from wl),
vt as (select distinct l as v from wd where dist <= d1 + {ALPHA}),
pe as (select a.l as la, b.l as lb, b.dist as db, a.d1, a.d2, a.rnk as ra, b.rnk as rb from wd a join wd b on a.w = b.w and a.rnk < b.rnk),
ed as (select distinct least(la, lb) as a, greatest(la, lb) as b from pe where db <= case when ra = 1 and rb = 2 then db when ra = 1 then d2 else d1 end + {ALPHA} and la in (select v from vt) and lb in (select v from vt)),
tr as (select x.a, x.b, y.b as c from ed x join ed y on y.a = x.a and x.b < y.b join ed z on z.a = x.b and z.b = y.b)"""
DIST = "pd as (select a.id as a, b.id as b, list_distance(a.x, b.x) as w from lm a join lm b on a.id < b.id)"
ALPHAV = WIT + ", " + DIST + """, tv as (select tr.a, tr.b, tr.c, pow(p.w, 2) as x, pow(q.w, 2) as y, pow(s.w, 2) as z from tr join pd p on p.a = tr.a and p.b = tr.b join pd q on q.a = tr.a and q.b = tr.c join pd s on s.a = tr.b and s.b = tr.c),
t2 as (select a, b, c, x * y * z / (2 * (x * y + x * z + y * z) - (x * x + y * y + z * z)) as value from tv),
gb as (select ed.a, ed.b, pow(pd.w, 2) / 4 as h, (select min(list_distance(l.x, [(p.x[1] + q.x[1]) / 2, (p.x[2] + q.x[2]) / 2, (p.x[3] + q.x[3]) / 2])) from lm l) as near from ed join pd using (a, b) join lm p on p.id = ed.a join lm q on q.id = ed.b),
cf as (select a, b, min(value) as up from (select a, b, value from t2 union all select a, c, value from t2 union all select b, c, value from t2) group by all),
sx as (select v::varchar as verts, 0 as dim, 0.0::double as value from vt union all select gb.a || ',' || gb.b, 1, case when near * near >= h * (1 - 1e-9) then h else coalesce(up, h) end from gb left join cf using (a, b) union all select a || ',' || b || ',' || c, 2, value from t2)"""
RIPS = BASE + DIST + f""", re as (select * from pd where w <= {REACH}), rt as (select x.a, x.b, y.b as c, greatest(x.w, y.w, z.w) as w from re x join re y on y.a = x.a and x.b < y.b join re z on z.a = x.b and z.b = y.b)"""

QUERIES = {
    "nearest_landmark": lambda s, d: _nearest(s, d),
    "witness_vertices": lambda s, d: X.witness_vertices(lists(s, d, landmarks(s, d)), ALPHA),
    "witness_edges": lambda s, d: X.witness_edges(lists(s, d, landmarks(s, d)), ALPHA),
    "witness_triangles": lambda s, d: X.triangles(written(X.witness_edges(lists(s, d, landmarks(s, d)), ALPHA), "edges")),
    "strong_witness_edges": lambda s, d: r(X.strong_witness_edges(lists(s, d, landmarks(s, d)), ALPHA), "value"),
    "rips_complex": lambda s, d: r(verts(X.rips(pair_distances(landmarks(s, d)), REACH)), "value"),
    "graph_complex": lambda s, d: r(verts(X.graph_complex(M.distances(emb_knn(s, d, KG)))), "value"),
    "alpha_values": lambda s, d: r(verts(filtration(s, d)[1]).select("verts", "dim", "value"), "value"),
    "rips_values": lambda s, d: r(verts(X.rips_values(*reversed(witness(s, d)))), "value"),
    "pairwise_values": lambda s, d: r(verts(X.pairwise_values(*reversed(witness(s, d)))), "value"),
    "skeleton_1": lambda s, d: _skeleton(s, d),
    "boundary": lambda s, d: _boundary(s, d),
    "cofaces": lambda s, d: _cofaces(s, d),
    "filtration_union": lambda s, d: _union(s, d),
    "relative_filtration": lambda s, d: _relative(s, d),
    "reindexed_complex": lambda s, d: _reindexed(s, d),
    "reduced_columns": lambda s, d: _reduced(s, d),
    "reduced_lower_bound": lambda s, d: _bounded(s, d),
    "betti_0": lambda s, d: _betti(s, d),
    "euler_characteristic": lambda s, d: _euler(s, d),
    "persistence_pairs": lambda s, d: _merges(s, d),
    "strong_witness_complex": lambda s, d: r(verts(X.strong_witness(lists(s, d, landmarks(s, d)), ALPHA)), "value"),
    "strong_witness_cliques": lambda s, d: _strong_cliques(s, d),
    "grid_complex": lambda s, d: _grid_complex(s, d),
    "persistence_diagram": lambda s, d: _diagram(s, d),
    "walk_cycles": lambda s, d: _cycles(s, d),
    "walk_classes": lambda s, d: _classes(s, d),
    "walk_dendrogram": lambda s, d: _tree(s, d),
    "tda_scan": lambda s, d: _scan(s, d),
    "kmeans_assignment": lambda s, d: _kmeans(s, d),
    "kmeans_centres": lambda s, d: _centres(s, d),
    "given_clusters": lambda s, d: _given(s, d),
    "grid_triangulation": lambda s, d: C.grid_triangulation(s, 12, 9, 10),
    "louvain_partition": lambda s, d: _louvain(s, d),
    "clique_communities": lambda s, d: C.clique_communities(M.symmetrize(M.distances(emb_knn(s, d, 4))).where("src < dst").select(F.col("src").alias("a"), F.col("dst").alias("b")), 3).select("least", "size", "id"),
    "index_path_edges": lambda s, d: _indexed(s, d),
    "nearest_landmark_whole": lambda s, d: whole(s, d)[1].where("rnk = 1").select(F.col("src").alias("id"), F.col("dst").alias("landmark")),
    "witness_vertices_whole": lambda s, d: (lambda m, n, a: X.witness_vertices(n, a))(*whole(s, d)),
    "witness_edges_whole": lambda s, d: (lambda m, n, a: X.witness_edges(n, a))(*whole(s, d)),
    "witness_triangles_whole": lambda s, d: (lambda m, n, a: X.triangles(written(X.witness_edges(n, a), "edges")))(*whole(s, d)),
    "strong_witness_edges_whole": lambda s, d: (lambda m, n, a: r(X.strong_witness_edges(n, a), "value"))(*whole(s, d)),
    "rips_complex_whole": lambda s, d: r(verts(whole_rips(s, d)), "value"),
}
SQL = {
    "nearest_landmark": BASE + "n as (select p.id, l.id as landmark, row_number() over (partition by p.id order by list_distance(p.x, l.x), l.id) as r from e3 p, lm l) select id, landmark from n where r = 1",
    "witness_vertices": WIT + " select v from vt",
    "witness_edges": WIT + " select a, b from ed",
    "witness_triangles": WIT + " select a, b, c from tr",
    "strong_witness_edges": WIT + f" select least(la, lb) as a, greatest(la, lb) as b, round(min(db - d1), 6) as value from pe where db < d1 + {ALPHA} group by 1, 2",
    "rips_complex": RIPS + " select id::varchar as verts, 0.0 as value from lm union all select a || ',' || b, round(w, 6) from re union all select a || ',' || b || ',' || c, round(w, 6) from rt",
    "graph_complex": t.with_(t.EMB, knn_sql(KG)) + ", ge as (select least(src, dst) as a, greatest(src, dst) as b, min(dist) as w from knn group by all) select a || ',' || b as verts, round(w, 6) as value from ge union all select id::varchar, 0.0 from emb",
    "alpha_values": ALPHAV + " select verts, dim, round(value, 6) as value from sx",
    "rips_values": WIT + ", " + DIST + ", e1 as (select a, b, w from ed join pd using (a, b)) select v::varchar as verts, 0.0 as value from vt union all select a || ',' || b, round(w, 6) from e1 union all select tr.a || ',' || tr.b || ',' || tr.c, round(greatest(p.w, q.w, s.w), 6) from tr join pd p on p.a = tr.a and p.b = tr.b join pd q on q.a = tr.a and q.b = tr.c join pd s on s.a = tr.b and s.b = tr.c",
    "pairwise_values": WIT + ", " + DIST + ", e1 as (select a, b, w from ed join pd using (a, b)) select v::varchar as verts, 0.0 as value from vt union all select a || ',' || b, round(w, 6) from e1 union all select tr.a || ',' || tr.b || ',' || tr.c, round(greatest(p.w, q.w, s.w) + 1e-7, 6) from tr join pd p on p.a = tr.a and p.b = tr.b join pd q on q.a = tr.a and q.b = tr.c join pd s on s.a = tr.b and s.b = tr.c",
    "skeleton_1": WIT + ", " + DIST + " select v::varchar as verts, 0 as dim from vt union all select a || ',' || b, 1 from ed",
    "boundary": WIT + " select a || ',' || b as verts, 2 as faces, a || ';' || b as named from ed union all select a || ',' || b || ',' || c, 3, a || ',' || b || ';' || a || ',' || c || ';' || b || ',' || c from tr union all select v::varchar, 0, '' from vt",
    "cofaces": WIT + ", ff as (select a || ',' || b as f, a || ',' || b || ',' || c as u from tr union all select a || ',' || c, a || ',' || b || ',' || c from tr union all select b || ',' || c, a || ',' || b || ',' || c from tr union all select a::varchar, a || ',' || b from ed union all select b::varchar, a || ',' || b from ed), al as (select v::varchar as verts from vt union all select a || ',' || b from ed union all select a || ',' || b || ',' || c from tr) select verts, coalesce(u, '-') as coface from al left join ff on f = verts",
    "relative_filtration": WIT + ", md as (select median(v) as m from vt) select v::varchar as verts from vt, md where v <= m union all select a || ',' || b from ed, md where b <= m union all select a || ',' || b || ',' || c from tr, md where c <= m",
    "reindexed_complex": WIT + ", nm as (select id as v, dense_rank() over (order by id) as n from lm) select n::varchar as verts from vt join nm using (v) union all select p.n || ',' || q.n from ed join nm p on p.v = a join nm q on q.v = b union all select p.n || ',' || q.n || ',' || s.n from tr join nm p on p.v = a join nm q on q.v = b join nm s on s.v = c",
    "reduced_columns": ALPHAV + " select row_number() over (order by 1) - 1 as sidx, true as holds from sx",
    "euler_characteristic": WIT + ", cc as (select v, v as r from vt union select case when cc.v = ed.a then ed.b else ed.a end, cc.r from cc join ed on cc.v in (ed.a, ed.b)), b as (select count(distinct r) as b from (select v, min(r) as r from cc group by v)), e as (select (select count(*) from vt) - (select count(*) from ed) + (select count(*) from tr) as e) select e::bigint as euler, b::bigint as betti_0, (b - e)::bigint as betti_1_less_2 from b, e",
    "kmeans_assignment": t.with_(t.EMB) + " select id, true as holds from emb",
    "kmeans_centres": "select true as holds",
    "given_clusters": t.with_(t.CLOUD, t.CLUSTERS) + ", u as (select id, dense_rank() over (order by cluster) as c from clu where cluster is not null) select c as cluster, count(*) as n, round(avg(x[1]) + 3.3e-10, 6) as x from u join pts using (id) group by c",
    "grid_triangulation": "with u as (select i + 1 as u, i % 12 as x, i // 12 as y from range(108) t(i)), k as (select list_sort(list(x + y))[11] as k from u) select p.u as a, q.u as b from u p join u q on p.u < q.u cross join k where abs(p.x - q.x) + abs(p.y - q.y) <= k",
    "louvain_partition": "select vec_id as id, true as holds from embeddings",
    "walk_cycles": f"select unnest(range(2, {N_WALKS + 1})) as walk_id, true as even",
    "walk_dendrogram": f"select unnest(range(2, {N_WALKS + 1})) as walk_id, true as named",
    "clique_communities": t.with_(t.EMB, knn_sql(4)) + """, ge as (select distinct least(src, dst) as a, greatest(src, dst) as b from knn), q3 as (select row_number() over (order by x.a, x.b, y.b) as q, x.a, x.b, y.b as c from ge x join ge y on y.a = x.a and x.b < y.b join ge z on z.a = x.b and z.b = y.b),
fc as (select q, a as u, b as v from q3 union all select q, a, c from q3 union all select q, b, c from q3), ln as (select distinct f.q as p, g.q as q from fc f join fc g on f.u = g.u and f.v = g.v), rc as (select q, q as r from q3 union select ln.q, rc.r from rc join ln on ln.p = rc.q),
rt as (select q, min(r) as r from rc group by q), mm as (select distinct r, unnest([a, b, c]) as id from q3 join rt using (q)) select min(id) over (partition by r) as least, count(*) over (partition by r) as size, id from mm""",
}
EDGE_VALUES = ALPHAV + ", ev as (select gb.a, gb.b, case when near * near >= h * (1 - 1e-9) then h else coalesce(up, h) end as value from gb left join cf using (a, b)), es as (select *, row_number() over (order by value, a, b) as k from ev)"
STRONG = WIT + f""", nr as (select w, l as v, dist - d1 as o from wd where dist - d1 < {ALPHA}), s1 as (select v, min(o) as value from nr group by v),
p2 as (select p.w, p.v as a, q.v as b, greatest(p.o, q.o) as o from nr p join nr q on p.w = q.w and p.v < q.v), s2 as (select a, b, min(o) as value from p2 group by a, b)"""
#: A 4 x 3 grid whose units are the first twelve embeddings; edges within the fifth smallest city-block distance from the corner.
GRID_UNITS = t.with_(t.EMB, "e3 as (select id, x[1:3] as x from emb)", "lm as (select row_number() over (order by id) as id, x from e3 order by id limit 12)", """u as (select id as u, (id - 1) % 4 as x, (id - 1) // 4 as y from lm), th as (select list_sort(list(x + y))[5] as th from u),
vt as (select id as v from lm), ed as (select p.u as a, q.u as b from u p join u q on p.u < q.u, th where abs(p.x - q.x) + abs(p.y - q.y) <= th), tr as (select x.a, x.b, y.b as c from ed x join ed y on y.a = x.a and x.b < y.b join ed z on z.a = x.b and z.b = y.b)""")
SQL |= {
    # an edge merges two components if those of its ends by earlier edges differ; the younger one, of larger least vertex, ends
    "persistence_pairs": EDGE_VALUES + """, cc as (select k, 1 as side, a as v from es union select k, 2, b from es union select cc.k, side, case when es.a = cc.v then es.b else es.a end from cc join es on es.k < cc.k and cc.v in (es.a, es.b)),
mn as (select k, min(v) filter (where side = 1) as p, min(v) filter (where side = 2) as q from cc group by k) select greatest(p, q) as born, a || ',' || b as merged_by, round(value, 6) as death from es join mn using (k) where p <> q""",
    "strong_witness_complex": STRONG + ", s3 as (select a, b, v as c, min(greatest(p2.o, nr.o)) as value from p2 join nr on nr.w = p2.w and nr.v > p2.b group by 1, 2, 3) select v::varchar as verts, round(value, 6) as value from s1 union all select a || ',' || b, round(value, 6) from s2 union all select a || ',' || b || ',' || c, round(value, 6) from s3",
    "strong_witness_cliques": STRONG + " select v::varchar as verts, round(value, 6) as value from s1 union all select a || ',' || b, round(value, 6) from s2 union all select x.a || ',' || x.b || ',' || y.b, round(greatest(x.value, y.value, z.value), 6) from s2 x join s2 y on y.a = x.a and x.b < y.b join s2 z on z.a = x.b and z.b = y.b",
    "grid_complex": GRID_UNITS + ALPHAV[len(WIT):] + " select verts, dim, round(value, 6) as value from sx",
}
#: Walks over the embeddings at their nearest landmarks, contracted, without cycles, led to the most frequent end.
LANDMARK_WALKS = SIM + ",\n" + WIT.split(t.EMB + ",\n", 1)[1] + ", clu as (select w as id, l as cluster from wl where rnk = 1), wlk as (select walk_id, step, v from sim), " + CONTRACT + ", " + ACYCLIC.format(src="ctr") + """,
ls as (select walk_id, arg_max(v, step) as v, max(step) as step from acy group by walk_id), tp as (select v as e from ls group by v order by count(*) desc, v limit 1),
endd as (select walk_id, step, v from acy union all select walk_id, step + 1, e from ls, tp where v <> e)"""
SQL["index_path_edges"] = LANDMARK_WALKS + ", ep as (select * from (select walk_id, step, v as src, lead(v) over (partition by walk_id order by step) as dst from endd) where dst is not null) select walk_id, count(*) as steps from ep join ed on ed.a = least(src, dst) and ed.b = greatest(src, dst) group by walk_id"
SQL["filtration_union"] = BASE + RIPS[len(BASE):] + ", " + WIT[len(BASE):] + ", al as (select id::varchar as verts from lm union select a || ',' || b from re union select a || ',' || b || ',' || c from rt union select v::varchar from vt union select a || ',' || b from ed union select a || ',' || b || ',' || c from tr) select verts from al"
WHOLE = t.with_(t.EMB) + f""", lm as (select id, x from emb where id % {SHARE} = 0),
wl as (select * from (select p.id as w, l.id as l, list_distance(p.x, l.x) as dist, row_number() over (partition by p.id order by list_distance(p.x, l.x), l.id) as rnk from emb p, lm l) where rnk <= {KWHOLE}),
al as (select round(avg(m), 6) as al from (select max(dist) as m from wl group by w)),
wd as (select *, min(dist) over (partition by w) as d1, min(case when rnk = 2 then dist end) over (partition by w) as d2 from wl),
vt as (select distinct l as v from wd, al where dist <= d1 + al),
pe as (select a.l as la, b.l as lb, b.dist as db, a.d1, a.d2, a.rnk as ra, b.rnk as rb, al from wd a join wd b on a.w = b.w and a.rnk < b.rnk cross join al),
ed as (select distinct least(la, lb) as a, greatest(la, lb) as b from pe where db <= case when ra = 1 and rb = 2 then db when ra = 1 then d2 else d1 end + al and la in (select v from vt) and lb in (select v from vt)),
re as (select a.id as a, b.id as b, list_distance(a.x, b.x) as w from lm a join lm b on a.id < b.id, al where list_distance(a.x, b.x) <= al)"""
CLIQUES = "select x.a, x.b, y.b as c from ed x join ed y on y.a = x.a and x.b < y.b join ed z on z.a = x.b and z.b = y.b"
SQL |= {
    "nearest_landmark_whole": WHOLE + " select w as id, l as landmark from wl where rnk = 1",
    "witness_vertices_whole": WHOLE + " select v from vt",
    "witness_edges_whole": WHOLE + " select a, b from ed",
    "witness_triangles_whole": WHOLE + " " + CLIQUES,
    "strong_witness_edges_whole": WHOLE + " select least(la, lb) as a, greatest(la, lb) as b, round(min(db - d1), 6) as value from pe where db < d1 + al group by 1, 2",
    "rips_complex_whole": WHOLE + " select id::varchar as verts, 0.0 as value from lm union all select a || ',' || b, round(w, 6) from re union all select x.a || ',' || x.b || ',' || y.b, round(greatest(x.w, y.w, z.w), 6) from re x join re y on y.a = x.a and x.b < y.b join re z on z.a = x.b and z.b = y.b",
}
SQL["betti_0"] = WIT + ", cc as (select v, v as r from vt union select case when cc.v = ed.a then ed.b else ed.a end, cc.r from cc join ed on cc.v in (ed.a, ed.b)) select count(distinct r) as betti_0 from (select v, min(r) as r from cc group by v)"


def _nearest(s, d):
    m = landmarks(s, d)
    return lists(s, d, m).where("rnk = 1").select(F.col("src").alias("id"), F.col("dst").alias("landmark"))


def _skeleton(s, d):
    m, c = witness(s, d)
    return verts(X.skeleton(c, m, 1, "rips")).select("verts", "dim")


def _boundary(s, d):
    _, f = filtration(s, d)
    b = X.boundary(f)
    # faces sorted as sets of numbers, to be named alike in SQL
    byset = b.select("sidx", F.explode("faces").alias("f")).join(f.select(F.col("sidx").alias("f"), F.col("verts").alias("face")), "f").groupBy("sidx").agg(F.array_join(F.transform(F.sort_array(F.collect_list("face")), lambda v: F.array_join(F.transform(v, lambda x: x.cast("string")), ",")), ";").alias("named"))
    return verts(f).select("sidx", "verts").join(b.select("sidx", F.size("faces").alias("faces")), "sidx").join(byset, "sidx", "left").select("verts", "faces", F.coalesce("named", F.lit("")).alias("named"))


def _cofaces(s, d):
    _, f = filtration(s, d)
    n = verts(f).select("sidx", "verts")
    c = X.cofaces(f).join(n, "sidx")
    return c.join(n.select(F.col("sidx").alias("coface"), F.col("verts").alias("up")), "coface", "left").select("verts", F.coalesce("up", F.lit("-")).alias("coface"))


def _union(s, d):
    m, c = witness(s, d)
    a = X.rips(pair_distances(m), REACH)
    return verts(X.union(a, X.rips_values(c, m))).select("verts")


def _relative(s, d):
    _, f = filtration(s, d)
    v = f.where("dim = 0").select(F.col("verts")[0].alias("v"))
    mid = v.agg(F.percentile("v", 0.5)).first()[0]
    return verts(X.relative(f, v.where(F.col("v") <= mid))).select("verts")


def _reindexed(s, d):
    from pyspark.sql import Window

    m, c = witness(s, d)
    names = m.select(F.col("id").alias("v"), F.row_number().over(Window.orderBy("id")).alias("name"))
    return verts(X.reindex(X.index(X.rips_values(c, m)), names)).select("verts")


def _reduction(s, d):
    m, f = filtration(s, d)
    b = written(X.boundary(f), "boundary")
    return m, f, b, written(G.reduce_boundary(b), "reduced")


def _reduced(s, d):
    """Certificate per simplex: no two reduced columns share a low, a killed simplex kills nothing, and the boundary of every
    reduced column's entries vanishes."""
    _, f, b, red = _reduction(s, d)
    lows = red.groupBy("low").agg(F.count("*").alias("n"), F.first("col").alias("col"))
    e = red.select("col", F.explode("entries").alias("sidx")).join(b.select("sidx", F.explode("faces").alias("f")), "sidx")
    odd = e.groupBy("col", "f").agg(F.count("*").alias("n")).where("n % 2 = 1").select("col").distinct().withColumn("odd", F.lit(1))
    out = f.select("sidx").join(lows.select(F.col("low").alias("sidx"), "n"), "sidx", "left").join(red.select(F.col("col").alias("sidx"), F.lit(1).alias("kills")), "sidx", "left").join(odd.withColumnRenamed("col", "sidx"), "sidx", "left")
    return out.select(F.col("sidx").cast("long").alias("sidx"), (F.col("odd").isNull() & (F.coalesce("n", F.lit(1)) == 1) & ~(F.col("n").isNotNull() & F.col("kills").isNotNull())).alias("holds"))


def _bounded(s, d):
    _, f, _, red = _reduction(s, d)
    cut = f.where("dim = 0").count()
    low = X.lower_bound(red, cut)
    return low.select("col", "low", (F.col("low") > cut).alias("above"), F.size("entries").alias("entries"))


def _betti(s, d):
    _, f, _, red = _reduction(s, d)
    return f.where("dim = 0").agg(F.count("*").alias("v")).transform(lambda t: with_scalars(t, red.where("dim = 0").agg(F.count("*").alias("k")))).select((F.col("v") - F.col("k")).alias("betti_0"))


def _euler(s, d):
    """V - E + T, and of the reduction the components and how many more loops than voids there are."""
    _, f, _, red = _reduction(s, d)
    n = {row["dim"]: row["count"] for row in f.groupBy("dim").count().collect()}  # three rows
    k = {row["dim"]: row["count"] for row in red.groupBy("dim").count().collect()}
    b = {i: n.get(i, 0) - k.get(i - 1, 0) - k.get(i, 0) for i in range(3)}
    euler = n.get(0, 0) - n.get(1, 0) + n.get(2, 0)
    return s.createDataFrame([(euler, b[0], b[1] - b[2])], "euler long, betti_0 long, betti_1_less_2 long")


def _pairs(s, d):
    """Classes of positive dimension, essential ones among them."""
    _, f, _, red = _reduction(s, d)
    return G.with_essential(G.pairs_of(red, f).where("dim > 0"), G.essential(red, f).where("dim > 0"))


def _merges(s, d):
    """The finite classes of dimension 0, by the vertex that began them and the edge that ended them."""
    _, f, _, red = _reduction(s, d)
    p = G.pairs_of(red, f, zero=True).where("dim = 0")
    n = f.select("sidx", "verts")
    p = p.join(n.select(F.col("sidx").alias("birth_idx"), F.col("verts")[0].alias("born")), "birth_idx").join(verts(n).select(F.col("sidx").alias("death_idx"), F.col("verts").alias("merged_by")), "death_idx")
    return r(p.select("born", "merged_by", "death"), "death")


def _strong_cliques(s, d):
    c = written(X.strong_witness(lists(s, d, landmarks(s, d)), ALPHA), "strong")
    v = c.where(F.size("verts") == 1).select(F.col("verts")[0].alias("v"), "value")
    e = c.where(F.size("verts") == 2).select(F.col("verts")[0].alias("a"), F.col("verts")[1].alias("b"), "value")
    return r(verts(X.clique_complex(v, e)), "value")


def _grid_complex(s, d):
    first = cloud3(s, d).orderBy("id").limit(12)
    codes = numbered(first, [], [F.col("id")], "cluster").select("cluster", "x")
    return r(verts(C.grid_complex(codes, 4, 3, 4)).select("verts", "dim", "value"), "value")


def _diagram(s, d):
    return r(G.diagram(_pairs(s, d)), "x", "y")


def landmark_walks(s, d):
    """Simulated walks over the embeddings, each vertex at its nearest landmark, contracted, all begun and ended alike."""
    m, f, b, red = _reduction(s, d)
    near = lists(s, d, m).where("rnk = 1").select(F.col("src").alias("id"), F.col("dst").alias("cluster"))
    w = written(W.contract(written(simulated(s, d)[0], "walks"), near), "contracted")
    w = written(W.remove_cycles(w), "acyclic")
    end = W.termini(w).groupBy("v").count().orderBy(F.desc("count"), "v").first()["v"]
    return m, f, b, red, written(W.add_terminus(w, end), "ended")


def _chains(s, d):
    m, f, b, red, w = landmark_walks(s, d)
    chains = written(G.triangulate(w, f, m), "chains")
    return m, f, b, red, w, written(G.cycles_against(chains, 1), "cycles")


def _cycles(s, d):
    """Every walk against walk 1 is a cycle: an even number of its edges meets in every vertex."""
    _, f, b, _, w, cycles = _chains(s, d)
    deg = cycles.join(b.select(F.col("sidx").alias("e"), F.explode("faces").alias("v")), "e").groupBy("walk_id", "v").agg(F.count("*").alias("n"))
    bad = deg.where("n % 2 = 1").select("walk_id").distinct().withColumn("bad", F.lit(1))
    return w.where("walk_id <> 1").select("walk_id").distinct().join(bad, "walk_id", "left").select("walk_id", F.col("bad").isNull().alias("even"))


def _represented(s, d):
    _, f, _, red, w, cycles = _chains(s, d)
    got = written(G.represent(cycles, red), "classes")
    every = w.where("walk_id <> 1").select("walk_id").distinct().join(got, "walk_id", "left").select("walk_id", F.coalesce("classes", F.array().cast("array<int>")).alias("classes"))
    return f, red, every


def _classes(s, d):
    return _represented(s, d)[2].select("walk_id", F.size("classes").alias("classes"))


def _tree(s, d):
    f, red, c = _represented(s, d)
    death = {row["death_idx"]: row["death"] for row in G.pairs_of(red, f).where("dim = 1").collect()}  # classes of the complex
    death |= {row["c"]: float("inf") for row in c.select(F.explode("classes").alias("c")).where("c < 0").distinct().collect()}
    kept = written(G.restrict(c, s.createDataFrame([(k,) for k in death], "c int")), "kept")
    tree = written(G.dendrogram(kept, death), "tree").join(kept, "walk_id")
    # walks share a leaf where their classes agree, and only there
    a, b = tree.groupBy("leaf").agg(F.min("walk_id").alias("by_leaf")), tree.groupBy("classes").agg(F.min("walk_id").alias("by_classes"))
    return tree.join(a, "leaf").join(b, "classes").select("walk_id", (F.col("leaf").startswith("ROOT") & (F.col("by_leaf") == F.col("by_classes"))).alias("named"))


def _scan(s, d):
    """Pairs of classes in the Rips complex of each superlevel set of the landmarks by distance to the first."""
    from ..operators.vectors import squared_distance

    m = landmarks(s, d)
    first = m.agg(F.min_by("x", "id").alias("o"))
    times = with_scalars(m, first).select("id", F.sqrt(squared_distance("x", "o")).alias("pt"))
    out = None
    for n, q in enumerate(times.agg(F.percentile("pt", [0.0, 0.5])).first()[0]):
        part = X.time_slices(m, times, [q])[q]
        f = written(X.index(X.rips(pair_distances(part), REACH * 2)), "slice")
        red = G.reduce_boundary(X.boundary(f))
        got = G.pairs_of(red, f).groupBy("dim").agg(F.count("*").alias("classes")).select(F.lit(n).alias("slice"), "dim", "classes")
        out = got if out is None else out.unionByName(got)
    return out


def _kmeans(s, d):
    """Every point's cluster is the one of its nearest centre, by distances to all centres in Spark's own arithmetic."""
    p = t.embedding_cloud(s, d)
    a, codes = C.kmeans(p, 8)
    far = [F.aggregate(F.zip_with("x", F.array(*[F.lit(float(v)) for v in c]), lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda s, v: s + v) for c in codes]
    both = a.join(p.select("id", F.array(*far).alias("d2")), "id")
    return both.select("id", (F.get("d2", (F.col("cluster") - 1).cast("int")) <= F.array_min("d2") + 1e-9).alias("holds"))


def _centres(s, d):
    from ..operators.vectors import avg_vector, matrix

    p = t.embedding_cloud(s, d)
    a, codes = C.kmeans(p, 8, rounds=100)
    m = matrix(avg_vector(p.join(a, "id"), ["cluster"], 64).orderBy("cluster").toArrow().column("x"))  # 8 rows
    return s.createDataFrame([(bool(np.allclose(m, codes, atol=1e-9)),)], "holds boolean")


def _given(s, d):
    a, codes = C.given_clusters(t.cloud(s, d), t.clusters(s, d).select("id", "cluster"), 25)
    n = a.join(t.cloud(s, d).select("id"), "id").groupBy("cluster").agg(F.count("*").alias("n"))
    return codes.join(n, "cluster").select("cluster", "n", F.round(F.col("x")[0] + 3.3e-10, 6).alias("x"))


def _louvain(s, d):
    """Every vertex has one community; modularity is above that of single vertices (at most 0), and no two communities would have
    more of it as one, by evidence per vertex for its own community."""
    e = written(M.symmetrize(M.distances(emb_knn(s, d, KG))), "edges")
    mc = C.louvain(e)
    a, b = mc.select(F.col("id").alias("src"), F.col("mc").alias("p")), mc.select(F.col("id").alias("dst"), F.col("mc").alias("q"))
    both = e.join(a, "src").join(b, "dst")
    total = e.agg(F.sum("w")).first()[0]
    inside = both.where("p = q").agg(F.sum("w")).first()[0]
    degree = written(both.groupBy("p").agg(F.sum("w").alias("d")), "degree")
    deg = degree.agg(F.sum(F.col("d") * F.col("d"))).first()[0]
    links = both.where("p <> q").groupBy("p", "q").agg(F.sum("w").alias("w")).join(degree, "p").join(degree.select(F.col("p").alias("q"), F.col("d").alias("e")), "q")
    gain = links.groupBy(F.col("p").alias("mc")).agg(F.max(F.col("w") - F.col("d") * F.col("e") / total).alias("gain"))
    return mc.join(gain, "mc", "left").select("id", ((F.coalesce("gain", F.lit(0.0)) <= 1e-9 * total) & F.lit(inside / total - deg / total**2 > 0)).alias("holds"))


def _indexed(s, d):
    _, f, _, _, w = landmark_walks(s, d)
    return W.index_edges(w, f).groupBy("walk_id").agg(F.count("*").alias("steps"))
