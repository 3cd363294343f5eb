"""Queries of walks, flow between communities and trackers, over the walks, points, clusters, labels and pseudotime tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashrand import uniform, uniform_sql
from ..functions.scalars import with_scalars
from ..operators import flow as C
from ..operators import knn as N
from ..operators import sparse as M
from ..operators import track as V
from ..operators import walks as W
from ..sources import tables as t
from ..sources.shared import written
from .clouds import MAIN, main_labels
from .base import emb_knn
from .graphs import KG, NORM, ORIENTED, ORIGIN_DIST, SEMER, oriented, origin_distance, r


def steps(s, d):
    return t.walks(s, d).select("walk_id", "step", "v")


#: Added before rounding means of decimal values: exact ties then round alike in every engine.
TIE = 3.3e-10


def ra(df, *names):
    for n in names:
        df = df.withColumn(n, F.round(F.col(n) + TIE, 6))
    return df


def long(df, *names):
    for n in names:
        df = df.withColumn(n, F.col(n).cast("long"))
    return df


def neighbour_edges(s, d):
    """The neighbour lists that came with the data, as edges of their smallest distance."""
    return s.read.parquet(f"{d}/knn.parquet").where("src <> dst and dist is not null").groupBy("src", "dst").agg(F.min("dist").alias("w"))


EDGES = "kne as (select src, dst, min(dist) as w from knn where src <> dst and dist is not null group by all)"
WK = t.with_(t.WALKS)
#: Walks simulated, and those of them whose pairwise distances are taken.
N_WALKS, N_PAIRED = 1000, 30
#: Waypoints sampled over the graph, the origin included.
WAYPOINTS = 500


def start(s, d):
    return t.embedding_cloud(s, d).agg(F.min("id")).first()[0]


def simulated(s, d, n=N_WALKS, **options):
    return W.simulate(written(oriented(s, d), "oriented"), start(s, d), n, 1, **options)


#: Of the tunnelling walks: the tolerance of each proposal.
BETA = [0.5 * 0.9**i for i in range(1, 21)]


def tunnelled(s, d):
    """Over the transition matrix before it is oriented, so that steps back are proposed."""
    k = M.transition_matrix(emb_knn(s, d, KG))
    return W.tunnelling(written(k, "transition"), origin_distance(s, d), start(s, d), N_WALKS, BETA)


def begun(s, d):
    """(mc): the communities that walks begin in."""
    first = t.walks(s, d).where("step = 1").select(F.col("v").alias("id")).distinct()
    return t.clusters(s, d).join(first, "id", "left_semi").where("mc is not null").select("mc").distinct()


def sampled_waypoints(s, d):
    """The origin and a uniform sample of the other vertices."""
    return t.embedding_cloud(s, d).select("id").orderBy(F.col("id") != start(s, d), uniform(5, "id"), "id").limit(WAYPOINTS)


SIM = ORIENTED + f""", cum as (select src, dst, w, sum(w) over (partition by src order by dst) as hi from ori),
cu as (select src, dst, w, coalesce(lag(hi) over (partition by src order by dst), 0) as lo, case when row_number() over (partition by src order by dst desc) = 1 then 1.0 else hi end as hi from cum),
sim as (select walk_id, 1 as step, (select min(id) from emb) as v, null::double as p from (select unnest(range(1, {N_WALKS + 1})) as walk_id)
  union all select s.walk_id, s.step + 1, cu.dst, cu.w from (select *, {uniform_sql(1, 'walk_id', 'step')} as u from sim) s join cu on cu.src = s.v and s.u >= cu.lo and s.u < cu.hi)"""
FATES = ORIENTED + ", fat as (select distinct dst as id from ori where dst not in (select src from ori))"
ACYCLIC = """f as (select *, min(step) over (partition by walk_id, v) as fs, max(step) over (partition by walk_id, v) as ls from {src}),
g as (select *, max(case when step = fs and ls > fs + 1 then ls end) over (partition by walk_id order by step rows between unbounded preceding and 1 preceding) as cut from f),
kp as (select walk_id, step, v from g where cut is null or cut < step),
en as (select walk_id, arg_max(v, step) as v, max(step) as step from {src} group by walk_id), tl as (select walk_id, arg_max(v, step) as v from kp group by walk_id),
al as (select * from kp union all select en.walk_id, en.step, en.v from en join tl on tl.walk_id = en.walk_id and tl.v <> en.v),
acy as (select walk_id, row_number() over (partition by walk_id order by step) as step, v from al)"""
CONTRACT = """cj as (select walk_id, step, cluster as v from wlk join clu on clu.id = wlk.v where cluster is not null),
cb as (select *, lag(v) over (partition by walk_id order by step) as b from cj),
ctr as (select walk_id, row_number() over (partition by walk_id order by step) as step, v from cb where b is null or b <> v)"""
PAIRS = "pr as (select * from (select walk_id, step, v as src, lead(v) over (partition by walk_id order by step) as dst from wlk) where dst is not null)"
TOP = "(select arg_max(v, (n, v)) from (select v, count(*) as n from (select arg_max(v, step) as v from wlk group by walk_id) group by v))"


def most_frequent_end(w):
    return W.termini(w).groupBy("v").agg(F.count("*").alias("n")).agg(F.max_by("v", F.struct("n", "v"))).first()[0]


def gridded(s, d):
    e, pt = t.embedding_cloud(s, d), origin_distance(s, d)
    top = pt.agg(F.max("pt").alias("m"))
    pt = with_scalars(pt, top).select("id", (F.col("pt") / F.col("m")).alias("pt"))
    return written(W.on_grid(simulated(s, d, N_PAIRED)[0], e.select("id", "x"), pt), "grid")


GRID = SIM.replace(f"range(1, {N_WALKS + 1})", f"range(1, {N_PAIRED + 1})") + """, tm as (select id, pt / (select max(pt) from pt) as pt from pt), pp as (select walk_id, pt, arg_max(x, step) as x from (select sim.walk_id, sim.step, tm.pt, emb.x from sim join tm on tm.id = sim.v join emb on emb.id = sim.v) group by all),
pl as (select *, lead(pt) over w as pt2, lead(x) over w as x2, row_number() over w as rn from pp window w as (partition by walk_id order by pt)),
gd as (select walk_id, g, c, case when pt2 is null or g / 100.0::double <= pt then x[c] else x[c] + (x2[c] - x[c]) * ((g / 100.0::double - pt) / (pt2 - pt)) end as v
  from (select *, unnest(range(1, 65)) as c from pl, (select unnest(range(0, 101)) as g) where (rn = 1 or g / 100.0::double >= pt) and (pt2 is null or g / 100.0::double < pt2)))"""

QUERIES = {
    "random_walks": lambda s, d: long(simulated(s, d)[0], "step"),
    "walk_stats": lambda s, d: r(simulated(s, d)[1], "gprob"),
    "random_walks_bounded": lambda s, d: long(simulated(s, d, most_steps=4)[0], "step"),
    "walks_to_fate": lambda s, d: _to_fate(s, d),
    "tunnelling_walks": lambda s, d: long(tunnelled(s, d), "step"),
    "fates": lambda s, d: W.fates(oriented(s, d)),
    "ancestors": lambda s, d: _ancestors(s, d),
    "reachability": lambda s, d: _reachability(s, d),
    "reachability_sampled": lambda s, d: W.reachability(written(oriented(s, d), "oriented"), written(sampled_waypoints(s, d), "ways")),
    "contract_walks": lambda s, d: long(W.contract(steps(s, d), t.clusters(s, d)), "step"),
    "contract_acyclic": lambda s, d: long(W.remove_cycles(written(W.contract(steps(s, d), t.clusters(s, d)), "contracted")), "step"),
    "remove_cycles": lambda s, d: long(W.remove_cycles(steps(s, d)), "step"),
    "walk_termini": lambda s, d: W.termini(steps(s, d)),
    "add_terminus": lambda s, d: _terminus(s, d),
    "select_walks": lambda s, d: W.select_walks(steps(s, d), t.walks(s, d).groupBy("walk_id").agg(F.count("*").alias("n")).where("n >= 50")),
    "walk_neighbourhood": lambda s, d: W.neighbourhood(steps(s, d), neighbour_edges(s, d), 1.2),
    "path_kmers": lambda s, d: W.kmers(steps(s, d), 3).select("walk_id", "step", F.array_join(F.transform("kmer", lambda v: v.cast("string")), ",").alias("kmer")),
    "similar_kmers": lambda s, d: _similar(s, d),
    "covered_kmers": lambda s, d: _kmer_pairs(W.covered_kmers(W.kmers(steps(s, d), 2), neighbour_edges(s, d))),
    "kmer_nodes": lambda s, d: W.kmer_nodes(W.kmers(steps(s, d), 2), neighbour_edges(s, d)).select(F.col("kmer")[0].alias("a"), F.col("kmer")[1].alias("b")),
    "path_grid": lambda s, d: gridded(s, d).select("walk_id", "g", F.posexplode("x").alias("dim", "x")).withColumn("x", F.round("x", 6)),
    "resample_walks": lambda s, d: W.resample(steps(s, d), t.cloud(s, d), 1.0).groupBy("walk_id").agg(F.count("*").alias("n"), F.round(F.sum(F.col("x")[0]) + TIE, 6).alias("x0")),
    "consensus_path": lambda s, d: _consensus(s, d),
    "connectome_counts": lambda s, d: C.transitions(steps(s, d), t.clusters(s, d)),
    "connectome_balance": lambda s, d: r(C.balance(C.transitions(steps(s, d), t.clusters(s, d))), "ratio"),
    "connectome_major": lambda s, d: C.major(C.transitions(steps(s, d), t.clusters(s, d))),
    "connectome_hard_terminus": lambda s, d: C.major(C.transitions(steps(s, d), t.clusters(s, d)), True),
    "connectome_edges": lambda s, d: r(C.flow_edges(written(C.transitions(steps(s, d), t.clusters(s, d)), "counts"), "max", 0.5), "weight", "width"),
    "connectome_edges_adaptive": lambda s, d: r(C.flow_edges(written(C.transitions(steps(s, d), t.clusters(s, d)), "counts"), "adaptive", origins=begun(s, d)), "weight").select("a", "b", "n", "weight"),
    "connectome_edges_mean": lambda s, d: r(C.flow_edges(written(C.transitions(steps(s, d), t.clusters(s, d)), "counts"), "mean"), "weight").select("a", "b", "n", "weight"),
    "connectome_positions": lambda s, d: C.node_positions(t.cloud(s, d), t.clusters(s, d)).select("mc", F.round(F.col("x")[0] + TIE, 6).alias("x"), F.round(F.col("x")[1] + TIE, 6).alias("y")),
    "connectome_labels": lambda s, d: r(C.node_labels(t.clusters(s, d), main_labels(s, d)), "share"),
    "connectome_tags": lambda s, d: C.node_tags(C.transitions(steps(s, d), t.clusters(s, d)), t.clusters(s, d), t.walks(s, d).where("step = 1").select(F.col("v").alias("id")).distinct()),
}
for _m in ("max", "sum", "euclid", "abs_sum"):
    QUERIES[f"path_distance_{_m}"] = lambda s, d, _m=_m: r(W.path_distances(gridded(s, d), _m), "dist")
for _m in ("max", "abs_sum"):
    QUERIES[f"path_distance_{_m}_end"] = lambda s, d, _m=_m: r(W.path_distances(gridded(s, d), _m, 0.5), "dist")
#: The metric over all coordinate differences, and over those of the last position.
DIST_SQL = {
    "max": ("max(abs(df))", "max(abs(df)) filter (where g = 100)"),
    "sum": ("sum(abs(df))", "sum(abs(df)) filter (where g = 100)"),
    "euclid": ("sqrt(sum(df * df))", "sqrt(sum(df * df) filter (where g = 100))"),
    "abs_sum": ("abs(sum(df))", "sqrt(sum(df * df) filter (where g = 100))"),
}
#: cov: pairs of vertices (a0, a1) that lie, as a set of two, among (b0, b1) and the neighbours of these.
COVER = t.with_(t.WALKS, EDGES) + """, km as (select distinct a, b from (select v as a, lead(v) over (partition by walk_id order by step) as b from wlk) where b is not null),
st as (select src, dst from kne union select v, v from wlk), nb as (select distinct km.a, km.b, st.dst as n from km join st on st.src = km.a union select km.a, km.b, st.dst from km join st on st.src = km.b),
cov as (select p.a as a0, p.b as a1, x.a as b0, x.b as b1 from km p join nb x on x.n = p.a join nb y on y.a = x.a and y.b = x.b and y.n = p.b where p.a <> p.b and (p.a <> x.a or p.b <> x.b))"""
SQL = {
    "random_walks": SIM + " select walk_id, step::bigint as step, v from sim",
    "walk_stats": SIM + " select walk_id, count(*) as len, round(exp(avg(ln(p))), 6) as gprob from sim group by walk_id",
    "random_walks_bounded": SIM + " select walk_id, step::bigint as step, v from sim where step <= 4",
    "fates": FATES + " select id from fat",
    "ancestors": FATES + ", anc as (select id as fate, id from fat union select fate, src from anc join ori on ori.dst = anc.id) select fate, id from anc",
    "reachability": FATES + ", way as (select id from bn where t <= 20 or id in (select id from fat)), rch as (select id as s, id as v from way union select s, dst from rch join ori on ori.src = rch.v) select distinct least(s, v) as a, greatest(s, v) as b from rch where v in (select id from way) and s <> v",
    "reachability_sampled": ORIENTED + f", way as (select id from emb order by id <> (select min(id) from emb), {uniform_sql(5, 'id')}, id limit {WAYPOINTS}), rch as (select id as s, id as v from way union select s, dst from rch join ori on ori.src = rch.v) select distinct least(s, v) as a, greatest(s, v) as b from rch where v in (select id from way) and s <> v",
    "contract_walks": t.with_(t.WALKS, t.CLUSTERS, CONTRACT) + " select * from ctr",
    "contract_acyclic": t.with_(t.WALKS, t.CLUSTERS, CONTRACT, ACYCLIC.format(src="ctr")) + " select * from acy",
    "remove_cycles": t.with_(t.WALKS, "wl as (select walk_id, step, v from wlk)", ACYCLIC.format(src="wl")) + " select * from acy",
    "walk_termini": WK + " select walk_id, arg_max(v, step) as v from wlk group by walk_id",
    "add_terminus": WK + f", e as (select {TOP} as e), n as (select walk_id, max(step) + 1 as step, e as v from wlk, e group by walk_id, e having arg_max(v, step) <> e) select walk_id, step, v from wlk union all select walk_id, step, v from n",
    "select_walks": WK + " select walk_id, step, v from wlk where walk_id in (select walk_id from wlk group by walk_id having count(*) >= 50)",
    "walk_neighbourhood": t.with_(t.WALKS, PAIRS, EDGES) + """, e as (select walk_id, step, pr.src, pr.dst, w from pr join kne using (src, dst)), b as (select walk_id, step, v, avg(w) * 1.2 as most from (select walk_id, step, src as v, w from e union all select walk_id, step + 1, dst, w from e) group by all)
select walk_id, dst as id from b join kne on kne.src = b.v where w <= most union select walk_id, v from wlk""",
    "path_kmers": WK + " select walk_id, step, kmer from (select walk_id, step, v::varchar || ',' || lead(v) over w::varchar || ',' || lead(v, 2) over w::varchar as kmer from wlk window w as (partition by walk_id order by step)) where kmer is not null",
    "similar_kmers": COVER + " select distinct least(p, q)[1] as a0, least(p, q)[2] as a1, greatest(p, q)[1] as b0, greatest(p, q)[2] as b1 from (select [a0, a1] as p, [b0, b1] as q from cov)",
    "covered_kmers": COVER + " select * from cov",
    "path_grid": GRID + " select walk_id, g, (c - 1)::int as dim, round(v, 6) as x from gd",
    "resample_walks": t.with_(t.WALKS, t.CLOUD) + """, p as (select walk_id, step, x, lead(x) over (partition by walk_id order by step) as x2 from wlk join pts on pts.id = wlk.v),
c as (select *, case when x2 is null then 1 else greatest(1, round(list_distance(x, x2))::int) end as parts from p), e as (select *, unnest(range(0, parts)) as k from c)
select walk_id, count(*) as n, round(sum(case when x2 is null then x[1] else x[1] + (x2[1] - x[1]) * k / parts end) + 3.3e-10, 6) as x0 from e group by walk_id""",
    "connectome_counts": t.with_(t.WALKS, t.CLUSTERS, PAIRS) + ", cnt as (select a.mc as a, b.mc as b, count(*) as n from pr join clu a on a.id = src join clu b on b.id = dst where a.mc <> b.mc group by all) select * from cnt",
}
CNT = t.with_(t.WALKS, t.CLUSTERS, PAIRS) + """, cnt as (select a.mc as a, b.mc as b, count(*) as n from pr join clu a on a.id = src join clu b on b.id = dst where a.mc <> b.mc group by all),
bal as (select mc, sum(ins) as ins, sum(outs) as outs, case when sum(ins) = 0 then 1.0 else sum(outs)::double / sum(ins) end as ratio from (select a as mc, n as outs, 0 as ins from cnt union all select b, 0, n from cnt) group by mc),
maj as (select c.a, c.b, c.n from cnt c left join cnt d on d.a = c.b and d.b = c.a where d.n is null or c.n > d.n or (c.n = d.n and c.a < c.b))"""
SQL |= {
    "connectome_balance": CNT + " select mc, ins::bigint as ins, outs::bigint as outs, round(ratio, 6) as ratio from bal",
    "connectome_major": CNT + " select * from maj",
    "connectome_hard_terminus": CNT + ", h as (select * from cnt where a not in (select mc from bal where ratio < 1)) select c.a, c.b, c.n from h c left join h d on d.a = c.b and d.b = c.a where d.n is null or c.n > d.n or (c.n = d.n and c.a < c.b)",
    # one scale for all: the largest half of ins and outs of any community
    "connectome_edges": CNT + ", e as (select *, pow(weight, 1.2::double) * 19 as width from (select *, n / (select max((ins + outs) / 2.0::double) from bal) as weight from maj)), q as (select quantile_cont(width, 0.5) as q from e) select a, b, n, round(weight, 6) as weight, round(width + case when width > q then 7 else 0 end, 6) as width, not width < q as arrow from e, q",
    # by the community left: outs of an origin, ins of a terminus, half of both for others
    "connectome_edges_adaptive": CNT + ", o as (select distinct mc from clu where mc is not null and id in (select v from wlk where step = 1)) select a, b, n, round(n / case when a in (select mc from o) then outs when ratio < 1 then ins else (ins + outs) / 2.0::double end, 6) as weight from maj join bal on bal.mc = maj.a",
    "connectome_edges_mean": CNT + " select a, b, n, round(n / ((ins + outs) / 2.0::double), 6) as weight from maj join bal on bal.mc = maj.a",
    "connectome_positions": t.with_(t.CLOUD, t.CLUSTERS) + " select mc, round(avg(x[1]) + 3.3e-10, 6) as x, round(avg(x[2]) + 3.3e-10, 6) as y from pts join clu using (id) where mc is not null group by mc",
    "connectome_labels": t.with_(t.LABELS, t.CLUSTERS, MAIN) + ", h as (select mc, label, count(*) as n from clu join ml using (id) where mc is not null and label <> 'ungated' group by all) select mc, label, n, round(n::double / sum(n) over (partition by mc), 6) as share from h",
    "connectome_tags": CNT + ", o as (select distinct mc from clu where id in (select v from wlk where step = 1)) select mc, ratio < 1 as terminus, mc in (select mc from o where mc is not null) as origin from bal",
}
for _m, _f in DIST_SQL.items():
    _pd = ", pd as (select a.walk_id as a, b.walk_id as b, a.g, a.v - b.v as df from gd a join gd b on a.g = b.g and a.c = b.c and a.walk_id < b.walk_id)"
    SQL[f"path_distance_{_m}"] = GRID + _pd + f" select a, b, round({_f[0]}, 6) as dist from pd group by a, b"
    if f"path_distance_{_m}_end" in QUERIES:
        SQL[f"path_distance_{_m}_end"] = GRID + _pd + f" select a, b, round({_f[0]} + 0.5::double * {_f[1]}, 6) as dist from pd group by a, b"


def _to_fate(s, d):
    """Walks simulated towards every fate, N_PAIRED for each."""
    e = written(oriented(s, d), "oriented")
    return long(W.walks_to(e, start(s, d), W.fates(e), N_PAIRED)[0], "step")


def _ancestors(s, d):
    e = written(oriented(s, d), "oriented")
    return W.ancestors_of(e, W.fates(e))


def _reachability(s, d):
    from ..operators.sparse import rank_bins

    e = written(oriented(s, d), "oriented")
    ways = rank_bins(origin_distance(s, d), 100).where("t <= 20").select("id").union(W.fates(e)).distinct()
    return W.reachability(e, ways)


def _terminus(s, d):
    w = written(steps(s, d), "steps")
    return long(W.add_terminus(w, most_frequent_end(w)), "step")


def _similar(s, d):
    return _kmer_pairs(W.similar_kmers(W.kmers(steps(s, d), 2), neighbour_edges(s, d)))


def _kmer_pairs(k):
    return k.select(F.col("a")[0].alias("a0"), F.col("a")[1].alias("a1"), F.col("b")[0].alias("b0"), F.col("b")[1].alias("b1"))


def _consensus(s, d):
    """Of every terminus's consensus path the number of positions, and its two ends, where a spline passes through its points."""
    w = simulated(s, d)[0]
    p = W.path_points(w, t.embedding_cloud(s, d))
    classes = W.termini(w).select("walk_id", F.col("v").alias("class"))
    c = W.consensus(p, classes, 64).groupBy("class").agg(F.count("*").alias("positions"), F.min_by("x", "step").alias("p"), F.max_by("x", "step").alias("q"))
    return c.select("class", "positions", *[F.round(F.col(e)[i], 6).alias(f"{e}{i}") for e in "pq" for i in (0, 63)])


# ---- trackers


def chosen(s, d):
    """Walks and scaled pseudotime of the path model with the most steps."""
    w = written(t.walks(s, d), "walks")
    o = w.groupBy("origin_name").count().orderBy(F.desc("count"), "origin_name").first()[0]
    times = t.pseudotime(s, d).where(F.col("origin_name") == o).select("id", "pt")
    times = written(V.scaled(times).withColumn("pt", F.round("pt", 9)), "times")
    return w.where(F.col("origin_name") == o).select("walk_id", "step", "v"), times


def segmented(s, d, parts=10, power=1.0):
    w, times = chosen(s, d)
    on = times.join(w.select(F.col("v").alias("id")).distinct(), "id")
    b = sorted({round(x, 9) for x in V.breaks_of(on, parts, power)})
    return w, times, V.segments(times, b).withColumn("segment", F.col("segment").cast("long"))


SEG = t.with_(t.WALKS, t.TIMES, t.CLOUD, t.LABELS, MAIN) + """, om as (select origin_name as o from wlk group by 1 order by count(*) desc, 1 limit 1), w1 as (select walk_id, step, v from wlk join om on o = origin_name),
p1 as (select id, pt from pst join om on o = origin_name), t1 as (select id, round(pt / (select max(pt) from p1), 9) as pt from p1),
br as (select list(distinct round(q, 9) order by round(q, 9)) as b from (select unnest(quantile_cont(pt, {probs})) as q from (select distinct pt from t1 where id in (select v from w1)))),
seg as (select id, greatest(1, len(list_filter(b, lambda v: v < pt))) as segment from t1, br where pt between b[1] and b[-1])"""
S10 = SEG.replace("{probs}", "[0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]")
SQUARED = S10 + ", bs as (select list(distinct round(q, 9) order by round(q, 9)) as b from (select unnest(quantile_cont(pt, [0, 0.01, 0.04, 0.09, 0.16, 0.25, 0.36, 0.49, 0.64, 0.81, 1])) as q from t1)), sq as (select id, greatest(1, len(list_filter(b, lambda v: v < pt))) as segment from t1, bs where pt between b[1] and b[-1])"


def windowed(s, d):
    _, times = chosen(s, d)
    b = sorted({round(x, 9) for x in V.window_breaks(times, 10)})
    return V.segments(times, b).withColumn("segment", F.col("segment").cast("long"))


def uniform_segments(s, d):
    _, times = chosen(s, d)
    b = sorted({round(x, 9) for x in V.breaks_of(times, 8, how="uniform")})
    return V.segments(times, b).withColumn("segment", F.col("segment").cast("long"))


QUERIES |= {
    "segments": lambda s, d: segmented(s, d)[2],
    "segments_uniform": uniform_segments,
    "markers_single": lambda s, d: ra(V.marker_by_walk(*_ws(segmented(s, d)), t.cloud(s, d), 0), "value"),
    "marker_points": lambda s, d: V.segment_points(*_ws(segmented(s, d))),
    "markers_multi": lambda s, d: ra(V.markers(*_ws(segmented(s, d)), t.cloud(s, d), 25), "value"),
    "populations": lambda s, d: V.populations(*_ws(segmented(s, d)), main_labels(s, d)),
    "populations_log2": lambda s, d: r(V.populations(*_ws(segmented(s, d)), main_labels(s, d), True), "n"),
    "label_composition": lambda s, d: r(V.composition(segmented(s, d)[2], main_labels(s, d)), "value"),
    "window_medians": lambda s, d: r(V.window_medians(t.cloud(s, d), windowed(s, d), 25), "q"),
    "window_gate_share": lambda s, d: r(V.gate_share(windowed(s, d), main_labels(s, d).where("label = 'ungated'")), "share"),
    "label_order": lambda s, d: ra(V.label_order(chosen(s, d)[1], main_labels(s, d)), "mean"),
    "highlight": lambda s, d: (lambda w, ts: V.highlight(ts, w, 0.2, 0.6))(*chosen(s, d)),
    "marked_walks": lambda s, d: _marked(s, d),
}


def _ws(x):
    return x[0], x[2]


def _marked(s, d):
    """Mark long walks, pin; remove those through one cluster, mark short ones, pin: both pinned batches."""
    w = written(steps(s, d), "steps")
    n = w.groupBy("walk_id").agg(F.count("*").alias("n"))
    g = V.WalkGroups(w)
    g.mark(n.where("n >= 60"))
    g.pin()
    g.remove(n.where("n >= 100"))
    g.mark(n.where("n <= 5"))
    return g.pin().select(F.col("batch").cast("int").alias("batch"), "walk_id")


SQL |= {
    "segments": S10 + " select id, segment from seg",
    "segments_uniform": S10 + ", lh as (select min(pt) as lo, max(pt) as hi from t1), bu as (select list(distinct round(lo + (hi - lo) * i / 8, 9) order by round(lo + (hi - lo) * i / 8, 9)) as b from lh, (select unnest(range(0, 9)) as i)) select id, greatest(1, len(list_filter(b, lambda v: v < pt))) as segment from t1, bu where pt between b[1] and b[-1]",
    "markers_single": S10 + " select segment, walk_id, round(avg(x[1]) + 3.3e-10, 6) as value, count(*) as n from w1 join seg on seg.id = w1.v join pts on pts.id = w1.v group by segment, walk_id",
    "marker_points": S10 + " select distinct segment, walk_id, v as id from w1 join seg on seg.id = w1.v",
    "markers_multi": S10 + ", e as (select segment, walk_id, x, unnest(range(1, 26)) as c from w1 join seg on seg.id = w1.v join pts on pts.id = w1.v), m as (select segment, walk_id, c, avg(x[c]) as v from e group by all) select segment, (c - 1)::int as marker, round(avg(v) + 3.3e-10, 6) as value from m group by segment, c",
    "populations": S10 + " select segment, label, count(*) as n from seg join ml using (id) where id in (select v from w1) group by segment, label",
    "populations_log2": S10 + " select segment, label, round(log2(count(*)), 6) as n from seg join ml using (id) where id in (select v from w1) group by segment, label",
    "label_composition": S10 + ", h as (select segment, label, count(*) as n from seg join ml using (id) group by all), g as (select * from (select distinct segment from h), (select distinct label from h)) select segment, label, round(coalesce(n, 0)::double / sum(coalesce(n, 0)) over (partition by segment), 6) as value from g left join h using (segment, label)",
    "window_medians": SQUARED + ", e as (select segment, x, unnest(range(1, 26)) as c from sq join pts using (id)) select segment, (c - 1)::int as marker, round(quantile_cont(x[c], 0.5), 6) as q from e group by segment, c",
    "window_gate_share": SQUARED + " select segment, round(avg(case when id in (select id from ml where label = 'ungated') then 1 else 0 end), 6) as share from sq group by segment",
    "label_order": S10 + ", m as (select label, avg(pt) as mean from t1 join ml using (id) group by label) select label, round(mean + 3.3e-10, 6) as mean, row_number() over (order by mean, label)::int as rank from m",
    "highlight": S10 + " select id from t1 where pt between 0.2 and 0.6 and id in (select v from w1)",
    "marked_walks": WK + ", n as (select walk_id, count(*) as n from wlk group by walk_id) select 1 as batch, walk_id from n where n >= 60 union all select 2, walk_id from n where n between 60 and 99 or n <= 5",
    "walks_to_fate": FATES + f""", anc as (select id as fate, id from fat union select fate, src from anc join ori on ori.dst = anc.id), og as (select min(id) as o from emb),
rf as (select fate, row_number() over (order by fate) as k from anc join og on id = o), fe as (select a.fate, src, dst, w from ori join anc a on a.id = src join anc b on b.fate = a.fate and b.id = dst where a.fate in (select fate from rf)),
fc as (select *, sum(w) over (partition by fate, src order by dst) / sum(w) over (partition by fate, src) as hi from fe),
fi as (select fate, src, dst, coalesce(lag(hi) over (partition by fate, src order by dst), 0) as lo, case when row_number() over (partition by fate, src order by dst desc) = 1 then 1.0 else hi end as hi from fc),
fs as (select fate, (k - 1) * {N_PAIRED} + i as walk_id, 1 as step, o as v from rf, og, (select unnest(range(1, {N_PAIRED + 1})) as i)
  union all select s.fate, s.walk_id, s.step + 1, fi.dst from (select *, {uniform_sql(1, 'walk_id', 'step')} as u from fs) s join fi on fi.fate = s.fate and fi.src = s.v and s.u >= fi.lo and s.u < fi.hi)
select fate, walk_id, step::bigint as step, v from fs""",
    "tunnelling_walks": SEMER + ", " + NORM + ", " + ORIGIN_DIST + f""", cum as (select src, dst, w, sum(w) over (partition by src order by dst) / sum(w) over (partition by src) as hi from p),
cu as (select src, dst, coalesce(lag(hi) over (partition by src order by dst), 0) as lo, case when row_number() over (partition by src order by dst desc) = 1 then 1.0 else hi end as hi from cum),
tun as (select walk_id, 1 as i, 1 as step, id as v, pt as t, 0.0::double as m, true as moved from pt, (select unnest(range(1, {N_WALKS + 1})) as walk_id) where id = (select min(id) from emb)
  union all select walk_id, i + 1, step + take::int, case when take then dst else v end, case when take then tt else t end, top, take from (select *,
    tt >= t or exp(-((1 - exp(-(top - tt))) - (1 - exp(-(top - t)))) / (0.5 * pow(0.9::double, i))) > {uniform_sql(2, 'walk_id', 'i')} as take
    from (select tun.*, cu.dst, q.pt as tt, greatest(m, q.pt) as top from (select *, {uniform_sql(1, 'walk_id', 'i')} as u from tun where i <= {len(BETA)}) tun join cu on cu.src = tun.v and tun.u >= cu.lo and tun.u < cu.hi join pt q on q.id = cu.dst)))
select walk_id, step::bigint as step, v from tun where moved""",
    "consensus_path": SIM + """, en as (select walk_id, arg_max(v, step) as class, count(*) as n from sim group by walk_id), c as (select class, 3 * max(n) as positions from en group by class)
select class, positions, round(a.x[1], 6) as p0, round(a.x[64], 6) as p63, round(b.x[1], 6) as q0, round(b.x[64], 6) as q63 from c join emb b on b.id = class, emb a where a.id = (select min(id) from emb)""",
}
