"""Queries of imports, merges, exports and layouts."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashrand import uniform_sql
from ..operators.layout import Layouts
from ..sources import io
from ..sources import tables as t
from .clouds import MAIN, main_labels
from .graphs import r

#: Pseudo-gates over the event table: every event lies in the gate of its type, those of value over 50 in an event gate too.
def gates(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    order = F.when(F.col("event_type") == "click", 2).when(F.col("event_type") == "view", 1).otherwise(3)
    by = e.where("event_type <> 'error'").select(F.col("event_id").alias("id"), F.concat(F.lit("/all/A_"), "event_type").alias("path"), order.alias("gate_order"))
    ev = e.where("value > 50").select(F.col("event_id").alias("id"), F.lit("/all/live_G1").alias("path"), F.lit(0).alias("gate_order"))
    return by.unionByName(ev)


GATES = """gt as (select event_id as id, '/all/A_' || event_type as path, case event_type when 'click' then 2 when 'view' then 1 else 3 end as gate_order from events where event_type <> 'error' union all select event_id, '/all/live_G1', 0 from events where value > 50)"""


def files(s, d):
    p = t.cloud(s, d).where("file_id is not null and events_sel is not null")
    return p, p.groupBy("file_id").agg(F.max("events_sel").alias("n"))


def first_origin(s, d):
    p = t.pseudotime(s, d)
    o = p.groupBy("origin_name").count().orderBy(F.desc("count"), "origin_name").first()[0]
    return o, p.where(F.col("origin_name") == o).select("id", "pt")


def report(s, d):
    o, times = first_origin(s, d)
    w = t.walks(s, d).where(F.col("origin_name") == o)
    return io.path_report(times, w).select("id", F.col("which_event").cast("long").alias("which_event"), F.col("local_pseudotime").cast("long").alias("local_pseudotime"))


def enriched(s, d):
    p, _ = files(s, d)
    src = s.read.parquet(f"{d}/points.parquet").where("file_id is not null and events_sel is not null").select("file_id", "events_sel")
    o, times = first_origin(s, d)
    w = t.walks(s, d).where(F.col("origin_name") == o)
    layout = t.cloud(s, d).select("id", F.slice("x", 1, 2).alias("x"))
    return r(io.enrichment(src, p, layout, times, t.labels(s, d), {"all": w}), "layout_1", "layout_2")


def merged(s, d):
    a = t.cloud(s, d).select("id", "x", "events_sel").where("events_sel is not null")
    b = t.embedding_cloud(s, d).select("id", "x", (F.col("id") + 1).alias("events_sel"))
    return io.merge([a, b]).select("file_id", "id", "events_sel", F.col("row").alias("row"))


def layouts(s, d):
    reg = Layouts()
    reg.add("given", layout=t.cloud(s, d).select("id", F.slice("x", 1, 2).alias("x")))
    name = reg.add("pca", t.cloud(s, d).select("id", "x"))
    return reg.tables[name].select("id", F.lit(name).alias("layout_name"), F.size("x").alias("axes"))


def pca_variance(s, d):
    """The scores have mean 0, are uncorrelated, and the first varies no less than the second or than any single channel."""
    from ..operators.layout import principal_components

    v = principal_components(t.cloud(s, d).select("id", "x")).select(*[F.col("x")[i].alias(f"y{i}") for i in range(2)])
    q = v.agg(*[f(f"y{i}").alias(f"{n}{i}") for i in range(2) for n, f in (("m", F.avg), ("v", F.var_pop))])
    both = v.agg(F.abs(F.corr("y0", "y1")).alias("c")).first()[0]
    most = t.cloud(s, d).agg(*[F.var_pop(F.col("x")[i]).alias(f"v{i}") for i in range(t.CHANNELS)]).first()
    return q.select((F.abs("m0") < 1e-6).alias("centred_0"), (F.abs("m1") < 1e-6).alias("centred_1"), (F.col("v0") >= F.col("v1")).alias("ordered"), F.lit(both < 1e-6).alias("uncorrelated"), (F.col("v0") >= max(most) * (1 - 1e-9)).alias("leading"))


QUERIES = {
    "cloud_summary": lambda s, d: io.summary(t.cloud(s, d), t.labels(s, d)),
    "gate_labels": lambda s, d: io.gate_labels(gates(s, d), "_G[0-9]+$", "/[A-Z]_", "^A_")[0],
    "gate_origins": lambda s, d: io.gate_labels(gates(s, d), "_G[0-9]+$", "/[A-Z]_", "^A_")[1],
    "file_offsets": lambda s, d: io.with_offsets(*files(s, d)).select("id", "file_id", "row"),
    "merge_fileid": merged,
    "fcs_parameter_table": lambda s, d: r(io.parameter_table(t.cloud(s, d), [f"ch{i:02d}" for i in range(25)]), "max_range", "min_range"),
    "path_report": report,
    "export_enrichment": enriched,
    "connect_handle": lambda s, d: _handle(s, d),
    "layout_registry": layouts,
    "layout_pca": pca_variance,
    "synthetic_snowman": lambda s, d: r(io.snowman(s, 1000, 3).select("id", *[F.col("x")[i].alias(c) for i, c in enumerate("xyz")]), "x", "y", "z"),
}


def _handle(s, d):
    p = t.cloud(s, d).select("id", "x")
    a, b = p.agg(F.min("id"), F.max("id")).first()
    return r(io.handle(p, a, b).select("id", F.posexplode("x").alias("dim", "x")), "x")


#: The label sets of the data.
LABEL_SETS = ("consensus", "default", "gate_v2")


def _noisy(axis: int, shift: int, radius: float, height: float) -> str:
    """Coordinate of a point n on a noisy circle whose seeds begin at 1 + shift."""
    seed = 1 + shift
    noise = f"sqrt(-2 * ln(1 - {uniform_sql(seed + 1 + axis, 'n')})) * cos(2 * pi() * {uniform_sql(seed + 1001 + axis, 'n')}) * 0.1"
    angle = f"{uniform_sql(seed, 'n')} * 2 * pi()"
    return [f"{radius} * cos({angle}) + {noise}", f"{radius} * sin({angle}) + {noise} + {height}", noise][axis]


OM = "om as (select origin_name as o from pst group by 1 order by count(*) desc, 1 limit 1), p1 as (select id, pt from pst join om on o = origin_name)"
FILES = t.with_(t.CLOUD) + ", fl as (select * from pts where file_id is not null and events_sel is not null), sz as (select file_id, max(events_sel) as n from fl group by file_id), of as (select file_id, coalesce(sum(n) over (order by file_id rows between unbounded preceding and 1 preceding), 0) as o from sz)"
SQL = {
    "cloud_summary": t.with_(t.CLOUD, t.LABELS) + " select labels_name, (select count(*) from pts) as n, count(distinct label) as levels from lab group by labels_name",
    "gate_labels": t.with_(GATES) + ", ev as (select distinct id from gt where regexp_matches(path, '_G[0-9]+$')), nm as (select id, arg_min(split_part(path, '/', 3), gate_order) as label from gt where regexp_matches(path, '/[A-Z]_') group by id) select id, coalesce(label, 'ungated') as label from ev left join nm using (id)",
    "gate_origins": t.with_(GATES) + " select distinct split_part(path, '/', 3) as label from gt where regexp_matches(split_part(path, '/', 3), '^A_')",
    "file_offsets": FILES + " select id, file_id, (events_sel + o)::bigint as row from fl join of using (file_id)",
    "merge_fileid": t.with_(t.CLOUD, t.EMB) + ", a as (select id, events_sel from pts where events_sel is not null) select 1 as file_id, id, events_sel, events_sel as row from a union all select 2, id, id + 1, id + 1 + (select max(events_sel) from a) from emb",
    "fcs_parameter_table": t.with_(t.CLOUD) + " select 'ch' || lpad((c - 1)::varchar, 2, '0') as name, (c - 1)::int as position, round(max(x[c]) + 1, 6) as max_range, round(least(0, min(x[c]) - 1), 6) as min_range from (select x, unnest(range(1, 26)) as c from pts) group by c",
    "path_report": t.with_(t.WALKS, t.TIMES, OM) + ", rk as (select id, dense_rank() over (order by pt) as r from p1 where id in (select v from wlk join om on o = origin_name)) select p1.id, case when r is null then -1 else 1000 end::bigint as which_event, coalesce(r, -1)::bigint as local_pseudotime from p1 left join rk using (id)",
    "export_enrichment": t.with_(t.WALKS, t.CLOUD, t.TIMES, t.LABELS, OM) + """, rk as (select id, dense_rank() over (order by pt) as r from p1), cd as (select id, labels_name, dense_rank() over (partition by labels_name order by label) as c from lab),
on_ as (select distinct v as id from wlk join om on o = origin_name), lr as (select id, dense_rank() over (order by pt) as r from p1 where id in (select id from on_)), pn as (select p1.id, case when lr.r is null then -1 else 1000 end as we, coalesce(lr.r, -1) as lp from p1 left join lr using (id)),
rw as (select file_id, events_sel, arg_min(x[1] * 100, id) as layout_1, arg_min(x[2] * 100, id) as layout_2, arg_min(r, id) filter (where r is not null) as ps, arg_min(we, id) filter (where we is not null) as we, arg_min(lp, id) filter (where lp is not null) as lp,
  @arg from pts left join rk using (id) left join pn using (id) @join where file_id is not null and events_sel is not null group by all),
fr as (select distinct file_id, events_sel from points where file_id is not null and events_sel is not null)
select fr.file_id, fr.events_sel, round(coalesce(layout_1, -100), 6) as layout_1, round(coalesce(layout_2, -100), 6) as layout_2, coalesce(ps, -100)::double as pseudotime, coalesce(we, -100)::double as which_event_all, coalesce(lp, -100)::double as local_pseudotime_all,
  @out from fr left join rw on rw.file_id = fr.file_id and rw.events_sel = fr.events_sel"""
    .replace("@arg", ", ".join(f"arg_min(l_{n}.c, id) filter (where l_{n}.c is not null) as l_{n}" for n in LABEL_SETS))
    .replace("@join", " ".join(f"left join (select id, c from cd where labels_name = '{n}') l_{n} using (id)" for n in LABEL_SETS))
    .replace("@out", ", ".join(f"coalesce(rw.l_{n}, -100)::double as label_{n}" for n in LABEL_SETS)),
    # stems of heights 1 to 10 over both points, then the straight line between them at height 10
    "connect_handle": t.with_(t.CLOUD) + """, m as (select arg_min(x, id) as p, arg_max(x, id) as q, max(id) as top from pts), k as (select unnest(range(1, 11)) as k),
al as (select id, list_append(x, 0.0) as x from pts union all select top + k, list_append(p, k::double) from m, k union all select top + 10 + k, list_append(q, k::double) from m, k
  union all select top + 20 + k, list_append([p[i] + (q[i] - p[i]) * (k * 0.1::double) for i in range(1, 26)], 10.0) from m, k)
select id, (c - 1)::int as dim, round(x[c], 6) as x from (select id, x, unnest(range(1, 27)) as c from al)""",
    "layout_registry": t.with_(t.CLOUD) + " select id, '2_pca' as layout_name, 2 as axes from pts",
    "layout_pca": "select true as centred_0, true as centred_1, true as ordered, true as uncorrelated, true as leading",
    # three circles above each other, 1000, 1000 and 500 points, normal noise of 0.1 by two uniforms
    "synthetic_snowman": "with c as (select unnest([0, 1, 2]) as i), p as (select i, unnest(range(0, case when i = 2 then 500 else 1000 end)) as n from c), q as (select n * 3 + i as id, "
    + ", ".join(f"case i when 0 then {_noisy(k, 0, 1.0, 0.0)} when 1 then {_noisy(k, 10, 0.7, 1.7)} else {_noisy(k, 20, 0.4, 2.8)} end as {c}" for k, c in enumerate("xyz"))
    + " from p) select id, round(x, 6) as x, round(y, 6) as y, round(z, 6) as z from q where y >= 0",
}
