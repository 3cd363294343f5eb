"""SQL of the training-data queries that SQL can express, over whole tables (all pairs of points, so for small scales)."""
from __future__ import annotations

from .percentiles import P4_SQL
from .quotas import P5_REPORT_SQL, P5_SQL

POINTS = """p as (select id, x from (select *, row_number() over (partition by id order by ingested_at desc nulls last) rn from points where id is not null)
  where rn = 1 and len(x) = 25 and list_count(x) = 25 and len(list_filter(x, lambda v: isnan(v))) = 0)"""
LINKS = POINTS + ", l as (select a.id as a, b.id as b, list_distance(a.x, b.x) as d from p a join p b on a.id <> b.id where list_distance(a.x, b.x) <= 0.4)"
RUNS = (
    "with "
    + POINTS
    + """, s as (select walk_id, step, v, visited_at from (select *, row_number() over (partition by walk_id, step order by logged_at desc nulls last) rn from walks where walk_id is not null and step is not null) where rn = 1 and v is not null),
o as (select *, lag(v) over (partition by walk_id order by step) as pv from s),
q as (select distinct pv, v from o where pv is not null and pv <> v), n as (select q.pv, q.v from q join p a on a.id = q.pv join p b on b.id = q.v where list_distance(a.x, b.x) <= 0.4),
g as (select o.*, sum(case when o.pv = o.v or n.v is not null then 0 else 1 end) over (partition by walk_id order by step) as r from o left join n on n.pv = o.pv and n.v = o.v)
"""
)

SQL = {
    "p1_found": "with " + POINTS + " select id from p where id not in (select a.id from p a join p b on a.id <> b.id and list_distance(a.x, b.x) <= 8.0)",
    "p2_found": "with " + LINKS + ", r as (select *, row_number() over (partition by a order by d, b) as rnk from l) select distinct least(a, b) as id_a, greatest(a, b) as id_b from r where rnk <= 5",
    "p3_found": "with recursive " + LINKS + ", c as (select a as id, a as root from l union select l.b, c.root from c join l on l.a = c.id), k as (select id, min(root) as cluster_key from c group by id) select cluster_key, id from k qualify count(*) over (partition by cluster_key) >= 3",
    "p4_percentiles": P4_SQL,
    "p5_found": P5_SQL,
    "p5_report": P5_REPORT_SQL,
    "p6_found": RUNS + "select walk_id, min(step) as first_step, max(step) as last_step, count(*)::int as n_steps from g group by walk_id, r having count(*) >= 2",
    "p6_runs": RUNS + "select walk_id, min(step) as first_step, max(step) as last_step, count(*) as n_steps, arg_min(v, step) as v, date_diff('microsecond', arg_min(visited_at, step), arg_max(visited_at, step)) / 1e6 as seconds from g group by walk_id, r",
}
