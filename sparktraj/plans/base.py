"""SQL for neighbour tables, and the driver tables behind the queries."""
from __future__ import annotations

from ..operators import knn
from ..sources import tables as t


def knn_sql(k: int, name: str = "knn", cloud: str = "emb", metric: str = "euclid") -> str:
    d = "list_distance(a.x, b.x)" if metric == "euclid" else "abs(1 - list_cosine_similarity(a.x, b.x))"
    return f"""{name} as (select src, dst, rnk::int as rnk, dist from (select src, dst, dist, row_number() over (partition by src order by dist, dst) as rnk
  from (select a.id as src, b.id as dst, {d} as dist from {cloud} a join {cloud} b on a.id <> b.id)) where rnk <= {k})"""


def emb_knn(spark, d: str, k: int):
    return knn.knn(t.embedding_cloud(spark, d), k)
