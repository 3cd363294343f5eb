"""Tables of the data model, current rows only, and the SQL common table expressions that say the same.

The point clouds: ``cloud`` (points, 25 channels) and ``embedding_cloud`` (embeddings, 64 dims, float). Walks, clusters, labels and
pseudotime are the latest rows of their tables.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHANNELS, EMBEDDING_DIM = 25, 64


def _latest(df: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    first = F.struct(F.col(order).isNotNull(), F.col(order), *[F.xxhash64(c) for c in columns])
    return df.groupBy(*keys).agg(F.max_by(F.struct(*columns), first).alias("r")).select(*keys, "r.*")


def cloud(spark: SparkSession, d: str) -> DataFrame:
    """(id, x, file_id, events_sel) of usable points."""
    cur = _latest(spark.read.parquet(f"{d}/points.parquet").where("id is not null"), ["id"], "ingested_at", ["x", "file_id", "events_sel"])
    return cur.where(F.coalesce((F.size("x") == CHANNELS) & (F.size(F.array_compact("x")) == CHANNELS) & ~F.array_contains("x", float("nan")), F.lit(False)))


def embedding_cloud(spark: SparkSession, d: str) -> DataFrame:
    """(id, x, label) of the embeddings."""
    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"), F.col("label").cast("string").alias("label"))


def labels(spark: SparkSession, d: str) -> DataFrame:
    """(id, labels_name, label), labels without case and outer blanks."""
    rows = spark.read.parquet(f"{d}/point_labels.parquet").where("id is not null and labels_name is not null")
    return _latest(rows, ["id", "labels_name"], "labelled_at", ["label"]).select("id", "labels_name", F.lower(F.trim("label")).alias("label")).where("label is not null")


def clusters(spark: SparkSession, d: str) -> DataFrame:
    """(id, cluster, mc)."""
    rows = spark.read.parquet(f"{d}/cluster_assign.parquet").where("id is not null")
    cur = _latest(rows, ["id"], "assigned_at", ["clusters", "metaclusters"])
    return cur.select("id", F.col("clusters").cast("long").alias("cluster"), F.col("metaclusters").cast("long").alias("mc"))


def walks(spark: SparkSession, d: str) -> DataFrame:
    """(origin_name, walk_id, step, v) of the current steps with a vertex; step is renumbered without gaps, from 1."""
    rows = spark.read.parquet(f"{d}/walks.parquet").where("walk_id is not null and step is not null")
    cur = _latest(rows, ["walk_id", "step"], "logged_at", ["v", "origin_name"]).where("v is not null")
    w = Window.partitionBy("walk_id").orderBy("step")
    return cur.select("origin_name", "walk_id", F.row_number().over(w).alias("step"), "v")


def pseudotime(spark: SparkSession, d: str) -> DataFrame:
    """(origin_name, id, pt) where it is defined."""
    rows = spark.read.parquet(f"{d}/pseudotime.parquet").where("id is not null")
    first = F.struct("computed_at", "arrived_at", F.coalesce("res", F.lit(0.0)))
    cur = rows.groupBy("origin_name", "id").agg(F.max_by(F.struct("res"), first).alias("r")).select("origin_name", "id", F.col("r.res").alias("pt"))
    return cur.where("pt is not null and not isnan(pt) and abs(pt) < double('infinity') and pt not in (-1.0, -100.0)")


#: The same tables in SQL.
CLOUD = """pts as (select id, x, file_id, events_sel from (select *, row_number() over (partition by id order by ingested_at desc nulls last) rn from points where id is not null)
  where rn = 1 and len(x) = 25 and list_count(x) = 25 and len(list_filter(x, lambda v: isnan(v))) = 0)"""
EMB = "emb as (select vec_id as id, embedding::double[] as x, label::varchar as label from embeddings)"
LABELS = """lab as (select id, labels_name, lower(trim(label)) as label from (select *, row_number() over (partition by id, labels_name order by labelled_at desc nulls last) rn
  from point_labels where id is not null and labels_name is not null) where rn = 1 and label is not null)"""
CLUSTERS = """clu as (select id, clusters::bigint as cluster, metaclusters::bigint as mc from (select *, row_number() over (partition by id order by assigned_at desc nulls last) rn
  from cluster_assign where id is not null) where rn = 1)"""
WALKS = """wlk as (select origin_name, walk_id, row_number() over (partition by walk_id order by step) as step, v from (select *, row_number() over (partition by walk_id, step order by logged_at desc nulls last) rn
  from walks where walk_id is not null and step is not null) where rn = 1 and v is not null)"""
TIMES = """pst as (select origin_name, id, res as pt from (select *, row_number() over (partition by origin_name, id order by computed_at desc nulls last, arrived_at desc nulls last) rn
  from pseudotime where id is not null) where rn = 1 and res is not null and isfinite(res) and res not in (-1, -100))"""


def with_(*parts: str) -> str:
    return "with recursive " + ",\n".join(parts) + "\n"
