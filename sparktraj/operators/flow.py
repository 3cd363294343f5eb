"""Flow between communities along walks: the connectome's edges and nodes as tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantiles
from ..functions.scalars import with_scalars
from .vectors import avg_vector
from .walks import pairs


def transitions(walks: DataFrame, communities: DataFrame) -> DataFrame:
    """(a, b, n): steps of all walks between different communities (id, mc). Vertex pairs are folded before the two lookups."""
    p = pairs(walks).groupBy("src", "dst").agg(F.count("*").alias("n"))
    c = communities.where("mc is not null").select("id", "mc")
    p = p.join(c.select(F.col("id").alias("src"), F.col("mc").alias("a")), "src").join(c.select(F.col("id").alias("dst"), F.col("mc").alias("b")), "dst")
    return p.where("a <> b").groupBy("a", "b").agg(F.sum("n").alias("n"))


def balance(counts: DataFrame) -> DataFrame:
    """(mc, ins, outs, ratio): ratio outs / ins, 1 where nothing comes in."""
    both = counts.select(F.col("a").alias("mc"), F.col("n").alias("outs"), F.lit(0).cast("long").alias("ins")).unionByName(counts.select(F.col("b").alias("mc"), F.lit(0).cast("long").alias("outs"), F.col("n").alias("ins")))
    return both.groupBy("mc").agg(F.sum("ins").alias("ins"), F.sum("outs").alias("outs")).withColumn("ratio", F.when(F.col("ins") == 0, 1.0).otherwise(F.try_divide(F.col("outs"), F.col("ins"))))


def major(counts: DataFrame, hard_terminus: bool = False) -> DataFrame:
    """Keeps the stronger direction of every pair, a < b on ties; with ``hard_terminus`` nothing leaves where ratio < 1."""
    if hard_terminus:
        stops = balance(counts).where("ratio < 1").select(F.col("mc").alias("a"))
        counts = counts.join(stops, "a", "left_anti")
    back = counts.select(F.col("a").alias("b"), F.col("b").alias("a"), F.col("n").alias("m"))
    both = counts.join(back, ["a", "b"], "left")
    return both.where("m is null or n > m or (n = m and a < b)").select("a", "b", "n")


def flow_edges(counts: DataFrame, scale: str = "max", qq: float = 0.0, hard_terminus: bool = False, origins: DataFrame | None = None) -> DataFrame:
    """(a, b, n, weight, width, arrow): n over the flow of the community it leaves, half of its ins and outs (mean); over the largest
    of these halves (max); or (adaptive) over the ins of a community with ratio below 1, the outs of an origin (mc of
    ``origins``) and the half of any other. Arrows only for widths not under their qq-quantile, those above it 7 wider."""
    kept = major(counts, hard_terminus)
    half = (F.col("ins") + F.col("outs")) / 2
    bal = balance(counts)
    if scale == "max":
        e = with_scalars(kept, bal.agg(F.max(half).alias("s")))
    else:
        if scale == "adaptive":
            half = F.when(F.col("ratio") < 1, F.col("ins")).otherwise(half)
            if origins is not None:
                bal = bal.join(origins.select("mc").distinct().withColumn("origin", F.lit(True)), "mc", "left")
                half = F.when(F.col("origin"), F.col("outs")).otherwise(half)
        e = kept.join(bal.select(F.col("mc").alias("a"), half.alias("s")), "a")
    e = e.select("a", "b", "n", (F.col("n") / F.col("s")).alias("weight")).withColumn("width", F.pow("weight", F.lit(1.2)) * 19)
    e = with_scalars(e, exact_quantiles(e, [], "width", [qq]).select("q"))
    return e.select("a", "b", "n", "weight", (F.col("width") + F.when(F.col("width") > F.col("q"), 7).otherwise(0)).alias("width"), (F.col("width") >= F.col("q")).alias("arrow"))


def node_positions(layout: DataFrame, communities: DataFrame, dim: int = 2) -> DataFrame:
    """(mc, x): centroid of each community's points in the layout (id, x)."""
    return avg_vector(layout.join(communities.select("id", "mc"), "id").where("mc is not null"), ["mc"], dim)


def node_labels(communities: DataFrame, labels: DataFrame, without: str | None = "ungated") -> DataFrame:
    """(mc, label, n, share): label histogram of each community."""
    rows = communities.where("mc is not null").select("id", "mc").join(labels.select("id", "label"), "id")
    rows = rows if without is None else rows.where(F.col("label") != without)
    h = rows.groupBy("mc", "label").agg(F.count("*").alias("n"))
    return h.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("mc")))


def node_tags(counts: DataFrame, communities: DataFrame, origins: DataFrame) -> DataFrame:
    """(mc, terminus, origin): ratio below 1, and whether an origin (id) lies in the community."""
    o = communities.join(origins.select("id"), "id", "left_semi").select("mc").distinct().withColumn("origin", F.lit(True))
    return balance(counts).join(o, "mc", "left").select("mc", (F.col("ratio") < 1).alias("terminus"), F.coalesce("origin", F.lit(False)).alias("origin"))


def connectome(walks: DataFrame, communities: DataFrame, labels: DataFrame, layout: DataFrame, origins: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """Nodes (mc, x, terminus, origin) and edges of the flow between communities."""
    counts = transitions(walks, communities)
    nodes = node_positions(layout, communities).join(node_tags(counts, communities, origins), "mc", "left")
    begins = communities.join(origins.select("id"), "id", "left_semi").select("mc")
    return nodes, flow_edges(counts, origins=begins, **options)
