"""Constructors, imports, merges and exports of labelled clouds."""
from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashrand import uniform
from ..functions.ordered import numbered, running_sum
from ..functions.scalars import with_scalars

UNSELECTED, UNPINNED = -100.0, -1.0


def construct(points: DataFrame, labels: DataFrame | None = None, dim: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Checks a cloud (id, x) and its labels (id, labels_name, label): equal lengths, no nulls, unique ids; source_row defaults to
    the id. Labels without a name stand under "default"."""
    if "id" not in points.columns or "x" not in points.columns:
        raise ValueError("a cloud needs the columns id and x")
    if "events_sel" not in points.columns:
        points = points.withColumn("events_sel", F.col("id"))
    bad = points.agg(F.count(F.when(F.col("x").isNull() | (F.size(F.array_compact("x")) != F.size("x")), 1)).alias("nulls"), F.count_distinct(F.size("x")).alias("sizes"), F.first(F.size("x")).alias("dim"), (F.count("*") - F.count_distinct("id")).alias("repeats")).first()
    if bad["nulls"] or bad["sizes"] > 1 or bad["repeats"] or (dim and bad["dim"] not in (None, dim)):
        raise ValueError(f"not a cloud: {bad.asDict()}")
    if labels is not None and "labels_name" not in labels.columns:
        labels = labels.withColumn("labels_name", F.lit("default"))
    return points, labels


def summary(points: DataFrame, labels: DataFrame) -> DataFrame:
    """(labels_name, n, levels): rows and distinct labels of every label set."""
    n = points.agg(F.count("*").alias("n"))
    return labels.groupBy("labels_name").agg(F.count_distinct("label").alias("levels")).transform(lambda t: with_scalars(t, n)).select("labels_name", "n", "levels")


def gate_labels(gates: DataFrame, events: str, labels: str, origin: str) -> tuple[DataFrame, DataFrame]:
    """From gate membership (id, path, gate_order): events lie in a gate whose path matches ``events``; an event's label is the
    first gate that matches ``labels``, "ungated" without one; gates that match ``origin`` name origins.

    Returns (id, label) and the names (label) of origins."""
    picked = gates.where(F.col("path").rlike(events)).select("id").distinct()
    g = gates.withColumn("label", F.element_at(F.split("path", "/"), -1))
    named = g.where(F.col("path").rlike(labels)).groupBy("id").agg(F.min_by("label", "gate_order").alias("label"))
    out = picked.join(named, "id", "left").select("id", F.coalesce("label", F.lit("ungated")).alias("label"))
    return out, g.where(F.col("label").rlike(origin)).select("label").distinct()


def compensate(events: DataFrame, inverse: list[list[float]]) -> DataFrame:
    """x times the inverse spillover matrix."""
    cols = [sum((F.col("x")[i] * float(inverse[i][j]) for i in range(len(inverse))), F.lit(0.0)) for j in range(len(inverse[0]))]
    return events.withColumn("x", F.array(*cols))


def choose_channels(events: DataFrame, table: DataFrame) -> tuple[DataFrame, list[str]]:
    """Channels with use = 1 of the channel table (name, desc, use, position), called by desc or else by name."""
    rows = table.where("use = 1").orderBy("position").collect()  # a file's channels
    return events.withColumn("x", F.array(*[F.col("x")[r["position"]] for r in rows])), [r["desc"] or r["name"] for r in rows]


def with_offsets(frames: DataFrame, sizes: DataFrame) -> DataFrame:
    """Rows of several files (file_id, events_sel) as rows of their concatenation: events_sel plus the sizes (file_id, n) of
    the files before."""
    before = running_sum(sizes.select("file_id", "n"), [], [F.col("file_id")], "n", "upto").select("file_id", (F.col("upto") - F.col("n")).alias("offset"))
    return frames.join(before, "file_id").withColumn("row", F.col("events_sel") + F.col("offset"))


def merge(clouds: list[DataFrame], seed: int | None = None) -> DataFrame:
    """(file_id, id, x, events_sel, row): several clouds as one; ids are kept per file, rows shifted by the files before, in an
    order that a hash of the seed shuffles when it is given."""
    all_ = None
    for n, c in enumerate(clouds):
        one = c.select(F.lit(n + 1).alias("file_id"), "id", "x", "events_sel")
        all_ = one if all_ is None else all_.unionByName(one)
    sizes = all_.groupBy("file_id").agg(F.max("events_sel").alias("n"))
    out = with_offsets(all_, sizes)
    return out if seed is None else out.orderBy(uniform(seed, "file_id", "id"), "file_id", "id")


def parameter_table(points: DataFrame, names: list[str]) -> DataFrame:
    """(name, position, max_range, min_range): a file's parameter table, range = max + 1, minimum = min(0, min - 1)."""
    e = points.select(F.posexplode("x").alias("position", "v")).groupBy("position").agg((F.max("v") + 1).alias("max_range"), F.least(F.lit(0.0), F.min("v") - 1).alias("min_range"))
    name = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("position") + 1)
    return e.select(name.alias("name"), "position", "max_range", "min_range")


def channel_table(names: list[str], descs: list[str | None], spark: SparkSession) -> DataFrame:
    """(position, name, desc, use) with use = 0 everywhere, to be edited and read back."""
    return spark.createDataFrame([(i, n, d, 0) for i, (n, d) in enumerate(zip(names, descs))], "position int, name string, desc string, use int")


def path_report(times: DataFrame, walks: DataFrame) -> DataFrame:
    """(id, which_event, local_pseudotime): 1000 and the dense rank of pt among the walks' points, -1 for the others."""
    on = walks.select(F.col("v").alias("id")).distinct()
    chosen = times.join(on, "id", "left_semi")
    from ..operators.sparse import rank_bins

    ranks = rank_bins(chosen.select("id", "pt"), 1).select("id", F.col("t").alias("rank"))
    return times.select("id").join(ranks, "id", "left").select("id", F.when(F.col("rank").isNull(), -1).otherwise(1000).alias("which_event"), F.coalesce("rank", F.lit(-1)).alias("local_pseudotime"))


def enrichment(sources: DataFrame, points: DataFrame, layout: DataFrame, times: DataFrame, labels: DataFrame, pinned: dict[str, DataFrame] | None = None) -> DataFrame:
    """One row per event of the source files (file_id, events_sel): layout times 100, dense rank of pseudotime, and for every label
    set of labels (id, labels_name, label) the number of the label in a column label_{name}; -100 for events that aren't
    among the points. Each pinned batch of walks (name -> walk_id, step, v) adds which_event_{name}, 1000 for events on it and -1 for
    other points, and local_pseudotime_{name}, the dense rank among them; -100 again for the rest."""
    from ..operators.sparse import rank_bins

    sets = sorted(r[0] for r in labels.select("labels_name").distinct().collect())  # label sets
    codes = numbered(labels.select("labels_name", "label").distinct(), ["labels_name"], [F.col("label")], "code")
    coded = labels.join(codes, ["labels_name", "label"]).groupBy("id").agg(*[F.min(F.when(F.col("labels_name") == n, F.col("code"))).alias(f"label_{n}") for n in sets]) if sets else None
    ranks = rank_bins(times.select("id", "pt"), 1).select("id", F.col("t").alias("pseudotime"))
    rows = points.select("id", "file_id", "events_sel").join(layout.select("id", (F.col("x")[0] * 100).alias("layout_1"), (F.col("x")[1] * 100).alias("layout_2")), "id", "left")
    rows = rows.join(ranks, "id", "left")
    rows = rows.join(coded, "id", "left") if sets else rows
    for name, walks in (pinned or {}).items():
        rows = rows.join(path_report(times, walks).toDF("id", f"which_event_{name}", f"local_pseudotime_{name}"), "id", "left")
    names = [c for c in rows.columns if c not in ("id", "file_id", "events_sel")]
    rows = rows.groupBy("file_id", "events_sel").agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("id"))).alias(c) for c in names])
    out = sources.select("file_id", "events_sel").distinct().join(rows, ["file_id", "events_sel"], "left")
    return out.select("file_id", "events_sel", *[F.coalesce(F.col(c).cast("double"), F.lit(UNSELECTED)).alias(c) for c in names])


def _normal(seed: int):
    """A normal variate that follows from the id, by two uniforms."""
    return F.sqrt(-2 * F.log(1 - uniform(seed, "id"))) * F.cos(2 * math.pi * uniform(seed + 1000, "id"))


def noisy_circle(spark: SparkSession, n: int, radius: float = 1.0, sd: float = 0.1, shift: tuple[float, ...] = (0.0, 0.0), seed: int = 1) -> DataFrame:
    """(id, x): n points about a circle; each follows from its id and the seed, however the rows are partitioned."""
    a = uniform(seed, "id") * 2 * math.pi
    x = [radius * F.cos("a") + _normal(seed + 1) * sd + shift[0], radius * F.sin("a") + _normal(seed + 2) * sd + shift[1], *[_normal(seed + 3 + i) * sd + s for i, s in enumerate(shift[2:])]]
    return spark.range(n).withColumn("a", a).select("id", F.array(*x).alias("x"))


def snowman(spark: SparkSession, n: int, dims: int = 2, seed: int = 1) -> DataFrame:
    """Three noisy circles above each other, rows below 0 dropped."""
    parts = [noisy_circle(spark, m, r, 0.1, (0.0, y, *[0.0] * (dims - 2)), seed + 10 * i) for i, (m, r, y) in enumerate(((n, 1.0, 0.0), (n, 0.7, 1.7), (n // 2, 0.4, 2.8)))]
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("id", F.col("id") * 3 + i)
        out = p if out is None else out.unionByName(p)
    return out.where(F.col("x")[1] >= 0)


def handle(points: DataFrame, a: int, b: int, step: float = 0.1, height: float = 10.0) -> DataFrame:
    """Adds a dimension, 0 for the points, and a handle in it: an upright stem over point a, one over point b, both at multiples
    of step * height up to height, and at full height a straight bridge from a's stem to b's by steps.

    New ids follow the largest one: a's stem, b's stem, the bridge, each in order."""
    ends = points.where(F.col("id").isin(a, b)).groupBy().agg(F.max(F.when(F.col("id") == a, F.col("x"))).alias("p"), F.max(F.when(F.col("id") == b, F.col("x"))).alias("q"))
    top = points.agg(F.max("id").alias("top"))
    n = int(1 / step + 1e-9)
    k = with_scalars(ends, top).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3 * n - 1))))
    k = k.withColumn("part", F.floor(F.col("k") / n)).withColumn("t", (F.col("k") % n + 1) * step)
    line = F.zip_with("p", "q", lambda u, v: u + (v - u) * F.col("t"))
    base = F.when(F.col("part") == 0, F.col("p")).when(F.col("part") == 1, F.col("q")).otherwise(line)
    up = F.when(F.col("part") < 2, F.col("t") * height).otherwise(F.lit(float(n * step * height)))
    new = k.select((F.col("top") + F.col("k") + 1).alias("id"), F.concat(base, F.array(up)).alias("x"))
    return points.select("id", F.concat("x", F.array(F.lit(0.0))).alias("x")).unionByName(new)


def save(tables: dict[str, DataFrame], path: str, about: dict) -> None:
    """A handle on disk: every table as parquet under the path, and a table of one row with what they are called and other values."""
    spark = next(iter(tables.values())).sparkSession
    for i, df in enumerate(tables.values()):
        df.write.mode("overwrite").parquet(f"{path}/table_{i}")
    spark.createDataFrame([(json.dumps(about | {"tables": list(tables)}),)], "about string").write.mode("overwrite").parquet(f"{path}/about")


def load(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict]:
    about = json.loads(spark.read.parquet(f"{path}/about").first()[0])
    return {n: spark.read.parquet(f"{path}/table_{i}") for i, n in enumerate(about.pop("tables"))}, about
