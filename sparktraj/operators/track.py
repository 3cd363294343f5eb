"""Trackers: expression and populations along segments of pseudotime."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantiles
from ..functions.scalars import with_scalars


def scaled(times: DataFrame) -> DataFrame:
    """pt over its maximum."""
    return with_scalars(times, times.agg(F.max("pt").alias("m"))).select("id", F.try_divide("pt", "m").alias("pt"))


def breaks_of(times: DataFrame, parts: int, power: float = 1.0, how: str = "quantile", given: list[float] | None = None) -> list[float]:
    """Sorted distinct break points: quantiles of the distinct times at (i / parts)^power, equal widths, or those given."""
    if given is not None:
        return sorted(set(given))
    if how == "uniform":
        lo, hi = times.agg(F.min("pt"), F.max("pt")).first()
        return [] if lo is None else sorted({lo + (hi - lo) * i / parts for i in range(parts + 1)})
    probs = [(i / parts) ** power for i in range(parts + 1)]
    return sorted({row["q"] for row in exact_quantiles(times.select("pt").distinct(), [], "pt", probs).collect()})  # parts + 1 rows


def segments(times: DataFrame, breaks: list[float]) -> DataFrame:
    """(id, segment): right-closed intervals numbered from 1, the first one closed on the left too."""
    b = F.array(*[F.lit(float(x)) for x in breaks])
    n = F.size(F.filter(b, lambda v: v < F.col("pt")))
    out = times.where((F.col("pt") >= breaks[0]) & (F.col("pt") <= breaks[-1])) if breaks else times.limit(0)
    return out.select("id", F.greatest(F.lit(1), n).alias("segment"))


def marker_by_walk(walks: DataFrame, seg: DataFrame, points: DataFrame, marker: int) -> DataFrame:
    """(segment, walk_id, value, n): mean of one channel over a walk's points in a segment."""
    rows = walks.join(seg.select(F.col("id").alias("v"), "segment"), "v").join(points.select(F.col("id").alias("v"), F.col("x")[marker].alias("value")), "v")
    return rows.groupBy("segment", "walk_id").agg(F.avg("value").alias("value"), F.count("*").alias("n"))


def segment_points(walks: DataFrame, seg: DataFrame) -> DataFrame:
    """(segment, walk_id, id): the points behind a tracker's values, long form."""
    return walks.join(seg.select(F.col("id").alias("v"), "segment"), "v").select("segment", "walk_id", F.col("v").alias("id")).distinct()


def markers(walks: DataFrame, seg: DataFrame, points: DataFrame, dim: int) -> DataFrame:
    """(marker, segment, value): mean over walks of the walks' means, every channel."""
    rows = walks.join(seg.select(F.col("id").alias("v"), "segment"), "v").join(points.select(F.col("id").alias("v"), "x"), "v")
    per = rows.groupBy("segment", "walk_id").agg(*[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(dim)])
    both = per.groupBy("segment").agg(F.array(*[F.avg(f"m{i}") for i in range(dim)]).alias("x"))
    return both.select("segment", F.posexplode("x").alias("marker", "value"))


def tracked(walks: DataFrame, seg: DataFrame, points: DataFrame, chosen: list[int]) -> DataFrame:
    """One channel by walk (segment, walk_id, value, n), several as means over walks (segment, marker, value)."""
    if len(chosen) == 1:
        return marker_by_walk(walks, seg, points, chosen[0])
    some = points.select("id", F.array(*[F.col("x")[i] for i in chosen]).alias("x"))
    return markers(walks, seg, some, len(chosen)).withColumn("marker", F.element_at(F.array(*map(F.lit, chosen)), F.col("marker") + 1))


def populations(walks: DataFrame, seg: DataFrame, labels: DataFrame, log2: bool = False) -> DataFrame:
    """(segment, label, n): distinct points of each label on the walks in a segment; log2 of it (null for none) if wanted."""
    on = walks.select(F.col("v").alias("id")).distinct()
    rows = on.join(seg, "id").join(labels.select("id", "label"), "id").groupBy("segment", "label").agg(F.count("*").alias("n"))
    return rows.withColumn("n", F.when(F.col("n") > 0, F.log2("n"))) if log2 else rows


def composition(seg: DataFrame, labels: DataFrame, proportions: bool = True) -> DataFrame:
    """(segment, label, value): counts of every label in every segment, zeros included, or shares of the segment."""
    rows = seg.join(labels.select("id", "label"), "id")
    counts = rows.groupBy("segment", "label").agg(F.count("*").alias("n"))
    every = counts.agg(F.collect_set("label").alias("all"))  # the labels of a display
    grid = with_scalars(counts.select("segment").distinct(), every).select("segment", F.explode("all").alias("label"))
    full = grid.join(counts, ["segment", "label"], "left").select("segment", "label", F.coalesce("n", F.lit(0)).alias("value"))
    return full.withColumn("value", F.col("value") / F.sum("value").over(Window.partitionBy("segment"))) if proportions else full


def window_breaks(times: DataFrame, n: int, how: str = "squared") -> list[float]:
    """Windows by quantiles with squared probabilities, equal widths, or plain quantiles."""
    if how == "uniform":
        return breaks_of(times, n, how="uniform")
    probs = [(i / n) ** 2 if how == "squared" else i / n for i in range(n + 1)]
    return sorted({row["q"] for row in exact_quantiles(times, [], "pt", probs).collect()})  # n + 1 rows


def window_medians(points: DataFrame, seg: DataFrame, dim: int) -> DataFrame:
    """(segment, marker, q): median of every channel in every window."""
    rows = seg.join(points.select("id", F.posexplode("x").alias("marker", "value")), "id")
    return exact_quantiles(rows, ["segment", "marker"], "value", [0.5]).select("segment", "marker", "q")


def gate_share(seg: DataFrame, gate: DataFrame) -> DataFrame:
    """(segment, share): part of a window's points that lie in the gate (id)."""
    g = gate.select("id").distinct().withColumn("in", F.lit(1))
    return seg.join(g, "id", "left").groupBy("segment").agg(F.avg(F.coalesce("in", F.lit(0))).alias("share"))


def label_order(times: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, mean, rank): labels by mean pseudotime."""
    m = times.join(labels.select("id", "label"), "id").groupBy("label").agg(F.avg("pt").alias("mean"))
    return m.withColumn("rank", F.row_number().over(Window.orderBy("mean", "label")))  # one row per label


def highlight(times: DataFrame, walks: DataFrame, lo: float, hi: float) -> DataFrame:
    """(id): points on the walks with pt in [lo, hi]."""
    return times.where(F.col("pt").between(lo, hi)).join(walks.select(F.col("v").alias("id")).distinct(), "id", "left_semi").select("id")


class WalkGroups:
    """Sets of walk ids under marking: mark, clear, remove as junk, undo, pin."""

    def __init__(self, walks: DataFrame):
        self.all = walks.select("walk_id").distinct()
        self.history: list[tuple[DataFrame, DataFrame]] = []
        self.marked = self.all.limit(0)
        self.junk = self.all.limit(0)
        self.pins: list[DataFrame] = []

    def _keep(self):
        self.history.append((self.marked, self.junk))

    def mark(self, ids: DataFrame) -> None:
        self._keep()
        self.marked = self.marked.union(ids.select("walk_id")).distinct().join(self.junk, "walk_id", "left_anti")

    def clear(self) -> None:
        self._keep()
        self.marked = self.all.limit(0)

    def remove(self, ids: DataFrame) -> None:
        self._keep()
        self.junk = self.junk.union(ids.select("walk_id")).distinct()
        self.marked = self.marked.join(self.junk, "walk_id", "left_anti")

    def undo(self) -> None:
        if self.history:
            self.marked, self.junk = self.history.pop()

    def pin(self) -> DataFrame:
        """(batch, walk_id) of every batch pinned so far, this one included."""
        self.pins.append(self.marked.withColumn("batch", F.lit(len(self.pins) + 1)))
        out = self.pins[0]
        for p in self.pins[1:]:
            out = out.unionByName(p)
        return out.select("batch", "walk_id")
