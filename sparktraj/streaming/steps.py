"""Walk steps and pseudotime values as they arrive (Structured Streaming).

Late and repeated rows are handled by watermarks on the time of logging; state is bounded by the watermark.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_steps(steps: DataFrame, late: str = "2 hours") -> DataFrame:
    """Each (walk_id, step, v, logged_at) once, however often it arrives within the watermark."""
    return steps.withWatermark("logged_at", late).dropDuplicatesWithinWatermark(["walk_id", "step", "v", "logged_at"])


def steps_per_window(steps: DataFrame, window: str = "1 hour", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """(origin_name, begin, steps, walks): tumbling or sliding windows of logged steps per path model; walks are counted
    approximately, as exact distinct counts have no bounded state."""
    w = F.window("logged_at", window, slide) if slide else F.window("logged_at", window)
    g = first_steps(steps, late).groupBy("origin_name", w.alias("w"))
    return g.agg(F.count("*").alias("steps"), F.approx_count_distinct("walk_id").alias("walks")).select("origin_name", F.col("w.start").alias("begin"), "steps", "walks")


def walk_sessions(steps: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(walk_id, begin, end, steps): stretches of a walk without a longer gap in visited_at."""
    s = steps.withWatermark("visited_at", late).groupBy("walk_id", F.session_window("visited_at", gap).alias("w"))
    return s.agg(F.count("*").alias("steps")).select("walk_id", F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "steps")
