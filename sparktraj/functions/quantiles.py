"""Exact quantiles per group in bounded memory (linear interpolation of neighbouring order statistics).

A sketch brackets every wanted rank; one more pass counts the rows below the bracket and keeps the distinct values inside it
with their counts, a ten-thousandth of the rows or so, among which the order statistics are picked. No group is collected.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 10_000


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float]) -> DataFrame:
    """(keys, p, q); nulls and NaN are left out, a group without values gives no rows."""
    df = df.select(*keys, F.col(value).cast("double").alias("_v")).where("_v is not null and not isnan(_v)")
    # the sketch errs by n / ACCURACY ranks at most; small groups are bracketed by their whole range
    near = [[max(0.0, p - 5 / ACCURACY), min(1.0, p + 5 / ACCURACY)] for p in probs]
    flat = [b for n in near for b in n]
    sketch = df.groupBy(*keys).agg(F.count("*").alias("_n"), F.percentile_approx("_v", flat, ACCURACY).alias("_a"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    if not keys:
        return _whole_column(df, probs, near, sketch)
    small = F.col("_n") <= 2 * ACCURACY
    pairs = [F.struct(F.lit(float(p)).alias("p"), F.when(small | F.lit(near[i][0] == 0), F.col("_lo")).otherwise(F.col("_a")[2 * i]).alias("lo"), F.when(small | F.lit(near[i][1] == 1), F.col("_hi")).otherwise(F.col("_a")[2 * i + 1]).alias("hi")) for i, p in enumerate(probs)]
    sketch = sketch.select(*[F.col(k).alias(f"_{k}") for k in keys], "_n", F.array(*pairs).alias("_b"))
    match = [F.col(f"_{k}").eqNullSafe(F.col(k)) for k in keys]
    rows = df.join(sketch, match).select(*keys, "_v", "_n", F.explode("_b").alias("b")).select(*keys, "_v", "_n", "b.*")
    return _picked(rows, keys)


def _whole_column(df: DataFrame, probs: list[float], near: list[list[float]], sketch: DataFrame) -> DataFrame:
    """The brackets of a single group are constants."""
    k = sketch.first()
    if not k["_n"]:
        return df.select(F.lit(0.0).alias("p"), F.col("_v").alias("q")).limit(0)
    small, a = k["_n"] <= 2 * ACCURACY, k["_a"]
    brackets = [F.struct(F.lit(float(p)).alias("p"), F.lit(k["_lo"] if small or near[i][0] == 0 else a[2 * i]).alias("lo"), F.lit(k["_hi"] if small or near[i][1] == 1 else a[2 * i + 1]).alias("hi")) for i, p in enumerate(probs)]
    rows = df.select("_v", F.lit(k["_n"]).cast("long").alias("_n"), F.explode(F.array(*brackets)).alias("b")).select("_v", "_n", "b.*")
    return _picked(rows, [])


def _picked(rows: DataFrame, keys: list[str]) -> DataFrame:
    # one row per distinct value of the bracket; everything below folds into a single one
    folded = rows.where("_v <= hi").withColumn("_v", F.when(F.col("_v") >= F.col("lo"), F.col("_v"))).groupBy(*keys, "p", "_n", "_v").agg(F.count("*").alias("c"))
    w = Window.partitionBy(*keys, "p").orderBy(F.col("_v").asc_nulls_first())
    upto = folded.withColumn("upto", F.sum("c").over(w)).where("_v is not null").withColumn("pos", F.col("p") * (F.col("_n") - 1))
    low = F.min(F.when(F.col("upto") > F.floor("pos"), F.col("_v")))
    high = F.min(F.when(F.col("upto") > F.ceil("pos"), F.col("_v")))
    return upto.groupBy(*keys, "p").agg((low + (high - low) * F.max(F.col("pos") - F.floor("pos"))).alias("q"))
