"""Row numbers and running sums over large groups without a task that holds a whole group.

Rows are cut into range partitions by (keys, order); each partition numbers or sums its own stretch of a group, and the totals of
the stretches before, one row per partition and group, are added.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written


def _stretches(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    by = [*map(F.col, keys), *order]
    return written(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_part", F.spark_partition_id()), "ranges")


def _added(rows: DataFrame, keys: list[str], total: Column, local: Column, out: str) -> DataFrame:
    sizes = rows.groupBy("_part", *keys).agg(total.alias("_c"))
    w = Window.partitionBy(*keys).orderBy("_part") if keys else Window.orderBy("_part")
    before = sizes.withColumn("_before", F.coalesce(F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    before = before.select(F.col("_part").alias("_p"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_before")
    match = [F.col("_part") == F.col("_p"), *[F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]]
    return rows.withColumn(out, local).join(before, match).withColumn(out, F.col(out) + F.col("_before")).drop("_part", "_p", "_before", *[f"_k{i}" for i in range(len(keys))])


def numbered(df: DataFrame, keys: list[str], order: list[Column], out: str = "n") -> DataFrame:
    """Row number from 1 within the keys, in the given order (make it total)."""
    rows = _stretches(df, keys, order)
    return _added(rows, keys, F.count("*"), F.row_number().over(Window.partitionBy("_part", *keys).orderBy(*order)).cast("long"), out)


def running_sum(df: DataFrame, keys: list[str], order: list[Column], value: str, out: str = "sum") -> DataFrame:
    """Sum of ``value`` up to and with each row."""
    rows = _stretches(df, keys, order)
    w = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return _added(rows, keys, F.sum(value), F.sum(value).over(w), out)
