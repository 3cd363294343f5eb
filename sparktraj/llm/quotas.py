"""Problem 5: a sample with target shares per category, with minimums and a report of what could not be met.

The population of a plan is counted per (label, file) cell. Iterative proportional fitting rakes the cells to the plan's label
counts and to the files' shares in the population; a row's weight is its cell's target over its cell's count. Each row gets the
key -ln(u)/weight with u from a hash, and each label takes its rows of smallest key: share * n_total of them, at least
min_rows. Labels with too few rows give all they have and are reported.

Defined cases: unusable points, null labels and labels no plan names are left out; labels compare without case and outer
blanks; a label wanted but absent has 0 available; a null file is a file of its own; ties in key go to the smaller id; repeated
plan rows count once; empty tables give no rows (or, with plans alone, rows with nothing available).
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import current_points, is_usable, materialize, small_side
from .percentiles import current_labels

#: Bins of keys for every doubling of the key.
BINS = 256


def rake(cells: np.ndarray, targets: list[np.ndarray], margins: list[np.ndarray], rounds: int = 60) -> np.ndarray:
    """Scale cell sizes until each margin's sums meet its targets as far as they agree; margins[m][i]: class of cell i in m."""
    w = cells.astype(float).copy()
    for _ in range(rounds):
        for t, m in zip(targets, margins):
            s = np.bincount(m, w, len(t))
            w *= np.where(s > 0, t / np.where(s > 0, s, 1), 0)[m]
    return w


def wanted_rows(plans: DataFrame) -> DataFrame:
    n = F.round(F.coalesce("share", F.lit(0.0)).cast("decimal(18,9)") * F.coalesce("n_total", F.lit(0))).cast("long")
    return plans.where("plan_name is not null and label is not null").dropDuplicates(["plan_name", "labels_name", "label"]).select("plan_name", "labels_name", "label", "share", "min_rows", "n_total", F.greatest(F.coalesce("min_rows", F.lit(0)), n).alias("wanted"), F.lower(F.trim("label")).alias("norm"))


def draw(plans: DataFrame, population: DataFrame, seed: int = 17) -> tuple[DataFrame, DataFrame, DataFrame]:
    """plans as target_mix, population (id, labels_name, norm, file_id) -> the sample (plan_name, label, id), the report by label, and
    the report by file (gap: actual less target share)."""
    plans, _ = small_side(wanted_rows(plans))
    population = population.withColumn("file", F.coalesce(F.col("file_id").cast("string"), F.lit("null"))).select("labels_name", "norm", "file", "id")
    cells = materialize(population.groupBy("labels_name", "norm", "file").agg(F.count("*").alias("n")), "cells")
    here = cells.join(plans.select("plan_name", "labels_name", "norm", "wanted"), ["labels_name", "norm"])
    whole = cells.groupBy("labels_name", "file").agg(F.sum("n").alias("file_n"))
    here = here.join(whole, ["labels_name", "file"]).select("plan_name", "labels_name", "norm", "file", "n", "wanted", "file_n")

    def fit(c: pd.DataFrame) -> pd.DataFrame:
        label, labels = pd.factorize(c["norm"])
        file, files = pd.factorize(c["file"])
        target = np.zeros(len(labels))
        target[label] = c["wanted"].to_numpy(float)
        natural = np.zeros(len(files))
        natural[file] = c["file_n"].to_numpy(float)
        w = rake(c["n"].to_numpy(float), [natural / natural.sum() * target.sum(), target], [file, label])
        return c.assign(weight=np.maximum(w / c["n"], 1e-12))[["plan_name", "labels_name", "norm", "file", "weight"]]

    # a plan's cells are its labels times the files, whatever the number of rows
    weights = here.groupBy("plan_name").applyInPandas(fit, "plan_name string, labels_name string, norm string, file string, weight double")
    weights, _ = small_side(weights)
    rows = population.join(weights, ["labels_name", "norm", "file"])
    u = (F.pmod(F.xxhash64("id", "plan_name", F.lit(seed)), F.lit(2**40)) + 1) / float(2**40 + 1)
    rows = rows.select("plan_name", "labels_name", "norm", "file", "id", (-F.log(u) / F.col("weight")).alias("key"))
    rows = rows.join(plans.select("plan_name", "labels_name", "norm", "label", "wanted"), ["plan_name", "labels_name", "norm"])
    # the threshold of a label's keys lies in one narrow bin: bins below are taken whole, and only that bin's rows are ordered
    rows = rows.withColumn("bin", F.floor(F.log2("key") * BINS).cast("int"))
    bins = rows.groupBy("plan_name", "label", "bin", "wanted").agg(F.count("*").alias("c"))
    run = bins.withColumn("upto", F.sum("c").over(Window.partitionBy("plan_name", "label").orderBy("bin")))
    over = F.when(F.col("upto") > F.col("wanted"), F.col("bin"))
    edge = run.groupBy("plan_name", "label").agg(F.min(over).alias("cut"), F.min_by(F.col("wanted") - F.col("upto") + F.col("c"), over).alias("rest"))
    rows = rows.join(small_side(edge)[0], ["plan_name", "label"]).where("cut is null or bin <= cut")
    last = rows.where("bin = cut").withColumn("r", F.row_number().over(Window.partitionBy("plan_name", "label").orderBy("key", "id"))).where("r <= rest")
    columns = ["plan_name", "labels_name", "label", "file", "id"]
    drawn = materialize(rows.where("cut is null or bin < cut").select(*columns).unionByName(last.select(*columns)), "sample")
    sample = drawn.select("plan_name", "labels_name", "label", "id")
    got = sample.groupBy("plan_name", "label").agg(F.count("*").alias("taken"))
    have = cells.groupBy("labels_name", "norm").agg(F.sum("n").alias("available"))
    report = plans.join(have, ["labels_name", "norm"], "left").join(got, ["plan_name", "label"], "left")
    report = report.withColumn("taken", F.coalesce("taken", F.lit(0))).withColumn("available", F.coalesce("available", F.lit(0)))
    report = report.withColumn("gap", F.col("wanted") - F.col("taken")).withColumn("actual_share", F.try_divide("taken", F.sum("taken").over(Window.partitionBy("plan_name"))))
    report = report.select("plan_name", "labels_name", "label", "share", "min_rows", "n_total", "wanted", "available", "taken", "gap", "actual_share")
    # the margin of files, which raking can only meet as far as labels and minimums leave it
    goal = here.select("plan_name", "labels_name", "file", "file_n").distinct()
    goal = goal.withColumn("target_share", F.col("file_n") / F.sum("file_n").over(Window.partitionBy("plan_name", "labels_name"))).drop("file_n")
    by_file = drawn.groupBy("plan_name", "labels_name", "file").agg(F.count("*").alias("taken"))
    files = goal.join(by_file, ["plan_name", "labels_name", "file"], "left").withColumn("taken", F.coalesce("taken", F.lit(0)))
    files = files.withColumn("actual_share", F.try_divide("taken", F.sum("taken").over(Window.partitionBy("plan_name"))))
    return sample, report, files.withColumn("gap", F.col("actual_share") - F.col("target_share"))


def _population(spark, d: str) -> tuple[DataFrame, DataFrame]:
    points = current_points(spark.read.parquet(f"{d}/points.parquet")).where(is_usable()).select("id", "file_id")
    labels = current_labels(spark.read.parquet(f"{d}/point_labels.parquet")).withColumnRenamed("label", "norm")
    return spark.read.parquet(f"{d}/target_mix.parquet"), materialize(labels.join(points, "id"), "population")


def p5_found(spark, d: str) -> DataFrame:
    return draw(*_population(spark, d))[1].where("gap > 0").select("plan_name", "label")


def p5_sample(spark, d: str) -> DataFrame:
    return draw(*_population(spark, d))[0]


def p5_report(spark, d: str) -> DataFrame:
    """Taken is, by definition, the lesser of wanted and available."""
    return draw(*_population(spark, d))[1].withColumn("actual_share", F.round("actual_share", 9))


def p5_files(spark, d: str) -> DataFrame:
    return draw(*_population(spark, d))[2]


P5_REPORT_SQL = """
with p as (select id from (select *, row_number() over (partition by id order by ingested_at desc nulls last) rn from points where id is not null)
  where rn = 1 and len(x) = 25 and list_count(x) = 25 and len(list_filter(x, lambda v: isnan(v))) = 0),
l as (select labels_name, lower(trim(label)) as norm, count(*) as n from (select *, row_number() over (partition by id, labels_name order by labelled_at desc nulls last) rn
  from point_labels where id is not null and labels_name is not null) join p using (id) where rn = 1 and label is not null group by 1, 2),
m as (select distinct plan_name, labels_name, label, share, min_rows, n_total, greatest(min_rows, round(share::decimal(18,9) * n_total))::bigint as wanted from target_mix),
t as (select m.*, coalesce(l.n, 0) as available, least(wanted, coalesce(l.n, 0)) as taken from m left join l on l.labels_name = m.labels_name and l.norm = lower(trim(m.label)))
select *, wanted - taken as gap, round(taken / nullif(sum(taken) over (partition by plan_name), 0), 9) as actual_share from t
"""
P5_SQL = """
with p as (select id from (select *, row_number() over (partition by id order by ingested_at desc nulls last) rn from points where id is not null)
  where rn = 1 and len(x) = 25 and list_count(x) = 25 and len(list_filter(x, lambda v: isnan(v))) = 0),
l as (select labels_name, lower(trim(label)) as norm, count(*) as n from (select *, row_number() over (partition by id, labels_name order by labelled_at desc nulls last) rn
  from point_labels where id is not null and labels_name is not null) join p using (id) where rn = 1 and label is not null group by 1, 2)
select distinct m.plan_name, m.label from target_mix m left join l on l.labels_name = m.labels_name and l.norm = lower(trim(m.label))
where coalesce(l.n, 0) < greatest(m.min_rows, round(m.share::decimal(18,9) * m.n_total))
"""
