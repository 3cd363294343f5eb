"""Problem 8: mix sources to target weights of tokens.

Every document's size is its tokens by a public tokenizer. Per mix, the tokens of the cells (source, language, length class) are
raked to the mix's source targets and to the languages' and length classes' shares of the corpus (documents carry no topic; the
length class stands in its place), never above max_repeats times what a cell has. The ratio of a cell's raked to its present
tokens is the expected number of copies of its documents. The whole part is given to each; of the rest documents are drawn in
the order of u / fraction (u from a hash) until the source's tokens are used up; what a document too large for the rest leaves
open is filled in further rounds. The cut is found from a histogram of that order, and a running sum only within the bin that holds it.

Defined cases: null and empty texts have no tokens and are never drawn; a null source belongs to no target; a null language is
a language; a source that doesn't exist or is too small even at max_repeats is reported with its gap; null weights count as 0
and null max_repeats as 1; an empty table gives reports with nothing used.
"""
from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small_side
from .tokens import VOCABULARY, token_counts

#: Bins per unit of the drawing order.
BINS = 1024
KEEP = ["mix_name", "doc_id", "source", "n_tokens"]


def raked_rates(tokens, source, lang, size, target, cap, rounds: int = 80) -> np.ndarray:
    """Expected copies per cell: tokens raked to the targets of source (by cell: target[source]), language and size class."""
    have = np.bincount(source, tokens)
    goal = np.minimum(target, have * cap)
    w = tokens * (goal / np.maximum(have, 1e-9))[source]
    lt, st = np.bincount(lang, tokens), np.bincount(size, tokens)
    lt, st = lt / max(lt.sum(), 1e-9) * goal.sum(), st / max(st.sum(), 1e-9) * goal.sum()
    top = tokens * cap[source]
    for _ in range(rounds):
        for m, t in ((lang, lt), (size, st), (source, goal)):
            s = np.bincount(m, w, len(t))
            w = np.minimum(w * np.where(s > 0, t / np.where(s > 0, s, 1), 0)[m], top)
    for _ in range(50):  # what the cap cut off goes to cells of the source that have room
        s = np.bincount(source, w, len(goal))
        room = np.bincount(source, top - w, len(goal))
        w = np.minimum(w + ((goal - s) / np.maximum(room, 1e-9))[source] * (top - w) * ((goal - s) > 0)[source], top)
        s = np.bincount(source, w, len(goal))
        w *= np.where(s > goal, goal / np.maximum(s, 1e-9), 1)[source]
    return w / np.maximum(tokens, 1e-9)


def mix(targets: DataFrame, docs: DataFrame, seed: int = 23, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """targets as source_targets, docs (doc_id, text, source, lang, n_chars) -> the copies (mix_name, doc_id, source, n_tokens,
    copies) and the report per source."""
    plans, _ = small_side(targets.where("mix_name is not null and source is not null").dropDuplicates(["mix_name", "source"]).select("mix_name", "source", F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce("max_repeats", F.lit(1)).alias("max_repeats"), (F.coalesce("weight", F.lit(0.0)) * F.coalesce("total_tokens", F.lit(0))).alias("target"), "total_tokens"))
    size = F.when(F.length("text") < 500, 0).when(F.length("text") < 2000, 1).otherwise(2)
    about = docs.select("doc_id", "source", F.coalesce("lang", F.lit("")).alias("lang"), size.alias("size"))
    sized = materialize(token_counts(docs, vocabulary).where("n_tokens > 0").join(about, "doc_id"), "sized")
    cells = materialize(sized.groupBy("source", "lang", "size").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")), "cells")

    def fit(c: pd.DataFrame) -> pd.DataFrame:
        s, names = pd.factorize(c["source"])
        lang, _ = pd.factorize(c["lang"])
        target, cap = np.zeros(len(names)), np.zeros(len(names))
        target[s], cap[s] = c["target"].to_numpy(float), c["max_repeats"].to_numpy(float)
        rate = raked_rates(c["tokens"].to_numpy(float), s, lang, c["size"].to_numpy(), target, cap)
        return c.assign(rate=rate)[["mix_name", "source", "lang", "size", "rate"]]

    # a mix's cells are its sources times languages times three, whatever the number of documents
    rates = cells.join(plans, "source").groupBy("mix_name").applyInPandas(fit, "mix_name string, source string, lang string, size int, rate double")
    rates, _ = small_side(rates)
    rows = sized.join(rates, ["source", "lang", "size"])
    u = (F.pmod(F.xxhash64("doc_id", "mix_name", F.lit(seed)), F.lit(2**40)) + 1) / float(2**40 + 1)
    part = F.col("rate") - F.floor(F.col("rate") + 1e-9)
    rows = rows.select("mix_name", "source", "doc_id", "n_tokens", F.floor(F.col("rate") + 1e-9).alias("whole"), F.when(part > 1e-9, u / part).alias("order"))
    rows = materialize(rows.withColumn("bin", F.when(F.col("order").isNotNull(), F.least(F.floor(F.col("order") * BINS), F.lit(64 * BINS)))), "rows")
    have = cells.groupBy("source").agg(F.sum("tokens").alias("available"))
    used = rows.groupBy("mix_name", "source").agg(F.sum(F.col("whole") * F.col("n_tokens")).alias("whole_tokens"))
    budget = plans.join(have, "source").join(used, ["mix_name", "source"]).select("mix_name", "source", (F.least(F.col("target"), F.col("available") * F.col("max_repeats")) - F.col("whole_tokens")).alias("budget"))
    copies = [rows.where("whole > 0").select(*KEEP, F.col("whole").alias("copies"))]
    rows = rows.where("bin is not null")
    while True:
        # documents larger than what is left are passed over, for good as it only shrinks; the next round fills what the cut left open
        left, _ = small_side(budget)
        rows = materialize(rows.join(left, ["mix_name", "source"]).where("n_tokens <= budget"), "rows")
        open_ = rows
        bins = open_.groupBy("mix_name", "source", "bin").agg(F.sum("n_tokens").alias("t"), F.first("budget").alias("budget"))
        upto = F.sum("t").over(Window.partitionBy("mix_name", "source").orderBy("bin"))
        over = F.when(F.col("upto") > F.col("budget"), F.col("bin"))
        edge = bins.withColumn("upto", upto).groupBy("mix_name", "source").agg(F.min(over).alias("cut"), F.min_by(F.col("budget") - F.col("upto") + F.col("t"), over).alias("left"))
        open_ = open_.join(small_side(edge)[0], ["mix_name", "source"]).where("cut is null or bin <= cut")  # one row per source of a mix
        running = F.sum("n_tokens").over(Window.partitionBy("mix_name", "source").orderBy("order", "doc_id"))
        cut = open_.where("bin = cut").withColumn("sum", running).where("sum <= left")
        won = materialize(open_.where("cut is null or bin < cut").select(*KEEP).unionByName(cut.select(*KEEP)), "won")
        if won.isEmpty():
            break
        copies.append(won.select(*KEEP, F.lit(1).cast("long").alias("copies")))
        spent = won.groupBy("mix_name", "source").agg(F.sum("n_tokens").alias("spent"))
        budget = left.join(spent, ["mix_name", "source"], "left").select("mix_name", "source", (F.col("budget") - F.coalesce("spent", F.lit(0))).alias("budget"))
        rows = rows.drop("budget").join(won.select("mix_name", "doc_id"), ["mix_name", "doc_id"], "left_anti")
    copies = functools.reduce(DataFrame.unionByName, copies).groupBy(*KEEP).agg(F.sum("copies").cast("int").alias("copies"))
    copies = materialize(copies, "copies")
    got = copies.groupBy("mix_name", "source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("actual_tokens"), F.count("*").alias("documents"), F.max("copies").alias("most_copies"))
    report = plans.join(have, "source", "left").join(got, ["mix_name", "source"], "left").na.fill(0, ["available", "actual_tokens", "documents", "most_copies"])
    report = report.withColumn("actual_share", F.try_divide(F.col("actual_tokens"), F.sum("actual_tokens").over(Window.partitionBy("mix_name"))))
    report = report.withColumn("gap_tokens", F.greatest(F.lit(0.0), F.col("target") - F.col("actual_tokens")))
    return copies, report.select("mix_name", "source", "weight", "max_repeats", "target", "available", "actual_tokens", "documents", "most_copies", "actual_share", "gap_tokens")


def _inputs(spark, d: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{d}/source_targets.parquet"), spark.read.parquet(f"{d}/documents.parquet")


def p8_sample(spark, d: str) -> DataFrame:
    return mix(*_inputs(spark, d))[0]


def p8_report(spark, d: str) -> DataFrame:
    return mix(*_inputs(spark, d))[1]
