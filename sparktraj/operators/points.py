"""Point-wise transforms, normalisation, denoising and sampling of clouds (id, x)."""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashrand import uniform
from ..functions.ordered import numbered, running_sum
from ..functions.quantiles import exact_quantiles
from ..functions.scalars import with_scalars
from ..sources.shared import written
from .sparse import sparse_times_vectors
from .vectors import avg_vector, explode_dims, matrix, squared_distance


def asinh_transform(points: DataFrame, c: float = 5.0, f=None) -> DataFrame:
    """x := asinh(x / c), or any Column -> Column function of an element."""
    f = f or (lambda v: F.asinh(v / c))
    return points.withColumn("x", F.transform("x", f))


def normalize_percentile(points: DataFrame, p: float = 0.99, control=None) -> DataFrame:
    """(id, dim, value): each dimension divided by its p-quantile over the control rows (a condition; all by default)."""
    rows = explode_dims(points, "id")
    base = rows if control is None else explode_dims(points.where(control), "id")
    q = exact_quantiles(base, ["dim"], "value", [p]).select("dim", "q")
    return rows.join(F.broadcast(q), "dim").select("id", "dim", F.try_divide("value", "q").alias("value"))  # one row per dimension


def zscore(points: DataFrame) -> DataFrame:
    rows = explode_dims(points, "id")
    s = rows.groupBy("dim").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    return rows.join(F.broadcast(s), "dim").select("id", "dim", F.try_divide(F.col("value") - F.col("m"), F.col("s")).alias("value"))


def min_max(points: DataFrame) -> DataFrame:
    rows = explode_dims(points, "id")
    s = rows.groupBy("dim").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return rows.join(F.broadcast(s), "dim").select("id", "dim", F.try_divide(F.col("value") - F.col("lo"), F.col("hi") - F.col("lo")).alias("value"))


def denoise(points: DataFrame, lists: DataFrame, dim: int, rounds: int = 1) -> DataFrame:
    """x := mean of the neighbours' x, all at once, ``rounds`` times."""
    for _ in range(rounds):
        points = avg_vector(lists.join(points.select(F.col("id").alias("dst"), "x"), "dst"), ["src"], dim).withColumnRenamed("src", "id")
    return points


def magic(points: DataFrame, transition: DataFrame, dim: int, rounds: int = 1) -> DataFrame:
    """x := P x, ``rounds`` times, P row-normalised without diagonal."""
    for _ in range(rounds):
        points = sparse_times_vectors(transition, points, dim)
    return points


def denoise_verb(points: DataFrame, lists: DataFrame, dim: int, method: str = "KNN", transition: DataFrame | None = None, rounds: int = 1) -> DataFrame:
    if method == "KNN":
        return denoise(points, lists, dim, rounds)
    if method == "MAGIC":
        return magic(points, transition, dim, rounds)
    raise ValueError(f"unknown method {method}: KNN or MAGIC")


def core_points(lists: DataFrame, perc: float = 0.8) -> DataFrame:
    """(id): points whose density 1 / (distance to the last neighbour) lies above the perc-quantile."""
    last = lists.groupBy("src").agg((1 / F.max("dist")).alias("dens"))
    q = exact_quantiles(last, [], "dens", [perc]).select("q")
    return with_scalars(last, q).where("dens > q").select(F.col("src").alias("id"))


def kth_distance(lists: DataFrame, k: int) -> DataFrame:
    """(id, dist): distance to the k-th entry of a list that counts the point itself first, that is to its neighbour k - 1."""
    return lists.where(F.col("rnk") == k - 1).select(F.col("src").alias("id"), "dist")


def densities(lists: DataFrame, k: int, d: float = 2.0, e: float = 1.0) -> DataFrame:
    """(id, dens): (k / (n V_d) / (distance to entry k)^d)^e, the point itself being entry 1; copies at distance 0 are infinitely
    dense."""
    at = kth_distance(lists, k)
    v = math.pi ** (d / 2) / math.gamma(d / 2 + 1)
    n = at.agg(F.count("*").alias("n"))
    return with_scalars(at, n).select("id", F.when(F.col("dist") > 0, F.pow(k / (F.col("n") * v) / F.pow("dist", d), F.lit(float(e)))).otherwise(F.lit(math.inf)).alias("dens"))


def down_sample(lists: DataFrame, n_keep: int, k: int = 10, d: float = 2.0, e: float = 1.0, seed: int = 7) -> DataFrame:
    """(id): density-dependent sample; dense rows stay with probability boundary / density.

    With the densities in ascending order and cdf_i the sum of 1 / density from row i on, the boundary is n_keep / cdf_1, or
    where that exceeds the least density the first (n_keep - i) / cdf_i that doesn't exceed density i (the first of all if each
    does)."""
    dens = written(densities(lists, k, d, e), "density")
    size = dens.agg(F.count("*").alias("n"), F.min("dens").alias("least"))
    down = [F.desc("dens"), F.desc("id")]
    rows = numbered(with_scalars(dens.withColumn("inv", 1 / F.col("dens")), size), [], down, "r")
    rows = running_sum(rows, [], down, "inv", "cdf").withColumn("i", F.col("n") - F.col("r") + 1)
    keep = F.least(F.lit(n_keep), F.col("n"))
    rows = rows.select("i", "dens", "least", (keep / F.col("cdf")).alias("all"), ((keep - F.col("i")) / F.col("cdf")).alias("target"))
    got = rows.agg(F.min_by("all", "i").alias("all"), F.min("least").alias("least"), F.min_by("target", "i").alias("one"), F.min_by("target", F.when(F.col("target") <= F.col("dens"), F.col("i"))).alias("first"))
    bound = got.select(F.when(F.col("all") > F.col("least"), F.coalesce("first", "one")).otherwise(F.col("all")).alias("boundary"))
    return with_scalars(dens, bound).where(F.col("boundary") / F.col("dens") > uniform(seed, "id")).select("id")


def weighted_sample(weights: DataFrame, n: int, seed: int = 7) -> DataFrame:
    """(id): n rows without replacement with probability proportional to w, by exponential keys. A column log_w in place of w holds
    logarithms, for weights beyond the range of a double."""
    u = -F.log(uniform(seed, "id") + 1e-12)
    if "log_w" in weights.columns:
        keyed = weights.where("log_w is not null").select("id", (F.log(u) - F.col("log_w")).alias("key"))
    else:
        keyed = weights.where("w > 0").select("id", (u / F.col("w")).alias("key"))
    return keyed.orderBy("key", "id").limit(n).select("id")


def sparse_sample(lists: DataFrame, n: int, k: int = 10, e: float = 1.0, method: str = "naive", seed: int = 7) -> DataFrame:
    """(id): n rows drawn by their distance to entry k of the list: weights dist^e (naive) or exp(dist^e) (exp)."""
    far = kth_distance(lists, k)
    if method == "naive":
        return weighted_sample(far.select("id", F.pow("dist", F.lit(float(e))).alias("w")), n, seed)
    if method == "exp":
        return weighted_sample(far.select("id", F.pow("dist", F.lit(float(e))).alias("log_w")), n, seed)
    raise ValueError(f"unknown method {method}: naive or exp")


def upsample_labels(labels: DataFrame, n: int, take_all: str | None = None, replace: bool = True, seed: int = 3) -> DataFrame:
    """(id, label, draw): n draws per label, with or without replacement; every row of ``take_all``.

    With replacement draw j takes row floor(u_j * size) of its label in order of id."""
    rest = labels if take_all is None else labels.where(F.col("label") != take_all)
    if replace:
        rows = numbered(rest.select("id", "label"), ["label"], [F.col("id")], "k").withColumn("k", F.col("k") - 1)
        sizes = rest.groupBy("label").agg(F.count("*").alias("size")).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(n))))
        picks = sizes.withColumn("k", F.floor(uniform(seed, "label", "draw") * F.col("size")).cast("long"))
        out = picks.join(rows, ["label", "k"]).select("id", "label", "draw")
    else:
        # first within 32 salts of a label, then of what is left
        keyed = rest.select("id", "label", uniform(seed, "label", "id").alias("u"))
        for by in (["label", F.pmod(F.xxhash64("id"), F.lit(32))], ["label"]):
            keyed = keyed.withColumn("draw", F.row_number().over(Window.partitionBy(*by).orderBy("u", "id"))).where(F.col("draw") <= n)
        out = keyed.select("id", "label", "draw")
    if take_all is not None:
        out = out.unionByName(labels.where(F.col("label") == take_all).select("id", "label", F.lit(0).alias("draw")))
    return out


def _hashed_uniform(*keys: np.ndarray | int) -> np.ndarray:
    """Uniforms in (0, 1) from integer keys, by the finaliser of a 64-bit mix."""
    h = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for k in keys:
            h = (h ^ np.asarray(k).astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            h = h ^ (h >> np.uint64(31))
    return ((h >> np.uint64(11)).astype(float) + 0.5) / 2.0**53


def gamma_of(ids: np.ndarray, draw: int, at: np.ndarray, alpha: float, seed: int) -> np.ndarray:
    """Gamma(alpha) variates that follow from (id, draw, position): squeeze rejection for alpha + 1, times u^(1 / alpha)."""
    d = alpha + 1 - 1 / 3
    c = 1 / math.sqrt(9 * d)
    out, open_, turn = np.zeros(len(ids)), np.arange(len(ids)), 0
    while len(open_):
        u = [_hashed_uniform(seed, ids[open_], draw, at[open_], 4 * turn + j) for j in range(3)]
        z = np.sqrt(-2 * np.log(u[0])) * np.cos(2 * np.pi * u[1])
        v = (1 + c * z) ** 3
        ok = (v > 0) & (np.log(u[2]) < 0.5 * z * z + d - d * v + d * np.log(np.where(v > 0, v, 1)))
        out[open_[ok]] = d * v[ok]
        open_, turn = open_[~ok], turn + 1
    return out * _hashed_uniform(seed, ids, draw, at, 3) ** (1 / alpha)


def upsample(points: DataFrame, lists: DataFrame, n: int, alpha: float = 0.1, seed: int = 5) -> DataFrame:
    """(id, draw, x): n synthetic rows per point, mixtures of its neighbours with Dirichlet(alpha) weights."""
    both = lists.join(points.select(F.col("id").alias("dst"), "x"), "dst").groupBy("src").agg(F.transform(F.array_sort(F.collect_list(F.struct("rnk", "x"))), lambda s: s["x"]).alias("xs"))  # k vectors

    def run(batches):
        for b in batches:
            ids, xs = b.column(0).to_numpy(), b.column(1)
            size = np.diff(xs.offsets.to_numpy())
            of = np.repeat(np.arange(len(ids)), size)  # the list of every vector, then every draw of them
            at = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
            vec = matrix(xs.flatten())
            y = np.zeros((len(ids), n, vec.shape[1]))
            for k in range(n):
                g = gamma_of(ids[of], k, at, alpha, seed) + 1e-300
                total = np.bincount(of, g, len(ids))
                np.add.at(y[:, k], of, vec * (g / total[of])[:, None])
            flat = y.reshape(len(ids) * n, -1)
            cells = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1]), pa.array(flat.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)), pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), len(ids))), cells], ["id", "draw", "x"])

    return both.mapInArrow(run, "id long, draw int, x array<double>")


def unique_points(points: DataFrame) -> DataFrame:
    """(id, rep): the smallest id with the same x."""
    rep = points.groupBy("x").agg(F.min("id").alias("rep"))
    return points.join(rep, "x").select("id", "rep")


def set_origin(points: DataFrame, labels: DataFrame, dim: int) -> DataFrame:
    """(label, id): per label the member nearest to the label's mean, the smallest id on ties."""
    rows = points.select("id", "x").join(labels.select("id", "label"), "id")
    mean = avg_vector(rows, ["label"], dim, out="m")
    near = rows.join(mean, "label").withColumn("d2", F.round(squared_distance("x", "m"), 9))
    return near.groupBy("label").agg(F.min_by("id", F.struct("d2", "id")).alias("id"))


def farthest_points(points: DataFrame, k: int, start: int | None = None) -> DataFrame:
    """(pick, id): farthest-point sampling from the smallest id (or ``start``), squared distances, the smallest id on ties.

    Sequential by nature: one pass per landmark over a written table with the running distance; k is a parameter."""
    rows = written(points.select("id", "x").withColumn("d2", F.lit(float("inf"))), "fps")
    first = rows.where(F.col("id") == start).first() if start is not None else rows.orderBy("id").first()
    picked = []
    if first is None:
        return points.sparkSession.createDataFrame([], "pick int, id long")
    chosen = [(first["id"], np.array(first["x"]))]

    def update(batches, c):
        for b in batches:
            x = matrix(b.column(1))
            d = np.minimum(b.column(2).to_numpy(zero_copy_only=False), ((x - c) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(d)], ["id", "x", "d2"])

    for n in range(k):
        i, c = chosen[-1]
        picked.append((n + 1, i))
        if n + 1 == k:
            break
        rows = rows.mapInArrow(lambda it, c=c: update(it, c), rows.schema)
        if n % 8 == 7:
            rows = written(rows, "fps")
        top = rows.agg(F.max_by(F.struct("id", "x", "d2"), F.struct(F.round("d2", 9), -F.col("id"))).alias("r")).first()["r"]
        if top["d2"] <= 0:
            break
        chosen.append((top["id"], np.array(top["x"])))
    return points.sparkSession.createDataFrame(picked, "pick int, id long")


def sigma(lists: DataFrame, target: float | None = None) -> DataFrame:
    """(src, sigma): bisection so that the list's sum of exp(-max(d, 0) / sigma) reaches the target, log2 of its length if none is
    given; 64 halvings, 1e-5. All lists of a batch are bisected together."""

    @F.pandas_udf("double")
    def bisect(ds: pd.Series) -> pd.Series:
        size = ds.map(len).to_numpy()
        d = np.full((len(ds), max(1, int(size.max(initial=1)))), np.inf)  # padded: an infinite distance adds nothing
        d[np.arange(d.shape[1])[None] < size[:, None]] = np.concatenate([np.empty(0), *ds])
        goal = np.full(len(ds), target) if target is not None else np.log2(np.maximum(size, 1))
        lo, hi, mid, open_ = np.zeros(len(ds)), np.full(len(ds), np.inf), np.ones(len(ds)), np.arange(len(ds))
        for _ in range(64):
            s = np.where(d[open_] > 0, np.exp(-d[open_] / mid[open_, None]), 1.0).sum(1)
            apart = np.abs(s - goal[open_]) >= 1e-5
            open_, above = open_[apart], (s > goal[open_])[apart]
            if not len(open_):
                break
            hi[open_[above]], lo[open_[~above]] = mid[open_[above]], mid[open_[~above]]
            mid[open_] = np.where(np.isinf(hi[open_]), mid[open_] * 2, (lo[open_] + np.where(np.isinf(hi[open_]), 0, hi[open_])) / 2)
        return pd.Series(mid)

    return lists.groupBy("src").agg(F.collect_list("dist").alias("ds")).select("src", bisect("ds").alias("sigma"))


def rho_sigma(lists: DataFrame, k: int) -> DataFrame:
    """(src, rho, sigma): rho the first distance, sigma from the rest above it, not under a thousandth of the mean distance."""
    rho = lists.groupBy("src").agg(F.min("dist").alias("rho"), F.avg("dist").alias("mean"))
    above = lists.join(rho, "src").select("src", (F.col("dist") - F.col("rho")).alias("dist"))
    return sigma(above, math.log2(k)).join(rho, "src").select("src", "rho", F.greatest("sigma", F.col("mean") * 1e-3).alias("sigma"))


def fuzzy_distance(lists: DataFrame, k: int) -> DataFrame:
    """(src, dst, w): -log of the fuzzy union p + p' - p p' with p = exp(-(d - rho) / sigma)."""
    p = lists.join(rho_sigma(lists, k), "src").select("src", "dst", F.exp(-(F.col("dist") - F.col("rho")) / F.col("sigma")).alias("p"))
    both = p.withColumn("q", F.lit(0.0)).unionByName(p.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(0.0).alias("p"), F.col("p").alias("q")))
    return both.groupBy("src", "dst").agg(F.sum("p").alias("p"), F.sum("q").alias("q")).select("src", "dst", (-F.log(F.greatest(F.col("p") + F.col("q") - F.col("p") * F.col("q"), F.lit(1e-300)))).alias("w"))
