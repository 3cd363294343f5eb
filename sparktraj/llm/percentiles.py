"""Problem 4: exact percentiles of very large columns, by a distributed sort with counts per partition.

Values travel as sorted blocks of (value, count): a task sorts what it holds of a group and cuts it at the group's splitters,
and each (group, range) is merged in one place. Ranges of a group come from equi-depth summaries of all its rows, so they hold
about ``range_rows`` values; equal values fold into one entry with a count, so a value that many rows share can't fill a range.
The counts give every range its offset in its group, a target position is looked up in the one or two ranges that hold its
neighbouring order statistics, and the value is interpolated between them (the common linear rule).

``state`` keeps, for each part of a group (a day, a file), about 1/epsilon order statistics with the number of values each
stands for; ``merged`` combines any number of states. A merged percentile is off by at most epsilon * n ranks.

Defined cases: null, NaN and infinite values are left out (sentinels by the caller); a group without values gives no row; a
group of one value gives that value; a null group key is a group; an empty table gives no rows.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import DIM, current_points, is_usable, materialize

PROBS = (0.05, 0.25, 0.5, 0.75, 0.95)
#: Values aimed at for a range, and the most ranges over all groups: the splitters stay under a few MB at any size.
RANGE_ROWS, MAX_RANGES = 200_000, 20_000
#: Entries of a summary that splitters come from.
SUMMARY = 128
#: Values held in a task before they are sorted and sent.
HELD = 3_000_000


def _held(batches, dim):
    """Yields (group keys, matrix of values) of many rows at a time."""
    keys, values, n = [], [], 0
    for b in batches:
        if b.num_rows:
            c = b.column(1)
            keys.append(b.column(0))
            values.append(c.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(float))
            n += values[-1].size
        if n >= HELD:
            yield pa.chunked_array(keys).combine_chunks(), np.concatenate(values)
            keys, values, n = [], [], 0
    if n:
        yield pa.chunked_array(keys).combine_chunks(), np.concatenate(values)


def _folded(v: np.ndarray, c: np.ndarray | None = None):
    """Distinct sorted values and their counts."""
    if c is None:
        v = np.sort(v)
        first = np.r_[True, v[1:] != v[:-1]] if len(v) else np.empty(0, bool)
        at = np.nonzero(first)[0]
        return v[at], np.diff(np.r_[at, len(v)])
    o = np.argsort(v, kind="stable")
    v, c = v[o], c[o]
    at = np.nonzero(np.r_[True, v[1:] != v[:-1]])[0] if len(v) else np.empty(0, np.int64)
    return v[at], np.add.reduceat(c, at) if len(at) else c


def _groups(batches, dim):
    """Yields (key, channel, distinct sorted values, counts) of what the task holds."""
    for keys, x in _held(batches, dim):
        coded = keys.dictionary_encode() if not pa.types.is_dictionary(keys.type) else keys
        code = coded.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(code, kind="stable")
        code, x = code[order], x[order]
        at = np.nonzero(np.r_[True, code[1:] != code[:-1]])[0]
        names = coded.dictionary.to_pylist()
        for a, z in zip(at, np.r_[at[1:], len(code)]):
            for ch in range(dim):
                v = x[a:z, ch]
                v = v[np.isfinite(v)]
                if len(v):
                    yield names[code[a]], ch, *_folded(v + 0.0)


def _cell(a) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def sorted_ranges(df: DataFrame, dim: int = 1, range_rows: int = RANGE_ROWS) -> DataFrame:
    """df(key string, vals array<double> of ``dim``) -> (key, channel, range, n, v, c): the sorted table, a row per range, with
    values v and counts c as binary."""
    df = df.withColumn("key", F.coalesce("key", F.lit("\0")))

    def summarise(batches):
        out = []
        for key, ch, v, c in _groups(batches, dim):
            n = int(c.sum())
            q = np.unique(np.searchsorted(np.cumsum(c), np.linspace(0, n, SUMMARY + 1)[1:], "left"))
            out.append((key, ch, n, v[q].tolist(), np.diff(np.r_[0, np.cumsum(c)[q]]).tolist()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out]) for i in range(5)], schema=pa.schema([("key", pa.string()), ("channel", pa.int32()), ("n", pa.int64()), ("v", pa.list_(pa.float64())), ("c", pa.list_(pa.int64()))]))

    # (key, channel) sums on the executors; only groups larger than a range reach the driver, and their splitters are bounded
    parts = materialize(df.mapInArrow(summarise, "key string, channel int, n long, v array<double>, c array<long>"), "summaries")
    sizes = parts.groupBy("key", "channel").agg(F.sum("n").alias("total"))
    total = sizes.agg(F.sum("total")).first()[0] or 0
    target = max(range_rows, -(-total // MAX_RANGES))
    large = parts.join(sizes.where(F.col("total") > target), ["key", "channel"])

    def split(key, t):
        n = t.column("total")[0].as_py()
        v, c = t.column("v").combine_chunks().flatten().to_numpy(), t.column("c").combine_chunks().flatten().to_numpy()
        v, c = _folded(v, c)
        k = -(-n // target)
        cuts = np.unique(v[np.minimum(np.searchsorted(np.cumsum(c), np.arange(1, k) * c.sum() / k), len(v) - 1)])
        return pa.table({"key": [key[0].as_py()], "channel": pa.array([key[1].as_py()], pa.int32()), "cuts": [cuts.tolist()]})

    rows = large.groupBy("key", "channel").applyInArrow(split, "key string, channel int, cuts array<double>").collect()
    cuts = {(r["key"], r["channel"]): np.array(r["cuts"]) for r in rows}

    def send(batches):
        got = []
        for key, ch, v, c in _groups(batches, dim):
            at = np.r_[0, np.searchsorted(v, cuts[key, ch], "right"), len(v)] if (key, ch) in cuts else np.array([0, len(v)])
            for i in range(len(at) - 1):
                if at[i + 1] > at[i]:
                    s = slice(at[i], at[i + 1])
                    one = None if c[s].max() == 1 else _cell(c[s].astype(np.int64))
                    got.append((key, ch, i, _cell(v[s]), one))
            if len(got) >= 2000:
                yield _batch(got)
                got = []
        if got:
            yield _batch(got)

    def _batch(got):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in got]), pa.array([r[1] for r in got], pa.int32()), pa.array([r[2] for r in got], pa.int32()), pa.array([r[3] for r in got], pa.binary()), pa.array([r[4] for r in got], pa.binary())], ["key", "channel", "range", "v", "c"])

    def merge(key, t):
        vs = [np.frombuffer(b, float) for b in t.column("v").to_pylist()]
        cs = [np.ones(len(v), np.int64) if b is None else np.frombuffer(b, np.int64) for v, b in zip(vs, t.column("c").to_pylist())]
        v, c = _folded(np.concatenate(vs), np.concatenate(cs))
        return pa.table([pa.array([key[0].as_py()]), pa.array([key[1].as_py()], pa.int32()), pa.array([key[2].as_py()], pa.int32()), pa.array([int(c.sum())]), pa.array([_cell(v)], pa.binary()), pa.array([None if c.max() == 1 else _cell(c)], pa.binary())], names=["key", "channel", "range", "n", "v", "c"])

    sent = df.mapInArrow(send, "key string, channel int, range int, v binary, c binary")
    return sent.groupBy("key", "channel", "range").applyInArrow(merge, "key string, channel int, range int, n long, v binary, c binary")


def exact(df: DataFrame, dim: int = 1, probs=PROBS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """df(key, vals) -> (key, channel, n, p, value)."""
    ranges = materialize(sorted_ranges(df, dim, range_rows), "ranges")
    # one row per range: offsets are running sums over the few ranges of a group
    w = Window.partitionBy("key", "channel").orderBy("range")
    at = ranges.select("key", "channel", "range", "n").withColumn("before", F.sum("n").over(w) - F.col("n")).withColumn("total", F.sum("n").over(Window.partitionBy("key", "channel")))
    rows = ranges.drop("n").join(at, ["key", "channel", "range"])
    probs = np.array(probs)

    def look_up(batches):
        for b in batches:
            out = []
            for key, ch, before, n, total, v, c in zip(*[b.column(i).to_pylist() for i in range(7)]):
                pos = probs * (total - 1)
                lo, hi = np.floor(pos).astype(np.int64), np.ceil(pos).astype(np.int64)
                v = np.frombuffer(v, float)
                ends = np.arange(1, len(v) + 1) if c is None else np.cumsum(np.frombuffer(c, np.int64))
                for want, side in ((lo, 0), (hi, 1)):
                    here = np.nonzero((want >= before) & (want < before + n))[0]
                    got = v[np.searchsorted(ends, want[here] - before, "right")]
                    out += [(key, ch, total, float(probs[i]), float(pos[i] - lo[i]), side, float(g)) for i, g in zip(here, got)]
            kinds = [pa.string(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["key", "channel", "n", "p", "part", "side", "value"])

    found = rows.select("key", "channel", "before", F.col("n"), "total", "v", "c").mapInArrow(look_up, "key string, channel int, n long, p double, part double, side int, value double")
    low, high = F.max(F.when(F.col("side") == 0, F.col("value"))), F.max(F.when(F.col("side") == 1, F.col("value")))
    out = found.groupBy("key", "channel", "n", "p").agg((low + (high - low) * F.max("part")).alias("value"))
    return out.withColumn("key", F.when(F.col("key") == "\0", None).otherwise(F.col("key")))


def state(df: DataFrame, epsilon: float = 0.005) -> DataFrame:
    """df(key, part, value) -> (key, part, n, lo, hi, items): at most about 1/epsilon order statistics of every part of a group,
    each standing for the values since the one before."""
    both = df.select(F.to_json(F.struct("key", "part"), {"ignoreNullFields": "false"}).alias("key"), F.array(F.col("value").cast("double")).alias("vals"))
    ranges = sorted_ranges(both, 1)

    def thin(batches):
        for b in batches:
            items = []
            for n, v, c in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                v = np.frombuffer(v, float)
                ends = np.arange(1, len(v) + 1) if c is None else np.cumsum(np.frombuffer(c, np.int64))
                step = max(1, int(epsilon * n))
                q = np.unique(np.searchsorted(ends, np.r_[np.arange(step, n, step), n], "left"))
                items.append([{"v": float(x), "c": int(y)} for x, y in zip(v[q], np.diff(np.r_[0, ends[q]]))])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(items, pa.list_(pa.struct([("v", pa.float64()), ("c", pa.int64())])))], ["key", "n", "items"])

    got = ranges.select("key", "n", "v", "c").mapInArrow(thin, "key string, n long, items array<struct<v:double,c:long>>")
    return got.withColumn("k", F.from_json("key", "key string, part string")).select("k.key", "k.part", "n", "items")


def merged(states: DataFrame, probs=PROBS, epsilon: float = 0.005) -> DataFrame:
    """(key, n, p, value, max_rank_error) of all parts of a group together: the first kept value whose running count reaches the
    target; every kept value stands for at most epsilon * n_part values of its part besides itself."""
    items = states.select("key", F.explode("items").alias("i")).select("key", "i.v", "i.c").groupBy("key", "v").agg(F.sum("c").alias("c"))
    w = Window.partitionBy("key").orderBy("v")
    run = items.withColumn("upto", F.sum("c").over(w)).withColumn("n", F.sum("c").over(Window.partitionBy("key")))
    run = run.withColumn("p", F.explode(F.array(*map(F.lit, probs))))
    hit = run.where("upto >= greatest(1, p * n)").groupBy("key", "n", "p").agg(F.min("v").alias("value"))
    return hit.withColumn("max_rank_error", F.ceil(F.col("n") * epsilon) + 1)


def current_pseudotime(times: DataFrame) -> DataFrame:
    """(origin_name, id, res, computed_at): the row computed last of every point and path model, then the one that arrived last;
    undefined values (-1, -100, null, NaN, infinite) left out."""
    old = F.lit("0001-01-01").cast("timestamp_ntz").cast(times.schema["computed_at"].dataType)
    order = F.struct(F.coalesce("computed_at", old), F.coalesce("arrived_at", old), F.coalesce("res", F.lit(0.0)))
    cur = times.where("id is not null").groupBy("origin_name", "id").agg(F.max_by(F.struct("res", "computed_at"), order).alias("r")).select("origin_name", "id", "r.*")
    return cur.where("res is not null and not isnan(res) and abs(res) < double('infinity') and res not in (-1.0, -100.0)")


def current_labels(labels: DataFrame) -> DataFrame:
    """(id, labels_name, label): the latest labelled_at (ties by label), without case and outer blanks; null labels are left out.

    Rows are brought together by id alone, so that later joins on id need no further exchange."""
    old = F.lit("0001-01-01").cast("timestamp_ntz").cast(labels.schema["labelled_at"].dataType)
    rows = labels.where("id is not null and labels_name is not null").repartition("id")
    cur = rows.groupBy("id", "labels_name").agg(F.max_by(F.struct("label"), F.struct(F.coalesce("labelled_at", old), "label")).alias("r"))
    return cur.select("id", "labels_name", F.lower(F.trim("r.label")).alias("label")).where("label is not null")


def p4_percentiles(spark, d: str) -> DataFrame:
    """(kind, name, label, channel, n, p, value): of every path model (label empty, channel -1), and of every label and channel over
    usable points."""
    times = current_pseudotime(spark.read.parquet(f"{d}/pseudotime.parquet")).select(F.col("origin_name").alias("key"), F.array("res").alias("vals"))
    one = exact(times).select(F.lit("pseudotime").alias("kind"), F.col("key").alias("name"), F.lit("").alias("label"), F.lit(-1).alias("channel"), "n", "p", "value")
    points = current_points(spark.read.parquet(f"{d}/points.parquet")).where(is_usable()).select("id", "x")
    labelled = current_labels(spark.read.parquet(f"{d}/point_labels.parquet")).join(points, "id").select(F.to_json(F.struct("labels_name", "label")).alias("key"), F.col("x").alias("vals"))
    two = exact(materialize(labelled, "labelled"), DIM).withColumn("k", F.from_json("key", "labels_name string, label string"))
    two = two.select(F.lit("label").alias("kind"), F.col("k.labels_name").alias("name"), F.col("k.label").alias("label"), "channel", "n", "p", "value")
    return one.unionByName(two).withColumn("value", F.round("value", 9))


def p4_merged_days(spark, d: str) -> DataFrame:
    """Percentiles of every path model combined from the states of its days."""
    times = current_pseudotime(spark.read.parquet(f"{d}/pseudotime.parquet"))
    parts = times.select(F.col("origin_name").alias("key"), F.to_date("computed_at").cast("string").alias("part"), F.col("res").alias("value"))
    return merged(materialize(state(parts), "states"))


P4_SQL = """
with p as (select id, x from (select *, row_number() over (partition by id order by ingested_at desc nulls last) rn from points where id is not null)
  where rn = 1 and len(x) = 25 and list_count(x) = 25 and len(list_filter(x, lambda v: isnan(v))) = 0),
l as (select id, labels_name, lower(trim(label)) as label from (select *, row_number() over (partition by id, labels_name order by labelled_at desc nulls last) rn
  from point_labels where id is not null and labels_name is not null) where rn = 1 and label is not null),
t as (select origin_name, res from (select *, row_number() over (partition by origin_name, id order by computed_at desc nulls last, arrived_at desc nulls last) rn
  from pseudotime where id is not null) where rn = 1 and res is not null and isfinite(res) and res not in (-1, -100)),
v as (select 'pseudotime' as kind, origin_name as name, '' as label, -1 as channel, res as v from t
  union all select 'label', labels_name, label, (c - 1)::int, x[c] from (select l.labels_name, l.label, p.x, unnest(range(1, 26)) as c from l join p using (id))),
q as (select kind, name, label, channel, count(*) as n, quantile_cont(v, [0.05, 0.25, 0.5, 0.75, 0.95]) as qs from v group by all)
select kind, name, label, channel, n, unnest([0.05, 0.25, 0.5, 0.75, 0.95]::double[]) as p, round(unnest(qs), 9) as value from q
"""
