"""Shared pieces: materialised tables in the shared folder, current rows, usable points, copies, Arrow conversion."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written as materialize

DIM = 25
#: Rows up to which a lookup side is broadcast; beyond it the same join runs as a shuffle.
BROADCAST_ROWS = 100_000


def small_side(df: DataFrame) -> tuple[DataFrame, int]:
    """Materialise a lookup side and count it; it is broadcast only up to BROADCAST_ROWS rows."""
    df = materialize(df, "side")
    n = df.count()
    return (F.broadcast(df) if n <= BROADCAST_ROWS else df), n


def current_points(points: DataFrame) -> DataFrame:
    """One row per id, the one with the latest ingested_at (a null one counts as the oldest); null ids are dropped."""
    order = F.struct(F.coalesce("ingested_at", F.lit("0001-01-01").cast("timestamp_ntz").cast(points.schema["ingested_at"].dataType)), F.xxhash64("x"))
    cur = points.where("id is not null").groupBy("id").agg(F.max_by(F.struct("x", "file_id", "events_sel"), order).alias("r"))
    return cur.select("id", "r.x", "r.file_id", "r.events_sel")


def is_usable(x="x", dim: int = DIM):
    """x has exactly ``dim`` elements, none null or NaN."""
    return F.coalesce((F.size(x) == dim) & (F.size(F.array_compact(x)) == dim) & ~F.array_contains(x, float("nan")), F.lit(False))


def usable_points(points: DataFrame, dim: int = DIM) -> DataFrame:
    return current_points(points).where(is_usable("x", dim))


def matrix(col: pa.Array, dim: int) -> np.ndarray:
    """A list<double> column of fixed length as an n x dim matrix; infinities become +-1e150 so that distances stay numbers."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    x = col.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    return np.clip(x, -1e150, 1e150)


def pack(x: np.ndarray) -> pa.Array:
    """Rows of a matrix as binary cells, without a copy per row."""
    x = np.ascontiguousarray(x)
    n, width = len(x), x.shape[1] * x.itemsize
    offsets = np.arange(n + 1, dtype=np.int64) * width
    return pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(x)]).cast(pa.binary())


def unpack(col: pa.Array, dtype, dim: int) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not len(col):
        return np.empty((0, dim), dtype)
    o = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1]
    return np.frombuffer(col.buffers()[2], np.uint8)[o[0] : o[-1]].view(dtype).reshape(-1, dim)


def hash_sample(df: DataFrame, n: int, size: int, cols: list[str]) -> pa.Table:
    """At most ``size`` rows, chosen by a hash of id: the bounded sample that models are fitted on."""
    keep = min(1_000_000, int(size / max(1, n) * 1_000_000) + 1)
    df = df if n <= size else df.where(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1_000_000)) < keep)
    return df.select("id", *cols).toArrow().sort_by("id").slice(0, size + size // 4)


def split_copies(points: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Points with equal x (by two 64-bit hashes) stand under their smallest id.

    Returns the representatives, (id, rep) of the others, and the number of others. Only 24 bytes a point are shuffled.
    """
    h = points.select("id", F.xxhash64("x").alias("h1"), F.xxhash64("x", F.lit(7)).alias("h2"))
    many = h.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("c")).where("c > 1").drop("c")
    others, n = small_side(h.join(many, ["h1", "h2"]).where("id <> rep").select("id", "rep"))
    return (points.join(others.select("id"), "id", "left_anti") if n else points), others, n
