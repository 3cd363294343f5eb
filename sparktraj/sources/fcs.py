"""Flow cytometry files (FCS 3.x, list mode) as a Spark data source.

    spark.dataSource.register(FcsSource)
    spark.read.format("fcs").load("/dir/*.fcs")      # (path, event, x)
    df.write.format("fcs").option("names", "a,b").option("keywords", "$OP=me").save("/dir")

Each file is a partition; events are read in blocks. Written files have one float per channel, range max + 1.
"""
from __future__ import annotations

import glob
import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

BLOCK = 20_000


def read_header(f) -> tuple[dict[str, str], int]:
    """Keywords and the offset of the data."""
    head = f.read(58)
    if head[:3] != b"FCS":
        raise ValueError("not an FCS file")
    begin, end, data = (int(head[a:b]) for a, b in ((10, 18), (18, 26), (26, 34)))
    f.seek(begin)
    text = f.read(end - begin + 1).decode("latin-1")
    sep = text[0]
    parts = text[1:].rstrip(sep).replace(sep * 2, "\0").split(sep)
    parts = [p.replace("\0", sep) for p in parts]
    keys = {k.upper(): v for k, v in zip(parts[::2], parts[1::2])}
    return keys, data or int(keys["$BEGINDATA"])


def dtype_of(keys: dict[str, str]) -> list[np.dtype]:
    order = "<" if keys["$BYTEORD"].startswith("1") else ">"
    kind = keys["$DATATYPE"]
    bits = [int(keys[f"$P{i}B"]) for i in range(1, int(keys["$PAR"]) + 1)]
    return [np.dtype(order + ({"F": "f4", "D": "f8"}.get(kind) or f"u{b // 8}")) for b in bits]


def channels(path: str) -> list[tuple[int, str, str | None, float]]:
    """(position, name, description, range) of a file."""
    with open(path, "rb") as f:
        k, _ = read_header(f)
    return [(i - 1, k[f"$P{i}N"], k.get(f"$P{i}S"), float(k[f"$P{i}R"])) for i in range(1, int(k["$PAR"]) + 1)]


def spillover(path: str) -> tuple[list[str], list[list[float]]] | None:
    with open(path, "rb") as f:
        k, _ = read_header(f)
    text = k.get("$SPILLOVER") or k.get("SPILL")
    if not text:
        return None
    parts = text.split(",")
    n = int(parts[0])
    m = np.array(parts[1 + n : 1 + n + n * n], float).reshape(n, n)
    return parts[1 : 1 + n], m.tolist()


def write_file(path: str, x: np.ndarray, names: list[str], descs: list[str] | None = None, keywords: dict[str, str] | None = None) -> None:
    n, p = x.shape
    top = x.max(0) + 1 if n else np.ones(p)
    keys = {"$BYTEORD": "1,2,3,4", "$DATATYPE": "F", "$MODE": "L", "$NEXTDATA": "0", "$PAR": str(p), "$TOT": str(n), "$BEGINANALYSIS": "0", "$ENDANALYSIS": "0", "$BEGINSTEXT": "0", "$ENDSTEXT": "0"}
    for i in range(p):
        keys |= {f"$P{i + 1}N": names[i], f"$P{i + 1}S": (descs or names)[i], f"$P{i + 1}B": "32", f"$P{i + 1}E": "0,0", f"$P{i + 1}R": f"{top[i]:.6g}"}
    keys |= keywords or {}
    body = "|" + "|".join(a.replace("|", "||") + "|" + b.replace("|", "||") for a, b in keys.items())
    width = len(body.encode("latin-1")) + len("|$BEGINDATA||$ENDDATA||") + 24
    begin = 58 + width
    data = np.ascontiguousarray(x, "<f4").tobytes()
    text = (body + f"|$BEGINDATA|{begin:012d}|$ENDDATA|{begin + len(data) - 1:012d}|").encode("latin-1")
    inside = begin + len(data) - 1 < 100_000_000
    head = b"FCS3.1    " + b"".join(f"{v:8d}".encode() for v in (58, 58 + len(text) - 1, begin if inside else 0, begin + len(data) - 1 if inside else 0, 0, 0))
    with open(path, "wb") as f:
        f.write(head + text.ljust(width, b" ") + data)


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.paths = sorted(glob.glob(options["path"])) if not os.path.isdir(options["path"]) else sorted(glob.glob(os.path.join(options["path"], "*.fcs")))

    def partitions(self):
        return [_File(p) for p in self.paths]

    def read(self, part):
        with open(part.path, "rb") as f:
            keys, data = read_header(f)
            kinds, total = dtype_of(keys), int(keys["$TOT"])
            row = np.dtype([(str(i), k) for i, k in enumerate(kinds)])
            f.seek(data)
            for s in range(0, total, BLOCK):
                rows = np.frombuffer(f.read(min(BLOCK, total - s) * row.itemsize), row)
                x = np.stack([rows[n].astype(float) for n in row.names], 1) if len(rows) else np.empty((0, len(kinds)))
                n = len(x)
                cells = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(kinds)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array([part.path] * n, pa.string()), pa.array(np.arange(s + 1, s + n + 1)), cells], ["path", "event", "x"])


class _Written(WriterCommitMessage):
    def __init__(self, path: str | None):
        self.path = path


class _Writer(DataSourceWriter):
    def __init__(self, options, schema):
        self.path, self.names = options["path"], options.get("names", "").split(",")
        self.keywords = dict(p.split("=", 1) for p in options.get("keywords", "").split(";") if "=" in p)
        self.at = schema.fieldNames().index("x")

    def write(self, rows):
        x = [list(r[self.at]) for r in rows]
        if not x:
            return _Written(None)
        os.makedirs(self.path, exist_ok=True)
        p = os.path.join(self.path, f"{uuid.uuid4().hex}.fcs")
        a = np.array(x, float)
        names = self.names if len(self.names) == a.shape[1] else [f"P{i + 1}" for i in range(a.shape[1])]
        write_file(p, a, names, keywords=self.keywords)
        return _Written(p)

    def abort(self, messages):
        for m in messages:
            if m and m.path and os.path.exists(m.path):
                os.remove(m.path)


class FcsSource(DataSource):
    @classmethod
    def name(cls):
        return "fcs"

    def schema(self):
        return "path string, event long, x array<double>"

    def reader(self, schema):
        return _Reader(self.options)

    def writer(self, schema, overwrite):
        return _Writer(self.options, schema)
