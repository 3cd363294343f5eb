"""Layouts (id, x): a registry by name, diffusion maps, principal components, or a layout brought along."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sparse import diffusion_map
from .vectors import matrix


def principal_components(points: DataFrame, axes: int = 2) -> DataFrame:
    """Scores on the leading components; moments are one sum per task over all rows, the sign makes the largest loading positive."""
    dim = points.select(F.max(F.size("x"))).first()[0]
    if not dim or dim < 1:
        return points.select("id", "x").limit(0)

    def sums(batches):
        s = None
        for b in batches:
            x = matrix(b.column(0), dim)
            v = np.r_[len(x), x.sum(0), (x.T @ x).ravel()]
            s = v if s is None else s + v
        if s is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(s))), pa.array(s)], ["i", "v"])

    s = points.select("x").mapInArrow(sums, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").toArrow().column("v").to_numpy()
    mean = s[1 : 1 + dim] / s[0]
    w, v = np.linalg.eigh(s[1 + dim :].reshape(dim, dim) / s[0] - np.outer(mean, mean))
    v = v[:, ::-1][:, :axes]
    v = v * np.sign(v[np.abs(v).argmax(0), np.arange(v.shape[1])])

    def project(batches):
        for b in batches:
            y = (matrix(b.column(1), dim) - mean) @ v
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(y.tolist(), pa.list_(pa.float64()))], ["id", "x"])

    return points.select("id", "x").mapInArrow(project, "id long, x array<double>")


class Layouts:
    """Named layouts; a new one is called "{number}_{method}"."""

    def __init__(self):
        self.tables: dict[str, DataFrame] = {}

    def add(self, method: str, points: DataFrame | None = None, lists: DataFrame | None = None, layout: DataFrame | None = None, axes: int = 2) -> str:
        if layout is not None:
            table = layout.select("id", "x")
        elif method == "diffuse":
            table = diffusion_map(lists, axes)
        elif method == "pca":
            table = principal_components(points, axes)
        else:
            raise ValueError(f"unknown layout method {method}: diffuse, pca, or bring a layout")
        name = f"{len(self.tables) + 1}_{method}"
        self.tables[name] = table
        return name
