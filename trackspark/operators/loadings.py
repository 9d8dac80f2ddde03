"""Principal components of each track's motion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tracks whose matrices a task holds before it hands them on.
MOST_TRACKS = 256


def merged(a: tuple, b: tuple) -> tuple:
    """Rows, means and co-moments about the means of two sets of rows taken together; each is centred on its own mean, so
    that nothing is lost where values are far from 0."""
    n, apart = a[0] + b[0], b[1] - a[1]
    return n, a[1] + apart * (b[0] / n), a[2] + b[2] + np.outer(apart, apart) * (a[0] * b[0] / n)


def co_moments(features: DataFrame, track: list[str], column: str) -> DataFrame:
    """n, mean and co (products of deviations from the means, summed, row by row) of the array `column` over a track's
    frames; frames with NaN or null don't count.

    A task sends one matrix per track that it has, not one per batch; these are merged in two steps, so that no task gets
    the matrices of all tasks.
    """
    known = features.filter(~F.exists(column, lambda v: F.isnan(v) | F.isnull(v)))
    names = [f"k{i}" for i in range(len(track))]
    keyed = known.select(*(F.col(t).alias(k) for t, k in zip(track, names)), F.col(column).cast("array<double>").alias("v"))
    parts = T.StructType([keyed.schema[k] for k in names] + T.StructType.fromDDL("n long, mean array<double>, co array<double>").fields)

    def frame(found: dict) -> pd.DataFrame:
        rows = [(*key, n, mean.tolist(), co.ravel().tolist()) for key, (n, mean, co) in found.items()]
        return pd.DataFrame(rows, columns=parts.names)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[tuple, tuple] = {}
        for batch in batches:
            for key, rows in batch.groupby(names, dropna=False, sort=False)["v"]:
                x = np.stack(rows.to_list())
                mean = x.mean(0)
                new = len(x), mean, (x - mean).T @ (x - mean)
                key = tuple(None if pd.isna(k) else k for k in key)
                found[key] = merged(found[key], new) if key in found else new
            if len(found) > MOST_TRACKS:
                yield frame(found)
                found = {}
        yield frame(found)

    def together(rows: pd.DataFrame) -> pd.DataFrame:
        size = len(rows["mean"].iloc[0])
        whole = None
        for n, mean, co in zip(rows["n"], rows["mean"], rows["co"]):
            new = int(n), np.array(mean), np.array(co).reshape(size, size)
            whole = new if whole is None else merged(whole, new)
        key = tuple(None if pd.isna(rows[k].iloc[0]) else rows[k].iloc[0] for k in names)
        return frame({key: whole})

    found = keyed.mapInPandas(sums, parts)
    found = found.groupBy(*names, F.pmod(F.spark_partition_id(), F.lit(16))).applyInPandas(lambda key, rows: together(rows), parts)
    found = found.groupBy(*names).applyInPandas(lambda key, rows: together(rows), parts)
    return found.select(*(F.col(k).alias(t) for k, t in zip(names, track)), "n", "mean", "co")


def track_pca(features: DataFrame, track: list[str], column: str, k: int = 3) -> DataFrame:
    """component, variance_ratio and loadings of the array `column` over a track's frames; frames with NaN don't count, tracks
    of fewer than two other frames go. The sign of a component makes its largest loading positive."""
    moments = co_moments(features, track, column).filter("n > 1")
    found = "array<struct<component: int, variance_ratio: double, loadings: array<double>>>"

    @F.pandas_udf(found)
    def solved(mean: pd.Series, co: pd.Series) -> pd.Series:
        out = []
        for m, c in zip(mean, co):
            values, vectors = np.linalg.eigh(np.array(c).reshape(len(m), len(m)))
            total = max(float(values.sum()), 1e-300)
            values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k].T
            vectors = vectors * np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(1)])[:, None]
            out.append([{"component": i, "variance_ratio": max(float(v), 0.0) / total, "loadings": w.tolist()} for i, (v, w) in enumerate(zip(values, vectors), 1)])
        return pd.Series(out)

    return moments.select(*track, F.inline(solved("mean", "co")))


def pca_contribution(pca: DataFrame, track: list[str], top_n: int) -> DataFrame:
    """|speed loading + acceleration loading| of each point on the first component, the `top_n` largest with rank.

    Loadings hold all points' speeds and then all points' accelerations.
    """
    half = (F.size("loadings") / 2).cast("int")
    both = F.zip_with(F.slice("loadings", 1, half), F.slice("loadings", half + 1, half), lambda s, a: F.abs(s + a))
    rows = pca.filter("component = 1").select(*track, F.posexplode(both).alias("kp", "contribution"))
    order = Window.partitionBy(*track).orderBy(F.desc("contribution"), "kp")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_n)
