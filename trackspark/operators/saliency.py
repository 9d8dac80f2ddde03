"""Saliency of points and parts, per chunk, song and dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import nan, number


def saliency_song_mean(chunks: DataFrame, song: list[str], column: str) -> DataFrame:
    """Mean over a song's chunks of each point's saliency: kp, saliency; 0 where no chunk has a number."""
    rows = chunks.select(*song, F.posexplode(column).alias("kp", "v"))
    return rows.groupBy(*song, "kp").agg(F.coalesce(F.avg(number("v")), F.lit(0.0)).alias("saliency"))


def saliency_scalar_mean(chunks: DataFrame, song: list[str], column: str) -> DataFrame:
    return chunks.groupBy(*song).agg(F.coalesce(F.avg(number(column)), F.lit(0.0)).alias(column))


def saliency_dataset_mean(songs: DataFrame) -> DataFrame:
    """Unweighted mean over songs for each point."""
    return songs.groupBy("kp").agg(F.avg("saliency").alias("saliency"), F.count("*").alias("songs"))


def saliency_contrast(top: DataFrame, bottom: DataFrame, n: int = 5) -> DataFrame:
    """The `n` points with the largest |top - bottom|, with the difference and the average of both."""
    both = top.select("kp", F.col("saliency").alias("top")).join(bottom.select("kp", F.col("saliency").alias("bottom")), "kp")
    both = both.withColumns({"difference": F.col("top") - F.col("bottom"), "average": (F.col("top") + F.col("bottom")) / 2})
    return both.orderBy(F.desc(F.abs("difference")), "kp").limit(n)


def to_parts(values: DataFrame, parts: DataFrame, keys: list[str], agg: str = "mean", value: str = "saliency") -> DataFrame:
    """Mean or sum of the points of each part; a point counts in each of its parts."""
    made = F.coalesce(F.avg(number(value)), nan()) if agg == "mean" else F.sum(F.coalesce(number(value), F.lit(0.0)))
    return values.join(parts, "kp").groupBy(*keys, "part").agg(made.alias(value))


def part_series(chunks: DataFrame, parts: DataFrame, chunk: list[str], value: str = "saliency") -> DataFrame:
    """Per chunk the sum over all parts, and that over the number of parts."""
    sums = to_parts(chunks, parts, chunk, "sum", value)
    return sums.groupBy(*chunk).agg(F.sum(value).alias("total"), (F.sum(value) / F.count("*")).alias("per_part"))


def overlay_events(series: DataFrame, events: DataFrame, keys: list[str], chunk_s: float = 4.0, min_abs: float = 0.66) -> DataFrame:
    """Chunks with the events of |correlation| over min_abs that fall into them (null where none does)."""
    strong = events.filter(F.abs("correlation") > min_abs).withColumn("chunk", F.floor(F.col("time") / chunk_s))
    return series.join(strong, [*keys, "chunk"], "left")


def gradient_saliency(grads: DataFrame, keys: list[str], grad: str = "grad") -> DataFrame:
    """Mean |gradient| over batch, time and channel for each key and point."""
    return grads.groupBy(*keys, "kp").agg(F.avg(F.abs(grad)).alias("saliency"))


def grad_x_input(grads: DataFrame, keys: list[str], grad: str = "grad", x: str = "x") -> DataFrame:
    """Mean |input x gradient|."""
    return grads.groupBy(*keys, "kp").agg(F.avg(F.abs(F.col(x) * F.col(grad))).alias("saliency"))


def integrated_gradients(grads: DataFrame, keys: list[str], place: list[str], baseline: str | None = None) -> DataFrame:
    """Mean gradient over the path's steps, times input less baseline, then the mean of its size for each point.

    grads: keys, place (such as time and channel), kp, x, grad and one row for each step alpha.
    """
    gap = F.first("x") - (F.first(baseline) if baseline else F.lit(0.0))
    paths = grads.groupBy(*keys, *place, "kp").agg((F.avg("grad") * gap).alias("__ig"))
    return paths.groupBy(*keys, "kp").agg(F.avg(F.abs("__ig")).alias("saliency"))
