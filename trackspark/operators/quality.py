"""Coverage, missing values and confidence of a dataset. Scores come as arrays by frame or as one row per point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import below, number


def percent(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part * 100.0, whole), F.lit(0.0))


def layout_counts(songs: DataFrame) -> DataFrame:
    return songs.filter("layout is not null").groupBy("layout").agg(F.count("*").alias("songs"))


def fps_counts(songs: DataFrame) -> DataFrame:
    return songs.groupBy("fps").agg(F.count("*").alias("songs"))


def static_camera_ratio(songs: DataFrame) -> DataFrame:
    return songs.agg(F.avg(F.when(F.coalesce("moving_camera", F.lit(False)), 0.0).otherwise(1.0)).alias("static_ratio"))


def eligible_hours(songs: DataFrame, layouts: list[list[str]]) -> DataFrame:
    """Songs and hours with an allowed layout, a correct body detection and a camera that doesn't move."""
    allowed = F.array(*(F.array(*map(F.lit, x)) for x in layouts))
    kept = songs.filter(F.array_contains(allowed, F.col("layout")) & F.col("correct_body_detection").eqNullSafe(True) & ~F.coalesce("moving_camera", F.lit(False)))
    return kept.agg(F.count("*").alias("songs"), F.coalesce(F.sum("duration") / 3600, F.lit(0.0)).alias("hours"))


def nan_flags(score: str = "score") -> tuple[Column, Column]:
    """Whether all, and whether any, of a frame's scores are NaN."""
    return F.forall(score, lambda s: F.isnan(s)), F.exists(score, lambda s: F.isnan(s))


def nan_frame_ratio(frames: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Percent of frames whose scores are all NaN, and of those with any NaN."""
    every, some = nan_flags()
    n = F.count("*")
    return frames.groupBy(*(by or [])).agg(percent(F.count(F.when(every, 1)), n).alias("all_nan_pct"), percent(F.count(F.when(some, 1)), n).alias("any_nan_pct"), n.alias("frames"))


def mean_score(score: str = "score") -> tuple[Column, Column]:
    """Sum and number of the scores of a frame that aren't NaN."""
    known = F.filter(score, lambda s: ~F.isnan(s))
    return F.aggregate(known, F.lit(0.0), lambda t, s: t + s), F.size(known)


def confidence_by(frames: DataFrame, track: list[str], by: str) -> DataFrame:
    """Unweighted mean over the tracks of each `by` of the tracks' NaN-skipping mean score."""
    total, n = mean_score()
    tracks = frames.groupBy(*track).agg(F.try_divide(F.sum(total), F.sum(n)).alias("mean"))
    return tracks.groupBy(by).agg(F.avg("mean").alias("confidence"), F.count("mean").alias("tracks"))


def low_confidence_pooled(frames: DataFrame, by: str, limit: float = 3.0) -> DataFrame:
    """Scores under `limit` of all scores of each `by`, as a ratio."""
    low = F.size(F.filter("score", lambda s: below(s, limit)))
    return frames.groupBy(by).agg(F.coalesce(F.try_divide(F.sum(low), F.sum(F.size("score"))), F.lit(0.0)).alias("low_ratio"))


def low_confidence_mean(frames: DataFrame, track: list[str], by: str, limit: float = 3.0) -> DataFrame:
    """Mean over the tracks of each `by` of the tracks' ratios of scores under `limit`; a track without any has 0."""
    return low_confidence_pooled_by(frames, track, limit).groupBy(by).agg(F.avg("low_ratio").alias("low_ratio"))


def low_confidence_pooled_by(frames: DataFrame, keys: list[str], limit: float) -> DataFrame:
    low = F.size(F.filter("score", lambda s: below(s, limit)))
    return frames.groupBy(*keys).agg(F.coalesce(F.try_divide(F.sum(low), F.sum(F.size("score"))), F.lit(0.0)).alias("low_ratio"))


def track_nan_profile(frames: DataFrame, track: list[str]) -> DataFrame:
    """Mean over tracks of the percent of frames whose scores are all NaN."""
    return nan_frame_ratio(frames, track).agg(F.avg("all_nan_pct").alias("mean_all_nan_pct"), F.count("*").alias("tracks"))


def feature_nan_profile(features: DataFrame, track: list[str], by: str, values: list[str]) -> DataFrame:
    """Mean over the tracks of each `by` of the percent of NaN of each of `values`."""
    tracks = features.groupBy(*track).agg(*(percent(F.count(F.when(F.isnan(v), 1)), F.count("*")).alias(v) for v in values))
    return tracks.groupBy(by).agg(*(F.avg(v).alias(f"{v}_nan_pct") for v in values))


def score_profile(points: DataFrame, by: str, occluded: DataFrame | None = None) -> DataFrame:
    """Of each `by`: the mean over points of their mean score, and the quartiles and ends of those means.

    points: by, kp, score (and the occlusion's keys); rows in `occluded` are left out.
    """
    if occluded is not None:
        points = points.join(occluded, [c for c in occluded.columns if c in points.columns], "left_anti")
    means = points.groupBy(by, "kp").agg(F.avg(number("score")).alias("mean"))
    q = F.percentile("mean", [0.25, 0.5, 0.75])
    return means.groupBy(by).agg(
        F.avg("mean").alias("mean"), F.min("mean").alias("low"), q[0].alias("q25"), q[1].alias("median"), q[2].alias("q75"), F.max("mean").alias("high"),
    )


def missing_outputs(tracks: DataFrame, files: DataFrame, required: DataFrame, track: list[str]) -> DataFrame:
    """Required files (file, and instrument or null for all) that a track lacks."""
    rows = tracks.withColumnRenamed("instrument", "__i")
    named = rows.join(required.filter("instrument is not null").withColumnRenamed("instrument", "__i"), "__i")
    of_all = required.filter("instrument is null").agg(F.collect_set("file").alias("__files"))  # one row
    wanted = named.unionByName(rows.join(of_all).withColumn("file", F.explode("__files")).drop("__files"))
    return wanted.withColumnRenamed("__i", "instrument").select(*track, "file").join(files, [*track, "file"], "left_anti")
