"""The main workloads as one plan each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import blocks, correlate, pose, timeaxis


def motion_features(frames: DataFrame, track: list[str], parts: DataFrame, dropped: list[int], fps: float = 30.0, limit: float = 3.0, block: int = blocks.BLOCK) -> DataFrame:
    """Frames of points (kp, score arrays) to mean speed and acceleration of each part: normalise, drop points, smooth,
    mask, differentiate, average. Arrays stay one row per frame up to the part means; rows are shuffled once, by track and
    block of frames, with the four frames on either side that smoothing and both gradients look at."""
    rows = pose.normalize_frame(frames)
    keep = lambda c: F.filter(c, lambda p, i: ~i.isin(*dropped)) if dropped else F.col(c)
    size = F.size("kp")
    kept = F.filter(F.sequence(F.lit(0), size - 1), lambda i: ~i.isin(*dropped)) if dropped else F.sequence(F.lit(0), size - 1)
    rows = rows.withColumns({"__at": kept, "kp": keep("kp"), "score": keep("score")})
    rows = rows.withColumns({"x": F.transform("kp", lambda p: p["x"]), "y": F.transform("kp", lambda p: p["y"])}).drop("kp")
    nan = F.lit(float("nan"))
    masked = {c: F.zip_with(c, "score", lambda v, s: F.when(~F.isnan(s) & (s < limit), nan).otherwise(v)) for c in "xy"}

    def moved(wide: DataFrame, keys: list[str]) -> DataFrame:
        return timeaxis.speed_acceleration(timeaxis.smooth(wide, keys, ["x", "y"]).withColumns(masked), keys, fps=fps)

    rows = blocks.in_blocks(rows, track, 4, moved, block)
    points = rows.select(*track, "frame", F.explode_outer(F.arrays_zip("__at", "speed", "acceleration")).alias("p")).filter("p is not null")  # see explode_points
    points = points.select(*track, "frame", F.col("p.__at").alias("kp"), "p.speed", "p.acceleration")
    return timeaxis.part_means(points, [*track, "frame"], parts, ["speed", "acceleration"])


def strong_windows(motion: DataFrame, audio: DataFrame, track: list[str], fps: float = 30.0, threshold: float = 0.5) -> DataFrame:
    """Long features (track, feature, frame, value) to sliding windows of half a second every tenth of one."""
    pairs = correlate.feature_pairs(motion, audio, track)
    keys = [*track, "motion_feature", "audio_feature"]
    return correlate.sliding_corr(pairs, keys, win=int(0.5 * fps), step=int(0.1 * fps), fps=fps, threshold=threshold)


def lag_study(pairs: DataFrame, group: str, keys: list[str], pair: str, fps: str = "fps", win: int = 150, max_lag: int = 30) -> DataFrame:
    """Lagged cross-correlation windows (frame, x: motion, y: audio, fps) and their profile per lag.

    Frames without motion are dropped and the time axis is closed up, both sides are brought to 30 frames a second, and
    windows are correlated over all lags. Tracks without a rate are left out.
    """
    track = [group, *keys, pair]
    known = pairs.filter(~F.isnan("x") & F.col("x").isNotNull() & F.col(fps).isNotNull()).select(*track, "frame", "x", "y", fps)
    even = timeaxis.resample_rate(blocks.close_up(known, track), track, fps, 30.0, value=["x", "y"])
    return correlate.lag_profile(correlate.cross_corr_windows(even, track, win=win, max_lag=max_lag), group, pair)
