"""Choosing songs, frames and points; masking values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import nan, below


def select_songs(
    songs: DataFrame, artist: str | None = None, song: str | None = None, layout: list[str] | None = None, layout_set: list[str] | None = None,
    require_body: bool = False, drop_moving: bool = False, drop_face_fp: bool = False,
) -> DataFrame:
    """Songs with a layout that has no null member, narrowed by what is given. A null moving_camera passes."""
    keep = F.col("layout").isNotNull() & ~F.exists("layout", F.isnull)
    if artist is not None:
        keep &= F.col("artist") == artist
    if song is not None:
        keep &= F.col("song") == song
    if layout is not None:
        keep &= F.col("layout") == F.array(*map(F.lit, layout))
    if layout_set is not None:
        keep &= F.array_sort(F.array_distinct("layout")) == F.array(*map(F.lit, sorted(set(layout_set))))
    if require_body:
        keep &= F.col("correct_body_detection").eqNullSafe(True)
    if drop_moving:
        keep &= ~F.coalesce("moving_camera", F.lit(False))
    if drop_face_fp:
        keep &= F.coalesce(F.size("face_false_positive_frames"), F.lit(0)) <= 0
    return songs.filter(keep)


def exclude_songs(songs: DataFrame, deny: DataFrame | list[tuple[str, str]]) -> DataFrame:
    """Without the listed (artist, song) pairs, a table or a list."""
    if isinstance(deny, DataFrame):
        return songs.join(deny.select("artist", "song"), ["artist", "song"], "left_anti")
    listed = songs.sparkSession.createDataFrame(deny or [("", "")], "artist string, song string")
    return songs.join(F.broadcast(listed) if len(deny) < 10_000 else listed, ["artist", "song"], "left_anti")


def occluded_parts(songs: DataFrame, performer: str = "instrument") -> DataFrame:
    """The arm and hand that a performer's place in the layout hides: left for the first one, else right for the last."""
    side = F.when(F.col(performer) == F.try_element_at("layout", F.lit(1)), "left").when(F.col(performer) == F.try_element_at("layout", F.lit(-1)), "right")
    hidden = songs.withColumn("__side", side).filter("__side is not null")
    parts = F.array(F.concat("__side", F.lit("_arm")), F.concat("__side", F.lit("_hand")))
    return hidden.select("artist", "song", performer, F.explode(parts).alias("part"))


def slice_chunk(frames: DataFrame, start_s: float, duration_s: float, fps: float, frame: str = "frame") -> DataFrame:
    """Frames from int(start * fps) up to, without, int((start + duration) * fps)."""
    first, end = int(start_s * fps), int((start_s + duration_s) * fps)
    return frames.filter((F.col(frame) >= first) & (F.col(frame) < end))


def mask_low_confidence(frames: DataFrame, values: list[str], score: str = "score", limit: float = 3.0) -> DataFrame:
    """`values` are NaN where the score is under `limit`; a NaN score doesn't mask."""
    return frames.withColumns({v: F.when(below(score, limit), nan()).otherwise(F.col(v)) for v in values})


def mask_intervals(frames: DataFrame, intervals: DataFrame, track: list[str], values: list[str], frame: str = "frame", block: int = 1024) -> DataFrame:
    """`values` are NaN in the inclusive intervals (start, end) of the track; intervals with a null bound are skipped.

    Intervals are dealt to the blocks of frames that they touch, so that the range is an equi-join and a filter.
    """
    spans = intervals.filter("start is not null and end is not null and start <= end")
    blocks = F.sequence(F.floor(F.col("start") / block), F.floor(F.col("end") / block))
    spans = spans.select(*track, "start", "end", F.explode(blocks).alias("__block"))
    keyed = frames.withColumn("__block", F.floor(F.col(frame) / block))
    hit = keyed.select(*track, frame, "__block").join(spans, [*track, "__block"]).filter(F.col(frame).between(F.col("start"), F.col("end")))
    hit = hit.select(*track, frame).distinct().withColumn("__hit", F.lit(True))
    out = frames.join(hit, [*track, frame], "left")
    return out.withColumns({v: F.when(F.col("__hit"), nan()).otherwise(F.col(v)) for v in values}).drop("__hit")


def fill_nan(df: DataFrame, columns: list[str], value: float = 0.0, infinite: bool = False) -> DataFrame:
    """NaN becomes `value`; with `infinite`, infinities become 1 and -1."""

    def filled(c: str) -> Column:
        x = F.nanvl(F.col(c), F.lit(float(value)))
        return F.when(x == float("inf"), 1.0).when(x == float("-inf"), -1.0).otherwise(x) if infinite else x

    return df.withColumns({c: filled(c) for c in columns})


def all_of(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, flags, F.lit(True))
