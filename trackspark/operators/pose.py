"""Frames of keypoints: one row per frame, points as an array of (x, y), or one row per point (kp, x, y, score)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import nan, above
from .blocks import BLOCK, halo, in_blocks
from .timeaxis import gradient

#: Frames that are registered in one go, whatever Spark's batches have.
FRAMES_AT_ONCE = 1024

# Points of the 133-point whole-body layout, and of the 68-point face, by part.
BODY_PARTS = {
    "head": [0, 1, 2, 3, 4],
    "left_arm": [5, 7, 9],
    "right_arm": [6, 8, 10],
    "left_leg": [11, 13, 15],
    "right_leg": [12, 14, 16],
    "left_foot": [17, 18, 19],
    "right_foot": [20, 21, 22],
    "face": list(range(23, 91)),
    "left_hand": list(range(91, 112)),
    "right_hand": list(range(112, 133)),
}
FACE_PARTS = {
    "face_contour": list(range(0, 17)),
    "right_eyebrow": list(range(17, 22)),
    "left_eyebrow": list(range(22, 27)),
    "nose": list(range(27, 36)),
    "right_eye": list(range(36, 42)),
    "left_eye": list(range(42, 48)),
    "mouth": list(range(48, 68)),
}


def part_dim(spark, which: str = "body") -> DataFrame:
    """The bridge (part, kp): a point may be in several parts."""
    table = BODY_PARTS if which == "body" else FACE_PARTS
    return spark.createDataFrame([(p, k) for p, ks in table.items() for k in ks], "part string, kp int")


def normalize_frame(frames: DataFrame, kp: str = "kp", scale: float = 1.0) -> DataFrame:
    """Points less their mean, over the greatest distance from it (+1e-8), times scale; NaN if any coordinate is."""
    bad = F.exists(kp, lambda p: F.isnan(p["x"]) | F.isnan(p["y"]) | F.isnull(p["x"]) | F.isnull(p["y"]))
    mean = lambda axis: F.aggregate(kp, F.lit(0.0), lambda t, p: t + p[axis]) / F.size(kp)
    frames = frames.withColumns({"__bad": bad, "__mx": mean("x"), "__my": mean("y")})
    distance = F.array_max(F.transform(kp, lambda p: F.sqrt((p["x"] - F.col("__mx")) ** 2 + (p["y"] - F.col("__my")) ** 2)))
    frames = frames.withColumn("__far", distance + 1e-8)

    def scaled(p: Column, axis: str, mean: str) -> Column:
        return F.when(F.col("__bad"), nan()).otherwise((p[axis] - F.col(mean)) / F.col("__far") * scale).alias(axis)

    return frames.withColumn(kp, F.transform(kp, lambda p: F.struct(scaled(p, "x", "__mx"), scaled(p, "y", "__my")))).drop("__bad", "__mx", "__my", "__far")


def explode_points(frames: DataFrame, keys: list[str], kp: str = "kp") -> DataFrame:
    """keys, kp, x, y: one row per point.

    For a plain posexplode Spark would first filter by the array's size, as a copy of all that the array is made from.
    """
    rows = frames.select(*keys, F.posexplode_outer(kp).alias("kp", "__p")).filter("kp is not null")
    return rows.select(*keys, "kp", "__p.x", "__p.y")


def drop_keypoints(points: DataFrame, dropped: DataFrame, keys: list[str], on: list[str], kp: str = "kp") -> DataFrame:
    """Without the points in `dropped` (`on` columns and kp); the rest are numbered anew from 0 in each key."""
    kept = points.join(dropped.select(*on, kp).distinct(), [*on, kp], "left_anti")
    return kept.withColumn(kp, F.row_number().over(Window.partitionBy(*keys).orderBy(kp)) - 1)


def body_subset(frames: DataFrame, kp: str = "kp") -> DataFrame:
    """The 55 upper-body points: no legs (but hips 11 and 12), feet or face."""
    gone = set(range(13, 17)) | set(range(17, 91))
    return frames.withColumn(kp, F.filter(kp, lambda p, i: ~i.isin(*sorted(gone))))


def visible_edges(points: DataFrame, edges: DataFrame, keys: list[str], limit: float, occluded: DataFrame | None = None) -> DataFrame:
    """Edges (a, b) of each frame whose both ends score over `limit` and aren't occluded (keys and kp)."""
    seen = points.filter(above("score", limit))
    if occluded is not None:
        seen = seen.join(occluded, [c for c in occluded.columns if c in seen.columns], "left_anti")
    ends = [seen.select(*keys, F.col("kp").alias(e), F.col("x").alias(f"x_{e}"), F.col("y").alias(f"y_{e}")) for e in "ab"]
    return ends[0].join(edges, "a").join(ends[1], [*keys, "b"])


def mask_region(chunks: DataFrame, region: str, column: str = "points", template: str | None = None) -> DataFrame:
    """Points of a region get the template's value (0 without one); region body masks all points with 0."""
    if region == "body":
        return chunks.withColumn(column, F.transform(column, lambda v: F.lit(0.0)))
    points = FACE_PARTS[region]
    fill = lambda i: F.coalesce(F.get(F.col(template), i), F.lit(0.0)) if template else F.lit(0.0)
    return chunks.withColumn(column, F.transform(column, lambda v, i: F.when(i.isin(*points), fill(i)).otherwise(v)))


def shuffle_time(chunks: DataFrame, keys: list[str], seed: int = 0, frame: str = "frame") -> DataFrame:
    """`frame` becomes its place in one random order of the key's frames, the same for all rows of a frame and seed."""
    frames = chunks.select(*keys, frame).distinct()
    order = Window.partitionBy(*keys).orderBy(F.xxhash64(F.lit(seed), *keys, frame), frame)
    places = frames.withColumn("__to", F.row_number().over(order) - 1)
    base = frames.withColumn("__at", F.row_number().over(Window.partitionBy(*keys).orderBy(frame)) - 1).withColumnRenamed(frame, "__from")
    moved = places.join(base, [*[places[k].eqNullSafe(base[k]) for k in keys], places["__to"] == base["__at"]]).select(*[places[k] for k in keys], places[frame], "__from")
    return chunks.join(moved, [*keys, frame]).drop(frame).withColumnRenamed("__from", frame)


def name_keypoints(df: DataFrame, names: DataFrame, scheme: str = "whole", kp: str = "kp") -> DataFrame:
    """Adds `name` from names (kp, name). face: points start at 23; body55: from 13 on they are the hands, from 91."""
    number = {"whole": F.col(kp), "face": F.col(kp) + 23, "body55": F.when(F.col(kp) >= 13, F.col(kp) - 13 + 91).otherwise(F.col(kp))}[scheme]
    lookup = names.select(F.col("kp").alias("__kp"), "name")
    return df.withColumn("__kp", number).join(lookup, "__kp", "left").drop("__kp")


def distance(ax, ay, bx, by) -> Column:
    return F.sqrt((ax - bx) ** 2 + (ay - by) ** 2)


def bow_arm_features(frames: DataFrame, track: list[str], fps: float = 30.0, arm: tuple[int, int, int] = (6, 8, 10), kp: str = "kp", frame: str = "frame") -> DataFrame:
    """wrist_speed, elbow_angle in degrees and arm_extension (shoulder to wrist) of one arm (shoulder, elbow, wrist)."""
    point = {n: F.element_at(kp, i + 1) for n, i in zip("sew", arm)}
    flat = frames.select(*track, frame, *(point[n][axis].alias(f"{n}{axis}") for n in "sew" for axis in "xy"))
    moved = in_blocks(flat, track, 1, lambda rows, keys: gradient(rows, keys, {"vx": "wx", "vy": "wy"}, fps, frame), frame=frame)
    c = F.col
    dot = (c("sx") - c("ex")) * (c("wx") - c("ex")) + (c("sy") - c("ey")) * (c("wy") - c("ey"))
    norms = distance(c("sx"), c("sy"), c("ex"), c("ey")) * distance(c("wx"), c("wy"), c("ex"), c("ey"))
    cosine = F.coalesce(F.try_divide(dot, norms), nan())
    angle = F.when(F.isnan(cosine), nan()).otherwise(F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))))
    return moved.select(
        *track, frame, F.sqrt(c("vx") ** 2 + c("vy") ** 2).alias("wrist_speed"), angle.alias("elbow_angle"), distance(c("sx"), c("sy"), c("wx"), c("wy")).alias("arm_extension"),
    )


def face_features(frames: DataFrame, keys: list[str], points: str = "pts", ring: tuple[int, int] = (48, 68), ends: tuple[int, int] = (8, 33)) -> DataFrame:
    """mouth_area (shoelace over the ring of points) and jaw_to_nose (distance of two points)."""
    mouth = F.slice(points, ring[0] + 1, ring[1] - ring[0])
    turned = F.concat(F.slice(mouth, 2, ring[1] - ring[0] - 1), F.slice(mouth, 1, 1))
    cross = F.zip_with(mouth, turned, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    area = F.abs(F.aggregate(cross, F.lit(0.0), lambda t, v: t + v)) / 2
    a, b = (F.element_at(points, e + 1) for e in ends)
    return frames.select(*keys, area.alias("mouth_area"), distance(a["x"], a["y"], b["x"], b["y"]).alias("jaw_to_nose"))


def rigid_fit(points: np.ndarray, template: np.ndarray, fit: int) -> np.ndarray:
    """Points (n, k, d) turned and moved so that their first `fit` lie closest to the template's (Kabsch algorithm)."""
    a, b = points[:, :fit], template[:fit]
    ca, cb = a.mean(1, keepdims=True), b.mean(0)
    known = ~np.isnan(a).any((1, 2))
    turn = np.full((len(points), points.shape[2], points.shape[2]), np.nan)
    if known.any():
        u, _, vt = np.linalg.svd(np.einsum("nki,kj->nij", (a - ca)[known], b - cb))
        flip = np.ones((known.sum(), points.shape[2]))
        flip[:, -1] = np.sign(np.linalg.det(u @ vt))
        turn[known] = (u * flip[:, None, :]) @ vt
    return (points - ca) @ turn + cb


def register_to_template(frames: DataFrame, keys: list[str], template: list[list[float]], fit: int = 48, points: str = "pts") -> DataFrame:
    """Keys and the x, y of each frame's points (structs x, y, z) after rigid alignment to `template`."""
    goal = np.array(template, float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, FRAMES_AT_ONCE):
                batch = whole.slice(first, FRAMES_AT_ONCE)
                rows = batch.column(len(keys))
                if len(pc.unique(pc.list_value_length(rows))) != 1 or rows.null_count:
                    raise ValueError("frames must have the same number of points")
                flat = rows.flatten()
                data = np.stack([pc.struct_field(flat, axis).cast(pa.float64()).to_numpy(zero_copy_only=False) for axis in "xyz"], axis=-1)
                moved = rigid_fit(data.reshape(len(rows), -1, 3), goal, fit)[:, :, :2]
                ends = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * moved.shape[1])
                made = pa.StructArray.from_arrays([pa.array(moved[:, :, i].ravel()) for i in range(2)], ["x", "y"])
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.ListArray.from_arrays(ends, made)], names=[*keys, points])

    kept = frames.select(*keys, points)
    schema = ", ".join(f"`{k}` {kept.schema[k].dataType.simpleString()}" for k in keys)
    return kept.mapInArrow(run, f"{schema}, `{points}` array<struct<x:double,y:double>>")


def apply_track_features(frames: DataFrame, track: list[str], fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, frame: str = "frame", reach: int | None = None, block: int = BLOCK) -> DataFrame:
    """User-defined features: fn(pandas frame, sorted by frame) -> pandas frame of `schema`.

    A function of whole tracks gets each track at once. One that gives rows by frame and looks `reach` frames either way
    gets a block of a track with so many frames more on both sides; of what it makes, the block's own frames are kept, so
    that a long track is several tasks and none is held whole.
    """
    if reach is None:
        return frames.groupBy(*track).applyInPandas(lambda rows: fn(rows.sort_values(frame, ignore_index=True)), schema)
    size = max(block, reach)

    def own(rows: pd.DataFrame) -> pd.DataFrame:
        number = rows["__block"].iloc[0]
        out = fn(rows.drop(columns=["__block", "__own"]).sort_values(frame, ignore_index=True)) if rows["__own"].any() else None
        return out[out[frame] // size == number] if out is not None else pd.DataFrame(columns=names)

    names = T.StructType.fromDDL(schema).names
    return halo(frames, reach, reach, size, frame).groupBy(*track, "__block").applyInPandas(lambda rows: own(rows), schema)
