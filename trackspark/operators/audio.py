"""Operators on tables of audio samples (track, i, y)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.tables import kept
from .blocks import halo, in_blocks


def mix_channels(samples: DataFrame, track: list[str], path: str = "channel", i: str = "i", y: str = "y") -> DataFrame:
    """One signal per track from its files in path order, mixed as (y + y2) / 2 again and again."""
    files = samples.select(*track, path).distinct()
    order = Window.partitionBy(*track).orderBy(path)
    count = F.count("*").over(Window.partitionBy(*track))
    place = F.row_number().over(order)
    power = F.when(place == 1, count - 1).otherwise(count - place + 1)
    weights = files.withColumn("__w", F.pow(F.lit(0.5), power))
    return samples.join(weights, [*track, path]).groupBy(*track, i).agg(F.sum(F.col(y) * F.col("__w")).alias(y))


def framewise_rms(samples: DataFrame, track: list[str], hop: int = 1024, i: str = "i", y: str = "y") -> DataFrame:
    """Root mean square of centred frames of two hops, n div hop + 1 of them, with silence beyond the ends."""
    hops = samples.groupBy(*track, F.expr(f"{i} div {hop}").alias("frame")).agg(F.sum(F.col(y) * F.col(y)).alias("__e"), F.count("*").alias("__n"))
    spine = samples.groupBy(*track).agg(F.count("*").alias("__total")).select(*track, F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"__total div {hop}"))).alias("frame"))
    both = spine.join(hops, [*track, "frame"], "left").withColumn("__e", F.coalesce("__e", F.lit(0.0)))
    two = Window.partitionBy(*track).orderBy("frame").rowsBetween(-1, 0)
    return both.select(*track, "frame", F.sqrt(F.sum("__e").over(two) / (2 * hop)).alias("rms"))


def mel_bank(rate: float, size: int, bands: int) -> np.ndarray:
    """bands x (size / 2 + 1) weights of triangles between points that are equally spaced in mel from 0 to half the rate,
    each of equal area: linear in Hz up to 1000 Hz, 15 mel, and logarithmic beyond, 27 mel to a factor of 6.4."""
    top, step = rate / 2, math.log(6.4) / 27
    points = np.linspace(0, top * 3 / 200 if top < 1000 else 15 + math.log(top / 1000) / step, bands + 2)
    hertz = np.where(points < 15, points * 200 / 3, 1000 * np.exp(step * (points - 15)))
    at = np.linspace(0, top, size // 2 + 1)
    low, mid, high = (hertz[k : k + bands, None] for k in range(3))
    return np.maximum(0, np.minimum((at - low) / (mid - low), (high - at) / (high - mid))) * 2 / (high - low)


def mel_levels(samples: DataFrame, track: list[str], hop: int, size: int, bands: int, rate: float, i: str, y: str, together: int) -> DataFrame:
    """track, frame and `levels`, the power of each mel band in dB, of frames of `size` samples around every `hop`-th sample
    (n div hop + 1 of them), with silence beyond the ends.

    Samples are shuffled once, into blocks of `together` hops with half a frame more on either side, so that a frame that
    lies across the edge of a block is whole in one; a block's frames are one transform.
    """
    half, block = size // 2, hop * together
    rows = halo(samples.select(*track, F.col(i).cast("long").alias("__i"), F.col(y).cast("double").alias("__y")), half, half, block, "__i")
    rows = rows.drop("__own").repartition(*track, "__block").sortWithinPartitions(*track, "__block")
    schema = T.StructType([rows.schema[t] for t in track] + [T.StructField("frame", T.LongType()), T.StructField("levels", T.ArrayType(T.DoubleType()))])
    types, bank, window = to_arrow_schema(schema), mel_bank(rate, size, bands).T, 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)

    def frames(key: tuple, number: int, at: np.ndarray, values: np.ndarray) -> pa.RecordBatch | None:
        start = number * block - half
        wave = np.zeros(block + size)
        wave[at - start] = values
        # frame t is there if a sample comes before its middle; the last samples of a track are in the halo of its last frame
        first, last = max(0, number * together), min((number + 1) * together - 1, (int(at.max()) + 1) // hop)
        if last < first:
            return None
        cut = np.lib.stride_tricks.sliding_window_view(wave, size)[(np.arange(first, last + 1) - number * together) * hop]
        levels = 10 * np.log10(np.maximum(1e-10, np.abs(np.fft.rfft(cut * window, axis=1)) ** 2 @ bank))
        n = len(levels)
        columns = [pa.array([k] * n, types.field(c).type) for c, k in enumerate(key)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(np.arange(first, last + 1)), pa.array(levels.tolist(), types.field("levels").type)], schema=types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            *names, at, values, number = (batch.column(c) for c in range(len(track) + 3))
            number, of = number.to_numpy(), list(zip(*(c.to_pylist() for c in names)))
            changes = np.flatnonzero(np.array([a != b for a, b in zip(of[1:], of[:-1])], bool) | (np.diff(number) != 0)) + 1
            edges = [0, *changes.tolist(), batch.num_rows]
            at, values = at.to_numpy(), values.to_numpy(zero_copy_only=False)
            for a, b in zip(edges, edges[1:]):
                now = (of[a], int(number[a]))
                if now != key:
                    if parts and (out := frames(*key, *(np.concatenate(x) for x in zip(*parts)))):
                        yield out
                    key, parts = now, []
                parts.append((at[a:b], np.nan_to_num(values[a:b])))
        if parts and (out := frames(*key, *(np.concatenate(x) for x in zip(*parts)))):
            yield out

    return rows.select(*track, "__i", "__y", "__block").mapInArrow(run, schema)


def onset_envelope(samples: DataFrame, track: list[str], hop: int = 1024, bands: int = 128, i: str = "i", y: str = "y", rate: float = 48000.0, size: int | None = None, depth: float = 80.0, together: int = 64) -> DataFrame:
    """Onset strength: the mean over mel bands of the rise of level in dB from frame to frame, n div hop + 1 of them.

    Frames of `size` samples (two hops) are centred; levels are not lower than `depth` dB under the loudest of the track,
    which is found first. A rise is told at the frame where its samples begin to be in the middle: size div (2 hop) frames
    on, and the first ones are 0. Missing samples and NaN are silence.
    """
    size = size or 2 * hop
    late = size // (2 * hop)
    levels = kept(mel_levels(samples, track, hop, size, bands, rate, i, y, max(together, -(-size // hop))))
    loudest = levels.groupBy(*track).agg(F.max(F.array_max("levels")).alias("__top"))
    floored = levels.join(loudest, track).select(*track, "frame", F.transform("levels", lambda v: F.greatest(v, F.col("__top") - depth)).alias("levels"))

    def rises(rows: DataFrame, keys: list[str]) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy("frame")
        now, before = F.lag("levels", late).over(order), F.lag("levels", late + 1).over(order)
        rows = rows.withColumns({"__now": now, "__before": before})
        rise = F.aggregate(F.zip_with("__now", "__before", lambda a, b: F.greatest(F.lit(0.0), a - b)), F.lit(0.0), lambda t, v: t + v) / bands
        return rows.withColumn("onset_env", F.coalesce(rise, F.lit(0.0)))

    return in_blocks(floored, track, late + 1, rises).select(*track, "frame", "onset_env")


def si_sdr(samples: DataFrame, chunk: list[str], estimate: str = "est", reference: str = "ref", eps: float = 1e-8) -> DataFrame:
    """Scale-invariant signal-to-distortion ratio in dB of each chunk, from one pass of sums."""
    e, r = F.col(estimate), F.col(reference)
    sums = samples.groupBy(*chunk).agg(F.count("*").alias("n"), F.sum(e).alias("se"), F.sum(r).alias("sr"), F.sum(e * e).alias("see"), F.sum(r * r).alias("srr"), F.sum(e * r).alias("ser"))
    c = F.col
    ee, rr, er = c("see") - c("se") ** 2 / c("n"), c("srr") - c("sr") ** 2 / c("n"), c("ser") - c("se") * c("sr") / c("n")
    alpha = (er + eps) / (rr + eps)
    target, noise = alpha * alpha * rr, ee - 2 * alpha * er + alpha * alpha * rr
    return sums.select(*chunk, (10 * F.log10((target + eps) / (F.greatest(noise, F.lit(0.0)) + eps))).alias("si_sdr"))
