"""Long tracks in blocks of frames equal whole tracks, and run on several tasks."""

import math

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from trackspark.operators import blocks, correlate, timeaxis
from trackspark.plans import pose_queries, workloads

LENGTHS = (1, 2, 6, 7, 8, 13, 14, 15, 29, 64)


@pytest.fixture(scope="module")
def df(spark):
    rng = np.random.default_rng(1)
    rows = []
    for n in LENGTHS:
        x = np.where(rng.random(n) < 0.3, np.nan, rng.normal(size=n))
        x[5:27] = np.nan  # a gap over several blocks
        rows += [(f"t{n}", i, float(v), float(w)) for i, (v, w) in enumerate(zip(x, rng.normal(size=n)))]
    rows += [("late", i, float(i % 4), 1.0) for i in range(100, 131)] + [("minus", i, float(i * i % 7), 2.0) for i in range(-9, 9)]
    rows += [("nan", i, math.nan, math.nan) for i in range(20)]
    return spark.createDataFrame(rows, "track string, frame long, x double, y double").repartition(3).cache()


def same(a, b):
    key = lambda r: tuple("nan" if isinstance(v, float) and math.isnan(v) else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r)
    a, b = a.select(*sorted(a.columns)), b.select(*sorted(b.columns))
    assert a.columns == b.columns and sorted(map(key, a.collect())) == sorted(map(key, b.collect()))


@pytest.mark.parametrize("block", [4, 7, 1000])
def test_chains_in_blocks_equal_whole_tracks(df, block):
    smooth = lambda rows, keys: timeaxis.smooth(rows, keys, ["x", "y"])
    both = lambda rows, keys: timeaxis.speed_acceleration(smooth(rows, keys), keys, fps=30.0)
    for reach, chain in ((2, smooth), (1, lambda rows, keys: timeaxis.gradient(rows, keys, {"d": "x"})), (4, both)):
        same(blocks.in_blocks(df, ["track"], reach, chain, block), chain(df, ["track"]))


@pytest.mark.parametrize("block", [4, 7, 1000])
def test_gaps_runs_and_windows_in_blocks_equal_whole_tracks(df, block):
    order = Window.partitionBy("track").orderBy("frame")
    known = F.when(~F.isnan("x"), F.col("x"))
    before = F.last(known, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(known, ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    plain = df.withColumn("x", F.coalesce(known, (before + after) / 2, before, after, F.col("x")))
    same(timeaxis.fill_nan_frames(df, ["track"], ["x"], block=block), plain)

    flag = F.isnan("x") | (F.col("x") > 1)
    runs = df.filter(flag).withColumn("run", F.col("frame") - F.row_number().over(order)).groupBy("track", "run").agg(F.min("frame").alias("start"), F.max("frame").alias("end")).drop("run")
    same(timeaxis.islands(df, ["track"], flag, block=block), runs)

    closed = df.filter(~flag).withColumn("frame", F.row_number().over(order).cast("long") - 1)
    same(blocks.close_up(df.filter(~flag), ["track"], block), closed)

    zero = df.filter("frame >= 0 and track <> 'late'")
    for win, step in ((5, 2), (6, 3), (4, 4)):
        same(correlate.sliding_corr(zero, ["track"], win=win, step=step, block=block), correlate.sliding_corr(zero, ["track"], win=win, step=step, block=10**6))


def test_points_are_normalised_once_and_few_tracks_are_several_tasks(spark, tmp_path):
    """No filter repeats the arrays' expressions for each point, and frames are numbered by label and block, null labels too."""
    rows = [(i * 1000, None if i % 5 == 4 else i % 2, [float((i * k) % 17) for k in range(64)]) for i in range(60)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = pose_queries.w1_normalize_frame(spark, str(tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert not any("Filter" in line and "lambda" in line for line in plan)
    windows = [line for line in plan if "Window [row_number" in line]
    assert windows and all("__block" in line for line in windows)
    want = {}
    for _, label, _ in rows:
        want.setdefault(label, []).append(len(want.get(label, [])))
    got = {}
    for r in found.filter("kp = 31").collect():
        got.setdefault(r["track"], []).append(r["frame"])
    assert {k: sorted(v) for k, v in got.items()} == want and found.count() == 60 * 32


def test_motion_features_in_blocks(spark):
    rng = np.random.default_rng(2)
    rows = [(t, i, [(float(a), float(b)) for a, b in rng.normal(size=(6, 2))], rng.uniform(0, 9, 6).tolist()) for t in ("a", "b") for i in range(23)]
    frames = spark.createDataFrame(rows, "track string, frame long, kp array<struct<x: double, y: double>>, score array<double>")
    parts = spark.createDataFrame([("p", 0), ("p", 2), ("q", 3)], "part string, kp int")
    run = lambda block: workloads.motion_features(frames, ["track"], parts, [1], block=block)
    same(run(5), run(1000))


def test_one_track_is_several_tasks(spark):
    """10^7 frames of one track, smoothed and differentiated twice with one exchange, by track and block."""
    rows = spark.range(10**7).select(F.lit("a").alias("track"), F.col("id").alias("frame"), F.sin("id").alias("x"), F.cos("id").alias("y"))
    moved = blocks.in_blocks(rows, ["track"], 4, lambda r, k: timeaxis.speed_acceleration(timeaxis.smooth(r, k, ["x", "y"]), k))
    plan = moved._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "__block" in plan.split("Exchange hashpartitioning")[1].split("\n")[0]
    spread = moved.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.max("speed").alias("s")).collect()
    assert sum(r["n"] for r in spread) == 10**7 and len(spread) > 1 and max(r["n"] for r in spread) < 6 * 10**6
    runs = timeaxis.islands(rows, ["track"], F.col("frame") % 1_000_000 != 5)
    assert sorted((r["start"], r["end"]) for r in runs.collect()) == [(0, 4)] + [(6 + k * 10**6, min(4 + (k + 1) * 10**6, 10**7 - 1)) for k in range(10)]
