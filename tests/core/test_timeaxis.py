"""Time-axis operators against NumPy formulas, with NaN and tracks of any length."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trackspark.operators import select, timeaxis

LENGTHS = (1, 2, 14, 15, 16, 40)


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(0)
    found = {f"t{n}": rng.normal(size=n).round(3) for n in LENGTHS}
    found["gaps"] = np.where(np.arange(20) % 6 == 3, np.nan, rng.normal(size=20))
    found["nan"] = np.full(5, np.nan)
    found["flat"] = np.full(9, 2.5)
    return found


@pytest.fixture(scope="module")
def df(spark, series):
    rows = [(t, i, float(v), float(v) * 2) for t, x in series.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "track string, frame long, x double, y double").repartition(3).cache()


def arrays(df, column):
    out = {}
    for r in df.orderBy("track", "frame").collect():
        out.setdefault(r["track"], []).append(math.nan if r[column] is None else r[column])
    return {t: np.array(v) for t, v in out.items()}


def savgol(x):
    wide = np.concatenate(([x[0]] * 2, x, [x[-1]] * 2))
    return sum(w * wide[k : k + len(x)] for k, w in enumerate((-3, 12, 17, 12, -3))) / 35


def test_smooth(df, series):
    got = arrays(timeaxis.smooth(df, ["track"], ["x"]), "x")
    for t, x in series.items():
        np.testing.assert_allclose(got[t], savgol(x), atol=1e-12)


def test_smooth_on_arrays_is_smooth_on_numbers(df):
    both = timeaxis.smooth(df.withColumn("v", F.array("x", "y")), ["track"], ["v"])
    one = timeaxis.smooth(df, ["track"], ["x", "y"])
    joined = both.select("track", "frame", "v").join(one, ["track", "frame"])
    bad = joined.filter(~(F.col("v")[0].eqNullSafe(F.col("x")) & F.col("v")[1].eqNullSafe(F.col("y"))))
    assert bad.count() == 0


def test_smooth_refuses_even_windows(df):
    with pytest.raises(ValueError):
        timeaxis.smooth(df, ["track"], ["x"], win=4)


def test_gradient_and_speed(df, series):
    got = arrays(timeaxis.gradient(df, ["track"], {"d": "x"}, 30.0), "d")
    moved = arrays(timeaxis.speed_acceleration(df, ["track"], fps=30.0), "acceleration")
    for t, x in series.items():
        if len(x) == 1:
            assert np.isnan(got[t]).all()
            continue
        np.testing.assert_allclose(got[t], np.gradient(x) * 30, atol=1e-9)
        if len(x) > 1:
            second = np.gradient(np.gradient(x) * 30) * 30
            np.testing.assert_allclose(moved[t], np.hypot(second, 2 * second), atol=1e-7)


def test_chain_of_windows_shuffles_once(spark, df):
    rows = df.select("track", "frame", "x", "y")
    plan = timeaxis.speed_acceleration(timeaxis.smooth(rows, ["track"], ["x", "y"]), ["track"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_fill_nan_frames(df, series):
    got = arrays(timeaxis.fill_nan_frames(df, ["track"], ["x", "y"]), "x")
    x = series["gaps"]
    for i in range(len(x)):
        want = x[i] if not np.isnan(x[i]) else (x[i - 1] + x[i + 1]) / 2
        assert got["gaps"][i] == pytest.approx(want)
    assert np.isnan(got["nan"]).all()


@pytest.mark.parametrize("n", [1, 2, 7, 40, 93])
def test_resample_endpoint(df, series, n):
    got = arrays(timeaxis.resample_endpoint(df.select("track", "frame", F.col("x").alias("value")), ["track"], n), "value")
    for t, x in series.items():
        if not np.isnan(x).any():
            np.testing.assert_allclose(got[t], np.interp(np.linspace(0, len(x) - 1, n), np.arange(len(x)), x), atol=1e-9)


def test_resample_rate(df, series):
    got = arrays(timeaxis.resample_rate(df.select("track", "frame", F.col("x").alias("value"), F.lit(30.0).alias("fps")), ["track"], "fps"), "value")
    for t, x in series.items():
        np.testing.assert_allclose(got[t], x)
    half = arrays(timeaxis.resample_rate(df.select("track", "frame", F.col("x").alias("value"), F.lit(60.0).alias("fps")), ["track"], "fps"), "value")
    np.testing.assert_allclose(half["t16"], series["t16"][::2])


@settings(max_examples=5, deadline=None)
@given(st.lists(st.booleans(), min_size=1, max_size=40))
def test_islands_round_trip(spark, flags):
    rows = spark.createDataFrame([("a", i, f) for i, f in enumerate(flags)], "track string, frame long, flag boolean")
    got = timeaxis.islands(rows, ["track"], F.col("flag")).collect()
    on = {i for r in got for i in range(r["start"], r["end"] + 1)}
    assert on == {i for i, f in enumerate(flags) if f} and sum(r["end"] - r["start"] + 1 for r in got) == len(on)


def test_robust_scale(df, series):
    got = arrays(timeaxis.robust_scale(df.select("track", "frame", F.col("x").alias("value")), ["track"]), "value")
    x = series["t40"]
    low, high = np.percentile(x, [5, 95])
    np.testing.assert_allclose(got["t40"], (np.clip(x, low, high) - low) / (high - low))
    np.testing.assert_allclose(got["flat"], 2.5)
    np.testing.assert_allclose(got["nan"], 0)


def test_masks(spark, df):
    spans = spark.createDataFrame([("t40", 3, 5), ("t40", 38, 900), ("t16", None, 4), ("t15", 9, 2)], "track string, start long, end long")
    got = arrays(select.mask_intervals(df, spans, ["track"], ["x"], block=4), "x")
    assert np.flatnonzero(np.isnan(got["t40"])).tolist() == [3, 4, 5, 38, 39]
    assert not np.isnan(got["t16"]).any() and not np.isnan(got["t15"]).any()
    low = select.mask_low_confidence(df.withColumn("score", F.when(F.col("frame") == 0, float("nan")).otherwise(F.col("frame").cast("double"))), ["x"], limit=3.0)
    assert np.flatnonzero(np.isnan(arrays(low, "x")["t40"])).tolist() == [1, 2]
    filled = select.fill_nan(spark.createDataFrame([(math.nan,), (math.inf,), (-math.inf,), (2.0,)], "v double"), ["v"], infinite=True)
    assert sorted(r["v"] for r in filled.collect()) == [-1, 0, 1, 2]
