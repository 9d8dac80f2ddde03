"""Correlation operators against NumPy, and their invariances."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackspark.functions.numeric import betainc, ks_p, p_values
from trackspark.operators import correlate, modulation


@pytest.fixture(scope="module")
def pairs(spark):
    rng = np.random.default_rng(1)
    rows = []
    for n in (1, 14, 15, 16, 60):
        x, y = rng.normal(size=n), rng.normal(size=n)
        y = y + x if n == 60 else y
        for i in range(n):
            rows.append((f"t{n}", i, float(x[i]) if i % 11 else math.nan, float(y[i])))
    rows += [("flat", i, 3.0, float(i)) for i in range(20)]
    return spark.createDataFrame(rows, "track string, frame long, x double, y double").repartition(3).cache()


def windows(pairs, win, step):
    data = {}
    for r in pairs.orderBy("track", "frame").collect():
        data.setdefault(r["track"], []).append((r["x"], r["y"]))
    for t, rows in data.items():
        a = np.array(rows)
        for s in range(0, len(a) - win + 1, step):
            part = a[s : s + win]
            part = part[~np.isnan(part).any(1)]
            flat = len(part) < 2 or part.std(0).min() == 0
            yield t, s, len(part), None if flat else np.corrcoef(part.T)[0, 1]


@pytest.mark.parametrize(("win", "step"), [(15, 3), (14, 2), (12, 5), (7, 7)])
def test_sliding_corr(pairs, win, step):
    got = {(r["track"], r["start"]): r for r in correlate.sliding_corr(pairs, ["track"], win=win, step=step).collect()}
    want = list(windows(pairs, win, step))
    assert len(got) == len(want)
    for t, s, n, r in want:
        row = got[t, s]
        assert row["n"] == n and row["time"] == pytest.approx(s / 30)
        assert row["r"] == (None if r is None else pytest.approx(r, abs=1e-9))
        assert row["strong"] == (r is not None and row["p"] < 0.05 and abs(r) > 0.3)


def test_scale_and_shift_do_not_matter(pairs):
    one = {(r["track"], r["start"]): r["r"] for r in correlate.sliding_corr(pairs, ["track"]).collect()}
    moved = pairs.withColumns({"x": F.col("x") * 7 + 1e6, "y": F.col("y") * 0.5 - 3e5})
    two = {(r["track"], r["start"]): r["r"] for r in correlate.sliding_corr(moved, ["track"]).collect()}
    assert one.keys() == two.keys() and all((a is None and two[k] is None) or a == pytest.approx(two[k], abs=1e-6) for k, a in one.items())


def test_zero_step_is_refused(pairs):
    with pytest.raises(ValueError):
        correlate.sliding_corr(pairs, ["track"], step=0)


def test_p_values_at_the_critical_r():
    import pandas as pd

    table = {3: 0.9969173, 5: 0.8783394, 10: 0.6318969, 15: 0.5139775, 16: 0.4973090}
    p = p_values(pd.Series(list(table.values())), pd.Series(list(table)))
    np.testing.assert_allclose(p.to_numpy(float), 0.05, atol=1e-6)
    assert p_values(pd.Series([1.0, None]), pd.Series([2, 9])).tolist()[0] == 1.0
    np.testing.assert_allclose(betainc(np.array([2.0]), 3.0, np.array([0.4])), 0.5248)


@pytest.mark.parametrize("lag", [0, 2, -3])
def test_cross_corr_finds_the_lag(spark, lag):
    rng = np.random.default_rng(2)
    base = rng.normal(size=80)
    rows = [(i, float(base[i - lag + 10]), float(base[i + 10])) for i in range(40)]
    df = spark.createDataFrame([("a", *r) for r in rows], "track string, frame long, x double, y double")
    found = correlate.cross_corr_windows(df, ["track"], win=40, max_lag=5).collect()
    assert max(found, key=lambda r: r["c"])["lag"] == lag and len(found) == 11
    with pytest.raises(ValueError):
        correlate.cross_corr_windows(df, ["track"], win=5, max_lag=5)


def test_align_drops_unequal_tracks(spark):
    a = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 2.0), ("b", 0, 1.0)], "track string, frame long, x double")
    b = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 2.0), ("b", 0, 1.0), ("b", 1, 1.0)], "track string, frame long, y double")
    assert {r["track"] for r in correlate.align(a, b, ["track"]).collect()} == {"a"}


def test_ks(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=200).round(2), rng.normal(0.5, 1, 150).round(2)
    df = spark.createDataFrame([("a", float(v)) for v in a] + [("b", float(v)) for v in b], "m string, v double")
    row = modulation.ks_two_sample(df, "v", "m").first()
    grid = np.unique(np.concatenate((a, b)))
    want = max(abs((a <= g).mean() - (b <= g).mean()) for g in grid)
    assert row["statistic"] == pytest.approx(want) and row["p"] == pytest.approx(ks_p(want, 200, 150))
    assert modulation.ks_two_sample(df.filter("m = 'a'"), "v", "m").collect() == []


def test_histogram_counts_every_row(spark):
    df = spark.createDataFrame([(float(i % 37),) for i in range(500)] + [(None,)], "v double")
    rows = modulation.fd_histogram(df, "v").collect()
    assert sum(r["count"] for r in rows) == 500 and max(r["bin"] for r in rows) < 300
    flat = modulation.fd_histogram(spark.createDataFrame([(1.0,)] * 5, "v double"), "v").collect()
    assert [(r["bin"], r["count"]) for r in flat] == [(0, 5)]
