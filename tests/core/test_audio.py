"""Onset strength against a plain NumPy version, whatever the blocks."""

import math

import numpy as np
import pytest

from trackspark.operators import audio
from trackspark.plans import signal_queries, standins


def plain_onset(y, hop, size, bands, rate, depth=80.0):
    padded = np.concatenate((np.zeros(size // 2), y, np.zeros(size)))
    window = np.array([0.5 - 0.5 * math.cos(2 * math.pi * j / size) for j in range(size)])
    frames = np.array([padded[t * hop : t * hop + size] for t in range(len(y) // hop + 1)]) * window
    power = np.abs(np.fft.rfft(frames)) ** 2
    mel = lambda f: f * 3 / 200 if f < 1000 else 15 + math.log(f / 1000) * 27 / math.log(6.4)
    hz = lambda m: m * 200 / 3 if m < 15 else 1000 * math.exp((m - 15) * math.log(6.4) / 27)
    points = [hz(mel(rate / 2) * k / (bands + 1)) for k in range(bands + 2)]
    level = np.zeros((len(frames), bands))
    for b in range(bands):
        low, mid, high = points[b : b + 3]
        for k in range(size // 2 + 1):
            f = k * rate / size
            up, down = (f - low) / (mid - low), (high - f) / (high - mid)
            level[:, b] += max(0.0, min(up, down)) * 2 / (high - low) * power[:, k]
    level = 10 * np.log10(np.maximum(level, 1e-10))
    level = np.maximum(level, level.max() - depth)
    rise = np.maximum(np.diff(level, axis=0), 0).mean(1)
    return np.concatenate((np.zeros(1 + size // (2 * hop)), rise))[: len(frames)]


@pytest.mark.parametrize("hop, size, together", [(16, None, 64), (16, None, 3), (8, 32, 5), (64, 64, 4)])
def test_onset_strength(spark, hop, size, together):
    rng = np.random.default_rng(6)
    waves = {n: np.sin(np.arange(n) ** 1.3 / 9) * (rng.random(n) < 0.7) for n in (1, 15, 16, 17, 160, 161, 1000)}
    waves[300] = np.zeros(300)
    df = spark.createDataFrame([(n, i, float(v)) for n, w in waves.items() for i, v in enumerate(w)], "track long, i long, y double").repartition(3)
    got = {}
    for r in audio.onset_envelope(df, ["track"], hop=hop, bands=6, rate=4000.0, size=size, together=together).orderBy("frame").collect():
        got.setdefault(r["track"], []).append((r["frame"], r["onset_env"]))
    assert set(got) == set(waves)
    for n, rows in got.items():
        assert [f for f, _ in rows] == list(range(n // hop + 1))
        np.testing.assert_allclose([v for _, v in rows], plain_onset(waves[n], hop, size or 2 * hop, 6, 4000.0), atol=1e-7)
    rms = audio.framewise_rms(df, ["track"], hop=hop).groupBy("track").count().collect()
    assert {r["track"]: r["count"] for r in rms} == {n: n // hop + 1 for n in waves}


def test_onset_of_the_query_equals_the_plain_version(spark):
    sf = "/root/testdata/sf0.001"
    waves, got = {}, {}
    for r in standins.lines(spark, sf).orderBy("track", "frame").collect():
        waves.setdefault(r["track"], []).append(r["l_quantity"])
    for r in signal_queries.w16_onset_envelope(spark, sf).orderBy("track", "frame").collect():
        got.setdefault(r["track"], []).append(r["onset_env"])
    assert set(got) == set(waves)
    for track, rows in got.items():
        np.testing.assert_allclose(rows, plain_onset(np.array(waves[track], float), 16, 32, 4, 3000.0), atol=1e-3)
    assert max(map(max, got.values())) > 0.1
