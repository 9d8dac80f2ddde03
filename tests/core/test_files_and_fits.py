"""Keypoint files by ranges of frames, components far from 0, registration against quaternions, lags against plain sums."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from trackspark.operators import correlate, loadings, pose, timeaxis
from trackspark.plans import pose_queries, standins, workloads
from trackspark.sources import files
from trackspark.sources.arrays import Reader


def test_a_long_file_is_read_by_several_tasks(spark, tmp_path):
    folder = tmp_path / "A" / "long"
    folder.mkdir(parents=True)
    data = np.lib.format.open_memmap(folder / "vn.npy", "w+", np.float32, (10**6, 2, 2))
    data[:] = (np.arange(10**6, dtype=np.float32)[:, None, None] + np.array([[0, 0.25], [0.5, 0.75]], np.float32))
    data.flush()
    rows = files.read_keypoint_arrays(spark, str(tmp_path), part_bytes=2 << 20)
    assert rows.rdd.getNumPartitions() == 8
    total = rows.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.sum((F.col("kp")[1][1] == F.col("frame") + 0.75).cast("int")).alias("good")).collect()
    assert len(total) == 8 and sum(r["n"] for r in total) == sum(r["good"] for r in total) == 10**6 and max(r["n"] for r in total) <= 131_072


def test_files_come_back_as_written_and_odd_ones_are_refused(spark, tmp_path):
    rng = np.random.default_rng(7)
    kp = {(a, s): rng.normal(size=(n, 3, 2)) for a, s, n in (("A", "s", 1), ("A", "t", 2500), ("B", "s", 40))}
    rows = [(a, s, "vn", f, p.tolist()) for (a, s), track in kp.items() for f, p in enumerate(track)]
    df = spark.createDataFrame(rows, "artist string, song string, instrument string, frame int, kp array<array<double>>").repartition(5)
    for root in (str(tmp_path / "plain"), f"file://{tmp_path}/uri"):
        assert files.write_keypoint_arrays(df, ["artist", "song", "instrument"], root) == 3
        got = files.read_keypoint_arrays(spark, root, part_bytes=4000).orderBy("artist", "song", "frame").collect()
        assert [(r["artist"], r["song"], r["instrument"], r["frame"]) for r in got] == [(a, s, "vn", f) for (a, s), t in sorted(kp.items()) for f in range(len(t))]
        np.testing.assert_array_equal(np.array([r["kp"] for r in got]), np.concatenate([kp[k] for k in sorted(kp)]))
    np.testing.assert_array_equal(np.load(tmp_path / "plain" / "B" / "s" / "vn.npy"), kp["B", "s"])
    for name, array in (("objects", np.array([None, 1], object)), ("flat", np.zeros((3, 2))), ("columns", np.asfortranarray(np.zeros((3, 2, 2))))):
        (tmp_path / name / "A" / "s").mkdir(parents=True)
        np.save(tmp_path / name / "A" / "s" / "vn.npy", array, allow_pickle=True)
        with pytest.raises(PySparkException, match="array of numbers"):
            files.read_keypoint_arrays(spark, str(tmp_path / name)).collect()
    (tmp_path / "none").mkdir()
    assert files.read_keypoint_arrays(spark, str(tmp_path / "none")).collect() == []


def test_headers_of_every_version(tmp_path):
    for version in ((1, 0), (2, 0)):
        path = tmp_path / f"v{version[0]}" / "a" / "s"
        path.mkdir(parents=True)
        with open(path / "x.npy", "wb") as file:
            np.lib.format.write_array(file, np.arange(24, dtype=np.int16).reshape(4, 3, 2), version)
        reader = Reader(str(path.parents[1]), 24)
        parts = reader.partitions()
        assert [(p.first, p.end) for p in parts] == [(0, 2), (2, 4)]
        assert [b.to_pydict()["kp"] for p in parts for b in reader.read(p)] == np.arange(24.0).reshape(2, 2, 3, 2).tolist()


def test_components_keep_their_digits_far_from_zero(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(4000, 5)) @ np.diag([3, 2, 1, 0.5, 0.1]) + np.array([1e6, -1e6, 2e6, 0, 5e5])
    rows = [("a" if i % 4 else None, i, v) for i, v in enumerate(x.tolist())] + [("b", 0, [1.0] * 5), ("a", -1, [None] + [0.0] * 4)]
    df = spark.createDataFrame(rows, "track string, frame int, v array<double>").repartition(7)
    got = {r["track"]: r for r in loadings.co_moments(df, ["track"], "v").collect()}
    at = np.arange(4000) % 4 > 0
    for key, part in (("a", x[at]), (None, x[~at])):
        assert got[key]["n"] == len(part)
        np.testing.assert_allclose(got[key]["mean"], part.mean(0), rtol=1e-14)
        np.testing.assert_allclose(np.array(got[key]["co"]).reshape(5, 5) / (len(part) - 1), np.cov(part.T), rtol=1e-7, atol=1e-8)
    first = loadings.track_pca(df.filter("track = 'a'"), ["track"], "v", 5).orderBy("component").collect()
    values, vectors = np.linalg.eigh(np.cov(x[at].T))
    np.testing.assert_allclose([r["variance_ratio"] for r in first], values[::-1] / values.sum(), rtol=1e-6)
    np.testing.assert_allclose(np.abs([r["loadings"] for r in first]), np.abs(vectors.T[::-1]), atol=1e-5)


def quaternion_fit(a, b):
    """The turn that brings points a nearest to b, by the largest eigenvector of Horn's 4 x 4 matrix."""
    s = (a - a.mean(0)).T @ (b - b.mean(0))
    z = np.array([s[1, 2] - s[2, 1], s[2, 0] - s[0, 2], s[0, 1] - s[1, 0]])
    n = np.zeros((4, 4))
    n[0, 0], n[0, 1:], n[1:, 0], n[1:, 1:] = np.trace(s), z, z, s + s.T - np.trace(s) * np.eye(3)
    w, x, y, z = np.linalg.eigh(n)[1][:, -1]
    return np.array([
        [w * w + x * x - y * y - z * z, 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), w * w - x * x + y * y - z * z, 2 * (y * z - w * x)],
        [2 * (x * z - w * y), 2 * (y * z + w * x), w * w - x * x - y * y + z * z],
    ])


def test_registration_takes_few_frames_at_once(spark, monkeypatch):
    """A batch of 5,000 frames is fitted in parts, and their rows stay in order."""
    rng = np.random.default_rng(3)
    goal, seen, fit = rng.normal(size=(8, 3)), [], pose.rigid_fit
    monkeypatch.setattr(pose, "rigid_fit", lambda data, *rest: seen.append(len(data)) or fit(data, *rest))
    df = spark.createDataFrame([(1, [(0.0, 1.0, 2.0)] * 8)], "id long, pts array<struct<x: double, y: double, z: double>>")
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema: run, raising=False)
    run = pose.register_to_template(df, ["id"], goal.tolist(), 8)
    monkeypatch.undo()
    clouds = [[{"x": float(k), "y": 1.0 * (k % 7), "z": None if k == 4000 else float(i * i)} for i in range(8)] for k in range(5000)]
    monkeypatch.setattr(pose, "rigid_fit", lambda data, *rest: seen.append(len(data)) or data + 1)
    out = list(run(iter([pa.RecordBatch.from_pylist([{"id": k, "pts": c} for k, c in enumerate(clouds)])])))
    assert max(seen) <= 1024 and sum(seen) == 5000
    rows = [r for b in out for r in b.to_pylist()]
    assert [r["id"] for r in rows] == list(range(5000)) and [r["pts"][3]["x"] for r in rows] == [k + 1.0 for k in range(5000)]


def test_registration_equals_the_quaternion_solution(spark):
    rng = np.random.default_rng(9)
    goal = rng.normal(size=(12, 3))
    clouds = [rng.normal(size=(12, 3)) * 4 + 7 for _ in range(20)]
    clouds += [goal * np.array([1, 1, -1]) + 3, -goal]  # mirrored: a turn may not mirror them back
    clouds += [goal @ quaternion_fit(rng.normal(size=(5, 3)), rng.normal(size=(5, 3))).T * 1.0 + k for k in range(6)]
    flat = rng.normal(size=(12, 3))
    flat[:, 2] = 0
    clouds.append(flat)  # in a plane
    rows = [(i, [tuple(p) for p in c.tolist()]) for i, c in enumerate(clouds)] + [(99, [(math.nan, 1.0, 1.0)] + [(0.0, 0.0, 0.0)] * 11)]
    df = spark.createDataFrame(rows, "id long, pts array<struct<x: double, y: double, z: double>>")
    got = {r["id"]: np.array([(p["x"], p["y"]) for p in r["pts"]]) for r in pose.register_to_template(df, ["id"], goal.tolist(), fit=10).collect()}
    for i, c in enumerate(clouds):
        turn = quaternion_fit(c[:10], goal[:10])
        want = (c - c[:10].mean(0)) @ turn.T + goal[:10].mean(0)
        np.testing.assert_allclose(got[i], want[:, :2], atol=1e-8)
    np.testing.assert_allclose(got[24], goal[:, :2], atol=1e-8)  # a moved goal comes back
    assert np.isnan(got[99]).all()
    line = spark.createDataFrame([(0, [(float(k), 2.0 * k, -1.0 * k) for k in range(12)]), (1, [(5.0, 5.0, 5.0)] * 12)], "id long, pts array<struct<x: double, y: double, z: double>>")
    for r in pose.register_to_template(line, ["id"], goal.tolist(), fit=10).collect():  # many turns are as good: distances stay
        there = np.array([(p["x"], p["y"]) for p in r["pts"]])
        assert np.isfinite(there).all() and np.linalg.norm(np.diff(there, axis=0), axis=1).max() <= math.sqrt(6) + 1e-9


def test_lags_equal_plain_sums(spark):
    rng = np.random.default_rng(10)
    x, y = rng.normal(size=(2, 95))
    y[5:] += x[:-5]
    x[70], x[40:60] = math.nan, 2.0  # a window with a gap, and one that doesn't vary
    df = spark.createDataFrame([("a", i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "track string, frame long, x double, y double")
    got = {(r["window"], r["lag"]): r["c"] for r in correlate.cross_corr_windows(df, ["track"], win=20, max_lag=19).collect()}
    assert {w for w, _ in got} == {0, 1} and len(got) == 2 * 39
    for w in (0, 1):
        a, b = ((v[20 * w : 20 * w + 20] - v[20 * w : 20 * w + 20].mean()) / v[20 * w : 20 * w + 20].std() for v in (x, y))
        for lag in range(-19, 20):
            assert got[w, lag] == pytest.approx(sum(a[n + lag] * b[n] for n in range(20) if 0 <= n + lag < 20), abs=1e-9)


def test_lag_study_equals_numpy(spark):
    """Gaps dropped first, then both sides brought to 30 frames a second, then windows and their profile."""
    rng = np.random.default_rng(11)
    rows, all_lags = [], []
    for track, fps in (("p", 25.0), ("q", 30.0), ("r", 50.0), ("s", None)):
        x, y = rng.normal(size=(2, 130))
        x[rng.random(130) < 0.2] = math.nan
        rows += [("v", track, "m-a", i, float(a), float(b), fps) for i, (a, b) in enumerate(zip(x, y))]
        if fps is None:
            continue
        a, b = x[~np.isnan(x)], y[~np.isnan(x)]
        if fps != 30:
            n = len(a)
            m = int(n / fps * 30)
            at = np.arange(m) * (n / m)
            k = np.clip(np.floor(at).astype(int), 0, n - 2)
            a, b = (v[k] + (v[k + 1] - v[k]) * (at - k) for v in (a, b))
        for w in range(len(a) // 30):
            p, q = ((v[30 * w : 30 * w + 30] - v[30 * w : 30 * w + 30].mean()) / v[30 * w : 30 * w + 30].std() for v in (a, b))
            full = np.correlate(p, q, "full")
            all_lags.append(full[29 - 8 : 29 + 9])
    df = spark.createDataFrame(rows, "grp string, track string, pair string, frame long, x double, y double, fps double")
    got = workloads.lag_study(df, "grp", ["track"], "pair", win=30, max_lag=8).filter("grp is null").orderBy("lag").collect()
    assert [r["lag"] for r in got] == list(range(-8, 9)) and {r["windows"] for r in got} == {len(all_lags)}
    np.testing.assert_allclose([r["mean_c"] for r in got], np.mean(all_lags, axis=0), atol=1e-9)
    np.testing.assert_allclose([r["std_c"] for r in got], np.std(all_lags, axis=0), atol=1e-9)


def test_tracks_without_audio_are_left_out(spark):
    specific = spark.createDataFrame([("a", "wrist", 0, 1.0), ("b", "wrist", 0, 2.0)], "track string, feature string, frame int, value double")
    audio = spark.createDataFrame([("b", 0)], "track string, frame int")
    got = correlate.merge_feature_sets(specific, specific, audio, ["track"]).collect()
    assert {(r["track"], r["feature"]) for r in got} == {("b", "instrument::wrist"), ("b", "general::wrist")}
    assert [r["track"] for r in correlate.merge_feature_sets(specific, specific, audio, ["track"], "generic").collect()] == ["b"]


def test_rates(spark):
    df = spark.createDataFrame([(k, i, float(i), float(-i), f) for k, f in (("a", 30.0), ("b", 60.0), ("c", None)) for i in range(29)], "k string, frame long, x double, y double, fps double")
    got = {}
    for r in timeaxis.resample_rate(df, ["k"], "fps", value=["x", "y"]).orderBy("frame").collect():
        got.setdefault(r["k"], []).append((r["x"], r["y"]))
    assert got["a"] == [(float(i), float(-i)) for i in range(29)] and len(got["b"]) == 14 and set(got) == {"a", "b"}
    assert all(x == -y for x, y in got["b"])


SF = "/root/testdata/sf0.01"


def test_components_of_the_query_equal_numpy(spark):
    vectors, got, top = {}, {}, {}
    for r in pose_queries.motion(spark, SF).collect():
        vectors.setdefault(r["track"], []).append(r["v"])
    for r in pose_queries.a10_track_pca(spark, SF).collect():
        got.setdefault((r["track"], r["component"]), {})[r["i"]] = (r["variance_ratio"], r["loading"])
    for r in pose_queries.a11_pca_contribution(spark, SF).collect():
        top.setdefault(r["track"], {})[r["rank"]] = (r["kp"], r["contribution"])
    for track, rows in vectors.items():
        x = np.array(rows, float)
        values, columns = np.linalg.eigh(np.cov(x[~np.isnan(x).any(1)].T))
        for c in (1, 2, 3):
            ratio, loading = zip(*(got[track, c][i] for i in range(64)))
            assert ratio[0] == pytest.approx(values[-c] / values.sum(), abs=1e-5)
            want = columns[:, -c] * np.sign(columns[np.abs(columns[:, -c]).argmax(), -c])
            np.testing.assert_allclose(loading, want, atol=1e-3)
        share = np.abs(columns[:32, -1] + columns[32:, -1])
        order = sorted(range(32), key=lambda k: -share[k])[:5]
        assert [top[track][r][0] for r in range(1, 6)] == order
        np.testing.assert_allclose([top[track][r][1] for r in range(1, 6)], share[order], atol=1e-3)


def test_registration_of_the_query_equals_quaternions(spark):
    goal = np.array([[k % 5 / 5, k % 7 / 7, k % 3 / 3] for k in range(32)])
    got = {}
    for r in pose_queries.g3_register_to_template(spark, SF).collect():
        got.setdefault((r["track"], r["frame"]), {})[r["kp"]] = (r["x"], r["y"])
    rows = standins.frames(spark, SF).collect()
    assert len(got) == len(rows)
    for r in rows:
        points = np.array([(p["x"], p["y"], p["x"] * p["y"]) for p in r["kp"]])
        moved = (points - points[:20].mean(0)) @ quaternion_fit(points[:20], goal[:20]).T + goal[:20].mean(0)
        np.testing.assert_allclose([got[r["track"], r["frame"]][k] for k in range(32)], moved[:, :2], atol=1e-3)
