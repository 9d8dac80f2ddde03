"""Poses, tracks, samples, summaries and files on small hand-made inputs."""

import io
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackspark.functions import names
from trackspark.operators import audio, loadings, pose, quality, saliency, select, summary, tracks
from trackspark.plans import model_queries
from trackspark.sources import files
from trackspark.streaming.counts import stream_chunk_counts

POINTS = "array<struct<x:double,y:double>>"


def frame(*xy):
    return [{"x": float(x), "y": float(y)} for x, y in xy]


def test_normalize_frame(spark):
    df = spark.createDataFrame([(0, frame((0, 0), (4, 0), (2, 3))), (1, frame((1, 1), (math.nan, 2), (0, 0)))], f"frame int, kp {POINTS}")
    got = {r["frame"]: r["kp"] for r in pose.normalize_frame(df).collect()}
    p = np.array([(0, 0), (4, 0), (2, 3)], float) - (2, 1)
    np.testing.assert_allclose([(q["x"], q["y"]) for q in got[0]], p / (np.hypot(*p.T).max() + 1e-8))
    assert all(math.isnan(q["x"]) and math.isnan(q["y"]) for q in got[1])


def test_geometry(spark):
    ring = [(math.cos(a), math.sin(a)) for a in np.linspace(0, 2 * math.pi, 20, endpoint=False)]
    pts = frame(*([(0, 0)] * 8 + [(3, 4)] + [(0, 0)] * 39 + ring))
    row = pose.face_features(spark.createDataFrame([(0, pts)], f"frame int, pts {POINTS}"), ["frame"]).first()
    assert row["mouth_area"] == pytest.approx(10 * math.sin(2 * math.pi / 20)) and row["jaw_to_nose"] == 5
    arm = [frame(*([(9, 9)] * 6), (0, 1), (9, 9), (0, 0), (9, 9), (1 + t, 0)) for t in range(3)]
    rows = spark.createDataFrame([("a", t, kp) for t, kp in enumerate(arm)], f"track string, frame int, kp {POINTS}")
    got = pose.bow_arm_features(rows, ["track"], fps=10).orderBy("frame").collect()
    assert [r["elbow_angle"] for r in got] == pytest.approx([90] * 3) and [r["wrist_speed"] for r in got] == pytest.approx([10] * 3)
    assert got[2]["arm_extension"] == pytest.approx(math.hypot(3, 1))


def test_registration_undoes_a_turn():
    rng = np.random.default_rng(0)
    template = rng.normal(size=(12, 3))
    turn = np.linalg.qr(rng.normal(size=(3, 3)))[0]
    turn *= np.sign(np.linalg.det(turn))
    moved = np.stack([template @ turn + 5, np.full((12, 3), np.nan)])
    got = pose.rigid_fit(moved, template, 8)
    np.testing.assert_allclose(got[0], template, atol=1e-9)
    assert np.isnan(got[1]).all()


def test_regions_shuffles_and_names(spark):
    chunk = spark.createDataFrame([(0, [1.0] * 68)], "chunk int, points array<double>")
    assert sum(pose.mask_region(chunk, "mouth").first()["points"]) == 48 and sum(pose.mask_region(chunk, "body").first()["points"]) == 0
    rows = spark.createDataFrame([(c, f, k, f * 10 + k) for c in range(2) for f in range(6) for k in range(3)], "chunk int, frame int, kp int, v int")
    got = pose.shuffle_time(rows, ["chunk"], seed=4)
    assert got.select("chunk", "frame", "kp").distinct().count() == 36
    moved = got.groupBy("chunk", "frame").agg(F.countDistinct(F.floor(F.col("v") / 10)).alias("n")).agg(F.max("n")).first()[0]
    assert moved == 1 and got.filter("frame <> floor(v / 10)").count() > 0
    assert pose.part_dim(spark).filter("part = 'face'").count() == 68


def test_songs(spark):
    rows = [("a", "1", ["vn", "vc"], None, True, []), ("a", "2", ["vc", "vn"], True, True, []), ("a", "3", ["vn", None], False, True, []), ("b", "1", None, False, None, []), ("b", "2", ["vn"], False, None, [[1, 2]])]
    songs = spark.createDataFrame(rows, "artist string, song string, layout array<string>, moving_camera boolean, correct_body_detection boolean, face_false_positive_frames array<array<int>>")
    keys = lambda df: sorted((r["artist"], r["song"]) for r in df.collect())
    assert keys(select.select_songs(songs)) == [("a", "1"), ("a", "2"), ("b", "2")]
    assert keys(select.select_songs(songs, layout=["vn", "vc"])) == [("a", "1")]
    assert keys(select.select_songs(songs, layout_set=["vc", "vn"], drop_moving=True)) == [("a", "1")]
    assert keys(select.select_songs(songs, require_body=True, drop_face_fp=True)) == [("a", "1"), ("a", "2")]
    assert keys(select.exclude_songs(songs, [("a", "1")])) == [("a", "2"), ("a", "3"), ("b", "1"), ("b", "2")]
    one = songs.filter("song = '2' and artist = 'b'").withColumn("instrument", F.lit("vn"))
    assert sorted(r["part"] for r in select.occluded_parts(one).collect()) == ["left_arm", "left_hand"]
    assert quality.static_camera_ratio(songs).first()[0] == 0.8


def test_tracks_follow_performers(spark):
    rng = np.random.default_rng(1)
    rows = []
    for f in range(30):
        for subj, (x, y) in enumerate([(600, 500), (200, 510), (900, 490)]):
            if (f, subj) != (7, 1):
                cx, cy = x + rng.normal(), y + rng.normal()
                rows.append(("s", f, subj, cx - 50, cy - 80, cx + 50, cy + 80))
        if f % 5 == 0:
            rows.append(("s", f, 9, 0.0, 0.0, 10.0, 10.0))
    boxes = spark.createDataFrame([tuple(map(lambda v: float(v) if isinstance(v, np.floating) else v, r)) for r in rows], "song string, frame long, subj long, x0 double, y0 double, x1 double, y1 double")
    songs = spark.createDataFrame([("s", ["vn", "va", "vc"], None), ("moving", ["vn"], True)], "song string, layout array<string>, moving_camera boolean")
    got = tracks.build_tracks(boxes, songs, ["song"], ["x0"]).collect()
    assert len(got) == 90 and sum(r["x0"] is None for r in got) == 1
    mean = {n: np.mean([r["x0"] for r in got if r["instrument"] == n and r["x0"] is not None]) for n in ("vn", "va", "vc")}
    assert mean["vn"] == pytest.approx(150, abs=2) and mean["va"] == pytest.approx(550, abs=2) and mean["vc"] == pytest.approx(850, abs=2)
    limits = tracks.adaptive_thresholds(boxes.limit(0), ["song"], songs).collect()
    assert {(r["radius"], r["height"]) for r in limits} == {(100.0, 150.0)}


def test_samples(spark):
    x = np.sin(np.arange(100) / 3)
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "track string, i long, y double")
    got = [r["rms"] for r in audio.framewise_rms(df, ["track"], hop=16).orderBy("frame").collect()]
    wide = np.concatenate((np.zeros(16), x, np.zeros(32)))
    np.testing.assert_allclose(got, [math.sqrt((wide[k * 16 : k * 16 + 32] ** 2).mean()) for k in range(100 // 16 + 1)])
    onset = [r["onset_env"] for r in audio.onset_envelope(df, ["track"], hop=16, bands=4).orderBy("frame").collect()]
    assert len(onset) == 100 // 16 + 1 and onset[0] == onset[1] == 0 and min(onset) >= 0
    files_ = spark.createDataFrame([("a", c, 0, v) for c, v in (("1", 8.0), ("2", 4.0), ("3", 2.0))], "track string, channel string, i long, y double")
    assert audio.mix_channels(files_, ["track"]).first()["y"] == (((8 + 4) / 2) + 2) / 2
    noisy = spark.createDataFrame([(0, float(v + 0.1 * (-1) ** i), float(2 * v)) for i, v in enumerate(x)], "chunk int, est double, ref double")
    e, r = x + 0.1 * (-1.0) ** np.arange(100), 2 * x
    e, r = e - e.mean(), r - r.mean()
    a = (e @ r + 1e-8) / (r @ r + 1e-8)
    want = 10 * math.log10(((a * r) @ (a * r) + 1e-8) / ((e - a * r) @ (e - a * r) + 1e-8))
    assert audio.si_sdr(noisy, ["chunk"]).first()["si_sdr"] == pytest.approx(want)


def test_components(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 4)) @ np.diag([5, 2, 1, 0.5])
    rows = [("a", i, v) for i, v in enumerate(x.tolist())] + [("a", 99, [math.nan] * 4), ("b", 0, [1.0] * 4)]
    df = spark.createDataFrame(rows, "track string, frame int, v array<double>").repartition(4)
    got = loadings.track_pca(df, ["track"], "v", 3).orderBy("component").collect()
    values, vectors = np.linalg.eigh(np.cov(x.T))
    assert [r["track"] for r in got] == ["a"] * 3
    np.testing.assert_allclose([r["variance_ratio"] for r in got], values[::-1][:3] / values.sum())
    for r, v in zip(got, vectors.T[::-1]):
        np.testing.assert_allclose(np.abs(r["loadings"]), np.abs(v), atol=1e-8)
        assert max(r["loadings"], key=abs) > 0
    top = loadings.pca_contribution(loadings.track_pca(df, ["track"], "v", 1), ["track"], 1).collect()
    assert len(top) == 1 and top[0]["rank"] == 1


def test_summaries(spark):
    rows = [("a", 1, 2, 1.0, True), ("a", 2, 4, 3.0, True), ("b", 3, None, None, False)]
    df = spark.createDataFrame(rows, "artist string, song int, n_chunks int, m_mean double, ok boolean")
    got = {r["artist"]: r for r in summary.film_summary(df, "artist", ["m_mean"]).collect()}
    assert got["a"]["m_mean_weighted"] == pytest.approx((2 * 1 + 4 * 3) / 6) and got["a"]["m_mean_std"] == pytest.approx(math.sqrt(2))
    assert got["b"]["m_mean"] is None and got["b"]["m_mean_n"] == 0 and got[None]["songs"] == 3
    assert summary.numeric_columns(df) == ["song", "n_chunks", "m_mean"]
    parts = spark.createDataFrame([("arm", 0), ("arm", 1), ("body", 1)], "part string, kp int")
    values = spark.createDataFrame([(0, 0, 1.0), (0, 1, 3.0), (0, 2, math.nan)], "chunk int, kp int, saliency double")
    assert {r["part"]: r["saliency"] for r in saliency.to_parts(values, parts, ["chunk"]).collect()} == {"arm": 2.0, "body": 3.0}
    assert saliency.part_series(values, parts, ["chunk"]).first()["total"] == 7.0


def test_names(spark):
    df = spark.createDataFrame([("a/b c?.mp3", "x/Vocal_model.json"), (None, "plain"), ("é:1 ", "a_VIOLIN_vocal")], "n string, p string")
    got = df.select(names.safe_name(F.col("n")).alias("s"), names.safe_name(F.col("n"), "readable").alias("r"), names.model_tag(F.col("p")).alias("t")).collect()
    assert [r["s"] for r in got] == ["a_b_c_.mp3", None, "1"] and got[0]["r"] == "ab c.mp3" and [r["t"] for r in got] == ["vocal", "unknown", "violin"]


def test_files(spark, tmp_path):
    (tmp_path / "meta.json").write_text(json.dumps({"A": {"s": {"layout": ["vn", None], "fps": 25, "more": 1}}, "B": {"t": {}}}))
    got = {r["song"]: r for r in files.read_song_metadata(spark, str(tmp_path / "meta.json")).collect()}
    assert got["s"]["layout"] == ["vn", None] and got["t"]["fps"] is None
    folder = tmp_path / "kp" / "A" / "s"
    folder.mkdir(parents=True)
    data = np.arange(2100 * 6, dtype=np.float32).reshape(2100, 3, 2)
    buffer = io.BytesIO()
    np.save(buffer, data)
    (folder / "vn.npy").write_bytes(buffer.getvalue())
    rows = files.read_keypoint_arrays(spark, str(tmp_path / "kp"))
    assert rows.count() == 2100 and rows.filter("frame = 2099").first()["kp"] == data[2099].tolist()
    assert {(r["artist"], r["song"], r["instrument"]) for r in rows.select("artist", "song", "instrument").distinct().collect()} == {("A", "s", "vn")}
    features = tmp_path / "f" / "A" / "s"
    features.mkdir(parents=True)
    (features / "vn.json").write_text('{"arm": {"speed": [1.0, NaN]}}')
    got = files.read_feature_json(spark, str(tmp_path / "f"), "general").orderBy("frame").collect()
    assert got[0]["feature"] == "arm_speed" and got[0]["value"] == 1 and math.isnan(got[1]["value"])
    records = tmp_path / "r"
    records.mkdir()
    for name, text in {"one.json": '{"artist": "A", "song": "s", "m": 1.5}', "bad.json": "{", "none.json": '{"m": 2}', "aggregated_x.json": '{"artist": "A", "song": "all"}'}.items():
        (records / name).write_text(text)
    assert [tuple(r) for r in files.read_song_records(spark, str(records), "artist string, song string, m double").collect()] == [("A", "s", 1.5)]
    assert files.pending(spark.range(3), spark.range(1), ["id"]).count() == 2 and files.pending(spark.range(3), spark.range(1), ["id"], force=True).count() == 3


def test_stream_counts_match_the_batch(spark, tmp_path):
    events = spark.createDataFrame([("a", f"2024-01-01 00:00:{s:02d}") for s in (0, 1, 3, 4, 9)] + [("b", "2024-01-01 00:05:00")], "k string, t string").select("k", F.to_timestamp("t").alias("ts"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, ts timestamp").parquet(str(tmp_path / "in"))
    q = stream_chunk_counts(stream, ["k"]).writeStream.outputMode("append").format("memory").queryName("chunk_counts").trigger(availableNow=True).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["count"] for r in spark.table("chunk_counts").filter("k = 'a'").collect()) == [1, 1, 3]


def test_queries_of_many_tracks_write_no_file_for_each(spark, tmp_path, monkeypatch):
    """s3 and s5 on 150 tracks: the same rows, in no more files than tasks."""
    for number, run in enumerate((model_queries.s3_read_feature_json, model_queries.s5_read_song_records)):
        monkeypatch.setattr(model_queries.files, "scratch", lambda spark, n=number: str(tmp_path / str(n)))
        rows = run(spark, "/root/testdata/sf0.01")
        assert rows.select("song").distinct().count() == 150
        assert len(list((tmp_path / str(number)).rglob("part-*"))) <= 8


def test_feature_lines_are_read_as_files_are(spark, tmp_path):
    folder = tmp_path / "tree" / "A" / "s"
    folder.mkdir(parents=True)
    (folder / "violin.json").write_text('{"head": {"speed": [1.5, null, 2.0]}}')
    (tmp_path / "lines.txt").write_text('{"A": {"s": {"violin": {"head": {"speed": [1.5, null, 2.0]}}}}}\n')
    got = [sorted(map(tuple, files.read_feature_json(spark, str(p), "general", lines).collect()), key=str) for p, lines in ((tmp_path / "tree", False), (tmp_path / "lines.txt", True))]
    assert got[0] == got[1] and len(got[0]) == 3
    (tmp_path / "songs.txt").write_text('{"artist": "A", "song": "s", "m": 1.0}\n{"artist": "A", "so\n{"song": "t", "m": 2.0}\n')
    assert [tuple(r) for r in files.read_song_records(spark, str(tmp_path / "songs.txt"), "artist string, song string, m double", lines=True).collect()] == [("A", "s", 1.0)]
