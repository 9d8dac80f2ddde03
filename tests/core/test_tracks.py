"""Clustering and tracks against plain loops, on made rows and on the queries' own tables."""

import math

import numpy as np
import pytest

from trackspark.operators import tracks
from trackspark.plans import pose_queries, standins

SF = "/root/testdata/sf0.01"


def plain_centers(rows, limits, share, frames=None):
    """rows: song -> [(frame, subj, x, y)]; every earlier centre is tried in turn."""
    out = {}
    for song, boxes in rows.items():
        found = []
        for _, _, x, y in sorted(boxes):
            for c in found:
                if math.hypot(c[0] - x, c[1] - y) < limits[song]:
                    c[2] += 1
                    c[0] += (x - c[0]) / c[2]
                    c[1] += (y - c[1]) / c[2]
                    break
            else:
                found.append([x, y, 1])
        least = share * (frames[song] if frames else len({b[0] for b in boxes}))
        out[song] = [(i, *c) for i, c in enumerate(found) if c[2] > least]
    return out


def collected(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["song"], []).append((r["center"], r["x"], r["y"], r["count"]))
    return {k: sorted(v) for k, v in out.items()}


def close(got, want):
    assert {k for k, v in want.items() if v} == set(got)
    for song, rows in got.items():
        np.testing.assert_allclose(np.array(rows, float), np.array(want[song], float), atol=1e-9)


def boxes_of(df):
    rows = {}
    for r in tracks.with_centers(df).collect():
        rows.setdefault(r["song"], []).append((r["frame"], r["subj"], r["cx"], r["cy"]))
    return rows


@pytest.fixture(scope="module")
def detections(spark):
    return standins.detections(spark, SF).cache()


def test_centers_of_the_query_equal_a_plain_loop(spark, detections):
    limits = tracks.adaptive_thresholds(detections, ["song"])
    radius = {r["song"]: r["radius"] for r in limits.collect()}
    for share in (0.02, 0.0):
        close(collected(tracks.cluster_centers(detections, limits, ["song"], share)), plain_centers(boxes_of(detections), radius, share))


def test_frames_without_boxes_count(spark):
    rows = [("a", f, 0, 100.0 * (f % 2), 0.0) for f in range(0, 10)] + [("b", f, s, 300.0 * s, -40.0) for f in range(5) for s in (1, 0)] + [("b", 3, 2, None, 1.0), ("b", 3, 3, math.nan, 1.0)]
    df = spark.createDataFrame([(k, f, s, x, y, x, y) for k, f, s, x, y in rows], "song string, frame long, subj long, x0 double, y0 double, x1 double, y1 double")
    limits = spark.createDataFrame([("a", 30.0), ("b", 30.0)], "song string, radius double")
    frames = spark.createDataFrame([("a", f) for f in range(10)] + [("b", f) for f in range(8)], "song string, frame long")
    got = lambda share, frames=None: {k: [c[3] for c in v] for k, v in collected(tracks.cluster_centers(df, limits, ["song"], share, frames)).items()}
    assert got(0.49) == {"a": [5, 5], "b": [5, 5]} and got(0.66) == {"b": [5, 5]}
    assert got(0.66, frames) == {} and got(0.6, frames) == {"b": [5, 5]}
    assert tracks.cluster_centers(df.limit(0), limits, ["song"]).collect() == []


def test_a_song_goes_through_in_batches_and_many_centres_are_found_fast(spark):
    rng = np.random.default_rng(4)
    points = [(7, f, s, float(x), float(y)) for f in range(4000) for s, (x, y) in enumerate(rng.uniform(-20_000, 20_000, (5, 2)))]
    df = spark.createDataFrame([(k, f, s, x, y, x, y) for k, f, s, x, y in points], "song long, frame long, subj long, x0 double, y0 double, x1 double, y1 double")
    limits = spark.createDataFrame([(7, 400.0)], "song long, radius double")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 777)
    try:
        got = collected(tracks.cluster_centers(df, limits, ["song"], 0.0))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    close(got, plain_centers({7: [p[1:] for p in points]}, {7: 400.0}, 0.0))
    assert len(got[7]) > 2000


def test_tracks_of_the_query_equal_a_plain_loop(spark):
    """t5 on its own table: thresholds, centres, outliers, performers and the nearest box of every frame."""
    got = {(r["song"], r["instrument"], r["frame"]): (r["x0"], r["y0"]) for r in pose_queries.t5_build_tracks(spark, SF).collect()}
    boxes, records, frames = pose_queries.steady_boxes(spark, SF)
    layout = {r["song"]: r["layout"] for r in records.collect() if not r["moving_camera"]}
    all_frames = {}
    for r in frames.collect():
        all_frames.setdefault(r["song"], set()).add(r["frame"])
    rows = {}
    for r in boxes.collect():
        rows.setdefault(r["song"], []).append(r)
    want = {}
    for song, names in layout.items():
        mine = rows[song]
        xs, ys = [v for r in mine for v in (r["x0"], r["x1"])], [v for r in mine for v in (r["y0"], r["y1"])]
        radius = max(50.0, min(200.0, (max(xs + ys) - min(xs + ys)) * 0.08))
        height = max(100.0, min(300.0, (max(r["y1"] for r in mine) - min(r["y0"] for r in mine)) * 0.15))
        points = [(r["frame"], r["subj"], (r["x0"] + r["x1"]) / 2, (r["y0"] + r["y1"]) / 2) for r in mine]
        centers = [c[1:3] for c in plain_centers({song: points}, {song: radius}, 0.66, {song: len(all_frames[song])})[song]]
        if len(centers) > 1:
            y = np.array([c[1] for c in centers])
            limit = min(height, max(50.0, 1.5 * y.std()))
            centers = [c for c in centers if not (c[1] < np.median(y) - limit or c[1] < np.percentile(y, 75) - 0.8 * limit)]
        chosen = sorted(sorted(centers, key=lambda c: (-c[1], c[0]))[: len(names)])
        for instrument in names[: len(chosen)]:
            want |= {(song, instrument, f): (None, None) for f in all_frames[song]}
        for r in sorted(mine, key=lambda r: r["subj"]):
            x, y = (r["x0"] + r["x1"]) / 2, (r["y0"] + r["y1"]) / 2
            far = [math.hypot(x - a, y - b) for a, b in chosen]
            k = int(np.argmin(far)) if far else None
            if k is not None and far[k] < radius:
                want[song, names[k], r["frame"]] = (r["x0"], r["y0"])
    assert len(got) == len(want) > 1000 and set(got) == set(want)
    assert any(v == (None, None) for v in want.values())
    for key, value in want.items():
        assert got[key] == pytest.approx(value) if value[0] is not None else got[key] == (None, None)


def test_rounds_carry_the_centres_on(spark, detections):
    """Clustering in many rounds of few boxes gives what a plain loop over whole songs gives, with all frames counted too."""
    frames = spark.range(400).selectExpr("id * 1000 as frame").crossJoin(spark.range(5).selectExpr("cast(id as int) as song"))
    limits = tracks.adaptive_thresholds(detections, ["song"])
    radius = {r["song"]: r["radius"] for r in limits.collect()}
    boxes = detections.cache()
    rounds = tracks.in_rounds(tracks.with_centers(boxes), ["song"], 500)
    assert len(rounds) > 4 and sum(r.count() for r in rounds) == boxes.count()
    close(collected(tracks.cluster_centers(boxes, limits, ["song"], 0.02, size=500)), plain_centers(boxes_of(boxes), radius, 0.02))
    every = {s: 400 for s in radius}
    close(collected(tracks.cluster_centers(boxes, limits, ["song"], 0.5, frames, 500)), plain_centers(boxes_of(boxes), radius, 0.5, every))


def test_long_songs_meet_their_few_rows_in_shares(spark):
    rows = spark.range(10000).selectExpr("id % 2 as song", "id as frame")
    found = tracks.with_song(rows, spark.createDataFrame([(0, "a"), (0, "b"), (1, "c")], "song long, name string").hint("merge"), ["song"])
    assert found.groupBy("song", "name").count().count() == 3 and found.count() == 15000
    assert "__share" in found._jdf.queryExecution().executedPlan().toString()


def test_chunks_of_boxes_give_what_single_ones_do():
    """Leaders.add_all() has the very centres of add(), box by box, with few centres, many, and centres that wander."""
    rng = np.random.default_rng(6)
    n = 30_000
    places = {
        80.8: (rng.integers(1, 51, n) * 20.0, rng.integers(0, 11, n) * 50.000000001),
        100.0: (rng.choice([0.0, 100.0, 200.0], n), rng.choice([0.0, 100.0], n)),
        60.0: (np.linspace(0, 3000, n) + rng.normal(0, 30, n), rng.normal(0, 20, n)),
        400.0: (rng.uniform(-9000, 9000, n), rng.uniform(-9000, 9000, n)),
    }
    for limit, (x, y) in places.items():
        one, all_ = tracks.Leaders(limit), tracks.Leaders(limit)
        for point in zip(x.tolist(), y.tolist()):
            one.add(*point)
        for at in range(0, n, 7000):
            all_.add_all(x[at : at + 7000], y[at : at + 7000])
        assert all_.found == one.found


def test_boxes_of_a_song_go_to_python_flat(spark, detections):
    """Nested columns of a batch cost time with its square, and the last round isn't clustered again for each reader."""
    found = tracks.cluster_centers(detections, tracks.adaptive_thresholds(detections, ["song"]), ["song"], 0.02)
    assert "MapInArrow" not in found._jdf.queryExecution().executedPlan().toString()
