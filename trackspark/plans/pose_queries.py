"""Queries on frames of points, detections and songs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names
from ..operators import loadings, pose, quality, select, timeaxis, tracks
from . import workloads
from .registry import query
from .signal_queries import FRAMES, savgol, slope
from .standins import DETECTIONS, POINTS, SONGS, detections, frames, out, q, songs, table

TRACK = ["track"]
PARTS = [("left", k) for k in range(12)] + [("right", k) for k in range(10, 32)]
PART_SQL = "parts AS (SELECT 'left' AS part, unnest(range(12)) AS kp UNION ALL SELECT 'right', unnest(range(10, 32)))"


def parts(spark):
    return spark.createDataFrame(PARTS, "part string, kp int")


def points(spark, sf_dir):
    rows = frames(spark, sf_dir)
    exploded = rows.select("track", "frame", "vec_id", F.posexplode_outer(F.arrays_zip("kp", "score")).alias("kp", "p")).filter("kp is not null")  # see explode_points
    return exploded.select("track", "frame", "vec_id", "kp", "p.kp.x", "p.kp.y", "p.score")


NORMAL = """normal AS (SELECT track, frame, kp, (x - avg(x) OVER f) / d * 1.0 AS x, (y - avg(y) OVER f) / d AS y, score FROM (
  SELECT *, max(sqrt((x - mx) ** 2 + (y - my) ** 2)) OVER (PARTITION BY track, frame) + 1e-8 AS d FROM (
  SELECT *, avg(x) OVER (PARTITION BY track, frame) AS mx, avg(y) OVER (PARTITION BY track, frame) AS my FROM points)) WINDOW f AS (PARTITION BY track, frame))"""


@query(f"WITH {POINTS}, {NORMAL} SELECT track, frame, kp, {q('x')} AS x, {q('y')} AS y FROM normal")
def w1_normalize_frame(spark, sf_dir):
    found = pose.explode_points(pose.normalize_frame(frames(spark, sf_dir)), ["track", "frame"])
    return found.select("track", "frame", "kp", out("x").alias("x"), out("y").alias("y"))


@query(f"""WITH {POINTS}, {PART_SQL}, a AS (SELECT track, frame, 'general' AS part, avg(score) AS score FROM points GROUP BY ALL
UNION ALL SELECT track, frame, part, avg(score) FROM points JOIN parts USING (kp) GROUP BY ALL) SELECT track, frame, part, {q('score')} AS score FROM a""")
def a1_part_means(spark, sf_dir):
    found = timeaxis.part_means(points(spark, sf_dir), ["track", "frame"], parts(spark), ["score"])
    return found.select("track", "frame", "part", out("score").alias("score"))


KP_FRAMES = FRAMES.replace("PARTITION BY track", "PARTITION BY track, kp")


@query(f"""WITH {POINTS}, {NORMAL}, {PART_SQL}, kept AS (SELECT * FROM normal WHERE kp NOT IN (3, 4)),
s AS (SELECT track, frame, kp, score, {savgol('x')} AS x, {savgol('y')} AS y FROM kept {KP_FRAMES}),
m AS (SELECT track, frame, kp, CASE WHEN score < 3 THEN 'nan'::DOUBLE ELSE x END AS x, CASE WHEN score < 3 THEN 'nan'::DOUBLE ELSE y END AS y FROM s),
v AS (SELECT track, frame, kp, {slope('x')} AS vx, {slope('y')} AS vy FROM m {KP_FRAMES}),
a AS (SELECT track, frame, kp, sqrt(vx * vx + vy * vy) AS s, {slope('vx')} AS ax, {slope('vy')} AS ay FROM v {KP_FRAMES}),
n AS (SELECT track, frame, kp, CASE WHEN NOT isnan(s) THEN s END AS s, CASE WHEN NOT isnan(ax + ay) THEN sqrt(ax * ax + ay * ay) END AS c FROM a),
r AS (SELECT track, frame, 'general' AS part, avg(s) AS s, avg(c) AS c FROM n GROUP BY ALL UNION ALL SELECT track, frame, part, avg(s), avg(c) FROM n JOIN parts USING (kp) GROUP BY ALL)
SELECT track, frame, part, {q('s', 5)} AS speed, {q('c', 4)} AS acceleration FROM r""")
def motion_features(spark, sf_dir):
    found = workloads.motion_features(frames(spark, sf_dir), TRACK, parts(spark), dropped=[3, 4])
    return found.select("track", "frame", "part", out("speed", 5).alias("speed"), out("acceleration", 4).alias("acceleration"))


@query(f"WITH {POINTS} SELECT track, frame, row_number() OVER (PARTITION BY track, frame ORDER BY kp) - 1 AS kp, {q('x')} AS x FROM points WHERE NOT (kp < 4 OR (track = 1 AND kp = 9))")
def p4_drop_keypoints(spark, sf_dir):
    rows = points(spark, sf_dir)
    gone = rows.select("track", "kp").distinct().filter("kp < 4 or (track = 1 and kp = 9)")
    found = pose.drop_keypoints(rows, gone, ["track", "frame"], TRACK)
    return found.select("track", "frame", F.col("kp").cast("long").alias("kp"), out("x").alias("x"))


@query(f"WITH {POINTS}, k AS (SELECT track, frame, list(x ORDER BY kp) AS xs FROM points WHERE kp <= 12 GROUP BY ALL) SELECT track, frame, len(xs) AS n, {q('xs[13]')} AS hip FROM k")
def p5_body_subset(spark, sf_dir):
    found = pose.body_subset(frames(spark, sf_dir))
    return found.select("track", "frame", F.size("kp").cast("long").alias("n"), out(F.element_at("kp", 13)["x"]).alias("hip"))


EDGES = [(0, 1), (1, 2), (5, 7), (7, 9)]


@query(f"""WITH {POINTS}, edges AS (SELECT unnest([0, 1, 5, 7]) AS a, unnest([1, 2, 7, 9]) AS b)
SELECT p.track, p.frame, e.a, e.b, {q('p.x')} AS x_a, {q('q.x')} AS x_b FROM edges e JOIN points p ON p.kp = e.a AND p.score > 3 JOIN points q ON q.kp = e.b AND q.score > 3 AND q.track = p.track AND q.frame = p.frame""")
def p9_visible_edges(spark, sf_dir):
    edges = spark.createDataFrame(EDGES, "a int, b int")
    found = pose.visible_edges(points(spark, sf_dir), edges, ["track", "frame"], 3.0)
    return found.select("track", "frame", "a", "b", out("x_a").alias("x_a"), out("x_b").alias("x_b"))


@query(f"WITH {POINTS} SELECT track, frame, {q('sum(CASE WHEN kp BETWEEN 27 AND 31 THEN 0 ELSE x END)', 5)} AS total FROM points GROUP BY ALL")
def p10_mask_region(spark, sf_dir):
    rows = frames(spark, sf_dir).withColumn("points", F.transform("kp", lambda p: p["x"]))
    found = pose.mask_region(rows, "nose")
    return found.select("track", "frame", out(F.aggregate("points", F.lit(0.0), lambda t, v: t + v), 5).alias("total"))


@query(f"WITH {POINTS} SELECT track, count(DISTINCT frame) AS frames, CAST(sum(frame) AS BIGINT) AS frame_sum, {q('sum(x)', 4)} AS x_sum FROM points WHERE kp = 0 GROUP BY ALL")
def p11_shuffle_time(spark, sf_dir):
    rows = points(spark, sf_dir).filter("kp = 0").select("track", "frame", "x")
    found = pose.shuffle_time(rows, TRACK, seed=3)
    return found.groupBy("track").agg(F.countDistinct("frame").alias("frames"), F.sum("frame").alias("frame_sum"), out(F.sum("x"), 4).alias("x_sum"))


@query(f"WITH {POINTS} SELECT DISTINCT kp, 'point' || CASE WHEN kp >= 13 THEN kp - 13 + 91 ELSE kp END AS name FROM points")
def p13_name_keypoints(spark, sf_dir):
    dim = spark.range(133).select(F.col("id").cast("int").alias("kp"), F.concat(F.lit("point"), "id").alias("name"))
    return pose.name_keypoints(points(spark, sf_dir).select("kp").distinct(), dim, "body55")


ARM = "arm AS (SELECT track, frame, " + ", ".join(f"max({a}) FILTER (kp = {k}) AS {n}{a}" for n, k in zip("sew", (6, 8, 10)) for a in "xy") + " FROM points GROUP BY ALL)"
DOT, NORMS = "(sx - ex) * (wx - ex) + (sy - ey) * (wy - ey)", "sqrt((sx - ex) ** 2 + (sy - ey) ** 2) * sqrt((wx - ex) ** 2 + (wy - ey) ** 2)"


@query(f"""WITH {POINTS}, {ARM}, v AS (SELECT *, {slope('wx')} AS vx, {slope('wy')} AS vy FROM arm {FRAMES})
SELECT track, frame, {q('sqrt(vx * vx + vy * vy)', 5)} AS wrist_speed, {q(f'degrees(acos(greatest(-1, least(1, ({DOT}) / ({NORMS})))))', 4)} AS elbow_angle,
{q('sqrt((sx - wx) ** 2 + (sy - wy) ** 2)')} AS arm_extension FROM v""")
def g1_bow_arm_features(spark, sf_dir):
    found = pose.bow_arm_features(frames(spark, sf_dir), TRACK)
    return found.withColumns({"wrist_speed": out("wrist_speed", 5), "elbow_angle": out("elbow_angle", 4), "arm_extension": out("arm_extension")})


@query(f"""WITH {POINTS}, ring AS (SELECT track, frame, x, y, coalesce(lead(x) OVER o, first_value(x) OVER o) AS nx, coalesce(lead(y) OVER o, first_value(y) OVER o) AS ny FROM points WHERE kp >= 20 WINDOW o AS (PARTITION BY track, frame ORDER BY kp)),
area AS (SELECT track, frame, abs(sum(x * ny - nx * y)) / 2 AS area FROM ring GROUP BY ALL),
jaw AS (SELECT track, frame, sqrt((max(x) FILTER (kp = 8) - max(x) FILTER (kp = 30)) ** 2 + (max(y) FILTER (kp = 8) - max(y) FILTER (kp = 30)) ** 2) AS d FROM points GROUP BY ALL)
SELECT track, frame, {q('area')} AS mouth_area, {q('d')} AS jaw_to_nose FROM area JOIN jaw USING (track, frame)""")
def g2_face_features(spark, sf_dir):
    found = pose.face_features(frames(spark, sf_dir), ["track", "frame"], "kp", (20, 32), (8, 30))
    return found.withColumns({"mouth_area": out("mouth_area"), "jaw_to_nose": out("jaw_to_nose")})


@query()
def g3_register_to_template(spark, sf_dir):
    rows = frames(spark, sf_dir).withColumn("pts", F.transform("kp", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), (p["x"] * p["y"]).alias("z"))))
    template = [[k % 5 / 5, k % 7 / 7, k % 3 / 3] for k in range(32)]
    found = pose.register_to_template(rows, ["track", "frame"], template, fit=20)
    return found.select("track", "frame", F.posexplode("pts").alias("kp", "p")).select("track", "frame", "kp", out("p.x", 4).alias("x"), out("p.y", 4).alias("y"))


@query("SELECT page_id, left(trim(regexp_replace(url, '[^A-Za-z0-9_.-]+', '_', 'g'), '_'), 100) AS strict, replace(replace(url, '/', '_'), ' ', '_') AS paths, rtrim(regexp_replace(url, '[^\\p{L}\\p{N} ._]', '', 'g')) AS readable FROM pages")
def g5_safe_name(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", names.safe_name(url).alias("strict"), names.safe_name(url, "paths").alias("paths"), names.safe_name(url, "readable").alias("readable"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'vocal' WHEN 1 THEN 'violin' ELSE 'unknown' END AS tag FROM part")
def g6_model_tag(spark, sf_dir):
    kind = F.when(F.col("p_partkey") % 3 == 0, "x_Vocal_violin").when(F.col("p_partkey") % 3 == 1, "VIOLIN_old").otherwise("plain")
    path = F.concat(F.lit("models/"), kind, F.lit("_"), F.regexp_replace("p_name", " ", "-"), F.lit(".json"))
    return table(spark, sf_dir, "part").select("p_partkey", names.model_tag(path).alias("tag"))


# --- songs


@query(f"WITH {SONGS} SELECT artist, song FROM songs WHERE list_contains(layout, 'F') AND len(layout) = 3 AND correct_body_detection AND NOT coalesce(moving_camera, false) AND NOT has_fp")
def p1_select_songs(spark, sf_dir):
    return select.select_songs(songs(spark, sf_dir), layout_set=["F", "O", "P"], require_body=True, drop_moving=True, drop_face_fp=True).select("artist", "song")


@query(f"WITH {SONGS} SELECT artist, song FROM songs WHERE song NOT IN ('Customer#000000003', 'Customer#000000005') OR artist NOT IN (SELECT artist FROM songs WHERE song IN ('Customer#000000003', 'Customer#000000005'))")
def p2_exclude_songs(spark, sf_dir):
    rows = songs(spark, sf_dir)
    deny = rows.filter("song in ('Customer#000000003', 'Customer#000000005')").select("artist", "song")
    return select.exclude_songs(rows, deny).select("artist", "song")


@query(f"""WITH {SONGS}, p AS (SELECT artist, song, layout, unnest(layout) AS instrument FROM songs WHERE layout IS NOT NULL),
s AS (SELECT *, CASE WHEN instrument = layout[1] THEN 'left' WHEN instrument = layout[-1] THEN 'right' END AS side FROM p)
SELECT artist, song, instrument, side || unnest(['_arm', '_hand']) AS part FROM s WHERE side IS NOT NULL""")
def p3_occluded_parts(spark, sf_dir):
    rows = songs(spark, sf_dir).filter("layout is not null").withColumn("instrument", F.explode("layout"))
    return select.occluded_parts(rows)


@query(f"WITH {SONGS} SELECT array_to_string(layout, ',') AS layout, count(*) AS songs FROM songs WHERE layout IS NOT NULL GROUP BY 1")
def a12_layout_counts(spark, sf_dir):
    return quality.layout_counts(songs(spark, sf_dir)).withColumn("layout", F.array_join("layout", ","))


@query(f"WITH {SONGS} SELECT fps, count(*) AS songs FROM songs GROUP BY 1")
def a12_fps_counts(spark, sf_dir):
    return quality.fps_counts(songs(spark, sf_dir))


@query(f"WITH {SONGS} SELECT {q('avg(CASE WHEN moving_camera THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END)')} AS static_ratio FROM songs")
def a13_static_camera_ratio(spark, sf_dir):
    return quality.static_camera_ratio(songs(spark, sf_dir)).select(out("static_ratio").alias("static_ratio"))


@query(f"WITH {SONGS} SELECT count(*) AS songs, {q('coalesce(sum(duration), 0) / 3600', 5)} AS hours FROM songs WHERE layout IN (['F', 'O', 'P'], ['F', 'O']) AND correct_body_detection AND NOT coalesce(moving_camera, false)")
def a14_eligible_hours(spark, sf_dir):
    return quality.eligible_hours(songs(spark, sf_dir), [["F", "O", "P"], ["F", "O"]]).withColumn("hours", out("hours", 5))


# --- scores


@query(f"WITH {POINTS}, f AS (SELECT track, frame, bool_and(score IS NULL) AS e, bool_or(score IS NULL) AS s FROM points GROUP BY ALL) SELECT {q('100.0::DOUBLE * count(*) FILTER (e) / count(*)')} AS all_nan_pct, {q('100.0::DOUBLE * count(*) FILTER (s) / count(*)')} AS any_nan_pct, count(*) AS frames FROM f")
def a15_nan_frame_ratio(spark, sf_dir):
    return quality.nan_frame_ratio(frames(spark, sf_dir)).withColumns({"all_nan_pct": out("all_nan_pct"), "any_nan_pct": out("any_nan_pct")})


@query(f"WITH {POINTS}, t AS (SELECT track, avg(score) AS m FROM points GROUP BY 1) SELECT track % 3 AS artist, {q('avg(m)')} AS confidence, count(m) AS tracks FROM t GROUP BY 1")
def a16_confidence(spark, sf_dir):
    rows = frames(spark, sf_dir).withColumn("artist", F.col("track") % 3)
    return quality.confidence_by(rows, ["artist", "track"], "artist").withColumn("confidence", out("confidence"))


@query(f"WITH {POINTS} SELECT track % 3 AS artist, {q('count(*) FILTER (score < 3) / count(*)::DOUBLE')} AS low_ratio FROM points GROUP BY 1")
def a17_low_confidence_pooled(spark, sf_dir):
    return quality.low_confidence_pooled(frames(spark, sf_dir).withColumn("artist", F.col("track") % 3), "artist").withColumn("low_ratio", out("low_ratio"))


@query(f"WITH {POINTS}, t AS (SELECT track, count(*) FILTER (score < 3) / count(*)::DOUBLE AS r FROM points GROUP BY 1) SELECT track % 2 AS instrument, {q('avg(r)')} AS low_ratio FROM t GROUP BY 1")
def a17_low_confidence_mean(spark, sf_dir):
    rows = frames(spark, sf_dir).withColumn("instrument", F.col("track") % 2)
    return quality.low_confidence_mean(rows, ["instrument", "track"], "instrument").withColumn("low_ratio", out("low_ratio"))


@query(f"WITH {POINTS}, f AS (SELECT track, frame, bool_and(score IS NULL) AS e FROM points WHERE kp IN (0, 7) GROUP BY ALL), t AS (SELECT track, 100.0::DOUBLE * count(*) FILTER (e) / count(*) AS p FROM f GROUP BY 1) SELECT {q('avg(p)')} AS mean_all_nan_pct, count(*) AS tracks FROM t")
def a18_track_nan_profile(spark, sf_dir):
    rows = frames(spark, sf_dir).withColumn("score", F.array(F.element_at("score", 1), F.element_at("score", 8)))
    return quality.track_nan_profile(rows, TRACK).withColumn("mean_all_nan_pct", out("mean_all_nan_pct"))


@query(f"WITH {POINTS}, t AS (SELECT track, kp, 100.0::DOUBLE * count(*) FILTER (score IS NULL) / count(*) AS p FROM points GROUP BY ALL) SELECT track, {q('avg(p)')} AS score_nan_pct FROM t GROUP BY 1")
def a18_feature_nan_profile(spark, sf_dir):
    return quality.feature_nan_profile(points(spark, sf_dir), ["track", "kp"], "track", ["score"]).withColumn("score_nan_pct", out("score_nan_pct"))


@query(f"""WITH {POINTS}, m AS (SELECT track, kp, avg(score) AS m FROM points WHERE NOT (track % 2 = 0 AND kp IN (5, 7, 9)) GROUP BY ALL)
SELECT track, {q('avg(m)')} AS mean, {q('min(m)')} AS low, {q('quantile_cont(m, 0.25)')} AS q25, {q('quantile_cont(m, 0.5)')} AS median, {q('quantile_cont(m, 0.75)')} AS q75, {q('max(m)')} AS high FROM m GROUP BY 1""")
def a19_score_profile(spark, sf_dir):
    rows = points(spark, sf_dir)
    hidden = rows.filter("track % 2 = 0 and kp in (5, 7, 9)").select("track", "kp").distinct()
    found = quality.score_profile(rows, "track", hidden)
    return found.select("track", *(out(c).alias(c) for c in ("mean", "low", "q25", "median", "q75", "high")))


@query("""WITH t AS (SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN 'vocal' ELSE 'violin' END AS instrument FROM customer),
r AS (SELECT 'motion' AS file, NULL AS i UNION ALL SELECT 'audio', NULL UNION ALL SELECT 'face', 'vocal')
SELECT c_custkey, instrument, file FROM t JOIN r ON i IS NULL OR i = instrument WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND ((o_orderstatus = 'F' AND file = 'motion') OR (o_orderstatus = 'O' AND file = 'audio') OR (o_orderstatus = 'P' AND file = 'face')))""")
def j6_missing_outputs(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_nationkey") % 2 == 0, "vocal").otherwise("violin").alias("instrument"))
    file = F.when(F.col("o_orderstatus") == "F", "motion").when(F.col("o_orderstatus") == "O", "audio").otherwise("face")
    files = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), file.alias("file")).distinct().join(rows, "c_custkey")
    required = spark.createDataFrame([("motion", None), ("audio", None), ("face", "vocal")], "file string, instrument string")
    return quality.missing_outputs(rows, files, required, ["c_custkey", "instrument"])


# --- detections

SONG = ["song"]
LIMITS = """limits AS (SELECT song, greatest(50, least(200, (greatest(max(x1), max(y1), max(x0), max(y0)) - least(min(x0), min(y0), min(x1), min(y1))) * 0.08))::DOUBLE AS radius,
  greatest(100, least(300, (max(y1) - min(y0)) * 0.15))::DOUBLE AS height FROM detections GROUP BY 1)"""


@query(f"WITH {DETECTIONS}, {LIMITS} SELECT song, {q('radius')} AS radius, {q('height')} AS height FROM limits")
def t1_adaptive_thresholds(spark, sf_dir):
    return tracks.adaptive_thresholds(detections(spark, sf_dir), SONG).withColumns({"radius": out("radius"), "height": out("height")})


@query()
def t2_cluster_centers(spark, sf_dir):
    rows = detections(spark, sf_dir)
    found = tracks.cluster_centers(rows, tracks.adaptive_thresholds(rows, SONG), SONG, share=0.02)
    return found.withColumns({"x": out("x", 4), "y": out("y", 4)})


CENTERS = """centers AS (SELECT s_nationkey AS song, s_suppkey AS center, s_acctbal AS x, (s_suppkey * 37 % 400)::DOUBLE AS y FROM supplier)"""


def centers(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier")
    return rows.select(F.col("s_nationkey").alias("song"), F.col("s_suppkey").alias("center"), F.col("s_acctbal").alias("x"), (F.col("s_suppkey") * 37 % 400).cast("double").alias("y"))


@query(f"""WITH {CENTERS}, s AS (SELECT song, quantile_cont(y, 0.5) AS m, quantile_cont(y, 0.75) AS h, least(150, greatest(50, 1.5 * stddev_pop(y))) AS t, count(*) AS n FROM centers GROUP BY 1)
SELECT song, center, {q('x')} AS x, {q('y')} AS y FROM centers JOIN s USING (song) WHERE n <= 1 OR NOT (y < m - t OR y < h - 0.8 * t)""")
def t3_drop_high_outliers(spark, sf_dir):
    rows = centers(spark, sf_dir)
    limits = rows.select("song").distinct().withColumn("height", F.lit(150.0))
    return tracks.drop_high_outliers(rows, limits, SONG).withColumns({"x": out("x"), "y": out("y")})


def layouts(rows):
    return rows.select("song").distinct().withColumn("layout", F.array(F.lit("violin"), F.lit("vocal"), F.lit("cello")))


PERFORMERS = """low AS (SELECT *, row_number() OVER (PARTITION BY song ORDER BY y DESC, x, center) AS r FROM centers),
performers AS (SELECT song, (['violin', 'vocal', 'cello'])[row_number() OVER (PARTITION BY song ORDER BY x, y, center)] AS instrument, center, x, y, count(*) OVER (PARTITION BY song) = 3 AS complete FROM low WHERE r <= 3)"""


@query(f"WITH {CENTERS}, {PERFORMERS} SELECT song, instrument, center, {q('x')} AS x, {q('y')} AS y, complete FROM performers")
def t4_pick_performers(spark, sf_dir):
    rows = centers(spark, sf_dir)
    return tracks.pick_performers(rows, layouts(rows), SONG).withColumns({"x": out("x"), "y": out("y")})


@query(f"""WITH {DETECTIONS}, centers AS (SELECT CAST(s AS BIGINT) AS song, CAST(c AS BIGINT) AS center, (200 + 300 * c)::DOUBLE AS x, (100 + 100 * c)::DOUBLE AS y FROM range(5) a(s), range(3) b(c)),
performers AS (SELECT song, (['violin', 'vocal', 'cello'])[center + 1] AS instrument, x, y FROM centers),
near AS (SELECT d.song, d.frame, d.subj, d.x0, d.y0, p.instrument, sqrt(((d.x0 + d.x1) / 2 - p.x) ** 2 + ((d.y0 + d.y1) / 2 - p.y) ** 2) AS dist, p.x FROM detections d JOIN performers p USING (song)),
best AS (SELECT song, frame, subj, x0, y0, arg_min(instrument, (dist, x)) AS instrument, min(dist) AS dist FROM near GROUP BY ALL),
won AS (SELECT song, instrument, frame, arg_max(x0, subj) AS x0, arg_max(y0, subj) AS y0 FROM best WHERE dist < 150 GROUP BY ALL)
SELECT p.song, p.instrument, f.frame, {q('x0')} AS x0, {q('y0')} AS y0 FROM performers p JOIN (SELECT DISTINCT song, frame FROM detections) f USING (song) LEFT JOIN won w ON w.song = p.song AND w.instrument = p.instrument AND w.frame = f.frame""")
def j7_assign_nearest(spark, sf_dir):
    rows = detections(spark, sf_dir)
    names_ = F.array(F.lit("violin"), F.lit("vocal"), F.lit("cello"))
    at = spark.range(15).select((F.col("id") % 5).alias("song"), F.expr("id div 5").alias("c"))
    performers = at.select("song", F.element_at(names_, F.col("c").cast("int") + 1).alias("instrument"), (200.0 + 300 * F.col("c")).alias("x"), (100.0 + 100 * F.col("c")).alias("y"))
    limits = at.select("song").distinct().withColumn("radius", F.lit(150.0))
    found = tracks.assign_nearest(rows, performers, limits, SONG, ["x0", "y0"])
    return found.withColumns({"x0": out("x0"), "y0": out("y0")})


def steady_boxes(spark, sf_dir):
    """Boxes of a few steady performers among the stand-in's noise, the songs' records, and all their frames: each tenth frame
    has lost its boxes."""
    noise = detections(spark, sf_dir)
    frames_ = noise.select("song", "frame").distinct()
    spots = F.array(*(F.struct(F.lit(100 + k).cast("long").alias("subj"), F.lit(150.0 + 350 * k).alias("cx"), F.lit(300.0).alias("cy")) for k in range(3)))
    steady = frames_.select("song", "frame", F.inline(spots))
    steady = steady.select("song", "frame", "subj", (F.col("cx") - 10).alias("x0"), (F.col("cy") - 20).alias("y0"), (F.col("cx") + 10).alias("x1"), (F.col("cy") + 20).alias("y1"))
    return noise.unionByName(steady).filter("frame % 10 <> 3"), layouts(noise).withColumn("moving_camera", F.col("song") == 4), frames_


@query()
def t5_build_tracks(spark, sf_dir):
    boxes, records, frames_ = steady_boxes(spark, sf_dir)
    found = tracks.build_tracks(boxes, records, SONG, ["x0", "y0"], frames_)
    return found.withColumns({"x0": out("x0"), "y0": out("y0")})


@query(f"""WITH {POINTS}, c AS (SELECT track, frame, avg(x) * 100 AS mx, avg(y) * 100 AS my FROM points GROUP BY ALL), n AS (SELECT track, frame, x * 100 AS x, y * 100 AS y FROM points WHERE kp = 0),
d AS (SELECT track, frame, sqrt((mx - x) ** 2 + (my - y) ** 2) AS d FROM c JOIN n USING (track, frame)),
g AS (SELECT track, frame, frame - row_number() OVER (PARTITION BY track ORDER BY frame) AS g FROM d WHERE d > 12),
i AS (SELECT track, min(frame) AS start, max(frame) AS "end" FROM g GROUP BY track, g)
SELECT track, start, "end", count(*) OVER (PARTITION BY track) AS intervals, CAST(sum("end" - start + 1) OVER (PARTITION BY track) AS BIGINT) AS frames FROM i""")
def w13_face_false_positives(spark, sf_dir):
    rows = frames(spark, sf_dir).withColumn("kp", F.transform("kp", lambda p: F.struct((p["x"] * 100).alias("x"), (p["y"] * 100).alias("y"))))
    return tracks.face_false_positives(rows.select("track", "frame", F.col("kp").alias("pts")), rows, TRACK, 12.0)


# --- components


def motion(spark, sf_dir):
    rows = frames(spark, sf_dir).withColumns({"x": F.transform("kp", lambda p: p["x"]), "y": F.transform("kp", lambda p: p["y"])})
    moved = timeaxis.speed_acceleration(rows, TRACK, fps=30.0)
    return moved.select("track", "frame", F.concat("speed", "acceleration").alias("v"))


MOTION = f"""moved AS (SELECT track, frame, kp, {slope('x')} AS vx, {slope('y')} AS vy FROM points {KP_FRAMES}),
turned AS (SELECT track, frame, kp, sqrt(vx * vx + vy * vy) AS speed, {slope('vx')} AS ax, {slope('vy')} AS ay FROM moved {KP_FRAMES}),
motion AS (SELECT track, frame, kp AS i, speed AS v FROM turned UNION ALL SELECT track, frame, kp + 32, sqrt(ax * ax + ay * ay) FROM turned)"""


@query(f"""WITH {POINTS}, {MOTION} SELECT a.track, a.i AS i, b.i AS j, count(*) AS n, {q('avg(a.v)', 5)} AS mean, {q('covar_samp(a.v, b.v)', 2)} AS covariance
FROM motion a JOIN motion b ON a.track = b.track AND a.frame = b.frame GROUP BY 1, 2, 3""")
def a10_co_moments(spark, sf_dir):
    """What components are solved from: all covariances of the points' speeds and accelerations."""
    found = loadings.co_moments(motion(spark, sf_dir), TRACK, "v")
    rows = found.select("track", "n", "mean", F.posexplode("co").alias("at", "co")).withColumns({"i": F.expr("at div 64").cast("int"), "j": (F.col("at") % 64).cast("int")})
    return rows.select("track", "i", "j", "n", out(F.element_at("mean", F.col("i") + 1), 5).alias("mean"), out(F.col("co") / (F.col("n") - 1), 2).alias("covariance"))


@query()
def a10_track_pca(spark, sf_dir):
    found = loadings.track_pca(motion(spark, sf_dir), TRACK, "v")
    return found.select("track", "component", out("variance_ratio", 5).alias("variance_ratio"), F.posexplode("loadings").alias("i", "loading")).withColumn("loading", out("loading", 4))


@query()
def a11_pca_contribution(spark, sf_dir):
    found = loadings.pca_contribution(loadings.track_pca(motion(spark, sf_dir), TRACK, "v"), TRACK, 5)
    return found.select("track", "kp", "rank", out("contribution", 4).alias("contribution"))


@query(f"WITH {POINTS} SELECT track, {q('max(x) - min(x)')} AS spread FROM points WHERE kp = 0 GROUP BY 1")
def u1_apply_track_features(spark, sf_dir):
    """A user-defined feature of whole tracks: the range of each track's first point."""
    rows = frames(spark, sf_dir).select("track", "frame", F.element_at("kp", 1)["x"].alias("x"))

    def spread(track):
        return track.groupby("track", as_index=False).agg(spread=("x", lambda v: float(v.max() - v.min())))

    return pose.apply_track_features(rows, TRACK, spread, "track int, spread double").withColumn("spread", out("spread"))


@query(f"""WITH {POINTS} SELECT track, frame, {q('median(x) OVER (PARTITION BY track ORDER BY frame ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)')} AS middle FROM points WHERE kp = 0""")
def u1_apply_frame_features(spark, sf_dir):
    """A user-defined feature by frame: the running median of seven frames, in blocks with three frames on either side."""
    rows = frames(spark, sf_dir).select("track", "frame", F.element_at("kp", 1)["x"].alias("x"))

    def middle(track):
        return track.assign(middle=track["x"].rolling(7, center=True, min_periods=1).median())[["track", "frame", "middle"]]

    found = pose.apply_track_features(rows, TRACK, middle, "track int, frame long, middle double", reach=3, block=16)
    return found.withColumn("middle", out("middle"))


