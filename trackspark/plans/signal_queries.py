"""Queries on signals: time axis and correlation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audio, blocks, correlate, select, timeaxis
from . import workloads
from .registry import query
from .standins import GAPPY, LINES, SIGNALS, gappy, lines, out, q, signals

TRACK = ["track"]
# Least |r| with p < 0.05 (two-sided) for n rows.
CRITICAL = {
    3: 0.9969173, 4: 0.95, 5: 0.8783394, 6: 0.8114014, 7: 0.7544922, 8: 0.7067344, 9: 0.6663836, 10: 0.6318969, 11: 0.6020688,
    12: 0.5759830, 13: 0.5529427, 14: 0.5324128, 15: 0.5139775, 16: 0.4973090,
}
STRONG_AT = "CASE n " + " ".join(f"WHEN {n} THEN {r}" for n, r in CRITICAL.items()) + " ELSE 2 END"

#: Windows of 15 frames every 3 of `pairs` (track, frame, x, y): r and n of rows where both are there.
WINDOWS = f"""sizes AS (SELECT track, max(frame) + 1 AS total FROM pairs GROUP BY 1),
starts AS (SELECT track, unnest(range(0, CAST(total AS BIGINT) - 14, 3)) AS start FROM sizes),
raw AS (SELECT s.track, s.start, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS n,
  CASE WHEN var_pop(x) FILTER (y IS NOT NULL) > 1e-9 AND var_pop(y) FILTER (x IS NOT NULL) > 1e-9 THEN corr(x, y) END AS r
  FROM starts s JOIN pairs p ON p.track = s.track AND p.frame >= s.start AND p.frame < s.start + 15 GROUP BY 1, 2),
windows AS (SELECT track, start, start / 30.0 AS time, n, r, coalesce(abs(r) > ({STRONG_AT}) AND abs(r) > 0.3, false) AS strong FROM raw)"""


def windows(spark, sf_dir):
    return correlate.sliding_corr(gappy(spark, sf_dir), TRACK)


def shown(df):
    return df.select("track", "start", out("time").alias("time"), "n", out("r").alias("r"), "strong")


PAIRS = GAPPY + ", pairs AS (SELECT track, frame, x, y FROM gappy), "


@query(f"WITH {PAIRS}{WINDOWS} SELECT track, start, {q('time')} AS time, n, {q('r')} AS r, strong FROM windows")
def w6_sliding_corr(spark, sf_dir):
    return shown(windows(spark, sf_dir))


@query(f"""WITH {GAPPY}, pairs AS (SELECT track, row_number() OVER (PARTITION BY track ORDER BY frame) - 1 AS frame, x, y FROM gappy WHERE x IS NOT NULL), {WINDOWS}
SELECT track, start, {q('time')} AS time, n, {q('r')} AS r, strong FROM windows""")
def w7_masked_sliding_corr(spark, sf_dir):
    return shown(correlate.masked_sliding_corr(gappy(spark, sf_dir), TRACK, ["x"]))


@query(f"WITH {PAIRS}{WINDOWS} SELECT track, CAST(floor(time / 4) AS BIGINT) AS chunk, count(*) AS count FROM windows WHERE strong GROUP BY 1, 2")
def a3_chunk_counts(spark, sf_dir):
    return correlate.chunk_counts(windows(spark, sf_dir).filter("strong"), TRACK)


@query(f"WITH {PAIRS}{WINDOWS} SELECT track, {q('time')} AS time, {q('r')} AS correlation FROM windows WHERE strong")
def a4_strong_events(spark, sf_dir):
    found = correlate.strong_events(windows(spark, sf_dir), TRACK)
    return found.select("track", out("time").alias("time"), out("correlation").alias("correlation"))


@query(f"""WITH {PAIRS}{WINDOWS} SELECT track % 3 AS instrument, track AS part, count(*) FILTER (abs(r) > 0.66) AS strong, count(*) AS windows
FROM windows GROUP BY ROLLUP (1, 2)""".replace("ROLLUP (1, 2)", "ROLLUP (track % 3, track)"))
def a5_strong_counts_by_part(spark, sf_dir):
    rows = windows(spark, sf_dir).select((F.col("track") % 3).alias("instrument"), F.col("track").alias("part"), "r")
    return correlate.strong_counts_by_part(rows, ["instrument", "part"])


def two_audio(spark, sf_dir):
    """Long motion and audio features: x as motion; y and |x - y| as audio."""
    rows = signals(spark, sf_dir)
    motion = rows.select("track", "frame", F.lit("speed").alias("feature"), F.col("x").alias("value"))
    both = F.array(F.struct(F.lit("rms").alias("feature"), F.col("y").alias("value")), F.struct(F.lit("onset_env").alias("feature"), F.abs(F.col("x") - F.col("y")).alias("value")))
    return motion, rows.select("track", "frame", F.inline(both))


def pair_windows(spark, sf_dir):
    motion, sound = two_audio(spark, sf_dir)
    return correlate.sliding_corr(correlate.feature_pairs(motion, sound, TRACK), ["track", "motion_feature", "audio_feature"])


LONG = SIGNALS + """, pairs AS (SELECT track || '/rms' AS track, frame, x, y FROM signals UNION ALL SELECT track || '/onset_env', frame, x, abs(x - y) FROM signals), """
SPLIT = ", named AS (SELECT CAST(split_part(track, '/', 1) AS BIGINT) AS track, split_part(track, '/', 2) AS audio_feature, * EXCLUDE (track) FROM windows)"
PCT = "coalesce(100.0 * count(*) FILTER (strong) / nullif(count(*), 0), 0)"


@query(f"WITH {LONG}{WINDOWS}{SPLIT} SELECT track, audio_feature, start, n, {q('r')} AS r, strong FROM named")
def j2_feature_pair_windows(spark, sf_dir):
    return pair_windows(spark, sf_dir).select("track", "audio_feature", "start", "n", out("r").alias("r"), "strong")


@query(f"""WITH {LONG}{WINDOWS.replace("> 0.3", "> 0.5")}{SPLIT} SELECT track, audio_feature, start, n, {q('r')} AS r, strong FROM named""")
def strong_windows(spark, sf_dir):
    """The main study: motion and audio features to windows of half a second, strong from |r| of 0.5 on."""
    return workloads.strong_windows(*two_audio(spark, sf_dir), TRACK).select("track", "audio_feature", "start", "n", out("r").alias("r"), "strong")


@query(f"""WITH {LONG}{WINDOWS}{SPLIT} SELECT track % 2 AS grp, motion_feature, audio_feature, count(*) FILTER (strong) AS strong, count(*) AS total, {q(PCT)} AS pct
FROM (SELECT *, 'speed' AS motion_feature FROM named) GROUP BY GROUPING SETS ((track % 2, motion_feature, audio_feature), (track % 2, audio_feature), (audio_feature))""")
def a6_strong_share(spark, sf_dir):
    rows = pair_windows(spark, sf_dir).withColumn("grp", F.col("track") % 2)
    return correlate.strong_share(rows, "grp", "motion_feature", "audio_feature").withColumn("pct", out("pct"))


@query(f"""WITH {LONG}{WINDOWS}{SPLIT}, shares AS (SELECT audio_feature, {PCT} AS pct, track % 2 AS grp FROM named GROUP BY 1, 3),
wide AS (SELECT audio_feature, coalesce(max(pct) FILTER (grp = 0), 0) AS specific, coalesce(max(pct) FILTER (grp = 1), 0) AS general FROM shares GROUP BY 1)
SELECT audio_feature, {q('specific')} AS specific, {q('general')} AS general,
CASE WHEN specific > general THEN 'specific' WHEN specific < general THEN 'general' ELSE 'equal' END AS higher FROM wide""")
def a7_compare_share(spark, sf_dir):
    rows = pair_windows(spark, sf_dir).withColumn("grp", F.when(F.col("track") % 2 == 0, "specific").otherwise("general"))
    shares = correlate.strong_share(rows, "grp", "motion_feature", "audio_feature").filter("grp is not null and motion_feature is null")
    return correlate.compare_share(shares, "grp", "audio_feature", "specific", "general").withColumns({"specific": out("specific"), "general": out("general")})


@query(f"""WITH {LONG}{WINDOWS}{SPLIT} SELECT track, audio_feature, {q('avg(r)', 5)} AS mean_r, {q('max(r)')} AS max_r, count(*) FILTER (strong) AS strong, {q(PCT)} AS pct_strong
FROM named GROUP BY 1, 2""")
def a8_track_corr_summary(spark, sf_dir):
    found = correlate.track_corr_summary(pair_windows(spark, sf_dir), ["track", "audio_feature"])
    return found.withColumns({"mean_r": out("mean_r", 5), "max_r": out("max_r"), "pct_strong": out("pct_strong")})


@query(f"""WITH {LONG}{WINDOWS}{SPLIT}, s AS (SELECT track, audio_feature, avg(r) AS m FROM named GROUP BY 1, 2)
SELECT track, arg_max(audio_feature, (m, audio_feature = 'onset_env', audio_feature)) AS better FROM s GROUP BY 1""")
def a8_better_feature(spark, sf_dir):
    return correlate.better_feature(correlate.track_corr_summary(pair_windows(spark, sf_dir), ["track", "audio_feature"]), TRACK)


@query(f"WITH {SIGNALS}, n AS (SELECT track, count(*) AS c, count(*) FILTER (event_type <> 'view') AS d FROM signals GROUP BY 1) SELECT s.track, s.frame, s.x, s.y FROM signals s JOIN n USING (track) WHERE track % 2 = 0")
def j1_align(spark, sf_dir):
    rows = signals(spark, sf_dir)
    short = rows.filter("track % 2 = 0 or frame > 0").select("track", "frame", "y")
    return correlate.align(rows.select("track", "frame", "x"), short, TRACK)


@query(f"""WITH {SIGNALS} SELECT track, 'instrument::wrist' AS feature, frame, x AS value FROM signals UNION ALL SELECT track, 'general::body', frame, y FROM signals""")
def j3_merge_feature_sets(spark, sf_dir):
    rows = signals(spark, sf_dir)
    one = rows.select("track", F.lit("wrist").alias("feature"), "frame", F.col("x").alias("value"))
    two = rows.select("track", F.lit("body").alias("feature"), "frame", F.col("y").alias("value"))
    return correlate.merge_feature_sets(one, two, rows, TRACK)


@query(f"""WITH {PAIRS}{WINDOWS}, hit AS (SELECT p.track, p.frame, 'p' || (w.start % 2) AS part FROM pairs p JOIN windows w ON p.track = w.track AND w.strong
 AND p.frame >= w.start AND p.frame < w.start + 60) SELECT track, frame, string_agg(DISTINCT part, ',' ORDER BY part) AS parts FROM hit GROUP BY 1, 2""")
def j4_correlated_parts(spark, sf_dir):
    rows = gappy(spark, sf_dir)
    found = windows(spark, sf_dir).withColumns({"part": F.concat(F.lit("p"), F.col("start") % 2), "time": F.col("start").cast("double")})
    hit = correlate.correlated_parts(rows.select("track", "frame"), found, TRACK, span_s=60.0, fps=1.0)
    return hit.withColumn("parts", F.array_join("parts", ","))


@query(f"""WITH {LINES}, rows AS (SELECT track, frame, l_quantity AS x, l_tax + l_quantity / 100 AS y FROM lines),
w AS (SELECT track, frame // 20 AS win, frame, (x - avg(x) OVER k) / stddev_pop(x) OVER k AS a, (y - avg(y) OVER k) / stddev_pop(y) OVER k AS b, count(*) OVER k AS n
  FROM rows WINDOW k AS (PARTITION BY track, frame // 20))
SELECT p.track, CAST(p.win AS BIGINT) AS window, CAST(p.frame - q.frame AS INTEGER) AS lag, {q('sum(p.a * q.b)', 5)} AS c FROM w p JOIN w q ON p.track = q.track AND p.win = q.win AND abs(p.frame - q.frame) <= 5
WHERE p.n = 20 GROUP BY 1, 2, 3""")
def w8_cross_corr_windows(spark, sf_dir):
    rows = lines(spark, sf_dir).select("track", "frame", F.col("l_quantity").alias("x"), (F.col("l_tax") + F.col("l_quantity") / 100).alias("y"))
    return correlate.cross_corr_windows(rows, TRACK, win=20, max_lag=5).withColumn("c", out("c", 5))


@query(f"""WITH {LINES}, rows AS (SELECT track, frame, l_quantity AS x, l_tax + l_quantity / 100 AS y FROM lines),
w AS (SELECT track, frame // 20 AS win, frame, (x - avg(x) OVER k) / stddev_pop(x) OVER k AS a, (y - avg(y) OVER k) / stddev_pop(y) OVER k AS b, count(*) OVER k AS n
  FROM rows WINDOW k AS (PARTITION BY track, frame // 20)),
c AS (SELECT p.track % 3 AS grp, p.track, p.win, p.frame - q.frame AS lag, sum(p.a * q.b) AS c FROM w p JOIN w q ON p.track = q.track AND p.win = q.win AND abs(p.frame - q.frame) <= 5
WHERE p.n = 20 GROUP BY ALL),
g AS (SELECT grp, 'xy' AS pair, CAST(lag AS INTEGER) AS lag, avg(c) AS m, stddev_pop(c) AS s, count(*) AS windows FROM c GROUP BY GROUPING SETS ((grp, lag), (lag)))
SELECT grp, pair, lag, {q('m', 5)} AS mean_c, {q('s', 5)} AS std_c, windows, row_number() OVER (PARTITION BY grp ORDER BY abs(m) DESC, lag) = 1 AS best FROM g""")
def a9_lag_profile(spark, sf_dir):
    rows = lines(spark, sf_dir).select((F.col("track") % 3).alias("grp"), "track", F.lit("xy").alias("pair"), "frame", F.col("l_quantity").alias("x"), (F.col("l_tax") + F.col("l_quantity") / 100).alias("y"))
    cross = correlate.cross_corr_windows(rows, ["grp", "track", "pair"], win=20, max_lag=5)
    return correlate.lag_profile(cross, "grp", "pair").withColumns({"mean_c": out("mean_c", 5), "std_c": out("std_c", 5)})


FPS = "CASE track % 4 WHEN 0 THEN 25.0 WHEN 1 THEN 30.0 WHEN 2 THEN 24.0 END::DOUBLE"


@query(f"""WITH {GAPPY}, known AS (SELECT track, {FPS} AS fps, row_number() OVER (PARTITION BY track ORDER BY frame) - 1 AS frame, x, y FROM gappy WHERE x IS NOT NULL AND track % 4 < 3),
sizes AS (SELECT track, count(*) AS n, CAST(trunc(CASE WHEN fps = 30 THEN count(*) ELSE count(*) / fps * 30 END) AS BIGINT) AS m FROM known GROUP BY track, fps),
spine AS (SELECT track, n, m, unnest(range(m)) AS k FROM sizes), spots AS (SELECT *, k * (n / CAST(m AS DOUBLE)) AS p FROM spine),
placed AS (SELECT *, greatest(0, least(CAST(floor(p) AS BIGINT), n - 2)) AS i FROM spots),
even AS (SELECT z.track, z.k AS frame, CASE WHEN b.x IS NULL OR p = i THEN a.x ELSE a.x + (b.x - a.x) * (p - i) END AS x, CASE WHEN b.x IS NULL OR p = i THEN a.y ELSE a.y + (b.y - a.y) * (p - i) END AS y
  FROM placed z JOIN known a ON a.track = z.track AND a.frame = z.i LEFT JOIN known b ON b.track = z.track AND b.frame = z.i + 1),
w AS (SELECT track, frame // 20 AS win, frame, (x - avg(x) OVER k) / stddev_pop(x) OVER k AS a, (y - avg(y) OVER k) / stddev_pop(y) OVER k AS b, count(*) OVER k AS n FROM even WINDOW k AS (PARTITION BY track, frame // 20)),
c AS (SELECT p.track % 4 AS grp, p.track, p.win, p.frame - q.frame AS lag, sum(p.a * q.b) AS c FROM w p JOIN w q ON p.track = q.track AND p.win = q.win AND abs(p.frame - q.frame) <= 6 WHERE p.n = 20 GROUP BY ALL),
g AS (SELECT grp, 'xy' AS pair, CAST(lag AS INTEGER) AS lag, avg(c) AS m, stddev_pop(c) AS s, count(*) AS windows FROM c GROUP BY GROUPING SETS ((grp, lag), (lag)))
SELECT grp, pair, lag, {q('m', 5)} AS mean_c, {q('s', 5)} AS std_c, windows, row_number() OVER (PARTITION BY grp ORDER BY abs(m) DESC, lag) = 1 AS best FROM g""")
def lag_study(spark, sf_dir):
    """The lag study: gaps dropped, rates of 25, 30, 24 or none brought to 30, windows of 20 frames over 13 lags."""
    group = F.col("track") % 4
    fps = F.when(group == 0, 25.0).when(group == 1, 30.0).when(group == 2, 24.0)
    rows = gappy(spark, sf_dir).select(group.alias("grp"), "track", F.lit("xy").alias("pair"), "frame", "x", "y", fps.alias("fps"))
    return workloads.lag_study(rows, "grp", ["track"], "pair", win=20, max_lag=6).withColumns({"mean_c": out("mean_c", 5), "std_c": out("std_c", 5)})


@query(f"""WITH {GAPPY}, c AS (SELECT track, frame // 12 AS part, count(x) AS n, corr(x, y + x / 3) FILTER (x IS NOT NULL) AS r FROM gappy GROUP BY 1, 2)
SELECT track, CAST(part AS BIGINT) AS part, n, {q('r')} AS r FROM c WHERE n > 2 AND r > 0.25 AND abs(r) > ({STRONG_AT})""")
def a2_global_corr(spark, sf_dir):
    """Parts of 12 frames: the p test leaves out many whose r is over the limit."""
    rows = gappy(spark, sf_dir).select("track", F.expr("frame div 12").alias("part"), "x", (F.col("y") + F.col("x") / 3).alias("y"))
    return correlate.global_corr(rows, ["track", "part"]).select("track", "part", "n", out("r").alias("r"))


# --- time axis


def edge(c: str, k: int) -> str:
    move, end = ("lag", "first_value") if k > 0 else ("lead", "last_value")
    return f"coalesce({move}({c}, {abs(k)}) OVER o, {end}({c}) OVER w)"


def savgol(c: str) -> str:
    return "(" + " + ".join(f"{v} * {edge(c, k) if k else c}" for k, v in ((2, -3), (1, 12), (0, 17), (-1, 12), (-2, -3))) + ") / 35.0"


FRAMES = "WINDOW o AS (PARTITION BY track ORDER BY frame), w AS (PARTITION BY track ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"


@query(f"WITH {SIGNALS} SELECT track, frame, {q(savgol('x'), 5)} AS x, {q(savgol('y'), 5)} AS y FROM signals {FRAMES}")
def w2_smooth(spark, sf_dir):
    found = blocks.in_blocks(signals(spark, sf_dir), TRACK, 2, lambda rows, keys: timeaxis.smooth(rows, keys, ["x", "y"]))
    return found.select("track", "frame", out("x", 5).alias("x"), out("y", 5).alias("y"))


def slope(c: str) -> str:
    return f"coalesce((lead({c}) OVER o - lag({c}) OVER o) / 2, lead({c}) OVER o - {c}, {c} - lag({c}) OVER o) * 30"


@query(f"WITH {SIGNALS} SELECT track, frame, {q(slope('x'))} AS dx FROM signals {FRAMES}")
def w3_gradient(spark, sf_dir):
    found = blocks.in_blocks(signals(spark, sf_dir), TRACK, 1, lambda rows, keys: timeaxis.gradient(rows, keys, {"dx": "x"}, 30.0))
    return found.select("track", "frame", out("dx").alias("dx"))


@query(f"""WITH {SIGNALS}, v AS (SELECT track, frame, {slope('x')} AS vx, {slope('y')} AS vy FROM signals {FRAMES}),
a AS (SELECT track, frame, vx, vy, {slope('vx')} AS ax, {slope('vy')} AS ay FROM v {FRAMES})
SELECT track, frame, {q('sqrt(vx * vx + vy * vy)', 4)} AS speed, {q('sqrt(ax * ax + ay * ay)', 4)} AS acceleration FROM a""")
def w4_speed_acceleration(spark, sf_dir):
    found = blocks.in_blocks(signals(spark, sf_dir), TRACK, 2, lambda rows, keys: timeaxis.speed_acceleration(rows, keys, fps=30.0))
    return found.select("track", "frame", out("speed", 4).alias("speed"), out("acceleration", 4).alias("acceleration"))


@query(f"""WITH {GAPPY}, f AS (SELECT track, frame, x, last_value(x IGNORE NULLS) OVER (PARTITION BY track ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b,
 first_value(x IGNORE NULLS) OVER (PARTITION BY track ORDER BY frame ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a FROM gappy)
SELECT track, frame, {q('coalesce(x, (a + b) / 2, b, a)')} AS x FROM f""")
def w5_fill_nan_frames(spark, sf_dir):
    return timeaxis.fill_nan_frames(gappy(spark, sf_dir), TRACK, ["x"]).select("track", "frame", out("x").alias("x"))


SPINE = "spine AS (SELECT track, n, m, unnest(range(CAST(m AS BIGINT))) AS k FROM sizes)"
MIXED = "CASE WHEN b.x IS NULL OR p = i THEN a.x ELSE a.x + (b.x - a.x) * (p - i) END"
PLACED = "placed AS (SELECT track, k, p, greatest(0, least(CAST(floor(p) AS BIGINT), n - 2)) AS i FROM spots)"
INTERPOLATED = f"SELECT z.track, z.k AS frame, {q(MIXED, 9)} AS value FROM placed z JOIN signals a ON a.track = z.track AND a.frame = z.i LEFT JOIN signals b ON b.track = z.track AND b.frame = z.i + 1"


@query(f"""WITH {SIGNALS}, sizes AS (SELECT track, count(*) AS n, 40 AS m FROM signals GROUP BY 1), {SPINE},
spots AS (SELECT *, k * (n - 1) / CAST(m - 1 AS DOUBLE) AS p FROM spine), {PLACED} {INTERPOLATED}""")
def w9_resample_endpoint(spark, sf_dir):
    rows = signals(spark, sf_dir).select("track", "frame", F.col("x").alias("value"))
    return timeaxis.resample_endpoint(rows, TRACK, 40).select("track", F.col("frame").cast("long").alias("frame"), out("value", 9).alias("value"))


@query(f"""WITH {SIGNALS}, sizes AS (SELECT track, count(*) AS n, CAST(floor(count(*) / 25.0::DOUBLE * 30.0::DOUBLE) AS BIGINT) AS m FROM signals GROUP BY 1), {SPINE},
spots AS (SELECT *, k * (n / CAST(m AS DOUBLE)) AS p FROM spine), {PLACED} {INTERPOLATED}""")
def w10_resample_rate(spark, sf_dir):
    rows = signals(spark, sf_dir).select("track", "frame", F.col("x").alias("value"), F.lit(25.0).alias("fps"))
    return timeaxis.resample_rate(rows, TRACK, "fps").select("track", F.col("frame").cast("long").alias("frame"), out("value", 9).alias("value"))


@query(f"""WITH {SIGNALS}, a AS (SELECT track, frame, x FROM signals), b AS (SELECT track, 2 * frame AS frame, y FROM signals UNION ALL SELECT track, 2 * frame + 1, (x + y) / 2 FROM signals),
s AS (SELECT track, count(*) AS la, 2 * count(*) AS lb FROM a GROUP BY 1),
p AS (SELECT a.track, a.x, a.frame * (lb - 1) / CAST(la - 1 AS DOUBLE) AS p, lb FROM a JOIN s USING (track)),
i AS (SELECT *, greatest(0, least(CAST(floor(p) AS BIGINT), lb - 2)) AS i FROM p),
v AS (SELECT i.track, i.x, b1.y + coalesce(b2.y - b1.y, 0) * (p - i) AS y FROM i JOIN b b1 ON b1.track = i.track AND b1.frame = i.i LEFT JOIN b b2 ON b2.track = i.track AND b2.frame = i.i + 1)
SELECT track, {q('corr(x, y)')} AS r FROM v GROUP BY 1""")
def w11_interp_corr(spark, sf_dir):
    """x with a series of twice its length."""
    rows = signals(spark, sf_dir)
    a = rows.select("track", "frame", F.col("x").alias("value"))
    twice = F.array(F.struct((2 * F.col("frame")).alias("frame"), F.col("y").alias("value")), F.struct((2 * F.col("frame") + 1).alias("frame"), ((F.col("x") + F.col("y")) / 2).alias("value")))
    return timeaxis.interp_corr(a, rows.select("track", F.inline(twice)), TRACK).withColumn("r", out("r"))


ISLANDS = """islands AS (SELECT track, min(frame) AS start, max(frame) AS "end" FROM (SELECT track, frame, frame - row_number() OVER (PARTITION BY track ORDER BY frame) AS g
 FROM signals WHERE event_type = 'view') GROUP BY track, g)"""


def views(spark, sf_dir):
    return timeaxis.islands(signals(spark, sf_dir), TRACK, F.col("event_type") == "view")


@query(f'WITH {SIGNALS}, {ISLANDS} SELECT track, start, "end" FROM islands')
def w12_islands(spark, sf_dir):
    return views(spark, sf_dir)


@query(f"""WITH {SIGNALS}, e AS (SELECT track, quantile_cont(x, 0.05) AS lo, quantile_cont(x, 0.95) AS hi FROM signals GROUP BY 1)
SELECT track, frame, {q('CASE WHEN hi > lo THEN (greatest(lo, least(hi, x)) - lo) / (hi - lo) ELSE x END', 5)} AS value FROM signals JOIN e USING (track)""")
def w14_robust_scale(spark, sf_dir):
    rows = signals(spark, sf_dir).select("track", "frame", F.col("x").alias("value"))
    return timeaxis.robust_scale(rows, TRACK).select("track", "frame", out("value", 5).alias("value"))


# --- samples


@query(f"""WITH {LINES}, n AS (SELECT track, count(*) AS n FROM lines GROUP BY 1), s AS (SELECT track, unnest(range(n // 16 + 1)) AS frame FROM n)
SELECT s.track, s.frame, {q('sqrt(coalesce(sum(l_quantity * l_quantity), 0) / 32)', 5)} AS rms
FROM s LEFT JOIN lines l ON l.track = s.track AND l.frame >= (s.frame - 1) * 16 AND l.frame < (s.frame + 1) * 16 GROUP BY 1, 2""")
def w15_framewise_rms(spark, sf_dir):
    rows = lines(spark, sf_dir).select("track", F.col("frame").alias("i"), F.col("l_quantity").alias("y"))
    return audio.framewise_rms(rows, TRACK, hop=16).withColumn("rms", out("rms", 5))


#: Frames of 32 samples every 16, at a rate of 3000, in 4 mel bands; the transform as sums over samples.
MEL = "CASE WHEN m < 15 THEN m * 200 / 3.0 ELSE 1000 * exp(ln(6.4::DOUBLE) / 27 * (m - 15)) END"


@query(f"""WITH {LINES}, n AS (SELECT track, count(*) AS n FROM lines GROUP BY 1), t AS (SELECT track, unnest(range(n // 16 + 1)) AS t FROM n),
x AS (SELECT t.track, t.t, l.frame - t.t * 16 + 16 AS j, l_quantity AS y FROM t JOIN lines l ON l.track = t.track AND l.frame >= t.t * 16 - 16 AND l.frame < t.t * 16 + 16),
w AS (SELECT track, t, j, y * (0.5 - 0.5 * cos(2 * pi() * j / 32)) AS y FROM x), bins AS (SELECT unnest(range(17)) AS k),
p AS (SELECT track, t, k, sum(y * cos(2 * pi() * j * k / 32)) ** 2 + sum(y * sin(2 * pi() * j * k / 32)) ** 2 AS p FROM w, bins GROUP BY ALL),
points AS (SELECT i, {MEL} AS h FROM (SELECT i, i * (15 + ln(1.5::DOUBLE) / (ln(6.4::DOUBLE) / 27)) / 5 AS m FROM (SELECT unnest(range(6)) AS i))),
bank AS (SELECT a.i AS band, k, greatest(0, least((k * 93.75 - a.h) / (b.h - a.h), (c.h - k * 93.75) / (c.h - b.h))) * 2 / (c.h - a.h) AS v FROM bins, points a JOIN points b ON b.i = a.i + 1 JOIN points c ON c.i = a.i + 2),
s AS (SELECT track, t, band, 10 * log10(greatest(1e-10, sum(p * v))) AS s FROM p JOIN bank USING (k) GROUP BY ALL),
f AS (SELECT track, t, band, greatest(s, max(s) OVER (PARTITION BY track) - 80) AS s FROM s),
r AS (SELECT track, t, greatest(0, lag(s, 1) OVER o - lag(s, 2) OVER o) AS r FROM f WINDOW o AS (PARTITION BY track, band ORDER BY t))
SELECT track, t AS frame, {q('coalesce(avg(r), 0)', 4)} AS onset_env FROM r GROUP BY 1, 2""")
def w16_onset_envelope(spark, sf_dir):
    rows = lines(spark, sf_dir).select("track", F.col("frame").alias("i"), F.col("l_quantity").alias("y"))
    return audio.onset_envelope(rows, TRACK, hop=16, bands=4, rate=3000.0).withColumn("onset_env", out("onset_env", 4))


@query(f"""WITH {SIGNALS}, c AS (SELECT track % 5 AS song, frame AS i, track, x AS y FROM signals),
f AS (SELECT song, track, row_number() OVER (PARTITION BY song ORDER BY track) AS k, count(*) OVER (PARTITION BY song) AS n FROM (SELECT DISTINCT song, track FROM c)),
w AS (SELECT song, track, power(0.5, CASE WHEN k = 1 THEN n - 1 ELSE n - k + 1 END) AS w FROM f)
SELECT song, i, {q('sum(y * w)', 5)} AS y FROM c JOIN w USING (song, track) GROUP BY 1, 2""")
def w17_mix_channels(spark, sf_dir):
    rows = signals(spark, sf_dir).select((F.col("track") % 5).alias("song"), F.col("frame").alias("i"), F.col("track").alias("channel"), F.col("x").alias("y"))
    return audio.mix_channels(rows, ["song"]).withColumn("y", out("y", 5))


@query(f"""WITH {LINES}, s AS (SELECT track, count(*) * covar_pop(l_extendedprice, l_quantity) AS er, count(*) * var_pop(l_quantity) AS rr, count(*) * var_pop(l_extendedprice) AS ee FROM lines GROUP BY 1),
a AS (SELECT *, (er + 1e-8) / (rr + 1e-8) AS alpha FROM s)
SELECT track, {q('10 * log10((alpha * alpha * rr + 1e-8) / (greatest(ee - 2 * alpha * er + alpha * alpha * rr, 0) + 1e-8))', 5)} AS si_sdr FROM a""")
def g4_si_sdr(spark, sf_dir):
    return audio.si_sdr(lines(spark, sf_dir), TRACK, "l_extendedprice", "l_quantity").withColumn("si_sdr", out("si_sdr", 5))


# --- masks and slices


@query(f"WITH {SIGNALS} SELECT track, frame, x FROM signals WHERE frame >= 7 AND frame < 37")
def p6_slice_chunk(spark, sf_dir):
    return select.slice_chunk(signals(spark, sf_dir), 0.25, 1.0, 30.0).select("track", "frame", "x")


@query(f"WITH {GAPPY} SELECT track, frame, CASE WHEN y < 30 THEN NULL ELSE x END AS x FROM gappy")
def p7_mask_low_confidence(spark, sf_dir):
    found = select.mask_low_confidence(gappy(spark, sf_dir), ["x"], "y", 30.0)
    return found.select("track", "frame", F.when(~F.isnan("x"), F.col("x")).alias("x"))


@query(f"""WITH {SIGNALS}, {ISLANDS} SELECT s.track, s.frame, CASE WHEN EXISTS (SELECT 1 FROM islands i WHERE i.track = s.track AND s.frame BETWEEN i.start AND i."end") THEN NULL ELSE x END AS x FROM signals s""")
def p8_mask_intervals(spark, sf_dir):
    found = select.mask_intervals(signals(spark, sf_dir), views(spark, sf_dir), TRACK, ["x"])
    return found.select("track", "frame", F.when(~F.isnan("x"), F.col("x")).alias("x"))


@query(f"WITH {GAPPY} SELECT track, frame, coalesce(x, 0) AS x FROM gappy")
def p12_fill_nan(spark, sf_dir):
    return select.fill_nan(gappy(spark, sf_dir), ["x"]).select("track", "frame", "x")
