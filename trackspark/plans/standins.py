"""The driver's tables as keyed signals, songs, detections and records, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import nan
from ..operators import blocks


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track, frame, x, y, event_type, ts: one track per user."""
    rows = table(spark, sf_dir, "events")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    frame = (F.row_number().over(order) - 1).cast("long")
    y = F.get_json_object("props", "$.k").cast("double")
    return rows.select(F.col("user_id").alias("track"), frame.alias("frame"), F.col("value").alias("x"), y.alias("y"), "event_type", "event_id")


SIGNALS = """signals AS (SELECT user_id AS track, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame,
  value AS x, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS y, event_type, event_id FROM events)"""


def gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """signals() with x NaN at errors."""
    return signals(spark, sf_dir).withColumn("x", F.when(F.col("event_type") == "error", nan()).otherwise(F.col("x")))


GAPPY = SIGNALS + """, gappy AS (SELECT track, frame, CASE WHEN event_type = 'error' THEN NULL ELSE x END AS x, y, event_type FROM signals)"""

LINE_ORDER = ["l_shipdate", "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track, frame and the number columns of lineitem: one track per supplier."""
    rows = table(spark, sf_dir, "lineitem")
    frame = (F.row_number().over(Window.partitionBy("l_suppkey").orderBy(*LINE_ORDER)) - 1).cast("long")
    return rows.select(F.col("l_suppkey").alias("track"), frame.alias("frame"), "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_orderkey")


LINES = f"""lines AS (SELECT l_suppkey AS track, row_number() OVER (PARTITION BY l_suppkey ORDER BY {', '.join(LINE_ORDER)}) - 1 AS frame,
  l_quantity, l_extendedprice, l_discount, l_tax, l_orderkey FROM lineitem)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track, frame, kp (32 points) and score (32): one track per label."""
    # numbered in blocks, as there are few labels
    rows = blocks.close_up(table(spark, sf_dir, "embeddings").withColumn("frame", F.col("vec_id")), ["label"])
    value = lambda i: F.element_at("embedding", i).cast("double")
    at = F.sequence(F.lit(0), F.lit(31))
    kp = F.transform(at, lambda i: F.struct(value(2 * i + 1).alias("x"), value(2 * i + 2).alias("y")))
    score = F.transform(at, lambda i: F.when((F.col("vec_id") + i) % 7 == 0, nan()).otherwise(((F.col("vec_id") * 3 + i * 5) % 11).cast("double")))
    return rows.select(F.col("label").alias("track"), "frame", kp.alias("kp"), score.alias("score"), "vec_id")


POINTS = """points AS (SELECT track, frame, vec_id, CAST(kp AS INTEGER) AS kp, CAST(embedding[2 * kp + 1] AS DOUBLE) AS x, CAST(embedding[2 * kp + 2] AS DOUBLE) AS y,
  CASE WHEN (vec_id + kp) % 7 = 0 THEN NULL ELSE CAST((vec_id * 3 + kp * 5) % 11 AS DOUBLE) END AS score
  FROM (SELECT label AS track, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, vec_id, embedding, unnest(range(32)) AS kp FROM embeddings))"""


def songs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Song records: artist = nation, song = customer, layout = the statuses of the customer's orders."""
    layout = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_set("o_orderstatus")).alias("layout"))
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("artist"))
    key = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").join(layout, "c_custkey", "left").join(nation, "c_nationkey")
    return rows.select(
        "artist", F.col("c_name").alias("song"), "layout", F.when(key % 3 == 0, True).when(key % 3 == 1, False).alias("moving_camera"),
        F.when(key % 4 == 0, 25.0).when(key % 4 == 1, 29.97).when(key % 4 == 2, 30.0).alias("fps"), F.col("c_acctbal").alias("duration"),
        F.when(key % 5 == 0, None).otherwise(key % 2 == 0).alias("correct_body_detection"),
        F.when(key % 7 == 0, F.array(F.array(F.lit(1), F.lit(2)))).otherwise(F.array().cast("array<array<int>>")).alias("face_false_positive_frames"),
    )


SONGS = """layouts AS (SELECT o_custkey, list_sort(list_distinct(list(o_orderstatus))) AS layout FROM orders GROUP BY 1),
songs AS (SELECT n_name AS artist, c_name AS song, layout, CASE c_custkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS moving_camera,
  CASE c_custkey % 4 WHEN 0 THEN 25.0 WHEN 1 THEN 29.97 WHEN 2 THEN 30.0 END::DOUBLE AS fps, c_acctbal AS duration,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_custkey % 2 = 0 END AS correct_body_detection, c_custkey % 7 = 0 AS has_fp, c_custkey
  FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN layouts ON o_custkey = c_custkey)"""


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """song, frame, subj, x0, y0, x1, y1: boxes around centres from quantity and discount."""
    rows = table(spark, sf_dir, "lineitem")
    song = F.col("l_suppkey") % 5
    subj = (F.row_number().over(Window.partitionBy(song, "l_orderkey").orderBy("l_suppkey", *LINE_ORDER)) - 1).cast("long")
    x, y = F.col("l_quantity") * 20, F.col("l_discount") * 5000
    return rows.select(song.alias("song"), F.col("l_orderkey").alias("frame"), subj.alias("subj"), (x - 10).alias("x0"), (y - 20).alias("y0"), (x + 10).alias("x1"), (y + 20).alias("y1"))


DETECTIONS = f"""detections AS (SELECT l_suppkey % 5 AS song, l_orderkey AS frame,
  row_number() OVER (PARTITION BY l_suppkey % 5, l_orderkey ORDER BY l_suppkey, {', '.join(LINE_ORDER)}) - 1 AS subj,
  l_quantity * 20 - 10 AS x0, l_discount * 5000 - 20 AS y0, l_quantity * 20 + 10 AS x1, l_discount * 5000 + 20 AS y1 FROM lineitem)"""


def attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """artist, song, chunk, audio (32) and video (32) of each vector."""
    half = lambda first: F.transform(F.slice("embedding", first, 32), lambda v: v.cast("double"))
    return table(spark, sf_dir, "embeddings").select((F.col("label") % 3).alias("artist"), F.col("label").alias("song"), F.col("vec_id").alias("chunk"), half(1).alias("audio"), half(33).alias("video"))


ATTENTION = """attention AS (SELECT label % 3 AS artist, label AS song, vec_id AS chunk, CAST(p AS INTEGER) AS pos,
  CAST(embedding[p + 1] AS DOUBLE) AS audio, CAST(embedding[p + 33] AS DOUBLE) AS video FROM (SELECT *, unnest(range(32)) AS p FROM embeddings))"""


def modulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunk, t (4), f (8), gamma, beta."""
    rows = attention(spark, sf_dir).select("chunk", "song", F.posexplode(F.arrays_zip("audio", "video")).alias("i", "v"))
    return rows.select("chunk", "song", F.expr("i div 8").alias("t"), (F.col("i") % 8).alias("f"), F.col("v.audio").alias("gamma"), F.col("v.video").alias("beta"))


MODULATION = ATTENTION + """, modulation AS (SELECT chunk, song, pos // 8 AS t, pos % 8 AS f, audio AS gamma, video AS beta FROM attention)"""


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """artist, song, chunk, baseline, variant: per-chunk metrics, with the variant missing at errors."""
    rows = signals(spark, sf_dir)
    return rows.select((F.col("track") % 10).alias("artist"), F.col("track").alias("song"), F.col("event_id").alias("chunk"), F.col("x").alias("baseline"), F.when(F.col("event_type") != "error", F.col("y")).alias("variant"))


METRICS = SIGNALS + """, metrics AS (SELECT track % 10 AS artist, track AS song, event_id AS chunk, x AS baseline, CASE WHEN event_type <> 'error' THEN y END AS variant FROM signals)"""


def out(c: Column | str, digits: int = 6) -> Column:
    """A number as queries give it: rounded, null for NaN, no negative zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(F.when(~F.isnan(c), c), digits) + 0.0


def q(expression: str, digits: int = 6) -> str:
    """out() as SQL."""
    return f"round(CASE WHEN NOT isnan({expression}) THEN {expression} END, {digits}) + 0.0"
