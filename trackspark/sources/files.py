"""Readers and writers of the files that tracks and model outputs come in."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import PART_BYTES, KeypointArrays, opened
from .tables import scratch  # noqa: F401  the queries' folder for files

SONG = (
    "struct<layout:array<string>,moving_camera:boolean,fps:double,duration:double,correct_body_detection:boolean,"
    "face_false_positive_frames:array<array<int>>>"
)


def nested(spark: SparkSession, path: str, leaf: str, lines: bool) -> DataFrame:
    """artist, song, value of JSON that nests artist -> song -> value of type `leaf`; an object a file, or a line."""
    raw = spark.read.text(path, wholetext=not lines).select(F.from_json("value", f"map<string,map<string,{leaf}>>").alias("j"))
    return raw.select(F.explode("j").alias("artist", "s")).select("artist", F.explode("s").alias("song", "value"))


def read_song_metadata(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One row per song; fields that a record lacks are null, further ones aren't read."""
    return nested(spark, path, SONG, lines).select("artist", "song", "value.*")


def read_chunk_records(spark: SparkSession, path: str, record: str, lines: bool = False) -> DataFrame:
    """artist, song, chunk and the record's fields, from lists of records (a struct type) by song."""
    return nested(spark, path, f"array<{record}>", lines).select("artist", "song", F.posexplode("value").alias("chunk", "r")).select("artist", "song", "chunk", "r.*")


def path_part(i: int) -> Column:
    """The i-th part of a file's path from its end, 1 for the name without its suffix."""
    part = F.element_at(F.split("path", "/"), -i)
    return F.regexp_replace(part, r"\.[^.]*$", "") if i == 1 else part


def read_keypoint_arrays(spark: SparkSession, root: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """artist, song, instrument (from the path), frame and kp (points x dims as arrays) of the .npy files under `root`, one
    per artist/song/instrument; files are split by frames (see arrays). Files with Python objects are refused."""
    spark.dataSource.register(KeypointArrays)
    return spark.read.format("keypoint_arrays").option("part_bytes", part_bytes).load(root)


def write_keypoint_arrays(frames: DataFrame, keys: list[str], root: str) -> int:
    """A .npy file, under root/keys, for each track (frame, kp as arrays of numbers); their number. `root` is a folder that
    all executors share.

    A track's frames come sorted and in batches, so that no track is held: they are written as they come, and the header,
    which tells their number, is made first, from a count.
    """
    sizes = frames.groupBy(*keys).agg(F.count("*").alias("__n"))
    rows = frames.join(sizes, keys).select(*keys, "__n", "frame", "kp").repartition(*keys).sortWithinPartitions(*keys, "frame")

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = opened(root)
        path = file = None

        def closed() -> None:
            file.close()
            store.move(path + ".part", path)

        for batch in batches:
            columns = batch.to_pydict()
            for *names, n, _, kp in zip(*columns.values()):
                now = "/".join([folder, *map(str, names)]) + ".npy"
                if now != path:
                    if file:
                        closed()
                    path, file = now, store.write(now + ".part")
                    np.lib.format.write_array_header_1_0(file, {"descr": "<f8", "fortran_order": False, "shape": (n, len(kp), len(kp[0]))})
                    yield pa.RecordBatch.from_arrays([pa.array([now])], names=["path"])
                file.write(np.array(kp, "<f8").tobytes())
        if file:
            closed()

    return rows.mapInArrow(save, "path string").count()


def read_feature_json(spark: SparkSession, root: str, kind: str, lines: bool = False) -> DataFrame:
    """artist, song, instrument, feature, frame, value. kind general: {part: {feature: [..]}}; others: {feature: [..]}.

    A file per track, named by its path; with `lines`, tracks are lines {artist: {song: {instrument: ..}}} of files of any
    number, as many small files take longer to make, list and open than to read.
    """
    leaf = "map<string,map<string,array<double>>>" if kind == "general" else "map<string,array<double>>"
    if lines:
        raw = nested(spark, root, f"map<string,{leaf}>", lines).select("artist", "song", F.explode("value").alias("instrument", "m"))
    else:
        raw = spark.read.option("recursiveFileLookup", "true").text(root, wholetext=True).withColumn("path", F.col("_metadata.file_path"))
        raw = raw.select(path_part(3).alias("artist"), path_part(2).alias("song"), path_part(1).alias("instrument"), F.from_json("value", leaf).alias("m"))
    keys = ["artist", "song", "instrument"]
    if kind == "general":
        rows = raw.select(*keys, F.explode("m").alias("part", "m"))
        rows = rows.select(*keys, "part", F.explode("m").alias("feature", "v")).withColumn("feature", F.concat_ws("_", "part", "feature"))
    else:
        rows = raw.select(*keys, F.explode("m").alias("feature", "v"))
    return rows.select(*keys, "feature", F.posexplode("v").alias("frame", "value"))


def read_song_records(spark: SparkSession, folder: str, schema: str, lines: bool = False) -> DataFrame:
    """Records of a folder of JSON files, one per song, or one per line; aggregates, broken ones and those without artist or
    song go."""
    rows = spark.read.schema(f"{schema}, _broken string").option("multiLine", not lines).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").json(folder)
    kept = rows.filter(~F.col("_metadata.file_name").startswith("aggregated_") & F.col("_broken").isNull() & F.col("artist").isNotNull() & F.col("song").isNotNull())
    return kept.drop("_broken")


def write_partitioned(df: DataFrame, path: str, keys: list[str], force: bool = False, format: str = "parquet") -> None:
    """One folder per key; `force` replaces the keys at hand, otherwise rows are added."""
    writer = df.repartition(*keys).write.partitionBy(*keys).format(format)
    writer.option("partitionOverwriteMode", "dynamic").mode("overwrite" if force else "append").save(path)


def pending(df: DataFrame, done: DataFrame, keys: list[str], force: bool = False) -> DataFrame:
    """Rows whose keys aren't done yet; all of them with `force`."""
    return df if force else df.join(done.select(*keys).distinct(), keys, "left_anti")


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
