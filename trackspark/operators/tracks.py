"""From detections (song, frame, subj, x0, y0, x1, y1) to one track per performer."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.tables import kept, scratch
from .pose import distance
from .timeaxis import islands


def with_centers(detections: DataFrame) -> DataFrame:
    return detections.withColumns({"cx": (F.col("x0") + F.col("x1")) / 2, "cy": (F.col("y0") + F.col("y1")) / 2})


def adaptive_thresholds(detections: DataFrame, keys: list[str], songs: DataFrame | None = None) -> DataFrame:
    """radius = 8 % of the span of all coordinates within 50..200, height = 15 % of the vertical span within 100..300;
    100 and 150 for songs (of `songs`) without detections."""
    low = F.least(F.min("x0"), F.min("x1"), F.min("y0"), F.min("y1"))
    high = F.greatest(F.max("x0"), F.max("x1"), F.max("y0"), F.max("y1"))
    clamp = lambda v, a, b: F.greatest(F.lit(a), F.least(F.lit(b), v))
    radius, height = clamp((high - low) * 0.08, 50.0, 200.0), clamp((F.max("y1") - F.min("y0")) * 0.15, 100.0, 300.0)
    found = detections.groupBy(*keys).agg(radius.alias("radius"), height.alias("height"))
    if songs is None:
        return found
    return songs.select(*keys).distinct().join(found, keys, "left").na.fill({"radius": 100.0, "height": 150.0})


class Leaders:
    """Running cluster centres of one song: a point joins the first centre within `limit`, whose mean it moves, or is a new one.

    Centres lie in square cells a little wider than `limit`, so that only those of nine cells can be near a point. While they
    are FEW, points come in chunks (add_all) of which most can be given their centre at once.
    """

    FEW = 128

    def __init__(self, limit: float, found: list[list[float]] = ()):
        self.limit, self.width = limit, limit * 1.000001 or 1.0
        self.found: list[list[float]] = [list(c) for c in found]
        self.total, self.singly = sum(c[2] for c in self.found), 0
        self.fill()

    def fill(self) -> None:
        self.cells: dict[tuple[int, int], list[int]] = {}
        for k, c in enumerate(self.found):
            self.cells.setdefault(self.cell(c[0], c[1]), []).append(k)

    def cell(self, x: float, y: float) -> tuple[int, int]:
        return math.floor(x / self.width), math.floor(y / self.width)

    def add(self, x: float, y: float) -> None:
        here = self.cell(x, y)
        first = None
        for i in (-1, 0, 1):
            for j in (-1, 0, 1):
                for k in self.cells.get((here[0] + i, here[1] + j), ()):
                    if (first is None or k < first) and math.hypot(self.found[k][0] - x, self.found[k][1] - y) < self.limit:
                        first = k
        if first is None:
            self.cells.setdefault(here, []).append(len(self.found))
            self.found.append([x, y, 1])
            return
        c = self.found[first]
        before = self.cell(c[0], c[1])
        c[2] += 1
        c[0] += (x - c[0]) / c[2]
        c[1] += (y - c[1]) / c[2]
        after = self.cell(c[0], c[1])
        if after != before:
            self.cells[before].remove(first)
            self.cells.setdefault(after, []).append(first)


    def add_all(self, x: np.ndarray, y: np.ndarray) -> None:
        """add() each of the points, in their order."""
        at = 0
        while at < len(x):
            size = min(1 << 15, self.total // 128)
            if size < 64 or len(self.found) > self.FEW or self.singly > 0:
                size = 256
                self.singly -= size
                for point in zip(x[at : at + size].tolist(), y[at : at + size].tolist()):
                    self.add(*point)
            else:
                self.add_chunk(x[at : at + size], y[at : at + size])
            self.total += min(size, len(x) - at)
            at += size

    def add_chunk(self, x: np.ndarray, y: np.ndarray) -> None:
        """add() each of a few points, next to those added before.

        A point moves a centre of n points by less than limit / (n + 1), so that a centre can't leave the circle around its place
        that all points of the chunk that can reach it make. A point that is nearer to its first centre than the limit wherever
        in that circle the centre is, and farther from all before it, is decided; the others are tried one by one.
        """
        found, limit = self.found, self.limit
        cx, cy, n = np.array(found).T
        far = (x[:, None] - cx) ** 2 + (y[:, None] - cy) ** 2
        moved = limit * len(x) / (n + 1)
        for _ in range(2):
            moved = limit * (far < ((limit + moved) * 1.000001) ** 2).sum(0) / (n + 1)
        reach = far < ((limit + moved) * 1.000001) ** 2
        first = reach.argmax(1)
        inner = np.maximum(limit - moved, 0) * 0.999999
        here = np.arange(len(x))
        first[~(reach[here, first] & (far[here, first] < inner[first] ** 2))] = -1
        if 3 * (first < 0).sum() > len(x):
            self.singly = 16 * len(x)  # before chunks are tried again
        for k, px, py in zip(first.tolist(), x.tolist(), y.tolist()):
            if k < 0:
                for c in found:
                    if math.hypot(c[0] - px, c[1] - py) < limit:
                        break
                else:
                    found.append([px, py, 1])
                    continue
            else:
                c = found[k]
            c[2] += 1
            c[0] += (px - c[0]) / c[2]
            c[1] += (py - c[1]) / c[2]
        self.fill()


#: Boxes of a song in one round of clustering, and frames that stay in one round together.
ROUND, TOGETHER = 1 << 22, 4096
#: Tasks at least that the songs of a round are dealt to, so that few of them share one.
DEALT = 64
#: Numbers of rows that are no centre: a song's own, before its centres, and boxes, after them.
HEAD, BOX = -1, 2**31 - 1
#: Shares of a song's rows where all of them meet the song's own few rows.
SHARES = 64


def with_song(rows: DataFrame, songs: DataFrame, keys: list[str], frame: str = "frame") -> DataFrame:
    """`rows` with the columns of `songs` (a few rows for each of the keys), joined in SHARES shares of a song's frames, so
    that the rows of a few long songs are many tasks."""
    few = songs.withColumn("__share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SHARES - 1).cast("long"))))
    return rows.withColumn("__share", F.pmod(F.xxhash64(frame), F.lit(SHARES).cast("long"))).join(few, [*keys, "__share"]).drop("__share")


def in_rounds(rows: DataFrame, keys: list[str], size: int) -> list[DataFrame]:
    """The rows in rounds of about `size` a song, in the order of their frames; as they are if one is enough."""
    block = F.floor(F.col("frame") / TOGETHER).alias("__block")
    counts = rows.groupBy(*keys, block).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per block
    rounds = kept(counts.select(*keys, "__block", F.floor(before / size).alias("__round")))
    numbers = sorted(r[0] for r in rounds.select("__round").distinct().collect())
    if len(numbers) < 2:
        return [rows]
    path = scratch(rows.sparkSession)
    dealt = rows.withColumn("__block", block).join(rounds.hint("merge"), [*keys, "__block"]).drop("__block")
    dealt.repartition("__round", *keys).write.option("compression", "zstd").partitionBy("__round").parquet(path)
    table = rows.sparkSession.read.schema(dealt.schema).parquet(path)
    return [table.filter(F.col("__round") == n).select(*rows.columns) for n in numbers]


def values(column: pa.Array) -> np.ndarray:
    """The column's values; objects where some are null or they are no numbers."""
    return np.array([*column.to_pylist(), None], object)[:-1] if column.null_count else column.to_numpy(zero_copy_only=False)


def cluster_centers(detections: DataFrame, thresholds: DataFrame, keys: list[str], share: float = 0.66, frames: DataFrame | None = None, size: int = ROUND) -> DataFrame:
    """Clusters of box centres (center, x, y, count) found in more than `share` of the song's frames.

    In (frame, subj) order a box joins the first cluster within the radius, whose running mean it moves, or makes a new one.
    `frames` (keys, frame) has all frames of the songs; without it those count that have a box. The order decides, so a
    song's boxes pass through one task after another, in rounds of about `size` boxes and sorted batches: a task holds a round
    and the centres, never the song. Boxes without centre are skipped.
    """
    rows = with_centers(detections).filter(F.col("cx").isNotNull() & F.col("cy").isNotNull() & ~F.isnan("cx") & ~F.isnan("cy"))
    rows = rows.select(*keys, "frame", "subj", F.col("cx").cast("double").alias("cx"), F.col("cy").cast("double").alias("cy"))
    limits = thresholds.select(*keys, F.col("radius").cast("double").alias("radius"))
    if frames is not None:
        limits = kept(limits.join(frames.groupBy(*keys).agg(F.countDistinct("frame").alias("total")), keys))
    # rows of a song in this order: one (HEAD) with its last frame, radius and frames so far, its centres by number, and boxes;
    # all flat, as Spark hands nested columns to Python in time that grows with the square of a batch
    number, none = F.lit(0.0).alias("n"), F.lit(None)
    states = limits.select(*keys, F.lit(HEAD).alias("at"), none.cast(rows.schema["frame"].dataType).alias("frame"), F.col("radius").alias("cx"), F.lit(0.0).alias("cy"), number)
    rows = rows.select(*keys, F.lit(BOX).alias("at"), "frame", "cx", "cy", number, "subj")
    schema, of_key = states.schema, len(keys)
    types = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = leaders = frame = None
        radius, seen, found = 0.0, 0, []

        def closed() -> pa.RecordBatch:
            after = (leaders or Leaders(radius, found)).found
            table = [(*key, HEAD, frame, radius, 0.0, float(seen)), *((*key, k, None, x, y, float(n)) for k, (x, y, n) in enumerate(after))]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*table), types.types)], schema=types)

        for batch in batches:
            if not batch.num_rows:
                continue
            at, frames, x, y, n = (values(c) for c in batch.columns[of_key:])
            new = at != BOX
            new[1:] |= new[:-1]
            new[0] = True
            for c in batch.columns[:of_key]:
                v = values(c)
                new[1:] |= v[1:] != v[:-1]
            starts = np.flatnonzero(new).tolist()
            for a, b in zip(starts, [*starts[1:], batch.num_rows]):
                k = tuple(c[a].as_py() for c in batch.columns[:of_key])
                if at[a] == HEAD:
                    if key is not None:
                        yield closed()
                    key, leaders, found = k, None, []
                    frame, radius, seen = batch.column(of_key + 1)[a].as_py(), float(x[a]), int(n[a])
                elif k != key:  # a song without limits has no clusters
                    continue
                elif at[a] != BOX:
                    found.append([float(x[a]), float(y[a]), int(n[a])])
                else:
                    leaders = leaders or Leaders(radius, found)
                    f = frames[a:b]
                    seen += int(f[0] != frame) + int((f[1:] != f[:-1]).sum())
                    frame = f[-1:].tolist()[0]
                    leaders.add_all(x[a:b], y[a:b])
        if key is not None:
            yield closed()

    tasks = max(DEALT, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    for part in in_rounds(rows, keys, size):
        both = states.withColumn("subj", none.cast(rows.schema["subj"].dataType)).unionByName(part)
        both = both.repartition(tasks, *keys).sortWithinPartitions(*keys, "at", "frame", "subj").drop("subj")
        states = kept(both.mapInArrow(run, schema))
    seen = states.filter(F.col("at") == HEAD).select(*keys, F.col("n").alias("__seen"))
    if frames is not None:
        seen = seen.join(limits.select(*keys, "total"), keys).select(*keys, F.col("total").cast("double").alias("__seen"))
    found = states.filter(F.col("at") != HEAD).join(seen, keys).filter(F.col("n") > share * F.col("__seen"))
    return found.select(*keys, F.col("at").cast("long").alias("center"), F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("n").cast("long").alias("count"))


def drop_high_outliers(centers: DataFrame, thresholds: DataFrame, keys: list[str]) -> DataFrame:
    """Of songs with several centres, without those far above the others (small y)."""
    stats = centers.groupBy(*keys).agg(F.percentile("y", [0.5, 0.75]).alias("__q"), F.stddev_pop("y").alias("__d"), F.count("*").alias("__n"))
    both = centers.join(stats, keys).join(thresholds.select(*keys, "height"), keys)
    limit = F.least("height", F.greatest(F.lit(50.0), 1.5 * F.col("__d")))
    high = (F.col("y") < F.element_at("__q", 1) - limit) | (F.col("y") < F.element_at("__q", 2) - 0.8 * limit)
    return both.filter((F.col("__n") <= 1) | ~high).select(*centers.columns)


def pick_performers(centers: DataFrame, songs: DataFrame, keys: list[str]) -> DataFrame:
    """The lowest centres on screen, as many as the layout has names, named from left to right; `complete` is false
    where there are fewer centres than names."""
    rows = centers.join(songs.select(*keys, "layout"), keys)
    low = Window.partitionBy(*keys).orderBy(F.desc("y"), "x", "center")
    rows = rows.withColumn("__r", F.row_number().over(low)).filter(F.col("__r") <= F.size("layout"))
    left = Window.partitionBy(*keys).orderBy("x", "y", "center")
    count = F.count("*").over(Window.partitionBy(*keys))
    rows = rows.withColumns({"__r": F.row_number().over(left), "complete": count == F.size("layout")})
    return rows.withColumn("instrument", F.element_at("layout", F.col("__r"))).select(*keys, "instrument", "center", "x", "y", "complete")


def assign_nearest(detections: DataFrame, performers: DataFrame, thresholds: DataFrame, keys: list[str], values: list[str], frames: DataFrame | None = None) -> DataFrame:
    """For each performer and frame the `values` of the box whose nearest centre it is, within the radius.

    Of several boxes the last subject wins; frames without one have nulls. `frames` (keys, frame) has all frames, those
    without any box too; without it the frames are those of the boxes.
    """
    goals = performers.groupBy(*keys).agg(F.collect_list(F.struct("x", "y", "instrument")).alias("__goals")).join(thresholds.select(*keys, "radius"), keys)
    near = with_song(with_centers(detections), goals, keys)
    away = F.transform("__goals", lambda g: F.struct(distance(F.col("cx"), F.col("cy"), g["x"], g["y"]).alias("d"), g["x"].alias("x"), g["instrument"].alias("instrument")))
    best = near.select(*keys, "frame", "subj", *values, "radius", F.array_min(away).alias("__best")).filter(F.col("__best.d") < F.col("radius"))
    won = best.groupBy(*keys, F.col("__best.instrument").alias("instrument"), "frame").agg(F.max_by(F.struct(*values), "subj").alias("__v"))
    spine = with_song((detections if frames is None else frames).select(*keys, "frame").distinct(), performers.select(*keys, "instrument"), keys)
    return spine.join(won, [*keys, "instrument", "frame"], "left").select(*keys, "instrument", "frame", *(F.col(f"__v.{v}").alias(v) for v in values))


def build_tracks(detections: DataFrame, songs: DataFrame, keys: list[str], values: list[str], frames: DataFrame | None = None, share: float = 0.66) -> DataFrame:
    """One row per (song, instrument, frame), of songs with a layout and a camera that doesn't move.

    `frames` (keys, frame) has all frames of the songs, those without a box too.
    """
    usable = songs.filter(F.col("layout").isNotNull() & ~F.coalesce("moving_camera", F.lit(False)))
    boxes = kept(with_song(detections, usable.select(*keys).distinct(), keys))
    limits = kept(adaptive_thresholds(boxes, keys))
    centers = drop_high_outliers(cluster_centers(boxes, limits, keys, share, frames), limits, keys)
    return assign_nearest(boxes, pick_performers(centers, usable, keys), limits, keys, values, frames)


def face_false_positives(face: DataFrame, body: DataFrame, track: list[str], limit: float = 120.0) -> DataFrame:
    """Intervals of frames where the mean of the face's points is over `limit` from the body's nose (point 0).

    face: track, frame, pts; body: track, frame, kp. Adds `frames` and `intervals` of the track under their true names.
    """
    mean = lambda axis: F.aggregate("pts", F.lit(0.0), lambda t, p: t + p[axis]) / F.size("pts")
    nose = F.element_at("kp", 1)
    both = face.join(body.select(*track, "frame", "kp"), [*track, "frame"])
    both = both.withColumn("__d", distance(mean("x"), mean("y"), nose["x"], nose["y"]))
    found = islands(both, track, ~F.isnan("__d") & (F.col("__d") > limit))
    whole = Window.partitionBy(*track)
    return found.withColumns({"intervals": F.count("*").over(whole), "frames": F.sum(F.col("end") - F.col("start") + 1).over(whole)})
