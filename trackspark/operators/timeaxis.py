"""Operators along a track's frames.

Smoothing and gradients look a few frames either way: a chain of them on one track key plans with one shuffle and one
sort, and blocks.in_blocks() runs the same chain on blocks of long tracks. Gaps and runs of any length are found in blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import nan, elementwise, moments, number, pearson, savgol_weights
from . import blocks


def over(track: list[str], frame: str):
    return Window.partitionBy(*track).orderBy(frame)


def is_array(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.ArrayType)


def smooth(df: DataFrame, track: list[str], columns: list[str], win: int = 5, poly: int = 2, frame: str = "frame") -> DataFrame:
    """Savitzky-Golay over the frames of a track, for number or array columns; ends repeat, NaN spoils what it touches."""
    if win % 2 == 0 or poly >= win:
        raise ValueError("win must be odd and greater than poly")
    order, whole = over(track, frame), over(track, frame).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    half, weights = win // 2, savgol_weights(win, poly)
    for c in columns:
        names = [f"__{c}_{k}" for k in range(win)]
        near = [F.coalesce(F.lag(c, half - k).over(order), (F.first(c) if k < half else F.last(c)).over(whole)) for k in range(win)]
        df = df.withColumns(dict(zip(names, near)))
        value = elementwise(lambda *v: sum((x * w for x, w in zip(v[1:], weights[1:])), v[0] * weights[0]), *map(F.col, names), is_array=is_array(df, c))
        df = df.withColumn(c, value).drop(*names)
    return df


def gradient(df: DataFrame, track: list[str], columns: dict[str, str], fps: float | str = 1.0, frame: str = "frame") -> DataFrame:
    """For {new: old}, central differences times fps, one-sided at both ends; NaN for a track of one frame."""
    order = over(track, frame)
    rate = F.col(fps) if isinstance(fps, str) else F.lit(float(fps))
    for new, old in columns.items():
        df = df.withColumns({"__before": F.lag(old).over(order), "__after": F.lead(old).over(order)})

        def slope(here: Column, before: Column, after: Column) -> Column:
            inner = (after - before) / 2
            return F.coalesce(inner, after - here, here - before, nan()) * rate

        array = is_array(df, old)
        if array:
            blank = F.transform(F.col(old), lambda x: F.lit(None).cast("double"))
            df = df.withColumns({"__before": F.coalesce("__before", blank), "__after": F.coalesce("__after", blank)})
        df = df.withColumn(new, elementwise(slope, F.col(old), F.col("__before"), F.col("__after"), is_array=array)).drop("__before", "__after")
    return df


def speed_acceleration(df: DataFrame, track: list[str], x: str = "x", y: str = "y", fps: float | str = 1.0, frame: str = "frame") -> DataFrame:
    """Adds `speed` and `acceleration`, the norms of the first and second gradient of (x, y), numbers or arrays."""
    df = gradient(df, track, {"__vx": x, "__vy": y}, fps, frame)
    df = gradient(df, track, {"__ax": "__vx", "__ay": "__vy"}, fps, frame)
    norm = lambda a, b: F.sqrt(a * a + b * b)
    array = is_array(df, x)
    out = {"speed": elementwise(norm, F.col("__vx"), F.col("__vy"), is_array=array), "acceleration": elementwise(norm, F.col("__ax"), F.col("__ay"), is_array=array)}
    return df.withColumns(out).drop("__vx", "__vy", "__ax", "__ay")


def fill_nan_frames(df: DataFrame, track: list[str], columns: list[str], frame: str = "frame", block: int = blocks.BLOCK) -> DataFrame:
    """Where all `columns` are NaN, the midpoint of the previous and next frame that isn't, or the one that exists."""
    missing = F.lit(True)
    for c in columns:
        missing &= F.isnan(c) | F.isnull(c)
    df = df.withColumn("__missing", missing)
    known = {f"__{c}": F.when(~F.col("__missing"), F.col(c)) for c in columns}
    df = blocks.neighbours_known(df, track, known, block, frame)
    out = {}
    for c in columns:
        before, after = F.col(f"__{c}_before"), F.col(f"__{c}_after")
        out[c] = F.when(F.col("__missing"), F.coalesce((before + after) / 2, before, after, F.col(c))).otherwise(F.col(c))
    return df.withColumns(out).drop("__missing", *(f"__{c}_{side}" for c in columns for side in ("before", "after")))


def grid(df: DataFrame, track: list[str], position: Column, length: str = "__m", frame: str = "frame", value: str | list[str] = "value") -> DataFrame:
    """Linear interpolation of dense series (frames 0..n-1), one or several columns, at `position`s of `length` new frames
    (columns __n, __m)."""
    values = [value] if isinstance(value, str) else value
    spine = df.groupBy(*track).agg(F.count("*").alias("__n"), F.first(length).alias("__m")).filter("__m > 0")
    spine = spine.select(*track, "__n", "__m", F.explode(F.sequence(F.lit(0), F.col("__m").cast("int") - 1)).alias("__k"))
    spine = spine.withColumn("__p", position)
    spine = spine.withColumn("__i", F.greatest(F.lit(0), F.least(F.floor("__p"), F.col("__n") - 2)).cast("long"))
    series = df.select(*track, F.col(frame).cast("long").alias("__i"), *(F.col(v).alias(f"__a_{v}") for v in values))
    after = series.select(*track, (F.col("__i") - 1).alias("__i"), *(F.col(f"__a_{v}").alias(f"__b_{v}") for v in values))
    out = spine.join(series, [*track, "__i"]).join(after, [*track, "__i"], "left")
    share = F.col("__p") - F.col("__i")

    def mixed(v: str) -> Column:
        a, b = F.col(f"__a_{v}"), F.col(f"__b_{v}")
        return F.when(b.isNull() | (share == 0), a).otherwise(a + (b - a) * share).alias(v)

    return out.select(*track, F.col("__k").alias(frame), *map(mixed, values))


def resample_endpoint(df: DataFrame, track: list[str], target_n: str | int, frame: str = "frame", value: str = "value") -> DataFrame:
    """Onto `target_n` points that include both ends (a number, or a column that is constant in a track)."""
    length = F.col(target_n) if isinstance(target_n, str) else F.lit(target_n)
    place = F.when(F.col("__m") > 1, F.col("__k") * (F.col("__n") - 1) / (F.col("__m") - 1)).otherwise(0.0)
    return grid(df.withColumn("__m", length), track, place, frame=frame, value=value)


def resample_rate(df: DataFrame, track: list[str], from_fps: str, to_fps: float = 30.0, frame: str = "frame", value: str | list[str] = "value") -> DataFrame:
    """Onto to_fps, int(n / from_fps * to_fps) points of one or several columns; positions past the last sample extend the
    last segment. A track at to_fps stays as it is, one without rate goes."""
    count, fps = F.count("*"), F.first(from_fps)
    rate = df.groupBy(*track).agg(F.when(fps == to_fps, count).otherwise(count / fps * to_fps).cast("int").alias("__m"), fps.alias("__f"))
    rated = df.drop(from_fps).join(rate, track)
    place = F.col("__k") * (F.col("__n") / F.col("__m"))
    return grid(rated, track, place, frame=frame, value=value)


def interp_corr(a: DataFrame, b: DataFrame, track: list[str], frame: str = "frame", value: str = "value") -> DataFrame:
    """Pearson r of a with b brought to a's length, both over the unit interval; null where either is constant."""
    sizes = a.groupBy(*track).agg(F.count("*").alias("__len"))
    other = resample_endpoint(b.join(sizes, track), track, "__len", frame, value).withColumnRenamed(value, "__other")
    both = a.join(other, [*track, frame])
    return both.groupBy(*track).agg(*moments(F.col(value), F.col("__other"))).select(*track, pearson().alias("r"))


def islands(df: DataFrame, track: list[str], flag: Column, frame: str = "frame", block: int = blocks.BLOCK) -> DataFrame:
    """Runs of consecutive flagged frames as inclusive intervals (start, end)."""
    return blocks.stitched_runs(df, track, flag, block, frame)


def robust_scale(df: DataFrame, track: list[str], value: str = "value", low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Clip to percentiles of the track and scale to 0..1; NaN counts as 0; a constant track stays as it is."""
    df = df.withColumn(value, F.nanvl(F.col(value), F.lit(0.0)))
    edges = df.groupBy(*track).agg(F.percentile(value, [low, high]).alias("__q"), F.min(value).alias("__min"), F.max(value).alias("__max"))
    least, most = F.greatest(F.element_at("__q", 1), F.col("__min")), F.least(F.element_at("__q", 2), F.col("__max"))
    clipped = F.greatest(least, F.least(most, F.col(value)))
    scaled = F.when(most > least, F.try_divide(clipped - least, most - least)).otherwise(F.col(value))
    return df.join(edges, track).withColumn(value, scaled).drop("__q", "__min", "__max")


def part_means(df: DataFrame, keys: list[str], parts: DataFrame, values: list[str], kp: str = "kp", whole: str = "general") -> DataFrame:
    """NaN-skipping means of `values` over each part's points (bridge: part, kp) and over all points as part `whole`."""
    means = [F.coalesce(F.avg(number(v)), nan()).alias(v) for v in values]
    by_part = df.join(parts, kp).groupBy(*keys, "part").agg(*means)
    return df.groupBy(*keys).agg(*means).withColumn("part", F.lit(whole)).unionByName(by_part)
