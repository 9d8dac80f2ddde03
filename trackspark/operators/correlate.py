"""How two signals move together: sliding and lagged correlation, strong windows, counts and shares."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import above, moments, number, pearson, pearson_p
from . import blocks


def align(motion: DataFrame, audio: DataFrame, track: list[str], frame: str = "frame") -> DataFrame:
    """Pairs by frame, of tracks that have as many motion as audio frames."""
    sizes = [df.groupBy(*track).agg(F.countDistinct(frame).alias("__n")) for df in (motion, audio)]
    same = sizes[0].join(sizes[1], [*track, "__n"]).drop("__n")
    return motion.join(same, track, "left_semi").join(audio, [*track, frame])


def feature_pairs(motion: DataFrame, audio: DataFrame, track: list[str], frame: str = "frame") -> DataFrame:
    """Every motion feature with every audio feature of the track: motion_feature, audio_feature, x, y."""
    m = motion.select(*track, frame, F.col("feature").alias("motion_feature"), F.col("value").alias("x"))
    a = audio.select(*track, frame, F.col("feature").alias("audio_feature"), F.col("value").alias("y"))
    return align(m, a, track, frame)


def merge_feature_sets(specific: DataFrame, general: DataFrame, audio: DataFrame, track: list[str], mode: str = "both") -> DataFrame:
    """The motion features of a mode (instrument, generic, both; prefixed if both) of tracks that have audio."""
    named = lambda df, p: df.withColumn("feature", F.concat(F.lit(p + "::"), "feature"))
    chosen = {"instrument": lambda: specific, "generic": lambda: general, "both": lambda: named(specific, "instrument").unionByName(named(general, "general"))}
    return chosen[mode]().join(audio.select(*track).distinct(), track, "left_semi")


def sliding_corr(pairs: DataFrame, keys: list[str], x: str = "x", y: str = "y", win: int = 15, step: int = 3, fps: float = 30.0, threshold: float = 0.3, alpha: float = 0.05, frame: str = "frame", block: int = blocks.BLOCK) -> DataFrame:
    """Pearson r of each window of `win` frames, every `step` frames: start, time, n, r, p, strong.

    Frames are 0..n-1 in each key. Rows where a side is NaN don't count; r is null under two rows or for a constant.
    Each frame is aggregated once, into panes of gcd(win, step) frames, and windows add up panes. Rows are shuffled once,
    by key and block of frames; a block has the frames too that its last windows need, and its values are centred on its
    mean first.
    """
    if not 0 < step or not 1 < win:
        raise ValueError("win must be over 1 and step over 0; for low frame rates give a longer step")
    pane, given = math.gcd(win, step), keys
    block = -(-max(block, win) // step) * step
    keys = [*keys, "__block"]
    whole = Window.partitionBy(*keys)
    centred = blocks.halo(pairs, 0, win, block, frame).select(
        *keys, frame, (F.col(x) - F.avg(number(x)).over(whole)).alias("__x"), (F.col(y) - F.avg(number(y)).over(whole)).alias("__y"),
    )
    panes = centred.groupBy(*keys, F.expr(f"{frame} div {pane}").alias("__pane")).agg(*moments(F.col("__x"), F.col("__y")), F.count("*").alias("__rows"))
    ahead = whole.orderBy("__pane").rowsBetween(0, win // pane - 1)
    sums = {c: F.coalesce(F.sum(c).over(ahead), F.lit(0)) for c in ("n", "sx", "sy", "sxx", "syy", "sxy", "__rows")}
    starts_here = blocks.block_of("__pane", block // pane) == F.col("__block")
    windows = panes.withColumns(sums).filter((F.col("__rows") == win) & (F.col("__pane") % (step // pane) == 0) & starts_here)
    windows = windows.select(*given, (F.col("__pane") * pane).alias("start"), (F.col("__pane") * pane / F.lit(float(fps))).alias("time"), "n", pearson().alias("r"))
    return windows.withColumn("p", pearson_p("r", "n")).withColumn("strong", F.coalesce((F.col("p") < alpha) & (F.abs("r") > threshold), F.lit(False)))


def masked_sliding_corr(pairs: DataFrame, keys: list[str], mask_columns: list[str], win: int = 15, frame: str = "frame", **parameters) -> DataFrame:
    """sliding_corr() after frames with NaN in a mask column are dropped and the time axis is closed up."""
    known = F.lit(True)
    for c in mask_columns:
        known &= ~F.isnan(c)
    return sliding_corr(blocks.close_up(pairs.filter(known), keys, frame=frame), keys, win=win, frame=frame, **parameters)


def lagged_products(win: int, max_lag: int, least: float):
    """A column of the sums of x[n + lag] * y[n], -max_lag to max_lag, of a window's z-scored values (arrays x, y); null
    where a deviation is under `least`. A batch of windows is one product of transforms, padded so that no lag wraps."""
    size = 1 << (win + max_lag - 1).bit_length()

    @F.pandas_udf("array<double>")
    def lags(x: pd.Series, y: pd.Series) -> pd.Series:
        a, b = (np.stack(s.to_list()).astype(float) for s in (x, y))
        da, db = a.std(1), b.std(1)
        good = (da >= least) & (db >= least)
        a, b = ((v[good] - v[good].mean(1, keepdims=True)) / d[good, None] for v, d in ((a, da), (b, db)))
        found = np.fft.irfft(np.fft.rfft(a, size) * np.fft.rfft(b, size).conj(), size)
        out = pd.Series([None] * len(x), dtype=object)
        out[np.flatnonzero(good)] = list(np.concatenate((found[:, size - max_lag :], found[:, : max_lag + 1]), axis=1))
        return out

    return lags


def cross_corr_windows(pairs: DataFrame, keys: list[str], x: str = "x", y: str = "y", win: int = 150, max_lag: int = 30, least: float = 1e-6, frame: str = "frame") -> DataFrame:
    """window, lag, c = sum of x[n + lag] * y[n] over tumbling windows of z-scored values; positive lag: x after y.

    Windows that are not full, where a value is missing or a side's deviation is under `least` are skipped. A window goes
    once to the transform, as two arrays, and comes back as its lags.
    """
    if max_lag > win - 1:
        raise ValueError("max_lag must be under win")
    whole = (number(x).isNotNull() & number(y).isNotNull()).alias("__known")
    rows = pairs.select(*keys, F.expr(f"{frame} div {win}").alias("window"), frame, F.col(x).cast("double").alias("a"), F.col(y).cast("double").alias("b"), whole).filter("__known")
    rows = rows.groupBy(*keys, "window").agg(F.array_sort(F.collect_list(F.struct(frame, "a", "b"))).alias("s")).filter(F.size("s") == win)
    lags = lagged_products(win, max_lag, least)(F.transform("s", lambda v: v["a"]), F.transform("s", lambda v: v["b"]))
    rows = rows.select(*keys, "window", lags.alias("c")).filter("c is not null")
    return rows.select(*keys, "window", F.posexplode("c").alias("lag", "c")).withColumn("lag", (F.col("lag") - max_lag).cast("int"))


def global_corr(pairs: DataFrame, keys: list[str], x: str = "x", y: str = "y", min_r: float = 0.25, alpha: float = 0.05) -> DataFrame:
    """One r and p per key; those with r > min_r and p < alpha."""
    whole = Window.partitionBy(*keys)
    centred = pairs.select(*keys, (F.col(x) - F.avg(number(x)).over(whole)).alias("__x"), (F.col(y) - F.avg(number(y)).over(whole)).alias("__y"))
    found = centred.groupBy(*keys).agg(*moments(F.col("__x"), F.col("__y"))).select(*keys, "n", pearson().alias("r")).withColumn("p", pearson_p("r", "n"))
    return found.filter((F.col("r") > min_r) & (F.col("p") < alpha))


def chunk_counts(events: DataFrame, keys: list[str], chunk_s: float = 4.0, time: str = "time") -> DataFrame:
    """Strong windows in each chunk of `chunk_s` seconds."""
    return events.groupBy(*keys, F.floor(F.col(time) / chunk_s).alias("chunk")).agg(F.count("*").alias("count"))


def strong_events(windows: DataFrame, keys: list[str]) -> DataFrame:
    """time and correlation of the strong windows, sorted by time within partitions of the keys."""
    return windows.filter("strong").select(*keys, "time", F.col("r").alias("correlation")).repartition(*keys).sortWithinPartitions(*keys, "time")


def strong_counts_by_part(windows: DataFrame, keys: list[str], min_abs: float = 0.66) -> DataFrame:
    """Windows with |r| over min_abs by the rollup of `keys` (null: all of a level)."""
    return windows.rollup(*keys).agg(F.count(F.when(above(F.abs("r"), min_abs), 1)).alias("strong"), F.count("*").alias("windows"))


def share(strong: Column, total: Column) -> Column:
    return F.coalesce(F.try_divide(strong * 100.0, total), F.lit(0.0))


def strong_share(windows: DataFrame, group: str, motion: str, audio: str) -> DataFrame:
    """Percent of strong windows by (group, motion, audio), by (group, audio) and by audio feature."""
    sets = [[F.col(group), F.col(motion), F.col(audio)], [F.col(group), F.col(audio)], [F.col(audio)]]
    strong = F.count(F.when(F.col("strong"), 1))
    return windows.groupingSets(sets, group, motion, audio).agg(strong.alias("strong"), F.count("*").alias("total"), share(strong, F.count("*")).alias("pct"))


def compare_share(shares: DataFrame, group: str, audio: str, specific: str, general: str) -> DataFrame:
    """For each audio feature, whether the specific or the general group has the higher share."""
    wide = shares.groupBy(audio).pivot(group, [specific, general]).agg(F.first("pct"))
    s, g = F.coalesce(F.col(f"`{specific}`"), F.lit(0.0)), F.coalesce(F.col(f"`{general}`"), F.lit(0.0))
    return wide.select(audio, s.alias("specific"), g.alias("general"), F.when(s > g, "specific").when(s < g, "general").otherwise("equal").alias("higher"))


def track_corr_summary(windows: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and greatest r (NaN and null skipped), strong windows and their percent."""
    strong = F.count(F.when(F.col("strong"), 1))
    return windows.groupBy(*keys).agg(F.avg(number("r")).alias("mean_r"), F.max(number("r")).alias("max_r"), strong.alias("strong"), share(strong, F.count("*")).alias("pct_strong"))


def better_feature(summary: DataFrame, keys: list[str], audio: str = "audio_feature", prefer: str = "onset_env") -> DataFrame:
    """The audio feature with the higher mean r; ties go to `prefer`."""
    order = F.struct(F.col("mean_r"), (F.col(audio) == prefer).cast("int"), F.col(audio))
    return summary.groupBy(*keys).agg(F.max_by(audio, order).alias("better"))


def lag_profile(cross: DataFrame, group: str, pair: str) -> DataFrame:
    """Mean and population deviation of c per lag, for each group and over all (null group), with the best lag marked."""
    sets = [[F.col(group), F.col(pair), F.col("lag")], [F.col(pair), F.col("lag")]]
    found = cross.groupingSets(sets, group, pair, "lag").agg(F.avg("c").alias("mean_c"), F.stddev_pop("c").alias("std_c"), F.count("*").alias("windows"))
    order = Window.partitionBy(group, pair).orderBy(F.desc(F.abs("mean_c")), "lag")
    return found.withColumn("best", F.row_number().over(order) == 1)


def correlated_parts(frames: DataFrame, windows: DataFrame, track: list[str], span_s: float = 2.0, fps: float = 30.0, frame: str = "frame") -> DataFrame:
    """For each frame, the parts with a strong window at time w where w*fps <= frame < (w+span)*fps.

    Both sides meet in buckets of one second of frames, so that the range is an equi-join and a filter.
    """
    size = max(1, round(fps))
    first, last = F.ceil(F.col("time") * fps), F.ceil((F.col("time") + span_s) * fps) - 1
    spans = windows.filter("strong").withColumns({"__first": first, "__last": last})
    spans = spans.withColumn("__bucket", F.explode(F.sequence(F.floor(F.col("__first") / size), F.floor(F.col("__last") / size))))
    rows = frames.withColumn("__bucket", F.floor(F.col(frame) / size))
    hit = rows.join(spans.select(*track, "part", "__bucket", "__first", "__last"), [*track, "__bucket"]).filter(F.col(frame).between(F.col("__first"), F.col("__last")))
    return hit.groupBy(*track, frame).agg(F.array_sort(F.collect_set("part")).alias("parts"))
