"""Statistics of modulation matrices (chunk, t, f, gamma, beta) and of distributions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import ks_p, moments, number, pearson
from .ranks import counts_before, mean_ranks, percentiles, range_starts, value_ranges


def finite(c: str) -> Column:
    x = F.col(c)
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")), x)


def sanitize_matrix(values: DataFrame, chunk: list[str], column: str) -> DataFrame:
    """Non-finite values become the median of the chunk's finite ones; chunks with under half finite go.

    Adds finite_share and max_abs.
    """
    stats = values.groupBy(*chunk).agg((F.count(finite(column)) / F.count("*")).alias("finite_share"), F.percentile(finite(column), 0.5).alias("__m"), F.max(F.abs(finite(column))).alias("max_abs"))
    return values.join(stats.filter("finite_share >= 0.5"), chunk).withColumn(column, F.coalesce(finite(column), "__m")).drop("__m")


def spread(c: Column, name: str) -> list[Column]:
    return [F.avg(c).alias(f"{name}_mean"), F.stddev_pop(c).alias(f"{name}_std"), F.min(c).alias(f"{name}_min"), F.max(c).alias(f"{name}_max"), F.percentile(c, 0.5).alias(f"{name}_median")]


def modulation_stats(values: DataFrame, chunk: list[str]) -> DataFrame:
    """Of each chunk: scale (1 + gamma) and bias (beta) spreads, |gamma| mean, deviation and percentiles, and sums."""
    size = F.abs("gamma")
    q = [0.5, 0.75, 0.9, 0.95, 0.99]
    aggs = spread(F.col("gamma") + 1, "scale") + spread(F.col("beta"), "bias") + [F.avg(size).alias("gamma_mean"), F.stddev_pop(size).alias("gamma_std")]
    aggs += [F.percentile(size, q)[i].alias(f"gamma_p{round(p * 100)}") for i, p in enumerate(q)]
    aggs += [F.sum(size).alias("gamma_intensity"), F.sum(F.abs("beta")).alias("beta_intensity")]
    return values.groupBy(*chunk).agg(*aggs)


def feature_modulation(values: DataFrame, chunk: list[str]) -> DataFrame:
    """Of each feature of a chunk the mean and deviation of scale and bias, and whether its mean is beyond one
    population deviation of the chunk's features."""
    rows = values.groupBy(*chunk, "f").agg(F.avg(F.col("gamma") + 1).alias("scale_mean"), F.stddev_pop("gamma").alias("scale_std"), F.avg("beta").alias("bias_mean"), F.stddev_pop("beta").alias("bias_std"))
    whole = Window.partitionBy(*chunk)
    out = {}
    for c, high, low in (("scale_mean", "boosted", "suppressed"), ("bias_mean", "bias_up", "bias_down")):
        mean, dev = F.avg(c).over(whole), F.stddev_pop(c).over(whole)
        out |= {high: F.col(c) > mean + dev, low: F.col(c) < mean - dev}
    return rows.withColumns(out)


def relative_change(values: DataFrame, chunk: list[str], a: str, q: str, floor: float = 0.01, clip: float = 50.0, small: float = 0.01) -> DataFrame:
    """(q - a) / max(|a|, floor), clipped: mean size, 95th percentile of it, share under `small`."""
    change = F.greatest(F.lit(-clip), F.least(F.lit(clip), (F.col(q) - F.col(a)) / F.greatest(F.abs(a), F.lit(floor))))
    size = F.abs(change)
    return values.groupBy(*chunk).agg(F.avg(size).alias("mean_change"), F.percentile(size, 0.95).alias("p95_change"), F.avg(F.when(size < small, 1.0).otherwise(0.0)).alias("unchanged_share"))


def attention_focus_corr(attention: DataFrame, gamma: DataFrame, chunk: list[str], eps: float = 1e-12) -> DataFrame:
    """Pearson r over steps t of mean |gamma| with the negative entropy of attention (chunk, head, t, j, w) averaged
    over heads; null where either is constant."""
    heads = attention.groupBy(*chunk, "t", "j").agg(F.avg("w").alias("w"))
    w = F.greatest("w", F.lit(eps))
    focus = heads.groupBy(*chunk, "t").agg(F.sum(w * F.log(w)).alias("focus"))
    steps = gamma.groupBy(*chunk, "t").agg(F.avg(F.abs("gamma")).alias("size"))
    both = focus.join(steps, [*chunk, "t"])
    return both.groupBy(*chunk).agg(*moments(F.col("size"), F.col("focus"))).select(*chunk, pearson().alias("r"))


def explode_feature_means(records: DataFrame, keys: list[str], scale: str, bias: str) -> DataFrame:
    """keys, feature_idx, gamma (scale - 1), beta and their sizes, of records that have both arrays."""
    rows = records.filter(F.col(scale).isNotNull() & F.col(bias).isNotNull()).select(*keys, F.posexplode(F.arrays_zip(F.col(scale).alias("s"), F.col(bias).alias("b"))).alias("feature_idx", "v"))
    rows = rows.select(*keys, "feature_idx", (F.col("v.s") - 1).alias("gamma"), F.col("v.b").alias("beta")).filter("gamma is not null and beta is not null")
    return rows.withColumns({"abs_gamma": F.abs("gamma"), "abs_beta": F.abs("beta")})


def describe(df: DataFrame, column: str, by: str | None = None, approx: bool = False) -> DataFrame:
    """n, mean, population deviation and p50, 75, 90, 95, 99, exact for a column or groups of any size; with `approx` in one
    pass, by sketches."""
    q = [0.5, 0.75, 0.9, 0.95, 0.99]
    keys = [by] if by else []
    aggs = [F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_pop(column).alias("std")]
    if approx:
        found = df.groupBy(*keys).agg(*aggs, F.percentile_approx(column, q, 100_000).alias("percentiles"))
    else:
        sums, places = df.groupBy(*keys).agg(*aggs), percentiles(df, keys, column, q)
        if by:
            places = places.withColumnRenamed(by, "__by")
            found = sums.join(places, sums[by].eqNullSafe(places["__by"]), "left")
        else:
            found = sums.join(places, F.lit(True), "left")  # one row each
    return found.select(*keys, "n", "mean", "std", *(F.col("percentiles")[i].alias(f"p{round(p * 100)}") for i, p in enumerate(q)))


def fd_histogram(df: DataFrame, column: str, bins: int | None = None) -> DataFrame:
    """bin, low, count of equal-width bins; their number by Freedman and Diaconis within 10..300, else 100."""
    edges = df.agg(F.min(column).alias("low"), F.max(column).alias("high"), F.count(column).alias("n"))
    edges = edges.join(percentiles(df, [], column, [0.25, 0.75]).select(F.col("percentiles").alias("q")), F.lit(True), "left")  # one row each
    width = 2 * (F.col("q")[1] - F.col("q")[0]) / F.pow(F.col("n"), F.lit(1 / 3))
    free = F.ceil((F.col("high") - F.col("low")) / F.nullif(width, F.lit(0.0)))
    number_of = F.lit(bins) if bins else F.when(free.isNotNull(), F.greatest(F.lit(10), F.least(F.lit(300), free))).otherwise(100)
    edges = edges.select("low", "high", number_of.cast("int").alias("bins"))
    rows = df.filter(F.col(column).isNotNull()).select(F.col(column).alias("__v")).join(F.broadcast(edges))  # one row
    step = F.nullif(F.col("high") - F.col("low"), F.lit(0.0)) / F.col("bins")
    place = F.when(step.isNotNull(), F.least(F.col("bins") - 1, F.floor((F.col("__v") - F.col("low")) / step))).otherwise(0).cast("int")
    return rows.groupBy(place.alias("bin")).agg(F.first(F.col("low") + place * F.coalesce(step, F.lit(0.0))).alias("low"), F.count("*").alias("count"))


def ks_two_sample(df: DataFrame, column: str, group: str, ranges: int | None = None) -> DataFrame:
    """Kolmogorov-Smirnov statistic and p-value between the first two groups by name; null and NaN values don't count.

    Both groups are counted per distinct value; the running counts come from ranges of equally many distinct values, so
    that neither outliers nor a common value send all to one task.
    """
    names = [r[0] for r in df.select(group).distinct().orderBy(group).limit(2).collect()]
    if len(names) < 2:
        return df.sparkSession.createDataFrame([], "statistic double, p double")
    rows = df.filter(F.col(column).isNotNull() & ~F.isnan(column) & F.col(group).isin(names)).select(F.col(column).alias("v"), group)
    ranged = value_ranges(rows, [], "v", {c: F.count(F.when(F.col(group) == n, 1)) for n, c in zip(names, "ab")}, ranges)
    starts = range_starts(ranged, [], ["a", "b"])
    total = starts.agg(F.sum("a_in").alias("a"), F.sum("b_in").alias("b")).first()
    if not total["a"] or not total["b"]:
        return df.sparkSession.createDataFrame([], "statistic double, p double")
    sums = counts_before(ranged, starts, [], "v", ["a", "b"])
    upto = {c: (F.col(f"{c}_before") + F.col(c)) / total[c] for c in "ab"}
    found = sums.agg(F.max(F.abs(upto["a"] - upto["b"])).alias("statistic"))
    p = F.udf(lambda d: ks_p(d, total["a"], total["b"]), "double", useArrow=True)
    return found.withColumn("p", p("statistic"))


def top_features(df: DataFrame, n: int, by: list[str], value: str = "abs_gamma") -> DataFrame:
    """The `n` keys with the largest mean of `value`."""
    return df.groupBy(*by).agg(F.avg(value).alias("mean")).orderBy(F.desc("mean"), *by).limit(n)


def rows_of_top(df: DataFrame, top: DataFrame, by: list[str]) -> DataFrame:
    return df.join(top.select(*by), by, "left_semi")


def pearson_spearman(df: DataFrame, x: str, y: str, by: str) -> DataFrame:
    """Both coefficients by `by`; ties have the mean of their ranks. A group's ranks come from several tasks (see ranks)."""
    known = df.filter(number(x).isNotNull() & number(y).isNotNull()).select(by, F.col(x).alias("x"), F.col(y).alias("y"))
    for c in "xy":
        known = known.join(mean_ranks(known, [by], c, f"r{c}"), [by, c])
    both = known.groupBy(by).agg(F.struct(*moments(F.col("x"), F.col("y"))).alias("p"), F.struct(*moments(F.col("rx"), F.col("ry"))).alias("s"))
    r = lambda p: pearson(*(F.col(f"{p}.{c}") for c in ("n", "sx", "sy", "sxx", "syy", "sxy")))
    return both.select(by, r("p").alias("pearson"), r("s").alias("spearman"))


def sample_rows(df: DataFrame, n: int, keys: list[str], seed: int = 0) -> DataFrame:
    """At most `n` rows, the same for the same seed: those with the smallest hash of their keys."""
    return df.orderBy(F.xxhash64(F.lit(seed), *keys), *keys).limit(n)


def chunk_filter(chunks: DataFrame, counts: DataFrame, song: list[str], pct: float, top: bool = True) -> DataFrame:
    """The ceil(pct x n) chunks of each song with the most (or fewest) strong windows; chunks without count have 0."""
    if not math.isfinite(pct) or not 0 <= pct <= 1:
        raise ValueError("pct is a share from 0 to 1")
    rows = chunks.join(counts, [*song, "chunk"], "left").na.fill({"count": 0})
    key = F.desc("count") if top else F.asc("count")
    whole = Window.partitionBy(*song)
    rows = rows.withColumns({"__r": F.row_number().over(whole.orderBy(key, "chunk")), "__n": F.count("*").over(whole)})
    return rows.filter(F.col("__r") <= F.ceil(F.col("__n") * pct)).drop("__r", "__n")
