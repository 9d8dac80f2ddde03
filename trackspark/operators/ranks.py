"""Ranks, running counts and exact percentiles of columns of any size, by counts of distinct values in value ranges.

Equal values are counted first, so that a common value is one row. The distinct values are split into ranges of about equal
size by a sample (a range partition); what is before a range comes from the ranges' totals, one row each, and what is
before a value inside its range from that range alone. No task sees all values of a group, nor all of a range that isn't
asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import kept


def value_ranges(df: DataFrame, by: list[str], value: str, counts: dict[str, Column], ranges: int | None = None) -> DataFrame:
    """by, value, the {name: aggregate}s of each distinct value and `__range`, its range partition: `ranges` of them, as
    many as Spark shuffles into by default."""
    found = df.groupBy(*by, value).agg(*(v.alias(k) for k, v in counts.items()))
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return kept(found.repartitionByRange(n, *by, value).withColumn("__range", F.spark_partition_id()))


def range_starts(ranged: DataFrame, by: list[str], counts: list[str]) -> DataFrame:
    """by, __range, the range's own sums (`{name}_in`) and those of the group's earlier ranges (`{name}_start`): a row per range."""
    sums = ranged.groupBy(*by, "__range").agg(*(F.sum(c).alias(f"{c}_in") for c in counts))
    earlier = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    return sums.withColumns({f"{c}_start": F.coalesce(F.sum(f"{c}_in").over(earlier), F.lit(0)) for c in counts})


def counts_before(ranged: DataFrame, starts: DataFrame, by: list[str], value: str, counts: list[str]) -> DataFrame:
    """`ranged` with `{name}_before`, the sum over the group's smaller values, for the ranges that `starts` has."""
    inside = Window.partitionBy(*by, "__range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    rows = ranged.join(starts, [*by, "__range"]) if by else ranged.join(starts, "__range")
    return rows.withColumns({f"{c}_before": F.col(f"{c}_start") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in counts})


def mean_ranks(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """by, value and `name`, the rank from 1 of each distinct value in its group; ties have the mean of their ranks."""
    ranged = value_ranges(df, by, value, {"n": F.count("*")})
    rows = counts_before(ranged, range_starts(ranged, by, ["n"]), by, value, ["n"])
    return rows.select(*by, value, (F.col("n_before") + (F.col("n") + 1) / 2).alias(name))


def percentiles(df: DataFrame, by: list[str], value: str, shares: list[float], ranges: int | None = None) -> DataFrame:
    """by and `percentiles`, an array of the values at `shares`, with linear interpolation between neighbours; null values
    don't count, and a group without any isn't there.

    Of the ranges only those that hold a wanted place are looked into.
    """
    ranged = value_ranges(df.filter(F.col(value).isNotNull()), by, value, {"n": F.count("*")}, ranges)
    starts = range_starts(ranged, by, ["n"])
    sizes = starts.groupBy(*by).agg(F.sum("n_in").alias("size"))
    place = (F.col("size") - 1) * F.col("share")
    wanted = sizes.select(*by, "size", F.posexplode(F.array(*(F.lit(float(s)) for s in shares))).alias("at", "share"))
    wanted = wanted.select(*by, "at", (place - F.floor(place)).alias("part"), F.explode(F.array(F.floor(place), F.least(F.floor(place) + 1, F.col("size") - 1))).alias("place")).distinct()
    wanted = kept(wanted)
    held = lambda start, size: (F.col("place") >= F.col(start)) & (F.col("place") < F.col(start) + F.col(size))
    join = lambda a, b, inside: a.join(b, by).filter(inside) if by else a.join(b, inside)  # noqa: E731  one row per place on one side
    asked = join(starts, wanted.select(*by, "place").distinct(), held("n_start", "n_in")).select(*starts.columns).distinct()
    rows = counts_before(ranged, asked, by, value, ["n"])
    at = join(rows, wanted, held("n_before", "n")).select(*by, "at", "part", "place", F.col(value).alias("v"))
    both = at.groupBy(*by, "at").agg(F.min_by("v", "place").alias("low"), F.max_by("v", "place").alias("high"), F.first("part").alias("part"))
    mixed = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.col("low") + (F.col("high") - F.col("low")) * F.col("part"))
    both = both.select(*by, "at", mixed.cast("double").alias("v"))
    found = F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda p: p["v"])
    return both.groupBy(*by).agg(found.alias("percentiles")).filter(F.size("percentiles") > 0)
