"""Long tracks in blocks of frames, so that a track isn't one task's.

Frames are whole numbers that follow one another in a track. What looks a few frames back or ahead gets blocks with copies
of their neighbours' edge rows (a halo); what carries a value on, however far, carries it inside a block and then over
one row per block.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Frames of a block.
BLOCK = 4096


def block_of(frame: str, block: int = BLOCK) -> Column:
    return F.floor(F.col(frame) / block).cast("long")


def halo(df: DataFrame, before: int, after: int, block: int = BLOCK, frame: str = "frame") -> DataFrame:
    """Each row with its block `__block` (`__own`), and once more for a neighbour that it is near to: blocks have the
    `before` frames before and the `after` frames after their own. No row is shuffled by this."""
    if max(before, after) > block:
        raise ValueError("a halo may not be wider than a block")
    own, at = block_of(frame, block), F.pmod(F.col(frame), F.lit(block))
    near = F.array_compact(F.array(own, F.when(at < after, own - 1), F.when(at >= block - before, own + 1)))
    return df.withColumn("__block", F.explode(near)).withColumn("__own", F.col("__block") == own)


def in_blocks(df: DataFrame, track: list[str], reach: int, chain: Callable[[DataFrame, list[str]], DataFrame], block: int = BLOCK, frame: str = "frame") -> DataFrame:
    """chain(df, keys) over blocks in place of whole tracks, for operators that together look `reach` frames either way.

    They run on one shuffle by track and block; what they make of the halo, where they miss rows, is dropped.
    """
    wide = halo(df, reach, reach, max(block, reach), frame)
    return chain(wide, [*track, "__block"]).filter("__own").drop("__block", "__own")


def block_totals(df: DataFrame, track: list[str], sums: dict[str, Column], block: int = BLOCK, frame: str = "frame") -> DataFrame:
    """track, __block and the {name: aggregate}s of all earlier blocks of the track, 0 for the first: a row per block."""
    found = df.groupBy(*track, block_of(frame, block).alias("__block")).agg(*(v.alias(k) for k, v in sums.items()))
    earlier = Window.partitionBy(*track).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    return found.select(*track, "__block", *(F.coalesce(F.sum(k).over(earlier), F.lit(0)).alias(k) for k in sums))


def close_up(df: DataFrame, track: list[str], block: int = BLOCK, frame: str = "frame") -> DataFrame:
    """The rows with frames numbered anew from 0 on in their order: places inside a block, after the rows of earlier blocks. Null is a track of its own."""
    earlier = block_totals(df, track, {"__rows": F.count("*")}, block, frame)
    inside = F.row_number().over(Window.partitionBy(*track, "__block").orderBy(frame)).cast("long") - 1
    rows = df.withColumn("__block", block_of(frame, block)).withColumn("__at", inside)
    names = [*track, "__block"]
    earlier = earlier.select(*(F.col(c).alias(f"__of_{i}") for i, c in enumerate(names)), "__rows")
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"__of_{i}")) for i, c in enumerate(names)))
    return rows.join(earlier, same).withColumn(frame, F.col("__at") + F.col("__rows")).select(*df.columns)


def neighbours_known(df: DataFrame, track: list[str], values: dict[str, Column], block: int = BLOCK, frame: str = "frame") -> DataFrame:
    """Adds `{name}_before` and `{name}_after` for {name: value}: the last value that isn't null in the frames before, and
    the first in those after; null where there is none."""
    order = Window.partitionBy(*track, "__block").orderBy(frame)
    back, ahead = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    rows = df.withColumn("__block", block_of(frame, block))
    # a row per block: its first and last known values, and then those of the nearest blocks that have any
    ends = {}
    for name, value in values.items():
        ends |= {f"__first_{name}": F.min_by(value, F.when(value.isNotNull(), F.col(frame))), f"__last_{name}": F.max_by(value, F.when(value.isNotNull(), F.col(frame)))}
    edges = rows.groupBy(*track, "__block").agg(*(v.alias(k) for k, v in ends.items()))
    blocks = Window.partitionBy(*track).orderBy("__block")
    earlier, later = blocks.rowsBetween(Window.unboundedPreceding, -1), blocks.rowsBetween(1, Window.unboundedFollowing)
    carried = {}
    for name in values:
        carried |= {f"__from_{name}": F.last(f"__last_{name}", ignorenulls=True).over(earlier), f"__to_{name}": F.first(f"__first_{name}", ignorenulls=True).over(later)}
    edges = edges.select(*track, "__block", *(v.alias(k) for k, v in carried.items()))
    inside = {}
    for name, value in values.items():
        inside |= {f"{name}_before": F.last(value, ignorenulls=True).over(back), f"{name}_after": F.first(value, ignorenulls=True).over(ahead)}
    rows = rows.withColumns(inside).join(edges, [*track, "__block"])
    both = {f"{n}_{side}": F.coalesce(f"{n}_{side}", f"__{part}_{n}") for n in values for side, part in (("before", "from"), ("after", "to"))}
    return rows.withColumns(both).drop("__block", *(f"__{part}_{n}" for n in values for part in ("from", "to")))


def stitched_runs(df: DataFrame, track: list[str], flag: Column, block: int = BLOCK, frame: str = "frame") -> DataFrame:
    """Runs of consecutive flagged frames (start, end): found inside blocks; those that touch a block's edge, two a block at
    most, are joined to the runs that they meet."""
    rows = df.filter(flag).withColumn("__block", block_of(frame, block))
    order = Window.partitionBy(*track, "__block").orderBy(frame)
    runs = rows.withColumn("__run", F.col(frame) - F.row_number().over(order)).groupBy(*track, "__block", "__run").agg(F.min(frame).alias("start"), F.max(frame).alias("end"))
    edge = (F.col("start") == F.col("__block") * block) | (F.col("end") == (F.col("__block") + 1) * block - 1)
    runs = runs.withColumn("__edge", edge)
    by_start = Window.partitionBy(*track).orderBy("start")
    apart = F.coalesce(F.col("start") > F.lag("end").over(by_start) + 1, F.lit(True))
    met = runs.filter("__edge").withColumn("__apart", apart.cast("int")).withColumn("__run", F.sum("__apart").over(by_start))
    met = met.groupBy(*track, "__run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__run")
    return runs.filter(~F.col("__edge")).select(*track, "start", "end").unionByName(met)
