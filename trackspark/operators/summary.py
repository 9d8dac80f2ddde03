"""Roll-ups of per-chunk model outputs to songs, artists and the dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import number


def numeric_columns(df: DataFrame, but: tuple[str, ...] = ()) -> list[str]:
    """Columns of numbers; booleans aren't numbers."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in but]


def attention_marginals(weights: DataFrame, chunk: list[str], i: str = "i", j: str = "j", w: str = "w") -> DataFrame:
    """Mean attention of each row and of each column of a chunk's matrix: axis, place, mean."""
    sets = [[*map(F.col, chunk), F.col(i)], [*map(F.col, chunk), F.col(j)]]
    found = weights.groupingSets(sets, *chunk, i, j).agg(F.avg(w).alias("mean"), F.grouping(i).alias("__g"))
    return found.select(*chunk, F.when(F.col("__g") == 0, "query").otherwise("key").alias("axis"), F.coalesce(i, j).alias("place"), "mean")


def attention_song_mean(records: DataFrame, song: list[str], columns: list[str]) -> DataFrame:
    """One NaN-skipping mean over all values of all chunks of a song, for each array column."""
    out = {}
    for c in columns:
        known = F.filter(c, lambda v: ~F.isnan(v))
        out[c] = F.try_divide(F.sum(F.aggregate(known, F.lit(0.0), lambda t, v: t + v)), F.sum(F.size(known)))
    return records.groupBy(*song).agg(*(v.alias(c) for c, v in out.items()))


def attention_position_mean(records: DataFrame, by: str, column: str) -> DataFrame:
    """Mean at each position by `by` and over the dataset (null): by, pos, mean."""
    rows = records.select(by, F.posexplode(column).alias("pos", "v"))
    return rows.groupingSets([[F.col(by), F.col("pos")], [F.col("pos")]], by, "pos").agg(F.avg(number("v")).alias("mean"))


def ablation_song_summary(chunks: DataFrame, song: list[str], baseline: str, variants: list[str]) -> DataFrame:
    """n_chunks, means of baseline and variants, differences of the means, and means of the chunks' differences."""
    aggs = [F.count("*").alias("n_chunks"), F.avg(baseline).alias("baseline_mean")]
    for v in variants:
        aggs += [F.avg(v).alias(f"{v}_mean"), (F.avg(v) - F.avg(baseline)).alias(f"delta_{v}"), F.avg(F.col(v) - F.col(baseline)).alias(f"chunk_delta_{v}")]
    return chunks.groupBy(*song).agg(*aggs)


def ablation_summary(songs: DataFrame, but: tuple[str, ...] = ("n_chunks",)) -> DataFrame:
    """Unweighted mean over songs of every number, and their count."""
    return songs.agg(F.count("*").alias("songs"), *(F.avg(c).alias(c) for c in numeric_columns(songs, but)))


def record_kind(df: DataFrame) -> tuple[str, str]:
    """Study type and level of ablation records, from their column names."""
    names = " ".join(df.columns)
    study = "region_masking" if any(w in names for w in ("mouth", "nose", "body")) else "temporal_shuffle" if "shuffle" in names else "unknown"
    return study, "chunk" if "chunk" in df.columns else "song"


def summarize_numeric(records: DataFrame, by: str, but: tuple[str, ...] = ()) -> DataFrame:
    """Mean of every number by `by` and overall (null), and the count."""
    aggs = [F.avg(c).alias(c) for c in numeric_columns(records, (by, *but))]
    return records.groupingSets([[F.col(by)], []], by).agg(F.count("*").alias("records"), *aggs)


def film_song_summary(chunks: DataFrame, song: list[str], metrics: list[str]) -> DataFrame:
    """n_chunks, and the mean and population deviation of each metric, nulls skipped."""
    aggs = [a for m in metrics for a in (F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std"))]
    return chunks.groupBy(*song).agg(F.count("*").alias("n_chunks"), *aggs)


def weighted(value: Column, weight: Column) -> Column:
    return F.try_divide(F.sum(value * weight), F.sum(F.when(value.isNotNull(), weight)))


def film_summary(records: DataFrame, by: str, metrics: list[str], weight: str = "n_chunks", delta: str | None = None) -> DataFrame:
    """By `by` and overall (null): n, and of each metric the mean, sample deviation (0 for one), min, max, number; of
    *_mean metrics also the mean weighted by max(1, weight). `delta` adds the percent of songs where it is over 0."""
    w = F.greatest(F.lit(1), F.coalesce(weight, F.lit(1))) if weight in records.columns else F.lit(1)
    aggs = [F.count("*").alias("songs")]
    for m in metrics:
        aggs += [F.avg(m).alias(m), F.when(F.count(m) > 0, F.coalesce(F.stddev_samp(m), F.lit(0.0))).alias(f"{m}_std"), F.min(m).alias(f"{m}_min"), F.max(m).alias(f"{m}_max"), F.count(m).alias(f"{m}_n")]
        if m.endswith("_mean"):
            aggs.append(weighted(F.col(m), w).alias(f"{m}_weighted"))
    if delta:
        aggs.append((F.count(F.when(F.col(delta) > 0, 1)) * 100.0 / F.count("*")).alias("positive_pct"))
    return records.groupingSets([[F.col(by)], []], by).agg(*aggs)
