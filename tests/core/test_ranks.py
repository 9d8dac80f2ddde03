"""Ranks and percentiles from value ranges against NumPy, with ties, one hot value, outliers and NaN."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackspark.operators import modulation, ranks


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    rows = [("a", float(v)) for v in rng.integers(0, 40, 300)] + [("b", float(v)) for v in rng.normal(size=201)] + [("one", 5.0), ("two", 1.0), ("two", 2.0), ("flat", 3.0), ("flat", 3.0), ("none", None)]
    rows += [("b", 1e9), ("b", -1e9), ("a", None)]
    return spark.createDataFrame(rows, "k string, v double").repartition(3).cache()


def by_group(table):
    out = {}
    for r in table.collect():
        if r["v"] is not None:
            out.setdefault(r["k"], []).append(r["v"])
    return out


@pytest.mark.parametrize("ranges", [1, 5, None])
def test_percentiles(table, ranges):
    shares = [0.0, 0.25, 0.5, 0.751, 0.99, 1.0]
    got = {r["k"]: r["percentiles"] for r in ranks.percentiles(table, ["k"], "v", shares, ranges).collect()}
    want = by_group(table)
    assert set(got) == set(want)
    for k, values in want.items():
        np.testing.assert_allclose(got[k], np.percentile(values, [100 * s for s in shares]), rtol=1e-12, atol=1e-9)
    whole = ranks.percentiles(table, [], "v", shares, ranges).collect()
    np.testing.assert_allclose(whole[0]["percentiles"], np.percentile(sum(want.values(), []), [100 * s for s in shares]), rtol=1e-12, atol=1e-9)
    assert ranks.percentiles(table.filter("v is null"), [], "v", shares).collect() == []


def test_describe_keeps_groups_without_values(table):
    got = {r["k"]: r for r in modulation.describe(table, "v", "k").collect()}
    assert got["none"]["n"] == 0 and got["none"]["p50"] is None and got["one"]["p99"] == 5.0
    empty = modulation.describe(table.limit(0), "v").collect()
    assert len(empty) == 1 and empty[0]["n"] == 0 and empty[0]["p50"] is None


def test_mean_ranks(table):
    known = table.filter("v is not null")
    got = {(r["k"], r["v"]): r["r"] for r in ranks.mean_ranks(known, ["k"], "v", "r").collect()}
    for k, values in by_group(table).items():
        values = np.array(values)
        for v in set(values.tolist()):
            assert got[k, v] == ((values < v).sum() + (values <= v).sum() + 1) / 2


def test_percentiles_of_a_million_values_and_a_hot_one(spark):
    """10^6 distinct values beside one that half of the rows have: no range holds more than its part, only one is looked into."""
    rows = spark.range(2 * 10**6).select(F.when(F.col("id") % 2 == 0, F.lit(-7.0)).otherwise((F.col("id") * 7919 % 2_000_003).cast("double")).alias("v"))
    ranged = ranks.value_ranges(rows, [], "v", {"n": F.count("*")}, 16)
    sizes = [r["count"] for r in ranged.groupBy("__range").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 0.15 * sum(sizes) and sum(sizes) == 10**6 + 1
    got = ranks.percentiles(rows, [], "v", [0.25, 0.5, 0.75, 0.999], 16).first()["percentiles"]
    values = np.where(np.arange(2 * 10**6) % 2 == 0, -7.0, np.arange(2 * 10**6) * 7919 % 2_000_003)
    np.testing.assert_allclose(got, np.percentile(values, [25, 50, 75, 99.9]))


def test_one_group_is_ranked_by_several_tasks(spark):
    rows = spark.range(200_000).select(F.lit("g").alias("k"), (F.col("id") * 7919 % 100_003).cast("double").alias("v"))
    ranged = ranks.value_ranges(rows, ["k"], "v", {"n": F.count("*")}, 8)
    sizes = [r["count"] for r in ranged.groupBy("__range").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 0.3 * sum(sizes)
    paired = rows.withColumn("w", F.pow("v", F.lit(3.0)))
    found = modulation.pearson_spearman(paired, "v", "w", "k").first()
    assert found["spearman"] == pytest.approx(1) and found["pearson"] < 0.95


def test_two_samples_with_an_outlier(spark):
    """Equal-width ranges would put all but one value into one range."""
    rng = np.random.default_rng(5)
    a, b = np.append(rng.normal(size=4000), 1e12), rng.normal(0.2, 1, 3000).round(1)
    rows = spark.createDataFrame([("x", float(v)) for v in a] + [("y", float(v)) for v in b] + [("z", 1.0), ("x", float("nan")), ("y", None)], "g string, v double")
    at = np.union1d(a, b)
    want = np.abs(np.searchsorted(np.sort(a), at, "right") / len(a) - np.searchsorted(np.sort(b), at, "right") / len(b)).max()
    found = modulation.ks_two_sample(rows, "v", "g", 32).first()
    assert found["statistic"] == pytest.approx(want, abs=1e-12) and 0 <= found["p"] < 1e-6
    ranged = ranks.value_ranges(rows.filter("v is not null and not isnan(v)"), [], "v", {"n": F.count("*")}, 32)
    sizes = [r["count"] for r in ranged.groupBy("__range").count().collect()]
    assert max(sizes) < 0.06 * sum(sizes)
