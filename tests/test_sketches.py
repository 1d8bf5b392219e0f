"""Tile summaries: exact parts equal one pass over the pixels, sketches stay within their bounds after merging."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from coverspark.operators import sketches


@pytest.fixture(scope="module")
def px(spark):
    rows = spark.range(60_000).select("id", F.concat(F.lit("t"), (F.col("id") % 37).cast("string")).alias("tile"))
    value = F.when(F.col("id") % 11 > 0, F.floor(F.pow(F.pmod(F.xxhash64("id"), F.lit(30_000)) / 1000, 2) * 20))
    return rows.withColumn("value", F.when(F.col("tile") != "t5", value).cast("int"))


@pytest.fixture(scope="module")
def stored(spark, px, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('s')}/summaries"
    sketches.summarize(px).write.parquet(path)
    return spark.read.parquet(path)


def test_merged_summaries_are_those_of_one_pass(px, stored):
    values = np.array([r[0] for r in px.filter("value is not null").select("value").collect()])
    got = sketches.described(stored).first()
    assert (got["pixels"], got["n"], got["lo"], got["hi"]) == (60_000, len(values), values.min(), values.max())
    assert got["mean"] == pytest.approx(values.mean()) and got["std"] == pytest.approx(values.std())
    assert got["distinct"] == pytest.approx(len(set(values.tolist())), rel=0.05)
    half = stored.withColumn("east", F.expr("int(substring(tile, 2)) % 2"))
    parts = {r["east"]: r["n"] for r in sketches.described(half, ["east"]).collect()}
    assert sum(parts.values()) == len(values) and len(parts) == 2


def test_quantiles_and_histograms_stay_within_the_bound(px, stored):
    values = np.sort([r[0] for r in px.filter("value is not null").select("value").collect()])
    for r in sketches.quantiles(stored, [0, 0.02, 0.25, 0.5, 0.98, 1]).collect():
        low, high = np.searchsorted(values, r["value"]) / len(values), np.searchsorted(values, r["value"], side="right") / len(values)
        assert low - 0.01 <= r["share"] <= high + 0.01
    edges = [0, 100, 1000, 5000, 18_000]
    got = {r["bin"]: r["n"] for r in sketches.histogram_estimate(stored, edges).collect()}
    for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        true = np.sum((values <= b) & ((values > a) | (i == 0) & (values >= a)))
        assert abs(got[i] - true) <= 0.015 * len(values)


def test_tiles_without_values(stored, px):
    none = sketches.described(stored.filter("tile = 't5'")).first()
    assert (none["n"], none["lo"], none["mean"], none["distinct"]) == (0, None, None, 0) and none["pixels"] > 0
    assert sketches.quantiles(stored.filter("tile = 't5'"), [0.5]).count() == 0
    assert sketches.summarize(px.filter("false")).count() == 0
