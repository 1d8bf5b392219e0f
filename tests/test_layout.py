"""Stored layouts: joins without an exchange, boxes that read few files, logs that grow."""

import uuid

import pytest
from pyspark.sql import functions as F

from coverspark.operators import change, grid, sampling, series
from coverspark.sources import pixels


@pytest.fixture(scope="module")
def px(spark):
    return spark.range(40 * 60).select(F.lit("a").alias("tile"), F.floor(F.col("id") / 60).cast("int").alias("row"), (F.col("id") % 60).cast("int").alias("col"), (F.col("id") % 7).cast("int").alias("value"))


@pytest.fixture
def no_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_stored_maps_meet_without_an_exchange(spark, px, tmp_path, no_broadcast):
    names = [f"t{uuid.uuid4().hex}" for _ in range(2)]
    one, two = (pixels.store_pixels(px.withColumn("value", F.col("value") * k), n, 6, f"file://{tmp_path}/{n}") for k, n in enumerate(names, 1))
    both = change.pair(one, two).withColumn("flag", change.change_flag(F.col("c1"), F.col("c2")))
    assert "SortMergeJoin" in plan(both) and "Exchange" not in plan(both)
    assert {r["flag"]: r["count"] for r in both.groupBy("flag").count().collect()} == {0: 343, 1: 2057}
    masked = grid.apply_mask(one, two.filter("value > 6").select(*pixels.PIX, F.lit(1).alias("mask")))
    assert "Exchange" not in plan(masked) and masked.count() == px.count()
    assert "Exchange" not in plan(sampling.sample_mask(one, two.filter("value = 2").groupBy(*pixels.PIX).agg(F.max("value").alias("value"))))
    for n in names:
        spark.sql(f"DROP TABLE {n}")


def files_read(df):
    physical = df._jdf.queryExecution().executedPlan()
    physical.executeCollect()
    return physical.collectLeaves().head().metrics().apply("numFiles").value()


def test_files_read_follow_the_box(spark, px, tmp_path):
    path = f"file://{tmp_path}/blocks"
    pixels.write_blocks(px, path, 10)
    sizes = {}
    for box in ((0, 40, 0, 60), (0, 20, 0, 20), (12, 18, 33, 39), (9, 11, 9, 11)):
        df = pixels.read_box(spark, path, *box, 10)
        sizes[box] = files_read(df)
        assert sorted(map(tuple, df.select("row", "col", "value").collect())) == sorted(map(tuple, px.filter(f"row >= {box[0]} and row < {box[1]} and col >= {box[2]} and col < {box[3]}").select("row", "col", "value").collect()))
    assert list(sizes.values()) == [24, 4, 1, 4]
    scenes = pixels.read_box(spark, path, 3, 6, 3, 6, 10).withColumn("path", F.lit("LANDSAT08.A2013144.h019v025.hdf"))
    assert series.site_series(scenes, 4, 4, 3).first()["value"] == series.site_series(px.withColumn("path", F.lit("LANDSAT08.A2013144.h019v025.hdf")), 4, 4, 3).first()["value"]


def test_records_of_runs_are_appended(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    for run in ("a", "b"):
        pixels.append_record(spark, {"trees": 250, "depth": 30}, path, run)
    assert sorted(map(tuple, pixels.read_records(spark, path).collect())) == [(r, k, v) for r in "ab" for k, v in (("depth", "30"), ("trees", "250"))]


def test_a_mask_of_many_maps(spark, px):
    maps = [px.filter(f"col <> {i}") for i in range(1, 70, 3)] * 3
    assert len(maps) > 62
    got = grid.common_mask(*maps)
    assert got.count() == px.filter("value > 0 and not (col % 3 = 1 and col < 70)").count()
