"""Time series per site, climate means and field plots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coverspark.sources.pixels import parse_scene


def site_series(scenes: DataFrame, row: int, col: int, window: int = 1, legacy: bool = False) -> DataFrame:
    """date and value at one pixel, or the truncated mean of a window around it; the filter reaches the scan.

    ``legacy`` windows leave out the last row and column.
    """
    k = window // 2
    last = k - 1 if legacy and window > 1 else k
    box = F.col("row").between(row - k, row + last) & F.col("col").between(col - k, col + last)
    return with_dates(scenes.filter(box)).groupBy("date").agg(F.avg("value").cast("int").alias("value"))


def site_series_many(scenes: DataFrame, sites: DataFrame, names: Sequence[str], window: int = 1) -> DataFrame:
    """One column per site, in one pass over the scenes; each site's window becomes pixels, which join by equality."""
    k = window // 2
    step = F.sequence(F.lit(-k), F.lit(k))
    near = sites.select("site", "row", "col", F.explode(step).alias("dr")).withColumn("dc", F.explode(step))
    near = near.select("site", (F.col("row") + F.col("dr")).alias("row"), (F.col("col") + F.col("dc")).alias("col"))
    return with_dates(scenes.join(near, ["row", "col"])).groupBy("date").pivot("site", list(names)).agg(F.avg("value").cast("int"))


def series_by_site(scenes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """date and truncated mean for scenes that are already cut to sites."""
    return with_dates(scenes).groupBy(*keys, "date").agg(F.avg("value").cast("int").alias("value"))


def with_dates(scenes: DataFrame) -> DataFrame:
    return parse_scene(scenes) if "path" in scenes.columns else scenes


def series_align(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two series on all dates of either."""
    return a.select("date", F.col("value").alias("a")).join(b.select("date", F.col("value").alias("b")), "date", "full")


def annual_mean(px: DataFrame, keys: Sequence[str], mask: DataFrame | None = None) -> DataFrame:
    """Sum of values over the number of values > 0, within a mask of values >= 0."""
    if mask is not None:
        px = px.join(mask.filter("value >= 0").select("tile", "row", "col"), ["tile", "row", "col"], "left_semi")
    return px.groupBy(*keys).agg((F.sum("value") / F.nullif(F.count_if(F.col("value") > 0), F.lit(0))).alias("mean"))


def plots_region(df: DataFrame, states: Sequence[str], columns: Sequence[str], state: str = "state") -> DataFrame:
    return df.filter(F.col(state).isin(*states)).select(*columns)


def first_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key with each column's first value that is not null, in ``order``."""
    rest = [c for c in df.columns if c not in (key, order)]
    return df.groupBy(key).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in rest])


def key_unique(df: DataFrame, key: str) -> DataFrame:
    return df.agg((F.count(key) == F.count_distinct(key)).alias("is_unique"))
