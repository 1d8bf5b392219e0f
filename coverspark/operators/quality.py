"""Bit quality: ranks from packed flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def get_bit(col: Column, i: int) -> Column:
    """The bit at its own weight."""
    return col.bitwiseAND(F.lit(1 << i))


def get_normalized_bit(col: Column, i: int) -> Column:
    """The bit as 0 or 1."""
    return F.shiftright(col, i).bitwiseAND(F.lit(1))


def qa_rank(qa: Column, aerosol: Column) -> Column:
    """3 water or snow; 2 unclear, shadow, cloud, cirrus, or climatology or high aerosol; 1 medium; 0 low aerosol.

    Null where the aerosol is null; a null ``qa`` has no flags but is not clear.
    """
    q = F.coalesce(qa, F.lit(0))
    on = lambda c, i: get_normalized_bit(c, i) == 1
    two = lambda c, i: F.shiftright(c, i).bitwiseAND(F.lit(3))
    poor = ~on(q, 1) | on(q, 3) | on(q, 5) | on(aerosol, 3) | (two(q, 8) >= 2) | (two(q, 6) >= 2) | two(aerosol, 6).isin(0, 3)
    rank = F.when(on(q, 2) | on(q, 4), 3).when(poor, 2).when(two(aerosol, 6) == 2, 1).otherwise(0)
    return F.when(aerosol.isNotNull(), rank)


def qa_summary(px: DataFrame, qa: str = "pixel_qa", aerosol: str = "sr_aerosol") -> DataFrame:
    """Pixels and statistics of the packed flags for each rank."""
    ranked = px.withColumn("rank", qa_rank(F.col(qa), F.col(aerosol)))
    return ranked.groupBy("rank").agg(
        F.count("*").alias("pixels"), F.max(qa).alias("qa_max"), F.min(qa).alias("qa_min"), F.avg(qa).alias("qa_mean"), F.stddev_pop(qa).alias("qa_std")
    )
