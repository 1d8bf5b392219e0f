"""Class frequencies, groups and reclassification.  Class and group tables are small by their nature."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def class_freq(px: DataFrame, value: str = "value", sort: bool = False) -> DataFrame:
    """Pixels per class, nulls skipped."""
    out = px.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("class")).agg(F.count("*").alias("n"))
    return out.orderBy(F.desc("n"), "class") if sort else out


def class_percent(freq: DataFrame) -> DataFrame:
    return freq.withColumn("percent", F.col("n") / F.sum("n").over(Window.partitionBy()) * 100)


def class_group_freq(px: DataFrame, keys: DataFrame, value: str = "value") -> DataFrame:
    """Counts per class and, with a null class, per group; classes are counted before the groups."""
    freq = class_freq(px, value).join(keys, F.col("class") == F.col("lc_key"))
    return freq.groupingSets([["grp_key", "class"], ["grp_key"]], "grp_key", "class").agg(F.sum("n").alias("n"))


def classes_by_group(px: DataFrame, keys: DataFrame, value: str = "value") -> DataFrame:
    """The classes present in each group, as text."""
    freq = class_freq(px, value).join(keys, F.col("class") == F.col("lc_key"))
    return freq.groupBy("grp_key").agg(F.concat_ws(",", F.sort_array(F.collect_set("class"))).alias("classes"))


def reclassify(px: DataFrame, mapping: DataFrame, value: str = "value") -> DataFrame:
    """Values (``lc_key``) replaced by groups (``grp_key``), 0 if there is none."""
    m = mapping.select(F.col("lc_key").alias("_k"), F.col("grp_key").alias("_g"))
    return px.join(m, F.col(value) == F.col("_k"), "left").withColumn(value, F.coalesce("_g", F.lit(0))).drop("_k", "_g")


def class_table(px: DataFrame, keys: DataFrame, value: str = "value") -> DataFrame:
    """Class, description, group, frequency and percent."""
    freq = class_percent(class_freq(px, value)).join(keys, F.col("class") == F.col("lc_key"), "left")
    return freq.select("class", "description", "grp_key", "grp_desc", "n", "percent")


def group_percent(freq: DataFrame, threshold: int = 1000) -> DataFrame:
    """Groups of at least ``threshold`` pixels and their percent of what stays."""
    return class_percent(freq.filter(F.col("n") >= threshold))


def reclassify_ranked(px: DataFrame, keys: DataFrame, threshold: int, value: str = "value") -> DataFrame:
    """Reclassify to the groups with enough pixels, numbered 1 to k in order of their key; 0 elsewhere."""
    groups = class_freq(px, value).join(keys, F.col("class") == F.col("lc_key")).groupBy("grp_key").agg(F.sum("n").alias("n"))
    kept = groups.filter(F.col("n") >= threshold).withColumn("rank", F.dense_rank().over(Window.orderBy("grp_key")))
    return reclassify(px, keys.join(kept, "grp_key").select("lc_key", F.col("rank").alias("grp_key")), value)


def distribution_by_period(px: DataFrame, periods: Sequence[str]) -> DataFrame:
    """Counts of classes that occur in every period, side by side: one pass over maps in columns."""
    return counts_union(px, periods).na.drop()


def counts_union(px: DataFrame, periods: Sequence[str]) -> DataFrame:
    """Counts of every class of any period; null where it does not occur."""
    long = px.unpivot([], list(periods), "period", "class").filter("class is not null")
    return long.groupBy("class").pivot("period", list(periods)).agg(F.count(F.lit(1)))


def label_sorted(freq: DataFrame, keys: DataFrame) -> DataFrame:
    """Percents with labels, the largest first."""
    return class_percent(freq).join(keys, F.col("class") == F.col("lc_key"), "left").select("class", "description", "percent").orderBy(F.desc("percent"), "class")


def distinct_values(px: DataFrame, value: str = "value") -> DataFrame:
    """The distinct values, a row each, however many there are."""
    return px.filter(F.col(value).isNotNull()).select(F.col(value).alias("value")).distinct()


def unique_values(px: DataFrame, value: str = "value") -> DataFrame:
    """The sorted distinct values of a class map in one row, and their number; ``distinct_values`` suits continuous ones."""
    return distinct_values(px, value).agg(F.sort_array(F.collect_list("value")).alias("vals"), F.count("*").alias("n"))
