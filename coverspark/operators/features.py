"""Feature names, statistics, composites and scaling."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PIX = ["tile", "row", "col"]
#: Fixed values of the products: bands, vegetation indices, months, seasons, phenology.
BANDS = ["BLUE", "GREEN", "RED", "NIR", "MIR", "SWIR1"]
INDICES = ["EVI", "EVI2", "NDVI"]
MONTHS = ["JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"]
SEASONS = {"SPR": ["APR", "MAY", "JUN"], "SUM": ["JUL", "AUG", "SEP"], "FAL": ["OCT", "NOV", "DEC"], "WIN": ["JAN", "FEB", "MAR"]}
PHENOLOGY = ["SOS", "EOS", "LOS", "DOP", "GUR", "GDR", "MAX", "NOS", "SOS2", "EOS2", "LOS2", "DOP2", "GUR2", "GDR2", "MAX2", "CUM"]
VARIABLES = ["AVG", "STDEV"]
#: What to divide by for real units.
SCALE = {"SOS": 1, "EOS": 1, "LOS": 1, "DOP": 1, "GUR": 100, "GDR": 100, "MAX": 10000, "CUM": 10}


def _names(spark: SparkSession, times: Sequence[str]) -> DataFrame:
    names = [(f"{t} {b} {v}", t, b, v) for b in BANDS + INDICES for t in times for v in VARIABLES]
    return spark.createDataFrame(names + [(f"PHEN {p}", None, p, None) for p in PHENOLOGY], "feature string, period string, band string, var string")


def monthly_features(spark: SparkSession) -> DataFrame:
    """The names of all monthly features and of phenology."""
    return _names(spark, MONTHS)


def seasonal_features(spark: SparkSession) -> DataFrame:
    """The names of all seasonal features and of phenology."""
    return _names(spark, list(SEASONS))


def parse_feature(name: Column) -> Column:
    """struct(period, band, var, kind) from ``MON BAND VAR``, ``MON Bn (Band) VAR`` or ``PHEN P``."""
    p = F.split(name, " ")
    four = F.size(p) == 4
    band = F.when(four, F.upper(F.regexp_extract(p[2], r"^\(?(.*?)\)?$", 1))).otherwise(p[1])
    phen = p[0] == "PHEN"
    kind = F.when(phen, "PHEN").when(four | band.isin(*BANDS), "BAND").otherwise("VI")
    return F.struct(F.when(~phen, p[0]).alias("period"), band.alias("band"), F.when(~phen, F.element_at(p, -1)).alias("var"), kind.alias("kind"))


def feature_type(name: Column) -> Column:
    """struct(type, var): BAND, VI or PHEN, and AVG, MIN, MAX, STD, NPI or VAL."""
    last = F.element_at(F.split(name, " "), -1)
    kind = parse_feature(name).getField("kind")
    var = F.when(kind == "PHEN", "VAL").otherwise(F.substring(last, 1, 3))
    return F.struct(kind.alias("type"), F.when(var.isin("AVG", "MIN", "MAX", "STD", "NPI"), var).otherwise("VAL").alias("var"))


def exclude_features(df: DataFrame, tokens: Sequence[str], feature: str = "feature") -> DataFrame:
    """Rows whose feature name has none of the tokens."""
    return df.filter(~F.arrays_overlap(F.split(feature, " "), F.array(*map(F.lit, tokens))))


def seasonal_composite(wide: DataFrame, bands: Sequence[str], variables: Sequence[str] = VARIABLES, strict: bool = False) -> DataFrame:
    """Columns ``SEASON_BAND_VAR`` from ``MON_BAND_VAR``: the rounded mean of the months with data; others pass.

    ``strict`` divides the sum by three whatever is missing.
    """
    made, used = {}, set()
    for s, months in SEASONS.items():
        for b in bands:
            for v in variables:
                cols = [f"{m}_{b}_{v}" for m in months if f"{m}_{b}_{v}" in wide.columns]
                if cols:
                    total = reduce(lambda x, y: x + y, [F.coalesce(F.col(c), F.lit(0)) for c in cols])
                    n = F.lit(3) if strict else F.nullif(reduce(lambda x, y: x + y, [F.col(c).isNotNull().cast("int") for c in cols]), F.lit(0))
                    made[f"{s}_{b}_{v}"] = F.bround(total / n).cast("int")
                    used |= set(cols)
    return wide.select(*[c for c in wide.columns if c not in used], *[e.alias(k) for k, e in made.items()])


def seasonal_long(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same for rows (keys, month number, value)."""
    season = F.element_at(F.array(*map(F.lit, ["WIN", "SPR", "SUM", "FAL"])), (F.floor((F.col("month") - 1) / 3) + 1).cast("int"))
    rows = long.filter("value is not null").groupBy(*keys, season.alias("season")).agg(F.sum("value").alias("s"), F.count("value").alias("n"))
    return rows.select(*keys, "season", F.bround(F.col("s") / F.col("n")).cast("int").alias("value"))


def monthly_stats(obs: DataFrame, keys: Sequence[str], nan: int = -13000) -> DataFrame:
    """avg, min, max, stddev and number of valid observations by keys and month."""
    valid = obs.filter(F.col("value") > nan)
    return valid.groupBy(*keys, "month").agg(
        F.avg("value").alias("avg"), F.min("value").alias("min"), F.max("value").alias("max"), F.stddev_samp("value").alias("stddev"), F.count("value").alias("npi")
    )


def basic_stats(long: DataFrame, low: Column | int = 0, by: str = "feature") -> DataFrame:
    """Raw and valid (at least ``low``) min, max and mean by feature."""
    ok = F.when(F.col("value") >= low, F.col("value"))
    return long.groupBy(by).agg(
        F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"), F.min(ok).alias("valid_min"), F.max(ok).alias("valid_max"), F.avg(ok).alias("valid_mean")
    )


def range_of_type(stats: DataFrame, by: Sequence[str]) -> DataFrame:
    """Least of the valid minima and greatest of the valid maxima by type and variable."""
    return stats.groupBy(*by).agg(F.min("valid_min").alias("low"), F.max("valid_max").alias("high"))


def _with_stats(long: DataFrame, by: Sequence[str], *stats: Column) -> DataFrame:
    return long.join(long.groupBy(*by).agg(*stats), list(by))


def normalize(long: DataFrame, by: Sequence[str]) -> DataFrame:
    """Min-max scaling within ``by`` (features: few); null where all values are equal."""
    out = _with_stats(long, by, F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    return out.withColumn("value", (F.col("value") - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0))).drop("_lo", "_hi")


def standardize(long: DataFrame, by: Sequence[str]) -> DataFrame:
    """(value - mean) / population standard deviation within ``by``."""
    out = _with_stats(long, by, F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"))
    return out.withColumn("value", (F.col("value") - F.col("_m")) / F.nullif(F.col("_s"), F.lit(0.0))).drop("_m", "_s")


def apply_scale(long: DataFrame, feature: str = "feature") -> DataFrame:
    """Values in real units: phenology by its own factor, bands by 10000."""
    table = F.create_map(*[F.lit(x) for kv in SCALE.items() for x in kv])
    return long.withColumn("value", F.col("value") / F.coalesce(F.try_element_at(table, F.col(feature)), F.lit(10000)))


def array_stats(px: DataFrame, value: str = "value") -> DataFrame:
    return px.agg(F.max(value).alias("max"), F.min(value).alias("min"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def common_limits(long: DataFrame, lo: float, hi: float) -> DataFrame:
    """Limits over all features, never tighter than those given."""
    return long.agg(F.least(F.lit(lo), F.min("value")).alias("lo"), F.greatest(F.lit(hi), F.max("value")).alias("hi"))


def _bin(value: Column, lo: Column, hi: Column, bins: int) -> Column:
    w = (hi - lo) / bins
    return F.when((value >= lo) & (value <= hi), F.least(F.coalesce(F.floor((value - lo) / F.nullif(w, F.lit(0.0))), F.lit(0)), F.lit(bins - 1)).cast("int"))


def histogram(px: DataFrame, bins: int, lo: float | None = None, hi: float | None = None, value: str = "value") -> DataFrame:
    """Counts of equal bins; the last one is closed. Limits default to the data's own."""
    v = F.col(value)
    if lo is None or hi is None:
        limits = px.agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"))
        px = px.join(F.broadcast(limits), how="cross")
        low, high = (F.col("_lo") if lo is None else F.lit(lo)), (F.col("_hi") if hi is None else F.lit(hi))
    else:
        low, high = F.lit(lo), F.lit(hi)
    return px.select(_bin(v, low, high, bins).alias("bin")).filter("bin is not null").groupBy("bin").agg(F.count("*").alias("n"))


def histogram_edges(px: DataFrame, edges: Sequence[float], value: str = "value") -> DataFrame:
    """Counts between given edges; the last bin is closed."""
    v, e = F.col(value), list(edges)
    at = F.size(F.filter(F.array(*map(F.lit, e[1:-1])), lambda x: x <= v))
    return px.filter((v >= e[0]) & (v <= e[-1])).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def histogram2d(px: DataFrame, x: str, y: str, bins: int, limits: tuple[float, float, float, float]) -> DataFrame:
    """Counts of a grid of bins over two columns."""
    x0, x1, y0, y1 = limits
    binned = px.select(_bin(F.col(x), F.lit(x0), F.lit(x1), bins).alias("x_bin"), _bin(F.col(y), F.lit(y0), F.lit(y1), bins).alias("y_bin"))
    return binned.na.drop().groupBy("x_bin", "y_bin").agg(F.count("*").alias("n"))


def linear_fit(px: DataFrame, x: str, y: str, intercept: bool = True) -> DataFrame:
    """slope, intercept and R² of y on x; without intercept R² is uncentred."""
    both = px.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    if intercept:
        return both.agg(F.regr_slope(b, a).alias("slope"), F.regr_intercept(b, a).alias("intercept"), F.regr_r2(b, a).alias("r2"))
    s = both.agg(F.sum(a * b).alias("xy"), F.sum(a * a).alias("xx"), F.sum(b * b).alias("yy"))
    slope = F.col("xy") / F.col("xx")
    return s.select(slope.alias("slope"), F.lit(0.0).alias("intercept"), (slope * F.col("xy") / F.col("yy")).alias("r2"))


def to_long(wide: DataFrame, features: Sequence[str], keys: Sequence[str] = PIX) -> DataFrame:
    return wide.unpivot(list(keys), list(features), "feature", "value")


def to_wide(long: DataFrame, features: Sequence[str], keys: Sequence[str] = PIX) -> DataFrame:
    return long.groupBy(*keys).pivot("feature", list(features)).agg(F.first("value"))


def to_vector(wide: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="skip").transform(wide)
