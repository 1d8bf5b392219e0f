"""Change between maps.  Per-pixel columns come from one pass; every report derives from small counted tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coverspark.functions import chisq

PIX = ["tile", "row", "col"]
HA = 0.09  # a 30 m pixel
#: Transition codes of the gain, unchanged and loss maps.
FOREST = {"gain": [101106, 102106, 101109, 102109], "unchanged": [106106, 109109, 106109, 109106], "loss": [106101, 106102, 109101, 109102]}
#: The same for single classes.
SINGLE = {
    "evergreen": {"gain": [101106, 102106, 109106], "unchanged": [106106], "loss": [106101, 106102, 106109]},
    "deciduous": {"gain": [101109, 102109, 106109], "unchanged": [109109], "loss": [109101, 109102, 109106]},
    "urban": {"gain": [101102, 106102, 109102], "unchanged": [102102], "loss": [102101, 102106, 102109]},
    "agriculture": {"gain": [102101, 106101, 109101], "unchanged": [101101], "loss": [101102, 101106, 101109]},
}
BUILT = {"gain": [106101, 106102, 109101, 109102], "unchanged": [101101, 102102], "loss": [102101, 101102, 101106, 101109, 102106, 102109]}


def pair(m1: DataFrame, m2: DataFrame) -> DataFrame:
    """c1 and c2 of every pixel of the first map: the one large join, for maps that are not columns of one table."""
    return m1.select(*PIX, F.col("value").alias("c1")).join(m2.select(*PIX, F.col("value").alias("c2")), PIX, "left")


def change_flag(c1: Column, c2: Column) -> Column:
    """0 same, 1 different, over pixels of map 1; missing in map 2 counts as changed."""
    return F.when(c1.isNotNull(), F.when(c1.eqNullSafe(c2), 0).otherwise(1))


def change_summary(px: DataFrame, c1: str, c2: str, by: Sequence[str] = ()) -> DataFrame:
    """Changed pixels, all pixels, percent and hectares."""
    flag = px.select(*by, change_flag(F.col(c1), F.col(c2)).alias("f")).filter("f is not null")
    out = flag.groupBy(*by).agg(F.sum("f").alias("changed"), F.count("f").alias("total"))
    return out.withColumns({"percent": F.col("changed") / F.col("total") * 100, "ha": F.col("changed") * HA})


def difference(c1: Column, c2: Column) -> Column:
    """Later minus earlier code, 0 where one is missing."""
    return F.coalesce(c2 - c1, F.lit(0))


def difference_counts(px: DataFrame, c1: str, c2: str) -> DataFrame:
    return px.groupBy(difference(F.col(c1), F.col(c2)).alias("difference")).agg(F.count("*").alias("n"))


def compare_rasters(a: DataFrame, b: DataFrame) -> DataFrame:
    """Statistics of b - a where both have a value, and the pixels that only one of them has."""
    j = a.select(*PIX, F.col("value").alias("x")).join(b.select(*PIX, F.col("value").alias("y")), PIX, "full")
    d = F.col("y") - F.col("x")
    return j.agg(F.count(d).alias("n"), F.min(d).alias("min"), F.max(d).alias("max"), F.avg(d).alias("mean"), F.stddev_pop(d).alias("std"), F.count_if(F.col("y").isNull() & F.col("x").isNotNull()).alias("only_a"), F.count_if(F.col("x").isNull() & F.col("y").isNotNull()).alias("only_b"))


def gain_loss(px: DataFrame, c1: str, c2: str, by: Sequence[str] = (), n: str | None = None) -> DataFrame:
    """Per class: counts of both periods, hectares, difference, percent of the first period and of the changed area.

    ``n`` names a column of counts if the rows are counted already.

    The changed area is that of the pixels of map 1 whose class differs in map 2 (``change_flag``); the percents keep
    the sign of the difference.
    """
    counts = px.groupBy(*by, F.col(c1).alias("c1"), F.col(c2).alias("c2")).agg((F.sum(n) if n else F.count("*")).alias("n"))
    none = F.lit(0).cast("bigint")
    moved = F.coalesce(change_flag(F.col("c1"), F.col("c2")), F.lit(0)) * F.col("n")
    first = F.struct(F.col("c1").alias("class"), F.col("n").alias("n1"), none.alias("n2"), moved.alias("moved"))
    second = F.struct(F.col("c2").alias("class"), none.alias("n1"), F.col("n").alias("n2"), none.alias("moved"))
    long = counts.select(*by, F.explode(F.array(first, second)).alias("e")).select(*by, "e.*")
    out = long.filter("class is not null").groupBy(*by, "class").agg(F.sum("n1").alias("n1"), F.sum("n2").alias("n2"), F.sum("moved").alias("moved"))
    d = F.col("n2") - F.col("n1")
    changed = F.sum("moved").over(Window.partitionBy(*by))
    out = out.withColumns({"ha1": F.col("n1") * HA, "ha2": F.col("n2") * HA, "diff": d, "diff_ha": d * HA, "pct_of_first": d / F.nullif(F.col("n1"), F.lit(0)) * 100, "pct_of_change": d / F.nullif(changed, F.lit(0)) * 100})
    return out.drop("moved")


def gain_loss_long(gl: DataFrame, periods: tuple[str, str] = ("1", "2")) -> DataFrame:
    """A row per class and period: frequency, area, and the class's difference, percent of the first period and of the changed area."""
    rows = [F.struct(F.lit(p).alias("period"), "class", F.col(f"n{i}").alias("frequency"), F.col(f"ha{i}").alias("ha"), F.col("diff_ha").alias("difference"), "pct_of_first", "pct_of_change") for i, p in enumerate(periods, 1)]
    return gl.select(F.explode(F.array(*rows)).alias("e")).select("e.*")


def gain_loss_periods(px: DataFrame, periods: Sequence[str]) -> DataFrame:
    """``gain_loss`` of each pair of consecutive periods and of the first and the last, with their names.

    The pixels are read once for any number of periods: tuples of classes are counted, and each adds to all pairs.
    """
    pairs = list(zip(periods, periods[1:], strict=False)) + ([(periods[0], periods[-1])] if len(periods) > 2 else [])
    tuples = px.groupBy(*periods).agg(F.count("*").alias("n"))
    own = [F.struct(F.lit(a).alias("from"), F.lit(b).alias("to"), F.col(a).alias("first"), F.col(b).alias("second"), "n") for a, b in pairs]
    return gain_loss(tuples.select(F.explode(F.array(*own)).alias("e")).select("e.*"), "first", "second", ["from", "to"], "n")


def transition_code(c1: Column, c2: Column) -> Column:
    """c1 * 1000 + c2; a missing side counts as 0."""
    return (F.coalesce(c1, F.lit(0)) * 1000 + F.coalesce(c2, F.lit(0))).cast("int")


def transition_counts(px: DataFrame, c1: str, c2: str, by: Sequence[str] = ()) -> DataFrame:
    """code, c1, c2, pixels and hectares: at most a few hundred rows, from which the other reports come."""
    n = px.groupBy(*by, F.col(c1).alias("c1"), F.col(c2).alias("c2")).agg(F.count("*").alias("n"))
    return n.select(*by, transition_code(F.col("c1"), F.col("c2")).alias("code"), "c1", "c2", "n", F.bround(F.col("n") * HA, 2).alias("ha"))


def both_valid(tr: DataFrame) -> DataFrame:
    return tr.filter("c1 is not null and c2 is not null")


def transition_matrix(tr: DataFrame, classes: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """Rows later class, columns (``from_<class>``) earlier class, hectares; zeros filled."""
    wide = both_valid(tr).groupBy(*by, F.col("c2").alias("to")).pivot("c1", list(classes)).agg(F.sum("ha"))
    return wide.select(*by, "to", *[F.coalesce(F.col(str(c)), F.lit(0.0)).alias(f"from_{c}") for c in classes])


def transition_percent(tr: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Percent of each earlier class that became each later one."""
    share = F.col("n") / F.sum("n").over(Window.partitionBy(*by, "c1")) * 100
    return both_valid(tr).select(*by, "c1", "c2", share.alias("percent"))


def gain_loss_map(code: Column, rules: Mapping[str, Sequence[int]]) -> Column:
    """1 gain, 2 unchanged, 3 loss, 0 other; a later rule wins."""
    return F.when(code.isin(*rules["loss"]), 3).when(code.isin(*rules["unchanged"]), 2).when(code.isin(*rules["gain"]), 1).otherwise(0)


def gain_loss_counts(tr: DataFrame, rules: Mapping[str, Sequence[int]], by: Sequence[str] = ()) -> DataFrame:
    out = tr.groupBy(*by, gain_loss_map(F.col("code"), rules).alias("state")).agg(F.sum("n").alias("n"))
    return out.withColumn("ha", F.col("n") * HA)


def chi_square_table(px: DataFrame, c1: str, c2: str) -> DataFrame:
    """Per class: frequencies, fraction, expected (whole), observed and (O-E)²/E; null where nothing is expected."""
    gl = gain_loss(px, c1, c2).select("class", F.col("n1").alias("f1"), F.col("n2").alias("f2"))
    gl = gl.withColumn("fraction", F.col("f1") / F.sum("f1").over(Window.partitionBy())).withColumn("expected", (F.col("fraction") * F.sum("f2").over(Window.partitionBy())).cast("bigint"))
    o_e = F.col("f2") - F.col("expected")
    return gl.withColumn("chi", o_e * o_e / F.nullif(F.col("expected"), F.lit(0)))


def chi_square_maps(px: DataFrame, c1: str, c2: str) -> DataFrame:
    """chi2, degrees of freedom, n and Cramér's V of two class distributions."""
    s = chi_square_table(px, c1, c2).agg(F.sum("chi").alias("chi2"), (F.count("*") - 1).alias("dof"), (F.sum("f1") + F.sum("f2")).alias("n"))
    v = F.sqrt(F.col("chi2") / (F.col("n") * F.nullif(F.least(F.col("dof"), F.lit(1)), F.lit(0))))
    return s.select("chi2", "dof", "n", v.alias("cramers_v"))


def critical_value(dof: int, alpha: float = 0.05) -> float:
    return chisq.quantile(1 - alpha, dof)


def contingency_test(table: DataFrame, alpha: float = 0.05) -> dict[str, object]:
    """Independence test of the two rows expected and observed (columns of ``table``; at most a row a class).

    Classes that are 0 on both sides are dropped; with one degree of freedom Yates' correction applies.
    """
    s = table.filter("expected > 0 or f2 > 0").select(F.col("expected").alias("a"), F.col("f2").alias("b"))
    s = s.withColumns({"sa": F.sum("a").over(Window.partitionBy()), "sb": F.sum("b").over(Window.partitionBy()), "k": F.count("*").over(Window.partitionBy())})
    yates = F.when(F.col("k") == 2, 0.5).otherwise(0.0)

    def part(x: str, sx: str) -> Column:
        e = (F.col("a") + F.col("b")) * F.col(sx) / (F.col("sa") + F.col("sb"))
        d = F.abs(F.col(x) - e)
        return F.pow(d - F.least(yates, d), 2) / e

    r = s.agg(F.sum(part("a", "sa") + part("b", "sb")).alias("x"), F.max("k").alias("k")).first()
    dof = (r["k"] or 1) - 1
    p = chisq.upper_tail(r["x"], dof) if dof else 1.0
    return {"statistic": r["x"], "p": p, "dof": dof, "critical": critical_value(dof, alpha) if dof else None, "dependent": p <= alpha}


def change_report(px: DataFrame, c1: str, c2: str, alpha: float = 0.05) -> DataFrame:
    """Key and value rows of a change run: change, both chi-square tests and the conclusion.

    The tests look at a counted table of a row a class, from which the driver gets one row.
    """
    one = change_summary(px, c1, c2).join(chi_square_maps(px, c1, c2), how="cross").first()
    test = contingency_test(chi_square_table(px, c1, c2), alpha)
    rows = {
        "change_pixels": one["changed"], "total_pixels": one["total"], "percent_change": one["percent"], "change_ha": one["ha"], "chi_square": one["chi2"], "dof": one["dof"],
        "sample_size": one["n"], "m": min(one["dof"], 1), "cramers_v": one["cramers_v"], "alpha": alpha, "critical_value": critical_value(one["dof"], alpha) if one["dof"] else None,
        "contingency_statistic": test["statistic"], "p_value": test["p"], "contingency_dof": test["dof"], "maps_differ": float(test["dependent"]),
    }
    return px.sparkSession.createDataFrame([(k, None if v is None else float(v)) for k, v in rows.items()], "key string, value double")


def zone_compare(tr: DataFrame, source: int, targets: Sequence[int], zones: Sequence[str], zone: str = "zone") -> DataFrame:
    """Hectares and percent of a class's loss to each target, a column per zone, as ``ha (pct%)``."""
    pct = F.col("n") / F.sum("n").over(Window.partitionBy(zone, "c1")) * 100
    rows = both_valid(tr).withColumn("pct", pct).filter((F.col("c1") == source) & F.col("c2").isin(*targets))
    rows = rows.withColumn("text", F.concat(F.format_number(F.col("ha"), 2), F.lit(" ("), F.format_number("pct", 2), F.lit("%)")))
    return rows.groupBy("c2").pivot(zone, list(zones)).agg(F.first("text"))


def transition_labels(tr: DataFrame, drop: Sequence[int] = ()) -> DataFrame:
    """``area\\npercent%`` for every cell of the transition matrix, without rare classes."""
    pct = F.col("n") / F.sum("n").over(Window.partitionBy("c1")) * 100
    rows = both_valid(tr).withColumn("pct", pct).filter(~F.col("c1").isin(*drop) & ~F.col("c2").isin(*drop) if drop else F.lit(True))
    return rows.select("c1", "c2", F.concat(F.format_number(F.col("ha"), 2), F.lit("\n"), F.format_number("pct", 2), F.lit("%")).alias("text"))


def change_pixel_counts(px: DataFrame, ref: tuple[str, str], map_: tuple[str, str]) -> DataFrame:
    """Transition counts of reference and map on the union of codes, and the reference's percents; code 0 is left out."""
    r = transition_counts(px, *ref).groupBy("code").agg(F.sum("n").alias("ref_n"))
    m = transition_counts(px, *map_).groupBy("code").agg(F.sum("n").alias("map_n"))
    both = r.join(m, "code", "full").filter("code <> 0")
    return both.withColumn("ref_pct", F.col("ref_n") / F.sum("ref_n").over(Window.partitionBy()) * 100)
