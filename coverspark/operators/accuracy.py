"""Accuracy assessment: confusion and error matrices, kappa, and area-weighted estimates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PIX = ["tile", "row", "col"]


def crosstab(df: DataFrame, classes: Sequence[int], truth: str = "truth", predict: str = "predict") -> DataFrame:
    """Counts of truth by prediction with an ``All`` row and column; classes are given, so one pass is enough."""
    cube = df.groupBy(F.col(truth).cast("string").alias("truth"), F.col(predict).cast("string").alias("predict")).agg(F.count("*").alias("n"))
    cube = cube.cube("truth", "predict").agg(F.sum("n").alias("n"))
    cube = cube.select(F.coalesce("truth", F.lit("All")).alias("truth"), F.coalesce("predict", F.lit("All")).alias("predict"), "n")
    return cube.groupBy("truth").pivot("predict", [*map(str, classes), "All"]).agg(F.sum("n")).na.fill(0)


def confusion(df: DataFrame, truth: str = "truth", predict: str = "predict", n: str | None = None) -> DataFrame:
    """truth, predict, n over the union of classes, zeros included.  Classes are few.  ``n``: rows are counted already."""
    n = df.filter(F.col(truth).isNotNull() & F.col(predict).isNotNull()).groupBy(F.col(truth).alias("truth"), F.col(predict).alias("predict")).agg((F.sum(n) if n else F.count("*")).alias("n"))
    classes = n.select(F.explode(F.array("truth", "predict")).alias("c")).distinct()
    dense = classes.select(F.col("c").alias("truth")).join(F.broadcast(classes.select(F.col("c").alias("predict"))), how="cross")
    return dense.join(n, ["truth", "predict"], "left").select("truth", "predict", F.coalesce("n", F.lit(0)).alias("n"))


def accuracy(conf: DataFrame) -> DataFrame:
    return conf.agg((F.sum(F.when(F.col("truth") == F.col("predict"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))


def normalize_conf(conf: DataFrame, by: str = "truth") -> DataFrame:
    """Shares within each truth (producer's) or each prediction (user's); null where there is none."""
    total = F.nullif(F.sum("n").over(Window.partitionBy(by)), F.lit(0))
    return conf.select("truth", "predict", (F.col("n") / total).alias("share"))


def _sides(conf: DataFrame) -> DataFrame:
    """Per class: right, truth total, prediction total, and the whole total."""
    long = conf.select(F.explode(F.array(
        F.struct(F.col("truth").alias("class"), F.col("n").alias("t"), F.lit(0).cast("bigint").alias("p"), F.when(F.col("truth") == F.col("predict"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("predict").alias("class"), F.lit(0).cast("bigint").alias("t"), F.col("n").alias("p"), F.lit(0).cast("bigint").alias("hit")))).alias("e")).select("e.*")
    out = long.groupBy("class").agg(F.sum("t").alias("t"), F.sum("p").alias("p"), F.sum("hit").alias("hit"))
    return out.withColumn("total", F.sum("t").over(Window.partitionBy()))


def kappa(conf: DataFrame) -> DataFrame:
    """Cohen's kappa; null when chance agreement is one."""
    s = _sides(conf).agg((F.sum("hit") / F.max("total")).alias("po"), F.sum(F.col("t") / F.col("total") * F.col("p") / F.col("total")).alias("pe"))
    return s.select(((F.col("po") - F.col("pe")) / F.nullif(1 - F.col("pe"), F.lit(0.0))).alias("kappa"))


def class_report(conf: DataFrame) -> DataFrame:
    """precision, recall, f1 and support per class, then accuracy, macro and weighted averages; 0/0 is 0."""
    zero = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    s = _sides(conf)
    rows = s.select(F.col("class").cast("string").alias("class"), zero(F.col("hit"), F.col("p")).alias("precision"), zero(F.col("hit"), F.col("t")).alias("recall"), (2 * F.col("hit") / F.nullif(F.col("t") + F.col("p"), F.lit(0))).alias("f1"), F.col("t").alias("support"), "hit")
    rows = rows.withColumn("f1", F.coalesce("f1", F.lit(0.0)))
    score = ["precision", "recall", "f1"]
    macro = rows.agg(F.lit("macro avg").alias("class"), *[F.avg(c).alias(c) for c in score], F.sum("support").alias("support"))
    weighted = rows.agg(F.lit("weighted avg").alias("class"), *[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c) for c in score], F.sum("support").alias("support"))
    right = F.sum("hit") / F.sum("support")
    overall = rows.agg(F.lit("accuracy").alias("class"), *[right.alias(c) for c in score], F.sum("support").alias("support"))
    return rows.drop("hit").unionByName(overall).unionByName(macro).unionByName(weighted)


def assess(px: DataFrame, label: str = "label", predict: str = "predict", train: str = "is_train") -> DataFrame:
    """Counts of (split, truth, predict) for all, training and testing pixels in one pass; labels <= 0 are left out."""
    n = px.filter((F.col(label) > 0) & F.col(predict).isNotNull()).groupBy(F.when(F.col(train) == 1, "training").otherwise("testing").alias("split"), F.col(label).alias("truth"), F.col(predict).alias("predict")).agg(F.count("*").alias("n"))
    every = n.groupBy("truth", "predict").agg(F.sum("n").alias("n")).select(F.lit("all").alias("split"), "truth", "predict", "n")
    return n.unionByName(every)


def validation_counts(sites: DataFrame, truth: str = "site", predict: str = "value") -> DataFrame:
    """Validation and prediction counts per class and their difference, 0 where absent."""
    long = sites.select(F.explode(F.array(F.struct(F.col(truth).alias("class"), F.lit(1).alias("v"), F.lit(0).alias("p")), F.struct(F.col(predict).alias("class"), F.lit(0).alias("v"), F.lit(1).alias("p")))).alias("e")).select("e.*")
    out = long.filter("class is not null").groupBy("class").agg(F.sum("v").alias("validation"), F.sum("p").alias("prediction"))
    return out.withColumn("difference", F.col("prediction") - F.col("validation"))


def validate(pred: DataFrame, sites: DataFrame) -> dict[str, DataFrame]:
    """Every report of a validation run."""
    from coverspark.operators.grid import select_sites

    at = select_sites(pred, sites)
    conf = confusion(at, "site", "value")
    return {"counts": validation_counts(at), "confusion": conf, "accuracy": accuracy(conf), "users": normalize_conf(conf, "predict"), "producers": normalize_conf(conf, "truth"), "kappa": kappa(conf), "report": class_report(conf)}


def validate_windows(pred: DataFrame, points: DataFrame, sizes: Sequence[int] = (1, 3, 5)) -> DataFrame:
    """size, pixels, right and accuracy for windows of several sizes around sites (site, row, col), in one run.

    Where windows of one size overlap the greatest site wins, as in ``points_to_windows``; windows end at the map's
    edge, and sites of 0 are none.  The largest window is made once, and the map is joined once for all sizes.
    """
    k = max(sizes) // 2
    step = F.sequence(F.lit(-k), F.lit(k))
    near = points.filter("site > 0").withColumn("dr", F.explode(step)).withColumn("dc", F.explode(step))
    at = near.select((F.col("row") + F.col("dr")).alias("row"), (F.col("col") + F.col("dc")).alias("col"), F.greatest(F.abs("dr"), F.abs("dc")).alias("d"), "site")
    at = at.groupBy("row", "col").agg(*[F.max(F.when(F.col("d") <= n // 2, F.col("site"))).alias(f"s{n}") for n in sizes])
    both = pred.select("row", "col", F.coalesce("value", F.lit(0)).alias("value")).join(at, ["row", "col"])
    found = [F.struct(F.lit(n).alias("size"), F.col(f"s{n}").alias("site")) for n in sizes]
    rows = both.select("value", F.explode(F.array(*found)).alias("e")).select("value", "e.*").filter("site is not null")
    right = F.count_if(F.col("site") == F.col("value"))
    return rows.groupBy("size").agg(F.count("*").alias("pixels"), right.alias("right"), (right / F.count("*")).alias("accuracy"))


def mask_like(map_: DataFrame, ref: DataFrame) -> DataFrame:
    """Map pixels where the reference has a value."""
    return map_.join(ref.filter("value is not null").select(*PIX), PIX, "left_semi")


def sample_pairs(px: DataFrame, ref: str, map_: str, mask: str = "mask") -> DataFrame:
    """(ref, map) where sampled, without map 0 and without map classes that the reference never has there."""
    pairs = px.filter((F.col(mask) == 1) & (F.col(map_) > 0) & F.col(ref).isNotNull()).select(*PIX, F.col(ref).alias("ref"), F.col(map_).alias("map"))
    seen = pairs.select(F.col("ref").alias("map")).distinct()
    return pairs.join(seen, "map", "left_semi").select(*PIX, "ref", "map")


def pair_counts(table: DataFrame, ref: str, map_: str) -> DataFrame:
    """ref, map, n of what ``sample_pairs`` would return, from rows that count pixels (n): a few hundred at most."""
    counts = table.filter((F.col(map_) > 0) & F.col(ref).isNotNull()).groupBy(F.col(ref).alias("ref"), F.col(map_).alias("map")).agg(F.sum("n").alias("n"))
    return counts.join(counts.select(F.col("ref").alias("map")).distinct(), "map", "left_semi").select("ref", "map", "n")


def error_matrix(pairs: DataFrame, areas: DataFrame, classes: Sequence[int], weights: str = "map") -> DataFrame:
    """Rows map, columns reference (``r_<class>``), row_total, map_area and w, and a totals row (map null).

    ``areas`` has class and ha.  ``weights``: ``map``, the share of the area, or ``sample``, that of the reference sample.
    ``pairs`` may be counted already, in a column n.
    """
    pairs = pairs if "n" in pairs.columns else pairs.withColumn("n", F.lit(1).cast("bigint"))
    counts = pairs.groupBy("map").pivot("ref", list(classes)).agg(F.sum("n"))
    cols = [f"r_{c}" for c in classes]
    counts = counts.select(F.col("map").cast("int").alias("map"), *[F.coalesce(F.col(str(c)), F.lit(0)).alias(n) for c, n in zip(classes, cols, strict=True)])
    total = sum((F.col(c) for c in cols[1:]), F.col(cols[0]))
    rows = counts.withColumn("row_total", total).join(areas.select(F.col("class").alias("map"), F.col("ha").cast("bigint").alias("map_area")), "map", "left")
    if weights == "sample":
        share = pairs.groupBy(F.col("ref").alias("map")).agg(F.sum("n").alias("_n"))
        rows = rows.join(share, "map", "left").withColumn("w", F.coalesce("_n", F.lit(0)) / F.sum("row_total").over(Window.partitionBy())).drop("_n")
    else:
        rows = rows.withColumn("w", F.col("map_area") / F.sum("map_area").over(Window.partitionBy()))
    totals = rows.agg(F.lit(None).cast("int").alias("map"), *[F.sum(c).alias(c) for c in [*cols, "row_total", "map_area", "w"]])
    return rows.unionByName(totals)


def area_proportions(conf: DataFrame, areas: DataFrame) -> DataFrame:
    """map, ref, n, weight, share in its map row (u) and of the whole area (p).  ``conf``: map, ref, n; ``areas``: class, ha."""
    a = areas.select(F.col("class").alias("map"), F.col("ha").alias("a")).withColumn("total", F.sum("a").over(Window.partitionBy()))
    rows = conf.join(a, "map").withColumn("ni", F.sum("n").over(Window.partitionBy("map")))
    u = F.col("n") / F.nullif(F.col("ni"), F.lit(0))
    return rows.select("map", "ref", "n", "ni", "a", (F.col("a") / F.col("total")).alias("w"), u.alias("u"), (F.col("a") / F.col("total") * u).alias("p"), "total")


def olofsson(conf: DataFrame, areas: DataFrame) -> DataFrame:
    """User's, producer's and overall accuracy and area share of each class with standard errors.

    ``conf`` is dense (zeros included).  Estimates of strata with one sample have null standard errors.
    """
    p = area_proportions(conf, areas)
    by_ref, free = Window.partitionBy("ref"), F.nullif(F.col("ni") - 1, F.lit(0))
    var = F.col("u") * (1 - F.col("u")) / free
    p = p.withColumn("var", var).withColumn("aj", F.sum(F.col("a") * F.col("u")).over(by_ref)).withColumn("pj", F.sum("p").over(by_ref))
    off = F.when(F.col("map") != F.col("ref"), F.col("a") * F.col("a") * F.col("var")).otherwise(0.0)
    known = F.count_if(F.col("var").isNull() & (F.col("map") != F.col("ref")))
    cols = p.groupBy("ref").agg(
        F.max("pj").alias("area"), F.max("aj").alias("aj"), F.sum(F.col("w") * F.col("w") * F.col("var")).alias("area_var"), F.count_if(F.col("var").isNull()).alias("gaps"), F.sum(off).alias("off"), known.alias("off_gaps"),
        *[F.max(F.when(F.col("map") == F.col("ref"), F.col(c))).alias(n) for c, n in (("u", "ua"), ("p", "pjj"), ("var", "ua_var"), ("a", "a"), ("w", "w"))],
    )
    pa = F.col("pjj") / F.nullif(F.col("area"), F.lit(0.0))
    cols = cols.withColumn("pa", pa)
    pa_var = (F.col("a") * F.col("a") * F.pow(1 - F.col("pa"), 2) * F.col("ua_var") + F.pow("pa", 2) * F.col("off")) / F.nullif(F.pow("aj", 2), F.lit(0.0))
    cols = cols.withColumn("oa", F.sum("pjj").over(Window.partitionBy())).withColumn("oa_var", F.sum(F.col("w") * F.col("w") * F.col("ua_var")).over(Window.partitionBy()))
    return cols.select(
        F.col("ref").alias("class"), "ua", F.sqrt("ua_var").alias("ua_se"), "pa", F.when(F.col("off_gaps") == 0, F.sqrt(pa_var)).alias("pa_se"), "area", F.when(F.col("gaps") == 0, F.sqrt("area_var")).alias("area_se"), "oa", F.sqrt("oa_var").alias("oa_se")
    )


#: The normal distribution's 97.5 % point.
Z = 1.959963984540054


def accuracy_summary(estimates: DataFrame, total_ha: float) -> DataFrame:
    """Areas in ha with 95 % intervals, and printed forms as reports have them.

    Printed areas are whole, with two standard errors; accuracies have three decimals and half their interval four.
    """
    ha, se = F.col("area") * total_ha, F.col("area_se") * total_ha
    shown = lambda a, b, n, m: F.concat(F.format_number(F.round(a, n), n), F.lit(" ± "), F.format_number(F.round(b, m), m))
    ua_ci, pa_ci = Z * F.col("ua_se"), Z * F.col("pa_se")
    return estimates.select(
        "class", ha.alias("ha"), se.alias("ha_se"), (ha - Z * se).alias("ha_low"), (ha + Z * se).alias("ha_high"), ua_ci.alias("ua_ci"), pa_ci.alias("pa_ci"),
        shown(ha, 2 * se, 0, 0).alias("ha_text"), shown(F.col("ua"), ua_ci, 3, 4).alias("ua_text"), shown(F.col("pa"), pa_ci, 3, 4).alias("pa_text"),
    )
