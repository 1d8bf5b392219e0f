"""Stratified window sampling and sample-size design."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIX = ["tile", "row", "col"]


def train_targets(freq: DataFrame, share: float) -> DataFrame:
    """Target pixels per class, truncated."""
    return freq.withColumn("target", (F.col("n") * share).cast("bigint"))


def windows(px: DataFrame, w: int, rows: int, cols: int, r0: int = 0, c0: int = 0) -> DataFrame:
    """The lattice window (wr, wc) of each pixel; those that do not fit whole between the corners are left out."""
    out = px.withColumns({"wr": F.floor((F.col("row") - r0) / w).cast("int"), "wc": F.floor((F.col("col") - c0) / w).cast("int")})
    return out.filter((F.col("row") >= r0) & (F.col("col") >= c0) & ((F.col("wr") + 1) * w + r0 <= rows) & ((F.col("wc") + 1) * w + c0 <= cols))


def window_counts(px: DataFrame, value: str = "value") -> DataFrame:
    return px.filter(F.col(value).isNotNull()).groupBy("wr", "wc", F.col(value).alias("class")).agg(F.count("*").alias("n"))


def window_order(seed: int) -> Column:
    """A random but repeatable order of windows."""
    return F.md5(F.concat_ws(":", F.lit(seed), "wr", "wc"))


def _first_windows(drawn: DataFrame, n: int) -> DataFrame:
    """The first n windows of the order: whole bins of its first digits, and as many of the next bin as are lacking."""
    drawn = drawn.withColumn("bin", F.substring("h", 1, 3))
    bins = drawn.groupBy("bin").agg(F.count("*").alias("s"))  # 4096 at most
    bins = bins.withColumn("ahead", F.coalesce(F.sum("s").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("s")
    drawn = drawn.join(bins, "bin").filter(F.col("ahead") < n)
    place = F.col("ahead") + F.row_number().over(Window.partitionBy("bin").orderBy("h"))
    return drawn.withColumn("place", place).filter(F.col("place") <= n)


def stratified_windows(counts: DataFrame, targets: DataFrame, seed: int, max_windows: int | None = None) -> DataFrame:
    """Windows that each class takes, in random order, until its count reaches the target: (wr, wc, class, n, before).

    Running totals have two phases, so that the largest class is never sorted in one task: bins of the first hex digits
    of the order are summed and cumulated first, then only the order within a bin is.  ``targets`` is a class table.
    """
    rows = counts.join(targets.select("class", "target"), "class").withColumn("h", window_order(seed))
    if max_windows is not None:
        drawn = _first_windows(counts.select("wr", "wc").distinct().withColumn("h", window_order(seed)), max_windows)
        rows = rows.join(drawn.select("wr", "wc"), ["wr", "wc"], "left_semi")
    rows = rows.withColumn("bin", F.substring("h", 1, 3))
    bins = rows.groupBy("class", "bin").agg(F.sum("n").alias("s"))
    ahead = Window.partitionBy("class").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("ahead", F.coalesce(F.sum("s").over(ahead), F.lit(0))).drop("s")
    rows = rows.join(bins, ["class", "bin"]).filter(F.col("ahead") < F.col("target"))
    within = Window.partitionBy("class", "bin").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.col("ahead") + F.coalesce(F.sum("n").over(within), F.lit(0)))
    return rows.filter(F.col("before") < F.col("target")).select("wr", "wc", "class", "n", "before", "target")


def stratified_sample(px: DataFrame, targets: DataFrame, w: int, rows: int, cols: int, seed: int = 1, value: str = "value", box: tuple[int, int, int, int] | None = None, max_windows: int | None = None) -> DataFrame:
    """Pixels sampled by whole windows; classes without a target are ignored; ``box`` is (r0, c0, r1, c1)."""
    r0, c0, r1, c1 = box or (0, 0, rows, cols)
    lattice = windows(px, w, r1, c1, r0, c0)
    taken = stratified_windows(window_counts(lattice, value), targets, seed, max_windows)
    kept = lattice.join(taken.select("wr", "wc", F.col("class").alias(value)), ["wr", "wc", value], "left_semi")
    return kept.select(*px.columns)


def window_table(px: DataFrame, columns: Sequence[str], w: int) -> DataFrame:
    """A row per lattice window and tuple of values: wr, wc, the columns, n, and the last row and column seen.

    One scan of the pixels, combined before the exchange; frequencies, samples by windows and what is counted at them
    follow from this table, which holds a row for several pixels.
    """
    at = {"wr": F.floor(F.col("row") / w).cast("int"), "wc": F.floor(F.col("col") / w).cast("int")}
    return px.withColumns(at).groupBy("wr", "wc", *columns).agg(F.count("*").alias("n"), F.max("row").alias("last_row"), F.max("col").alias("last_col"))


def sampled_table(table: DataFrame, value: str, share: float, w: int, seed: int = 1) -> DataFrame:
    """The rows of a ``window_table`` whose pixels a stratified sample of whole windows takes, by classes of ``value``."""
    size = table.agg((F.max("last_row") + 1).alias("rows"), (F.max("last_col") + 1).alias("cols"))
    whole = table.join(F.broadcast(size), how="cross").filter(((F.col("wr") + 1) * w <= F.col("rows")) & ((F.col("wc") + 1) * w <= F.col("cols")))
    known = F.col(value).isNotNull()
    freq = table.filter(known).groupBy(F.col(value).alias("class")).agg(F.sum("n").alias("n"))
    counts = whole.filter(known).groupBy("wr", "wc", F.col(value).alias("class")).agg(F.sum("n").alias("n"))
    taken = stratified_windows(counts, train_targets(freq, share), seed)
    return whole.join(taken.select("wr", "wc", F.col("class").alias(value)), ["wr", "wc", value], "left_semi").select(*table.columns)


def sample_report(freq: DataFrame, targets: DataFrame, sample: DataFrame) -> DataFrame:
    """Pixels, target, sampled, percents of target and class, and whether the target is met; all inputs are class tables."""
    out = freq.join(targets.select("class", "target"), "class").join(sample.select("class", F.col("n").alias("sampled")), "class", "left")
    s = F.coalesce("sampled", F.lit(0))
    return out.select("class", F.col("n").alias("pixels"), "target", s.alias("sampled"), (s / F.nullif(F.col("target"), F.lit(0)) * 100).alias("pct_of_target"), (s / F.col("n") * 100).alias("pct_of_class"), (s >= F.col("target")).alias("complete"))


def sample_mask(px: DataFrame, sample: DataFrame, value: str = "value") -> DataFrame:
    """mask (0 or 1) and the sampled label."""
    s = sample.select(*PIX).distinct().withColumn("mask", F.lit(1))
    out = px.join(s, PIX, "left").withColumn("mask", F.coalesce("mask", F.lit(0)))
    return out.withColumn("sampled", F.when(F.col("mask") == 1, F.col(value)))


def sample_size(strata: DataFrame, se: float = 0.01, short: bool = False) -> DataFrame:
    """n for a target standard error, from strata (class, pixels, u): (ΣWS)² / (SE² + ΣWS²/N), or (ΣWS/SE)²."""
    n = F.sum("pixels").over(Window.partitionBy())
    w, s = F.col("pixels") / n, F.sqrt(F.col("u") * (1 - F.col("u")))
    sums = strata.select(F.col("pixels"), (w * s).alias("ws"), (w * s * s).alias("wss")).agg(F.sum("pixels").alias("total"), F.sum("ws").alias("ws"), F.sum("wss").alias("wss"))
    size = F.pow(F.col("ws") / se, 2) if short else F.pow("ws", 2) / (se * se + F.col("wss") / F.col("total"))
    return sums.select("total", size.alias("size"))


def allocate(strata: DataFrame, n: DataFrame, fixed: int = 75, step: int = 25, factor: float = 1.0) -> DataFrame:
    """Equal, proportional and three fixed-for-small allocations by class, and their totals (class null).

    Strata whose proportional share is below a fixed value get that value; the others share the rest in proportion,
    with the weight of the small strata of the first allocation spread evenly.  A class table: one partition is right.
    """
    size = F.bround(F.col("size"))
    rows = strata.join(F.broadcast(n.select("size")), how="cross")
    all_ = Window.partitionBy()
    rows = rows.withColumn("w", F.col("pixels") / F.sum("pixels").over(all_)).withColumn("k", F.count("*").over(all_))
    rows = rows.withColumn("prop", (size * F.col("w")).cast("bigint")).withColumn("equal", F.bround(F.col("size") / F.col("k")).cast("bigint"))
    small = F.col("prop") < fixed + step
    rows = rows.withColumn("fw", F.sum(F.when(small, F.col("w")).otherwise(0.0)).over(all_)).withColumn("fk", F.count_if(small).over(all_))
    add = F.coalesce(F.bround(F.col("fw") / F.nullif(F.col("k") - F.col("fk"), F.lit(0)), 2), F.lit(0.0))
    rows = rows.withColumn("add", add)
    names = []
    for i, v in enumerate((fixed + step, fixed, fixed - step), 1):
        low = F.col("prop") < v
        rows = rows.withColumn("r", F.count_if(low).over(all_) * v)
        rest = F.when(F.col("r") < F.col("size"), F.bround(F.col("size") - F.col("r"))).otherwise(F.col("size"))
        rows = rows.withColumn(f"alloc{i}", F.when(low, v).otherwise((F.bround(F.col("w") + F.col("add"), 2) * rest).cast("bigint")).cast("bigint"))
        names.append(f"alloc{i}")
    names = ["equal", *names, "prop"]
    rows = rows.select("class", *[(F.col(c) * factor).cast("bigint").alias(c) for c in names])
    return rows.unionByName(rows.agg(F.lit(None).cast("int").alias("class"), *[F.sum(c).alias(c) for c in names]))


def change_label(code: Column, short: Mapping[int, str]) -> Column:
    """``AG->UR`` for a transition code, ``AG`` for no change, ``--`` for unknown classes."""
    table = F.create_map(*[F.lit(x) for kv in short.items() for x in kv])
    a, b = F.try_element_at(table, F.floor(code / 1000).cast("int")), F.try_element_at(table, (code % 1000).cast("int"))
    return F.when(a.isNull() | b.isNull(), "--").when(a == b, a).otherwise(F.concat(a, F.lit("->"), b))


def select_strata(alloc: DataFrame, codes: Sequence[int], size: str) -> DataFrame:
    """The chosen strata with their sizes; those without are dropped."""
    return alloc.filter(F.col("class").isin(*codes)).select("class", F.col(size).alias("target")).na.drop()
