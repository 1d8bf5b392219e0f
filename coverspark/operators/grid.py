"""Grids, tiles, masks and predicates on pixel tables (tile, row, col, ...)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIX = ["tile", "row", "col"]
SENTINEL = -13000
#: Most rows of a tile index.
TILES = 100_000


def mosaic_extent(grid: DataFrame) -> DataFrame:
    """North, west, south and east bounds from origin, resolution (yres < 0) and shape."""
    return grid.select(
        F.col("uly").alias("north"), F.col("ulx").alias("west"), (F.col("uly") + F.col("nrows") * F.col("yres")).alias("south"), (F.col("ulx") + F.col("ncols") * F.col("xres")).alias("east")
    )


def tile_slices(tiles: DataFrame, grid: DataFrame) -> DataFrame:
    """Half-open rows and columns of each tile in the mosaic; quotients are floored."""
    at = lambda edge, origin, res: F.floor((F.col(edge) - F.col(origin)) / F.col(res)).cast("int")
    joined = tiles.join(F.broadcast(grid.limit(1)), how="cross")
    return joined.select(
        "tile", at("n", "uly", "yres").alias("row0"), at("s", "uly", "yres").alias("row1"), at("w", "ulx", "xres").alias("col0"), at("e", "ulx", "xres").alias("col1")
    )


def assign_tile(px: DataFrame, slices: DataFrame) -> DataFrame:
    """The tile of each mosaic pixel and its row and column there.

    ``slices`` is a tile index, a row per tile file, which a range join compares with every pixel; so it is sent whole,
    and one that can't be small is refused.
    """
    few = slices.limit(TILES + 1).count()
    if few > TILES:
        raise ValueError(f"a tile index has at most {TILES} tiles; use regular_tiles for a regular grid")
    s = F.broadcast(slices)
    inside = (px["row"] >= s["row0"]) & (px["row"] < s["row1"]) & (px["col"] >= s["col0"]) & (px["col"] < s["col1"])
    rest = [c for c in px.columns if c not in PIX]
    return px.join(s, inside).select(s["tile"], (px["row"] - s["row0"]).alias("row"), (px["col"] - s["col0"]).alias("col"), *[px[c] for c in rest])


def regular_tiles(px: DataFrame, rows: int, cols: int) -> DataFrame:
    """Tile names for a regular tiling, without a join."""
    number = lambda c, n: F.floor(F.col(c) / n).cast("int").cast("string")
    return px.withColumn("tile", F.concat(F.lit("h"), number("col", cols), F.lit("v"), number("row", rows)))


def mosaic(px: DataFrame, slices: DataFrame, order: str = "tile") -> DataFrame:
    """Tiles put into the mosaic; where they overlap the last tile in ``order`` wins."""
    rest = [c for c in px.columns if c not in PIX]
    placed = px.join(slices, "tile").select("tile", (F.col("row") + F.col("row0")).alias("row"), (F.col("col") + F.col("col0")).alias("col"), *rest)
    last = F.max_by(F.struct("tile", *rest), F.col(order)).alias("v")
    return placed.groupBy("row", "col").agg(last).select("row", "col", "v.*")


def with_xy(px: DataFrame, grid: DataFrame) -> DataFrame:
    """Map coordinates of each pixel's upper left corner."""
    g = F.broadcast(grid.limit(1).select("ulx", "uly", "xres", "yres"))
    out = px.join(g, how="cross")
    return out.withColumns({"x": F.col("ulx") + F.col("col") * F.col("xres"), "y": F.col("uly") + F.col("row") * F.col("yres")}).drop("ulx", "uly", "xres", "yres")


def apply_mask(px: DataFrame, mask: DataFrame, value: str = "value", fill: float | None = SENTINEL) -> DataFrame:
    """Values where the mask is 1, ``fill`` elsewhere (None: null)."""
    out = px.join(mask.select(*PIX, F.col("mask").alias("_mask")), PIX, "left")
    return out.withColumn(value, F.when(F.col("_mask") == 1, F.col(value)).otherwise(F.lit(fill))).drop("_mask")


def masked(value: Column, mask: Column, fill: float | None = SENTINEL) -> Column:
    """``apply_mask`` where the mask is a column of the same table: no join."""
    return F.when(mask == 1, value).otherwise(F.lit(fill))


def mask_where(px: DataFrame, mask: DataFrame) -> DataFrame:
    """Pixels whose mask is not 0."""
    return px.join(mask.filter("mask <> 0").select(*PIX), PIX, "left_semi")


def split_masks(px: DataFrame, label: str = "label", train: str = "train", roi: str = "roi") -> DataFrame:
    """is_train, is_test (inside the region of interest) and land_cover: the label where trained."""
    t, r = F.coalesce(F.col(train), F.lit(0)) == 1, F.coalesce(F.col(roi), F.lit(0)) == 1
    return px.withColumns({"is_train": (t & r).cast("int"), "is_test": (~t & r).cast("int"), "land_cover": F.when(t & r, F.col(label))})


def split_accounting(px: DataFrame) -> DataFrame:
    """Counts and ratios of a split, one row each: a single pass."""
    n = px.agg(
        F.count("*").alias("total"), F.count_if(F.col("roi") == 1).alias("in_roi"), F.count("land_cover").alias("labels"), F.sum("is_train").alias("training"), F.sum("is_test").alias("testing")
    )
    ratio = lambda a, b: (F.col(a) / F.nullif(F.col(b), F.lit(0))).cast("double")
    whole = lambda a: F.col(a).cast("double")
    rows = [("total", whole("total")), ("roi", whole("in_roi")), ("labels_of_roi", ratio("labels", "in_roi")), ("training_of_labels", ratio("training", "labels")), ("training_of_roi", ratio("training", "in_roi")), ("testing_of_roi", ratio("testing", "in_roi"))]
    return n.select(F.explode(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in rows])).alias("e")).select("e.*")


def overlay(px: DataFrame, layers: Sequence[tuple[int, str]], value: str = "value") -> DataFrame:
    """Pixels of ancillary columns > 0 take their class, in order; the last wins."""
    out = F.col(value)
    for k, layer in layers:
        out = F.when(F.col(layer) > 0, F.lit(k)).otherwise(out)
    return px.withColumn(value, out)


def extract_zone(px: DataFrame, zones: Iterable[str], value: str = "value", zone: str = "zone") -> DataFrame:
    """The map inside each zone and 0 outside, one column a zone: one pass for all."""
    return px.select(*PIX, *[F.when(F.col(zone) == z, F.col(value)).otherwise(F.lit(0)).alias(f"{value}_{z}") for z in zones])


def common_mask(*maps: DataFrame) -> DataFrame:
    """Pixels with a value > 0 in every map; a map may repeat a pixel.  Up to 62 maps are bits of a number, more a set."""
    bits = len(maps) <= 62
    every = None
    for i, m in enumerate(maps):
        one = m.filter("value > 0").select(*PIX, F.lit(1 << i if bits else i).cast("bigint").alias("map"))
        every = one if every is None else every.unionByName(one)
    found = F.bit_or("map") if bits else F.size(F.collect_set("map"))
    return every.groupBy(*PIX).agg(found.alias("maps")).filter(F.col("maps") == ((1 << len(maps)) - 1 if bits else len(maps))).drop("maps")


def common_columns(px: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``common_mask`` for maps that are columns of one table: no shuffle."""
    found = F.lit(True)
    for c in columns:
        found = found & (F.coalesce(F.col(c), F.lit(0)) > 0)
    return px.filter(found).select(*PIX)


def select_sites(pred: DataFrame, sites: DataFrame) -> DataFrame:
    """Site value and prediction (0 where missing) at sites > 0."""
    s = sites.filter("site > 0").select(*PIX, "site")
    return s.join(pred.select(*PIX, "value"), PIX, "left").select(*PIX, "site", F.coalesce("value", F.lit(0)).alias("value"))


def keep_values(px: DataFrame, values: Sequence[int], value: str = "value") -> DataFrame:
    """Chosen values, 0 elsewhere."""
    return px.withColumn(value, F.when(F.col(value).isin(*values), F.col(value)).otherwise(0))


def crop(px: DataFrame, r0: int, r1: int, c0: int, c1: int) -> DataFrame:
    """A half-open window, counted from its own corner."""
    inside = (F.col("row") >= r0) & (F.col("row") < r1) & (F.col("col") >= c0) & (F.col("col") < c1)
    return px.filter(inside).withColumns({"row": F.col("row") - r0, "col": F.col("col") - c0})


def filter_values(px: DataFrame, values: Sequence[int], value: str = "value") -> DataFrame:
    """1 where the value is one of the given, else 0; nulls stay."""
    return px.withColumn(value, F.col(value).isin(*values).cast("int"))


def points_to_windows(points: DataFrame, grid: DataFrame, n: int = 3) -> DataFrame:
    """The n x n pixels around each point (site, x, y); where windows overlap the greatest site wins."""
    k = n // 2
    at = points.join(F.broadcast(grid.limit(1)), how="cross")
    at = at.select("site", F.floor((F.col("y") - F.col("uly")) / F.col("yres")).cast("int").alias("r"), F.floor((F.col("x") - F.col("ulx")) / F.col("xres")).cast("int").alias("c"), "nrows", "ncols")
    at = at.withColumn("dr", F.explode(F.sequence(F.lit(-k), F.lit(k)))).withColumn("dc", F.explode(F.sequence(F.lit(-k), F.lit(k))))
    at = at.withColumns({"row": F.col("r") + F.col("dr"), "col": F.col("c") + F.col("dc")})
    at = at.filter("row >= 0 and col >= 0 and row < nrows and col < ncols")
    return at.groupBy("row", "col").agg(F.max("site").alias("site"))


def missing_ratio(long: DataFrame, nan: int = SENTINEL, by: str = "month") -> DataFrame:
    """Values at or below the missing-value mark, all values and percent, by period."""
    out = long.groupBy(by).agg(F.count_if(F.col("value") <= nan).alias("missing"), F.count("value").alias("size"))
    return out.withColumn("percent", F.col("missing") / F.col("size") * 100)


def value_health(long: DataFrame, nan: int = SENTINEL, by: str = "feature") -> DataFrame:
    """Null, present, missing-mark, negative and zero counts per feature, and percents of all."""
    v = F.col("value")
    out = long.groupBy(by).agg(
        F.count("*").alias("size"), F.count_if(v.isNull()).alias("masked"), F.count("value").alias("unmasked"), F.count_if(v <= nan).alias("nan"), F.count_if((v < 0) & (v > nan)).alias("negative"), F.count_if(v == 0).alias("zero")
    )
    return out.withColumns({f"{c}_pct": F.col(c) / F.col("size") * 100 for c in ("masked", "nan", "negative", "zero")})
