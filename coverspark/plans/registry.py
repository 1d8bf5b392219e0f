"""The registered queries of the library's own operators and their SQL.

Each query runs over a whole table: a pixel grid with aligned maps, observations, scenes and plots that
``plans.fixtures`` derives from the given tables.  Doubles are rounded to six decimals in the last projection only.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coverspark.operators import accuracy, change, classes, features, forest, grid, quality, repair, sampling, series, sketches
from coverspark.plans.fixtures import ctes, view
from coverspark.sources import pixels

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CLASSES = list(range(101, 112))
PIX = "tile, row, col"


def _query(sql: str | None = None, *views: str):
    """Register a function (spark, sf_dir) -> DataFrame under its name; ``sql`` follows the views' WITH clause."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"{ctes(*views)} {sql}" if views else sql
        return f

    return add


def r6(df: DataFrame) -> DataFrame:
    """Doubles to six decimals."""
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _px(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    df = view(spark, sf_dir, "px")
    return df.select(*cols) if cols else df


def _map(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return _px(spark, sf_dir, "tile", "row", "col", F.col(name).alias("value"))


def _tr(spark: SparkSession, sf_dir: str, by: tuple[str, ...] = ()) -> DataFrame:
    return change.transition_counts(_px(spark, sf_dir), "ref1", "ref2", by)


TR = "tr AS (SELECT coalesce(ref1,0)*1000+coalesce(ref2,0) AS code, ref1 AS c1, ref2 AS c2, count(*) AS n, round_even(count(*)*0.09::DOUBLE, 2) AS ha FROM px GROUP BY ref1, ref2)"
TRZ = TR.replace("SELECT ", "SELECT zone, ", 1).replace("GROUP BY ", "GROUP BY zone, ")

# --- sources and names -------------------------------------------------------------------------------------------------


@_query("SELECT site, path, CAST(strptime(substr(path,12,7),'%Y%j') AS DATE) AS date, CAST(substr(path,12,4) AS INT) AS year, CAST(substr(path,16,3) AS INT) AS doy, 'h019v025' AS scene_tile, value FROM scene", "scene")
def parse_scene(spark, sf_dir):
    return pixels.parse_scene(view(spark, sf_dir, "scene")).select("site", "path", "date", "year", "doy", "scene_tile", "value")


@_query("SELECT DISTINCT band AS feature FROM obs", "obs")
def feature_list(spark, sf_dir):
    return pixels.feature_list(view(spark, sf_dir, "obs").withColumnRenamed("band", "feature"))


@_query("SELECT coalesce(a.f, b.f) AS feature, a.f IS NOT NULL AS in_a, b.f IS NOT NULL AS in_b FROM (SELECT DISTINCT band||' '||month AS f FROM obs WHERE month <= 8) a FULL JOIN (SELECT DISTINCT band||' '||month AS f FROM obs WHERE month >= 5) b ON a.f = b.f", "obs")
def feature_overlap(spark, sf_dir):
    long = view(spark, sf_dir, "obs").withColumn("feature", F.concat_ws(" ", "band", "month"))
    return pixels.feature_overlap(long.filter("month <= 8"), long.filter("month >= 5"))


@_query("SELECT p.tile, p.row, p.col, k.description, g.grp_desc FROM px p JOIN keys k ON p.ref1 = k.lc_key JOIN (SELECT grp_key, arg_max(grp_desc, lc_key) AS grp_desc FROM keys GROUP BY grp_key) g ON k.grp_key = g.grp_key", "px", "keys")
def class_descriptions(spark, sf_dir):
    keys = view(spark, sf_dir, "keys")
    named = keys.drop("grp_desc").join(pixels.group_names(keys), "grp_key")
    px = _px(spark, sf_dir)
    return px.join(F.broadcast(named), px["ref1"] == named["lc_key"]).select("tile", "row", "col", "description", "grp_desc")


@_query(f"SELECT {PIX}, CAST(ref1 AS SMALLINT) AS value FROM px", "px")
def pixels_round_trip(spark, sf_dir):
    """Written as typed pixels, a folder a tile, and read back with NoData as null."""
    path = pixels.shared_folder(spark)
    pixels.write_pixels(_map(spark, sf_dir, "ref1"), path)
    return pixels.read_pixels(spark, path, nodata=0).select("tile", "row", "col", "value")


@_query(f"SELECT {PIX}, CAST(round_even(sos/7.0::DOUBLE, 0) AS SMALLINT) AS value FROM px", "px")
def read_feature(spark, sf_dir):
    return pixels.read_feature(_px(spark, sf_dir, "tile", "row", "col", (F.col("sos") / F.lit(7.0)).alias("sos_week")), "sos_week")


@_query("SELECT tile, CAST(count(*) > 0 AS BOOLEAN) AS has_files FROM px GROUP BY tile", "px")
def list_files(spark, sf_dir):
    """The tiles for which the writer left files of some length."""
    path = pixels.shared_folder(spark)
    pixels.write_pixels(_map(spark, sf_dir, "ref1"), path)
    files = pixels.list_files(spark, path, ".parquet").withColumn("tile", F.regexp_extract("path", r"tile=([^/]+)/", 1))
    return files.groupBy("tile").agg((F.min("length") > 0).alias("has_files"))


def _text(df: DataFrame, *parts) -> str:
    """Write lines made of the parts and return their folder."""
    path = pixels.shared_folder(df.sparkSession)
    df.select(F.concat(*parts).alias("value")).write.text(path)
    return path


@_query("SELECT tile, 2000000-30*min(row) AS n, 500000+30*min(col) AS w, 2000000-30*(max(row)+1) AS s, 500000+30*(max(col)+1) AS e FROM px GROUP BY tile", "px")
def read_tiles(spark, sf_dir):
    lit, text = F.lit, lambda c: F.col(c).cast("string")
    path = _text(_tiles(spark, sf_dir), F.col("tile"), lit(",N="), text("n"), lit(".7,W="), text("w"), lit(",S="), text("s"), lit(",E="), text("e"))
    return pixels.read_tiles(spark, path)


@_query("SELECT DISTINCT 'CLASS_'||ref1 AS key, CAST(ref1 AS INT) AS value FROM px WHERE ref1 IS NOT NULL", "px")
def read_params(spark, sf_dir):
    path = _text(_freq(spark, sf_dir), F.lit("CLASS_"), F.col("class").cast("string"), F.lit(" = "), F.col("class").cast("string"))
    return pixels.read_params(spark, path)


@_query("SELECT lc_key AS key, lc_key%256 AS r, 10 AS g, 20 AS b, 255 AS a, description AS label FROM keys WHERE lc_key IN (SELECT ref1 FROM px)", "px", "keys")
def read_legend(spark, sf_dir):
    used = view(spark, sf_dir, "keys").join(_freq(spark, sf_dir), F.col("lc_key") == F.col("class"), "left_semi")
    key = F.col("lc_key").cast("string")
    path = _text(used, key, F.lit("  "), (F.col("lc_key") % 256).cast("string"), F.lit(" 10 20 255 - "), F.col("description"))
    return pixels.read_legend(spark, path)


@_query("SELECT lc_key, description, grp_key, grp_desc FROM keys WHERE lc_key IN (SELECT ref1 FROM px)", "px", "keys")
def read_class_keys(spark, sf_dir):
    """Through the report writer: one CSV file with a header."""
    path = pixels.shared_folder(spark)
    pixels.write_report(view(spark, sf_dir, "keys").join(_freq(spark, sf_dir), F.col("lc_key") == F.col("class"), "left_semi").select("grp_key", "grp_desc", "lc_key", "description"), path)
    return pixels.read_class_keys(spark, path, (2, 3, 0, 1))


@_query("SELECT unnest(['pixels','rows']) AS key, unnest([CAST(count(*) AS VARCHAR), CAST(max(row)+1 AS VARCHAR)]) AS value FROM px", "px")
def run_record(spark, sf_dir):
    found = _px(spark, sf_dir).agg(F.count("*").alias("pixels"), (F.max("row") + 1).alias("rows")).first()
    return pixels.run_record(spark, found.asDict())


@_query("SELECT unnest(['first','second']) AS run, 'pixels' AS key, CAST(count(*) AS VARCHAR) AS value FROM px", "px")
def run_log(spark, sf_dir):
    """Two runs appended to one log."""
    path, n = pixels.shared_folder(spark), _px(spark, sf_dir).count()
    for run in ("first", "second"):
        pixels.append_record(spark, {"pixels": n}, path, run)
    return pixels.read_records(spark, path)


@_query("SELECT tile, CAST(1 AS BIGINT) AS files, 'parquet' AS kind FROM px GROUP BY tile", "px")
def files_by_tile(spark, sf_dir):
    """The writer leaves one file a tile; names come from the listing."""
    path = pixels.shared_folder(spark)
    pixels.write_pixels(_map(spark, sf_dir, "ref1"), path)
    name = F.element_at(F.split("path", "/"), -1)
    files = pixels.list_files(spark, path, ".parquet").withColumn("tile", F.regexp_extract("path", r"tile=([^/]+)/", 1))
    return files.filter("length > 0").groupBy("tile", F.element_at(F.split(name, r"\."), -1).alias("kind")).agg(F.count("*").alias("files"))


def _stored(spark, sf_dir, name):
    path = pixels.shared_folder(spark)
    return pixels.store_pixels(_map(spark, sf_dir, name), f"map_{path.rsplit('/', 1)[-1]}", 8, path)


@_query(f"SELECT {PIX}, CASE WHEN ref2 IS NULL THEN NULL WHEN map2 IS NULL OR ref2<>map2 THEN 1 ELSE 0 END AS flag FROM px", "px")
def change_flag_stored(spark, sf_dir):
    """Maps stored in buckets meet without an exchange."""
    both = change.pair(_stored(spark, sf_dir, "ref2"), _stored(spark, sf_dir, "map2"))
    return both.select("tile", "row", "col", change.change_flag(F.col("c1"), F.col("c2")).alias("flag"))


@_query("SELECT tile, row-25 AS row, col-30 AS col, ref1 AS value FROM px WHERE row>=25 AND row<75 AND col>=30 AND col<90", "px")
def crop_stored(spark, sf_dir):
    """A window of a map stored in squares: files of squares outside it are not read."""
    path = pixels.shared_folder(spark)
    pixels.write_blocks(_map(spark, sf_dir, "ref1"), path, 25)
    return grid.crop(pixels.read_box(spark, path, 25, 75, 30, 90, 25), 25, 75, 30, 90)


# --- grid --------------------------------------------------------------------------------------------------------------

GRID = "grid AS (SELECT 500000.0::DOUBLE AS ulx, 2000000.0::DOUBLE AS uly, 30.0::DOUBLE AS xres, -30.0::DOUBLE AS yres, max(row)+1 AS nrows, max(col)+1 AS ncols FROM px)"
TILES = "tiles AS (SELECT tile, 2000000-30*min(row) AS n, 500000+30*min(col) AS w, 2000000-30*(max(row)+1) AS s, 500000+30*(max(col)+1) AS e FROM px GROUP BY tile)"
SLICES = "slices AS (SELECT tile, min(row) AS row0, max(row)+1 AS row1, min(col) AS col0, max(col)+1 AS col1 FROM px GROUP BY tile)"


def _grid(spark, sf_dir):
    d = lambda x: F.lit(float(x))
    shape = _px(spark, sf_dir).agg((F.max("row") + 1).alias("nrows"), (F.max("col") + 1).alias("ncols"))
    return shape.select(d(500000).alias("ulx"), d(2000000).alias("uly"), d(30).alias("xres"), d(-30).alias("yres"), "nrows", "ncols")


def _tiles(spark, sf_dir):
    edge = lambda c, k, base: (F.lit(base) + k * c).cast("bigint")
    return _px(spark, sf_dir).groupBy("tile").agg(
        edge(F.min("row"), -30, 2000000).alias("n"), edge(F.min("col"), 30, 500000).alias("w"), edge(F.max("row") + 1, -30, 2000000).alias("s"), edge(F.max("col") + 1, 30, 500000).alias("e")
    )


def _slices(spark, sf_dir):
    return grid.tile_slices(_tiles(spark, sf_dir), _grid(spark, sf_dir))


@_query(f", {GRID} SELECT uly AS north, ulx AS west, uly+nrows*yres AS south, ulx+ncols*xres AS east FROM grid", "px")
def mosaic_extent(spark, sf_dir):
    return grid.mosaic_extent(_grid(spark, sf_dir))


@_query(f", {SLICES} SELECT * FROM slices", "px")
def tile_slices(spark, sf_dir):
    return _slices(spark, sf_dir)


@_query(f", {SLICES} SELECT p.tile, p.row-s.row0 AS row, p.col-s.col0 AS col, p.ref1 AS value FROM px p JOIN slices s ON p.tile = s.tile", "px")
def mosaic_cut(spark, sf_dir):
    return grid.assign_tile(_map(spark, sf_dir, "ref1"), _slices(spark, sf_dir))


@_query("SELECT tile, row, col, ref1 AS value FROM px", "px")
def mosaic_round_trip(spark, sf_dir):
    slices = _slices(spark, sf_dir)
    out = grid.mosaic(grid.assign_tile(_map(spark, sf_dir, "ref1"), slices), slices)
    return out.select("tile", "row", "col", "value")


@_query("SELECT 'h'||(col//50)||'v'||(row//50) AS tile, row, col FROM px", "px")
def regular_tiles(spark, sf_dir):
    return grid.regular_tiles(_px(spark, sf_dir, "row", "col"), 50, 50).select("tile", "row", "col")


@_query(f"SELECT {PIX}, 500000.0::DOUBLE+30*col AS x, 2000000.0::DOUBLE-30*row AS y FROM px", "px")
def with_xy(spark, sf_dir):
    return grid.with_xy(_px(spark, sf_dir, "tile", "row", "col"), _grid(spark, sf_dir)).select("tile", "row", "col", "x", "y")


@_query(f"SELECT {PIX}, CASE WHEN roi=1 THEN ref1 ELSE -13000 END AS value FROM px", "px")
def apply_mask(spark, sf_dir):
    mask = _px(spark, sf_dir, "tile", "row", "col", F.col("roi").alias("mask"))
    return grid.apply_mask(_map(spark, sf_dir, "ref1"), mask)


@_query(f"SELECT {PIX}, ref1 AS value FROM px WHERE urban <> 0", "px")
def mask_where(spark, sf_dir):
    return grid.mask_where(_map(spark, sf_dir, "ref1"), _px(spark, sf_dir, "tile", "row", "col", F.col("urban").alias("mask")))


def _split(spark, sf_dir):
    px = _px(spark, sf_dir).withColumn("train", (F.col("pix") % 10 == 0).cast("int"))
    return grid.split_masks(px, "ref1")


SPLIT = "sp AS (SELECT *, CAST(pix%10=0 AND roi=1 AS INT) AS is_train, CAST(NOT pix%10=0 AND roi=1 AS INT) AS is_test, CASE WHEN pix%10=0 AND roi=1 THEN ref1 END AS land_cover FROM px)"


@_query(f", {SPLIT} SELECT {PIX}, is_train, is_test, land_cover FROM sp", "px")
def split_masks(spark, sf_dir):
    return _split(spark, sf_dir).select("tile", "row", "col", "is_train", "is_test", "land_cover")


@_query(f""", {SPLIT}, s AS (SELECT count(*)::DOUBLE AS t, count(*) FILTER (roi=1)::DOUBLE AS r, count(land_cover)::DOUBLE AS l, sum(is_train)::DOUBLE AS tr, sum(is_test)::DOUBLE AS te FROM sp)
SELECT unnest(['total','roi','labels_of_roi','training_of_labels','training_of_roi','testing_of_roi']) AS key, round(unnest([t, r, l/r, tr/l, tr/r, te/r]), 6) AS value FROM s""", "px")
def split_accounting(spark, sf_dir):
    return r6(grid.split_accounting(_split(spark, sf_dir)))


@_query(f"SELECT {PIX}, CASE WHEN roi=0 THEN 103 WHEN urban>0 THEN 102 ELSE ref1 END AS value FROM px", "px")
def overlay_ancillary(spark, sf_dir):
    px = _px(spark, sf_dir).withColumn("water", 1 - F.col("roi"))
    return grid.overlay(px, [(102, "urban"), (103, "water")], "ref1").select("tile", "row", "col", F.col("ref1").alias("value"))


@_query(f"SELECT {PIX}, CASE WHEN zone='in' THEN ref1 ELSE 0 END AS ref1_in, CASE WHEN zone='out' THEN ref1 ELSE 0 END AS ref1_out FROM px", "px")
def extract_zone(spark, sf_dir):
    return grid.extract_zone(_px(spark, sf_dir), ["in", "out"], "ref1")


@_query(f"SELECT {PIX} FROM px WHERE ref1>0 AND map1>0 AND ref2>0 AND map2>0", "px")
def common_mask(spark, sf_dir):
    return grid.common_mask(*[_map(spark, sf_dir, m) for m in ("ref1", "map1", "ref2", "map2")])


@_query(f"SELECT {PIX} FROM px WHERE ref1>0 AND map2>0", "px")
def common_mask_wide(spark, sf_dir):
    return grid.common_columns(_px(spark, sf_dir), ["ref1", "map2"])


def _sites(spark, sf_dir):
    return _px(spark, sf_dir, "tile", "row", "col", F.col("ref1").alias("site"))


SITES = "st AS (SELECT tile, row, col, ref1 AS site, coalesce(map1,0) AS value FROM px WHERE ref1>0)"


@_query(f", {SITES} SELECT * FROM st", "px")
def select_sites(spark, sf_dir):
    return grid.select_sites(_map(spark, sf_dir, "map1"), _sites(spark, sf_dir))


@_query(f"SELECT {PIX}, CASE WHEN ref1 IN (101,106) THEN ref1 ELSE 0 END AS value FROM px", "px")
def keep_values(spark, sf_dir):
    return grid.keep_values(_map(spark, sf_dir, "ref1"), [101, 106])


@_query("SELECT tile, row-2 AS row, col-10 AS col, ref1 AS value FROM px WHERE row>=2 AND row<12 AND col>=10 AND col<60", "px")
def crop(spark, sf_dir):
    return grid.crop(_map(spark, sf_dir, "ref1"), 2, 12, 10, 60)


@_query(f"SELECT {PIX}, CAST(ref1 IN (101,106,999) AS INT) AS value FROM px", "px")
def filter_values(spark, sf_dir):
    return grid.filter_values(_map(spark, sf_dir, "ref1"), [101, 106, 999])


@_query(""", g AS (SELECT max(row)+1 AS nr, max(col)+1 AS nc FROM px), p AS (SELECT ref1 AS site, row AS r, col AS c FROM px WHERE ref1 IS NOT NULL)
SELECT r+dr AS row, c+dc AS col, max(site) AS site FROM p, g, (SELECT unnest([-1,0,1]) AS dr) a, (SELECT unnest([-1,0,1]) AS dc) b WHERE r+dr BETWEEN 0 AND nr-1 AND c+dc BETWEEN 0 AND nc-1 GROUP BY ALL""", "px")
def points_windows(spark, sf_dir):
    pts = _px(spark, sf_dir).filter("ref1 is not null")
    pts = pts.select(F.col("ref1").alias("site"), (F.col("col") * 30.0 + 500010).alias("x"), (F.lit(1999990.0) - F.col("row") * 30).alias("y"))
    return grid.points_to_windows(pts, _grid(spark, sf_dir), 3)


@_query("SELECT month, count(*) FILTER (value <= -13000) AS missing, count(*) AS size, round(count(*) FILTER (value <= -13000) / count(*) * 100, 6) AS percent FROM obs GROUP BY month", "obs")
def missing_ratio(spark, sf_dir):
    return r6(grid.missing_ratio(view(spark, sf_dir, "obs")))


@_query(", u AS (FROM (SELECT sos, eos, los, sr_aerosol FROM px) UNPIVOT INCLUDE NULLS (value FOR feature IN (sos, eos, los, sr_aerosol))) SELECT feature, count(*) AS size, count(*) FILTER (value IS NULL) AS masked, count(value) AS unmasked, count(*) FILTER (value <= -13000) AS nan, count(*) FILTER (value < 0 AND value > -13000) AS negative, count(*) FILTER (value = 0) AS zero, round(masked/size*100,6) AS masked_pct, round(nan/size*100,6) AS nan_pct, round(negative/size*100,6) AS negative_pct, round(zero/size*100,6) AS zero_pct FROM u GROUP BY feature", "px")
def value_health(spark, sf_dir):
    return r6(grid.value_health(features.to_long(_px(spark, sf_dir), ["sos", "eos", "los", "sr_aerosol"])))


# --- quality -----------------------------------------------------------------------------------------------------------

RANK = """CASE WHEN sr_aerosol IS NULL THEN NULL WHEN pixel_qa>>2&1=1 OR pixel_qa>>4&1=1 THEN 3
WHEN pixel_qa>>1&1=0 OR pixel_qa>>3&1=1 OR pixel_qa>>5&1=1 OR sr_aerosol>>3&1=1 OR (pixel_qa>>8&3)>=2 OR (pixel_qa>>6&3)>=2 OR (sr_aerosol>>6&3) IN (0,3) THEN 2
WHEN (sr_aerosol>>6&3)=2 THEN 1 ELSE 0 END"""


@_query(f"SELECT {PIX}, pixel_qa & 32 AS cloud_raw, pixel_qa >> 5 & 1 AS cloud FROM px", "px")
def qa_bits(spark, sf_dir):
    qa = F.col("pixel_qa")
    return _px(spark, sf_dir, "tile", "row", "col", quality.get_bit(qa, 5).alias("cloud_raw"), quality.get_normalized_bit(qa, 5).alias("cloud"))


@_query(f"SELECT {PIX}, {RANK} AS rank FROM px", "px")
def qa_rank(spark, sf_dir):
    return _px(spark, sf_dir, "tile", "row", "col", quality.qa_rank(F.col("pixel_qa"), F.col("sr_aerosol")).alias("rank"))


@_query(f"SELECT {RANK} AS rank, count(*) AS pixels, max(pixel_qa) AS qa_max, min(pixel_qa) AS qa_min, round(avg(pixel_qa),6) AS qa_mean, round(stddev_pop(pixel_qa),6) AS qa_std FROM px GROUP BY 1", "px")
def qa_summary(spark, sf_dir):
    return r6(quality.qa_summary(_px(spark, sf_dir)))


# --- classes -----------------------------------------------------------------------------------------------------------

FREQ = "f AS (SELECT ref1 AS class, count(*) AS n FROM px WHERE ref1 IS NOT NULL GROUP BY ref1)"


def _freq(spark, sf_dir, col="ref1"):
    return classes.class_freq(_px(spark, sf_dir), col)


@_query(f", {FREQ} SELECT * FROM f", "px")
def class_freq(spark, sf_dir):
    return classes.class_freq(_px(spark, sf_dir), "ref1", sort=True)


@_query(f", {FREQ} SELECT class, n, round(n/sum(n) OVER ()*100,6) AS percent FROM f", "px")
def class_percent(spark, sf_dir):
    return r6(classes.class_percent(_freq(spark, sf_dir)))


@_query(f", {FREQ} SELECT grp_key, class, CAST(sum(n) AS BIGINT) AS n FROM f JOIN keys ON class=lc_key GROUP BY GROUPING SETS ((grp_key, class), (grp_key))", "px", "keys")
def class_group_freq(spark, sf_dir):
    return classes.class_group_freq(_px(spark, sf_dir), view(spark, sf_dir, "keys"), "ref1")


@_query(f", {FREQ} SELECT grp_key, string_agg(CAST(class AS VARCHAR), ',' ORDER BY class) AS classes FROM f JOIN keys ON class=lc_key GROUP BY grp_key", "px", "keys")
def classes_by_group(spark, sf_dir):
    return classes.classes_by_group(_px(spark, sf_dir), view(spark, sf_dir, "keys"), "ref1")


@_query(f"SELECT {PIX}, coalesce(grp_key,0) AS value FROM px LEFT JOIN keys ON ref1=lc_key", "px", "keys")
def reclassify(spark, sf_dir):
    return classes.reclassify(_map(spark, sf_dir, "ref1"), view(spark, sf_dir, "keys"))


@_query(f", {FREQ} SELECT class, description, grp_key, grp_desc, n, round(n/sum(n) OVER ()*100,6) AS percent FROM f LEFT JOIN keys ON class=lc_key", "px", "keys")
def class_table(spark, sf_dir):
    return r6(classes.class_table(_px(spark, sf_dir), view(spark, sf_dir, "keys"), "ref1"))


@_query(f", {FREQ} SELECT class, n, round(n/sum(n) OVER ()*100,6) AS percent FROM f WHERE n>=1000", "px")
def group_percent(spark, sf_dir):
    return r6(classes.group_percent(_freq(spark, sf_dir), 1000))


@_query(f", {FREQ}, g AS (SELECT grp_key, CAST(dense_rank() OVER (ORDER BY grp_key) AS INT) AS k FROM (SELECT grp_key FROM f JOIN keys ON class=lc_key GROUP BY grp_key HAVING sum(n)>=1000)) SELECT {PIX}, coalesce(k,0) AS value FROM px LEFT JOIN keys ON ref1=lc_key LEFT JOIN g USING (grp_key)", "px", "keys")
def reclassify_ranked(spark, sf_dir):
    return classes.reclassify_ranked(_map(spark, sf_dir, "ref1"), view(spark, sf_dir, "keys"), 1000)


PERIODS = " FULL JOIN ".join(f"(SELECT {p} AS class, count(*) AS {p} FROM px WHERE {p} IS NOT NULL GROUP BY 1) {p}_" + (" USING (class)" if i else "") for i, p in enumerate(["ref1", "ref2", "map2"]))


@_query(f"SELECT class, ref1, ref2, map2 FROM {PERIODS} WHERE ref1>0 AND ref2>0 AND map2>0", "px")
def distribution_by_period(spark, sf_dir):
    return classes.distribution_by_period(_px(spark, sf_dir), ["ref1", "ref2", "map2"])


@_query(f"SELECT class, ref1, ref2, map2 FROM {PERIODS}", "px")
def counts_union(spark, sf_dir):
    return classes.counts_union(_px(spark, sf_dir), ["ref1", "ref2", "map2"])


@_query(f", {FREQ} SELECT class, description, round(n/sum(n) OVER ()*100,6) AS percent FROM f LEFT JOIN keys ON class=lc_key", "px", "keys")
def label_sorted(spark, sf_dir):
    return r6(classes.label_sorted(_freq(spark, sf_dir), view(spark, sf_dir, "keys")))


@_query("SELECT list_sort(list(DISTINCT ref1) FILTER (ref1 IS NOT NULL)) AS vals, count(DISTINCT ref1) AS n FROM px", "px")
def unique_values(spark, sf_dir):
    return classes.unique_values(_px(spark, sf_dir), "ref1")


@_query("SELECT count(*) AS pixels, count(ref1) AS n, min(ref1)::DOUBLE AS lo, max(ref1)::DOUBLE AS hi, round(avg(ref1),6) AS mean, round(stddev_pop(ref1),6) AS std, count(DISTINCT ref1) AS \"distinct\" FROM px", "px")
def mosaic_summary(spark, sf_dir):
    """From summaries stored with the tiles; with so few classes the sketch of distinct values is exact."""
    path = pixels.shared_folder(spark)
    sketches.summarize(_map(spark, sf_dir, "ref1")).write.parquet(path)
    return r6(sketches.described(spark.read.parquet(path)))


# --- features ----------------------------------------------------------------------------------------------------------


def _obs(spark, sf_dir):
    return view(spark, sf_dir, "obs")


def _valid(spark, sf_dir):
    return _obs(spark, sf_dir).filter("value > -13000").withColumnRenamed("band", "feature")


@_query("SELECT band||' '||month AS feature, band, CASE WHEN band IN ('BLUE','GREEN','RED','NIR','SWIR1','MIR') THEN 'BAND' ELSE 'VI' END AS type, count(*) AS n FROM obs GROUP BY 1,2,3", "obs")
def feature_type(spark, sf_dir):
    name = F.concat_ws(" ", F.lit("JAN"), "band", F.lit("AVG"))
    out = _obs(spark, sf_dir).select(F.concat_ws(" ", "band", "month").alias("feature"), features.parse_feature(name)["band"].alias("band"), features.feature_type(name)["type"].alias("type"))
    return out.groupBy("feature", "band", "type").agg(F.count("*").alias("n"))


NAMES = "mon AS (SELECT unnest(['JAN','FEB','MAR','APR','MAY','JUN','JUL','AUG','SEP','OCT','NOV','DEC']) AS mon, unnest(range(1,13)) AS m), vars AS (SELECT unnest(['AVG','STDEV']) AS var)"


@_query(f", {NAMES}, o AS (SELECT band, month, count(*) AS n FROM obs GROUP BY ALL) SELECT mon||' '||band||' '||var AS feature, mon AS period, band, var, CASE WHEN band IN ('EVI','EVI2','NDVI') THEN 'VI' ELSE 'BAND' END AS kind, n FROM o JOIN mon ON m=month, vars", "obs")
def monthly_features(spark, sf_dir):
    """The monthly feature names for which there are observations, taken apart, with their number."""
    months = F.array(*map(F.lit, features.MONTHS))
    n = _obs(spark, sf_dir).groupBy("band", F.element_at(months, F.col("month")).alias("period")).agg(F.count("*").alias("n"))
    part = features.parse_feature(F.col("feature"))
    return features.monthly_features(spark).join(n, ["band", "period"]).select("feature", *[part[c].alias(c) for c in ("period", "band", "var", "kind")], "n")


@_query(f", {NAMES}, o AS (SELECT band, CASE WHEN month<=3 THEN 'WIN' WHEN month<=6 THEN 'SPR' WHEN month<=9 THEN 'SUM' ELSE 'FAL' END AS period, count(*) AS n FROM obs GROUP BY ALL) SELECT period||' '||band||' '||var AS feature, period, band, var, n FROM o, vars", "obs")
def seasonal_features(spark, sf_dir):
    """The seasonal feature names for which there are observations, with their number."""
    months, at = F.array(*map(F.lit, features.MONTHS)), F.col("month")
    season = functools.reduce(lambda e, kv: F.when(F.element_at(months, at).isin(kv[1]), F.lit(kv[0])).otherwise(e), features.SEASONS.items(), F.lit(None).cast("string"))
    n = _obs(spark, sf_dir).groupBy("band", season.alias("period")).agg(F.count("*").alias("n"))
    return features.seasonal_features(spark).join(n, ["band", "period"]).select("feature", "period", "band", "var", "n")


@_query("SELECT band AS feature, count(*) AS n FROM obs WHERE band NOT IN ('NDVI','BLUE') GROUP BY band", "obs")
def exclude_features(spark, sf_dir):
    kept = features.exclude_features(_obs(spark, sf_dir).withColumnRenamed("band", "feature"), ["NDVI", "BLUE"])
    return kept.groupBy("feature").agg(F.count("*").alias("n"))


@_query("SELECT pix, band, month, round(avg(value),6) AS avg, min(value) AS min, max(value) AS max, round(stddev_samp(value),6) AS stddev, count(*) AS npi FROM obs WHERE value > -13000 GROUP BY pix, band, month", "obs")
def monthly_stats(spark, sf_dir):
    return r6(features.monthly_stats(_obs(spark, sf_dir), ["pix", "band"]))


@_query("SELECT pix, band, CASE (month-1)//3 WHEN 0 THEN 'WIN' WHEN 1 THEN 'SPR' WHEN 2 THEN 'SUM' ELSE 'FAL' END AS season, CAST(round_even(sum(value)/count(*),0) AS INT) AS value FROM obs WHERE value > -13000 GROUP BY 1,2,3", "obs")
def seasonal_composite(spark, sf_dir):
    return features.seasonal_long(_obs(spark, sf_dir).filter("value > -13000"), ["pix", "band"])


def _wide_sql() -> str:
    seasons = {"SPR": (4, 5, 6), "SUM": (7, 8, 9), "FAL": (10, 11, 12), "WIN": (1, 2, 3)}
    months = ", ".join(f"CAST(trunc(avg(value) FILTER (band='{b}' AND month={m})) AS INT) AS {b}{m}" for b in features.BANDS for m in range(1, 13))
    one = lambda b, k, ms: "CAST(round_even((" + "+".join(f"coalesce({b}{m},0)" for m in ms) + ")/nullif(" + "+".join(f"({b}{m} IS NOT NULL)::INT" for m in ms) + f",0),0) AS INT) AS \"{k}_{b}_AVG\""
    return f", w AS (SELECT pix, {months} FROM obs WHERE value > -13000 GROUP BY pix) SELECT pix, {', '.join(one(b, k, ms) for b in features.BANDS for k, ms in seasons.items())} FROM w"


@_query(_wide_sql(), "obs")
def seasonal_wide(spark, sf_dir):
    """All bands and seasons from all months, side by side."""
    obs = _obs(spark, sf_dir).filter("value > -13000")
    at = lambda b, m: F.avg(F.when((F.col("band") == b) & (F.col("month") == m), F.col("value"))).cast("int")
    wide = obs.groupBy("pix").agg(*[at(b, i + 1).alias(f"{name}_{b}_AVG") for b in features.BANDS for i, name in enumerate(features.MONTHS)])
    return features.seasonal_composite(wide, features.BANDS)


STATS = "bs AS (SELECT band AS feature, min(value) AS min, max(value) AS max, round(avg(value),6) AS mean, min(value) FILTER (value>=0) AS valid_min, max(value) FILTER (value>=0) AS valid_max, round(avg(value) FILTER (value>=0),6) AS valid_mean FROM obs GROUP BY band)"


@_query(f", {STATS} SELECT * FROM bs", "obs")
def basic_stats(spark, sf_dir):
    return r6(features.basic_stats(_obs(spark, sf_dir).withColumnRenamed("band", "feature")))


@_query(f", {STATS} SELECT CASE WHEN feature='NDVI' THEN 'VI' ELSE 'BAND' END AS type, min(valid_min) AS low, max(valid_max) AS high FROM bs GROUP BY 1", "obs")
def range_of_type(spark, sf_dir):
    stats = features.basic_stats(_obs(spark, sf_dir).withColumnRenamed("band", "feature"))
    name = F.concat_ws(" ", F.lit("JAN"), "feature", F.lit("AVG"))
    return features.range_of_type(stats.withColumn("type", features.feature_type(name)["type"]), ["type"])


VAL = "v AS (SELECT pix, band AS feature, month, value FROM obs WHERE value > -13000)"


@_query(f", {VAL} SELECT pix, feature, month, round((value-min(value) OVER w)/nullif(max(value) OVER w-min(value) OVER w,0),6) AS value FROM v WINDOW w AS (PARTITION BY feature)", "obs")
def normalize(spark, sf_dir):
    return r6(features.normalize(_valid(spark, sf_dir), ["feature"]).select("pix", "feature", "month", "value"))


@_query(f", {VAL} SELECT pix, feature, month, round((value-avg(value) OVER w)/stddev_pop(value) OVER w,6) AS value FROM v WINDOW w AS (PARTITION BY feature)", "obs")
def standardize(spark, sf_dir):
    return r6(features.standardize(_valid(spark, sf_dir), ["feature"]).select("pix", "feature", "month", "value"))


@_query(f", {VAL} SELECT pix, feature, month, value/10000 AS value FROM v", "obs")
def apply_scale(spark, sf_dir):
    return features.apply_scale(_valid(spark, sf_dir)).select("pix", "feature", "month", "value")


@_query("SELECT max(value) AS max, min(value) AS min, round(avg(value),6) AS mean, round(stddev_pop(value),6) AS std FROM obs", "obs")
def array_stats(spark, sf_dir):
    return r6(features.array_stats(_obs(spark, sf_dir)))


@_query("SELECT least(0, min(value)) AS lo, greatest(9000, max(value)) AS hi FROM obs", "obs")
def common_limits(spark, sf_dir):
    return features.common_limits(_obs(spark, sf_dir), 0, 9000)


@_query(f", {VAL}, m AS (SELECT min(value) AS lo, max(value) AS hi FROM v) SELECT CAST(least(floor((value-lo)/((hi-lo)/20)),19) AS INT) AS bin, count(*) AS n FROM v, m GROUP BY 1", "obs")
def histogram(spark, sf_dir):
    return features.histogram(_valid(spark, sf_dir), 20)


@_query(f", {VAL} SELECT CASE WHEN value<100 THEN 0 WHEN value<1000 THEN 1 WHEN value<5000 THEN 2 ELSE 3 END AS bin, count(*) AS n FROM v WHERE value BETWEEN 0 AND 9000 GROUP BY 1", "obs")
def histogram_edges(spark, sf_dir):
    return features.histogram_edges(_valid(spark, sf_dir), [0, 100, 1000, 5000, 9000])


@_query("SELECT CAST(least(floor(sos/(870.0::DOUBLE/10)),9) AS INT) AS x_bin, CAST(least(floor(los/(400.0::DOUBLE/10)),9) AS INT) AS y_bin, count(*) AS n FROM px WHERE sos BETWEEN 0 AND 870 AND los BETWEEN 0 AND 400 GROUP BY 1,2", "px")
def histogram2d(spark, sf_dir):
    return features.histogram2d(_px(spark, sf_dir), "sos", "los", 10, (0.0, 870.0, 0.0, 400.0))


@_query("SELECT round(regr_slope(eos,sos),6) AS slope, round(regr_intercept(eos,sos),6) AS intercept, round(regr_r2(eos,sos),6) AS r2 FROM px WHERE sos>=0", "px")
def linear_fit(spark, sf_dir):
    return r6(features.linear_fit(_px(spark, sf_dir).filter("sos >= 0"), "sos", "eos"))


@_query("SELECT round(sum(sos::DOUBLE*eos)/sum(sos::DOUBLE*sos),6) AS slope, 0.0::DOUBLE AS intercept, round(pow(sum(sos::DOUBLE*eos),2)/sum(sos::DOUBLE*sos)/sum(eos::DOUBLE*eos),6) AS r2 FROM px WHERE sos>=0", "px")
def linear_fit_origin(spark, sf_dir):
    return r6(features.linear_fit(_px(spark, sf_dir).filter("sos >= 0"), "sos", "eos", intercept=False))


@_query(f"SELECT {PIX}, sos, eos FROM px", "px")
def long_and_wide(spark, sf_dir):
    return features.to_wide(features.to_long(_px(spark, sf_dir), ["sos", "eos"]), ["sos", "eos"])


# --- repair ------------------------------------------------------------------------------------------------------------


@_query(f"SELECT {PIX}, CASE WHEN sos+eos>365 THEN (sos+eos-1)%365+1 ELSE sos+eos END AS annual, CASE WHEN los>=0 THEN los END AS positive, CASE WHEN los<0 THEN -1 ELSE los END AS nos, CASE WHEN los<=0 THEN 0 ELSE los END AS floored FROM px", "px")
def fix_annual(spark, sf_dir):
    los = F.col("los")
    return _px(spark, sf_dir, "tile", "row", "col", repair.fix_annual(F.col("sos") + F.col("eos")).alias("annual"), repair.null_negative(los).alias("positive"), repair.fix_nos(los).alias("nos"), repair.floor_zero(los).alias("floored"))


@_query("SELECT pix, band, month, CASE WHEN value<0 THEN round_even(avg(value) FILTER (value>=0) OVER (PARTITION BY band),2) ELSE value END AS value FROM obs", "obs")
def fill_mean(spark, sf_dir):
    return repair.fill_mean(_obs(spark, sf_dir), ["band"]).select("pix", "band", "month", F.col("value").cast("double").alias("value"))


@_query("SELECT pix, band, month, CASE WHEN value<0 THEN CAST(trunc(avg(value) FILTER (value>=0) OVER (PARTITION BY band)) AS INT) ELSE value END AS value FROM obs", "obs")
def fill_int_mean(spark, sf_dir):
    return repair.fill_int_mean(_obs(spark, sf_dir), ["band"]).select("pix", "band", "month", "value")


def _near(c: str) -> str:
    return f"""near_{c} AS (SELECT m.tile, m.row, m.col, greatest(abs(o.row-m.row),abs(o.col-m.col)) AS d, o.{c} AS v FROM px m JOIN px o ON m.tile=o.tile AND o.row BETWEEN m.row-10 AND m.row+10 AND o.col BETWEEN m.col-10 AND m.col+10 WHERE m.{c}<0 AND o.{c}>=0),
near2_{c} AS (SELECT * FROM near_{c} QUALIFY d = min(d) OVER (PARTITION BY {PIX})), cnt_{c} AS (SELECT {PIX}, v, count(*) AS n FROM near2_{c} GROUP BY ALL),
mode_{c} AS (SELECT {PIX}, min(v) AS lo, max(v) AS hi, CAST(trunc(sum(v*n)/sum(n)) AS INT) AS mean, first(v ORDER BY n DESC, v) AS mode, first(n ORDER BY n DESC, v) AS top FROM cnt_{c} GROUP BY ALL)"""


@_query(f", {_near('sos')} SELECT px.tile, px.row, px.col, CASE WHEN sos<0 THEN coalesce(CASE WHEN mode=lo THEN mean ELSE mode END, sos) ELSE sos END AS value FROM px LEFT JOIN mode_sos m ON px.tile=m.tile AND px.row=m.row AND px.col=m.col", "px")
def fill_mode(spark, sf_dir):
    return repair.fill_mode(_map(spark, sf_dir, "sos"))


@_query(f""", {_near('sos')}, {_near('eos')}, j AS (SELECT px.*, s.mode AS s, CASE WHEN e.mode=e.lo AND e.top=1 THEN e.hi ELSE e.mode END AS e FROM px LEFT JOIN mode_sos s ON px.tile=s.tile AND px.row=s.row AND px.col=s.col LEFT JOIN mode_eos e ON px.tile=e.tile AND px.row=e.row AND px.col=e.col)
SELECT {PIX}, CASE WHEN sos<0 AND s IS NOT NULL THEN s ELSE sos END AS sos, CASE WHEN sos<0 AND e IS NOT NULL THEN e ELSE eos END AS eos, CASE WHEN sos<0 AND e-s IS NOT NULL THEN CASE WHEN e-s<=0 THEN 365 ELSE e-s END ELSE los END AS los FROM j""", "px")
def fill_season(spark, sf_dir):
    return repair.fill_season(_px(spark, sf_dir, "tile", "row", "col", "sos", "eos", "los"))


@_query("SELECT count(*) FILTER ((sos<0)<>(eos<0) OR (sos<0)<>(los<0)) AS disagree, count(*) AS pixels FROM px", "px")
def check_colocated(spark, sf_dir):
    return repair.check_colocated(_px(spark, sf_dir))


# --- sampling ----------------------------------------------------------------------------------------------------------


@_query(f", {FREQ} SELECT class, n, CAST(trunc(n*0.2) AS BIGINT) AS target FROM f", "px")
def train_targets(spark, sf_dir):
    return sampling.train_targets(_freq(spark, sf_dir), 0.2)


WIN = "g AS (SELECT max(row)+1 AS nr, max(col)+1 AS nc FROM px), lat AS (SELECT *, row//7 AS wr, col//7 AS wc FROM px, g WHERE (row//7+1)*7<=nr AND (col//7+1)*7<=nc), wcnt AS (SELECT wr, wc, ref1 AS class, count(*) AS n FROM lat WHERE ref1 IS NOT NULL GROUP BY ALL)"
TAKE = f"{FREQ}, {WIN}, take AS (SELECT w.wr, w.wc, w.class, w.n, CAST(coalesce(sum(w.n) OVER (PARTITION BY w.class ORDER BY md5('1:'||wr||':'||wc) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS BIGINT) AS before, CAST(trunc(f.n*0.2) AS BIGINT) AS target FROM wcnt w JOIN f ON w.class=f.class QUALIFY before<target)"


def _lattice(spark, sf_dir):
    px = _px(spark, sf_dir)
    shape = px.agg(F.max("row") + 1, F.max("col") + 1).first()
    return px, shape[0], shape[1]


@_query(f", {WIN} SELECT wr, wc, class, n FROM wcnt", "px")
def window_counts(spark, sf_dir):
    px, rows, cols = _lattice(spark, sf_dir)
    return sampling.window_counts(sampling.windows(px, 7, rows, cols), "ref1")


@_query(f", {TAKE} SELECT * FROM take", "px")
def stratified_windows(spark, sf_dir):
    px, rows, cols = _lattice(spark, sf_dir)
    counts = sampling.window_counts(sampling.windows(px, 7, rows, cols), "ref1")
    return sampling.stratified_windows(counts, sampling.train_targets(_freq(spark, sf_dir), 0.2), 1)


def _sample(spark, sf_dir, **options):
    px, rows, cols = _lattice(spark, sf_dir)
    return sampling.stratified_sample(px, sampling.train_targets(_freq(spark, sf_dir), 0.2), 7, rows, cols, 1, "ref1", **options)


SAMPLE = f"{TAKE}, sam AS (SELECT l.* FROM lat l JOIN take t ON l.wr=t.wr AND l.wc=t.wc AND l.ref1=t.class)"


@_query(f", {SAMPLE} SELECT {PIX}, ref1 FROM sam", "px")
def stratified_sample(spark, sf_dir):
    return _sample(spark, sf_dir).select("tile", "row", "col", "ref1")


@_query(f", {TR}, {WIN.replace('ref1 AS class', 'coalesce(ref1,0)*1000+coalesce(ref2,0) AS class').replace('WHERE ref1 IS NOT NULL ', '')}, want AS (SELECT * FROM (VALUES (106106, 40), (106101, 30), (109101, 25)) t(class, target)), take AS (SELECT w.*, CAST(coalesce(sum(n) OVER (PARTITION BY w.class ORDER BY md5('1:'||wr||':'||wc) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS BIGINT) AS before, target FROM wcnt w JOIN want ON w.class=want.class QUALIFY before<target) SELECT l.tile, l.row, l.col, t.class AS code FROM lat l JOIN take t ON l.wr=t.wr AND l.wc=t.wc AND coalesce(l.ref1,0)*1000+coalesce(l.ref2,0)=t.class", "px")
def restricted_sample(spark, sf_dir):
    """Listed strata with sizes of their own; others are ignored."""
    px, rows, cols = _lattice(spark, sf_dir)
    px = px.withColumn("code", change.transition_code(F.col("ref1"), F.col("ref2")))
    targets = spark.createDataFrame([(106106, 40), (106101, 30), (109101, 25)], "class int, target long")
    return sampling.stratified_sample(px, targets, 7, rows, cols, 1, "code").select("tile", "row", "col", "code")


@_query(f", {FREQ}, lat AS (SELECT *, (row-2)//5 AS wr, (col-10)//5 AS wc FROM px WHERE row>=2 AND col>=10 AND ((row-2)//5+1)*5+2<=12 AND ((col-10)//5+1)*5+10<=60), wcnt AS (SELECT wr, wc, ref1 AS class, count(*) AS n FROM lat WHERE ref1 IS NOT NULL GROUP BY ALL), drawn AS (SELECT DISTINCT wr, wc FROM wcnt ORDER BY md5('1:'||wr||':'||wc) LIMIT 12), take AS (SELECT w.*, CAST(coalesce(sum(w.n) OVER (PARTITION BY w.class ORDER BY md5('1:'||wr||':'||wc) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS BIGINT) AS before, CAST(trunc(f.n*0.02) AS BIGINT) AS target FROM wcnt w JOIN drawn USING (wr, wc) JOIN f ON w.class=f.class QUALIFY before<target) SELECT l.tile, l.row, l.col, l.ref1 FROM lat l JOIN take t ON l.wr=t.wr AND l.wc=t.wc AND l.ref1=t.class", "px")
def boxed_sample(spark, sf_dir):
    """Windows of a box only, and no more than twelve of them."""
    px, rows, cols = _lattice(spark, sf_dir)
    targets = sampling.train_targets(_freq(spark, sf_dir), 0.02)
    return sampling.stratified_sample(px, targets, 5, rows, cols, 1, "ref1", box=(2, 10, 12, 60), max_windows=12).select("tile", "row", "col", "ref1")


@_query(f", {SAMPLE}, sc AS (SELECT ref1 AS class, count(*) AS s FROM sam GROUP BY 1) SELECT f.class, f.n AS pixels, CAST(trunc(f.n*0.2) AS BIGINT) AS target, coalesce(s,0) AS sampled, round(coalesce(s,0)/nullif(CAST(trunc(f.n*0.2) AS BIGINT),0)*100,6) AS pct_of_target, round(coalesce(s,0)/f.n*100,6) AS pct_of_class, coalesce(s,0)>=CAST(trunc(f.n*0.2) AS BIGINT) AS complete FROM f LEFT JOIN sc ON f.class=sc.class", "px")
def sample_report(spark, sf_dir):
    freq = _freq(spark, sf_dir)
    return r6(sampling.sample_report(freq, sampling.train_targets(freq, 0.2), classes.class_freq(_sample(spark, sf_dir), "ref1")))


@_query(f", {SAMPLE} SELECT p.tile, p.row, p.col, CAST(s.row IS NOT NULL AS INT) AS mask, s.ref1 AS sampled FROM px p LEFT JOIN sam s ON p.tile=s.tile AND p.row=s.row AND p.col=s.col", "px")
def sample_mask(spark, sf_dir):
    out = sampling.sample_mask(_px(spark, sf_dir), _sample(spark, sf_dir), "ref1")
    return out.select("tile", "row", "col", "mask", "sampled")


STRATA = "stra AS (SELECT code AS class, n AS pixels, CASE WHEN c1=c2 THEN 0.9::DOUBLE ELSE 0.75::DOUBLE END AS u FROM tr WHERE c1 IS NOT NULL AND c2 IS NOT NULL), siz AS (SELECT CAST(sum(pixels) AS BIGINT) AS total, pow(sum(pixels/t*sqrt(u*(1-u))),2)/(0.0001::DOUBLE+sum(pixels/t*u*(1-u))/sum(pixels)) AS size FROM (SELECT *, sum(pixels) OVER () AS t FROM stra))"


def _strata(spark, sf_dir):
    tr = change.both_valid(_tr(spark, sf_dir))
    return tr.select(F.col("code").alias("class"), F.col("n").alias("pixels"), F.when(F.col("c1") == F.col("c2"), 0.9).otherwise(0.75).alias("u"))


@_query(f", {TR}, {STRATA} SELECT total, round(size,6) AS size FROM siz", "px")
def sample_size(spark, sf_dir):
    return r6(sampling.sample_size(_strata(spark, sf_dir)))


def _alloc(i: int, v: int) -> str:
    return f"CASE WHEN prop<{v} THEN {v} ELSE CAST(trunc(round_even(w+addw,2)*(CASE WHEN r{i}<size THEN round_even(size-r{i},0) ELSE size END)) AS BIGINT) END AS alloc{i}"


@_query(f""", {TR}, {STRATA}, a AS (SELECT class, size, pixels/sum(pixels) OVER () AS w, count(*) OVER () AS k FROM stra, siz), b AS (SELECT *, CAST(trunc(round_even(size,0)*w) AS BIGINT) AS prop, CAST(round_even(size/k,0) AS BIGINT) AS equal FROM a),
c AS (SELECT *, coalesce(round_even(sum(CASE WHEN prop<100 THEN w ELSE 0.0::DOUBLE END) OVER ()/nullif(k-count(*) FILTER (prop<100) OVER (),0),2),0.0::DOUBLE) AS addw, count(*) FILTER (prop<100) OVER ()*100 AS r1, count(*) FILTER (prop<75) OVER ()*75 AS r2, count(*) FILTER (prop<50) OVER ()*50 AS r3 FROM b),
d AS (SELECT class, equal, {_alloc(1, 100)}, {_alloc(2, 75)}, {_alloc(3, 50)}, prop FROM c)
SELECT * FROM d UNION ALL SELECT NULL, CAST(sum(equal) AS BIGINT), CAST(sum(alloc1) AS BIGINT), CAST(sum(alloc2) AS BIGINT), CAST(sum(alloc3) AS BIGINT), CAST(sum(prop) AS BIGINT) FROM d""", "px")
def allocate(spark, sf_dir):
    strata = _strata(spark, sf_dir)
    return sampling.allocate(strata, sampling.sample_size(strata))


@_query(f", {TR} SELECT code, CASE WHEN c1 IN (101,102) AND c2 IN (101,102) THEN CASE WHEN c1=c2 THEN CASE c1 WHEN 101 THEN 'AG' ELSE 'UR' END ELSE CASE c1 WHEN 101 THEN 'AG->UR' ELSE 'UR->AG' END END ELSE '--' END AS label FROM tr", "px")
def change_labels(spark, sf_dir):
    return _tr(spark, sf_dir).select("code", sampling.change_label(F.col("code"), {101: "AG", 102: "UR"}).alias("label"))


@_query(f", {TR} SELECT code AS class, n AS target FROM tr WHERE code IN (106106,106101,109101,999999)", "px")
def select_strata(spark, sf_dir):
    return sampling.select_strata(_tr(spark, sf_dir).withColumnRenamed("code", "class"), [106106, 106101, 109101, 999999], "n")


# --- accuracy ----------------------------------------------------------------------------------------------------------

CONF = "cl AS (SELECT DISTINCT unnest([ref1,map1]) AS c FROM px WHERE ref1 IS NOT NULL AND map1 IS NOT NULL), cf AS (SELECT a.c AS truth, b.c AS predict, count(px.pix) AS n FROM cl a CROSS JOIN cl b LEFT JOIN px ON px.ref1=a.c AND px.map1=b.c GROUP BY ALL)"


def _conf(spark, sf_dir):
    return accuracy.confusion(_px(spark, sf_dir), "ref1", "map1")


@_query(", q AS (SELECT coalesce(CAST(ref1 AS VARCHAR),'All') AS truth, coalesce(CAST(map1 AS VARCHAR),'All') AS predict, count(*) AS n FROM px WHERE ref1 IS NOT NULL AND map1 IS NOT NULL GROUP BY CUBE (ref1, map1)) SELECT truth, " + ", ".join(f"CAST(coalesce(sum(n) FILTER (predict='{c}'),0) AS BIGINT) AS \"{c}\"" for c in [*CLASSES, "All"]) + " FROM q GROUP BY truth", "px")
def crosstab_margins(spark, sf_dir):
    return accuracy.crosstab(_px(spark, sf_dir).filter("ref1 is not null and map1 is not null"), CLASSES, "ref1", "map1")


@_query(f", {CONF} SELECT * FROM cf", "px")
def confusion(spark, sf_dir):
    return _conf(spark, sf_dir)


@_query(f", {CONF} SELECT round(sum(n) FILTER (truth=predict)/sum(n),6) AS accuracy FROM cf", "px")
def overall_accuracy(spark, sf_dir):
    return r6(accuracy.accuracy(_conf(spark, sf_dir)))


@_query(f", {CONF} SELECT truth, predict, round(n/nullif(sum(n) OVER (PARTITION BY truth),0),6) AS share FROM cf", "px")
def producer_accuracy(spark, sf_dir):
    return r6(accuracy.normalize_conf(_conf(spark, sf_dir), "truth"))


@_query(f", {CONF} SELECT truth, predict, round(n/nullif(sum(n) OVER (PARTITION BY predict),0),6) AS share FROM cf", "px")
def user_accuracy(spark, sf_dir):
    return r6(accuracy.normalize_conf(_conf(spark, sf_dir), "predict"))


SIDES = "sd AS (SELECT c AS class, (SELECT sum(n) FROM cf WHERE truth=c) AS t, (SELECT sum(n) FROM cf WHERE predict=c) AS p, (SELECT sum(n) FROM cf WHERE truth=c AND predict=c) AS hit, (SELECT sum(n) FROM cf) AS total FROM cl)"


@_query(f", {CONF}, {SIDES}, s AS (SELECT sum(hit)/max(total) AS po, sum(t/total*p/total) AS pe FROM sd) SELECT round((po-pe)/(1-pe),6) AS kappa FROM s", "px")
def kappa(spark, sf_dir):
    return r6(accuracy.kappa(_conf(spark, sf_dir)))


@_query(f""", {CONF}, {SIDES}, r AS (SELECT CAST(class AS VARCHAR) AS class, coalesce(hit/nullif(p,0),0) AS precision, coalesce(hit/nullif(t,0),0) AS recall, coalesce(2*hit/nullif(t+p,0),0) AS f1, CAST(t AS BIGINT) AS support, hit FROM sd),
u AS (SELECT class, precision, recall, f1, support FROM r UNION ALL SELECT 'accuracy', sum(hit)/sum(support), sum(hit)/sum(support), sum(hit)/sum(support), sum(support) FROM r UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM r
UNION ALL SELECT 'weighted avg', sum(precision*support)/sum(support), sum(recall*support)/sum(support), sum(f1*support)/sum(support), sum(support) FROM r)
SELECT class, round(precision,6) AS precision, round(recall,6) AS recall, round(f1,6) AS f1, CAST(support AS BIGINT) AS support FROM u""", "px")
def class_report(spark, sf_dir):
    return r6(accuracy.class_report(_conf(spark, sf_dir)))


@_query(", a AS (SELECT CASE WHEN pix%10=0 THEN 'training' ELSE 'testing' END AS split, ref1 AS truth, map1 AS predict, count(*) AS n FROM px WHERE roi=1 AND ref1>0 AND map1 IS NOT NULL GROUP BY ALL) SELECT * FROM a UNION ALL SELECT 'all', truth, predict, CAST(sum(n) AS BIGINT) FROM a GROUP BY truth, predict", "px")
def assess(spark, sf_dir):
    return accuracy.assess(_split(spark, sf_dir).filter("roi = 1"), "ref1", "map1")


@_query(f", {SITES}, u AS (SELECT site AS class, 1 AS v, 0 AS p FROM st UNION ALL SELECT value, 0, 1 FROM st) SELECT class, CAST(sum(v) AS BIGINT) AS validation, CAST(sum(p) AS BIGINT) AS prediction, CAST(sum(p)-sum(v) AS BIGINT) AS difference FROM u GROUP BY class", "px")
def validation_counts(spark, sf_dir):
    return accuracy.validation_counts(grid.select_sites(_map(spark, sf_dir, "map1"), _sites(spark, sf_dir)))


@_query(f", {SITES} SELECT round(count(*) FILTER (site=value)/count(*),6) AS accuracy FROM st", "px")
def validate_accuracy(spark, sf_dir):
    return r6(accuracy.validate(_map(spark, sf_dir, "map1"), _sites(spark, sf_dir))["accuracy"])


def _sized(n: int) -> str:
    k = n // 2
    steps = f"(SELECT unnest(range({-k}, {k + 1})) AS d)"
    return f"SELECT {n} AS size, row, col, max(site) AS site FROM (SELECT row+a.d AS row, col+b.d AS col, ref1 AS site FROM px, {steps} a, {steps} b WHERE urban=1 AND ref1>0) GROUP BY row, col"


@_query(f", w AS ({' UNION ALL '.join(map(_sized, (1, 3, 5)))}) SELECT size, count(*) AS pixels, count(*) FILTER (site=coalesce(map1,0)) AS \"right\", round(count(*) FILTER (site=coalesce(map1,0))/count(*),6) AS accuracy FROM w JOIN px USING (row, col) GROUP BY size", "px")
def validate_windows(spark, sf_dir):
    """Field sites of the urban zone against the map, as pixels and as windows of 3 and 5."""
    points = _px(spark, sf_dir).filter("urban = 1").select(F.col("ref1").alias("site"), "row", "col")
    return r6(accuracy.validate_windows(_map(spark, sf_dir, "map1"), points))


@_query(f"SELECT {PIX}, map2 AS value FROM px WHERE ref1 IS NOT NULL", "px")
def mask_like(spark, sf_dir):
    return accuracy.mask_like(_map(spark, sf_dir, "map2"), _map(spark, sf_dir, "ref1"))


PAIRS = f"{TAKE}, sam0 AS (SELECT l.* FROM lat l JOIN take t ON l.wr=t.wr AND l.wc=t.wc AND l.ref1=t.class), pr AS (SELECT tile, row, col, ref1 AS ref, map1 AS map FROM sam0 WHERE map1>0), pairs AS (SELECT * FROM pr WHERE map IN (SELECT ref FROM pr))"


def _pairs(spark, sf_dir):
    """Reference and map at the stratified sample."""
    return accuracy.sample_pairs(sampling.sample_mask(_px(spark, sf_dir), _sample(spark, sf_dir), "ref1"), "ref1", "map1")


@_query(f", {PAIRS} SELECT * FROM pairs", "px")
def sample_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir)


AREAS = "ar AS (SELECT map1 AS class, count(*)*0.09::DOUBLE AS ha FROM px WHERE map1 IS NOT NULL GROUP BY 1)"


def _counted(px, ref, map_):
    """Pairs (ref, map, n) at the stratified sample, and areas of the map's classes: one scan, then small written tables."""
    table = pixels.checkpointed(sampling.window_table(px, [ref, map_], 7))
    pairs = pixels.checkpointed(accuracy.pair_counts(sampling.sampled_table(table, ref, 0.2, 7), ref, map_))
    areas = table.filter(F.col(map_).isNotNull()).groupBy(F.col(map_).alias("class")).agg((F.sum("n") * 0.09).alias("ha"))
    return pairs, pixels.checkpointed(areas)


def _em(w: str) -> str:
    cols = ", ".join(f"count(*) FILTER (ref={c}) AS r_{c}" for c in CLASSES)
    sums = ", ".join(f"CAST(sum(r_{c}) AS BIGINT)" for c in CLASSES)
    return f""", {PAIRS}, {AREAS}, e AS (SELECT map, {cols}, count(*) AS row_total FROM pairs GROUP BY map), e2 AS (SELECT e.*, CAST(trunc(ha) AS BIGINT) AS map_area, {w} AS w FROM e LEFT JOIN ar ON class=map)
    SELECT * REPLACE (round(w,6) AS w) FROM e2 UNION ALL SELECT NULL, {sums}, CAST(sum(row_total) AS BIGINT), CAST(sum(map_area) AS BIGINT), round(sum(w),6) FROM e2"""


@_query(_em("CAST(trunc(ha) AS BIGINT)/sum(CAST(trunc(ha) AS BIGINT)) OVER ()"), "px")
def error_matrix(spark, sf_dir):
    return r6(accuracy.error_matrix(*_counted(_px(spark, sf_dir), "ref1", "map1"), CLASSES))


@_query(_em("coalesce((SELECT count(*) FROM pairs p WHERE p.ref=e.map),0)/sum(row_total) OVER ()"), "px")
def error_matrix_sample(spark, sf_dir):
    return r6(accuracy.error_matrix(*_counted(_px(spark, sf_dir), "ref1", "map1"), CLASSES, weights="sample"))


def _dense(px, ref="ref1", map_="map1"):
    """Dense counts of map by reference at the sample, and areas."""
    pairs, areas = _counted(px, ref, map_)
    return accuracy.confusion(pairs, "map", "ref", "n").select(F.col("truth").alias("map"), F.col("predict").alias("ref"), "n"), areas


PROP = f"{PAIRS}, {AREAS}, c2 AS (SELECT DISTINCT unnest([map,ref]) AS c FROM pairs), d0 AS (SELECT a.c AS map, b.c AS ref, count(p.map) AS n FROM c2 a CROSS JOIN c2 b LEFT JOIN pairs p ON p.map=a.c AND p.ref=b.c GROUP BY ALL), d1 AS (SELECT map, ref, n, sum(n) OVER (PARTITION BY map) AS ni, ha AS a, ha/(SELECT sum(ha) FROM ar) AS w FROM d0 JOIN ar ON class=map), d2 AS (SELECT *, n/nullif(ni,0) AS u, w*n/nullif(ni,0) AS p FROM d1), d3 AS (SELECT *, u*(1-u)/nullif(ni-1,0) AS v FROM d2)"


@_query(f", {PROP} SELECT map, ref, n, round(w,6) AS w, round(u,6) AS u, round(p,6) AS p FROM d2", "px")
def area_proportions(spark, sf_dir):
    return r6(accuracy.area_proportions(*_dense(_px(spark, sf_dir))).select("map", "ref", "n", "w", "u", "p"))


OLOF = f"""{PROP}, k AS (SELECT ref AS class, sum(p) AS area, sum(a*u) AS aj, sum(w*w*v) AS av, count(*) FILTER (v IS NULL) AS gaps, coalesce(sum(a*a*v) FILTER (map<>ref),0) AS off, count(*) FILTER (v IS NULL AND map<>ref) AS og, max(u) FILTER (map=ref) AS ua, max(p) FILTER (map=ref) AS pjj, max(v) FILTER (map=ref) AS uv, max(a) FILTER (map=ref) AS a, max(w) FILTER (map=ref) AS w FROM d3 GROUP BY ref),
ol AS (SELECT class, ua, sqrt(uv) AS ua_se, pjj/nullif(area,0) AS pa, CASE WHEN og=0 THEN sqrt((a*a*pow(1-pjj/nullif(area,0),2)*uv+pow(pjj/nullif(area,0),2)*off)/nullif(pow(aj,2),0)) END AS pa_se, area, CASE WHEN gaps=0 THEN sqrt(av) END AS area_se, sum(pjj) OVER () AS oa, sqrt(sum(w*w*uv) OVER ()) AS oa_se FROM k)"""


@_query(f", {OLOF} SELECT class, round(ua,6) AS ua, round(ua_se,6) AS ua_se, round(pa,6) AS pa, round(pa_se,6) AS pa_se, round(area,6) AS area, round(area_se,6) AS area_se, round(oa,6) AS oa, round(oa_se,6) AS oa_se FROM ol", "px")
def olofsson(spark, sf_dir):
    return r6(accuracy.olofsson(*_dense(_px(spark, sf_dir))))


def _group(c: str) -> str:
    return f"(floor(({c}-101)/3)+1)"


def _by_strata(sql: str) -> str:
    """The same SQL over transition strata: four groups of classes at two times make 16 codes of reference and of map."""
    codes = ", ".join(f"CAST({_group(a)}*10+{_group(b)} AS INT) AS {n}" for a, b, n in (("ref1", "ref2", "strata"), ("map1", "map2", "coded")))
    table = f"pc AS (SELECT px.*, {codes} FROM px)"
    return f", {table}, " + re.sub(r"\bpx\b", "pc", sql.lstrip(", ")).replace("ref1", "strata").replace("map1", "coded")


@_query(_by_strata(OLOF) + " SELECT class, round(ua,6) AS ua, round(ua_se,6) AS ua_se, round(pa,6) AS pa, round(pa_se,6) AS pa_se, round(area,6) AS area, round(area_se,6) AS area_se, round(oa,6) AS oa, round(oa_se,6) AS oa_se FROM ol", "px")
def transition_accuracy(spark, sf_dir):
    """Area-weighted accuracy of a change map: sample, pairs and estimates by transition strata."""
    code = lambda a, b, n: F.expr(f"CAST({_group(a)}*10+{_group(b)} AS INT)").alias(n)
    px = _px(spark, sf_dir, "row", "col", code("ref1", "ref2", "strata"), code("map1", "map2", "coded"))
    return r6(accuracy.olofsson(*_dense(px, "strata", "coded")))


def _shown(a: str, b: str, n: int, m: int) -> str:
    return f"format('{{{{:,.{n}f}}}}', round({a},{n})) || ' ± ' || format('{{{{:,.{m}f}}}}', round({b},{m}))"


Z95 = "1.959963984540054::DOUBLE"


@_query(f", {OLOF} SELECT class, round(area*1000,6) AS ha, round(area_se*1000,6) AS ha_se, round(area*1000-{Z95}*area_se*1000,6) AS ha_low, round(area*1000+{Z95}*area_se*1000,6) AS ha_high, round({Z95}*ua_se,6) AS ua_ci, round({Z95}*pa_se,6) AS pa_ci, {_shown('area*1000', '2*area_se*1000', 0, 0)} AS ha_text, {_shown('ua', Z95 + '*ua_se', 3, 4)} AS ua_text, {_shown('pa', Z95 + '*pa_se', 3, 4)} AS pa_text FROM ol".replace("{{", "{").replace("}}", "}"), "px")
def accuracy_summary(spark, sf_dir):
    return r6(accuracy.accuracy_summary(accuracy.olofsson(*_dense(_px(spark, sf_dir))), 1000.0))


# --- change ------------------------------------------------------------------------------------------------------------


@_query("SELECT count(*) FILTER (ref2 IS NULL OR map2 IS NULL OR ref2<>map2) AS changed, count(*) AS total, round(count(*) FILTER (ref2 IS NULL OR map2 IS NULL OR ref2<>map2)/count(*)*100,6) AS percent, round(count(*) FILTER (map2 IS NULL OR ref2<>map2)*0.09::DOUBLE,6) AS ha FROM px WHERE ref2 IS NOT NULL", "px")
def change_summary(spark, sf_dir):
    return r6(change.change_summary(_px(spark, sf_dir), "ref2", "map2"))


@_query(f"SELECT {PIX}, CASE WHEN ref2 IS NULL THEN NULL WHEN map2 IS NULL OR ref2<>map2 THEN 1 ELSE 0 END AS flag FROM px", "px")
def change_flag(spark, sf_dir):
    both = change.pair(_map(spark, sf_dir, "ref2"), _map(spark, sf_dir, "map2"))
    return both.select("tile", "row", "col", change.change_flag(F.col("c1"), F.col("c2")).alias("flag"))


@_query("SELECT coalesce(map2-ref2,0) AS difference, count(*) AS n FROM px GROUP BY 1", "px")
def difference_counts(spark, sf_dir):
    return change.difference_counts(_px(spark, sf_dir), "ref2", "map2")


@_query("SELECT count(map2-ref2) AS n, min(map2-ref2) AS min, max(map2-ref2) AS max, round(avg(map2-ref2),6) AS mean, round(stddev_pop(map2-ref2),6) AS std, count(*) FILTER (map2 IS NULL AND ref2 IS NOT NULL) AS only_a, count(*) FILTER (ref2 IS NULL AND map2 IS NOT NULL) AS only_b FROM px", "px")
def compare_rasters(spark, sf_dir):
    return r6(change.compare_rasters(_map(spark, sf_dir, "ref2"), _map(spark, sf_dir, "map2")))


def _gl(a: str, b: str, by: str = "") -> str:
    """Gains and losses in SQL: counts by class, and the area of the pixels of the first map that change."""
    key, part = (f"{by}, ", f"WHERE c.{by} IS NOT DISTINCT FROM g.{by}") if by else ("", "")
    changed = f"(SELECT {key}count(*) FILTER ({a} IS DISTINCT FROM {b}) * 0.09::DOUBLE AS ha FROM px WHERE {a} IS NOT NULL {'GROUP BY ' + by if by else ''})"
    counts = f"(SELECT {key}class, CAST(sum(a) AS BIGINT) AS n1, CAST(sum(b) AS BIGINT) AS n2 FROM (SELECT {key}{a} AS class, 1 AS a, 0 AS b FROM px UNION ALL SELECT {key}{b}, 0, 1 FROM px) WHERE class IS NOT NULL GROUP BY ALL)"
    own = f"g.{by}, " if by else ""
    return f"(SELECT {own}class, n1, n2, round(n1*0.09::DOUBLE,6) AS ha1, round(n2*0.09::DOUBLE,6) AS ha2, n2-n1 AS diff, round((n2-n1)*0.09::DOUBLE,6) AS diff_ha, round((n2-n1)/nullif(n1,0)*100,6) AS pct_of_first, round((n2-n1)*0.09::DOUBLE/nullif((SELECT max(ha) FROM {changed} c {part}),0)*100,6) AS pct_of_change FROM {counts} g)"


@_query(f"SELECT * FROM {_gl('ref1', 'ref2')}", "px")
def gain_loss(spark, sf_dir):
    return r6(change.gain_loss(_px(spark, sf_dir), "ref1", "ref2"))


@_query(f", g AS {_gl('ref1', 'ref2')} SELECT '2013-2016' AS period, class, n1 AS frequency, ha1 AS ha, diff_ha AS difference, pct_of_first, pct_of_change FROM g UNION ALL SELECT '2019-2022', class, n2, ha2, diff_ha, pct_of_first, pct_of_change FROM g", "px")
def gain_loss_long(spark, sf_dir):
    return r6(change.gain_loss_long(change.gain_loss(_px(spark, sf_dir), "ref1", "ref2"), ("2013-2016", "2019-2022")))


@_query(" UNION ALL ".join(f"SELECT *, '{a}' AS \"from\", '{b}' AS \"to\" FROM {_gl(a, b)}" for a, b in (("ref1", "ref2"), ("ref2", "map2"), ("ref1", "map2"))), "px")
def gain_loss_periods(spark, sf_dir):
    return r6(change.gain_loss_periods(_px(spark, sf_dir), ["ref1", "ref2", "map2"]))


@_query(f", {TR} SELECT CAST(code AS INT) AS code, c1, c2, n, ha FROM tr", "px")
def transition_counts(spark, sf_dir):
    return _tr(spark, sf_dir)


@_query(f", {TR} SELECT c2 AS \"to\", " + ", ".join(f"coalesce(sum(ha) FILTER (c1={c}),0.0::DOUBLE) AS from_{c}" for c in CLASSES) + " FROM tr WHERE c1 IS NOT NULL AND c2 IS NOT NULL GROUP BY c2", "px")
def transition_matrix(spark, sf_dir):
    return change.transition_matrix(_tr(spark, sf_dir), CLASSES)


@_query(f", {TR} SELECT c1, c2, round(n/sum(n) OVER (PARTITION BY c1)*100,6) AS percent FROM tr WHERE c1 IS NOT NULL AND c2 IS NOT NULL", "px")
def transition_percent(spark, sf_dir):
    return r6(change.transition_percent(_tr(spark, sf_dir)))


def _state(rules: dict) -> str:
    some = lambda k: ",".join(map(str, rules[k]))
    return f", {TR} SELECT CASE WHEN code IN ({some('loss')}) THEN 3 WHEN code IN ({some('unchanged')}) THEN 2 WHEN code IN ({some('gain')}) THEN 1 ELSE 0 END AS state, CAST(sum(n) AS BIGINT) AS n, round(sum(n)*0.09::DOUBLE,6) AS ha FROM tr GROUP BY 1"


@_query(_state(change.FOREST), "px")
def forest_gain_loss(spark, sf_dir):
    return r6(change.gain_loss_counts(_tr(spark, sf_dir), change.FOREST))


@_query(_state(change.BUILT), "px")
def built_gain_loss(spark, sf_dir):
    return r6(change.gain_loss_counts(_tr(spark, sf_dir), change.BUILT))


@_query(" UNION ALL ".join(f"SELECT '{k}' AS rules, * FROM ({_state(v)[2:].replace('tr AS', 'WITH tr AS', 1)})" for k, v in change.SINGLE.items()), "px")
def single_class_gain_loss(spark, sf_dir):
    tr = _tr(spark, sf_dir)
    made = [change.gain_loss_counts(tr, rules).withColumn("rules", F.lit(k)) for k, rules in change.SINGLE.items()]
    return r6(functools.reduce(DataFrame.unionByName, made))


CHI = "g AS (SELECT class, sum(a) AS f1, sum(b) AS f2 FROM (SELECT ref1 AS class, 1 AS a, 0 AS b FROM px UNION ALL SELECT ref2, 0, 1 FROM px) WHERE class IS NOT NULL GROUP BY 1), x AS (SELECT *, trunc(f1/(sum(f1) OVER ())*(sum(f2) OVER ())) AS expected FROM g)"


@_query(f", {CHI}, s AS (SELECT sum((f2-expected)*(f2-expected)/nullif(expected,0)) AS chi2, count(*)-1 AS dof, CAST(sum(f1)+sum(f2) AS BIGINT) AS n FROM x) SELECT round(chi2,6) AS chi2, dof, n, round(sqrt(chi2/(n*nullif(least(dof,1),0))),6) AS cramers_v FROM s", "px")
def chi_square_maps(spark, sf_dir):
    return r6(change.chi_square_maps(_px(spark, sf_dir), "ref1", "ref2"))


#: Pearson's statistic of the rows expected and f2, and its tail by the series of the incomplete gamma function.
PEARSON = "y AS (SELECT expected AS a, f2 AS b FROM x WHERE expected>0 OR f2>0), z AS (SELECT *, sum(a) OVER () AS sa, sum(b) OVER () AS sb, count(*) OVER () AS k FROM y), stat AS (SELECT sum(pow(a-(a+b)*sa/(sa+sb),2)/((a+b)*sa/(sa+sb))+pow(b-(a+b)*sb/(sa+sb),2)/((a+b)*sb/(sa+sb))) AS x, max(k)-1 AS dof FROM z), tail AS (SELECT x, dof, 1-list_sum(list_transform(range(CAST(x AS BIGINT)+500), lambda i: exp(-x/2+(dof/2+i)*ln(x/2)-lgamma(dof/2+i+1)))) AS p FROM stat)"


@_query(f", {CHI}, {PEARSON} SELECT dof, round(x,6) AS statistic, round(p,6) AS p, p<=0.05 AS dependent FROM tail", "px")
def contingency_test(spark, sf_dir):
    """Statistic, degrees of freedom, p and whether the maps differ."""
    found = change.contingency_test(change.chi_square_table(_px(spark, sf_dir), "ref1", "ref2"))
    return r6(spark.createDataFrame([tuple(found[k] for k in ("dof", "statistic", "p", "dependent"))], "dof long, statistic double, p double, dependent boolean"))


@_query(f", {CHI}, {PEARSON}, s AS (SELECT sum((f2-expected)*(f2-expected)/nullif(expected,0)) AS chi2, count(*)-1 AS dof, sum(f1)+sum(f2) AS n FROM x), c AS (SELECT count(*) FILTER (ref2 IS NULL OR ref1<>ref2) AS ch, count(*) AS t FROM px WHERE ref1 IS NOT NULL) SELECT unnest(['change_pixels','total_pixels','percent_change','change_ha','chi_square','dof','sample_size','m','cramers_v','alpha','contingency_statistic','p_value','contingency_dof','maps_differ']) AS key, round(unnest([ch::DOUBLE, t::DOUBLE, ch/t*100, ch*0.09::DOUBLE, chi2, s.dof::DOUBLE, n::DOUBLE, least(s.dof,1)::DOUBLE, sqrt(chi2/(n*nullif(least(s.dof,1),0))), 0.05::DOUBLE, tail.x, p, tail.dof::DOUBLE, (p<=0.05)::INT::DOUBLE]),6) AS value FROM s, c, tail", "px")
def change_report(spark, sf_dir):
    """The report but for its critical value, for which SQL has no function."""
    return r6(change.change_report(_px(spark, sf_dir), "ref1", "ref2").filter("key <> 'critical_value'"))


@_query(f"SELECT * FROM {_gl('ref1', 'ref2', 'zone')} WHERE zone IS NOT NULL", "px")
def zone_effectiveness(spark, sf_dir):
    return r6(change.gain_loss(_px(spark, sf_dir), "ref1", "ref2", ["zone"]).filter("zone is not null"))


@_query(f", {TRZ}, z AS (SELECT zone, c1, c2, ha, n/sum(n) OVER (PARTITION BY zone, c1)*100 AS pct FROM tr WHERE c1 IS NOT NULL AND c2 IS NOT NULL), t AS (SELECT zone, c2, format('{{:,.2f}} ({{:,.2f}}%)', ha, pct) AS text FROM z WHERE c1=106 AND c2 IN (101,102,109)) SELECT c2, max(text) FILTER (zone='in') AS \"in\", max(text) FILTER (zone='out') AS \"out\" FROM t GROUP BY c2", "px")
def zone_compare(spark, sf_dir):
    return change.zone_compare(_tr(spark, sf_dir, ("zone",)), 106, [101, 102, 109], ["in", "out"])


@_query(f", {TR}, t AS (SELECT *, n/sum(n) OVER (PARTITION BY c1)*100 AS pct FROM tr WHERE c1 IS NOT NULL AND c2 IS NOT NULL) SELECT c1, c2, format('{{:,.2f}}', ha)||chr(10)||format('{{:,.2f}}', pct)||'%' AS text FROM t WHERE c1<>103 AND c2<>103", "px")
def transition_labels(spark, sf_dir):
    return change.transition_labels(_tr(spark, sf_dir), [103])


@_query(", r AS (SELECT CAST(coalesce(ref1,0)*1000+coalesce(ref2,0) AS INT) AS code, count(*) AS ref_n FROM px GROUP BY 1), m AS (SELECT CAST(coalesce(map1,0)*1000+coalesce(map2,0) AS INT) AS code, count(*) AS map_n FROM px GROUP BY 1) SELECT code, ref_n, map_n, round(ref_n/sum(ref_n) OVER ()*100,6) AS ref_pct FROM r FULL JOIN m USING (code) WHERE code<>0", "px")
def change_pixel_counts(spark, sf_dir):
    return r6(change.change_pixel_counts(_px(spark, sf_dir), ("ref1", "ref2"), ("map1", "map2")))


# --- series, climate, plots --------------------------------------------------------------------------------------------

DATED = "sc AS (SELECT *, CAST(strptime(substr(path,12,7),'%Y%j') AS DATE) AS date FROM scene)"


@_query(f", {DATED} SELECT site, date, CAST(trunc(avg(value)) AS INT) AS value FROM sc GROUP BY site, date", "scene")
def site_series(spark, sf_dir):
    return series.series_by_site(view(spark, sf_dir, "scene"), ["site"])


@_query(f", {DATED}, j AS (SELECT date, site%10 AS r, value FROM sc) SELECT date, CAST(trunc(avg(value) FILTER (r BETWEEN 1 AND 3)) AS INT) AS a, CAST(trunc(avg(value) FILTER (r BETWEEN 6 AND 8)) AS INT) AS b FROM j GROUP BY date HAVING a IS NOT NULL OR b IS NOT NULL", "scene")
def site_series_many(spark, sf_dir):
    scenes = view(spark, sf_dir, "scene").select("path", "value", F.lit(0).alias("row"), (F.col("site") % 10).cast("int").alias("col"))
    sites = scenes.select("col").filter("col in (2, 7)").distinct().select(F.when(F.col("col") == 2, "a").otherwise("b").alias("site"), F.lit(0).alias("row"), "col")
    return series.site_series_many(scenes, sites, ["a", "b"], 3)


@_query(f", {DATED} SELECT a.date, a.v AS a, b.v AS b FROM (SELECT date, CAST(trunc(avg(value)) AS INT) AS v FROM sc WHERE site%2=0 GROUP BY date) a FULL JOIN (SELECT date, CAST(trunc(avg(value)) AS INT) AS v FROM sc WHERE site%2=1 GROUP BY date) b USING (date)".replace("SELECT a.date", "SELECT coalesce(a.date, b.date) AS date"), "scene")
def series_align(spark, sf_dir):
    scenes = view(spark, sf_dir, "scene")
    return series.series_align(series.series_by_site(scenes.filter("site % 2 = 0"), []), series.series_by_site(scenes.filter("site % 2 = 1"), []))


@_query("SELECT CAST(strptime(substr(path,12,7),'%Y%j') AS DATE) AS date, CAST(trunc(avg(value)) AS INT) AS value FROM scene WHERE site//25 BETWEEN -2 AND 4 AND site%25 BETWEEN 1 AND 7 GROUP BY ALL", "scene")
def site_window_series(spark, sf_dir):
    """Scenes as pixels, sites in rows of 25; the window around one of them."""
    scenes = view(spark, sf_dir, "scene").withColumns({"row": F.floor(F.col("site") / 25), "col": F.col("site") % 25})
    return series.site_series(scenes, 1, 4, 7)


@_query("SELECT pix, band, round(sum(value)/nullif(count(*) FILTER (value>0),0),6) AS mean FROM obs GROUP BY pix, band", "obs")
def annual_mean(spark, sf_dir):
    return r6(series.annual_mean(_obs(spark, sf_dir), ["pix", "band"]))


@_query("SELECT upmid, x FROM plots WHERE state IN ('BUILDING','MACHINERY')", "plots")
def plots_region(spark, sf_dir):
    return series.plots_region(view(spark, sf_dir, "plots"), ["BUILDING", "MACHINERY"], ["upmid", "x"])


@_query("SELECT cluster, arg_min(state, upmid) AS state, arg_min(x, upmid) FILTER (x IS NOT NULL) AS x FROM plots GROUP BY cluster", "plots")
def first_per_key(spark, sf_dir):
    return series.first_per_key(view(spark, sf_dir, "plots"), "cluster", "upmid")


@_query("SELECT count(upmid)=count(DISTINCT upmid) AS is_unique FROM plots", "plots")
def key_unique(spark, sf_dir):
    return series.key_unique(view(spark, sf_dir, "plots"), "upmid")


# --- classifier: a learned model has no SQL ----------------------------------------------------------------------------


def _vectors(spark, sf_dir):
    from pyspark.ml.functions import array_to_vector

    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return df.select("vec_id", array_to_vector("embedding").alias("features"), F.col("label").cast("int").alias("label"), (F.col("vec_id") % 2 == 0).cast("int").alias("is_train"), (F.col("vec_id") % 5 != 1).cast("int").alias("roi"))


def _model(spark, sf_dir):
    return forest.fit_forest(forest.training_set(_vectors(spark, sf_dir), "label"), range(10))


@_query()
def forest_predict(spark, sf_dir):
    return forest.predict_map(_model(spark, sf_dir), _vectors(spark, sf_dir), list(range(10)), ["vec_id"])


@_query()
def saved_forest_predict(spark, sf_dir):
    path = pixels.shared_folder(spark)
    forest.save_model(_model(spark, sf_dir), path)
    return forest.predict_map(forest.load_model(path), _vectors(spark, sf_dir), list(range(10)), ["vec_id"])


@_query()
def feature_importance(spark, sf_dir):
    return forest.feature_importance(spark, _model(spark, sf_dir), [f"e{i}" for i in range(64)])


@_query()
def holdout_accuracy(spark, sf_dir):
    data = _vectors(spark, sf_dir)
    share = forest.holdout_accuracy(data.select("vec_id", "features", "label"), list(range(10)), "vec_id")
    return spark.createDataFrame([(share,)], "accuracy double")


@_query()
def out_of_bag_accuracy(spark, sf_dir):
    data = _vectors(spark, sf_dir).select("vec_id", "features", "label")
    model = forest.fit_forest(data, range(10), key=["vec_id"])
    return spark.createDataFrame([(forest.out_of_bag_accuracy(model, data, range(10)),)], "accuracy double")


@_query()
def forest_importance_by_period(spark, sf_dir):
    """The cube holds two periods of 32 features each; a forest a period."""
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("embedding", F.col("label").cast("int").alias("label"))
    names = [f"e{i}" for i in range(32)]
    fit = lambda first: forest.fit_forest(df.select(F.slice("embedding", first, 32).alias("features"), "label"), range(10))
    return forest.importance_by_period({p: forest.feature_importance(spark, fit(first), names) for p, first in (("p1", 1), ("p2", 33))})


@_query("SELECT coalesce(a.band, b.band) AS feature, a.v AS p1, b.v AS p2 FROM (SELECT band, round(avg(value),6) AS v FROM obs WHERE month<=8 GROUP BY band) a FULL JOIN (SELECT band, round(avg(value),6) AS v FROM obs WHERE month>=5 GROUP BY band) b ON a.band=b.band", "obs")
def importance_by_period(spark, sf_dir):
    long = _obs(spark, sf_dir)
    mean = lambda df: df.groupBy(F.col("band").alias("feature")).agg(F.avg("value").alias("importance"))
    return r6(forest.importance_by_period({"p1": mean(long.filter("month <= 8")), "p2": mean(long.filter("month >= 5"))}))
