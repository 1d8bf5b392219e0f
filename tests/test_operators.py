"""Examples worked out by hand, and properties."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from coverspark.functions import chisq
from coverspark.operators import accuracy, change, classes, features, forest, grid, quality, repair, sampling, series
from coverspark.sources import pixels

PX = "tile string, row int, col int, value int"


def px(spark, values, tile="a", schema=PX):
    return spark.createDataFrame([(tile, r, c, v) for r, line in enumerate(values) for c, v in enumerate(line)], schema)


def grid_of(df):
    return {(r["row"], r["col"]): r["value"] for r in df.collect()}


def test_fix_annual(spark):
    df = spark.createDataFrame([(x,) for x in (-1, 0, 365, 366, 730, 731, 3650)], "x int")
    assert [r[0] for r in df.select(repair.fix_annual(F.col("x"))).collect()] == [-1, 0, 365, 1, 365, 1, 365]


@pytest.mark.parametrize(
    ("qa", "aerosol", "rank"),
    [(2, 64, 0), (2, 128, 1), (2, 0, 2), (2, 192, 2), (0, 64, 2), (2 | 8, 64, 2), (2 | 32, 64, 2), (2 | 4, 64, 3), (2 | 16, 64, 3), (4 | 32, 64, 3), (2 | 128, 64, 2), (2 | 512, 64, 2), (2, 64 | 8, 2), (2, None, None), (None, 64, 2)],
)
def test_qa_rank(spark, qa, aerosol, rank):
    df = spark.createDataFrame([(qa, aerosol)], "q int, a int")
    assert df.select(quality.qa_rank(F.col("q"), F.col("a"))).first()[0] == rank


def test_fill_mode_rules(spark):
    hole = [[5, 5, 7, 7, 9], [5, -1, -1, -1, 9], [7, -1, -1, -1, 9], [7, -1, -1, -1, 9], [1, 2, 2, 8, 8]]
    got = grid_of(repair.fill_mode(px(spark, hole)))
    assert got[1, 1] == 5 + 0 * got[1, 1] or got[1, 1] == 5  # 5 5 7 5 7: mode 5 is the least, so the mean 29 // 5
    assert got[1, 1] == 29 // 5
    assert got[2, 3] == 9  # three nines only: mode is the least, and so is the mean
    near = [v for line in hole for v in line if v >= 0]
    best = min(near, key=lambda v: (-near.count(v), v))
    assert got[2, 2] == best
    assert all(got[r, c] == v for r, line in enumerate(hole) for c, v in enumerate(line) if v >= 0)


def test_windows_stop_at_tiles_and_nothing_valid_stays(spark):
    a, b = px(spark, [[-1, -1]], "a"), px(spark, [[4, 4]], "b")
    got = {(r["tile"], r["col"]): r["value"] for r in repair.fill_mode(a.union(b)).collect()}
    assert got == {("a", 0): -1, ("a", 1): -1, ("b", 0): 4, ("b", 1): 4}


def test_gaps_wider_than_21_pixels_are_filled(spark):
    cells = [[(r * 7 + c * 3) % 5 if c < 2 or c > 30 else -1 for c in range(33)] for r in range(30)]
    cells[3:] = [[-1] * 33 for _ in cells[3:]]
    got = grid_of(repair.fill_mode(px(spark, cells)))
    season = spark.createDataFrame([("a", r, c, v, v, v) for r, line in enumerate(cells) for c, v in enumerate(line)], "tile string, row int, col int, sos int, eos int, los int")
    sos = {(r["row"], r["col"]): r["sos"] for r in repair.fill_season(season).collect()}
    for r, c in ((r, c) for r in range(30) for c in range(33) if cells[r][c] < 0):
        found, k = [], 0
        while not found:
            k += 1
            found = [v for line in cells[max(0, r - k) : r + k + 1] for v in line[max(0, c - k) : c + k + 1] if v >= 0]
        mode = min(found, key=lambda v: (-found.count(v), v))
        assert got[r, c] == (sum(found) // len(found) if mode == min(found) else mode)
        assert sos[r, c] == mode


def test_lattice(spark):
    for rows, cols, n in ((14, 14, 4), (15, 15, 4), (16, 10, 2)):
        df = spark.range(rows * cols).select((F.col("id") / cols).cast("int").alias("row"), (F.col("id") % cols).cast("int").alias("col"))
        assert sampling.windows(df, 7, rows, cols).select("wr", "wc").distinct().count() == n


def test_sample_reaches_targets_by_less_than_a_window(spark):
    cells = [[101 if (r * 31 + c * 17) % 10 < 7 else 106 for c in range(70)] for r in range(70)]
    df = px(spark, cells).withColumnRenamed("value", "class_")
    targets = spark.createDataFrame([(101, 300), (106, 120), (109, 10)], "class int, target long")
    draw = lambda seed: sorted(map(tuple, sampling.stratified_sample(df, targets, 7, 70, 70, seed, "class_").collect()))
    one = draw(5)
    assert one == draw(5) != draw(6)
    for c, t in ((101, 300), (106, 120)):
        n = sum(r[3] == c for r in one)
        assert t <= n < t + 49


def test_sample_size_and_allocation(spark):
    strata = spark.createDataFrame([(1, 6000, 0.8), (2, 3000, 0.8), (3, 700, 0.8), (4, 300, 0.8)], "class int, pixels long, u double")
    n = sampling.sample_size(strata, 0.01).first()["size"]
    assert n == pytest.approx(0.16 / (0.0001 + 0.16 / 10000))
    assert sampling.sample_size(strata, 0.01, short=True).first()["size"] == pytest.approx(1600)
    rows = {r["class"]: r for r in sampling.allocate(strata, sampling.sample_size(strata, 0.01)).collect()}
    assert [rows[c]["prop"] for c in (1, 2, 3, 4)] == [int(round(n) * w) for w in (0.6, 0.3, 0.07, 0.03)]
    assert rows[3]["alloc1"] == rows[4]["alloc1"] == 100
    assert rows[4]["alloc3"] == 50 if rows[4]["prop"] < 50 else True
    assert rows[None]["equal"] == 4 * round(n / 4)


def test_chi_square_functions():
    assert chisq.quantile(0.95, 1) == pytest.approx(3.841458820694124, abs=1e-9)
    assert chisq.quantile(0.95, 10) == pytest.approx(18.307038053275146, abs=1e-9)
    assert chisq.upper_tail(2 * math.log(20), 2) == pytest.approx(0.05, abs=1e-12)


def test_contingency_with_one_degree_of_freedom(spark):
    t = spark.createDataFrame([(10, 20), (30, 15), (0, 0)], "expected long, f2 long")
    got = change.contingency_test(t)
    n = 75
    expected = n * (abs(10 * 15 - 30 * 20) - n / 2) ** 2 / (40 * 35 * 30 * 45)
    assert got["dof"] == 1
    assert got["statistic"] == pytest.approx(expected)


def test_accuracy_properties(spark):
    same = spark.createDataFrame([(1, 1), (2, 2), (2, 2), (3, 3)], "truth int, predict int")
    conf = accuracy.confusion(same)
    assert accuracy.kappa(conf).first()[0] == pytest.approx(1)
    mixed = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (3, 1), (3, 3), (3, 3)], "truth int, predict int")
    c = accuracy.confusion(mixed)
    swapped = accuracy.confusion(mixed, "predict", "truth")
    users = {(r["truth"], r["predict"]): r["share"] for r in accuracy.normalize_conf(c, "predict").collect()}
    producers = {(r["predict"], r["truth"]): r["share"] for r in accuracy.normalize_conf(swapped, "truth").collect()}
    assert users == producers


def test_olofsson_areas_add_up_and_single_samples_have_no_error(spark):
    counts = [(1, 1, 66), (1, 2, 5), (2, 1, 4), (2, 2, 1)]
    conf = spark.createDataFrame([*counts, (3, 3, 1), (3, 1, 0), (3, 2, 0), (1, 3, 0), (2, 3, 0)], "map int, ref int, n long")
    areas = spark.createDataFrame([(1, 200.0), (2, 150.0), (3, 3.0)], "class int, ha double")
    rows = {r["class"]: r for r in accuracy.olofsson(conf, areas).collect()}
    assert sum(r["area"] for r in rows.values()) == pytest.approx(1)
    assert rows[1]["ua"] == pytest.approx(66 / 71)
    assert rows[1]["ua_se"] == pytest.approx(math.sqrt(66 / 71 * 5 / 71 / 70))
    assert rows[3]["ua_se"] is None


def test_change_null_rule_and_transitions(spark):
    m1, m2 = px(spark, [[1, 2, 3], [1, None, 2], [1, 1, 1]]), px(spark, [[1, 3, 3], [None, 4, 2], [1, 1, 2]])
    both = change.pair(m1, m2)
    s = change.change_summary(both, "c1", "c2").first()
    assert (s["changed"], s["total"]) == (3, 8)
    tr = change.transition_counts(both, "c1", "c2")
    assert sum(r["n"] for r in change.both_valid(tr).collect()) == 7
    per = {}
    for r in change.transition_percent(tr).collect():
        per[r["c1"]] = per.get(r["c1"], 0) + r["percent"]
    assert all(v == pytest.approx(100) for v in per.values())


def test_gain_loss_states():
    for rules in (change.FOREST, change.BUILT):
        for a, b in itertools.combinations(rules.values(), 2):
            assert not set(a) & set(b)


def test_tiles_cut_and_put_back(spark):
    g = spark.createDataFrame([(0.0, 100.0, 10.0, -10.0, 4, 4)], "ulx double, uly double, xres double, yres double, nrows int, ncols int")
    tiles = spark.createDataFrame([("p", 100, 0, 80, 20), ("q", 100, 20, 80, 40), ("r", 80, 0, 60, 20), ("s", 80, 20, 60, 40)], "tile string, n long, w long, s long, e long")
    slices = grid.tile_slices(tiles, g)
    whole = px(spark, [[r * 4 + c for c in range(4)] for r in range(4)])
    back = grid.mosaic(grid.assign_tile(whole, slices), slices)
    assert grid_of(back) == grid_of(whole)
    xy = {(r["row"], r["col"]): (r["x"], r["y"]) for r in grid.with_xy(whole, g).collect()}
    assert xy[2, 3] == (30.0, 80.0)


def test_files_round_trip(spark, tmp_path):
    p = str(tmp_path / "px")
    pixels.write_pixels(px(spark, [[1, None], [3, 4]]), p, "int16", -1)
    back = pixels.read_pixels(spark, p, -1)
    assert grid_of(back) == {(0, 0): 1, (0, 1): None, (1, 0): 3, (1, 1): 4}
    assert pixels.list_files(spark, p + "/tile=a", ".parquet").count() >= 1
    (tmp_path / "tiles").write_text("h1,N=10.9,W=-3.9,S=0,E=5\n\n")
    assert [tuple(r) for r in pixels.read_tiles(spark, str(tmp_path / "tiles")).collect()] == [("h1", 10, -3, 0, 5)]
    (tmp_path / "ranges").write_text("MIN_BAND=0\n\nNAN=-13000\n")
    assert {r["key"]: r["value"] for r in pixels.read_params(spark, str(tmp_path / "ranges")).collect()} == {"MIN_BAND": 0, "NAN": -13000}
    (tmp_path / "legend").write_text("101 255 0 10 255 - Agriculture land\n")
    assert tuple(pixels.read_legend(spark, str(tmp_path / "legend")).first()) == (101, 255, 0, 10, 255, "Agriculture land")
    (tmp_path / "keys.csv").write_text("A,B,C,D\n101,Farm,1,human\n102,Town,1,built\n")
    keys = pixels.read_class_keys(spark, str(tmp_path / "keys.csv"))
    assert [tuple(r) for r in pixels.group_names(keys).collect()] == [(1, "built")]
    pixels.write_report(keys, str(tmp_path / "report"))
    assert spark.read.option("header", True).csv(str(tmp_path / "report")).count() == 2
    assert pixels.run_record(spark, {"trees": 250}).first()["value"] == "250"
    assert pixels.read_feature(spark.createDataFrame([("a", 0, 0, 2.5)], "tile string, row int, col int, f double"), "f").first()["value"] == 2


def test_feature_names(spark):
    assert features.monthly_features(spark).count() == 232
    assert features.seasonal_features(spark).count() == 88
    names = ["JAN B2 (Blue) AVG", "FEB NDVI STDEV", "PHEN SOS2", "SPR NDVI AVG"]
    df = spark.createDataFrame([(n,) for n in names], "f string")
    got = [tuple(r[0]) for r in df.select(features.parse_feature(F.col("f"))).collect()]
    assert got == [("JAN", "BLUE", "AVG", "BAND"), ("FEB", "NDVI", "STDEV", "VI"), (None, "SOS2", None, "PHEN"), ("SPR", "NDVI", "AVG", "VI")]
    assert [tuple(r[0]) for r in df.select(features.feature_type(F.col("f"))).collect()] == [("BAND", "AVG"), ("VI", "STD"), ("PHEN", "VAL"), ("VI", "AVG")]
    wide = spark.createDataFrame([(1, 2, None, 3)], "APR_NIR_AVG int, MAY_NIR_AVG int, JUN_NIR_AVG int, PHEN_SOS int")
    assert features.seasonal_composite(wide, ["NIR"]).first()["SPR_NIR_AVG"] == 2
    assert features.seasonal_composite(wide, ["NIR"], strict=True).first()["SPR_NIR_AVG"] == 1


def test_scaling_of_equal_values_is_null(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("b", 3)], "f string, value int")
    assert sorted(str(r["value"]) for r in features.normalize(df, ["f"]).collect()) == ["0.0", "1.0", "None", "None"]


def test_empty_inputs(spark):
    none = px(spark, [])
    assert classes.class_freq(none).count() == 0
    assert repair.fill_mode(none).count() == 0
    assert change.transition_counts(change.pair(none, none), "c1", "c2").count() == 0
    assert accuracy.confusion(none.select(F.col("row").alias("truth"), F.col("col").alias("predict"))).count() == 0


def test_series_windows(spark):
    scenes = px(spark, [[r * 10 + c for c in range(9)] for r in range(9)]).withColumn("path", F.lit("LANDSAT08.A2013144.h019v025.hdf"))
    row = series.site_series(scenes, 4, 4, 7).first()
    assert (str(row["date"]), row["value"]) == ("2013-05-24", 44)
    assert series.site_series(scenes, 4, 4, 7, legacy=True).first()["value"] == 38


def test_forest_is_repeatable_and_survives_saving(spark, tmp_path):
    from pyspark.ml.functions import array_to_vector

    df = spark.range(200).select(F.array((F.col("id") % 2).cast("double"), (F.col("id") % 7).cast("double")).alias("a"), (F.col("id") % 2 + 101).cast("int").alias("label"), F.lit(1).alias("roi"), "id")
    df = df.withColumn("features", array_to_vector("a"))
    fit = lambda: forest.fit_forest(df, [101, 102], trees=5, depth=4)
    one, two = (sorted(map(tuple, forest.predict_map(m, df, [101, 102], ["id"]).collect())) for m in (fit(), fit()))
    assert one == two == [(i, i % 2 + 101) for i in range(200)]
    forest.save_model(fit(), str(tmp_path / "m"))
    assert forest.load_model(str(tmp_path / "m")).getNumTrees == 5


def test_registered_forests_have_production_size(spark, sf_dir, monkeypatch):
    from coverspark.plans import registry

    asked = []
    fit = lambda df, classes, trees=250, depth=30, **more: asked.append((trees, depth)) or real(df.limit(50), classes, trees=1, depth=2, **more)
    real = forest.fit_forest
    assert real.__defaults__[:2] == (250, 30)
    monkeypatch.setattr(forest, "fit_forest", fit)
    registry.QUERIES["feature_importance"](spark, sf_dir)
    registry.QUERIES["forest_predict"](spark, sf_dir)
    registry.QUERIES["holdout_accuracy"](spark, sf_dir)
    assert asked == [(250, 30)] * 3


def test_change_percents_have_signs_and_count_changed_pixels(spark):
    # eight pixels of map 1: 1 1 1 1 2 2 3 -; map 2: 1 1 2 - 1 2 3 3; changed are the third, fourth and fifth
    pairs = [(1, 1), (1, 1), (1, 2), (1, None), (2, 1), (2, 2), (3, 3), (None, 3)]
    got = {r["class"]: r for r in change.gain_loss(spark.createDataFrame(pairs, "c1 int, c2 int"), "c1", "c2").collect()}
    assert [got[c]["diff"] for c in (1, 2, 3)] == [-1, 0, 1]
    assert [got[c]["pct_of_change"] for c in (1, 2, 3)] == pytest.approx([-100 / 3, 0, 100 / 3])
    assert got[1]["pct_of_first"] == pytest.approx(-25)
    long = change.gain_loss_long(change.gain_loss(spark.createDataFrame(pairs, "c1 int, c2 int"), "c1", "c2"), ("a", "b")).collect()
    assert {(r["period"], r["class"]): r["frequency"] for r in long} == {("a", 1): 4, ("a", 2): 2, ("a", 3): 1, ("b", 1): 3, ("b", 2): 2, ("b", 3): 2}
    assert all(r["difference"] == got[r["class"]]["diff_ha"] for r in long)


def test_printed_accuracy_has_the_digits_of_reports(spark):
    rows = [(1, 0.91234, 0.012345, 0.85, 0.02, 0.25, 0.001)]
    est = spark.createDataFrame(rows, "class int, ua double, ua_se double, pa double, pa_se double, area double, area_se double")
    r = accuracy.accuracy_summary(est, 1_000_000.0).first()
    assert r["ha_text"] == "250,000 ± 2,000"
    assert r["ua_text"] == "0.912 ± 0.0242" and r["pa_text"] == "0.850 ± 0.0392"


def test_common_mask_counts_maps_not_rows(spark):
    a = px(spark, [[1, 1]])
    assert grid_of(grid.common_mask(a.union(a), px(spark, [[1, 0]])).withColumn("value", F.lit(1))) == {(0, 0): 1}


def test_distinct_values_are_rows(spark):
    assert sorted(r[0] for r in classes.distinct_values(px(spark, [[3, 1], [1, None]])).collect()) == [1, 3]


def test_single_class_rules_override_in_order():
    for rules in change.SINGLE.values():
        codes = [c for group in rules.values() for c in group]
        assert len(codes) == len(set(codes))


def test_change_report_has_both_tests(spark):
    pairs = [(1, 1)] * 40 + [(1, 2)] * 10 + [(2, 2)] * 30 + [(2, 3)] * 20 + [(3, 3)] * 25
    got = {r["key"]: r["value"] for r in change.change_report(spark.createDataFrame(pairs, "c1 int, c2 int"), "c1", "c2").collect()}
    assert got["change_pixels"] == 30 and got["total_pixels"] == 125 and got["dof"] == got["contingency_dof"] == 2 and got["m"] == 1 and got["alpha"] == 0.05
    assert got["critical_value"] == pytest.approx(-2 * math.log(0.05))
    assert got["p_value"] == pytest.approx(math.exp(-got["contingency_statistic"] / 2)) and got["maps_differ"] == float(got["p_value"] <= 0.05)


def test_a_hole_of_40_pixels_and_nulls_outside_the_region(spark):
    cells = [[(r + c) % 4 if max(r, c) >= 42 or min(r, c) < 2 else -1 for c in range(44)] for r in range(44)]
    rows = [("a", r, c, v if r < 43 else None, int(r < 43)) for r, line in enumerate(cells) for c, v in enumerate(line)]
    df = spark.createDataFrame(rows, "tile string, row int, col int, value int, roi int")
    got = {(r["row"], r["col"]): r["value"] for r in repair.fill_mode(df, inside="roi").collect()}
    assert all(v >= 0 for (r, _), v in got.items() if r < 43)
    assert all(v is None for (r, _), v in got.items() if r == 43)
    for r, c in ((22, 22), (10, 30), (41, 41)):
        found, k = [], 0
        while not found:
            k += 1
            found = [x for (y, z), x in (((y, z), v) for _, y, z, v, _ in rows) if max(abs(y - r), abs(z - c)) <= k and x is not None and x >= 0]
        mode = min(found, key=lambda v: (-found.count(v), v))
        assert got[r, c] == (sum(found) // len(found) if mode == min(found) else mode)
