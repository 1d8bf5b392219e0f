"""Forests: growth by levels equals growth in one task, out-of-bag votes and importances against plain versions."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from coverspark.operators import forest

CLASSES = [101, 104, 106]


@pytest.fixture(scope="module")
def cube(spark):
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(400, 6)), 2)
    y = np.where(x[:, 0] + x[:, 1] > 0.5, 101, np.where(x[:, 2] > 0, 104, 106))
    y[:40] = rng.choice(CLASSES, 40)
    rows = [(i, r.tolist(), int(c), int(i % 9 > 0)) for i, (r, c) in enumerate(zip(x, y, strict=True))]
    rows += [(1000, [float("nan"), 0.1, 0.2, 0.3, 0.4, 0.5], 101, 1), (1001, x[5].tolist(), None, 1), (1002, x[6].tolist(), 999, None)]
    return spark.createDataFrame(rows, "id long, features array<double>, label int, roi int").repartition(5)


def nodes_of(model):
    return sorted((tuple(r)[:6] + (tuple(r["counts"]),) for r in model.nodes.collect()), key=lambda r: r[:2])


@pytest.mark.parametrize("strategy", ["all", "sqrt"])
def test_levels_and_subtrees_make_the_same_forest(cube, strategy):
    whole, levels = (forest.fit_forest(cube, CLASSES, trees=4, depth=6, strategy=strategy, key=["id"], node_rows=k) for k in (1000, 20))
    assert nodes_of(whole) == nodes_of(levels)
    assert len(nodes_of(whole)) > 40 and max(r[1] for r in nodes_of(whole)) < 2**7


def test_splits_are_the_best_of_all(cube):
    model = forest.fit_forest(cube, CLASSES, trees=3, depth=3, key=["id"], bins=255)
    known = [r for r in cube.select("id", "features", "label", F.xxhash64("id").alias("k")).collect() if r["label"] in CLASSES]
    x, y = np.array([r["features"] for r in known]), np.array([CLASSES.index(r["label"]) for r in known])
    gini = lambda c: 1 - ((c / c.sum()) ** 2).sum()
    for t in range(3):
        w = forest.bag_weights(np.array([r["k"] for r in known]), t, 1)
        own = {n[1]: n for n in nodes_of(model) if n[0] == t}
        counts = lambda at: np.bincount(y[at], weights=w[at], minlength=3)  # noqa: B023, E731
        todo = [(1, np.flatnonzero(w))]
        while todo:
            node, at = todo.pop()
            assert own[node][6] == tuple(counts(at))
            best = 0
            for f in range(6):
                for v in np.unique(x[at, f]):
                    left = at[x[at, f] <= v]
                    rest = np.setdiff1d(at, left)
                    if len(rest) and len(left):
                        best = max(best, gini(counts(at)) - (counts(left).sum() * gini(counts(left)) + counts(rest).sum() * gini(counts(rest))) / counts(at).sum())
            if own[node][2] is None:
                assert node >= 8 or best < 1e-9
                continue
            assert own[node][4] == pytest.approx(best, rel=0.03, abs=1e-3)  # bins leave out a few thresholds
            low = x[at, own[node][2]] <= own[node][3]
            todo += [(2 * node, at[low]), (2 * node + 1, at[~low])]


def test_out_of_bag_votes(cube, spark, monkeypatch):
    model = forest.fit_forest(cube, CLASSES, trees=7, depth=30, key=["id"])
    trees = {t: {n[1]: n for n in nodes_of(model) if n[0] == t} for t in range(7)}
    rows = [r for r in cube.select("id", "features", "label", F.xxhash64("id").alias("k")).collect() if r["label"] in CLASSES]
    right, judged = 0, 0
    for r in rows:
        votes = np.zeros(3)
        for t, own in trees.items():
            if forest.bag_weights(np.array([r["k"]]), t, 1)[0]:
                continue
            node = 1
            while own[node][2] is not None:
                node = 2 * node + int(not r["features"][own[node][2]] <= own[node][3])
            votes += np.array(own[node][6]) / sum(own[node][6])
        if votes.max() > 0:
            judged += 1
            right += CLASSES[int(votes.argmax())] == r["label"]
    assert judged > 300
    monkeypatch.setattr(forest, "SENT", 2000)  # a tree or so at a time
    assert forest.out_of_bag_accuracy(model, cube, CLASSES) == pytest.approx(right / judged)
    assert forest.out_of_bag_accuracy(model, cube, CLASSES) > 0.7


def test_importances_are_those_of_mllib(cube, spark, tmp_path):
    from pyspark.ml.classification import RandomForestClassifier

    data = cube.filter("id < 400").select(array_to_vector("features").alias("features"), (F.col("label") % 5).cast("double").alias("label"))
    theirs = RandomForestClassifier(numTrees=6, maxDepth=5, seed=2).fit(data)
    theirs.write().save(str(tmp_path / "m"))
    saved = spark.read.parquet(str(tmp_path / "m" / "data"))
    if "nodeData" in saved.columns:
        saved = saved.select(F.col("treeID").alias("tree"), "nodeData.*")
    inner = F.col("split.featureIndex") >= 0
    nodes = saved.select("tree", F.when(inner, F.col("split.featureIndex")).alias("feature"), "gain", F.col("rawCount").cast("double").alias("n"))
    got = {r["feature"]: r["importance"] for r in forest.importances(nodes).collect()}
    assert [got.get(i, 0) for i in range(6)] == pytest.approx(theirs.featureImportances.toArray().tolist())


def test_deviation_of_importances(cube, spark):
    model = forest.fit_forest(cube, CLASSES, trees=9, depth=4)
    shares = np.zeros((9, 6))
    for n in nodes_of(model):
        if n[2] is not None:
            shares[n[0], n[2]] += n[4] * n[5]
    shares /= shares.sum(axis=1, keepdims=True)
    got = {r["feature"]: (r["importance"], r["deviation"]) for r in forest.feature_importance(spark, model, list("abcdef")).collect()}
    for i, name in enumerate("abcdef"):
        assert got[name] == pytest.approx((shares[:, i].mean(), shares[:, i].std()), abs=1e-9)


def test_maps_and_saved_models(cube, spark, tmp_path):
    model = forest.fit_forest(cube, CLASSES, trees=20, key=["id"])
    forest.save_model(model, f"file://{tmp_path}/f")
    again = forest.load_model(f"file://{tmp_path}/f")
    one, two = (sorted(map(tuple, forest.predict_map(m, cube, CLASSES, ["id"]).collect())) for m in (model, again))
    assert one == two and len(one) == 403
    assert {v for i, v in one if i < 400 and i % 9 == 0} == {0} and dict(one)[1002] == 0
    truth = {r["id"]: r["label"] for r in cube.collect()}
    assert np.mean([truth[i] == v for i, v in one if v and i < 400]) > 0.95
    assert again.key == ("id",) and forest.out_of_bag_accuracy(again, cube, CLASSES) == forest.out_of_bag_accuracy(model, cube, CLASSES)


def test_forest_without_rows_and_of_one_class(cube):
    with pytest.raises(ValueError, match="no rows"):
        forest.fit_forest(cube.filter("false"), CLASSES, trees=2)
    model = forest.fit_forest(cube.filter("label = 104"), CLASSES, trees=2, node_rows=10)
    assert [r[1:4] for r in nodes_of(model)] == [(1, None, None)] * 2
    assert {r["value"] for r in forest.predict_map(model, cube, CLASSES, ["id"]).collect()} == {0, 104}


def plain_votes(nodes, features, trees):
    """Summed class shares of the leaves that a row reaches."""
    votes = np.zeros(len(CLASSES))
    for t in trees:
        node = 1
        while nodes[t, node][2] is not None:
            node = 2 * node + int(not features[nodes[t, node][2]] <= nodes[t, node][3])
        votes += np.float32(np.array(nodes[t, node][6]) / sum(nodes[t, node][6]))
    return votes


@pytest.fixture
def no_nodes_at_the_driver(monkeypatch):
    """No more than some numbers a tree may come to the driver, and no model may be sent from it; parts are small."""
    from pyspark import SparkContext
    from pyspark.sql.classic.dataframe import DataFrame

    def refused(*_):
        raise AssertionError("the driver takes or sends a model")

    fewer = lambda self, collect=DataFrame.collect: rows if len(rows := collect(self)) <= 6 * 31 else refused()

    def begin():
        for kind, name, f in ((DataFrame, "toArrow", refused), (DataFrame, "toPandas", refused), (SparkContext, "broadcast", refused), (DataFrame, "collect", fewer)):
            monkeypatch.setattr(kind, name, f)
        for name, n in (("SENT", 3000), ("VOTERS", 150), ("SLICE", 40)):
            monkeypatch.setattr(forest, name, n, raising=False)

    yield begin


def test_votes_of_parts_and_chunks_are_those_of_all_trees(cube, no_nodes_at_the_driver, monkeypatch):
    model = forest.fit_forest(cube, CLASSES, trees=7, key=["id"])
    nodes = {r[:2]: r for r in nodes_of(model)}
    data = {r["id"]: r["features"] for r in cube.collect()}
    no_nodes_at_the_driver()
    voted = forest.vote(model, cube, ["id", "label"])
    monkeypatch.undo()
    got = voted.collect()
    assert voted.columns == ["id", "label", "votes", "prediction"] and sorted(r["id"] for r in got) == sorted(data)
    for r in got:
        want = plain_votes(nodes, data[r["id"]], range(7))
        assert r["votes"] == want.tolist() and r["prediction"] == want.argmax()
    assert forest.vote(model, cube.filter("false"), ["id"]).count() == 0


def test_saved_models_vote_without_the_driver(cube, no_nodes_at_the_driver, monkeypatch, tmp_path):
    model = forest.fit_forest(cube, CLASSES, trees=5, key=["id"])
    forest.save_model(model, f"file://{tmp_path}/m")
    again = forest.load_model(f"file://{tmp_path}/m")
    no_nodes_at_the_driver()
    mapped = forest.predict_map(again, cube, CLASSES, ["id"])
    monkeypatch.undo()
    nodes, data = {r[:2]: r for r in nodes_of(model)}, {r["id"]: r for r in cube.collect()}
    for i, value in mapped.collect():
        assert value == (CLASSES[plain_votes(nodes, data[i]["features"], range(5)).argmax()] if data[i]["roi"] == 1 else 0)


@pytest.mark.parametrize("take", [9, 3])
def test_nodes_split_together_are_those_split_one_by_one(take):
    rng = np.random.default_rng(8)
    x = rng.integers(0, 12, (1500, 9)).astype(np.uint8)
    y, w = (x[:, 0] + x[:, 1] + rng.integers(0, 4, 1500)) % 5, rng.integers(1, 5, 1500)
    edges = [np.arange(11) + 0.5] * 9
    batches = list(forest._grow(x, y, w, 2, 1, edges, 5, 12, take, 1))
    got = {r["node"]: r for b in batches for r in b.to_pylist()}
    todo, sizes = [(1, np.arange(1500))], []
    while todo:
        node, at = todo.pop()
        r = got.pop(node)
        assert r["counts"] == np.bincount(y[at], weights=w[at], minlength=5).tolist() and r["n"] == sum(r["counts"])
        split = forest._best(forest._histogram(x[at], y[at], w[at], 12, 5), forest._picked(2, node, 1, 9, take)) if node < 1 << 12 else None
        assert (r["gain"], r["feature"], r["threshold"]) == ((split[0], split[1], edges[0][split[2]]) if split else (None,) * 3)
        if split:
            sizes.append(len(at))
            low = x[at, split[1]] <= split[2]
            todo += [(2 * node, at[low]), (2 * node + 1, at[~low])]
    assert not got and min(sizes) == 2 and max(sizes) > forest.MIDDLE
    assert len([s for s in sizes if s <= forest.SMALL[-1]]) > 100 and len([s for s in sizes if forest.SMALL[-1] < s <= forest.MIDDLE]) > 5


def test_growth_is_dealt_out_by_its_work(cube, monkeypatch):
    """Few bytes are much work: rows that come in one partition are dealt to more."""
    seen = []
    real = forest.checkpointed
    monkeypatch.setattr(forest, "checkpointed", lambda df: seen.append((df.columns, df.rdd.getNumPartitions())) or real(df))
    monkeypatch.setattr(forest, "PAIRS", 1000, raising=False)
    forest.fit_forest(cube.coalesce(1), CLASSES, trees=8, depth=4)
    assert [n for columns, n in seen if "x" in columns][0] >= 3


def test_accuracies_take_no_model_to_the_driver(cube, no_nodes_at_the_driver, monkeypatch):
    model = forest.fit_forest(cube, CLASSES, trees=4, key=["id"])
    monkeypatch.setattr(forest, "fit_forest", lambda *_, **__: model)
    no_nodes_at_the_driver()
    assert forest.out_of_bag_accuracy(model, cube, CLASSES) > 0.6
    assert forest.holdout_accuracy(cube, CLASSES, "id") > 0.8
