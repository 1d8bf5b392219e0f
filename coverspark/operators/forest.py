"""Random forest classification.

Growth is hybrid.  Nodes with many rows are split by levels, from histograms that every partition adds to; once a node
has few enough rows, these are exchanged by tree and node and its subtree is finished in one task, so that neither
histograms nor passes over the data grow with the number of small nodes.  Features are cut to bins at quantiles.

Bagging is by hash: how often a row counts in a tree is a Poisson number (mean 1) made from the row's key and the
tree's number, so that it need not be stored and out-of-bag votes can tell the trees that did not hold a row.

A model is a table of nodes: ``tree, node, feature, threshold, gain, n, counts``.  The children of node i are 2 i (at
most the threshold) and 2 i + 1; leaves have no feature.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from coverspark.sources.pixels import checkpointed, shared_folder

#: Chances that a Poisson number of mean 1 is at most 0, 1, 2, ...
POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)])
NODES = "tree int, node bigint, feature int, threshold double, gain double, n double, counts array<double>"
#: Bytes of histograms in a task, and of the trees that a task votes with.
HISTOGRAMS, SENT = 1 << 28, 1 << 26
#: Pairs of a row and a tree that make a task, rows that a task votes on, and rows that are stored as one.
PAIRS, VOTERS, SLICE = 1 << 21, 1 << 17, 1 << 12
#: Nodes of at most the last of so many rows are split many at a time, filled up to the next of these sizes.
SMALL = (2, 3, 4, 6, 8, 12, 16, 24, 32)
#: Nodes of more rows than those and at most so many have their histograms made and searched several at a time.
MIDDLE = 256


@dataclass
class Forest:
    nodes: DataFrame
    trees: int
    classes: int
    seed: int
    key: tuple[str, ...]

    @property
    def getNumTrees(self) -> int:  # noqa: N802  as Spark's own models have it
        return self.trees


def training_set(px: DataFrame, label: str = "land_cover", train: str = "is_train") -> DataFrame:
    """Vectors (column ``features``) and labels of the pixels that train."""
    return px.filter((F.col(train) == 1) & F.col(label).isNotNull()).select("features", F.col(label).alias("label"))


def _index(classes: Sequence[int], label: str) -> Column:
    table = F.create_map(*[F.lit(x) for i, c in enumerate(classes) for x in (c, i)])
    return F.try_element_at(table, F.col(label).cast("int"))


def _values(df: DataFrame) -> Column:
    """The features as an array, from vectors or arrays."""
    return F.col("features").cast("array<double>") if df.schema["features"].dataType.typeName() == "array" else vector_to_array("features")


def _row_key(df: DataFrame, key: Sequence[str]) -> Column:
    return F.xxhash64(*key) if key else F.xxhash64(_values(df), "label")


def _mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def bag_weights(keys: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often rows of these keys (64 bits) count in a tree."""
    own = _mixed(np.array([(seed << 32) + tree + 1], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return np.searchsorted(POISSON, (_mixed(keys.astype(np.uint64) ^ own) >> np.uint64(11)) * 2.0**-53, side="right")


def _histogram(x: np.ndarray, y: np.ndarray, w: np.ndarray, bins: int, classes: int) -> np.ndarray:
    """Weight by class, bin and feature."""
    width, out = x.shape[1], 0
    for at in range(0, max(1, len(y)), 4096):  # so that what is made on the way stays small
        some = slice(at, at + 4096)
        cell = (x[some] + np.multiply(y[some], bins, dtype=np.int64)[:, None]) * width + np.arange(width)
        out = out + np.bincount(cell.ravel(), weights=np.repeat(w[some], width), minlength=width * bins * classes)
    return out.reshape(classes, bins, width)


def _best(h: np.ndarray, allowed: np.ndarray | None = None) -> tuple[float, int, int, np.ndarray] | None:
    """Gain (of the Gini impurity), feature, last bin to the left and its class weights; None if no split gains."""
    counts = h[:, :, 0].sum(axis=1)
    n, left = counts.sum(), np.array(h[:, :-1])
    for b in range(1, left.shape[1]):
        np.add(left[:, b], left[:, b - 1], out=left[:, b])
    nl, shared = left.sum(axis=0), (counts @ left.reshape(len(left), -1)).reshape(left.shape[1:])  # whole numbers: exact in any order
    squares, whole = (left * left).sum(axis=0), counts @ counts
    ok = (nl > 0) & (nl < n)
    with np.errstate(divide="ignore", invalid="ignore"):
        score = squares / nl + (whole - 2 * shared + squares) / (n - nl)
    gain = np.where(ok if allowed is None else ok & allowed, score / n - whole / n**2, -1.0).T
    f, b = divmod(int(gain.argmax()), gain.shape[1])
    return (float(gain[f, b]), f, b, left[:, b, f]) if gain[f, b] > 1e-12 else None


def _picked(tree: int, node: int, seed: int, width: int, take: int) -> np.ndarray | None:
    """The features that a node may be split by."""
    if take >= width:
        return None
    out = np.zeros(width, dtype=bool)
    out[np.random.default_rng([seed, tree, node]).choice(width, take, replace=False)] = True
    return out


def _best_of_each(h: np.ndarray, allowed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gain, feature and last bin to the left for each of several histograms; the gain is -1 where no split gains."""
    counts, left = h[:, :, :, 0].sum(axis=2), np.array(h[:, :, :-1])
    for b in range(1, left.shape[2]):
        np.add(left[:, :, b], left[:, :, b - 1], out=left[:, :, b])
    nl, shared = left.sum(axis=1), (counts[:, None] @ left.reshape(*counts.shape, -1)).reshape(len(h), *left.shape[2:])
    squares = np.square(left, out=left).sum(axis=1)
    n, whole = (a.sum(axis=1)[:, None, None] for a in (counts, counts * counts))
    with np.errstate(divide="ignore", invalid="ignore"):
        score = squares / nl + (whole - 2 * shared + squares) / (n - nl)
    gain = np.where((nl > 0) & (nl < n), score / n - whole / n**2, -1.0)
    most, each = gain.max(axis=1), np.arange(len(h))
    most = most if allowed is None else np.where(allowed, most, -1.0)
    feature = most.argmax(axis=1)
    best = most[each, feature]
    return np.where(best > 1e-12, best, -1.0), feature, (gain[each, :, feature] == best[:, None]).argmax(axis=1)


def _best_of_small(x: np.ndarray, y: np.ndarray, w: np.ndarray, classes: int, allowed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gain, feature and last bin to the left of many nodes of few rows each; the gain is -1 where no split gains.

    ``x`` is by node, row and feature (255 in rows that only fill up), ``y`` and ``w`` by node and row.  Only bins that
    rows have are tried, which are the first of those that part the rows alike.  Weights and their squares are whole
    numbers that 32-bit floats hold, so gains are exactly those of ``_best``.
    """
    nodes, size, width = x.shape
    own = np.zeros((nodes, classes + 2, size), dtype=np.float32)
    own[np.arange(nodes)[:, None], y, np.arange(size)] = w
    counts = own[:, :classes].sum(axis=2)
    own[:, classes], own[:, classes + 1] = w, w * np.take_along_axis(counts, y, axis=1)
    low = (x[:, :, None, :] <= x[:, None, :, :]).astype(np.float32).reshape(nodes, size, size * width)
    left = own @ low
    nl, shared = left[:, classes].astype(np.float64), left[:, classes + 1].astype(np.float64)
    squares = np.square(left[:, :classes]).sum(axis=1).astype(np.float64)
    n, whole = (a.sum(axis=1, dtype=np.float64)[:, None] for a in (counts, counts * counts))
    with np.errstate(divide="ignore", invalid="ignore"):
        score = squares / nl + (whole - 2 * shared + squares) / (n - nl)
    gain = np.where((nl > 0) & (nl < n), score / n - whole / n**2, -1.0).reshape(nodes, size, width)
    most, each = gain.max(axis=1), np.arange(nodes)
    most = most if allowed is None else np.where(allowed, most, -1.0)
    feature = most.argmax(axis=1)
    best = most[each, feature]
    alike = gain[each, :, feature] == best[:, None]
    return np.where(best > 1e-12, best, -1.0), feature, np.where(alike, x[each, :, feature], 255).min(axis=1)


def _parted(x: np.ndarray, counts: np.ndarray, starts: np.ndarray, allowed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gain, feature and last bin to the left of nodes with two classes that some feature parts; -1 as gain of the others.

    ``x`` has the rows by node and class, ``starts`` where those begin.  No split gains more than one that parts the classes.
    """
    low, high = (f.reduceat(x, starts, axis=0).reshape(-1, 2, x.shape[1]) for f in (np.minimum, np.maximum))
    parts = (high[:, 0] < low[:, 1]) | (high[:, 1] < low[:, 0])
    if allowed is not None:
        parts &= allowed
    feature, n = parts.argmax(axis=1), counts.sum(axis=1)
    gain = n / n - (counts * counts).sum(axis=1) / n**2
    each = np.arange(len(feature))
    return np.where(parts[each, feature], gain, -1.0), feature, high.min(axis=1)[each, feature]


def _grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, tree: int, root: int, edges: list[np.ndarray], classes: int, depth: int, take: int, seed: int) -> Iterator[pa.RecordBatch]:
    """The nodes of the subtree at ``root``, level by level; of each level the small nodes are split together."""
    width, bins = len(edges), max(map(len, edges)) + 1
    border = np.zeros((width, bins))
    for f, e in enumerate(edges):
        border[f, : len(e)] = e
    w = w.astype(np.float64)
    node, rows, ends = np.array([root], dtype=np.int64), np.arange(len(y)), np.array([len(y)])
    while len(node):
        starts = np.append(0, ends[:-1])
        size, of = ends - starts, np.repeat(np.arange(len(node)), ends - starts)
        counts = np.bincount(of * classes + y[rows], weights=w[rows], minlength=len(node) * classes).reshape(-1, classes)
        present = (counts > 0).sum(axis=1)
        gain, feature, last = np.full(len(node), -1.0), np.zeros(len(node), dtype=np.int64), np.zeros(len(node), dtype=np.int64)
        open_ = (present > 1) & (node < 1 << depth) & (bins > 1)
        may = lambda some: None if take >= width else np.array([_picked(tree, int(k), seed, width, take) for k in node[some]])  # noqa: B023, E731
        two = np.flatnonzero(open_ & (present == 2))
        if len(two):
            its = rows[(open_ & (present == 2))[of]]
            kind = np.repeat(np.arange(len(two)), size[two]) * classes + y[its]
            begins = np.append(0, np.cumsum(np.bincount(kind, minlength=len(two) * classes)))[:-1].reshape(len(two), classes)
            gain[two], feature[two], last[two] = _parted(x[its[np.argsort(kind, kind="stable")]], counts[two], begins[counts[two] > 0], may(two))
            open_ &= gain < 0
        for k in np.flatnonzero(open_ & (size > MIDDLE)):
            at, some = rows[starts[k] : ends[k]], np.flatnonzero(counts[k])
            split = _best(_histogram(x[at], np.searchsorted(some, y[at]), w[at], bins, len(some)), _picked(tree, int(node[k]), seed, width, take))
            if split is not None:
                gain[k], feature[k], last[k] = split[:3]
        place = np.searchsorted(SMALL, size) * 4 + np.searchsorted((2, 4, 8), present)
        place = np.where(open_ & (size <= SMALL[-1]), place, -1)
        rank = np.cumsum(counts > 0, axis=1) - 1  # the number of a class among those that a node has
        every = np.flatnonzero(open_ & (size > SMALL[-1]) & (size <= MIDDLE))
        every = every[np.argsort(present[every], kind="stable")]
        step = max(1, (1 << 17) // (classes * bins * width))
        for few in (every[i : i + step] for i in range(0, len(every), step)):
            at, own, most = np.concatenate([rows[starts[k] : ends[k]] for k in few]), np.repeat(np.arange(len(few)), size[few]), int(present[few].max())
            cell = (((own * most + rank[few[own], y[at]]) * bins)[:, None] + x[at]) * width + np.arange(width)
            h = np.bincount(cell.ravel(), weights=np.repeat(w[at], width), minlength=len(few) * most * bins * width).reshape(len(few), most, bins, width)
            gain[few], feature[few], last[few] = _best_of_each(h, may(few))
        for p in np.unique(place[place >= 0]):
            every, most = np.flatnonzero(place == p), SMALL[p // 4]
            step = max(1, (1 << 18) // (width * most * most))
            for few in (every[i : i + step] for i in range(0, len(every), step)):
                slot = starts[few, None] + np.arange(most)
                filled = slot < ends[few, None]
                at = rows[np.where(filled, slot, 0)]
                bag = np.where(filled[:, :, None], x[at], np.uint8(255))
                kind = np.where(filled, np.take_along_axis(rank[few], y[at], axis=1), 0)
                gain[few], feature[few], last[few] = _best_of_small(bag, kind, np.where(filled, w[at], 0.0), int(present[few].max()), may(few))
        inner = gain >= 0
        yield _node_batch(tree, node, inner, feature, border[feature, last], gain, counts)
        keep = inner[of]
        right = (x[rows[keep], feature[of[keep]]] > last[of[keep]]).astype(np.int64)
        child = 2 * (np.cumsum(inner) - 1)[of[keep]] + right
        rows = rows[keep][np.argsort(child, kind="stable")]
        ends = np.cumsum(np.bincount(child, minlength=2 * int(inner.sum())))
        node = (2 * node[inner][:, None] + np.arange(2)).ravel()


def _node_batch(tree: int, node: np.ndarray, inner: np.ndarray, feature: np.ndarray, threshold: np.ndarray, gain: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """Nodes of a tree; feature, threshold and gain are null where not ``inner``."""
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, counts.size + 1, counts.shape[1]), pa.int32()), pa.array(counts.ravel()))
    columns = [pa.array(np.full(len(node), tree), pa.int32()), pa.array(node, pa.int64()), pa.array(feature, pa.int32(), mask=~inner), pa.array(threshold, mask=~inner), pa.array(gain, mask=~inner), pa.array(counts.sum(axis=1)), lists]
    return pa.RecordBatch.from_arrays(columns, ["tree", "node", "feature", "threshold", "gain", "n", "counts"])


def _unpacked(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
    """The rows' bins, one byte each."""
    data = b"".join(batch["x"].to_pylist())
    return np.frombuffer(data, dtype=np.uint8).reshape(batch.num_rows, -1)


def _routed(x: np.ndarray, tops: dict[int, tuple[int, int]]) -> np.ndarray:
    """The node that each row reaches in one tree's top (node to feature and bin)."""
    at = np.ones(len(x), dtype=np.int64)
    inner = np.array(sorted(tops), dtype=np.int64)
    if not len(inner):
        return at
    feature, limit = np.array([tops[i] for i in inner.tolist()]).T
    moving = np.arange(len(x))
    while len(moving):
        place = np.minimum(np.searchsorted(inner, at[moving]), len(inner) - 1)
        on = inner[place] == at[moving]
        moving, place = moving[on], place[on]
        at[moving] = 2 * at[moving] + (x[moving, feature[place]] > limit[place])
    return at


def _edges(rows: DataFrame, width: int, bins: int) -> list[np.ndarray]:
    """Borders between neighbouring quantiles of each feature."""
    at = F.array(*[F.lit(i / bins) for i in range(bins + 1)])
    found = rows.agg(*[F.percentile_approx(F.when(~F.isnan(F.element_at("values", i + 1)), F.element_at("values", i + 1)), at, 10_000).alias(f"f{i}") for i in range(width)]).first()
    distinct = [np.unique(np.array(q if q else [0.0], dtype=np.float64)) for q in found]
    return [(q[:-1] + q[1:]) / 2 for q in distinct]


def _top_levels(data: DataFrame, trees: int, n: int, edges: list[np.ndarray], classes: int, depth: int, take: int, seed: int, node_rows: int) -> tuple[list[tuple], dict[int, dict[int, tuple[int, int]]], dict[int, set[int]]]:
    """The nodes with more than ``node_rows`` rows, level by level, how they are split, and which of them are leaves.  Only splits reach the driver."""
    spark, width, bins = data.sparkSession, len(edges), max(map(len, edges)) + 1
    tops: dict[int, dict[int, tuple[int, int]]] = {t: {} for t in range(trees)}
    closed: dict[int, set[int]] = {t: set() for t in range(trees)}
    rows: list[tuple] = []
    active = [(t, 1) for t in range(trees)] if n > node_rows else []
    per_job = max(1, HISTOGRAMS // (8 * width * bins * classes))
    part = max(1, (1 << 16) // (bins * classes))  # features of a row of histograms
    while active:
        following = []
        for some in (active[i : i + per_job] for i in range(0, len(active), per_job)):
            wanted: dict[int, list[int]] = {}
            for t, node in some:
                wanted.setdefault(t, []).append(node)
            shared = spark.sparkContext.broadcast((wanted, {t: tops[t] for t in wanted}))

            def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                nodes_of, tops_of = shared.value  # noqa: B023
                sums: dict[tuple[int, int], np.ndarray] = {}
                for batch in batches:
                    x, y, keys = _unpacked(batch), batch["label"].to_numpy(), batch["key"].to_numpy()
                    for t, nodes in nodes_of.items():
                        w, at = bag_weights(keys, t, seed), _routed(x, tops_of[t])
                        for node in nodes:
                            own = np.flatnonzero((at == node) & (w > 0))
                            if len(own):
                                h = _histogram(x[own], y[own], w[own], bins, classes)
                                sums[t, node] = sums[t, node] + h if (t, node) in sums else h
                for (t, node), h in sums.items():
                    for first in range(0, width, part):
                        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in ((t, pa.int32()), (node, pa.int64()), (first, pa.int32()), (h[:, :, first : first + part].tobytes(), pa.binary()))], ["tree", "node", "first", "h"])

            def chosen(table: pa.Table) -> pa.Table:
                t, node, first = (table[c][0].as_py() for c in ("tree", "node", "first"))
                h = sum(np.frombuffer(b.as_buffer(), dtype=np.float64) for b in table["h"]).reshape(classes, bins, -1)
                allowed = _picked(t, node, seed, width, take)
                split = _best(h, None if allowed is None else allowed[first : first + part]) or (0.0, 0, 0, np.zeros(classes))
                return pa.table({"tree": pa.array([t], pa.int32()), "node": [node], "gain": [split[0]], "feature": pa.array([first + split[1]], pa.int32()), "bin": pa.array([split[2]], pa.int32()), "left": [split[3].tolist()], "counts": [h[:, :, 0].sum(axis=1).tolist()]})

            partial = data.mapInArrow(added, "tree int, node bigint, first int, h binary")
            found = partial.groupBy("tree", "node", "first").applyInArrow(chosen, "tree int, node bigint, gain double, feature int, bin int, left array<double>, counts array<double>")
            best = found.groupBy("tree", "node").agg(F.max_by(F.struct("gain", "feature", "bin", "left", "counts"), F.struct("gain", -F.col("feature"))).alias("b"))
            for r in best.orderBy("tree", "node").collect():
                t, node, b = r["tree"], r["node"], r["b"]
                total = sum(b["counts"])
                if b["gain"] <= 0 or node.bit_length() > depth:
                    closed[t].add(node)
                    rows.append((t, node, None, None, None, total, list(b["counts"])))
                    continue
                tops[t][node] = (b["feature"], b["bin"])
                rows.append((t, node, b["feature"], float(edges[b["feature"]][b["bin"]]), b["gain"], total, list(b["counts"])))
                left = sum(b["left"])
                following += [(t, child) for child, k in ((2 * node, left), (2 * node + 1, total - left)) if k > node_rows]
        active = following
    return rows, tops, closed


def fit_forest(
    df: DataFrame, classes: Sequence[int], trees: int = 250, depth: int = 30, strategy: str = "all", seed: int = 1, key: Sequence[str] = (), bins: int = 32, node_rows: int = 1 << 19
) -> Forest:
    """A forest on ``features`` and ``label`` (codes in ``classes``, given a fixed index; other labels do not train).

    ``strategy``: features tried at a node: all, sqrt, log2 or onethird.  ``key``: columns that tell rows apart for
    bagging; without them rows of equal features and label share their weights.  Features are cut to ``bins`` (255 at
    most) by their quantiles; NaN lies above all numbers.  Nodes of up to ``node_rows`` rows are finished in one task.
    """
    spark = df.sparkSession
    known = df.withColumn("label", _index(classes, "label")).filter("label is not null")
    rows = checkpointed(known.select(_row_key(known, key).alias("key"), "label", _values(known).alias("values")))
    n, width = rows.agg(F.count("*"), F.max(F.size("values"))).first()
    if not n:
        raise ValueError("no rows to train on")
    take = {"all": width, "sqrt": round(width**0.5), "log2": int(math.log2(width)), "onethird": width // 3}[strategy] or 1
    edges, k = _edges(rows, width, min(bins, 255)), len(classes)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch["values"].to_pylist(), dtype=np.float64).reshape(batch.num_rows, width)
            binned = np.column_stack([np.searchsorted(e, x[:, i]) for i, e in enumerate(edges)]).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch["key"], batch["label"], pa.array([b.tobytes() for b in binned], pa.binary())], ["key", "label", "x"])

    wide = max(rows.rdd.getNumPartitions(), min(math.ceil(n * trees / PAIRS), 3 * spark.sparkContext.defaultParallelism))
    data = checkpointed(rows.repartition(wide).mapInArrow(cut, "key bigint, label int, x binary"))
    top, tops, closed = _top_levels(data, trees, n, edges, k, depth, take, seed, node_rows)
    shared = spark.sparkContext.broadcast((tops, closed))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, keys = _unpacked(batch), batch["label"].to_numpy().astype(np.int32), batch["key"].to_numpy()
            for t in range(trees):
                w = bag_weights(keys, t, seed)
                own = np.flatnonzero(w)
                node = _routed(x[own], shared.value[0][t])
                open_ = ~np.isin(node, list(shared.value[1][t]))
                own, node = own[open_], node[open_]
                own = own[np.argsort(node, kind="stable")]
                reached, sizes = np.unique(node, return_counts=True)
                parts = [own[e - n : e] for e, n in zip(np.cumsum(sizes), sizes, strict=True)]
                packed = [[a[at].tobytes() for at in parts] for a in (y, w.astype(np.uint8), x)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(parts), t), pa.int32()), pa.array(reached, pa.int64()), *[pa.array(p, pa.binary()) for p in packed]], ["tree", "node", "label", "w", "x"])

    def finished(table: pa.Table) -> pa.Table:
        t, node = table["tree"][0].as_py(), table["node"][0].as_py()
        y, w, x = (np.frombuffer(b"".join(table[c].to_pylist()), dtype=kind) for c, kind in (("label", np.int32), ("w", np.uint8), ("x", np.uint8)))
        return pa.Table.from_batches(_grow(x.reshape(len(y), width), y, w, t, node, edges, k, depth, take, seed))

    # a tree is much work from few bytes, by which Spark would deal it out
    tasks = max(min(trees, math.ceil(n * trees * 64 / PAIRS)), math.ceil(n * trees / 2 / PAIRS))
    parts = data.mapInArrow(dealt, "tree int, node bigint, label binary, w binary, x binary").repartition(tasks, "tree", "node")
    grown = parts.groupBy("tree", "node").applyInArrow(finished, NODES)
    path = shared_folder(spark)
    (spark.createDataFrame(top, NODES).unionByName(grown) if top else grown).write.parquet(path)
    return Forest(spark.read.parquet(path), trees, k, seed, tuple(key))


PACKED = "tree int, part int, feature binary, bin binary, next binary, shares binary"


def _packed(table: pa.Table, borders: dict[int, np.ndarray], part_of: dict[int, int]) -> pa.Table:
    """A tree in one row, its root first: by node the feature (-1: leaf), the number of its threshold among the
    feature's, the place of the left child or of the leaf's class shares, and all the different class shares."""
    table = table.sort_by("node")
    tree, node, feature = table["tree"][0].as_py(), table["node"].to_numpy(), table["feature"].fill_null(-1).to_numpy()
    limit, bin_ = table["threshold"].fill_null(0.0).to_numpy(), np.zeros(len(node), dtype=np.int64)
    for f in np.unique(feature[feature >= 0]):
        at = np.flatnonzero(feature == f)
        bin_[at] = np.searchsorted(borders[int(f)], limit[at])
    counts = np.asarray(table["counts"].combine_chunks().flatten()).reshape(len(node), -1)[feature < 0]
    shares, which = np.unique((counts / counts.sum(axis=1, keepdims=True)).astype(np.float32), axis=0, return_inverse=True)
    following = np.searchsorted(node, 2 * node)
    following[feature < 0] = which.ravel()
    packed = [a.astype(kind).tobytes() for a, kind in ((feature, np.int32), (bin_, _code(borders)), (following, np.int32), (shares, np.float32))]
    columns = [pa.array([v], pa.int32()) for v in (tree, part_of[tree])] + [pa.array([b], pa.binary()) for b in packed]
    return pa.table(dict(zip(["tree", "part", "feature", "bin", "next", "shares"], columns, strict=True)))


def _code(borders: dict[int, np.ndarray]) -> np.dtype:
    return np.min_scalar_type(max(map(len, borders.values()), default=0))


def _leaf(x: np.ndarray, feature: np.ndarray, last: np.ndarray, following: np.ndarray) -> np.ndarray:
    """The place of the class shares that each row reaches."""
    at = np.zeros(len(x), dtype=np.int64)
    moving = np.flatnonzero(feature[at] >= 0)
    while len(moving):
        here = at[moving]
        at[moving] = following[here] + (x[moving, feature[here]] > last[here])  # of siblings the right one follows the left
        moving = moving[feature[at[moving]] >= 0]
    return following[at]


def vote(model: Forest, df: DataFrame, keep: Sequence[str], out_of_bag: bool = False) -> DataFrame:
    """The columns ``keep`` with votes (summed class shares of the trees' leaves) and prediction (index; null without votes).

    ``out_of_bag``: only trees count that a row was not in, by its key; df then needs what the fit had, label included.
    Chunks of rows, their features as numbers of the model's thresholds, meet parts of the trees in an exchange; both
    are of bounded size, and neither passes the driver, which only gets the thresholds and the sizes of the trees.
    """
    nodes, seed, classes = model.nodes, model.seed, model.classes
    found: dict[int, list[float]] = {}
    for r in nodes.filter("feature is not null").select("feature", "threshold").distinct().collect():
        found.setdefault(r["feature"], []).append(r["threshold"])
    borders = {f: np.sort(np.array(v)) for f, v in found.items()}
    code = _code(borders)
    bag = _row_key(df, model.key) if out_of_bag else F.lit(0).cast("bigint")
    rows = df.select(F.struct(*keep).alias("row"), bag.alias("key"), _values(df).alias("values"))
    row = rows.schema["row"].dataType

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for whole in batches:
            for batch in (whole.slice(i, SLICE) for i in range(0, whole.num_rows, SLICE)):
                values = np.array(batch["values"].to_pylist(), dtype=np.float64).reshape(batch.num_rows, -1)
                x = np.zeros(values.shape, dtype=code)
                for f, b in borders.items():
                    x[:, f] = np.searchsorted(b, values[:, f])
                held = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), pa.concat_arrays([batch["row"]]))
                columns = [pa.array([number]), pa.array([batch.num_rows]), held, pa.array([batch["key"].to_numpy().tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["slice", "n", "rows", "key", "x"])
                number += 1

    slices = checkpointed(rows.mapInArrow(sliced, StructType().add("slice", "long").add("n", "long").add("rows", ArrayType(row)).add("key", "binary").add("x", "binary")))
    n = slices.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    chunks = max(1, math.ceil(n / VOTERS))
    # trees of a part: what fits a task, and work for one
    sizes, part_of, part, held, trees = {r["tree"]: r["count"] for r in nodes.groupBy("tree").count().collect()}, {}, 0, 0, 0
    for t in sorted(sizes):
        size = sizes[t] * (8 + code.itemsize)
        if trees and (held + size > SENT or (trees + 1) * n > PAIRS * chunks):
            part, held, trees = part + 1, 0, 0
        part_of[t], held, trees = part, held + size, trees + 1
    packed = checkpointed(nodes.groupBy("tree").applyInArrow(lambda table: _packed(table, borders, part_of), PACKED))

    def voted(rows: pa.Table, trees: pa.Table) -> pa.Table:
        out, shape = [], lambda i: (rows["n"][i].as_py(), -1)
        if rows.num_rows:
            x = np.concatenate([np.frombuffer(b.as_buffer(), dtype=code).reshape(shape(i)) for i, b in enumerate(rows["x"])])
            keys = np.concatenate([np.frombuffer(b.as_buffer(), dtype=np.int64) for b in rows["key"]])
            votes = np.zeros((len(x), classes))
            for tree in trees.to_batches(max_chunksize=1):
                feature, last, following, shares = (np.frombuffer(tree[c][0].as_buffer(), dtype=kind) for c, kind in (("feature", np.int32), ("bin", code), ("next", np.int32), ("shares", np.float32)))
                add = shares.reshape(-1, classes)[_leaf(x, feature, last, following)]
                votes += add * (bag_weights(keys, tree["tree"][0].as_py(), seed) == 0)[:, None] if out_of_bag else add
            out = [v.tobytes() for v in np.split(votes, np.cumsum(rows["n"].to_numpy())[:-1])]
        return pa.table({"slice": rows["slice"], "votes": pa.array(out, pa.binary())})

    def added(rows: pa.Table, votes: pa.Table) -> pa.Table:
        total = np.zeros((rows["n"][0].as_py(), classes))
        for v in votes["votes"]:
            total += np.frombuffer(v.as_buffer(), dtype=np.float64).reshape(total.shape)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, total.size + 1, classes), pa.int32()), pa.array(total.ravel()))
        return pa.table({"row": pa.concat_arrays([c.flatten() for c in rows["rows"].chunks]), "votes": lists})

    met = slices.select(F.pmod(F.xxhash64("slice"), F.lit(chunks)).cast("int").alias("chunk"), "slice", "n", "key", "x", F.explode(F.sequence(F.lit(0), F.lit(part))).alias("part"))
    sent = packed.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    each = met.groupBy("part", "chunk").cogroup(sent.groupBy("part", "chunk")).applyInArrow(voted, "slice bigint, votes binary")
    kind = StructType().add("row", row).add("votes", ArrayType(DoubleType()))
    rows = slices.select("slice", "n", "rows").groupBy("slice").cogroup(each.groupBy("slice")).applyInArrow(added, kind)
    found = F.array_position("votes", F.array_max("votes")).cast("int") - 1
    own = [F.col("row").getField(f.name).alias(f.name) for f in row.fields]
    return rows.select(*own, "votes", F.when(F.array_max("votes") > 0, found).alias("prediction"))


def _accuracy(voted: DataFrame) -> float:
    return voted.filter("prediction is not null").agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]


def holdout_accuracy(df: DataFrame, classes: Sequence[int], key: str, share: float = 0.2, **options) -> float:
    """Accuracy on a share of the rows, by hash of their key, that the forest does not see."""
    at = F.pmod(F.xxhash64(key), F.lit(1000)) < int(share * 1000)
    model = fit_forest(df.filter(~at), classes, **options)
    return _accuracy(vote(model, df.filter(at).withColumn("label", _index(classes, "label")), ["label"]))


def out_of_bag_accuracy(model: Forest, df: DataFrame, classes: Sequence[int]) -> float:
    """Accuracy on the rows of the fit, each voted on by the trees that did not hold it; rows in all trees do not count."""
    known = df.withColumn("label", _index(classes, "label")).filter("label is not null")
    return _accuracy(vote(model, known, ["label"], out_of_bag=True))


def tree_importances(nodes: DataFrame) -> DataFrame:
    """tree, feature (number), importance: the share of the tree's weighted gain that splits by the feature have."""
    gains = nodes.filter("feature is not null").groupBy("tree", "feature").agg(F.sum(F.col("gain") * F.col("n")).alias("g"))
    totals = gains.groupBy("tree").agg(F.sum("g").alias("t")).filter("t > 0")
    return gains.join(totals, "tree").select("tree", "feature", (F.col("g") / F.col("t")).alias("importance"))


def importances(nodes: DataFrame) -> DataFrame:
    """feature (number), importance (mean over the trees that split, sums to 1) and deviation over them."""
    each = tree_importances(nodes)
    trees = each.agg(F.count_distinct("tree").cast("double").alias("trees"))
    sums = each.groupBy("feature").agg(F.sum("importance").alias("s"), F.sum(F.col("importance") ** 2).alias("q")).crossJoin(F.broadcast(trees))
    mean = F.col("s") / F.col("trees")
    return sums.select("feature", mean.alias("importance"), F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.col("trees") - mean**2)).alias("deviation"))


def feature_importance(spark: SparkSession, model: Forest, names: Sequence[str]) -> DataFrame:
    """A row per feature, the most important first, with the deviation of its importance over the trees."""
    listed = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, feature string")
    found = importances(model.nodes).withColumnRenamed("feature", "i")
    number = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return F.broadcast(listed).join(found, "i", "left").select("feature", number("importance"), number("deviation")).orderBy(F.desc("importance"), "feature")


def importance_by_period(frames: dict[str, DataFrame]) -> DataFrame:
    """Importances of several periods side by side."""
    out = None
    for name, df in frames.items():
        one = df.select("feature", F.col("importance").alias(name))
        out = one if out is None else out.join(one, "feature", "full")
    return out


def predict_map(model: Forest, px: DataFrame, classes: Sequence[int], keys: Sequence[str], roi: str = "roi") -> DataFrame:
    """Predicted codes; 0 outside the region of interest, which is not scored."""
    codes = F.array(*map(F.lit, classes))
    inside = vote(model, px.filter(F.col(roi) == 1), keys).select(*keys, F.element_at(codes, F.col("prediction") + 1).alias("value"))
    return inside.unionByName(px.filter((F.col(roi) != 1) | F.col(roi).isNull()).select(*keys, F.lit(0).alias("value")))


def save_model(model: Forest, path: str) -> None:
    """The nodes as Parquet, and the numbers that a vote needs beside them; what was there is replaced."""
    model.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    about = [(model.trees, model.classes, model.seed, list(model.key))]
    model.nodes.sparkSession.createDataFrame(about, "trees int, classes int, seed bigint, key array<string>").coalesce(1).write.mode("overwrite").parquet(f"{path}/about")


def load_model(path: str) -> Forest:
    spark = SparkSession.active()
    about = spark.read.parquet(f"{path}/about").first()
    return Forest(spark.read.parquet(f"{path}/nodes"), about["trees"], about["classes"], about["seed"], tuple(about["key"]))
