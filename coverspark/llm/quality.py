"""Quality classifier: random-indexing word vectors pooled per document and a small calibrated network.

Words and their shapes (runs of lower case, upper case and digits shortened to one sign) are hashed to a fixed number
of rows, so the vector table has the same size for any corpus: of n distinct words, a word shares its row with n / ROWS
others on average.  Over all documents, each row sums the sparse random
index vectors of its neighbours.  A document is the mean of its words' and of its shapes' vectors.  A two-layer
network, fitted on a bounded sample of labelled rows, turns that into a probability, which a temperature calibrates.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coverspark.llm.common import text_of, tidy

ROWS, SHAPES, DIMS, NONZERO, WINDOW = 1 << 16, 1 << 12, 32, 4, 2
ALL = ROWS + SHAPES
_POWERS = np.cumprod(np.full(256, 0x9E3779B97F4A7C15, dtype=np.uint64))
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[ord("a") : ord("z") + 1] = ord("a")
_SHAPE[128:] = ord("a")
_SHAPE[ord("A") : ord("Z") + 1] = ord("A")
_SHAPE[ord("0") : ord("9") + 1] = ord("0")


def _rows(values: np.ndarray, place: np.ndarray, starts: np.ndarray, rows: int) -> np.ndarray:
    terms = values.astype(np.uint64) * _POWERS[place & 255]
    sums = np.add.reduceat(terms, starts)
    return ((sums ^ (sums >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(65 - rows.bit_length())).astype(np.int64)


def tokens(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the words and of their shapes, and the words' starts, for UTF-8 bytes with white space between words."""
    solid = data > 32
    edge = np.diff(np.concatenate([[0], solid.view(np.int8)]))
    starts = np.flatnonzero(edge == 1)
    if not len(starts):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    body = np.flatnonzero(solid)
    sizes = np.diff(np.append(np.flatnonzero(np.isin(body, starts, assume_unique=True)), len(body)))
    first = np.cumsum(sizes) - sizes
    words = _rows(data[body], np.arange(len(body)) - np.repeat(first, sizes), first, ROWS)
    kinds = _SHAPE[data[body]]
    new = np.empty(len(body), dtype=bool)
    new[0], new[1:] = True, kinds[1:] != kinds[:-1]
    new[first] = True
    place = np.cumsum(new)
    counts = np.add.reduceat(new.astype(np.int64), first)
    kept = kinds[new]
    begin = np.cumsum(counts) - counts
    shapes = _rows(kept, place[new] - 1 - np.repeat(begin, counts), begin, SHAPES)
    return words, shapes + ROWS, starts


def _batches(texts: pa.Array, most: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """Words, shapes, each word's document and the number of documents, for runs of about ``most`` bytes."""
    held: list[bytes] = []
    size = 0

    def made() -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        ends = np.cumsum([len(t) + 1 for t in held])
        words, shapes, starts = tokens(np.frombuffer(b"\n".join(held), dtype=np.uint8))
        return words, shapes, np.searchsorted(ends, starts, side="right"), len(held)

    for t in texts:
        held.append(t.as_buffer().to_pybytes())
        size += len(held[-1])
        if size >= most:
            yield made()
            held, size = [], 0
    if held:
        yield made()


def index_vectors(seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """For every row the places and the signs of its index vector's few values."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, DIMS, (ALL, NONZERO)), rng.choice([-1.0, 1.0], (ALL, NONZERO))


def word_vectors(docs: DataFrame, text_col: str = "text", blocks: int = 64) -> np.ndarray:
    """The table of context sums over all documents, rows scaled to length one.  Its size does not depend on them.

    What is summed are whole numbers, which doubles hold exactly, so the order in which parts arrive changes nothing.
    """
    per = ALL // blocks

    @tidy
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = index_vectors()
        total = np.zeros(ALL * DIMS)
        for batch in batches:
            for words, shapes, doc, _ in _batches(batch.column(0)):
                for seq in (words, shapes):
                    for step in range(1, WINDOW + 1):
                        same = doc[step:] == doc[:-step]
                        a, b = seq[:-step][same], seq[step:][same]
                        for x, y in ((a, b), (b, a)):
                            for k in range(NONZERO):
                                np.add.at(total, x * DIMS + places[y, k], signs[y, k])
        parts = total.astype("<f4").reshape(blocks, per * DIMS)
        used = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([parts[u].tobytes() for u in used], pa.binary())], ["block", "part"])

    @tidy
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, part in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held[b] = held.get(b, 0) + np.frombuffer(part.as_buffer(), dtype="<f4").astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v.astype("<f4").tobytes() for v in held.values()], pa.binary())], ["block", "part"])

    parts = docs.select(text_of(text_col).alias("text")).mapInArrow(sums, "block int, part binary")
    out = np.zeros((blocks, per * DIMS), dtype=np.float32)
    for r in parts.repartition("block").mapInArrow(gather, "block int, part binary").collect():
        out[r["block"]] = np.frombuffer(r["part"], dtype="<f4")
    out = out.reshape(ALL, DIMS)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def pooled(texts: pa.Array, table: np.ndarray) -> np.ndarray:
    """A row for each text: the means of its words' and of its shapes' vectors, and whether it has words."""
    out = []
    for words, shapes, doc, n in _batches(texts):
        counts = np.bincount(doc, minlength=n)
        made = np.zeros((n, 2 * DIMS + 1), dtype=np.float32)
        if len(doc):
            have, at = np.flatnonzero(counts), np.flatnonzero(np.diff(doc, prepend=-1))
            for part, rows in enumerate((words, shapes)):
                made[have, part * DIMS : (part + 1) * DIMS] = np.add.reduceat(table[rows], at, axis=0) / counts[have, None]
            made[have, -1] = 1
        out.append(made)
    return np.concatenate(out) if out else np.zeros((0, 2 * DIMS + 1), dtype=np.float32)


@dataclass
class Network:
    """Two layers and a temperature; ``mean`` and ``scale`` standardise the input."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, hidden: int = 24, steps: int = 600, rate: float = 0.01, decay: float = 1e-4, seed: int = 3, prior: float = 0.5) -> Network:
    """Fit by Adam on four fifths of the rows, then the temperature on the rest.

    Without rows of both labels nothing can be told apart: every text scores the share of label 1, ``prior`` counted
    as one row more.
    """
    width = x.shape[1]
    if len(np.unique(y)) < 2:
        share = np.clip((y.sum() + prior) / (len(y) + 1), 1e-9, 1 - 1e-9)
        return Network(np.zeros(width), np.ones(width), np.zeros((width, 1)), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held, used = order[: len(y) // 5], order[len(y) // 5 :]
    mean, scale = x[used].mean(axis=0), x[used].std(axis=0) + 1e-6
    p = [rng.normal(0, width**-0.5, (width, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
    m, v = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p]
    z, t = (x[used] - mean) / scale, y[used]
    for step in range(1, steps + 1):
        some = rng.integers(0, len(t), min(len(t), 2048))
        a = np.tanh(z[some] @ p[0] + p[1])
        g = (1 / (1 + np.exp(-np.clip(a @ p[2] + p[3], -40, 40))) - t[some]) / len(some)
        back = np.outer(g, p[2]) * (1 - a * a)
        grads = [z[some].T @ back + decay * p[0], back.sum(axis=0), a.T @ g + decay * p[2], np.array([g.sum()])]
        for i, q in enumerate(grads):
            m[i], v[i] = 0.9 * m[i] + 0.1 * q, 0.999 * v[i] + 0.001 * q * q
            p[i] = p[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    net = Network(mean, scale, p[0], p[1], p[2], float(p[3][0]))
    if len(held):
        logits, truth = net.logits(x[held]), y[held]
        loss = lambda s: np.mean(np.logaddexp(0, np.where(truth == 1, -logits, logits) / s))
        net.temperature = float(min(np.geomspace(0.5, 8, 60), key=loss))
    return net


def train(docs: DataFrame, labelled: DataFrame, table: np.ndarray, id_col: str, text_col: str, label_col: str, sample: int, prior: float = 0.5) -> Network:
    """A network fitted on at most ``sample`` of the labelled rows (by hash of their id), whose vectors go to the driver."""
    rows = labelled.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("key")).agg(F.max(label_col).alias("y"))
    rows = rows.orderBy(F.xxhash64("key"), "key").limit(sample)
    texts = docs.select(F.col(id_col).alias("key"), text_of(text_col).alias("text")).join(F.broadcast(rows), "key")
    shared = docs.sparkSession.sparkContext.broadcast(table)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = pa.array([v.tobytes() for v in pooled(batch.column(0), shared.value)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), vectors], ["key", "y", "v"])

    found = texts.select("text", F.col("key").cast("string"), F.col("y").cast("double")).mapInArrow(run, "key string, y double, v binary").collect()
    found.sort(key=lambda r: (r["key"], r["v"]))  # the same fit for any order of tasks
    x = np.array([np.frombuffer(r["v"], dtype=np.float32) for r in found]).reshape(-1, 2 * DIMS + 1).astype(np.float64)
    return fit(x, np.array([r["y"] for r in found]), prior=prior)


def score_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", limit: float = 0.7, sample: int = 20_000, prior: float = 0.5
) -> DataFrame:
    """The input's rows and columns with held_out, score (0 to 1) and predicted (1 if the score is at least ``limit``).

    Word vectors come from all documents; labels are learned from at most ``sample`` labelled rows, none of which has
    crc32 of its id, as text, equal to 2 modulo 4: those are held out.  A score depends on the text alone.  Null texts
    count as empty; empty texts share the score of a document without words.  A null id is held out of learning and
    marked by the crc32 of an empty text.  If an id has several labels the greatest counts.  With labels of one
    kind only, all scores are near that label; without any they are ``prior``.  Repeated rows have equal scores, very
    long texts are read whole, and an empty table gives no rows.  Input columns called held_out, score or predicted are
    replaced.
    """
    remainder = lambda c: F.crc32(F.coalesce(c.cast("string"), F.lit(""))) % 4
    table = word_vectors(docs, text_col)
    net = train(docs, labels.filter(remainder(F.col(id_col)) != 2), table, id_col, text_col, label_col, sample, prior)
    shared = docs.sparkSession.sparkContext.broadcast((table, net))
    own = [c for c in docs.columns if c not in ("held_out", "score", "predicted")]
    rows = docs.select(F.struct(*own).alias("row"))
    at = own.index(text_col)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, fitted = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                some = batch.column(0).slice(start, 512)
                scores = fitted.probability(pooled(some.field(at).fill_null(""), known).astype(np.float64))
                yield pa.RecordBatch.from_arrays([some, pa.array(scores, pa.float64())], ["row", "score"])

    scored = rows.mapInArrow(run, T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())]))
    return scored.select(
        *[F.col("row").getField(c).alias(c) for c in own],
        (remainder(F.col("row").getField(id_col)) == 2).alias("held_out"),
        "score",
        (F.col("score") >= limit).cast("int").alias("predicted"),
    )
