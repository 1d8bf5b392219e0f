"""Importance resampling toward a target text: hashed features, gains per bucket, and a draw of the highest scores.

Features are runs of words; the CRC-32 of a run continues that of its beginning.  A head vocabulary of frequent words
and pairs is broadcast: exact CRC states of the words and exact buckets of the pairs.  Features outside it (the tail)
get their CRC directly.  Both count into the same bucket totals, so the head changes the time taken and no result.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coverspark.llm.common import bucket_of, cut, partitions, text_of, tidy

#: Words are runs of digits, a-z and all beyond ASCII; A-Z count as a-z.  In UTF-8 every byte beyond ASCII is 128 or more.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Longer words are never of the head, which bounds its bytes.
LONGEST = 64


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[bytes]:
    for value in batch.column(column):
        yield value.as_buffer().to_pybytes()


def head_vocabulary(docs: DataFrame, longest_run: int = 1, size: int = 20_000, text_col: str = "text") -> tuple[dict[bytes, int], dict[tuple[bytes, bytes], int]]:
    """CRC states of frequent words and CRCs of frequent pairs (if runs are longer than one), at most ``size`` of each.

    Each task counts with bounded memory (rare entries are let go when there are many) and reports features with at
    least one in ``size`` of its own; of the sums the same share is kept, which bounds their number whatever the input.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [Counter(), Counter()]
        total = 0
        for batch in batches:
            for text in _texts(batch, 0):
                words = words_of(text)
                total += len(words)
                counts[0].update(words)
                if longest_run > 1:
                    counts[1].update(pairwise(words))
                for k, c in enumerate(counts):
                    if len(c) > 20 * size:
                        counts[k] = Counter(dict(c.most_common(10 * size)))
        kept = [(k, f if k == 0 else b" ".join(f), n) for k, c in enumerate(counts) for f, n in c.items() if n * size >= total and (len(f) if k == 0 else sum(map(len, f))) <= LONGEST]
        kept.append((-1, b"", total))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*kept, strict=True), (pa.int32(), pa.binary(), pa.int64()), strict=True)], ["kind", "feature", "n"])

    found = docs.select(text_of(text_col).alias("text")).mapInArrow(run, "kind int, feature binary, n bigint").groupBy("kind", "feature").agg(F.sum("n").alias("n"))
    found = cut(found)
    total = found.filter("kind = -1").agg(F.max("n")).first()[0] or 0
    head = found.filter((F.col("kind") >= 0) & (F.col("n") * size >= total)).collect()  # so no more than 2 x size rows
    states = {bytes(r["feature"]): zlib.crc32(r["feature"]) for r in head if r["kind"] == 0}
    pairs = {tuple(bytes(r["feature"]).split(b" ")): zlib.crc32(r["feature"]) for r in head if r["kind"] == 1}
    return states, pairs


def features_of(words: list[bytes], longest_run: int, buckets: int, head: tuple[dict, dict]) -> dict[int, int]:
    """How many features of a document lie in each bucket."""
    states, pairs = head
    out: dict[int, int] = {}
    for word, n in Counter(words).items():
        state = states.get(word)
        b = (zlib.crc32(word) if state is None else state) % buckets
        out[b] = out.get(b, 0) + n
    for run in range(2, longest_run + 1):
        for feature, n in Counter(zip(*(words[i:] for i in range(run)), strict=False)).items():
            crc, at = pairs.get(feature[:2]), 2
            if crc is None:
                crc, at = states.get(feature[0]), 1
                crc = zlib.crc32(feature[0]) if crc is None else crc
            for word in feature[at:]:
                crc = zlib.crc32(b" " + word, crc)
            out[crc % buckets] = out.get(crc % buckets, 0) + n
    return out


def bucket_totals(texts: DataFrame, head, longest_run: int = 1, buckets: int = 10_000, text_col: str = "text") -> np.ndarray:
    """Features of all texts by bucket; as many numbers for any input."""
    shared = texts.sparkSession.sparkContext.broadcast(head)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for text in _texts(batch, 0):
                found = features_of(words_of(text), longest_run, buckets, shared.value)
                sums[np.fromiter(found, dtype=np.int64, count=len(found))] += np.fromiter(found.values(), dtype=np.int64, count=len(found))
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sums[used])], ["bucket", "n"])

    counts = texts.select(text_of(text_col).alias("text")).mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, dtype=np.int64)
    for r in counts.collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's whole thousandths of the log ratio of target to corpus, both smoothed by one a bucket."""
    size = len(corpus)
    s, t = float(int(corpus.sum()) + size), float(int(target.sum()) + size)
    return np.array([math.floor(1000 * math.log((float(b) + 1) * s / ((float(a) + 1) * t))) for a, b in zip(corpus.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def noise(ids: Column, seed: int) -> Column:
    """Whole thousandths of a Gumbel number by the hash of the id; it makes the highest scores a weighted draw."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(ids.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("bigint")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def resample(
    docs: DataFrame, target: DataFrame, longest_run: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text"
) -> DataFrame:
    """The id, n_words, n_features, weight, score and rank of every document; the drawn ones have ranks 1, 2, 3, ...

    weight sums the gains of a document's features.  Of the N documents with ``least_words`` words, floor(percent x N /
    100) of the highest scores are drawn, ties to the smaller id.  Null and empty texts have no features and weight 0;
    a null id hashes as an empty one and comes last of ties; rows that repeat are ranked next to each other; very long
    texts are read whole; an empty table gives no rows, an empty target a target without features.  Other columns are
    not read.  Ranks come from a range exchange, counts of its partitions and places in them, so no task orders all rows.
    """
    spark = docs.sparkSession
    head = head_vocabulary(docs, longest_run, text_col=text_col)
    corpus = bucket_totals(docs, head, longest_run, buckets, text_col)
    shared = spark.sparkContext.broadcast((head, gains(corpus, bucket_totals(target, head, longest_run, buckets, target_col))))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, gain = shared.value
        for batch in batches:
            rows = []
            for text in _texts(batch, 1):
                words = words_of(text)
                found = features_of(words, longest_run, buckets, known)
                at, n = (np.fromiter(x, dtype=np.int64, count=len(found)) for x in (found, found.values()))
                rows.append((len(words), int(n.sum()), int(gain[at] @ n)))
            columns = zip(*rows, strict=True) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in columns]], ["id", "n_words", "n_features", "weight"])

    kind = docs.schema[id_col].dataType.simpleString()
    weighed = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_words bigint, n_features bigint, weight bigint")
    scored = cut(weighed.withColumn("score", (F.col("weight") + noise(F.col("id"), seed)).cast("bigint")))
    able = F.col("n_words") >= least_words
    order = [F.desc("able"), F.desc("score"), F.asc_nulls_last("id")]
    placed = scored.withColumn("able", able).repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    placed = cut(placed.withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftright("place", 33)
    sizes = sorted(map(tuple, placed.filter("able").groupBy(part.alias("part")).count().collect()))
    drawn = percent * sum(n for _, n in sizes) // 100
    before = [0]
    for _, n in sizes:
        before.append(before[-1] + n)
    ahead = F.split(F.lit(",".join(map(str, before))), ",").cast("array<bigint>")
    rank = F.element_at(ahead, bucket_of(part, [p for p, _ in sizes], "bigint")) + F.col("place").bitwiseAND((1 << 33) - 1) + 1 if sizes else F.lit(None)
    ranked = placed.withColumn("rank", F.when(F.col("able"), rank).cast("bigint"))
    return ranked.select(F.col("id").alias(id_col), "n_words", "n_features", "weight", "score", F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))


def draw(docs: DataFrame, ranks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The drawn rows with all their columns; ids must be unique and not null."""
    return docs.join(ranks.filter("rank is not null").select(id_col), id_col, "left_semi")
