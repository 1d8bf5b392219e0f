"""Sharding by histogram sort: exact byte counts below probed key boundaries, refined until the splitters fit.

The key is the text's hash and then the id, so that equal texts lie side by side and a group of copies of any size can
still be split between shards.  Each round counts, over all partitions, the bytes and rows between the probes and the
least and greatest key there; the next round probes only inside the gaps that still hold a target.  Rounds read a
narrow table of keys and sizes.  Then the rows are exchanged once, dealt by all boundaries probed, whose exact row
counts give each row its slot without sorting a whole shard in one task.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coverspark.llm.common import bucket_of, cut, partitions, text_of


def _key(id_col: str, text_col: str):
    part = lambda c: F.lpad(F.coalesce(F.hex(c), F.lit("")), 16, "0")
    return F.concat(part(F.xxhash64(text_of(text_col))), part(F.col(id_col).cast("long")))


def _between(low: str, high: str, n: int) -> list[str]:
    a, b = int(low, 16), int(high, 16)
    return sorted({f"{a + (b - a) * i // (n + 1) + 1:032X}" for i in range(n + 1)} & {f"{x:032X}" for x in range(a + 1, b + 1)} if b - a <= n else {f"{a + (b - a) * i // (n + 1):032X}" for i in range(1, n + 1)})


#: Most boundaries that rows are dealt by; they are part of the plan.
BOUNDS = 20_000


def splitters(
    keys: DataFrame, shards: int, tolerance: float = 0.002, probes: int = 15, most: int | None = None, rounds: int = 150
) -> tuple[list[str], list[tuple[str, int]]]:
    """Keys that open shards 1 to ``shards - 1`` and every boundary probed, with the exact number of rows below it.

    ``keys`` has key (32 hex digits) and size.  A splitter is settled when the bytes below it are within
    ``tolerance`` of a shard's share, or when no other key lies between it and the target.  What lies between two
    boundaries is probed further while it has more than ``most`` rows of more than one key.
    """
    below: dict[str, tuple[int, int]] = {}
    total = keys.agg(F.sum("size"), F.count("*"), F.min("key"), F.max("key")).first()
    size, rows, low, high = total
    if not rows:
        return [], []
    targets = [size * s / shards for s in range(1, shards)]
    gaps = {(low, high): probes * max(1, len(targets))}  # keys from low to high between which so many boundaries are probed
    chosen: dict[float, str] = {}
    for _ in range(rounds):
        new = sorted({p for (a, b), n in gaps.items() for p in _between(a, b, n)} - set(below))
        if not new:
            break
        bounds = sorted([*below, *new])
        found = keys.groupBy(bucket_of(F.col("key"), bounds, "string").alias("b"))
        found = {r["b"]: r for r in found.agg(F.sum("size").alias("s"), F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect()}
        s = n = 0
        inside: list[tuple[str, str] | None] = []
        gaps = {}
        for i in range(len(bounds) + 1):
            if i:
                below[bounds[i - 1]] = (s, n)
            r = found.get(i)
            inside.append((r["lo"], r["hi"]) if r else None)
            if r and most and r["n"] > most and r["lo"] < r["hi"]:
                gaps[inside[-1]] = -(-2 * r["n"] // most)
            s, n = s + (r["s"] if r else 0), n + (r["n"] if r else 0)
        sums = [below[b][0] for b in bounds]
        for t in targets:
            i = bisect_left(sums, t)  # the gap before boundary i holds the target
            near = min((abs(below[b][0] - t), b) for b in bounds[max(0, i - 1) : i + 1])
            chosen[t] = near[1]
            if near[0] > tolerance * size / shards and inside[i] and inside[i][0] < inside[i][1]:
                gaps[inside[i]] = gaps.get(inside[i], 0) + probes
        if not gaps:
            break
    else:
        raise RuntimeError(f"splitters did not settle in {rounds} rounds")
    return [chosen[t] for t in targets if t in chosen], [(b, below[b][1]) for b in sorted(below)]


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.002) -> DataFrame:
    """The input's rows and columns plus size (UTF-8 bytes and 8), shard (0 to ``shards - 1``) and slot.

    Shards have near equal sums of size; slots are gapless from 0 in each shard, in key order.  Null text has no
    bytes, a null id sorts as zero; repeated rows get slots of their own, and all rows of one text and id are ranked in
    one task.  Very long texts stay whole.  An empty table gives no rows.  Input columns that are called size, shard or
    slot are replaced; other extra columns pass unchanged.
    """
    spark = docs.sparkSession
    size = (F.octet_length(text_of(text_col)) + 8).cast("long")
    keys = cut(docs.select(_key(id_col, text_col).alias("key"), size.alias("size")))
    parts = min(4 * partitions(spark), BOUNDS // 4)
    opening, bounds = splitters(keys, shards, tolerance, max(15, -(-parts // shards)), -(-2 * keys.count() // parts))
    names = [b for b, _ in bounds]
    counts = [0, *(n for _, n in bounds)]
    opens = sorted(bisect_left(names, k) + 1 for k in opening)  # the first part of shards 1, 2, ...
    rows_before = [0, *(counts[p] for p in opens)]
    listed = lambda xs: F.split(F.lit(",".join(map(str, xs))), ",").cast("array<bigint>")

    rows = docs.select(F.struct("*").alias("row"), _key(id_col, text_col).alias("key"), size.alias("size"))
    rows = rows.withColumn("part", bucket_of(F.col("key"), names, "string"))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy("key")))
    rows = rows.withColumn("shard", bucket_of(F.col("part"), opens, "int"))
    slot = F.element_at(listed(counts), F.col("part") + 1) + F.col("rank") - 1 - F.element_at(listed(rows_before), F.col("shard") + 1)
    own = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("size", "shard", "slot")]
    return rows.select(*own, "size", F.col("shard").cast("int"), slot.cast("long").alias("slot"))
