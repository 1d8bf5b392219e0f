"""Phenology repair and filling of missing values.  Values below the minimum, and nulls, are missing."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coverspark.sources.pixels import checkpointed

PIX = ["tile", "row", "col"]
BLOCK = 64


def fix_annual(col: Column) -> Column:
    """Days of year beyond 365, less whole years."""
    return F.when(col > 365, F.pmod(col - 1, F.lit(365)) + 1).otherwise(col)


def null_negative(col: Column) -> Column:
    return F.when(col >= 0, col)


def fix_nos(col: Column) -> Column:
    """A negative number of seasons becomes -1."""
    return F.when(col < 0, -1).otherwise(col)


def floor_zero(col: Column) -> Column:
    return F.when(col <= 0, 0).otherwise(col)


def _missing(value: Column, low: float) -> Column:
    return value.isNull() | (value < low)


def _fill(long: DataFrame, by: Sequence[str], low: float, round_: bool) -> DataFrame:
    v = F.col("value")
    mean = F.avg(F.when(~_missing(v, low), v))
    means = long.groupBy(*by).agg((F.bround(mean, 2) if round_ else mean.cast("int")).alias("_m"))
    return long.join(means, list(by)).withColumn("value", F.when(_missing(v, low), F.col("_m")).otherwise(v)).drop("_m")


def fill_mean(long: DataFrame, by: Sequence[str], low: float = 0) -> DataFrame:
    """Missing values become the mean of the valid ones of their feature (few), to two decimals."""
    return _fill(long, by, low, True)


def fill_int_mean(long: DataFrame, by: Sequence[str], low: float = 0) -> DataFrame:
    """Missing values become the truncated mean of the valid ones."""
    return _fill(long, by, low, False)


def _reach(table: pa.Table) -> pa.Table:
    """Blocks of one tile and feature to pairs (block with gaps, block that can hold their nearest valid pixels).

    The sums of a table of block flags tell how many valid blocks any square of blocks holds, so halving finds the
    distance d (in blocks) of the nearest one.  No pixel's nearest valid pixel is in a block farther than d + 1, and
    none nearer than d is valid: pairs are of the ring d to d + 1, at most 16 d + 8 for each block with gaps.
    """
    br, bc, valid, gap = (table[c].to_numpy() for c in ("br", "bc", "valid", "gap"))
    out: list[np.ndarray] = []
    if valid.any() and gap.any():
        r0, c0 = int(br.min()), int(bc.min())
        flags = np.zeros((int(br.max()) - r0 + 1, int(bc.max()) - c0 + 1), dtype=np.int64)
        flags[br[valid] - r0, bc[valid] - c0] = 1
        r, c = br[gap] - r0, bc[gap] - c0
        for y, x, d in zip(r.tolist(), c.tolist(), (_nearest(flags, r, c, -1) - 1).tolist(), strict=True):
            top, left = max(0, y - d - 1), max(0, x - d - 1)
            near = np.argwhere(flags[top : y + d + 2, left : x + d + 2]) + (top, left)
            out.append(np.column_stack([near, np.full(len(near), y), np.full(len(near), x)]) + (r0, c0, r0, c0))
    rows = np.concatenate(out) if out else np.zeros((0, 4), dtype=np.int64)
    same = {c: pa.array([table[c][0].as_py()] * len(rows), table.schema.field(c).type) for c in ("tile", "feature")}
    return pa.table(same | {c: pa.array(rows[:, i]) for i, c in enumerate(("br", "bc", "gr", "gc"))})


def _nearest(flags: np.ndarray, r: np.ndarray, c: np.ndarray, low: int = 0) -> np.ndarray:
    """The least half width, above ``low``, of a square around each place with a flag in it; there is one at all."""
    sums = np.zeros((flags.shape[0] + 1, flags.shape[1] + 1), dtype=np.int64)
    sums[1:, 1:] = flags.cumsum(0).cumsum(1)
    below, above = np.full(len(r), low), np.full(len(r), max(flags.shape))
    while (above - below > 1).any():
        k = (below + above + 1) // 2  # of two neighbours the upper, which leaves them as they are
        up, down = np.clip(r - k, 0, None), np.clip(r + k + 1, None, flags.shape[0])
        left, right = np.clip(c - k, 0, None), np.clip(c + k + 1, None, flags.shape[1])
        hit = sums[down, right] - sums[up, right] - sums[down, left] + sums[up, left] > 0
        above, below = np.where(hit, k, above), np.where(hit, below, k)
    return above + (low < 0)


def _ring(k: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of the places at a distance of k rows or columns."""
    side, inner = np.arange(-k, k + 1), np.arange(-k + 1, k)
    ends = lambda a, b: np.concatenate([np.full(len(side), -k), np.full(len(side), k), *[inner] * 2])
    return ends(side, inner), np.concatenate([side, side, np.full(len(inner), -k), np.full(len(inner), k)])


def _rings(gaps: pa.Table, near: pa.Table, radius: int | None, most: int = 1 << 21) -> pa.Table:
    """mode (the least of ties), its count n, lo, hi and truncated mean of the valid pixels nearest to each gap of a block."""
    r, c = (gaps["gaps"].combine_chunks().flatten().field(f).to_numpy().astype(np.int64) for f in ("row", "col"))
    cells = near["cells"].combine_chunks().flatten()
    y, x = (cells.field(f).to_numpy().astype(np.int64) for f in ("row", "col"))
    values, code = np.unique(cells.field("v").to_numpy(), return_inverse=True)
    kind = cells.field("v").type
    found: list[tuple[np.ndarray, np.ndarray]] = []
    if len(y):
        r0, c0 = min(r.min(), y.min()), min(c.min(), x.min())
        grid = np.full((max(r.max(), y.max()) - r0 + 1, max(c.max(), x.max()) - c0 + 1), -1, dtype=np.int32)
        grid[y - r0, x - c0] = code
        width = _nearest(grid >= 0, r - r0, c - c0)
        for k in np.unique(width).tolist():
            dr, dc = _ring(k)
            at = np.flatnonzero(width == k) if radius is None or k <= radius else np.zeros(0, dtype=np.int64)
            for some in (at[i : i + max(1, most // len(dr))] for i in range(0, len(at), max(1, most // len(dr)))):
                rr, cc = (r[some] - r0)[:, None] + dr, (c[some] - c0)[:, None] + dc
                inside = (rr >= 0) & (rr < grid.shape[0]) & (cc >= 0) & (cc < grid.shape[1])
                got = np.where(inside, grid[np.clip(rr, 0, grid.shape[0] - 1), np.clip(cc, 0, grid.shape[1] - 1)], -1)
                of, _ = np.nonzero(got >= 0)
                found.append((some[of], got[got >= 0]))
    pixel = np.concatenate([f[0] for f in found]) if found else np.zeros(0, dtype=np.int64)
    seen = np.concatenate([f[1] for f in found]) if found else np.zeros(0, dtype=np.int64)
    pairs, n = np.unique(pixel * max(1, len(values)) + seen, return_counts=True)
    pixel, seen = pairs // max(1, len(values)), pairs % max(1, len(values))
    first = np.flatnonzero(np.diff(pixel, prepend=-1))
    most_seen = np.lexsort((seen, -n, pixel))[first]
    last = np.append(first[1:], len(pixel))[: len(first)] - 1
    sums, counts = (np.add.reduceat(a, first) if len(first) else a for a in (values[seen] * n, n))
    of = pixel[first]
    same = {f: pa.array([gaps[f][0].as_py()] * len(of), gaps.schema.field(f).type) for f in ("tile", "feature")}
    columns = {"row": pa.array(r[of]), "col": pa.array(c[of]), "mode": pa.array(values[seen[most_seen]], kind), "n": pa.array(n[most_seen])}
    return pa.table(same | columns | {"lo": pa.array(values[seen[first]], kind), "hi": pa.array(values[seen[last]], kind), "mean": pa.array(np.trunc(sums / counts).astype(np.int64))})


def _window_modes(px: DataFrame, low: float, names: Sequence[str], inside: str | None, radius: int | None) -> DataFrame:
    """mode (the least of ties), its count n, lo, hi and truncated mean of each gap's window, by feature.

    All valid pixels of the least window with a valid one lie on its edge, at the distance of the nearest.  Blocks of
    64 x 64 pixels that have gaps are paired with the blocks that can hold those; valid pixels of other blocks do not
    move.  A pair moves a block as one row, so rows grow with the gaps' blocks and not with the width of windows.
    """
    long = px.unpivot([*PIX, *([inside] if inside else [])], list(names), "feature", "v")
    side = lambda c: F.floor(F.col(c) / BLOCK).cast("bigint")
    long = long.withColumns({"br": side("row"), "bc": side("col"), "ok": ~_missing(F.col("v"), low)})
    gap = ~F.col("ok") & (F.coalesce(F.col(inside) == 1, F.lit(False)) if inside else F.lit(True))
    cells = long.groupBy("tile", "feature", "br", "bc").agg(F.bool_or("ok").alias("valid"), F.bool_or(gap).alias("gap"))
    kinds = {f.name: f.dataType.simpleString() for f in long.schema}
    block = ["tile", "feature", "br", "bc"]
    key = f"tile {kinds['tile']}, feature string"
    pairs = checkpointed(cells.groupBy("tile", "feature").applyInArrow(_reach, f"{key}, br bigint, bc bigint, gr bigint, gc bigint"))
    place = F.struct("row", "col")
    gaps = long.filter(gap).groupBy(*block).agg(F.collect_list(place).alias("gaps"))
    gaps = gaps.withColumnsRenamed({"br": "gr", "bc": "gc"}).join(pairs.select("tile", "feature", "gr", "gc").distinct(), ["tile", "feature", "gr", "gc"], "left_semi")
    valid = long.filter("ok").join(pairs.select(*block).distinct(), block, "left_semi").groupBy(*block).agg(F.collect_list(F.struct("row", "col", "v")).alias("cells"))
    sent = pairs.join(valid, block).select("tile", "feature", "gr", "gc", "cells")
    by = ["tile", "feature", "gr", "gc"]
    schema = f"{key}, row bigint, col bigint, mode {kinds['v']}, n bigint, lo {kinds['v']}, hi {kinds['v']}, mean bigint"
    found = gaps.groupBy(*by).cogroup(sent.groupBy(*by)).applyInArrow(lambda a, b: _rings(a, b, radius), schema)
    return found.withColumns({"row": F.col("row").cast(kinds["row"]), "col": F.col("col").cast(kinds["col"]), "mean": F.col("mean").cast("int")})


def fill_mode(px: DataFrame, low: float = 0, radius: int | None = None, value: str = "value", inside: str | None = None) -> DataFrame:
    """Missing pixels become the mode (the least of ties) of the smallest square window with a valid value.

    If the mode is the window's minimum, its truncated mean is taken.  Windows stop at the tile's edge; pixels of
    tiles with no valid value (within ``radius``, if it is given) stay, and so do those where the column ``inside``,
    if it is given, isn't 1: on a mosaic most nulls lie outside the region and are no gaps.
    """
    modes = _window_modes(px, low, [value], inside, radius).select(*PIX, F.when(F.col("mode") == F.col("lo"), F.col("mean")).otherwise(F.col("mode")).alias("_f"))
    v = F.col(value)
    return px.join(modes, PIX, "left").withColumn(value, F.when(_missing(v, low), F.coalesce("_f", v)).otherwise(v)).drop("_f")


def fill_season(px: DataFrame, low: float = 0, radius: int | None = None, inside: str | None = None) -> DataFrame:
    """Missing sos becomes the window's mode; eos its mode, or its maximum if the mode is a minimum seen once; los the rest.

    A length of zero or less becomes 365.  ``inside`` as in ``fill_mode``; both are found in one pass.
    """
    last = F.when((F.col("mode") == F.col("lo")) & (F.col("n") == 1), F.col("hi")).otherwise(F.col("mode"))
    of = lambda name, e: F.max(F.when(F.col("feature") == name, e))
    both = _window_modes(px, low, ["sos", "eos"], inside, radius).groupBy(*PIX).agg(of("sos", F.col("mode")).alias("_s"), of("eos", last).alias("_e"))
    out = px.join(both, PIX, "left")
    gone = _missing(F.col("sos"), low)
    length = F.col("_e") - F.col("_s")
    filled = {"sos": F.col("_s"), "eos": F.col("_e"), "los": F.when(length <= 0, 365).otherwise(length)}
    return out.withColumns({c: F.when(gone & f.isNotNull(), f).otherwise(F.col(c)) for c, f in filled.items()}).drop("_s", "_e")


def check_colocated(px: DataFrame, low: float = 0) -> DataFrame:
    """Pixels where sos, eos and los are not missing together."""
    m = [_missing(F.col(c), low).cast("int") for c in ("sos", "eos", "los")]
    return px.agg(F.count_if((m[0] != m[1]) | (m[0] != m[2])).alias("disagree"), F.count("*").alias("pixels"))
