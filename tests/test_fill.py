"""Gap filling against a search of growing windows: wide holes, scattered gaps, several tiles, limits."""

import random

import pytest

from coverspark.operators import repair


def window(cells, r, c, most=10**6):
    """The valid values of the least window around a pixel; cells: place to value, missing ones negative or null."""
    valid = {p: v for p, v in cells.items() if v is not None and v >= 0}
    if not valid:
        return []
    k = min(max(abs(y - r), abs(x - c)) for y, x in valid)
    return [v for (y, x), v in valid.items() if max(abs(y - r), abs(x - c)) == k] if k <= most else []


def filled(values):
    mode = min(values, key=lambda v: (-values.count(v), v))
    return sum(values) // len(values) if mode == min(values) else mode


@pytest.mark.parametrize("radius", [None, 2])
def test_scattered_gaps_of_many_tiles(spark, radius):
    rng = random.Random(3)
    tiles = {t: {(r + top, c - 70): rng.choice([-1, None, 1, 2, 3, 4]) if rng.random() < 0.6 else -1 for r in range(90) for c in range(150)} for t, top in (("a", 0), ("b", 1000))}
    tiles["none"] = {(r, c): -1 for r in range(3) for c in range(3)}
    tiles["one"] = {(r, c): 7 if (r, c) == (0, 0) else -1 for r in range(3) for c in range(200)}
    rows = [(t, r, c, v) for t, cells in tiles.items() for (r, c), v in cells.items()]
    got = {(r["tile"], r["row"], r["col"]): r["value"] for r in repair.fill_mode(spark.createDataFrame(rows, "tile string, row int, col int, value int"), radius=radius).collect()}
    assert len(got) == len(rows)
    some = rng.sample(rows, 900) + [r for r in rows if r[0] in ("none", "one")]
    for t, r, c, v in some:
        values = window(tiles[t], r, c, radius or 10**6) if v is None or v < 0 else []
        assert got[t, r, c] == (filled(values) if values else v), (t, r, c)


def test_a_hole_of_200_pixels(spark, monkeypatch):
    cells = {(r, c): -1 if 15 <= r < 215 and 10 <= c < 210 else (r * 7 + c * c) % 5 for r in range(230) for c in range(225)}
    df = spark.createDataFrame([("a", r, c, v, v, v) for (r, c), v in cells.items()], "tile string, row int, col int, sos int, eos int, los int")
    sent = []
    kept = repair.checkpointed
    monkeypatch.setattr(repair, "checkpointed", lambda d: sent.append(kept(d)) or sent[-1])
    got = {(r["row"], r["col"]): r["value"] for r in repair.fill_mode(df.withColumnRenamed("sos", "value")).collect()}
    assert sent[0].count() <= 16 * (16 * 2 + 8)  # rows of blocks; windows of single pixels would be 10 million rows
    season = {(r["row"], r["col"]): r for r in repair.fill_season(df).collect()}
    for at in [(15, 10), (114, 109), (115, 110), (214, 209), (15, 209), (60, 111), (150, 30), (200, 200), (114, 10)]:
        values = window(cells, *at)
        mode = min(values, key=lambda v: (-values.count(v), v))
        assert got[at] == filled(values), at
        last = max(values) if mode == min(values) and values.count(mode) == 1 else mode
        assert (season[at]["sos"], season[at]["eos"], season[at]["los"]) == (mode, last, last - mode if last > mode else 365)
    assert all(v >= 0 for v in got.values())


def test_pairs_hold_the_ring_of_the_nearest_block():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(4)
    for _ in range(20):
        valid, gap = rng.random((9, 12)) < 0.08, rng.random((9, 12)) < 0.5
        r, c = np.nonzero(valid | gap)
        table = pa.table({"tile": ["t"] * len(r), "feature": ["f"] * len(r), "br": r - 3, "bc": c + 5, "valid": valid[r, c], "gap": gap[r, c]})
        got = set(zip(*(repair._reach(table)[k].to_pylist() for k in ("gr", "gc", "br", "bc")), strict=True))
        want = set()
        for y, x in zip(*np.nonzero(gap), strict=True):
            near = [(max(abs(y - a), abs(x - b)), a, b) for a, b in zip(*np.nonzero(valid), strict=True)]
            want |= {(y - 3, x + 5, a - 3, b + 5) for d, a, b in near if d <= min(near)[0] + 1}
        assert got == want
