"""Packed tiles against numpy, for two stacks of different sizes at once."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from brimwell.operators import tiles

BY = ("session", "plane")
SHAPES = {("a", 1): (30, 9, 7), (None, 0): (25, 6, 7)}


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    stacks = {k: rng.integers(-20, 200, shape) for k, shape in SHAPES.items()}
    rows = [(s, p, f, v.ravel().tolist()) for (s, p), x in stacks.items() for f, v in enumerate(x)]
    frames = spark.createDataFrame(rows, "session string, plane int, frame long, pixels array<int>").repartition(3)
    shapes = spark.createDataFrame([(s, p, *shape) for (s, p), shape in SHAPES.items()], "session string, plane int, frames long, height long, width long")
    return stacks, frames, shapes


def test_stitched_tiles_by_brute_force(data):
    stacks, frames, shapes = data
    grid = tiles.tile_grid(shapes, (10, 4, 5), (6, 2, 3))
    out = tiles.stitched(tiles.tile_outcomes(tiles.tile_parts(frames, grid, 7, BY), lambda x, number: x * (number % 3 + 1) + 5, BY), shapes, BY, 1000)
    got = {(r.session, r.plane, r.frame): r.pixels for r in out.collect()}
    for key, x in stacks.items():
        want = np.full(x.shape, np.nan)
        for g in sorted((g for g in grid.collect() if (g.session, g.plane) == key), key=lambda g: g.tile):
            own = slice(g.own_s0, g.own_s1), slice(g.own_y0, g.own_y1), slice(g.own_x0, g.own_x1)
            y = x[own] * (g.tile % 3 + 1) + 5.0
            want[own] = y * math.sqrt(x[own].sum() / y.sum())
        want = np.floor((want - want.min()) / (want.max() - want.min()) * 1000)
        assert np.abs(np.array([got[(*key, f)] for f in range(len(x))]).reshape(x.shape) - want).max() <= 1  # a floor beside a whole number


def test_parts_are_cut_without_pixel_rows(data):
    stacks, frames, shapes = data
    grid = tiles.tile_grid(shapes, (10, 4, 5), (6, 2, 3))
    parts = tiles.tile_parts(frames, grid, 7, BY)
    assert "posexplode" not in parts._jdf.queryExecution().toString()
    rows = parts.collect()
    assert len(rows) == sum(g.s1 - g.s0 for g in grid.collect())
    for r in rows:
        assert r.pixels == stacks[r.session, r.plane][r.frame, r.y0 : r.y1, r.x0 : r.x1].ravel().tolist()


def test_above_least(data):
    stacks, frames, _ = data
    for r in tiles.above_least(frames, 4, BY).collect():
        x = stacks[r.session, r.plane]
        assert r.pixels == ((x[r.frame] - x.min()) / 4).ravel().tolist()


def test_tile_origins_and_pairs(data):
    stacks, frames, shapes = data
    size = (4, 4, 5)
    rows = tiles.tile_origins(shapes, size, (2, 3), 60, BY).collect()
    for key, (n, height, width) in SHAPES.items():
        own = [r for r in rows if (r.session, r.plane) == key]
        ny, nx = max(1, math.ceil((height - 4 + 2) / 2)), max(1, math.ceil((width - 5 + 3) / 3))
        gap = max(1, (n - 8) // max(1, math.ceil(60 / (ny * nx) / 2) - 1))
        assert {r.gap_s for r in own} == {gap} == {tiles.temporal_gap(n, 4, ny * nx, 2, 60)}
        assert {(r.s0, r.y0, r.x0) for r in own} == {(s, height - 4 if j == ny - 1 else 2 * j, width - 5 if i == nx - 1 else 3 * i) for s in range(0, n - 7, gap) for j in range(ny) for i in range(nx)}
        assert sorted(r.tile for r in own) == list(range(len(own)))
    assert len({r.place for r in rows}) == len(rows)
    origins = tiles.tile_origins(shapes, size, (2, 3), 60, BY)
    at = {(r.session, r.plane, r.tile): r for r in rows}
    pairs = tiles.tile_pairs(frames, origins, size, 7, BY).collect()
    assert len(pairs) == 4 * len(rows)
    for r in pairs:
        o, x = at[r.session, r.plane, r.tile], stacks[r.session, r.plane]
        for side, k in ((r.input, 0), (r.target, 1)):
            assert side == x[o.s0 + 2 * r.pair + k, o.y0 : o.y0 + 4, o.x0 : o.x0 + 5].ravel().tolist()


def test_empty_and_short_stacks(spark, data):
    _, frames, shapes = data
    grid = tiles.tile_grid(shapes, (10, 4, 5), (6, 2, 3))
    assert tiles.stitched(tiles.tile_outcomes(tiles.tile_parts(frames.limit(0), grid, 7, BY), lambda x, _: x, BY), shapes, BY).count() == 0
    assert tiles.tile_origins(shapes.withColumn("frames", F.lit(7).cast("long")), (4, 4, 5), (2, 3), 60, BY).count() == 0
