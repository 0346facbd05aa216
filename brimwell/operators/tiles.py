"""Overlapping tiles of image stacks: the grid, the parts that tiles own, functions of tiles, stitching, and training pairs.

Pixels stay packed: the part of a frame that a tile covers is cut out as row slices, tiles and frames exchange arrays, and no row holds a
pixel.  `by` names the columns that tell stacks apart, in frames and grid alike; null keys are a stack of their own.  A task holds
a tile, or an image.  Null pixels count as 0; frames that are null, or shorter than their stack's size says, are filled up with 0.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import packed
from .running import beside

AXES = ("s", "y", "x")
_EDGES = [f"{o}{a}{k}" for o in ("", "own_") for a in AXES for k in (0, 1)]


def tile_grid(shapes: DataFrame, size: tuple[int, int, int], gap: tuple[int, int, int]) -> DataFrame:
    """The tiles of each stack (frames, height, width, and any keys): `tile` counted from 0 (height, then width, then frames), and for each axis
    [a0, a1) and the part it owns, [own_a0, own_a1).

    There are ceil((n - size + gap) / gap) tiles on an axis, at least one; the last is flush with the end; inner edges give up
    (size - gap) / 2 to the neighbour; a sole tile owns the whole axis.
    """
    whole = dict(zip(AXES, ("frames", "height", "width")))
    sizes, gaps = dict(zip(AXES, size)), dict(zip(AXES, gap))
    many = {a: F.greatest(F.lit(1), F.ceil((F.col(whole[a]) - sizes[a] + gaps[a]) / gaps[a])).cast("long") for a in AXES}
    d = shapes
    for a in AXES:
        d = d.withColumn(f"n_{a}", many[a])
    for a in ("y", "x", "s"):
        d = d.withColumn(f"k_{a}", F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"n_{a}") - 1)))
    tile = (F.col("k_y") * F.col("n_x") + F.col("k_x")) * F.col("n_s") + F.col("k_s")
    for a in AXES:
        last, n, cut = F.col(f"k_{a}") == F.col(f"n_{a}") - 1, F.col(whole[a]).cast("long"), (sizes[a] - gaps[a]) // 2
        begin = F.when(last, F.greatest(F.lit(0), n - sizes[a])).otherwise(F.col(f"k_{a}") * gaps[a])
        d = d.withColumns({f"{a}0": begin, f"{a}1": F.when(last, n).otherwise(begin + sizes[a])})
        d = d.withColumns({f"own_{a}0": F.when(F.col(f"k_{a}") == 0, 0).otherwise(F.col(f"{a}0") + cut).cast("long"), f"own_{a}1": F.when(last, n).otherwise(F.col(f"{a}1") - cut).cast("long")})
    keys = [c for c in shapes.columns if c not in whole.values()]
    return d.select(*keys, tile.alias("tile"), *[c for a in AXES for c in (f"{a}0", f"{a}1", f"own_{a}0", f"own_{a}1")])


def above_least(frames: DataFrame, factor: float = 1.0, by: tuple[str, ...] = ()) -> DataFrame:
    """Pixels as doubles: what they have above the least pixel of their stack, divided by a factor."""
    least = frames.groupBy(*by).agg(F.min(F.array_min("pixels")).alias("_least"))
    return beside(frames, least, list(by)).withColumn("pixels", F.transform("pixels", lambda v: (v - F.col("_least")) / F.lit(float(factor)))).drop("_least")


def tile_parts(frames: DataFrame, grid: DataFrame, width: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, tile, the tile's edges, frame, pixels): what each tile covers of each frame, row after row; rows and columns beyond an image are left out."""
    tiles = grid.select(*by, "tile", *_EDGES, F.explode(F.sequence(F.col("s0"), F.col("s1") - 1)).alias("frame"))
    both = beside(frames.where("frame is not null and pixels is not null").select(*by, "frame", "pixels"), tiles, [*by, "frame"])
    part = lambda r: F.slice("pixels", (r * width + F.col("x0") + 1).cast("int"), (F.col("x1") - F.col("x0")).cast("int"))
    return both.select(*by, "tile", *_EDGES, "frame", F.flatten(F.transform(F.sequence(F.col("y0"), F.col("y1") - 1), part)).alias("pixels"))


def tile_outcomes(parts: DataFrame, function: Callable[[np.ndarray, int], np.ndarray], by: tuple[str, ...] = ()) -> DataFrame:
    """(by, tile, frame, y0, y1, x0, x1, pixels): function(the tile as an array of frames, rows, columns; its number) on the part that the tile owns,
    times sqrt(sum of what came in / sum of what came out) there; null where the outcome sums to 0."""
    schema = StructType([*[parts.schema[c] for c in by], *StructType.fromDDL("tile long,frame long,y0 long,y1 long,x0 long,x1 long,pixels array<double>").fields])

    def run(table: pa.Table) -> pa.Table:
        e = {c: table.column(c)[0].as_py() for c in _EDGES}
        shape = tuple(e[f"{a}1"] - e[f"{a}0"] for a in AXES)
        whole = np.zeros((shape[0], shape[1] * shape[2]))
        for f, v in zip(table.column("frame").to_pylist(), packed.rows(table, "pixels")):
            whole[f - e["s0"], : len(v)] = np.nan_to_num(v)
        whole = whole.reshape(shape)
        own = tuple(slice(e[f"own_{a}0"] - e[f"{a}0"], e[f"own_{a}1"] - e[f"{a}0"]) for a in AXES)
        raw, out = whole[own], np.asarray(function(whole, table.column("tile")[0].as_py()), float)[own]
        there = sorted({f for f in table.column("frame").to_pylist() if e["own_s0"] <= f < e["own_s1"]})
        with np.errstate(divide="ignore", invalid="ignore"):
            share = raw.sum() / out.sum()
        out = out * (math.sqrt(share) if np.isfinite(share) and share >= 0 else np.nan)
        place = np.array(there, np.int64) - e["own_s0"]
        first = pa.array(np.zeros(len(there), np.int64))
        keys = {c: table.column(c).slice(0, 1).combine_chunks().take(first) for c in by}
        edges = {f"{a}{k}": pa.array([e[f"own_{a}{k}"]] * len(there), pa.int64()) for a in "yx" for k in (0, 1)}
        return pa.table(keys | {"tile": pa.array([table.column("tile")[0].as_py()] * len(there), pa.int64()), "frame": pa.array(there, pa.int64())} | edges | {"pixels": packed.lists(out[place].reshape(len(there), -1)) if len(there) else pa.array([], pa.list_(pa.float64()))})

    return parts.groupBy(*by, "tile").applyInArrow(run, schema)


def stitched(outcomes: DataFrame, shapes: DataFrame, by: tuple[str, ...] = (), top: int = 65535) -> DataFrame:
    """(by, frame, pixels): the tiles' outcomes put together, where they overlap the later tile, from least to largest of the stack as 0..top (cut).

    shapes has height and width of each stack.  Pixels that no tile gives are null.
    """
    schema = StructType([*[outcomes.schema[c] for c in by], *StructType.fromDDL("frame long,pixels array<double>").fields])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("tile")
        height, width = (table.column(c)[0].as_py() for c in ("height", "width"))
        image = np.full((height, width), np.nan)
        edges = zip(*[table.column(c).to_pylist() for c in ("y0", "y1", "x0", "x1")])
        for (y0, y1, x0, x1), v in zip(edges, packed.rows(table, "pixels")):
            image[y0:y1, x0:x1] = v.reshape(y1 - y0, x1 - x0)
        return pa.table({c: table.column(c).slice(0, 1) for c in (*by, "frame")} | {"pixels": packed.lists(image.reshape(1, -1))})

    sized = beside(outcomes, shapes.select(*by, F.col("height").cast("long"), F.col("width").cast("long")), list(by))
    whole = sized.groupBy(*by, "frame").applyInArrow(run, schema)
    ends = whole.groupBy(*by).agg(F.min(F.array_min("pixels")).alias("_low"), F.max(F.array_max("pixels")).alias("_high"))
    share = lambda v: F.try_divide(v - F.col("_low"), F.col("_high") - F.col("_low"))
    return beside(whole, ends, list(by)).select(*by, "frame", F.transform("pixels", lambda v: F.floor(share(v) * top).cast("long")).alias("pixels"))


def temporal_gap(frames: int, size: int, tiles_of_image: int, stacks: int, wanted: int) -> int:
    """Frames between tiles for about `wanted` tiles over all stacks."""
    steps = math.ceil(wanted / tiles_of_image / stacks)
    return max(1, (frames - 2 * size) // max(1, steps - 1))


def tile_origins(shapes: DataFrame, size: tuple[int, int, int], gap: tuple[int, int], wanted: int, by: tuple[str, ...] = (), seed: str = "0") -> DataFrame:
    """(by, tile, s0, y0, x0, gap_s, place): origins of tiles for training, about `wanted` over all stacks, and their place in a fixed random order.

    Tiles of an image lie `gap` rows and columns apart as in tile_grid; in time they are gap_s frames apart, and a tile takes twice its
    frames, as inputs and targets take turns.  Stacks of fewer frames than that give none.
    """
    s, y, x = size
    per_axis = lambda n, a, g: F.greatest(F.lit(1), F.ceil((F.col(n) - a + g) / g)).cast("long")
    d = shapes.where(F.col("frames") >= 2 * s).withColumns({"_ny": per_axis("height", y, gap[0]), "_nx": per_axis("width", x, gap[1])})
    total = d.agg(F.count("*").alias("_stacks"))
    d = d.crossJoin(F.broadcast(total))  # one row
    steps = F.ceil(F.lit(wanted) / (F.col("_ny") * F.col("_nx")) / F.col("_stacks"))
    d = d.withColumn("gap_s", F.greatest(F.lit(1), F.floor((F.col("frames") - 2 * s) / F.greatest(F.lit(1), steps - 1))).cast("long"))
    d = d.withColumn("s0", F.explode(F.sequence(F.lit(0).cast("long"), F.col("frames") - 2 * s, F.col("gap_s"))))
    for a, n, whole, g in (("y", y, "height", gap[0]), ("x", x, "width", gap[1])):
        d = d.withColumn(f"_k{a}", F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"_n{a}") - 1)))
        d = d.withColumn(f"{a}0", F.when(F.col(f"_k{a}") == F.col(f"_n{a}") - 1, F.greatest(F.lit(0), F.col(whole) - n)).otherwise(F.col(f"_k{a}") * g).cast("long"))
    tile = ((F.col("_ky") * F.col("_nx") + F.col("_kx")) * (F.floor((F.col("frames") - 2 * s) / F.col("gap_s")) + 1) + F.floor(F.col("s0") / F.col("gap_s"))).cast("long")
    d = d.withColumn("tile", tile)
    return d.select(*by, "tile", "s0", "y0", "x0", "gap_s", F.md5(F.concat_ws(":", F.lit(seed), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in by], F.col("tile").cast("string"))).alias("place"))


def tile_pairs(frames: DataFrame, origins: DataFrame, size: tuple[int, int, int], width: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, tile, place, pair, input, target): for each tile the parts of its even frames beside those of the odd ones behind them, counted from its first frame; pairs are 0 to size[0] - 1."""
    s, y, x = size
    spread = origins.select(*by, "tile", "place", "y0", "x0", "s0", F.explode(F.sequence(F.col("s0"), F.col("s0") + 2 * s - 1)).alias("frame"))
    both = beside(frames.select(*by, "frame", "pixels"), spread, [*by, "frame"])
    part = lambda r: F.slice("pixels", (r * width + F.col("x0") + 1).cast("int"), F.least(F.lit(x), F.lit(width) - F.col("x0")).cast("int"))
    cut = both.select(*by, "tile", "place", (F.col("frame") - F.col("s0")).alias("k"), F.flatten(F.transform(F.sequence(F.col("y0"), F.col("y0") + y - 1), part)).alias("v"))
    side = lambda odd: F.max_by("v", F.when(F.col("k") % 2 == odd, 1))
    return cut.groupBy(*by, "tile", "place", F.floor(F.col("k") / 2).alias("pair")).agg(side(0).alias("input"), side(1).alias("target"))


def training_pairs(frames: DataFrame, seed: str = "0") -> DataFrame:
    """(pair, input, target, place): the pixels of even frames beside those of the next odd ones, and the place of each pair in a fixed random order."""
    pair = F.floor(F.col("frame") / 2).alias("pair")
    even = frames.where("frame % 2 = 0").select(pair, F.col("pixels").alias("input"))
    odd = frames.where("frame % 2 = 1").select(pair, F.col("pixels").alias("target"))
    return even.join(odd, "pair").withColumn("place", F.md5(F.concat_ws(":", F.lit(seed), F.col("pair").cast("string"))))
