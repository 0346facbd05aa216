"""Image-stack operators.  A frame is a row: frame long, pixels array<int> (row-major, `width` columns).

A table may hold several stacks: `by` names the columns that tell them apart (say session, channel, plane), and each stack is treated as if
it were alone.  Null keys are a stack of their own.  Null frames, null pixel arrays and null pixels are skipped by aggregates
and stay null in projections.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import packed
from .running import beside

HELD = 64  # partial images that a task holds
MASKS = 1 << 20  # region pixels that are broadcast


def halved(frames: DataFrame, unsigned: bool = True) -> DataFrame:
    """Pixels as signed 16-bit ones: unsigned values are halved (floor), others cut to their whole part."""
    return frames.withColumn("pixels", F.transform("pixels", lambda v: (F.floor(v / 2) if unsigned else v).cast("short").cast("int")))


def cropped(frames: DataFrame, width: int, y: tuple[int, int], x: tuple[int, int]) -> DataFrame:
    """The pixels with y[0] <= row < y[1] and x[0] <= column < x[1]."""
    inside = lambda v, i: F.floor(i / width).between(y[0], y[1] - 1) & (i % width).between(x[0], x[1] - 1)
    return frames.withColumn("pixels", F.filter("pixels", inside))


def without_artifact(frames: DataFrame, artifact: int = 1000, chunk: int = 7000, by: tuple[str, ...] = ()) -> DataFrame:
    """Drops leading frames of each session (`by`) so that the rest is whole chunks: the remainder if it covers the artifact, else as many more as needed."""
    n, rest = F.col("n"), F.col("n") % chunk
    crop = F.when(rest >= artifact, rest).otherwise(artifact + F.pmod(n - artifact, F.lit(chunk)))
    per = frames.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.count("*").alias("n")).select(*[f"_{c}" for c in by], crop.alias("_crop"))
    same = F.lit(True)
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    both = frames.join(per, same) if by else frames.crossJoin(F.broadcast(per))  # one row
    return both.where("frame >= _crop").withColumn("frame", F.col("frame") - F.col("_crop")).drop("_crop", *[f"_{c}" for c in by])


def stacks(frames: DataFrame, size: int = 7000, by: tuple[str, ...] = ()) -> DataFrame:
    """The stacks of `size` frames each of every session (`by`): chunk, its name `k_of_N` counted from 1 (k with two digits at least), and its frames."""
    two = lambda c: F.when(c < 10, F.concat(F.lit("0"), c.cast("string"))).otherwise(c.cast("string"))
    per = frames.groupBy(*by, F.floor(F.col("frame") / size).alias("chunk")).agg(F.count("*").alias("n_frames"), F.min("frame").alias("first_frame"))
    total = frames.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.ceil(F.count("*") / size).alias("total"))
    same = F.lit(True)
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    both = per.join(total, same) if by else per.crossJoin(F.broadcast(total))  # one row
    return both.select(*by, "chunk", F.concat(two(F.col("chunk") + 1), F.lit("_of_"), F.col("total").cast("string")).alias("name"), "n_frames", "first_frame")


def write_stacks(frames: DataFrame, path: str, size: int = 7000, by: tuple[str, ...] = ("channel", "plane")) -> None:
    """Writes stacks as Parquet folders by `by` and the stack's name `k_of_N`; frames of a stack meet in one file, in order."""
    chunked = frames.withColumn("_chunk", F.floor(F.col("frame") / size))
    named = beside(chunked, stacks(frames, size, by).select(*by, F.col("chunk").alias("_chunk"), F.col("name").alias("stack")), [*by, "_chunk"]).drop("_chunk")
    named.repartition(*by, "stack").sortWithinPartitions(*by, "stack", "frame").write.partitionBy(*by, "stack").parquet(path)


def pixel_rows(frames: DataFrame, width: int) -> DataFrame:
    """(frame, y, x, value): a row for each pixel."""
    p = frames.select("frame", F.posexplode("pixels").alias("i", "value"))
    return p.select("frame", F.floor(F.col("i") / width).alias("y"), (F.col("i") % width).cast("long").alias("x"), "value")


def _with(frames: DataFrame, by: tuple[str, ...], more: str) -> StructType:
    return StructType([*[frames.schema[c] for c in by], *StructType.fromDDL(more).fields])


def _summed(frames: DataFrame, width: int, block: tuple[int, int, int] | None, how: str = "sum", by: tuple[str, ...] = ()) -> DataFrame:
    """(by, frame, y, x, value, n): packed images reduced in each task by blocks, and those partial images by aggregation."""
    z, rows, columns = block or (0, 1, 1)
    fold, nought = {"sum": (np.add, 0.0), "max": (np.maximum, -np.inf), "min": (np.minimum, np.inf)}[how]
    names = [*by, "frame", "y", "x", "value", "n"]
    schema = _with(frames, by, "frame long,y long,x long,value double,n long")

    def told(held, kinds):
        for (key, f, n), (v, known) in held.items():
            i = np.flatnonzero(known)
            keys = [pa.array([k] * len(i), t) for k, t in zip(key, kinds)]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(np.full(len(i), f)), pa.array(i // width // rows), pa.array(i % width // columns), pa.array(v[i]), pa.array(known[i])], names=names)
        held.clear()

    def reduce(batches):
        held: dict[tuple, list[np.ndarray]] = {}
        kinds: list[pa.DataType] = []
        for batch in batches:
            kinds = [batch.schema.field(c).type for c in by]
            keys = list(zip(*[batch.column(c).to_pylist() for c in by])) if by else [()] * batch.num_rows
            for key, f, v in zip(keys, batch.column("frame").to_pylist(), packed.rows(batch, "pixels")):
                known = ~np.isnan(v)
                v = np.where(known, v, nought)
                at = (key, f // z if z else 0, len(v))
                if at in held:
                    fold(held[at][0], v, out=held[at][0])
                    held[at][1] += known
                else:
                    held[at] = [v, known.astype(np.int64)]
                    if len(held) > HELD:
                        yield from told(held, kinds)
        yield from told(held, kinds)

    parts = frames.where("pixels is not null" + (" and frame is not null" if z else "")).select(*by, F.coalesce(F.col("frame").cast("long"), F.lit(0)).alias("frame"), "pixels")
    return parts.mapInArrow(reduce, schema).groupBy(*by, "frame", "y", "x").agg(getattr(F, how)("value").alias("value"), F.sum("n").alias("n"))


def mean_image(frames: DataFrame, width: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, y, x, value): mean of each pixel over the frames: tasks sum whole images, a row for each pixel and task is shuffled."""
    return _summed(frames, width, None, by=by).select(*by, "y", "x", (F.col("value") / F.col("n")).alias("value"))


def grouped(frames: DataFrame, width: int, block: tuple[int, int, int], how: str = "mean", by: tuple[str, ...] = ()) -> DataFrame:
    """(by, frame, y, x, value): blocks of (frames, rows, columns) reduced to whole numbers (cut towards 0): mean, sum, max, min or median; what a partial block lacks counts as 0."""
    z, y, x = block
    whole = z * y * x
    if how == "median":
        return reduced(frames, width, block, np.median, by)
    parts = _summed(frames, width, block, "sum" if how == "mean" else how, by)
    value = F.col("value") / whole if how == "mean" else F.col("value")
    if how in ("max", "min"):
        value = F.when(F.col("n") < whole, (F.greatest if how == "max" else F.least)(value, F.lit(0.0))).otherwise(value)
    return parts.select(*by, "frame", "y", "x", value.cast("long").alias("value"))


def grouped_mean(frames: DataFrame, width: int, block: tuple[int, int, int], by: tuple[str, ...] = ()) -> DataFrame:
    """The blocks' means."""
    return grouped(frames, width, block, by=by)


def percentile_rescaled(frames: DataFrame, low: float, high: float, by: tuple[str, ...] = ()) -> DataFrame:
    """Pixels clipped at two percentiles of all pixels of the stack and mapped to 0..255; the percentiles come from a histogram of values."""
    counts = frames.select(*by, F.explode("pixels").alias("v")).groupBy(*by, "v").agg(F.count("*").alias("n"))
    cut = counts.groupBy(*by).agg(F.expr(f"percentile(v, {low / 100!r}, n)").alias("lo"), F.expr(f"percentile(v, {high / 100!r}, n)").alias("hi"))
    scale = lambda v: F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.try_divide((v - F.col("lo")) * 255.0, F.col("hi") - F.col("lo"))))
    return beside(frames, cut, list(by), "left" if by else "inner").withColumn("pixels", F.transform("pixels", scale)).drop("lo", "hi")


def normalised(frames: DataFrame, whole: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """Each frame minus its least pixel, over the largest of what is left; with `whole` by the extremes of all frames of the stack. Flat input becomes nulls."""
    low, high = F.array_min("pixels"), F.array_max("pixels")
    if whole:
        ends = frames.groupBy(*by).agg(F.min(low).alias("_low"), F.max(high).alias("_high"))
        frames, low, high = beside(frames, ends, list(by)), F.col("_low"), F.col("_high")
    return frames.withColumn("pixels", F.transform("pixels", lambda v: F.try_divide((v - low).cast("double"), (high - low).cast("double")))).drop("_low", "_high")


class _Masks:
    """Regions as a compressed sparse matrix: their pixels and weights one behind the other."""

    def __init__(self, table: pa.Table) -> None:
        table = table.sort_by([("roi", "ascending"), ("pixel", "ascending")])
        roi = table.column("roi").combine_chunks()
        self.pixel, self.weight = table.column("pixel").to_numpy().astype(np.int64), table.column("weight").cast(pa.float64()).to_numpy()
        codes = roi.dictionary_encode()
        first = np.flatnonzero(np.append(True, np.diff(codes.indices.to_numpy()) != 0)[: len(roi)])
        self.first, self.rois = first, roi.take(pa.array(first))

    def means(self, images: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weighted means of known pixels (images, regions), NaN where none is known; and which regions have pixels inside."""
        inside = self.pixel < images.shape[1]
        got = images[:, np.where(inside, self.pixel, 0)]
        known = inside & ~np.isnan(got)
        weight = np.where(known, self.weight, 0.0)
        total = np.add.reduceat(np.where(known, got, 0.0) * weight, self.first, axis=1)
        by = np.add.reduceat(weight, self.first, axis=1)
        some = np.add.reduceat(known, self.first, axis=1, dtype=np.int64)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where((some > 0) & (by != 0), total / by, np.nan), np.add.reduceat(inside, self.first, dtype=np.int64) > 0


def _trace_rows(masks: _Masks, frame: pa.Array, values: np.ndarray, at: np.ndarray) -> list[pa.Array]:
    """roi, frame, value of the frames of one stack, images of one size together."""
    size, out = np.diff(at), []
    for n in np.unique(size[size > 0]):
        own = np.flatnonzero(size == n)
        for k in range(0, len(own), max(1, (1 << 22) // max(1, len(masks.pixel)))):
            some = own[k : k + max(1, (1 << 22) // max(1, len(masks.pixel)))]
            images = values[(at[some][:, None] + np.arange(n)).ravel()].reshape(len(some), n)
            mean, there = masks.means(images)
            mean = mean[:, there].ravel()
            rois = masks.rois.filter(pa.array(there))
            out.append((rois.take(pa.array(np.tile(np.arange(len(rois)), len(some)))), frame.take(pa.array(np.repeat(some, len(rois)))), pa.array(mean, mask=np.isnan(mean))))
    return [pa.concat_arrays(c) for c in zip(*out)] if out else []


def region_traces(frames: DataFrame, regions: DataFrame, by: tuple[str, ...] = (), masks: int | None = None) -> DataFrame:
    """(by, roi, frame, value): weighted mean of each region's known pixels, null where none is; regions (by, roi, pixel, weight) meet the images of their stack.

    If regions has `overlap`, its pixels of that kind are left out; if it has `is_cell`, regions that are none.  Up to `masks` region pixels
    (1,048,576) are broadcast and gathered from packed images; of more, each stack's regions are dealt to its chunks of frames.
    """
    for column, keep in (("overlap", "not coalesce(overlap, false)"), ("is_cell", "is_cell = 1")):
        regions = regions.where(keep) if column in regions.columns else regions
    regions = regions.where("roi is not null and pixel >= 0").select(*by, "roi", "pixel", "weight")
    own = frames.where("pixels is not null").select(*by, "frame", "pixels")
    schema = StructType([*[frames.schema[c] for c in by], regions.schema["roi"], frames.schema["frame"], *StructType.fromDDL("value double").fields])
    masks = MASKS if masks is None else masks
    few = regions.limit(masks + 1).toArrow()  # a limit that tells the form apart; no region is left out
    if few.num_rows > masks:
        return _dealt_traces(own, regions, by, schema)
    keys = list(zip(*[few.column(c).to_pylist() for c in by])) if by else [()] * few.num_rows
    where: dict[tuple, list[int]] = {}
    for i, k in enumerate(keys):
        where.setdefault(k, []).append(i)
    shared = frames.sparkSession.sparkContext.broadcast({k: _Masks(few.take(pa.array(i))) for k, i in where.items()})

    def gather(batches):
        for batch in batches:
            stacks: dict[tuple, list[int]] = {}
            for i, k in enumerate(zip(*[batch.column(c).to_pylist() for c in by]) if by else [()] * batch.num_rows):
                stacks.setdefault(k, []).append(i)
            for key, i in stacks.items():
                if key in shared.value:
                    part = batch.take(pa.array(i)) if len(stacks) > 1 else batch
                    columns = _trace_rows(shared.value[key], part.column("frame"), *packed.flat(part.column("pixels")))
                    if columns:
                        yield pa.RecordBatch.from_arrays([*[pa.array([v] * len(columns[0]), batch.schema.field(c).type) for v, c in zip(key, by)], *columns], names=schema.names)

    return own.mapInArrow(gather, schema)


def _dealt_traces(own: DataFrame, regions: DataFrame, by: tuple[str, ...], schema: StructType, chunk: int = 512) -> DataFrame:
    """Frames by chunk, each with a copy of its stack's regions; a task holds a chunk and the regions of one stack."""
    dealt = own.withColumn("_chunk", F.coalesce(F.floor(F.col("frame") / chunk), F.lit(-1)))
    chunks = dealt.select(*by, "_chunk").distinct()
    copies = beside(chunks, regions, list(by)) if by else chunks.crossJoin(regions)  # a stack's regions for each of its chunks

    def gather(left: pa.Table, right: pa.Table) -> pa.Table:
        columns = _trace_rows(_Masks(right), left.column("frame").combine_chunks(), *packed.flat(left.column("pixels"))) if left.num_rows and right.num_rows else []
        if not columns:
            return pa.table({n: pa.array([], left.schema.field(n).type if n in left.schema.names else right.schema.field(n).type if n in right.schema.names else pa.float64()) for n in schema.names})
        return pa.table({c: pa.array([left.column(c)[0].as_py()] * len(columns[0]), left.schema.field(c).type) for c in by} | dict(zip(("roi", "frame", "value"), columns)))

    keys = [*by, "_chunk"]
    copies = copies.select(*[F.col(c).alias(c) for c in copies.columns])  # columns of their own, where both tables come from one
    return dealt.groupBy(*keys).cogroup(copies.groupBy(*keys)).applyInArrow(gather, schema)


def neuropil_corrected(soma: DataFrame, around: DataFrame, share: float = 0.7, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, roi, frame, value): a region's trace minus a share of its surroundings' trace."""
    keys = [*by, "roi", "frame"]
    return beside(soma, around.select(*keys, F.col("value").alias("_around")), keys).select(*keys, (F.col("value") - share * F.col("_around")).alias("value"))


def median_filtered(frames: DataFrame, width: int, footprint: tuple[int, int, int] = (3, 3, 3), chunk: int = 512, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, frame, pixels): the median over an odd footprint of frames, rows and columns, edges mirrored with the edge repeated.

    Frames are dealt by stack and chunk, each with the frames beside it that its edges need, so a task holds a chunk.  Frame
    numbers of a stack are whole, each once and without gaps, and its images of one size without null pixels; else the job ends with an error.
    """
    if not all(k % 2 for k in footprint):
        raise ValueError("a footprint has odd sides")
    z, y, x = (k // 2 for k in footprint)
    own = F.floor(F.col("frame") / chunk)
    near = F.array_distinct(F.array(own, F.floor((F.col("frame") - z) / chunk), F.floor((F.col("frame") + z) / chunk)))
    dealt = frames.where("frame is not null and pixels is not null").select(*by, F.explode(near).alias("_chunk"), F.col("frame").cast("long").alias("frame"), "pixels")
    schema = _with(frames, by, "frame long,pixels array<double>")

    def median(table: pa.Table) -> pa.Table:
        table = table.sort_by("frame")
        at, c = table.column("frame").to_numpy(), table.column("_chunk")[0].as_py()
        inner = np.flatnonzero(at // chunk == c)
        if not len(inner):
            return pa.table({f: pa.array([], table.schema.field(f).type) for f in (*by, "frame")} | {"pixels": pa.array([], pa.list_(pa.float64()))})
        image = packed.volume(table, "pixels", width)
        if (np.diff(at) != 1).any() or np.isnan(image).any():
            raise ValueError("a median needs every frame of its stack once, and every pixel")
        low, high = inner[0], len(at) - 1 - inner[-1]
        wide = np.pad(image, ((z - min(z, low), z - min(z, high)), (y, y), (x, x)), "symmetric")[max(0, low - z) :]
        out = np.empty((len(inner), image[0].size))
        for k in range(len(inner)):
            views = np.lib.stride_tricks.sliding_window_view(wide[k : k + 2 * z + 1], (2 * z + 1, 2 * y + 1, 2 * x + 1))[0]
            out[k] = np.median(views.reshape(*views.shape[:2], -1), axis=-1).ravel()
        keys = {f: table.column(f).slice(0, 1).combine_chunks().take(pa.array(np.zeros(len(inner), np.int64))) for f in by}
        return pa.table(keys | {"frame": pa.array(at[inner]), "pixels": packed.lists(out)})

    return dealt.groupBy(*by, "_chunk").applyInArrow(median, schema)


def reduced(frames: DataFrame, width: int, block: tuple[int, int, int], function: Callable[..., np.ndarray], by: tuple[str, ...] = ()) -> DataFrame:
    """As `grouped` with a function of a numpy array and the axes to reduce (np.median, np.ptp, ...), called once for a slab of block[0] frames.

    Slabs of packed frames meet in a task; missing and null pixels count as 0, blocks without a known pixel are left out.
    """
    z, rows, columns = block
    schema = _with(frames, by, "frame long,y long,x long,value long")

    def run(table: pa.Table) -> pa.Table:
        values, at = packed.flat(table.column("pixels"))
        size, place = np.diff(at), table.column("frame").to_numpy() % z
        high = -(-int(size.max()) // width)
        tall, wide = -(-high // rows) * rows, -(-width // columns) * columns
        slab, known = np.zeros((z, tall, wide)), np.zeros((z, tall, wide), bool)
        for k, (a, n) in enumerate(zip(at.tolist(), size.tolist())):
            own = np.full(-(-n // width) * width, np.nan)
            own[:n] = values[a : a + n]
            own = own.reshape(-1, width)
            there = ~np.isnan(own)
            slab[place[k], : len(own), :width][there] = own[there]
            known[place[k], : len(own), :width] |= there
        split = (z, tall // rows, rows, wide // columns, columns)
        value = np.trunc(function(slab.reshape(split), axis=(0, 2, 4))).astype(np.int64)
        i, j = np.nonzero(known.reshape(split).any(axis=(0, 2, 4)))
        first = pa.array(np.zeros(len(i), np.int64))
        keys = {f: table.column(f).slice(0, 1).combine_chunks().take(first) for f in by}
        return pa.table(keys | {"frame": table.column("_slab").slice(0, 1).combine_chunks().take(first), "y": pa.array(i), "x": pa.array(j), "value": pa.array(value[i, j])})

    dealt = frames.where("frame is not null and size(pixels) > 0").select(*by, F.floor(F.col("frame") / z).alias("_slab"), F.col("frame").cast("long").alias("frame"), "pixels")
    return dealt.groupBy(*by, "_slab").applyInArrow(run, schema)


def cell_diameters(rois: DataFrame, least: float = 10.0) -> DataFrame:
    """rois with `diameter` (twice the radius); `is_cell` becomes 0 where it is below `least`."""
    d = rois.withColumn("diameter", 2 * F.col("radius"))
    return d.withColumn("is_cell", F.when(F.col("diameter") < least, 0).otherwise(F.col("is_cell")))
