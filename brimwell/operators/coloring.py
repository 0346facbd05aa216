"""Colouring of image stacks.  A frame is a row: frame long, pixels array<int>; a coloured one has pixels array<struct<r, g, b>> of 0..255.

Masks are arrays of one flag for each pixel of an image (a bounded row), so frames stay packed and nothing is joined pixel by pixel.
`by` names the columns that tell stacks apart (say session, channel, plane); each is coloured as if it were alone.
Null pixels stay null; a stack without a mask has no region.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .images import normalised, percentile_rescaled
from .running import beside

CHANNELS = ("r", "g", "b")


def _color(r: Column, g: Column, b: Column) -> Column:
    return F.struct(r.cast("int").alias("r"), g.cast("int").alias("g"), b.cast("int").alias("b"))


def _each(frames: DataFrame, f) -> DataFrame:
    return frames.withColumn("pixels", F.transform("pixels", lambda v: F.when(v.isNotNull(), f(v))))


def grey_to_rgb(frames: DataFrame, whole: bool = True, by: tuple[str, ...] = ()) -> DataFrame:
    """Pixels from their least to their largest value as grey 0..255 (cut), over all frames of the stack or each by itself."""
    return _each(normalised(frames, whole, by), lambda v: _color(*[F.floor(v * 255)] * 3))


def background(frames: DataFrame, option: str, cutoffs: tuple[float, float] = (0.0, 100.0), by: tuple[str, ...] = ()) -> DataFrame:
    """`black`, `white`, or `grey`: the frames rescaled between two percentiles."""
    if option in ("black", "white"):
        level = F.lit(0 if option == "black" else 255)
        return _each(frames, lambda v: _color(level, level, level))
    if option != "grey":
        raise ValueError(f"no such background: {option!r}")
    return grey_to_rgb(percentile_rescaled(frames, *cutoffs, by=by), by=by)


def color_map(colors: list[tuple[float, float, float]], entries: int = 256) -> list[tuple[float, float, float]]:
    """Linear interpolation between colours (parts 0..1)."""
    out = []
    for k in range(entries):
        at = k / (entries - 1) * (len(colors) - 1)
        i = min(int(at), len(colors) - 2) if len(colors) > 1 else 0
        a, b = colors[i], colors[min(i + 1, len(colors) - 1)]
        out.append(tuple(x + (y - x) * (at - i) for x, y in zip(a, b)))
    return out


def colorized(frames: DataFrame, table: list[tuple[float, float, float]], whole: bool = True, by: tuple[str, ...] = ()) -> DataFrame:
    """Pixels looked up in a colour table by their place between the least and the largest value."""
    entries = F.array(*[_color(*[F.lit(int(x * 255)) for x in color]) for color in table])
    n = len(table)
    return _each(normalised(frames, whole, by), lambda v: F.element_at(entries, (F.least(F.floor(v * n), F.lit(n - 1)) + 1).cast("int")))


def disk_pixels(rois: DataFrame, height: int, width: int) -> DataFrame:
    """(roi, y, x): distinct pixels within `radius` of (y0, x0), moved into the image where they are beyond its edge."""
    r = F.ceil("radius")
    d = rois.select("roi", "y0", "x0", "radius", F.explode(F.sequence(-r, r)).alias("dy"))
    d = d.select("*", F.explode(F.sequence(-F.ceil("radius"), F.ceil("radius"))).alias("dx")).where("dy * dy + dx * dx <= radius * radius")
    inside = lambda c, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), c)).cast("long")
    return d.select("roi", inside(F.col("y0") + F.col("dy"), height).alias("y"), inside(F.col("x0") + F.col("dx"), width).alias("x")).distinct()


def region_pixels(rois: DataFrame, height: int, width: int, soma: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, roi, y, x): distinct pixels of regions whose pixels are named (pixels array<struct<y, x, soma>>), with `soma` those of the soma alone; beyond the image they are left out."""
    p = rois.select(*by, "roi", F.inline("pixels"))
    p = p.where(F.col("soma")) if soma else p
    return p.where(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1)).select(*by, "roi", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x")).distinct()


def mask(pixels: DataFrame, height: int, width: int, by: tuple[str, ...] = ()) -> DataFrame:
    """`mask`, a flag for each pixel of an image, from (by, y, x): one row, or with `by` one for each stack that has pixels."""
    place = F.col("y") * width + F.col("x")
    if by:
        return pixels.where(place.between(0, height * width - 1)).groupBy(*by).agg(_flags(F.sort_array(F.collect_set(place.cast("int"))), height * width).alias("mask"))
    all_ = pixels.sparkSession.range(height * width).withColumnRenamed("id", "pixel")
    own = pixels.select(place.alias("pixel")).distinct().withColumn("on", F.lit(True))
    flags = F.array_sort(F.collect_list(F.struct("pixel", F.coalesce("on", F.lit(False)).alias("on"))))
    return all_.join(own, "pixel", "left").agg(F.transform(flags, lambda p: p["on"]).alias("mask"))


def _flags(places: Column, n: int) -> Column:
    """A flag for each of n places from those that are on, in order: between two of them lies a stretch of places that are off."""
    ends = F.concat(F.array(F.lit(-1)), places, F.array(F.lit(n)))
    off = F.zip_with(F.slice(ends, F.lit(1), F.size(ends) - 1), F.slice(ends, F.lit(2), F.size(ends) - 1), lambda a, b: F.concat(F.array_repeat(F.lit(False), b - a - 1), F.array(F.lit(True))))
    return F.slice(F.flatten(off), F.lit(1), F.lit(n))  # without the flag of the end


def only_regions(colored: DataFrame, masks: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Coloured frames with black outside the mask."""
    black = _color(F.lit(0), F.lit(0), F.lit(0))
    d = beside(colored, masks, list(by), "left" if by else "inner")  # a mask is a row of an image's size
    none = F.transform("pixels", lambda p: F.lit(False))
    return d.withColumn("pixels", F.zip_with("pixels", F.coalesce("mask", none), lambda p, on: F.when(on, p).otherwise(black))).drop("mask")


def blended(under: DataFrame, over: DataFrame, alpha: float = 0.5, by: tuple[str, ...] = ()) -> DataFrame:
    """alpha of the upper and the rest of the lower picture, frame by frame of each stack."""
    mix = lambda a, b: _color(*[F.bround((1 - alpha) * a[c] + alpha * b[c]) for c in CHANNELS])
    keys = [*by, "frame"]
    d = beside(under, over.select(*keys, F.col("pixels").alias("_over")), keys)
    return d.withColumn("pixels", F.zip_with("pixels", "_over", mix)).drop("_over")


def merged(under: DataFrame, subsets: list[tuple[DataFrame, DataFrame]], by: tuple[str, ...] = ()) -> DataFrame:
    """The lower picture with those of subsets (coloured frames, mask) at their masks; later ones win."""
    keys = [*by, "frame"]
    for over, own in subsets:
        d = beside(under, over.select(*keys, F.col("pixels").alias("_over")), keys, "left")
        d = beside(d, own, list(by), "left" if by else "inner")
        pairs = F.zip_with("_over", "mask", lambda p, on: F.when(on, p))
        under = d.withColumn("pixels", F.coalesce(F.zip_with("pixels", pairs, lambda a, b: F.coalesce(b, a)), "pixels")).drop("_over", "mask")
    return under
