"""Catalogues of recordings from the names of their files: tables with a `path` and any keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .running import beside


def found(paths: DataFrame, path: str, *, ending: str | None = None, part: str | None = None) -> DataFrame:
    """Paths with an ending, or with a part in them."""
    for text, of in ((ending, "endswith"), (part, "contains")):
        paths = paths.where(getattr(F, of)(F.col(path), F.lit(text))) if text is not None else paths
    return paths


def catalogue(paths: DataFrame, path: str, keys: tuple[str, ...] = (), sizes: DataFrame | None = None) -> DataFrame:
    """(keys, channels, planes, frames) of recordings of one file for each frame, from the parts of their names between `_`.

    sizes (keys, height, width), one row for each recording (recording_settings has lines and pixels), adds these two, null where it has no row.
    channels: distinct parts with `Ch`; there are several planes if more than one part holds `Cycle00001`: then planes are those parts and
    frames the parts with `000001.ome`, for each channel; else frames are the parts with `Cycle00001` for each channel.
    """
    part = paths.select(*keys, F.explode(F.split(path, "_")).alias("part"))
    many = lambda text: F.count(F.when(F.contains("part", F.lit(text)), 1))
    n = part.groupBy(*keys).agg(F.countDistinct(F.when(F.contains("part", F.lit("Ch")), F.col("part"))).alias("channels"), many("Cycle00001").alias("cycle"), many("000001.ome").alias("first"))
    share = lambda c: F.try_divide(F.col(c), F.col("channels"))
    several = F.col("cycle") > 1
    out = n.select(*keys, "channels", F.when(several, F.floor(share("cycle"))).otherwise(1).cast("long").alias("planes"), F.floor(F.when(several, share("first")).otherwise(share("cycle"))).alias("frames"))
    return out if sizes is None else beside(out, sizes.select(*keys, "height", "width"), list(keys), "left")


def natural_key(path: str) -> Column:
    """Sorts numbers in names by their value (of up to 20 digits)."""
    runs = F.regexp_extract_all(F.col(path), F.lit("([0-9]+|[^0-9]+)"), F.lit(1))
    return F.transform(runs, lambda x: F.when(x.rlike("^[0-9]"), F.lpad(x, 20, "0")).otherwise(x))


def naturally_sorted(paths: DataFrame, folder: str, path: str) -> DataFrame:
    """paths with `place` (from 0) in the natural order of their folder, and `is_first`."""
    d = paths.withColumn("place", (F.row_number().over(Window.partitionBy(folder).orderBy(natural_key(path), path)) - 1).cast("long"))
    return d.withColumn("is_first", F.col("place") == 0)


def newest(paths: DataFrame, folder: str, path: str) -> DataFrame:
    """The last path by name of each folder."""
    return paths.groupBy(folder).agg(F.max(path).alias(path))


def stages(paths: DataFrame, folder: str, path: str, rules: list[tuple[str, str, int]]) -> DataFrame:
    """(folder, stage): the first rule (stage, pattern, least) of whose pattern the folder has `least` paths; else null."""
    n = paths.groupBy(folder).agg(*[F.count(F.when(F.col(path).rlike(pattern), 1)).alias(f"_{k}") for k, (_, pattern, _) in enumerate(rules)])
    stage = F.coalesce(*[F.when(F.col(f"_{k}") >= least, F.lit(name)) for k, (name, _, least) in enumerate(rules)])
    return n.select(folder, stage.alias("stage"))


def decoded(codes: str) -> Column:
    """Text from an array of byte codes (0 to 255) as UTF-8; bytes that are none become the replacement character, null codes and arrays give null."""
    two = lambda c: F.lpad(F.hex(c.cast("long")), 2, "0")
    whole = F.array_join(F.transform(codes, two), "")
    return F.when(~F.exists(codes, lambda c: c.isNull()), F.decode(F.unhex(whole), "UTF-8"))


def decoded_keys(table: str) -> Column:
    """A map with binary keys and values of any type as one with text keys; of keys that become one text the last in the map stays."""
    entry = lambda e: F.struct(F.decode(e["key"], "UTF-8").alias("key"), e["value"].alias("value"))
    entries = F.transform(F.map_entries(table), entry)
    last = lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda o: o["key"] == e["key"])
    return F.map_from_entries(F.filter(entries, last))
