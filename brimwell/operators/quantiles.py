"""Exact quantiles of groups of any size: distributed selection instead of all values of a group in one task.

Each pass counts, for every group, the values below, at and between two bounds around the wanted rank and draws closer bounds from a mergeable
sketch of those between.  The counts are exact, so the sketch decides the number of passes alone.  When at most `most` values
of each group are left between the bounds, their distinct values are counted and the ranks are read off.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import written
from .running import beside
from .traces import known

CELLS = 128
MOST = 1 << 16
LEAST = 64  # with fewer values than that between them bounds cannot come closer


def exact_quantile(df: DataFrame, keys: list[str], value: str, share: float, name: str = "quantile", most: int = MOST) -> DataFrame:
    """(keys, name): the value at place share * (n - 1) of the n known values of each group in order, between two values in proportion; null where none is known."""
    own, most = df.select(*keys, known(value).alias("_v")), max(most, LEAST)
    least, greatest = F.lit(float("-inf")), F.lit(float("inf"))
    state = None
    while True:
        rows = own.withColumns({"_lo": least, "_hi": greatest}) if state is None else beside(own, state.select(*keys, "_lo", "_hi"), keys)
        v = F.col("_v")
        between = (v > F.col("_lo")) & (v < F.col("_hi"))
        count = lambda c: F.coalesce(F.sum(F.when(c, 1)), F.lit(0)).cast("long")
        sketch = F.percentile_approx(F.when(between, v), [k / CELLS for k in range(CELLS + 1)], 100 * CELLS)
        told = rows.groupBy(*keys).agg(F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"), F.count("_v").alias("_n"), count(v < F.col("_lo")).alias("_below"), count(v == F.col("_lo")).alias("_at"), count(between).alias("_inside"), count(v <= F.col("_hi")).alias("_upto"), sketch.alias("_grid"))
        told = written(told)
        place = F.lit(share) * (F.col("_n") - 1)
        outside = (F.floor(place) < F.col("_below")) | (F.ceil(place) >= F.col("_upto"))
        state = told.agg(F.max("_inside").alias("most"), F.max(outside & (F.col("_n") > 0)).alias("lost")).first()
        if state.lost:
            raise ArithmeticError("a sketch was further off than it promises")
        if (state.most or 0) <= most:
            return _read_off(own, told, keys, share, name)
        state = _closer(told, share, most)


def _closer(told: DataFrame, share: float, most: int) -> DataFrame:
    """Bounds two ranks and a cell of the sketch to each side of the wanted ranks; groups of few values keep theirs."""
    place = F.lit(share) * (F.col("_n") - 1) - F.col("_below") - F.col("_at")
    cell = lambda rank, shift: F.least(F.greatest(F.floor(rank * CELLS / F.col("_inside")).cast("int") + shift, F.lit(0)), F.lit(CELLS))
    low, high = F.get("_grid", cell(place - 2, -1)), F.get("_grid", cell(place + 3, 2))
    narrow = (F.col("_inside") > most) & (place >= 0) & (place < F.col("_inside") - 1)
    edge = F.when(place < 0, F.struct(F.col("_lo").alias("a"), F.get("_grid", F.lit(0)).alias("b"))).otherwise(F.struct(F.get("_grid", F.lit(CELLS)).alias("a"), F.col("_hi").alias("b")))
    keep = F.struct(F.col("_lo").alias("a"), F.col("_hi").alias("b"))
    bounds = F.when(F.col("_inside") <= most, keep).when(narrow, F.struct(low.alias("a"), high.alias("b"))).otherwise(edge)
    return told.withColumn("_b", bounds).withColumns({"_lo": F.col("_b.a"), "_hi": F.col("_b.b")}).drop("_b")


def _read_off(own: DataFrame, told: DataFrame, keys: list[str], share: float, name: str) -> DataFrame:
    """Ranks among the distinct values from bound to bound: at most `most` + 2 for each group."""
    rows = beside(own, told.select(*keys, "_lo", "_hi"), keys).where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
    each = beside(rows.groupBy(*keys, "_v").agg(F.count("*").alias("_m")), told.select(*keys, "_n", "_below"), keys)
    upto = F.sum("_m").over(Window.partitionBy(*keys).orderBy("_v")) + F.col("_below")
    place = F.lit(share) * (F.col("_n") - 1)
    covers = lambda rank: F.min(F.when(F.col("_upto") > rank, F.col("_v")))
    found = each.withColumns({"_upto": upto, "_place": place}).groupBy(*keys).agg(covers(F.floor("_place")).alias("_a"), covers(F.ceil("_place")).alias("_b"), F.first("_place").alias("_p"))
    part = F.col("_p") - F.floor("_p")
    out = found.select(*keys, F.when(part == 0, F.col("_a")).otherwise((1 - part) * F.col("_a") + part * F.col("_b")).alias(name))
    return beside(told.select(*keys), out, keys, "left").select(*keys, name) if keys else out
