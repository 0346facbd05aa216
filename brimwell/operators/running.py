"""Values carried along a session: running last values, running sums, neighbours.

Every function takes a key, the order within it, and optionally a `segment`: a column that never falls along the order
(say, the hour of the time).  Then one session is dealt by segment: windows run within segments, and what a segment hands on
to the next, one row for each, is joined back.  Without it a session is one task's work.  Null keys are a session of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def beside(df: DataFrame, per: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """df with the other columns of per, one row for each key; null keys meet null keys."""
    renamed = per.select(*[F.col(k).alias(f"_beside{i}") for i, k in enumerate(keys)], *[c for c in per.columns if c not in keys])
    if not keys:
        return df.crossJoin(F.broadcast(renamed))  # one row
    same = F.lit(True)
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_beside{i}"))
    return df.join(renamed, same, how).drop(*[f"_beside{i}" for i in range(len(keys))])


def _ordered(order: list[str], ahead: bool) -> list[Column]:
    return [F.col(o).desc() if ahead else F.col(o).asc() for o in order]


def _handed_on(d: DataFrame, key: str, per: Column, total: Column, ahead: bool) -> DataFrame:
    """d with `_carry`: `total` over `_own`, the value `per` of each segment, of all segments before (after)."""
    each = d.groupBy(key, "_segment").agg(per.alias("_own"))
    w = Window.partitionBy(key).orderBy(F.col("_segment").desc() if ahead else F.col("_segment").asc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = each.select(F.col(key).alias("_key"), F.col("_segment").alias("_part"), total.over(w).alias("_carry"))
    return d.join(carried, F.col(key).eqNullSafe(F.col("_key")) & F.col("_segment").eqNullSafe(F.col("_part")), "left").drop("_key", "_part", "_segment")


def running_last(df: DataFrame, key: str, order: list[str], value: Column, name: str, *, ahead: bool = False, segment: Column | None = None) -> DataFrame:
    """The last known value up to each row, or with `ahead` the first known from it on; null where there is none."""
    by = Window.partitionBy(key) if segment is None else Window.partitionBy(key, "_segment")
    d = df.withColumn("_value", value) if segment is None else df.withColumns({"_value": value, "_segment": segment})
    own = F.last("_value", ignorenulls=True).over(by.orderBy(*_ordered(order, ahead)).rowsBetween(Window.unboundedPreceding, 0))
    if segment is None:
        return d.withColumn(name, own).drop("_value")
    place = F.when(F.col("_value").isNotNull(), F.struct(*order))
    edge = F.min_by("_value", place) if ahead else F.max_by("_value", place)
    d = _handed_on(d.withColumn("_seen", own), key, edge, F.last("_own", ignorenulls=True), ahead)
    return d.withColumn(name, F.coalesce("_seen", "_carry")).drop("_value", "_seen", "_carry")


def running_sum(df: DataFrame, key: str, order: list[str], value: Column, name: str, *, segment: Column | None = None) -> DataFrame:
    """The sum of value over the rows before each row (0 at the first)."""
    by = Window.partitionBy(key) if segment is None else Window.partitionBy(key, "_segment")
    d = df.withColumn("_value", value) if segment is None else df.withColumns({"_value": value, "_segment": segment})
    own = F.coalesce(F.sum("_value").over(by.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if segment is None:
        return d.withColumn(name, own).drop("_value")
    d = _handed_on(d.withColumn("_seen", own), key, F.sum("_value"), F.sum("_own"), False)
    return d.withColumn(name, F.col("_seen") + F.coalesce("_carry", F.lit(0))).drop("_value", "_seen", "_carry")


def neighbour(df: DataFrame, key: str, order: list[str], value: Column, name: str, *, ahead: bool = False, segment: Column | None = None) -> DataFrame:
    """The value of the row before each row, or with `ahead` behind it; null at the edge."""
    boxed = F.struct(value.alias("v"))
    by = Window.partitionBy(key) if segment is None else Window.partitionBy(key, "_segment")
    d = df.withColumn("_value", boxed) if segment is None else df.withColumns({"_value": boxed, "_segment": segment})
    own = F.lag("_value").over(by.orderBy(*_ordered(order, ahead)))
    if segment is None:
        return d.withColumn(name, own["v"]).drop("_value")
    place = F.struct(*order)
    edge = F.min_by("_value", place) if ahead else F.max_by("_value", place)
    d = _handed_on(d.withColumn("_seen", own), key, edge, F.last("_own"), ahead)
    return d.withColumn(name, F.coalesce("_seen", "_carry")["v"]).drop("_value", "_seen", "_carry")
