"""Ranks and running sums over groups of any size, the whole table included: no window holds more than a range of the order.

Rows are dealt by ranges of (group, order) and sorted, so a group may lie in many tasks.  Each task sums what it has of each group;
these sums, a row for each group and task, are added up along the tasks and handed back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import written
from .running import beside


def accumulated(df: DataFrame, by: list[str], order: list[Column], sums: dict[str, Column], parts: int | None = None) -> DataFrame:
    """df with, for each name of `sums`, the sum of its column over the rows of the group up to and with each row, in order.

    `order` are columns that rise along it (take -c for a falling one).  Rows of one group should differ in them, else their order is open.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [f"_o{i}" for i in range(len(order))]
    own = df.select("*", *[o.alias(k) for o, k in zip(order, keys)], *[c.alias(f"_v{i}") for i, c in enumerate(sums.values())])
    dealt = own.repartitionByRange(parts, *[F.col(c) for c in by], *[F.col(k) for k in keys]).sortWithinPartitions(*by, *keys)
    table = written(dealt.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)))  # numbers follow the rows' order
    totals = table.groupBy(*by, "_part").agg(*[F.sum(f"_v{i}").alias(f"_t{i}") for i in range(len(sums))])
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    offsets = totals.select(*by, "_part", *[F.sum(f"_t{i}").over(earlier).alias(f"_c{i}") for i in range(len(sums))])
    here = Window.partitionBy(*by, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    out = beside(table, offsets, [*by, "_part"])
    whole = [(F.coalesce(F.sum(f"_v{i}").over(here), F.lit(0)) + F.coalesce(F.col(f"_c{i}"), F.lit(0))).alias(name) for i, name in enumerate(sums)]
    return out.select(*[F.col(f"`{c}`") for c in df.columns], *whole)


def ranked(df: DataFrame, by: list[str], order: list[Column], name: str = "rank", parts: int | None = None) -> DataFrame:
    """df with `name`, the place of each row in its group, from 1."""
    return accumulated(df, by, order, {name: F.lit(1).cast("long")}, parts)
