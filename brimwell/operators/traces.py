"""Trace operators: tables (session or neuron key, order columns, value) in, DataFrames out.

Windows are partitioned by the trace's key.  Null and NaN values are unknown: aggregates skip them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .running import neighbour, running_sum


def known(value: str) -> Column:
    """NaN as null."""
    return F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))


def filled(df: DataFrame, value: str) -> Column:
    """The value of any type, NaN as null."""
    return F.when(~F.isnan(F.col(value)), F.col(value)) if df.schema[value].dataType.typeName() in ("float", "double") else F.col(value)


def numbered(df: DataFrame, key: str, order: list[str], name: str = "frame", segment: Column | None = None) -> DataFrame:
    """Frames from 0 along each trace."""
    if segment is not None:
        return running_sum(df, key, order, F.lit(1).cast("long"), name, segment=segment)
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1).cast("long"))


def rising_edges(df: DataFrame, key: str, order: list[str], value: str, step: float = 1.0, segment: Column | None = None) -> DataFrame:
    """Rows whose value is more than `step` above the one before; beside an unknown value there is no edge."""
    d = neighbour(df, key, order, known(value), "_before", segment=segment)
    return d.withColumn("rise", known(value) - F.col("_before")).drop("_before").where(F.col("rise") > step)


def binned(df: DataFrame, key: str, frame: str, value: str, size: int, how: str = "avg") -> DataFrame:
    """avg or sum of each bin of `size` frames; an incomplete last bin is dropped."""
    n = df.groupBy(key, F.floor(F.col(frame) / size).alias("bin")).agg(getattr(F, how)(known(value)).alias("value"), F.count("*").alias("n"))
    return n.where(F.col("n") == size).select(key, "bin", "value")


def mean_rate(df: DataFrame, key: str, value: str) -> DataFrame:
    """Mean of the known values of each trace."""
    return df.groupBy(key).agg(F.avg(known(value)).alias("mean_rate"))


def standardised_noise(df: DataFrame, key: str, order: list[str], value: str, rate: float, whole: bool = False) -> DataFrame:
    """Median absolute difference of neighbouring frames over the square root of the frame rate, per trace or over all (differences never cross traces)."""
    step = F.abs(known(value) - F.lag(known(value)).over(Window.partitionBy(key).orderBy(*order)))
    steps = df.withColumn("step", step)
    scaled = lambda c: (c / F.sqrt(F.lit(rate))).alias("noise")
    if whole:
        from .quantiles import exact_quantile  # which takes unknown values from here

        return exact_quantile(steps, [], "step", 0.5).select(scaled(F.col("quantile")))
    return steps.groupBy(key).agg(scaled(F.median("step")))


def covariance(vectors: DataFrame, values: str, width: int) -> DataFrame:
    """Sample covariance (i <= j) of the positions of a packed vector: each task sums products of its vectors, a row for each pair is shuffled.

    Vectors that are null, of another width or hold an unknown value are left out.
    """
    own = vectors.select(F.transform(values, lambda x: x.cast("double")).alias("v")).where((F.size("v") == width) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x)))

    def sums(batches):
        shift, n, total, square = None, 0, np.zeros(width), np.zeros((width, width))
        for batch in batches:
            x = batch.column("v").flatten().to_numpy().reshape(-1, width)
            if len(x):
                shift = x[0].copy() if shift is None else shift
                n, total, square = n + len(x), total + (x - shift).sum(axis=0), square + (x - shift).T @ (x - shift)
        if n:
            mean = total / n
            centred = square - n * np.outer(mean, mean)
            i, j = np.triu_indices(width)
            full = mean + shift
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(np.full(len(i), n)), pa.array(full[i]), pa.array(full[j]), pa.array(centred[i, j])], names=["i", "j", "n", "a", "b", "c"])

    parts = own.mapInArrow(sums, "i int, j int, n long, a double, b double, c double")
    n, a, b = F.sum("n"), F.sum(F.col("n") * F.col("a")), F.sum(F.col("n") * F.col("b"))
    whole = F.sum(F.col("c") + F.col("n") * F.col("a") * F.col("b")) - a * b / n
    return parts.groupBy("i", "j").agg(F.when(n > 1, whole / (n - 1)).alias("cov"))


def step_distance(df: DataFrame, key: str, order: list[str], x: str, y: str, segment: Column | None = None) -> DataFrame:
    """Euclidean distance from the point before; 0 at the first and where either point is unknown."""
    d = neighbour(df, key, order, F.struct(known(x).alias("x"), known(y).alias("y")), "_before", segment=segment)
    step = lambda c, b: known(c) - F.col(f"_before.{b}")
    return d.withColumn("distance", F.coalesce(F.hypot(step(x, "x"), step(y, "y")), F.lit(0.0))).drop("_before")


def rescaled(df: DataFrame, value: str, old: tuple[float, float], new: tuple[float, float] = (0.0, 140.0)) -> DataFrame:
    """Linear rescale from one range to another."""
    return df.withColumn(value, (F.col(value) - old[0]) * ((new[1] - new[0]) / (old[1] - old[0])) + new[0])


def mean_zero(df: DataFrame, key: str, value: str) -> DataFrame:
    """Value minus its trace's mean: an aggregation joined back, so a long trace is no single task's work."""
    means = df.groupBy(F.col(key).alias("_key")).agg(F.avg(known(value)).alias("_mean"))
    return df.join(means, F.col(key).eqNullSafe(F.col("_key"))).withColumn(value, F.col(value) - F.col("_mean")).drop("_key", "_mean")


def firing_rate(df: DataFrame, probability: str, rate: float) -> DataFrame:
    """Spikes a second from the probability of a spike in a frame."""
    return df.withColumn("firing_rate", known(probability) * rate)
