"""Filters, baselines and smoothing of traces: tables (key columns, frame, value).

What built-in windows can say is said by them.  Other filters take a `segment`, a column that never falls along the frames:
then a trace is dealt by segments (operators/segments) and filtered in blocks.  Without it they run trace by trace in
`applyInArrow`, so that a trace has to fit in a task.  NaN counts as null; unknown values stay unknown and a filter sees the
known ones only.  Null keys are a trace of their own.  Empty tables give empty ones.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernels, segments
from .quantiles import exact_quantile
from .running import beside
from .traces import known


def by_trace(df: DataFrame, keys: list[str], frame: str, value: str, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """value replaced by kernel(the trace's known values in order of frame)."""
    own = df.select(*[c for c in df.columns if c != value], known(value).alias(value))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(frame)
        x = table.column(value).to_numpy()
        there = ~np.isnan(x)
        out = np.full(len(x), np.nan)
        out[there] = kernel(x[there]) if there.any() else []
        return table.set_column(table.schema.get_field_index(value), value, pa.array(out, mask=~there))

    return own.groupBy(*keys).applyInArrow(run, own.schema)


def low_passed(df: DataFrame, keys: list[str], frame: str, value: str, rate: float, cutoff: float, order: int = 2, segment: Column | None = None) -> DataFrame:
    """Zero-phase Butterworth low-pass."""
    b, a = kernels.butterworth(order, cutoff / (rate / 2))
    if segment is not None:
        return segments.recursive(df, keys, frame, value, segment, b, a)
    return by_trace(df, keys, frame, value, lambda x: kernels.zero_phase(b, a, x))


def polynomial_detrended(df: DataFrame, keys: list[str], frame: str, value: str, order: int = 4) -> DataFrame:
    """Value minus the least-squares polynomial of its trace."""
    return by_trace(df, keys, frame, value, lambda x: kernels.polynomial_removed(x, order))


def smoothed(df: DataFrame, keys: list[str], frame: str, value: str, sigma: float, segment: Column | None = None) -> DataFrame:
    """Gaussian smoothing along time, cut at four sigma, mirrored edges."""
    if segment is None:
        return by_trace(df, keys, frame, value, lambda x: kernels.gaussian(x, sigma))
    r = int(4 * sigma + 0.5)

    return segments.haloed(df, keys, frame, value, segment, r, lambda x, before, n, *_: kernels.gaussian(x, sigma)[before : before + n], extend=segments.mirrored_ends)


def smoothed_rates(df: DataFrame, session: list[str], neuron: str, frame: str, value: str, sigma: float, segment: Column | None = None) -> DataFrame:
    """Gaussian smoothing along time, over the largest value of any neuron in the frame; what is not above 0 becomes 0."""
    d = smoothed(df, [*session, neuron], frame, value, sigma, segment)
    top = d.groupBy(*session, frame).agg(F.max(value).alias("_top"))
    share = F.try_divide(F.col(value), F.col("_top"))
    return beside(d, top, [*session, frame]).withColumn(value, F.when(share.isNotNull(), F.greatest(share, F.lit(0.0)))).drop("_top")


def moving_mean(df: DataFrame, keys: list[str], frame: str, value: str, half: int, segment: Column | None = None) -> DataFrame:
    """Centred mean over 2 * half + 1 rows, fewer at the edges."""
    if segment is not None:
        return segments.haloed(df, keys, frame, value, segment, half, lambda x, before, n, *_: kernels.centred_mean(x, half)[before : before + n], compact=False)
    w = Window.partitionBy(*keys).orderBy(frame).rowsBetween(-half, half)
    return df.withColumn(value, F.avg(known(value)).over(w))


def fir_low_passed(df: DataFrame, keys: list[str], frame: str, value: str, rate: float, cutoff: float = 1.0, taps: int = 30, segment: Column | None = None) -> DataFrame:
    """`taps` taps run forward and backward over a trace, begun in the steady state of its ends, which are reflected; a rate of `cutoff` or less is left as it is."""
    if rate <= cutoff:
        return df.withColumn(value, known(value))
    w = kernels.windowed_sinc(taps, min(1.0, cutoff / (rate / 2)))
    if segment is None:
        return by_trace(df, keys, frame, value, lambda x: kernels.zero_phase(w, np.ones(1), x))
    both, halo, small = np.convolve(w, w[::-1]), taps - 1, 3 * taps + 1  # forward and backward are one symmetric filter, 29 samples to each side

    def kernel(x: np.ndarray, before: int, n: int, whole: bool, _) -> np.ndarray:
        return kernels.zero_phase(w, np.ones(1), x)[before : before + n] if whole else kernels.overlap_save(both, x)

    return segments.haloed(df, keys, frame, value, segment, halo, kernel, extend=segments.odd_ends, small=small)


def baseline(df: DataFrame, keys: list[str], frame: str, value: str, rate: float, *, how: str = "fir", cutoff: float = 1.0, share: float = 0.05, segment: Column | None = None) -> DataFrame:
    """(keys, f0): the 5th percentile of the low-passed trace, not below its least value.

    how: `fir`, 30 taps run both ways without the first known sample (above `cutoff` Hz, else unfiltered), or `mean`, a centred moving mean of a second.
    """
    quantile = lambda d: exact_quantile(d, keys, value, share, "f0") if segment is not None else d.groupBy(*keys).agg(F.percentile(value, F.lit(share)).alias("f0"))
    if how == "mean":
        return quantile(moving_mean(df, keys, frame, value, int(rate // 2), segment))
    first = df.where(known(value).isNotNull()).groupBy(*keys).agg(F.min(frame).alias("_first"))
    rest = beside(df.select(*keys, frame, value), first, keys).where(F.col(frame) > F.col("_first")).drop("_first")
    least = df.groupBy(*keys).agg(F.min(known(value)).alias("_least"))
    f0 = quantile(fir_low_passed(rest, keys, frame, value, rate, cutoff, segment=segment))
    return beside(f0, least, keys).select(*keys, F.greatest("f0", "_least").alias("f0"))


def relative_fluorescence(df: DataFrame, neuron: list[str], frame: str, value: str, rate: float, *, raw: DataFrame | None = None, tiff: str | None = None, component: tuple[str, int] | None = None, offset: float = 1e-4, how: str = "fir", segment: Column | None = None) -> DataFrame:
    """dF/F: (value - F0) / F0 after an offset was added, F0 by neuron over all tiffs, or by tiff if `tiff` is named (then not below 0).

    If `raw` traces are given the divisor is their F0.  `value` becomes dF/F; a divisor of 0 gives null.  component (column,
    number): only rows of that number count, in both tables.
    """
    keys = [*neuron, *([tiff] if tiff else [])]
    own = lambda t: t.where(F.col(component[0]) == component[1]) if component else t
    lifted = lambda t: own(t).withColumn(value, known(value) + offset)
    clamp = lambda c: F.greatest(c, F.lit(0.0)) if tiff else c
    level = lambda t, name: baseline(t, keys, frame, value, rate, how=how, segment=segment).select(*keys, clamp(F.col("f0")).alias(name))
    d = lifted(df)
    out = beside(d, level(d, "_f0"), keys)
    by = F.col("_f0")
    if raw is not None:
        out, by = beside(out, level(lifted(raw), "_raw"), keys), F.col("_raw")
    return out.withColumn(value, F.try_divide(F.col(value) - F.col("_f0"), by)).drop("_f0", "_raw")


def diffused(df: DataFrame, keys: list[str], frame: str, value: str, *, times: int = 5, kappa: float = 100.0, gamma: float = 0.15, option: int = 1, scaled: bool = False, segment: Column | None = None) -> DataFrame:
    """Edge-preserving diffusion along time: x += gamma * (m - m before), with m = g(d) * d of the step d to the next sample (0 at the end).

    g: 1, exp(-(d/k)^2); 2, 1 / (1 + (d/k)^2); 3, ((1 - (d/(k sqrt 2))^2)^2) / 2, or 0 beyond k sqrt 2.  scaled: kappa times the trace's range.
    Without a segment a window for each time over one partitioning, fit for a few times; with it one pass in which each block
    takes `times` samples of its neighbours along.
    """
    if segment is not None:
        step = lambda x, before, n, _, spread: kernels.diffused(x, times, kappa * (spread or 0.0) if scaled else kappa, gamma, option)[before : before + n]
        return segments.haloed(df, keys, frame, value, segment, times, step, compact=False)
    w = Window.partitionBy(*keys).orderBy(frame)
    d = df.withColumn(value, known(value))
    whole = Window.partitionBy(*keys)
    d = d.withColumn("_k", F.lit(kappa) * (F.max(value).over(whole) - F.min(value).over(whole)) if scaled else F.lit(kappa))
    for _ in range(times):
        d = d.withColumn("_d", F.coalesce(F.lead(value).over(w) - F.col(value), F.lit(0.0)))
        d = d.withColumn("_m", _conduction(F.col("_d"), F.col("_k"), option) * F.col("_d"))
        d = d.withColumn(value, F.col(value) + gamma * (F.col("_m") - F.coalesce(F.lag("_m").over(w), F.lit(0.0))))
    return d.drop("_k", "_d", "_m")


def _conduction(d: Column, k: Column, option: int) -> Column:
    r = F.coalesce(F.try_divide(d, k), F.lit(0.0))
    if option == 1:
        return F.exp(-r * r)
    if option == 2:
        return 1 / (1 + r * r)
    half = r * r / 2
    return F.when(half <= 1, (1 - half) * (1 - half) / 2).otherwise(0.0)
