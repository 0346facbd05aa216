"""Operators that line up recordings: nearest fills, trial sets, runs of frames, stimulation times, merged traces.

Every window is partitioned by the session's key.  Unknown values are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .running import neighbour, running_last, running_sum
from .traces import filled, known


def nearest_filled(df: DataFrame, key: str, time: str, order: list[str], value: str, name: str, how: str = "nearest", segment: Column | None = None) -> DataFrame:
    """Fills a sparse value: `forward` the last known, `backward` the next known, `nearest` the known value nearest in time (ties: the earlier;
    null before the first and after the last known one).  `time` is a number; NaN is not known."""
    known_value = filled(df, value)
    at = F.when(known_value.isNotNull(), F.struct(F.col(time).alias("t"), known_value.alias("v")))
    if how in ("forward", "backward"):
        return running_last(df, key, order, known_value, name, ahead=how == "backward", segment=segment)
    d = running_last(running_last(df, key, order, at, "_b", segment=segment), key, order, at, "_a", ahead=True, segment=segment)
    earlier = F.col(time) - F.col("_b.t") <= F.col("_a.t") - F.col(time)
    return d.withColumn(name, F.when(F.col("_b").isNotNull() & F.col("_a").isNotNull(), F.when(earlier, F.col("_b.v")).otherwise(F.col("_a.v")))).drop("_a", "_b")


def trial_sets(df: DataFrame, key: str, order: list[str], state: str, trial: str, rest: str, segment: Column | None = None) -> DataFrame:
    """Number of trial runs that ended before each row; -1 up to the last row of the resting state."""
    d = neighbour(df, key, order, F.col(state), "_next", ahead=True, segment=segment)
    end = ((F.col(state) == trial) & ~F.col("_next").eqNullSafe(trial)).cast("int")
    d = running_sum(d, key, order, end, "_ended", segment=segment)
    last = df.where(F.col(state) == rest).groupBy(F.col(key).alias("_key")).agg(F.max(F.struct(*order)).alias("_rest"))
    d = d.join(last, F.col(key).eqNullSafe(F.col("_key")), "left")
    resting = F.col("_rest").isNotNull() & (F.struct(*order) <= F.col("_rest"))
    return d.withColumn("trial_set", F.when(resting, -1).otherwise(F.col("_ended")).cast("long")).drop("_next", "_ended", "_key", "_rest")


def complete_sessions(edges: DataFrame, trials: DataFrame, key: str) -> DataFrame:
    """(key, edges, complete): whether a session has as many rising edges as trials; both counts may be 0."""
    found, due = edges.groupBy(key).agg(F.count("*").alias("edges")), trials.groupBy(key).agg(F.count("*").alias("due"))
    both = due.join(found, key, "left").withColumn("edges", F.coalesce("edges", F.lit(0)))
    return both.select(key, F.col("edges").cast("long").alias("edges"), (F.col("edges") == F.col("due")).alias("complete"))


def without_unknown_frames(traces: DataFrame, frame: str, value: str, *others: DataFrame):
    """Drops each frame in which any trace is null or NaN, from the traces and from any other tables by frame; a tuple if there are others."""
    bad = traces.where(known(value).isNull()).select(F.col(frame).alias("_bad")).distinct()
    out = tuple(t.join(bad, F.col(frame).eqNullSafe(F.col("_bad")), "left_anti") for t in (traces, *others))
    return out if others else out[0]


def spike_matrix(spikes: DataFrame, neurons: DataFrame, n_frames: int) -> DataFrame:
    """(neuron, frame, spike 0/1), dense: frames 0..n_frames-1 of every neuron."""
    dense = neurons.select("neuron", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_frames - 1).cast("long"))).alias("frame"))
    hit = spikes.select("neuron", "frame").distinct().withColumn("spike", F.lit(1))
    return dense.join(hit, ["neuron", "frame"], "left").withColumn("spike", F.coalesce("spike", F.lit(0)))


def trial_frames(df: DataFrame, key: str, frame: str, length: int, start: str = "after_gap", indicator: str | None = None, level: float = 3.3) -> DataFrame:
    """(key, trial, frame): each run of frames (gaps above 1 part runs) starts a trial of a fixed length.

    With `indicator` only rows in which it reaches `level` count.  start: `after_gap`, the first frame of the run, or `before_gap`, for
    all but the first run the last frame of the run before.
    """
    w = Window.partitionBy(key).orderBy(frame)
    df = df.where(F.col(indicator) >= level) if indicator else df
    d = df.select(key, frame).where(F.col(frame).isNotNull()).distinct().withColumn("_before", F.lag(frame).over(w))
    heads = d.where(F.col("_before").isNull() | (F.col(frame) - F.col("_before") > 1)).withColumn("trial", (F.row_number().over(w) - 1).cast("long"))
    first = F.coalesce("_before", frame) if start == "before_gap" else F.col(frame)
    return heads.select(key, "trial", F.explode(F.sequence(first, first + (length - 1))).alias("frame"))


def stimulation_schedule(df: DataFrame, key: str, name: str, delay: str, duration: str) -> DataFrame:
    """Onset and end of each stimulation, one after the other in the order of lower-cased names."""
    w = Window.partitionBy(key).orderBy(F.lower(name), name)
    end = F.sum(F.col(delay) + F.col(duration)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("end", end).withColumn("onset", F.col("end") - F.col(duration))


def stimulated(samples: DataFrame, spans: DataFrame, key: str, time: str, level: float = 5.0, segment: Column | None = None) -> DataFrame:
    """`level` at samples inside any span [begin, end) of their key, else 0.

    Begins, ends and samples are put in one order and open spans are counted along it, so overlapping or long
    spans cost no more than short ones.
    """
    marks = spans.where("begin < end").select(key, F.explode(F.array(F.struct(F.col("begin").alias("at"), F.lit(1).alias("d")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("d")))).alias("m"))
    marks = marks.select(key, F.col("m.at").alias("_at"), F.col("m.d").alias("_d"))
    both = samples.withColumn("_at", F.col(time)).withColumn("_d", F.lit(0)).unionByName(marks, allowMissingColumns=True)
    # at one time ends and begins come before samples: a span holds its begin and not its end
    both = both.withColumns({"_order": 1 - F.abs("_d"), time: F.col("_at")})  # segment is a column of the time
    both = running_sum(both, key, ["_at", "_order"], F.col("_d"), "_open", segment=segment)
    return both.where("_d = 0").withColumn("signal", F.when(F.col("_open") > 0, level).otherwise(0.0)).drop("_at", "_d", "_order", "_open")


def sampled_at(frames: DataFrame, samples: DataFrame, key: str, time: str, signal: str, segment: Column | None = None) -> DataFrame:
    """frames with `signal`, the known sample of their key nearest in time (ties: the earlier; before the first and behind the last that one).

    Both tables have key and time and are put in one order, so no frame meets all samples; segment is a column of the time.
    """
    marked = frames.withColumn("_s", F.lit(None).cast(samples.schema[signal].dataType)).withColumn("_frame", F.lit(True))
    both = marked.unionByName(samples.select(key, time, F.col(signal).alias("_s"), F.lit(False).alias("_frame")), allowMissingColumns=True)
    for how in ("nearest", "forward", "backward"):
        both = nearest_filled(both, key, time, [time, "_frame"], "_s", f"_{how}", how, segment)
    near = F.coalesce("_nearest", "_forward", "_backward").alias(signal)
    return both.where("_frame").select(*[F.col(f"`{c}`") for c in frames.columns if c != signal], near)


def median_of_five(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Each value becomes the median of five around it; beyond the ends of a key and where unknown they are 0."""
    w = Window.partitionBy(key).orderBy(*order)
    around = [F.coalesce(F.lag(known(value), k).over(w), F.lit(0.0)) for k in (-2, -1, 0, 1, 2)]
    return df.withColumn(value, F.sort_array(F.array(*around))[2])


def artifact_frames(frames: DataFrame, samples: DataFrame, key: str, time: str, signal: str, level: float = 1.0, segment: Column | None = None) -> DataFrame:
    """frames with `signal` from the nearest sample after a median of five, and `is_artifact`, whether it is above `level`."""
    d = median_of_five(sampled_at(frames, samples, key, time, signal, segment), key, [time], signal)
    return d.withColumn("is_artifact", F.col(signal) > level)


def merged_frames(lengths: DataFrame, traces: DataFrame, key: str, part: str, frame: str, component: tuple[str, int] | None = None) -> DataFrame:
    """Frames numbered through all parts of a key: frame plus the lengths of the parts before.  lengths is (key, part, length).

    component (column, number): only rows of that number are merged.
    """
    traces = traces.where(F.col(component[0]) == component[1]) if component else traces
    w = Window.partitionBy(key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    before = lengths.select(F.col(key).alias("_key"), F.col(part).alias("_part"), F.coalesce(F.sum("length").over(w), F.lit(0)).alias("_before"))
    same = F.col(key).eqNullSafe(F.col("_key")) & F.col(part).eqNullSafe(F.col("_part"))
    return traces.join(before, same).withColumn(frame, F.col(frame) + F.col("_before")).drop("_key", "_part", "_before")


def detrended(df: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """Value minus the least-squares line of its key; a key with one time keeps its mean-free value; unknown values stay and do not count."""
    own = df.withColumn("_known", known(value))
    line = own.groupBy(F.col(key).alias("_key")).agg(F.regr_slope("_known", time).alias("_s"), F.avg(F.when(F.col("_known").isNotNull(), F.col(time))).alias("_t"), F.avg("_known").alias("_v"))
    fit = F.col("_v") + F.coalesce("_s", F.lit(0.0)) * (F.col(time) - F.col("_t"))
    return own.join(line, F.col(key).eqNullSafe(F.col("_key"))).withColumn(value, F.col(value) - fit).drop("_known", "_key", "_s", "_t", "_v")


def confusion(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Rows of each pair of label and prediction, and their share of the label's rows."""
    n = df.groupBy(label, prediction).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(label)))
