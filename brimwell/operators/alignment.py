"""Operators that put recordings of one session on one time line, and choose rows of it.

Times are whole milliseconds (`t_ms`), keys are session columns.  Offsets and counts are aggregations joined back, one row for each session.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .recordings import nearest_filled
from .running import beside, neighbour, running_last, running_sum
from .traces import known, rising_edges

_COMPARISON = re.compile(r"\s*(<=|>=|==|!=|<|>|=)\s*(-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|'[^']*')\s*$")


def _condition(column: str, predicate) -> Column:
    c = F.col(column)
    if isinstance(predicate, str):
        m = _COMPARISON.match(predicate)
        if not m:
            raise ValueError(f"not a comparison: {predicate!r}")
        value = F.lit(m[2][1:-1] if m[2][0] == "'" else float(m[2]) if re.search("[.eE]", m[2]) else int(m[2]))
        return {"<": c < value, "<=": c <= value, ">": c > value, ">=": c >= value, "=": c == value, "==": c == value, "!=": c != value}[m[1]]
    if isinstance(predicate, Iterable):
        return c.isin(*predicate)
    return c == predicate


def selected(df: DataFrame, conditions: list[tuple[str, object]], order: list[str] | None = None) -> DataFrame:
    """Rows that meet all conditions, columns by name, sorted by `order` if given.

    A condition is (column, predicate): a comparison as text (">= 3", "!= 'a'"), a list of values, or a value.
    """
    for column, predicate in conditions:
        df = df.where(_condition(column, predicate))
    return (df.orderBy(*order) if order else df).select(*sorted(df.columns))


def kept_neurons(traces: DataFrame, cells: DataFrame, neuron: str = "neuron") -> DataFrame:
    """Rows of the neurons that cells names; if it has `is_cell`, of those that are."""
    own = cells.where("is_cell = 1") if "is_cell" in cells.columns else cells
    return traces.join(own.select(neuron), neuron, "left_semi")


def flipped(df: DataFrame, gate: str) -> DataFrame:
    """A 0/1 gate whose 1 means triggered, from one whose 0 does."""
    return df.withColumn(gate, 1 - F.col(gate))


def indicators_swapped(df: DataFrame, trials: DataFrame, key: str, order: list[str], first: str, second: str) -> DataFrame:
    """Swaps two indicator columns in sessions whose first has more rising edges than trials (key, n_trials) says; sessions without trials have none."""
    edges = rising_edges(df, key, order, first).groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_edges"))
    due = edges.join(trials.select(F.col(key).alias("_due"), "n_trials"), F.col("_key").eqNullSafe(F.col("_due")), "left")
    swap = due.where(F.col("_edges") > F.coalesce("n_trials", F.lit(0))).select("_key", F.lit(True).alias("_swap"))
    d = df.join(swap, F.col(key).eqNullSafe(F.col("_key")), "left")
    return d.withColumns({first: F.when(F.col("_swap"), F.col(second)).otherwise(F.col(first)), second: F.when(F.col("_swap"), F.col(first)).otherwise(F.col(second))}).drop("_key", "_swap")


def on_grid(grid: DataFrame, channels: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """The rows of the grid with a column for each channel (keys, value); null where a channel has no row."""
    for name, channel in channels.items():
        grid = beside(grid, channel.select(*keys, F.col("value").alias(name)), keys, "left")
    return grid


def with_stimulus(df: DataFrame, trials: DataFrame, key: str, order: list[str], trial_set: str = "trial_set", segment: Column | None = None) -> DataFrame:
    """`stimulus` by row: at the first row of a trial set its stimulus from trials (key, trial, stimulus), at the session's first row the
    number of distinct stimuli ("none"), else the last one."""
    n = trials.groupBy(key).agg(F.countDistinct("stimulus").alias("_none"))
    head = df.groupBy(key).agg(F.min(F.struct(*order)).alias("_head"))
    d = beside(beside(neighbour(df, key, order, F.col(trial_set), "_before", segment=segment), head, [key]), n, [key], "left")
    own = trials.where("trial is not null").select(key, F.col("trial").alias(trial_set), F.col("stimulus").alias("_stimulus"))
    d = beside(d, own, [key, trial_set], "left")
    first = ~F.col("_before").eqNullSafe(F.col(trial_set))
    mark = F.when(F.struct(*order) == F.col("_head"), F.col("_none")).when(first, F.col("_stimulus"))
    return running_last(d, key, order, mark, "stimulus", segment=segment).drop("_before", "_head", "_none", "_stimulus")


def recording_shift(timeline: DataFrame, recording: DataFrame, key: str, state: str, trial: str, signal: str, level: float = 3.3) -> DataFrame:
    """(key, shift, began): rows by which the recording's first trial is ahead of the timeline's, and the timeline's first time.

    timeline has `row` and t_ms, recording has `row`.  The recording's trial begins in the row behind its first rise of over 1; a session
    whose signal is below `level` there, or that lacks a trial, has no shift.
    """
    edge = rising_edges(recording, key, ["row"], signal).groupBy(key).agg(F.min(F.struct("row", signal)).alias("e"))
    edge = edge.where(F.col(f"e.{signal}") >= level).select(key, F.col("e.row").alias("edge"))
    begin = timeline.groupBy(key).agg(F.min(F.when(F.col(state) == trial, F.col("row"))).alias("begin"), F.min("t_ms").alias("began")).where("begin is not null")
    return beside(edge, begin, [key]).select(key, (F.col("edge") - F.col("begin")).cast("long").alias("shift"), "began")


def recording_aligned(timeline: DataFrame, recording: DataFrame, shifts: DataFrame, key: str, signals: list[str], rate: int = 1000) -> DataFrame:
    """The timeline with the recording's signals at its times: its row r stands at (r - shift) / rate seconds behind the first time; rows outside are dropped, times without a row are null."""
    at = beside(recording, shifts, [key])
    t = F.col("began") + F.bround((F.col("row") - F.col("shift")) * 1000 / rate).cast("long")
    at = at.where("row >= shift").select(key, t.alias("t_ms"), *signals)
    return beside(timeline, at, [key, "t_ms"], "left")


def frames_aligned(timeline: DataFrame, frames: DataFrame, recording: DataFrame, shifts: DataFrame, key: str, rate: int = 1000, name: str = "imaging_frame", how: str = "nearest", segment: Column | None = None) -> DataFrame:
    """The timeline with frame numbers at their times, and `filled_<name>`.

    frames is (key, frame, relative_time in seconds); their zero is the recording's `time_ms` in the row `shift`.  Frames before the first time are dropped.
    """
    zero = beside(recording, shifts, [key]).where("row = shift").select(key, "began", (F.col("time_ms") / rate).alias("zero"))
    t = F.col("began") + F.bround((F.col("relative_time") - F.col("zero")) * 1000).cast("long")
    at = beside(frames, zero, [key]).withColumn("t_ms", t).where("t_ms >= began").groupBy(key, "t_ms").agg(F.min("frame").alias(name))
    both = beside(timeline, at, [key, "t_ms"], "left")
    return nearest_filled(both, key, "t_ms", ["t_ms"], name, f"filled_{name}", how, segment)


def downsampled_aligned(timeline: DataFrame, frames: DataFrame, key: str, factor: int = 3, artifact: int = 1000, chunk: int = 7000, frame: str = "imaging_frame", name: str = "downsampled_frame", segment: Column | None = None) -> DataFrame:
    """The timeline with numbers of down-sampled frames at the times of their middle frames, and `filled_<name>`.

    Of a session's frames (key, frame), every `factor`-th is one; leading ones are cropped so that the rest is whole chunks (see without_artifact).
    The ones that are left and stand on the timeline are numbered from 0.
    """
    n = F.ceil(F.count("*") / factor)
    crop = F.when(n % chunk >= artifact, n % chunk).otherwise(artifact + F.pmod(n - artifact, F.lit(chunk)))
    d = beside(timeline, frames.groupBy(key).agg(crop.cast("long").alias("_crop")), [key], "left")
    begin = F.col("_crop") * factor
    middle = (F.col(frame) >= begin) & (F.pmod(F.col(frame) - begin, F.lit(factor)) == min(1, factor - 1))
    d = d.withColumn("_hit", F.coalesce(middle, F.lit(False)))
    d = running_sum(d, key, ["t_ms"], F.col("_hit").cast("long"), "_before", segment=segment)
    d = d.withColumn(name, F.when(F.col("_hit"), F.col("_before"))).drop("_hit", "_crop", "_before")
    return nearest_filled(d, key, "t_ms", ["t_ms"], name, f"filled_{name}", segment=segment)


def pose_aligned(timeline: DataFrame, pose: DataFrame, key: str, points: dict[str, str], stage: str = "stage", trial: str = "trial", segment: Column | None = None) -> DataFrame:
    """The timeline with pose columns, nearest filled within each (stage, trial).

    pose is (key, stage, trial, frame, columns); the n samples of a trial lie evenly between the trial's first and last time, rounded to
    milliseconds (of samples that meet on one, the later).  What stays unknown gets the session's largest value (`max`), or the number that `points` names for its column.
    """
    by = [key, stage, trial]
    pose = pose.where(F.col(stage).isNotNull() & F.col(trial).isNotNull())
    ends = timeline.groupBy(*by).agg(F.min("t_ms").alias("_low"), F.max("t_ms").alias("_high"))
    count = pose.groupBy(*by).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*by).orderBy("frame")
    at = pose.withColumn("_k", F.row_number().over(w) - 1)
    at = beside(beside(at, ends, by), count, by)
    t = F.col("_low") + F.bround((F.col("_high") - F.col("_low")) * F.col("_k") / F.greatest(F.col("_n") - 1, F.lit(1))).cast("long")
    at = at.groupBy(*by, t.alias("t_ms")).agg(*[F.max_by(known(c), "_k").alias(c) for c in points])
    d = beside(timeline, at, [*by, "t_ms"], "left").withColumn("_by", F.when(F.col(stage).isNotNull() & F.col(trial).isNotNull(), F.struct(*by)))
    for c in points:
        d = nearest_filled(d, "_by", "t_ms", ["t_ms"], c, c, segment=segment)
    most = d.groupBy(F.col(key).alias("_key")).agg(*[F.max(c).alias(f"_max_{c}") for c, fill in points.items()])
    d = d.join(most, F.col(key).eqNullSafe(F.col("_key")), "left")
    filled = {c: F.coalesce(c, F.col(f"_max_{c}") if fill == "max" else F.lit(float(fill))) for c, fill in points.items()}
    return d.withColumns(filled).drop("_by", "_key", *[f"_max_{c}" for c in points])


def voltage_signals(signals: DataFrame, plotted: DataFrame) -> DataFrame:
    """Signals (name, channel) whose channel is among the plotted ones, names without blanks around them."""
    return signals.join(plotted.select("channel"), "channel", "left_semi").withColumn("name", F.trim("name"))


def plane_times(frames: DataFrame, key: str) -> DataFrame:
    """(key, plane, times): the relative times of each plane over the volumes, in order; a last volume of another number of planes than the one before is dropped.

    frames is (key, volume, plane, relative_time).  A plane's times are one row, bounded by a session's volumes.
    """
    w = Window.partitionBy(key).orderBy("volume")
    per = frames.groupBy(key, "volume").agg(F.count("*").alias("n")).withColumns({"before": F.lag("n").over(w), "last": F.lead("volume").over(w).isNull()})
    torn = per.where("last and before is not null and n <> before").select(key, "volume", F.lit(True).alias("_torn"))
    whole = beside(frames, torn, [key, "volume"], "left").where("_torn is null")
    return whole.groupBy(key, "plane").agg(F.transform(F.array_sort(F.collect_list(F.struct("volume", "relative_time"))), lambda x: x["relative_time"]).alias("times"))


def first_plane_placed(frames: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The first plane of each volume takes the position of the second; a sole plane keeps its own."""
    w = Window.partitionBy(*keys).orderBy("plane")
    second = {c: F.when(F.row_number().over(w) == 1, F.coalesce(F.lead(c).over(w), F.col(c))).otherwise(F.col(c)) for c in columns}
    return frames.withColumns(second)


def reference_frames(frames: DataFrame, many: int, frame: str = "frame", by: tuple[str, ...] = ()) -> DataFrame:
    """`many` evenly spaced frames of each stack (`by`), by rank: those at floor(i * n / m) of n, with m = min(many, n).

    Frame numbers are those of a stack without gaps, from any number on.
    """
    per = frames.groupBy(*by).agg(F.count("*").alias("_n"), F.min(frame).alias("_first"))
    d = beside(frames, per, list(by)).withColumns({"_m": F.least(F.lit(many), F.col("_n")), "_rank": F.col(frame) - F.col("_first")})
    place = F.ceil(F.col("_rank") * F.col("_m") / F.col("_n"))  # the least i with floor(i n / m) >= rank
    return d.where((F.floor(place * F.col("_n") / F.col("_m")) == F.col("_rank")) & (place < F.col("_m"))).drop("_n", "_m", "_first", "_rank")
