"""Tables from the files of recordings: listings, frame metadata and stimulation protocols in XML, pose CSV, numeric arrays.

A session is the folder that a file lies in.  Fields that a file lacks are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ranks import ranked
from ..operators.running import beside
from .npy import NpyValues

VALUE = (
    "struct<_key: string, _value: string, IndexedValue: array<struct<_index: string, _value: double, _description: string>>, "
    "SubindexedValues: array<struct<_index: string, SubindexedValue: array<struct<_subindex: string, _value: double>>>>>"
)
SHARD = f"struct<PVStateValue: array<{VALUE}>>"


def _session() -> Column:
    return F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)


def listed(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(session, path) of the files below a folder that are not empty; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return files.select(F.element_at(F.split("path", "/"), -2).alias("session"), "path")


def _value(shard: str, key: str) -> Column:
    return F.try_element_at(F.filter(F.col(f"{shard}.PVStateValue"), lambda v: v["_key"] == key), F.lit(1))


def _position(shard: str, axis: str, place: int = 1) -> Column:
    """The place-th value of an axis; the z axis has two, of the objective and of the tunable lens."""
    own = F.try_element_at(F.filter(_value(shard, "positionCurrent")["SubindexedValues"], lambda v: v["_index"] == axis), F.lit(1))
    return F.try_element_at(own["SubindexedValue"], F.lit(place))["_value"]


def _power(shard: str, name: str, place: int | None = None) -> Column:
    """A laser's power by its description, or where no value is described so by its place."""
    values = _value(shard, "laserPower")["IndexedValue"]
    named = F.try_element_at(F.filter(values, lambda v: v["_description"] == name), F.lit(1))["_value"]
    return F.coalesce(named, F.try_element_at(values, F.lit(place))["_value"]) if place else named


def _gains(shard: str) -> Column:
    """Gains by description (or index), null where the shard names none."""
    entry = lambda v: F.struct(F.coalesce(v["_description"], v["_index"]).alias("k"), v["_value"].alias("v"))
    named = F.filter(F.transform(_value(shard, "pmtGain")["IndexedValue"], entry), lambda e: e["k"].isNotNull())
    return F.map_from_entries(F.filter(named, lambda e: F.get(F.filter(named, lambda o: o["k"] == e["k"]), F.lit(0)) == e))


def frame_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(session, volume, plane, index, relative_time, absolute_time, last_good_frame, frame_period, scan_line_period, x, y, z, etl_z,
    imaging_power, uncaging_power, gains map<string, double>, channels array<string>, is_default).

    A frame's own values stand before those of the recording; is_default tells that the frame period is the recording's.
    """
    read = spark.read.format("xml")
    frame = f"array<struct<_relativeTime: double, _absoluteTime: double, _index: long, File: array<struct<_channel: string, _channelName: string>>, ExtraParameters: struct<_lastGoodFrame: long>, PVStateShard: {SHARD}>>"
    rows = read.option("rowTag", "Sequence").schema(f"_cycle long, Frame {frame}").load(path).select(_session().alias("session"), F.col("_cycle").alias("volume"), F.posexplode("Frame").alias("plane", "f"))
    d = rows.withColumn("s", F.col("f.PVStateShard")).join(_whole(spark, path).select("session", "d"), "session", "left")
    number = lambda key: (_value("s", key)["_value"].cast("double"), _value("d", key)["_value"].cast("double"))
    at = lambda axis, place, name: F.coalesce(_position("s", axis, place), _position("d", axis, place)).alias(name)
    return d.select(
        "session", "volume", F.col("plane").cast("long").alias("plane"), F.col("f._index").alias("index"), F.col("f._relativeTime").alias("relative_time"), F.col("f._absoluteTime").alias("absolute_time"), F.col("f.ExtraParameters._lastGoodFrame").alias("last_good_frame"),
        F.coalesce(*number("framePeriod")).alias("frame_period"), F.coalesce(*number("scanLinePeriod")).alias("scan_line_period"), at("XAxis", 1, "x"), at("YAxis", 1, "y"), at("ZAxis", 1, "z"), at("ZAxis", 2, "etl_z"),
        F.coalesce(_power("s", "Imaging"), _power("d", "Imaging", 1)).alias("imaging_power"), F.coalesce(_power("s", "Uncaging"), _power("d", "Uncaging", 2)).alias("uncaging_power"),
        F.coalesce(_gains("s"), _gains("d")).alias("gains"), F.transform("f.File", lambda c: c["_channelName"]).alias("channels"), number("framePeriod")[0].isNull().alias("is_default"),
    )


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", "PVScan").schema(f"_date string, PVStateShard {SHARD}").load(path).select(_session().alias("session"), F.col("_date").alias("date"), F.col("PVStateShard").alias("d"))


def recording_settings(spark: SparkSession, path: str) -> DataFrame:
    """One row for each recording: (session, date, scan_mode, is_resonant, bit_depth, dwell_time, frame_period, frame_rate, scan_line_period, lines,
    pixels, resolution, microns_x, microns_y, objective, objective_mag, objective_na, zoom, averaging, sampling, imaging_power,
    uncaging_power, gain_red, gain_green, x, y, z, etl_z, z_device)."""
    text = lambda key: _value("d", key)["_value"]
    number = lambda key, kind="double": text(key).cast(kind)
    part = lambda key, k: F.try_element_at(_value("d", key)["IndexedValue"], F.lit(k))["_value"]
    fields = {
        "scan_mode": text("activeMode"), "is_resonant": F.contains(text("activeMode"), F.lit("Resonant")), "bit_depth": number("bitDepth", "int"), "dwell_time": number("dwellTime"),
        "frame_period": number("framePeriod"), "frame_rate": F.try_divide(F.lit(1.0), number("framePeriod")), "scan_line_period": number("scanLinePeriod"), "lines": number("linesPerFrame", "int"), "pixels": number("pixelsPerLine", "int"),
        "resolution": F.concat(text("linesPerFrame"), F.lit("x"), text("pixelsPerLine")), "microns_x": part("micronsPerPixel", 1), "microns_y": part("micronsPerPixel", 2),
        "objective": text("objectiveLens"), "objective_mag": number("objectiveLensMag"), "objective_na": number("objectiveLensNA"), "zoom": number("opticalZoom"), "averaging": number("rastersPerFrame", "int"),
        "sampling": number("resonantSamplesPerPixel", "int"), "imaging_power": _power("d", "Imaging", 1), "uncaging_power": _power("d", "Uncaging", 2), "gain_red": part("pmtGain", 1), "gain_green": part("pmtGain", 2),
        "x": _position("d", "XAxis"), "y": _position("d", "YAxis"), "z": _position("d", "ZAxis"), "etl_z": _position("d", "ZAxis", 2), "z_device": number("zDevice", "int"),
    }
    return _whole(spark, path).select("session", "date", *[c.alias(n) for n, c in fields.items()])


def recording_summary(frames: DataFrame, averaging: int = 1, settings: DataFrame | None = None) -> DataFrame:
    """(session, planes, volumes, frames, frame_rate, inter_frame_period, volume_period, frequency, x, y, is_objective_stack, is_etl_stack,
    channels): one row for each session of frame metadata, and with `settings` all of recording_settings that it lacks.

    The period between frames is the frame period, times the averaging where there is one plane; that of volumes is the frame period times the
    planes.  A stack is one of the objective (the lens) if the z (etl_z) of its first volume differ.
    """
    w = F.struct("volume", "plane")
    first = frames.groupBy("session").agg(F.min("volume").alias("_first"))
    own = beside(frames, first, ["session"])
    in_first = lambda c: F.count_distinct(F.when(F.col("volume") == F.col("_first"), F.col(c))) > 1
    n = own.groupBy("session").agg(
        F.countDistinct("plane").alias("planes"), F.countDistinct("volume").alias("volumes"), F.count("*").alias("frames"), F.min_by("frame_period", w).alias("period"), F.min_by("x", w).alias("x"), F.min_by("y", w).alias("y"),
        in_first("z").alias("is_objective_stack"), in_first("etl_z").alias("is_etl_stack"), F.min_by("channels", w).alias("channels"),
    )
    between = F.when(F.col("planes") == 1, F.col("period") * averaging).otherwise(F.col("period"))
    volume = F.col("period") * F.col("planes")
    whole = F.when(F.col("planes") == 1, between).otherwise(volume)
    out = n.select("session", "planes", "volumes", "frames", F.try_divide(F.lit(1.0), "period").alias("frame_rate"), between.alias("inter_frame_period"), volume.alias("volume_period"), F.try_divide(F.lit(1.0), whole).alias("frequency"), "x", "y", "is_objective_stack", "is_etl_stack", "channels")
    return out if settings is None else beside(out, settings.drop(*[c for c in out.columns if c != "session"]), ["session"], "left")


def acquisition_rate(spark: SparkSession, path: str) -> DataFrame:
    """(session, rate) of voltage recordings, in Hz."""
    d = spark.read.format("xml").option("rowTag", "Experiment").schema("Rate long").load(path)
    return d.select(_session().alias("session"), F.col("Rate").alias("rate"))


def plotted_signals(spark: SparkSession, path: str) -> DataFrame:
    """(session, name, channel) of the signals of a voltage recording whose channel is plotted."""
    d = spark.read.format("xml").option("rowTag", "Experiment").schema("SignalList struct<VRecSignalPerPlotGroup: array<struct<Name: string, Channel: long>>>, PlottedChannels struct<Channel: array<long>>").load(path)
    s = d.select(_session().alias("session"), F.explode("SignalList.VRecSignalPerPlotGroup").alias("s"), F.col("PlottedChannels.Channel").alias("plotted"))
    return s.where(F.array_contains("plotted", F.col("s.Channel"))).select("session", F.trim("s.Name").alias("name"), F.col("s.Channel").alias("channel"))


def stimulation_protocol(spark: SparkSession, path: str) -> DataFrame:
    """(session, experiment, repetitions, delay, interpoint, duration, points, repeat_time, trial_duration, repeat_frequency, targets): a row for each experiment, times in milliseconds."""
    point = "array<struct<_Index: long, _X: double, _Y: double>>"
    galvo = f"struct<_InitialDelay: double, _InterPointDelay: double, _Duration: double, _Points: string, Point: {point}>"
    d = spark.read.format("xml").option("rowTag", "PVMarkPointElement").schema(f"_Repetitions long, PVGalvoPointElement {galvo}").load(path)
    g = lambda c: F.col(f"PVGalvoPointElement.{c}")
    d = d.select(_session().alias("session"), g("_Points").alias("experiment"), F.col("_Repetitions").alias("repetitions"), g("_InitialDelay").alias("delay"), g("_InterPointDelay").alias("interpoint"), g("_Duration").alias("duration"), F.size(g("Point")).alias("points"), g("Point").alias("targets"))
    repeat = F.col("interpoint") + F.col("duration")
    return d.select("session", "experiment", "repetitions", "delay", "interpoint", "duration", "points", repeat.alias("repeat_time"), (repeat * F.col("repetitions")).alias("trial_duration"), F.try_divide(F.lit(1.0), repeat).alias("repeat_frequency"), "targets")


def protocol_durations(protocol: DataFrame) -> DataFrame:
    """protocol with `took`, seconds that an experiment's stimulation takes."""
    return protocol.withColumn("took", F.bround((F.col("duration") + F.col("interpoint")) * F.col("points") * F.col("repetitions") / 1000, 2))


def pose_points(spark: SparkSession, path: str) -> DataFrame:
    """(session, frame, x1, y1, likelihood1, x2, y2, likelihood2) of the newest file of each session; header lines are those without a number in front."""
    names = ("frame", "x1", "y1", "likelihood1", "x2", "y2", "likelihood2")
    d = spark.read.csv(path, schema=", ".join(f"{n} string" for n in names)).withColumns({"session": _session(), "file": F.col("_metadata.file_path")})
    d = d.where(F.col("frame").rlike(r"^\s*[0-9]+(\.0*)?\s*$"))
    newest = d.groupBy("session").agg(F.max("file").alias("file"))
    known = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c)
    return d.join(newest, ["session", "file"], "left_semi").select("session", F.col("frame").cast("double").cast("long").alias("frame"), *map(known, names[1:]))


def with_trials(pose: DataFrame, ids: DataFrame) -> DataFrame:
    """pose with `trial` from ids (session, frame, trial); a session's ids begin at 0 where their least is 1."""
    least = ids.groupBy("session").agg(F.min("trial").alias("least"))
    own = ids.join(least, "session").select("session", "frame", (F.col("trial") - F.when(F.col("least") == 1, 1).otherwise(0)).alias("trial"))
    return pose.join(own, ["session", "frame"])


def analog_table(spark: SparkSession, path: str) -> DataFrame:
    """A recording's CSV with its header, names without blanks around them, as doubles, and session and `row` in the order of the first column."""
    d = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True).withColumn("session", _session())
    names = [c for c in d.columns if c != "session"]
    d = d.select("session", *[F.col(f"`{c}`").cast("double").alias(c.strip()) for c in names])
    return d.withColumn("row", (F.row_number().over(Window.partitionBy("session").orderBy(names[0].strip())) - 1).cast("long"))


def array_values(spark: SparkSession, path: str, range_bytes: int | None = None) -> DataFrame:
    """(session, path, row, col, value) of numeric .npy files of one or two axes, read by ranges of rows; objects are refused."""
    spark.dataSource.register(NpyValues)
    read = spark.read.format("brimwell_npy")
    return (read.option("rangebytes", range_bytes) if range_bytes else read).load(path)


def integer_rows(spark: SparkSession, path: str) -> DataFrame:
    """(session, path, row, col, value long) of CSV files of whole numbers without a header; rows from 0 in the order of the file, blank lines left out, other text null."""
    place = F.col("_metadata.file_block_start")
    lines = spark.read.text(path).select(_session().alias("session"), F.col("_metadata.file_path").alias("path"), place.alias("_block"), "value").withColumn("_line", F.monotonically_increasing_id())
    rows = ranked(lines.where(F.trim("value") != ""), ["path"], [F.col("_block"), F.col("_line")], "row")
    cells = rows.select("session", "path", (F.col("row") - 1).alias("row"), F.posexplode(F.split("value", ",")).alias("col", "v"))
    number = F.expr("try_cast(trim(v) as double)")
    return cells.select("session", "path", "row", F.col("col").cast("long").alias("col"), F.when(number == F.floor(number), number.cast("long")).alias("value"))


def neuron_numbers(values: DataFrame) -> DataFrame:
    """(session, neuron) from array_values: the first column, whatever stands beside it."""
    return values.where("col = 0").select("session", F.col("value").cast("long").alias("neuron"))
