import io

import numpy as np
import pytest

from brimwell.operators import coloring, files, images
from brimwell.sources import raw_frames, recordings

FRAME = '<Frame relativeTime="{t}" absoluteTime="{t}" index="{i}"><ExtraParameters lastGoodFrame="{i}"/><PVStateShard>{own}</PVStateShard></Frame>'
XML = """<?xml version="1.0"?><PVScan version="5"><PVStateShard><PVStateValue key="framePeriod" value="0.1"/><PVStateValue key="scanLinePeriod" value="0.002"/>
<PVStateValue key="positionCurrent"><SubindexedValues index="XAxis"><SubindexedValue subindex="0" value="5.5"/></SubindexedValues><SubindexedValues index="YAxis"><SubindexedValue subindex="0" value="-2"/></SubindexedValues></PVStateValue>
</PVStateShard>{seq}</PVScan>"""
OWN = '<PVStateValue key="framePeriod" value="0.2"/><PVStateValue key="positionCurrent"><SubindexedValues index="XAxis"><SubindexedValue subindex="0" value="7"/></SubindexedValues></PVStateValue>'


def test_frame_metadata_and_summary(spark, tmp_path):
    (tmp_path / "s1").mkdir()
    seq = "".join(f'<Sequence cycle="{c}">' + "".join(FRAME.format(t=c + p / 4, i=p + 1, own=OWN if (c, p) == (2, 1) else "") for p in range(2)) + "</Sequence>" for c in (1, 2, 3))
    (tmp_path / "s1/a.xml").write_text(XML.format(seq=seq))
    d = recordings.frame_metadata(spark, str(tmp_path / "s1"))
    got = {(r.volume, r.plane): r for r in d.collect()}
    assert len(got) == 6 and {r.session for r in got.values()} == {"s1"}
    assert (got[1, 0].frame_period, got[1, 0].x, got[1, 0].y, got[1, 0].is_default, got[1, 0].z) == (0.1, 5.5, -2.0, True, None)
    assert (got[2, 1].frame_period, got[2, 1].x, got[2, 1].y, got[2, 1].is_default, got[2, 1].relative_time, got[2, 1].last_good_frame) == (0.2, 7.0, -2.0, False, 2.25, 2)
    s = recordings.recording_summary(d).first()
    assert (s.planes, s.volumes, s.frames, s.frame_rate, s.volume_period) == (2, 3, 6, 10.0, 0.2) and s.frequency == pytest.approx(5)


WHOLE = """<?xml version="1.0"?><PVScan version="5" date="1/2/2020 3:04:05 PM"><PVStateShard><PVStateValue key="activeMode" value="ResonantGalvo"/><PVStateValue key="bitDepth" value="13"/>
<PVStateValue key="framePeriod" value="0.05"/><PVStateValue key="linesPerFrame" value="256"/><PVStateValue key="pixelsPerLine" value="512"/><PVStateValue key="objectiveLens" value="16X"/><PVStateValue key="objectiveLensNA" value="0.8"/>
<PVStateValue key="laserPower"><IndexedValue index="0" value="7" description="Pockels"/><IndexedValue index="1" value="3" description="Uncaging"/></PVStateValue>
<PVStateValue key="micronsPerPixel"><IndexedValue index="XAxis" value="1.5"/><IndexedValue index="YAxis" value="1.25"/></PVStateValue>
<PVStateValue key="pmtGain"><IndexedValue index="0" value="600" description="Red"/><IndexedValue index="1" value="700" description="Green"/></PVStateValue>
<PVStateValue key="positionCurrent"><SubindexedValues index="ZAxis"><SubindexedValue subindex="0" value="-5"/><SubindexedValue subindex="1" value="40"/></SubindexedValues></PVStateValue></PVStateShard>
<Sequence cycle="1">{frames}</Sequence></PVScan>"""


def test_powers_gains_lens_and_settings(spark, tmp_path):
    (tmp_path / "s").mkdir()
    own = '<PVStateValue key="laserPower"><IndexedValue index="0" value="9" description="Imaging"/></PVStateValue><PVStateValue key="pmtGain"><IndexedValue index="0" value="650" description="Red"/></PVStateValue><PVStateValue key="positionCurrent"><SubindexedValues index="ZAxis"><SubindexedValue subindex="0" value="-5"/><SubindexedValue subindex="1" value="80"/></SubindexedValues></PVStateValue>'
    frames = "".join(f'<Frame relativeTime="{k}" absoluteTime="{k}" index="{k}"><File channel="1" channelName="Ch1"/><File channel="2" channelName="Ch2"/><PVStateShard>{own if k else ""}</PVStateShard></Frame>' for k in (0, 1))
    (tmp_path / "s/a.xml").write_text(WHOLE.format(frames=frames))
    (tmp_path / "s/v.xml").write_text("<Root><Experiment><Rate>1000</Rate></Experiment></Root>")
    d = recordings.frame_metadata(spark, str(tmp_path / "s/a.xml"))
    a, b = sorted(d.collect(), key=lambda r: r.plane)
    assert (a.imaging_power, a.uncaging_power, a.gains, a.z, a.etl_z) == (7.0, 3.0, {"Red": 600.0, "Green": 700.0}, -5.0, 40.0)
    assert (b.imaging_power, b.uncaging_power, b.gains, b.z, b.etl_z, b.channels) == (9.0, 3.0, {"Red": 650.0}, -5.0, 80.0, ["Ch1", "Ch2"])
    settings = recordings.recording_settings(spark, str(tmp_path / "s/a.xml"))
    r = recordings.recording_summary(d, settings=settings).first()
    assert (r.objective, r.objective_na, r.resolution, r.microns_x, r.microns_y, r.bit_depth, r.is_resonant, r.gain_green, r.zoom, r.frame_rate) == ("16X", 0.8, "256x512", 1.5, 1.25, 13, True, 700.0, None, 20.0)
    assert (r.is_objective_stack, r.is_etl_stack, r.channels, r.planes) == (False, True, ["Ch1", "Ch2"], 2)
    names = spark.createDataFrame([("s", f"rec_Cycle0000{k}_Ch1_000001.ome.tif") for k in (1, 2)] + [("t", "rec_Cycle00001_Ch1_000001.ome.tif")], "session string, path string")
    sizes = settings.selectExpr("session", "lines height", "pixels width")
    assert {c.session: (c.frames, c.height, c.width) for c in files.catalogue(names, "path", ("session",), sizes).collect()} == {"s": (1, 256, 512), "t": (1, None, None)}
    assert recordings.acquisition_rate(spark, str(tmp_path / "s/v.xml")).first().rate == 1000


def test_bytes_to_text(spark):
    rows = [([*"aé\U0001f600".encode()], {b"k\xc3\xa9": 1}), ([], {}), (None, None), ([65, None], {b"a": 2})]
    d = spark.createDataFrame(rows, "codes array<int>, m map<binary, int>").select(files.decoded("codes").alias("t"), files.decoded_keys("m").alias("m"))
    assert [(r.t, r.m) for r in d.collect()] == [("aé\U0001f600", {"ké": 1}), ("", {}), (None, None), (None, {"a": 2})]


def test_named_pixels_of_regions(spark):
    rois = spark.createDataFrame([("s", 1, [(0, 0, True), (0, 1, False), (9, 0, True), (0, 0, True)]), (None, 1, [(1, 1, None)])], "session string, roi int, pixels array<struct<y: int, x: int, soma: boolean>>")
    pixels = lambda soma: sorted(map(str, ((r.session, r.roi, r.y, r.x) for r in coloring.region_pixels(rois, 2, 2, soma, ("session",)).collect())))
    assert pixels(False) == sorted(map(str, [("s", 1, 0, 0), ("s", 1, 0, 1), (None, 1, 1, 1)])) and pixels(True) == [str(("s", 1, 0, 0))]


def test_protocol(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s/p.xml").write_text('<PVMarkPointSeries><PVMarkPointElement Repetitions="4"><PVGalvoPointElement InitialDelay="50" InterPointDelay="10" Duration="15" Points="Group 1"><Point Index="1" X="0.5" Y="0.25"/><Point Index="2" X="0.1" Y="0.2"/></PVGalvoPointElement></PVMarkPointElement></PVMarkPointSeries>')
    r = recordings.protocol_durations(recordings.stimulation_protocol(spark, str(tmp_path / "s"))).first()
    assert (r.experiment, r.repetitions, r.points, r.repeat_time, r.trial_duration, r.repeat_frequency, r.took) == ("Group 1", 4, 2, 25.0, 100.0, 0.04, 0.2) and r.targets[1]["_X"] == 0.1


def test_plotted_signals(spark, tmp_path):
    (tmp_path / "s").mkdir()
    signal = "".join(f"<VRecSignalPerPlotGroup><Name> sig{k} </Name><Channel>{k}</Channel></VRecSignalPerPlotGroup>" for k in range(3))
    (tmp_path / "s/v.xml").write_text(f"<Root><Experiment><SignalList>{signal}</SignalList><PlottedChannels><Channel>0</Channel><Channel>2</Channel></PlottedChannels></Experiment></Root>")
    assert sorted((r.name, r.channel) for r in recordings.plotted_signals(spark, str(tmp_path / "s")).collect()) == [("sig0", 0), ("sig2", 2)]


def test_pose_and_trials(spark, tmp_path):
    (tmp_path / "s").mkdir()
    head = "scorer,a,a,a,b,b,b\nbodyparts,n,n,n,t,t,t\ncoords,x,y,likelihood,x,y,likelihood\n"
    (tmp_path / "s/1.csv").write_text(head + "0,9,9,9,9,9,9\n")
    (tmp_path / "s/2.csv").write_text(head + "0,1.5,2,0.99,3,4,NaN\n1,1,2,0.9,3,4,0.5\n")
    d = recordings.pose_points(spark, str(tmp_path / "s"))
    assert sorted((r.frame, r.x1, r.likelihood2) for r in d.collect()) == [(0, 1.5, None), (1, 1.0, 0.5)]
    ids = spark.createDataFrame([("s", 0, 1), ("s", 1, 2)], "session string, frame long, trial long")
    assert sorted((r.frame, r.trial) for r in recordings.with_trials(d, ids).collect()) == [(0, 0), (1, 1)]


def test_analog_and_arrays(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s/a.csv").write_text("Time(ms), TrialIndicator\n0,0.1\n1,3.4\n")
    got = recordings.analog_table(spark, str(tmp_path / "s/a.csv")).orderBy("row").collect()
    assert [(r.row, r["Time(ms)"], r.TrialIndicator) for r in got] == [(0, 0.0, 0.1), (1, 1.0, 3.4)]
    for name, x in (("i.npy", np.array([[4, 0], [7, 1]])), ("j.npy", np.arange(3))):
        b = io.BytesIO()
        np.save(b, x)
        (tmp_path / "s" / name).write_bytes(b.getvalue())
    v = recordings.array_values(spark, str(tmp_path / "s/*.npy"))
    assert sorted(r.neuron for r in recordings.neuron_numbers(v).collect()) == [0, 1, 2, 4, 7] and v.count() == 7


def test_catalogue_of_a_recording_of_four_planes(spark):
    """26,436 names: 4 planes of 6,609 frames, one channel."""
    from pyspark.sql import functions as F

    n = spark.range(26_436).select((F.floor(F.col("id") / 4) + 1).alias("c"), (F.col("id") % 4 + 1).alias("p"))
    name = F.format_string("rec_Cycle%05d_Ch2_%06d.ome.tif", "c", "p")
    assert tuple(files.catalogue(n.select(name.alias("path")), "path").first()) == (1, 4, 6609)
    one = spark.range(50).select(F.format_string("rec_Cycle00001_Ch2_%06d.ome.tif", F.col("id") + 1).alias("path"))
    assert tuple(files.catalogue(one.limit(1), "path").first()) == (1, 1, 1)
    assert files.catalogue(one.limit(0), "path").first().frames is None


def test_listing(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for n in ("x1.tif", "x10.tif", "x2.tif", "y.txt"):
        (tmp_path / "a" / n).write_text("x")
    d = recordings.listed(spark, str(tmp_path), "*.tif")
    assert d.count() == 3 and d.first().session == "a"
    assert [r.path[-7:].strip("/") for r in files.naturally_sorted(d, "session", "path").orderBy("place").collect()] == ["x1.tif", "x2.tif", "x10.tif"]


def test_raw_frames_round_trip(spark, tmp_path):
    x = np.random.default_rng(0).integers(0, 65536, (300, 4, 6)).astype("<u2")
    (tmp_path / "v.raw").write_bytes(x.tobytes())
    (tmp_path / "v.txt").write_text("300,4,6,uint16")
    spark.dataSource.register(raw_frames.RawFrames)
    d = spark.read.format("brimwell_raw").option("meta", str(tmp_path / "v.txt")).option("rangebytes", 4 * 6 * 2 * 70).load(str(tmp_path / "v.raw"))
    assert d.rdd.getNumPartitions() == 5
    got = d.orderBy("frame").collect()
    assert [r.frame for r in got] == list(range(300)) and (np.array([r.pixels for r in got]).reshape(x.shape) == x).all()
    none = spark.read.format("brimwell_raw").option("line", "0,4,6,uint16").load(str(tmp_path / "v.raw"))
    assert none.count() == 0


@pytest.mark.parametrize("dtype", ["uint16", "float32"])
def test_raw_folder_round_trip(spark, tmp_path, dtype):
    """Two channels and planes, a null session, gaps, nulls; written in 3 parts, read over many ranges."""
    rng = np.random.default_rng(1)
    rows = [(s, c, p, f, rng.integers(0, 60_000, 6).tolist()) for s in ("a b/c", None) for c in (1, 2) for p in (0, 1) for f in [*range(0, 25), *range(40, 52)]]
    d = spark.createDataFrame(rows + [("x", 1, 0, None, [1] * 6), ("x", 1, 0, 5, None), ("x", 1, 0, 6, [None, 2, 3, 4, 5, 6])], "session string, channel int, plane int, frame long, pixels array<int>")
    path, by = str(tmp_path / "out"), ("session", "channel", "plane")
    raw_frames.write_raw(d.repartition(7), path, 2, 3, dtype, 3, by=by, size=10)
    got = spark.read.format("brimwell_raw").option("rangebytes", 4 * 6 * np.dtype(dtype).itemsize).load(path)
    assert got.columns == [*by, "frame", "height", "width", "pixels"] and got.rdd.getNumPartitions() > 40
    want = {(s, c, p, f): x for s, c, p, f, x in rows} | {("x", 1, 0, 6): [0, 2, 3, 4, 5, 6]}
    assert {(r.session, r.channel, r.plane, r.frame): r.pixels for r in got.collect()} == want and got.count() == len(want)
    names = sorted(str(f.relative_to(tmp_path / "out")) for f in (tmp_path / "out").rglob("*.raw") if "channel=1/plane=0" in str(f) and "a%20b" in str(f))
    assert [n.rsplit("/", 1)[1] for n in names] == [f"0{k}_of_5.raw" for k in range(1, 6)]
    narrow = spark.read.schema("frame long, plane long").format("brimwell_raw").load(path)
    assert narrow.where("plane = 1").count() == 4 * 37
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    few = spark.read.format("brimwell_raw").option("rangebytes", 1).option("prune", "true").load(path).where("frame >= 41 and frame < 44 and plane = 1 and session = 'a b/c'")
    assert few.rdd.getNumPartitions() == 2 * 3 and few.count() == 6
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    with pytest.raises(Exception, match="overwrite"):
        raw_frames.write_raw(d, path, 2, 3, dtype, by=by)
    raw_frames.write_raw(d.where("channel = 2"), path, 2, 3, dtype, by=by, size=10, mode="overwrite")
    assert spark.read.format("brimwell_raw").load(path).count() == 4 * 37
    assert len(list((tmp_path / "out").rglob("*.raw"))) == 4 * 5 and not [f for f in (tmp_path / "out").iterdir() if f.name.startswith(".")]


def test_raw_writer_refuses_what_does_not_fit(spark, tmp_path):
    for k, (pixels, message) in enumerate([([1, 2], "must have"), ([1, 2, 70_000], "does not fit")]):
        with pytest.raises(Exception, match=message):
            raw_frames.write_raw(spark.createDataFrame([(0, pixels)], "frame long, pixels array<int>"), str(tmp_path / str(k)), 1, 3, "int16")
        assert not list((tmp_path / str(k)).rglob("*.raw"))
    raw_frames.write_raw(spark.createDataFrame([], "frame long, pixels array<int>"), str(tmp_path / "none"), 1, 3)
    assert spark.read.format("brimwell_raw").load(str(tmp_path / "none")).count() == 0


def test_stacks_round_trip(spark, tmp_path):
    rows = [(c, f, [f, c]) for c in (1, 2) for f in range(25 * c)]
    d = spark.createDataFrame(rows, "channel int, frame long, pixels array<int>")
    images.write_stacks(d, str(tmp_path / "s"), 10, ("channel",))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted((r.channel, r.frame, r.pixels) for r in back.collect()) == sorted(rows)
    assert {(r.channel, r.stack) for r in back.select("channel", "stack").distinct().collect()} == {(c, f"0{k}_of_{n}") for c, n in ((1, 3), (2, 5)) for k in range(1, n + 1)}
    assert len(list((tmp_path / "s").rglob("*.parquet"))) == 8


@pytest.mark.parametrize("order", ["C", "F"])
def test_arrays_are_read_by_ranges(spark, tmp_path, order):
    (tmp_path / "s").mkdir()
    x = np.random.default_rng(0).normal(size=(300, 7)).astype("<f4")
    np.save(tmp_path / "s/x.npy", np.asarray(x, order=order))
    d = recordings.array_values(spark, str(tmp_path / "s/x.npy"), 4 * 7 * 60)
    assert d.rdd.getNumPartitions() >= 5
    rows = d.collect()
    got = np.full(x.shape, np.nan)
    for r in rows:
        got[r.row, r.col] = r.value
    assert len(rows) == x.size and (got == x).all() and {r.session for r in rows} == {"s"}
    np.save(tmp_path / "s/o.npy", np.array([None, {}], object), allow_pickle=True)
    with pytest.raises(Exception, match="numbers of one or two axes"):
        recordings.array_values(spark, str(tmp_path / "s/o.npy")).count()
    np.save(tmp_path / "s/e.npy", np.zeros((0, 3)))
    assert recordings.array_values(spark, str(tmp_path / "s/e.npy")).count() == 0


def test_whole_numbers_without_a_header(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s/a.csv").write_text("".join(f"{k},{k * k}\n" for k in range(500)) + "\n 7 ,x\n")
    (tmp_path / "s/b.csv").write_text("5\n")
    rows = recordings.integer_rows(spark, str(tmp_path / "s/*.csv")).collect()
    got = {(r.path[-5:], r.row, r.col): r.value for r in rows}
    assert got == {("a.csv", k, c): v for k in range(500) for c, v in enumerate((k, k * k))} | {("a.csv", 500, 0): 7, ("a.csv", 500, 1): None, ("b.csv", 0, 0): 5} and {r.session for r in rows} == {"s"}
