"""Edge rows and closed forms that the driver's tables do not hold."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from brimwell.operators import alignment, coloring, decoders, decoding, images, kernels, recordings, signals, tiles, timeline, traces

NAN = math.nan


def events(spark, rows):
    return spark.createDataFrame(rows, "s string, t long, v double")


def test_unknown_values_make_no_edges(spark):
    d = events(spark, [("a", 0, 1.0), ("a", 1, NAN), ("a", 2, 5.0), ("a", 3, 9.0), ("b", 0, None), ("b", 1, 3.0), (None, 0, 0.0), (None, 1, 2.0)])
    assert sorted((str(r.s), r.t) for r in traces.rising_edges(d, "s", ["t"], "v").collect()) == [("None", 1), ("a", 3)]
    assert traces.rising_edges(d.limit(0), "s", ["t"], "v").count() == 0


def test_sessions_without_known_likelihood_are_rejected(spark):
    d = events(spark, [("a", 0, NAN), ("a", 1, NAN), ("b", 0, 0.96), ("b", 1, NAN), ("c", 0, 0.95), (None, 0, 0.99)])
    assert {r.s for r in timeline.accepted_sessions(d, "s", ["v"], 0.95).collect()} == {"b", None}


def test_null_keys_and_pixels_stay(spark):
    d = events(spark, [(None, 0, 1.0), (None, 1, 3.0), ("a", 0, 2.0), ("a", 1, NAN)])
    assert sorted(str(r.v) for r in traces.mean_zero(d, "s", "v").collect()) == ["-1.0", "0.0", "1.0", "nan"]
    assert recordings.detrended(d, "s", "t", "v").count() == 4
    f = spark.createDataFrame([(0, [None, 10]), (1, [4, 2])], "frame long, pixels array<int>")
    r = spark.createDataFrame([(1, 0, 1.0), (1, 1, 1.0)], "roi long, pixel int, weight double")
    assert {x.frame: x.value for x in images.region_traces(f, r).collect()} == {0: 10.0, 1: 3.0}
    assert {(x.y, x.x): x.value for x in images.mean_image(f, 2).collect()} == {(0, 0): 4.0, (0, 1): 6.0}
    p = spark.createDataFrame([(1.0, 1.5), (3.0, 2.0), (100.0, None)], "t double, p double")
    m = decoding.regression_metrics(p, "t", "p").first()
    assert m.r2 == pytest.approx(1 - 0.625 / 1) and m.mae == pytest.approx(0.75)


@pytest.mark.parametrize("size", [None, 7])
def test_carried_values_by_brute_force(spark, size):
    segment = F.floor(F.col("t") / size) if size else None
    rng = np.random.default_rng(0)
    data = [(s, t, None if rng.random() < 0.7 else float(rng.integers(9))) for s in ("a", "b", None) for t in sorted(rng.choice(90, 30, replace=False).tolist())]
    d = events(spark, data)
    got = {(r.s, r.t): r.near for r in recordings.nearest_filled(d, "s", "t", ["t"], "v", "near", segment=segment).collect()}
    for s, t, _ in data:
        known = [(a, v) for k, a, v in data if k == s and v is not None]
        low, high = [x for x in known if x[0] <= t], [x for x in known if x[0] >= t]
        want = None if not low or not high else low[-1][1] if t - low[-1][0] <= high[0][0] - t else high[0][1]
        assert got[s, t] == want
    states = d.withColumn("state", F.when(F.col("v").isNull(), "trial").when(F.col("v") > 7, "rest").otherwise("wait"))
    sets = {(r.s, r.t): r.trial_set for r in recordings.trial_sets(states, "s", ["t"], "state", "trial", "rest", segment=segment).collect()}
    for s in ("a", "b", None):
        own = [(t, "trial" if v is None else "rest" if v > 7 else "wait") for k, t, v in data if k == s]
        last = max([t for t, x in own if x == "rest"], default=-1)
        n = 0
        for i, (t, x) in enumerate(own):
            assert sets[s, t] == (-1 if t <= last else n)
            n += x == "trial" and (i + 1 == len(own) or own[i + 1][1] != "trial")
    up = {(r.s, r.t) for r in traces.rising_edges(d.na.fill(0.0), "s", ["t"], "v", segment=segment).collect()}
    flat = [(s, t, v or 0.0) for s, t, v in data]
    assert up == {(s, t) for (s0, _, a), (s, t, b) in zip(flat, flat[1:]) if s0 == s and b - a > 1}


def test_a_session_of_a_million_rows(spark):
    d = spark.range(1_000_000).select(F.lit("a").alias("s"), F.col("id").alias("t"), F.when(F.col("id") % 50 == 0, F.col("id") * 1.0).alias("v"), F.when(F.col("id") % 900 < 500, "trial").otherwise("wait").alias("state"))
    began = time.time()
    assert recordings.nearest_filled(d, "s", "t", ["t"], "v", "n", segment=F.floor(F.col("t") / 50_000)).where("n is null").count() == 49
    assert recordings.trial_sets(d, "s", ["t"], "state", "trial", "rest").agg(F.max("trial_set")).first()[0] == 1111
    assert time.time() - began < 120


def test_filters_in_closed_form():
    b, a = kernels.butterworth(2, 0.1)
    assert b == pytest.approx([0.02008337, 0.04016673, 0.02008337], abs=1e-8) and a == pytest.approx([1, -1.56101808, 0.64135154], abs=1e-8)
    assert kernels.zero_phase(b, a, np.full(40, 3.0)) == pytest.approx(np.full(40, 3.0))
    t = np.arange(400)
    assert kernels.zero_phase(b, a, np.sin(t * 0.02))[50:-50] == pytest.approx(np.sin(t * 0.02)[50:-50], abs=2e-3)
    assert np.abs(kernels.zero_phase(b, a, np.sin(t * 2.5))[50:-50]).max() < 1e-3
    taps = kernels.windowed_sinc(30, 0.3)
    assert taps.sum() == pytest.approx(1) and taps == pytest.approx(taps[::-1])
    assert kernels.polynomial_removed(3 + 2 * t - 0.1 * t**2.0 + 1e-6 * t**4.0, 4) == pytest.approx(np.zeros(400), abs=1e-5)
    spike = kernels.gaussian(np.eye(1, 41, 20)[0], 2.0)
    assert spike.sum() == pytest.approx(1) and spike == pytest.approx(spike[::-1]) and spike[20] / spike[22] == pytest.approx(math.exp(0.5))
    assert kernels.gaussian(np.array([1.0]), 3.0) == pytest.approx([1.0]) and kernels.zero_phase(b, a, np.array([2.0])) == pytest.approx([2.0])


def test_traces_with_unknown_values(spark):
    d = events(spark, [("a", t, NAN if t == 5 else 2.0) for t in range(40)] + [("b", 0, NAN), ("c", 0, 7.0)])
    for out in (signals.low_passed(d, ["s"], "t", "v", 10.0, 1.0), signals.smoothed_rates(d, [], "s", "t", "v", 1.0)):
        got = {(r.s, r.t): r.v for r in out.collect()}
        assert len(got) == 42 and got["a", 5] is None and got["b", 0] is None and got["a", 6] is not None
    dff = {(r.s, r.t): r.v for r in signals.relative_fluorescence(d, ["s"], "t", "v", 6.0).collect()}
    assert dff["a", 3] == pytest.approx(0) and dff["a", 5] is None
    assert signals.relative_fluorescence(d.limit(0), ["s"], "t", "v", 6.0).count() == 0
    assert signals.diffused(d, ["s"], "t", "v", times=3, scaled=True).where("s = 'a' and t = 3").first().v == pytest.approx(2)


def test_diffusion_options_as_arrays(spark):
    x = np.random.default_rng(2).normal(0, 50, 60)
    for option in (1, 2, 3):
        y = x.copy()
        for _ in range(3):
            d = np.append(np.diff(y), 0)
            k = 100.0
            g = {1: np.exp(-((d / k) ** 2)), 2: 1 / (1 + (d / k) ** 2), 3: np.where(np.abs(d) <= k * 2**0.5, (1 - (d / (k * 2**0.5)) ** 2) ** 2 / 2, 0)}[option]
            m = g * d
            y = y + 0.15 * (m - np.append(0, m[:-1]))
        d = events(spark, [("a", i, float(v)) for i, v in enumerate(x)])
        got = signals.diffused(d, ["s"], "t", "v", times=3, option=option).orderBy("t").collect()
        assert [r.v for r in got] == pytest.approx(y.tolist())


@pytest.mark.parametrize("n", [0, 1, 5, 999, 1000, 7000, 8500, 15200])
def test_crop_leaves_whole_chunks(spark, n):
    f = spark.range(n).select(F.col("id").alias("frame"), F.array(F.lit(1)).alias("pixels"), F.lit("s").alias("session"))
    for by in ((), ("session",)):
        left = images.without_artifact(f, 1000, 7000, by).count()
        assert left % 7000 == 0 and n - left >= min(n, 1000)


def test_every_place_is_owned(spark):
    shapes = spark.createDataFrame([(n, 150, 40, 7) for n in (1, 149, 150, 151, 333)], "stack long, frames long, height long, width long")
    grid = tiles.tile_grid(shapes, (150, 20, 10), (60, 8, 4)).collect()
    for n in (1, 149, 150, 151, 333):
        own = [g for g in grid if g.stack == n]
        seen = np.zeros((150, 40, 7), int)
        for g in own:
            seen[g.own_s0 : g.own_s1, g.own_y0 : g.own_y1, g.own_x0 : g.own_x1] += 1
        assert seen.min() == 1 and max(g.x1 for g in own) == 7


def test_median_by_brute_force(spark):
    x = np.random.default_rng(1).integers(0, 99, (13, 5, 4))
    f = spark.createDataFrame([(i, v.ravel().tolist()) for i, v in enumerate(x)], "frame long, pixels array<int>")
    for foot in ((3, 3, 3), (5, 1, 3)):
        wide = np.pad(x, [(k // 2, k // 2) for k in foot], "symmetric")
        want = np.median(np.lib.stride_tricks.sliding_window_view(wide, foot), axis=(3, 4, 5))
        for chunk in (4, 100):
            got = {r.frame: r.pixels for r in images.median_filtered(f, 4, foot, chunk).collect()}
            assert np.array([got[i] for i in range(13)]).reshape(x.shape).tolist() == want.tolist()
    with pytest.raises(ValueError):
        images.median_filtered(f, 4, (2, 3, 3))


def test_selection_reads_only_comparisons(spark):
    d = events(spark, [("a", 0, 1.0), ("b", 1, 4.0), ("c", 2, None)])
    assert [r.t for r in alignment.selected(d, [("v", ">= 1"), ("s", ["b", "c"])]).collect()] == [1]
    assert alignment.selected(d, [("s", "!= 'a'")], ["t"]).columns == ["s", "t", "v"]
    with pytest.raises(ValueError):
        alignment.selected(d, [("v", "__import__('os')")])


def test_shift_of_a_session_that_lacks_a_trial(spark):
    line = spark.createDataFrame([("a", 0, "wait", 5), ("a", 1, "trial", 6), ("b", 0, "wait", 0), ("c", 0, "trial", 0)], "s string, row long, state string, t_ms long")
    rec = spark.createDataFrame([("a", 0, 0.0), ("a", 1, 0.0), ("a", 2, 3.3), ("b", 0, 0.0), ("b", 1, 5.0), ("c", 0, 0.0), ("c", 1, 3.2)], "s string, row long, signal double")
    shifts = alignment.recording_shift(line, rec, "s", "state", "trial", "signal")
    assert [tuple(r) for r in shifts.collect()] == [("a", 1, 5)]
    got = {r.t_ms: r.signal for r in alignment.recording_aligned(line, rec, shifts, "s", ["signal"]).where("s = 'a'").collect()}
    assert got == {5: 0.0, 6: 3.3}


def test_permutations_keep_their_rows(spark):
    d = spark.createDataFrame([(n, f, n * 100 + f) for n in range(3) for f in range(20)], "neuron long, frame long, v long")
    for by in ((), ("neuron",)):
        got = decoders.shuffled_frames(d, by=by).collect()
        assert sorted(r.v for r in got) == sorted(n * 100 + f for n in range(3) for f in range(20)) and sorted(r.frame for r in got) == sorted(list(range(20)) * 3)
        to = {(r.neuron, r.v % 100): r.frame for r in got}
        assert all(to[0, f] == to[1, f] for f in range(20)) == (not by)
    c = decoders.curves(spark.createDataFrame([("a", y, s) for y, s in [(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.1), (1, None)]], "split string, y int, s double"), "y", "s", "split").orderBy("fpr", "tpr").collect()
    assert [(r.tpr, r.fpr) for r in c] == [(0.5, 0.5), (1.0, 0.5), (1.0, 1.0)]
    assert decoders.chained(d, [(traces.mean_zero, {"key": "neuron", "value": "v"}), (None, None)]).count() == 60


def test_colors_and_masks(spark):
    f = spark.createDataFrame([(0, [0, 5, None, 10])], "frame long, pixels array<int>")
    grey = coloring.grey_to_rgb(f).first().pixels
    assert [p and p.r for p in grey] == [0, 127, None, 255]
    m = coloring.mask(spark.createDataFrame([(0, 1), (1, 1), (0, 1)], "y long, x long"), 2, 2)
    assert m.first().mask == [False, True, False, True]
    assert coloring.mask(spark.createDataFrame([], "y long, x long"), 1, 2).first().mask == [False, False]
    assert coloring.color_map([(0, 0, 0), (1, 0, 0.5)], 3) == [(0, 0, 0), (0.5, 0, 0.25), (1, 0, 0.5)]
    with pytest.raises(ValueError):
        coloring.background(f, "pink")


def test_covariance_of_shifted_vectors(spark):
    x = np.random.default_rng(3).normal(1e6, 1, (50, 5))
    d = spark.createDataFrame([(r.tolist(),) for r in x] + [(None,), ([1.0],), ([NAN] * 5,)], "v array<double>").repartition(3)
    got = {(r.i, r.j): r.cov for r in traces.covariance(d, "v", 5).collect()}
    want = np.cov(x.T)
    assert all(v == pytest.approx(want[k], abs=1e-3) for k, v in got.items()) and len(got) == 15
