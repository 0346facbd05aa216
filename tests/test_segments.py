"""Traces in segments against the same filters over whole traces, and exact quantiles against numpy."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brimwell.operators import kernels, quantiles, segments, signals, traces

NAN = math.nan


def traces_of(spark, rng, lengths):
    rows = [(s, t, None if rng.random() < 0.05 else NAN if rng.random() < 0.05 else float(rng.normal() + t * 0.01), "own") for s, n in lengths.items() for t in range(n)]
    return spark.createDataFrame(rows, "s string, t long, v double, more string").repartition(3)


@pytest.mark.parametrize("size", [1, 7, 64, 5000])
def test_segments_give_what_whole_traces_give(spark, size):
    rng = np.random.default_rng(size)
    lengths = {"a": 400, "b": 1, "c": 2, "d": 92, "e": 91, "f": 30, None: 130} if size > 1 else {"a": 40, "b": 1, "c": 93, None: 11}
    d = traces_of(spark, rng, lengths)
    by = F.floor(F.col("t") / size)
    forms = {
        "low": lambda s: signals.low_passed(d, ["s"], "t", "v", 10.0, 1.0, segment=s),
        "order 3": lambda s: signals.low_passed(d, ["s"], "t", "v", 10.0, 0.7, 3, segment=s),
        "gaussian": lambda s: signals.smoothed(d, ["s"], "t", "v", 3.0, s),
        "fir": lambda s: signals.fir_low_passed(d, ["s"], "t", "v", 6.0, segment=s),
        "mean": lambda s: signals.moving_mean(d, ["s"], "t", "v", 3, s),
        "diffused": lambda s: signals.diffused(d, ["s"], "t", "v", times=5, kappa=2.0, option=2, scaled=True, segment=s),
    }
    for name, form in forms.items():
        whole, split = ({(r.s, r.t): (r.v, r.more) for r in form(s).collect()} for s in (None, by))
        assert whole.keys() == split.keys(), name
        for k, (v, more) in whole.items():
            assert more == "own" and (split[k][0] is None) == (v is None), (name, k)
            assert v is None or split[k][0] == pytest.approx(v, abs=1e-9), (name, k)


@pytest.mark.parametrize("block, size", [(1, 5000), (2, 1), (9, 7), (64, 5), (93, 5000)])
def test_blocks_of_any_size_give_what_whole_traces_give(spark, monkeypatch, block, size):
    monkeypatch.setattr(segments, "BLOCK", block)
    test_segments_give_what_whole_traces_give(spark, size)


def test_unknown_values_and_places(spark, monkeypatch):
    """Traces without a known value, unknown ends, null places (last), batches smaller than a block."""
    rows = [("none", t, None if t % 2 else NAN) for t in range(50)] + [("ends", t, float(t * t) if 20 <= t < 60 else None) for t in range(90)] + [("place", t, float(t % 7)) for t in range(60)] + [("place", None, 3.0)]
    d = spark.createDataFrame(rows, "s string, t long, v double").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        for block in (4, 20, 1000):
            monkeypatch.setattr(segments, "BLOCK", block)
            for form in (lambda s: signals.smoothed(d, ["s"], "t", "v", 1.0, s), lambda s: signals.diffused(d, ["s"], "t", "v", times=3, kappa=2.0, segment=s)):
                got = {(r.s, r.t): r.v for r in form(F.floor(F.col("t") / 8)).collect()}
                whole = {(r.s, r.t): r.v for r in form(None).where("t is not null").collect()}
                assert len(got) == 201 and all(r.v is None for r in form(F.floor(F.col("t") / 8)).where("s = 'none'").collect())
                for k, v in whole.items():
                    assert (k[0] == "place" and (k[1] < 4 or k[1] > 55)) or got[k] == (v if v is None else pytest.approx(v, abs=1e-9)), k
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_many_short_segments_are_few_calls(spark):
    """10,000 segments of 2,500 short traces: tasks take them by batches, not by a call for each."""
    d = spark.range(20_000, numPartitions=2).select((F.col("id") % 2500).alias("s"), F.col("id").alias("t"), (F.col("id") % 17).cast("double").alias("v"))
    out = signals.diffused(d, ["s"], "t", "v", times=2, kappa=8.0, option=2, segment=F.floor(F.col("t") / 5000))
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroupsInArrow" not in plan and "FlatMapCoGroupsInArrow" not in plan
    whole = {(r.s, r.t): r.v for r in signals.diffused(d, ["s"], "t", "v", times=2, kappa=8.0, option=2).collect()}
    assert {(r.s, r.t): pytest.approx(r.v, abs=1e-9) for r in out.collect()} == whole


def test_f0_and_dff_in_segments(spark):
    rng = np.random.default_rng(1)
    d = traces_of(spark, rng, {"a": 300, "b": 95, None: 200}).withColumn("component", (F.col("t") % 7 == 0).cast("int"))
    for how in ("fir", "mean"):
        whole, split = ({(r.s, r.t): r.v for r in signals.relative_fluorescence(d, ["s"], "t", "v", 6.0, how=how, component=("component", 0), segment=s).collect()} for s in (None, F.floor(F.col("t") / 50)))
        assert whole.keys() == split.keys() and len({k[0] for k in whole}) == 3 and all(k[1] % 7 for k in whole)
        assert all(split[k] == pytest.approx(v, rel=1e-9) if v is not None else split[k] is None for k, v in whole.items())


def test_a_long_trace_is_many_tasks_work(spark):
    n = 300_000
    d = spark.range(n, numPartitions=4).select(F.lit(1).alias("s"), F.col("id").alias("t"), (F.sin(F.col("id") * 0.01) + F.sin(F.col("id") * 2.0)).alias("v"))
    out = signals.low_passed(d, ["s"], "t", "v", 100.0, 2.0, segment=F.floor(F.col("t") / 20_000))
    x = np.array([r.v for r in d.orderBy("t").collect()])
    b, a = kernels.butterworth(2, 0.04)
    got = np.array([r.v for r in out.orderBy("t").collect()])
    assert np.abs(got - kernels.zero_phase(b, a, x)).max() < 1e-9
    per_task = out.groupBy(F.spark_partition_id()).count().collect()
    assert len(per_task) > 1 and max(r["count"] for r in per_task) < n


@settings(max_examples=30, deadline=None)
@given(st.lists(st.floats(-1e3, 1e3), min_size=1, max_size=300), st.integers(1, 4), st.floats(0.05, 0.9), st.integers(0, 300))
def test_a_filter_is_the_same_in_two_parts(x, order, share, cut):
    x, cut = np.array(x), min(cut, len(x))
    system = kernels.recursion(*kernels.butterworth(order, share))
    state = np.full(order, 0.5)
    step, drive, direct = system
    s, plain = state.copy(), []
    for v in x:
        plain.append(s[0] + direct * v)
        s = step @ s + drive * v
    y, end = kernels.driven(system, x, state)
    a, middle = kernels.driven(system, x[:cut], state)
    b, last = kernels.driven(system, x[cut:], middle)
    scale = 1e-9 * (1 + np.abs(x).max()) / share**order
    assert np.allclose(y, plain, atol=scale) and np.allclose(np.concatenate([a, b]), plain, atol=scale) and np.allclose(end, s, atol=scale) and np.allclose(last, s, atol=scale)
    free, _ = kernels.driven(system, np.zeros(len(x)), state)
    assert np.allclose(kernels.echo(system, len(x)) @ state, kernels.driven(system, free[::-1], np.zeros(order))[1], atol=scale)


@pytest.mark.parametrize("n, taps", [(100, 59), (5000, 59), (4096, 7), (1024, 300)])
def test_overlap_save(n, taps):
    rng = np.random.default_rng(n)
    x, w = rng.normal(size=n), rng.normal(size=taps)
    assert np.allclose(kernels.overlap_save(w, x), np.convolve(x, w, "valid"), atol=1e-10)


@pytest.mark.parametrize("share, most", [(0.0, 64), (0.05, 64), (0.5, 64), (0.77, 10_000), (1.0, 64)])
def test_quantiles(spark, share, most):
    rng = np.random.default_rng(4)
    groups = {"normal": rng.normal(size=3000), "ties": rng.choice([1.0, 2.0, 2.0, 2.0, 3.0], 2000), "wide": 10.0 ** rng.uniform(-300, 300, 1500) * rng.choice([-1, 1], 1500), "one": np.array([7.0]), "two": np.array([1.0, 2.0]), None: np.arange(500.0), "flat": np.full(900, 5.0), "ends": np.array([-math.inf, 0.0, 1.0, math.inf])}
    rows = [(k, float(v)) for k, x in groups.items() for v in x] + [("one", None), ("none", None), ("none", NAN)]
    d = spark.createDataFrame(rows, "k string, v double").repartition(4)
    got = {r.k: r.q for r in quantiles.exact_quantile(d, ["k"], "v", share, "q", most).collect()}
    assert got.pop("none") is None and got.keys() == groups.keys()
    for k, x in groups.items():
        x = np.sort(x)
        place = share * (len(x) - 1)
        part = place - math.floor(place)
        want = x[math.floor(place)] if part == 0 else (1 - part) * x[math.floor(place)] + part * x[math.ceil(place)]
        assert got[k] == pytest.approx(want, rel=1e-12), k
    everything = np.sort(np.concatenate([x for k, x in groups.items() if k != "ends"]))
    whole = quantiles.exact_quantile(d.where("k is null or k <> 'ends'"), [], "v", share, "q", most).first().q
    place = share * (len(everything) - 1)
    part = place - math.floor(place)
    assert whole == pytest.approx((1 - part) * everything[math.floor(place)] + part * everything[math.ceil(place)], rel=1e-12)
    assert quantiles.exact_quantile(d.limit(0), ["k"], "v", share).count() == 0 and quantiles.exact_quantile(d.limit(0), [], "v", share).first()[0] is None


def test_noise_over_all_traces(spark):
    d = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 4.0), ("b", 0, 0.0), ("b", 1, 1.0), (None, 0, 5.0), (None, 1, NAN)], "s string, t long, v double")
    assert traces.standardised_noise(d, "s", ["t"], "v", 4.0, whole=True).first().noise == 1.0
