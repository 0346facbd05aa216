"""Ranks over ranges against sorted lists; unknown values in fills, metrics and curves."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from brimwell.operators import decoders, decoding, ranks, recordings, timeline

NAN = math.nan


@pytest.mark.parametrize("parts", [1, 3, 20])
def test_running_sums_by_brute_force(spark, parts):
    rng = np.random.default_rng(parts)
    rows = [(s, int(k), int(v)) for s in ("a", None, "b") for k, v in zip(rng.permutation(200), rng.integers(-9, 9, 200))] + [("one", 1, 5)]
    d = spark.createDataFrame(rows, "s string, k long, v long").repartition(4)
    got = ranks.accumulated(d, ["s"], [F.col("k")], {"total": F.col("v"), "rank": F.lit(1)}, parts)
    assert got.columns == ["s", "k", "v", "total", "rank"]
    for r in got.collect():
        before = [v for s, k, v in rows if s == r.s and k <= r.k]
        assert (r.total, r.rank) == (sum(before), len(before))
    whole = {(r.s, r.k): r.rank for r in ranks.ranked(d, [], [-F.col("k"), F.col("s")], parts=parts).collect()} if parts == 1 else None
    if whole:
        want = sorted(rows, key=lambda r: (-r[1], r[0] is not None, r[0] or ""))
        assert whole == {(s, k): i + 1 for i, (s, k, _) in enumerate(want)}
    assert ranks.ranked(d.limit(0), ["s"], [F.col("k")]).count() == 0


def test_no_window_holds_a_whole_group(spark):
    d = spark.range(5000).select((F.col("id") % 2).alias("type"), F.col("id").alias("trial"))
    plans = [decoders.interleaved(d), decoders.exact_split(d, "trial"), decoders.curves(d.withColumn("split", F.lit(0)), "type", "trial", "split")]
    for p in plans:
        p.count()
        assert "Exchange SinglePartition" not in p._jdf.queryExecution().sparkPlan().toString()


def test_trials_in_turn(spark):
    rng = np.random.default_rng(0)
    trials = spark.createDataFrame([(int(t), int(v)) for t, v in enumerate(rng.choice(3, 40, p=[0.2, 0.3, 0.5]))], "trial long, type int")
    rows = sorted(decoders.interleaved(trials).collect(), key=lambda r: r.place)
    least = min(sum(r.type == k for r in trials.collect()) for k in range(3))
    assert [r.place for r in rows] == list(range(3 * least)) and [r.type for r in rows] == [0, 1, 2] * least
    features = trials.select("trial", (F.col("trial") * 10).alias("value"))
    got = {r.trial: r.value for r in decoders.permuted_labels(features, trials).collect()}
    assert got == {r.place: r.trial * 10 for r in rows}
    split = decoders.exact_split(trials, "trial", 0.7).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in split} == {"train": 28, "test": 12}


@pytest.mark.parametrize("size", [None, 2])
def test_nan_is_not_known(spark, size):
    d = spark.createDataFrame([("s", t, v) for t, v in enumerate([1.0, NAN, None, 5.0, NAN])], "s string, t long, v double")
    segment = F.floor(F.col("t") / size) if size else None
    ahead = {how: [r.x for r in recordings.nearest_filled(d, "s", "t", ["t"], "v", "x", how, segment).orderBy("t").collect()] for how in ("forward", "backward", "nearest")}
    assert ahead == {"forward": [1.0, 1.0, 1.0, 5.0, 5.0], "backward": [1.0, 5.0, 5.0, 5.0, None], "nearest": [1.0, 1.0, 5.0, 5.0, None]}
    assert [r.x for r in timeline.filled_forward(d, "s", ["t"], "v", "x", segment).orderBy("t").collect()] == [1.0, 1.0, 1.0, 5.0, 5.0]
    words = d.withColumn("w", F.when(F.col("t") == 1, "seen"))
    assert [r.x for r in timeline.filled_forward(words, "s", ["t"], "w", "x").orderBy("t").collect()] == [None] + ["seen"] * 4


def test_metrics_pass_over_nan(spark):
    rows = [("a", 0, 1.0, 1.5), ("a", 0, 3.0, 2.0), ("a", 0, NAN, 1.0), ("a", 0, 2.0, NAN)]
    d = spark.createDataFrame(rows, "split string, o int, t double, p double")
    for m in (decoding.regression_metrics(d, "t", "p").first(), decoders.split_regression_metrics(d, "split", "o", "t", "p").first()):
        assert (m.mae, m.mse) == (0.75, 0.625) and m.r2 == pytest.approx(1 - 0.625)
    scores = spark.createDataFrame([("a", 1, 0.9), ("a", 0, NAN), ("a", 0, 0.2), ("a", 1, None)], "split string, y int, s double")
    assert [(r.threshold, r.tpr, r.fpr) for r in decoders.curves(scores, "y", "s", "split").orderBy("fpr").collect()] == [(0.9, 1.0, 0.0), (0.2, 1.0, 1.0)]
    assert decoders.areas(scores, "y", "s", "split").first().roc_auc == 1.0


def test_frames_take_the_nearest_sample(spark):
    samples = spark.createDataFrame([("s", 10 * k, v) for k, v in enumerate([0.0, 5.0, 5.0, 5.0, NAN, 0.0])], "s string, t long, v double")
    frames = spark.createDataFrame([("s", t, k) for k, t in enumerate([-50, 4, 5, 6, 31, 40, 44, 99])] + [("none", 1, 0)], "s string, t long, frame int")
    for segment in (None, F.floor(F.col("t") / 20)):
        got = {(r.s, r.frame): r.v for r in recordings.sampled_at(frames, samples, "s", "t", "v", segment).collect()}
        assert got == {("s", 0): 0.0, ("s", 1): 0.0, ("s", 2): 0.0, ("s", 3): 5.0, ("s", 4): 5.0, ("s", 5): 5.0, ("s", 6): 0.0, ("s", 7): 0.0, ("none", 0): None}
        marks = {r.frame: r.is_artifact for r in recordings.artifact_frames(frames.where("s = 's'"), samples, "s", "t", "v", segment=segment).collect()}
        assert marks == {0: False, 1: False, 2: False, 3: True, 4: True, 5: True, 6: False, 7: False}


def test_gate_share_of_trials_in_a_state(spark):
    rows = [("s", "Trial", 0, 1), ("s", "Trial", 0, 0), ("s", "Wait", 0, 1), ("s", "Trial", 1, 1), ("s", "Trial", 7, 1), (None, "Trial", 0, 0), (None, "Trial", 0, None)]
    d = spark.createDataFrame(rows, "session string, state string, trial_set int, gate int")
    trials = spark.createDataFrame([("s", 0, "plus"), ("s", 1, "minus"), (None, 0, "plus")], "session string, trial_set int, stimulus string")
    got = {(r.session, r.stimulus): r.percent for r in timeline.trial_gate_share(d, "stimulus", "gate", state="state", trials=trials, by=("session",)).collect()}
    assert got == {("s", "plus"): 50.0, ("s", "minus"): 100.0, (None, "plus"): 0.0}


def test_null_sessions_stay_in_alignments(spark):
    """Every alignment treats rows of null session as a session; with segments it gives the same."""
    from brimwell.operators import alignment, traces

    line = spark.createDataFrame([(s, t, 100 + t, "trial" if t > 2 else "wait", t // 3) for s in ("a", None) for t in range(12)], "s string, row long, t_ms long, state string, trial_set long")
    rec = spark.createDataFrame([(s, t, 0.0 if t < 5 else 9.0, t * 2.0) for s in ("a", None) for t in range(14)], "s string, row long, signal double, time_ms double")
    shifts = alignment.recording_shift(line, rec, "s", "state", "trial", "signal")
    assert sorted(map(str, ((r.s, r["shift"], r.began) for r in shifts.collect()))) == sorted(map(str, [("a", 2, 100), (None, 2, 100)]))
    frames = rec.select("s", F.col("row").alias("frame"), (F.col("row") * 0.003).alias("relative_time"))
    trials = spark.createDataFrame([(s, k, k * 10) for s in ("a", None) for k in (1, 3)], "s string, trial long, stimulus long")
    pose = rec.select("s", F.lit("trial").alias("state"), F.lit(1).cast("long").alias("trial_set"), F.col("row").alias("frame"), F.col("signal").alias("x"))
    forms = {
        "recording": lambda g: alignment.recording_aligned(line, rec, shifts, "s", ["signal"]),
        "frames": lambda g: alignment.frames_aligned(line, frames, rec, shifts, "s", segment=g("t_ms")),
        "sampled": lambda g: alignment.downsampled_aligned(line.withColumn("imaging_frame", F.col("row")), frames, "s", 3, 1, 2, segment=g("t_ms")),
        "stimulus": lambda g: alignment.with_stimulus(line, trials, "s", ["t_ms"], segment=g("t_ms")),
        "pose": lambda g: alignment.pose_aligned(line, pose, "s", {"x": "max"}, "state", "trial_set", segment=g("t_ms")),
        "grid": lambda g: alignment.on_grid(line.select("s", "row"), {"c": rec.select("s", "row", F.col("signal").alias("value"))}, ["s", "row"]),
        "steps": lambda g: traces.step_distance(rec, "s", ["row"], "signal", "time_ms", g("row")),
        "numbers": lambda g: traces.numbered(rec, "s", ["row"], segment=g("row")),
        "spans": lambda g: recordings.stimulated(rec, spark.createDataFrame([("a", 3, 6), (None, 3, 6), (None, 5, 20)], "s string, begin long, end long"), "s", "row", segment=g("row")),
    }
    for name, form in forms.items():
        whole, split = ([{k: v for k, v in r.asDict().items()} for r in form(g).collect()] for g in (lambda c: None, lambda c: F.floor(F.col(c) / 4)))
        assert sorted(map(str, whole)) == sorted(map(str, split)), name
        mine, null = (sorted(str({k: v for k, v in r.items() if k != "s"}) for r in whole if r["s"] == s) for s in ("a", None))
        assert len(mine) == len(null) > 10 and (mine == null or name == "spans"), name
