"""Several stacks in one table: each operator gives for each stack what it gives for that stack alone; packed forms against numpy."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from brimwell.operators import alignment, coloring, images

BY = ("session", "plane")
STACKS = [("a", 0), ("a", 1), (None, 0)]


@pytest.fixture(scope="module")
def stacks(spark):
    rng = np.random.default_rng(0)
    rows = [(s, p, f, [None if rng.random() < 0.05 else int(v) for v in rng.integers(0, 50 * (k + 1), 12)]) for k, (s, p) in enumerate(STACKS) for f in range(7 + 2 * k)]
    return spark.createDataFrame(rows, "session string, plane int, frame long, pixels array<int>").repartition(3).cache()


def full(d):
    return d.withColumn("pixels", F.transform("pixels", lambda v: F.coalesce(v, F.lit(1))))


def masks(d):
    rows = [("a", 0, 0, 1), ("a", 0, 2, 3), (None, 0, 1, 0)]
    return d.sparkSession.createDataFrame(rows, "session string, plane int, y long, x long")


def regions(d):
    rows = [(s, p, roi, 3 * roi + k, 0.5 + k) for s, p in STACKS[:2] for roi in range(3) for k in range(3 + p)] + [(None, 0, 0, 40, 1.0), (None, 0, 1, 2, 2.0)]
    return d.sparkSession.createDataFrame(rows, "session string, plane int, roi int, pixel long, weight double")


FORMS = {
    "mean_image": lambda d, by: images.mean_image(d, 4, by),
    **{how: lambda d, by, how=how: images.grouped(d, 4, (2, 2, 3), how, by) for how in ("mean", "sum", "max", "min", "median")},
    "reduced": lambda d, by: images.reduced(d, 4, (3, 2, 2), lambda b, axis: b.max(axis) - b.min(axis), by),
    "percentiles": lambda d, by: images.percentile_rescaled(d, 5.0, 95.0, by),
    "normalised": lambda d, by: images.normalised(d, True, by),
    "median_filtered": lambda d, by: images.median_filtered(full(d), 4, (3, 3, 1), 4, by),
    "traces": lambda d, by: images.region_traces(d, only(regions(d), d, by), by),
    "dealt traces": lambda d, by: images.region_traces(d, only(regions(d), d, by), by, masks=2),
    "grey": lambda d, by: coloring.grey_to_rgb(d, True, by),
    "background": lambda d, by: coloring.background(d, "grey", (10.0, 90.0), by),
    "colorized": lambda d, by: coloring.colorized(d, [(0, 0, 0), (1, 0, 0.5)], True, by),
    "only": lambda d, by: coloring.only_regions(coloring.background(d, "white"), coloring.mask(only(masks(d), d, by), 3, 4, by), by),
    "blended": lambda d, by: coloring.blended(coloring.grey_to_rgb(d, True, by), coloring.background(d, "white"), 0.25, by),
    "merged": lambda d, by: coloring.merged(coloring.grey_to_rgb(d, True, by), [(coloring.background(d, "white"), coloring.mask(only(masks(d), d, by), 3, 4, by))], by),
    "reference": lambda d, by: alignment.reference_frames(d, 3, by=by),
}


def only(table, d, by):
    """The rows of the stack that d alone holds."""
    return table if by else table.join(d.select(*BY).distinct().withColumnsRenamed({"session": "_s", "plane": "_p"}), F.col("session").eqNullSafe(F.col("_s")) & (F.col("plane") == F.col("_p")), "left_semi").drop(*BY)


def plain(rows, drop=()):
    return sorted(str({k: (round(v, 9) if isinstance(v, float) else v) for k, v in sorted(r.asDict(True).items()) if k not in drop}) for r in rows)


@pytest.mark.parametrize("name", sorted(FORMS))
def test_stacks_are_treated_alone(stacks, name):
    both = FORMS[name](stacks, BY).collect()
    assert both
    for s, p in STACKS:
        alone = FORMS[name](stacks.where(F.col("session").eqNullSafe(F.lit(s)) & (F.col("plane") == p)), ()).collect()
        assert plain([r for r in both if (r.session, r.plane) == (s, p)], BY) == plain(alone, BY), (s, p)
    assert not FORMS[name](stacks.limit(0), BY).collect()


def test_traces_by_brute_force(spark, stacks):
    got = {(r.session, r.plane, r.frame, r.roi): r.value for r in images.region_traces(stacks, regions(stacks), BY).collect()}
    want = {}
    for f in stacks.collect():
        own = [r for r in regions(stacks).collect() if (r.session, r.plane) == (f.session, f.plane)]
        for roi in {r.roi for r in own if r.pixel < 12}:
            inside = [(f.pixels[r.pixel], r.weight) for r in own if r.roi == roi and r.pixel < 12]
            some = [(v, w) for v, w in inside if v is not None]
            want[f.session, f.plane, f.frame, roi] = sum(v * w for v, w in some) / sum(w for _, w in some) if some else None
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v) if v is not None else got[k] is None for k, v in want.items())


def test_no_pixel_rows_in_the_plans(stacks):
    for name in ("reduced", "median", "traces", "median_filtered"):
        assert "Generate posexplode" not in FORMS[name](stacks, BY)._jdf.queryExecution().toString(), name


def test_blocks_by_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(-40, 40, (7, 5, 6))
    d = spark.createDataFrame([(f, v.ravel().tolist()) for f, v in enumerate(x)], "frame long, pixels array<int>")
    wide = np.zeros((8, 6, 8), int)
    wide[:7, :5, :6] = x
    blocks = wide.reshape(4, 2, 3, 2, 2, 4)
    for how, f in {"mean": np.mean, "sum": np.sum, "max": np.max, "min": np.min, "median": np.median}.items():
        got = {(r.frame, r.y, r.x): r.value for r in images.grouped(d, 6, (2, 2, 4), how).collect()}
        want = np.trunc(f(blocks, axis=(1, 3, 5))).astype(int)
        assert got == {k: int(want[k]) for k in np.ndindex(want.shape)}, how


def test_large_blocks_take_little_time(spark):
    d = spark.range(12).select(F.col("id").alias("frame"), F.transform(F.sequence(F.lit(0), F.lit(256 * 256 - 1)), lambda i: ((i * 7 + F.col("id")) % 251).cast("int")).alias("pixels")).cache()
    assert d.count() == 12
    images.reduced(d, 256, (4, 4, 4), np.ptp).write.format("noop").mode("overwrite").save()
    began = time.time()
    images.reduced(d, 256, (4, 4, 4), np.ptp).write.format("noop").mode("overwrite").save()
    assert time.time() - began < 5


def test_a_median_refuses_gaps_and_ragged_images(spark):
    for rows in ([(0, [1, 2]), (2, [1, 2])], [(0, [1, 2]), (0, [1, 2])], [(0, [1, 2]), (1, [1, 2, 3, 4])], [(0, [1, None]), (1, [1, 2])]):
        with pytest.raises(Exception, match="median needs|one size"):
            images.median_filtered(spark.createDataFrame(rows, "frame long, pixels array<int>"), 2).collect()


def test_neuropil_of_two_sessions(spark):
    rows = [("a", 1, 0, 10.0), ("b", 1, 0, 20.0), (None, 1, 0, 30.0)]
    d = spark.createDataFrame(rows, "session string, roi int, frame long, value double")
    got = {r.session: r.value for r in images.neuropil_corrected(d, d, 0.5, ("session",)).collect()}
    assert got == {"a": 5.0, "b": 10.0, None: 15.0} and not math.isnan(sum(got.values()))
