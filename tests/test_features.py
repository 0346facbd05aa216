"""Trial features: how the trials are dealt over tasks, and what they are whatever the dealing."""

import pytest
from pyspark.sql import functions as F

from brimwell.operators import decoders


def trials_of(spark, n):
    at = {"trial_start": 0.0, "cs_start": 1.0, "cs_end": 4.0, "ucs_start": 6.0, "ucs_end": 7.0, "trial_end": 12.0}
    session = F.when(F.col("id") % 5 == 0, None).otherwise(F.col("id") % 2)
    return spark.range(n, numPartitions=1).select(session.alias("session"), F.col("id").alias("trial"), (F.col("id") % 3).alias("stimulus"), *[F.lit(v).alias(k) for k, v in at.items()])


@pytest.mark.parametrize("sessions", [0, 100])
def test_one_file_of_trials_is_many_tasks_work(spark, monkeypatch, sessions):
    monkeypatch.setattr(decoders, "ROWS", 24 * 7 * 50, raising=False)
    monkeypatch.setattr(decoders, "SESSIONS", sessions, raising=False)
    out = decoders.trial_features(trials_of(spark, 1000), 24, ("session",))
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 1000 * 24 * 7 and len(sizes) >= 15 and max(sizes) <= 3 * 24 * 7 * 50
    for r in out.where("trial % 97 = 0").collect():
        t, plus = r.frame * 12 / 24, r.trial % 3 == 0
        assert r.session == (None if r.trial % 5 == 0 else r.trial % 2)
        cs, trace, ucs = t <= 3, 3 < t <= 5, 5 < t <= 6
        assert r.value == (plus and cs, not plus and cs, plus and trace, not plus and trace, plus, not plus, plus and ucs)[r.feature]


def test_trials_without_sessions_and_none_at_all(spark):
    d = trials_of(spark, 6).drop("session")
    assert decoders.trial_features(d, 24).count() == 6 * 24 * 7
    assert decoders.trial_features(d.limit(0), 24).count() == 0 == decoders.trial_features(trials_of(spark, 0), 24, ("session",)).count()


def test_labels_are_added_up_where_the_features_are_made(spark, monkeypatch):
    monkeypatch.setattr(decoders, "ROWS", 24 * 7 * 50, raising=False)
    d = trials_of(spark, 1000)
    out = decoders.collapsed_features(decoders.trial_features(d, 24, ("session",)), [0, 2, 6], ("session",))
    plan = out._jdf.queryExecution().executedPlan().toString()
    top = plan[: plan.index("Generate")]
    assert "HashAggregate" in top and "Exchange" not in top
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 1000 * 24 and max(sizes) <= 3 * 24 * 50
    for r in out.where("trial % 97 = 0").collect():
        t = r.frame * 12 / 24
        assert r.label == (0 if r.trial % 3 else 1 if t <= 3 else 2 if t <= 5 else 3 if t <= 6 else 0)
