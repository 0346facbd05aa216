"""Registered queries of the image and recording operators, with the SQL that says the same.

Embeddings stand in for frames of 8 x 8 pixels (pixel = floor((x + 2) * 1000)), events for recordings.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import images, recordings, traces
from .queries import ORDER, _events, table

PIXEL = 1000


def _frames(spark, sf_dir):
    p = F.transform("embedding", lambda x: F.floor((x.cast("double") + 2) * PIXEL).cast("int"))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"), p.alias("pixels"))


def _pixels(frames):
    return frames.select("frame", F.posexplode("pixels").alias("i", "v")).select("frame", F.col("i").cast("long").alias("i"), "v")


def halved_pixels(spark, sf_dir):
    return _pixels(images.halved(_frames(spark, sf_dir))).withColumn("v", F.col("v").cast("long"))


def cropped_pixels(spark, sf_dir):
    return _pixels(images.cropped(_frames(spark, sf_dir), 8, (2, 6), (1, 4))).withColumn("v", F.col("v").cast("long"))


def artifact_crop(spark, sf_dir):
    return images.without_artifact(_frames(spark, sf_dir), 30, 70).select("frame", F.col("pixels")[0].cast("long").alias("v"))


def frame_stacks(spark, sf_dir):
    return images.stacks(_frames(spark, sf_dir), 70)


def mean_image(spark, sf_dir):
    return images.mean_image(_frames(spark, sf_dir), 8).select("y", "x", F.round("value", 6).alias("value"))


def grouped_mean(spark, sf_dir):
    return images.grouped_mean(_frames(spark, sf_dir), 8, (3, 3, 2))


def percentile_rescaled(spark, sf_dir):
    return _pixels(images.percentile_rescaled(_frames(spark, sf_dir), 1.0, 99.0)).withColumn("v", F.round("v", 6))


def normalised_pixels(spark, sf_dir):
    return _pixels(images.normalised(_frames(spark, sf_dir))).withColumn("v", F.round("v", 6))


def region_traces(spark, sf_dir):
    regions = spark.range(64).select((F.col("id") % 5).alias("roi"), F.col("id").cast("int").alias("pixel"), (1.0 + F.col("id") / 64).alias("weight")).where("roi < 4")
    return images.region_traces(_frames(spark, sf_dir), regions).select("roi", "frame", F.round("value", 5).alias("value"))


def neuropil_corrected(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"), F.posexplode("embedding").alias("i", "v")).withColumn("v", F.col("v").cast("double"))
    soma, around = e.where("i < 32").select("frame", F.col("i").alias("roi"), "v"), e.where("i >= 32").select("frame", (F.col("i") - 32).alias("roi"), F.col("v").alias("n"))
    return images.neuropil_corrected(soma.withColumnRenamed("v", "value"), around.withColumnRenamed("n", "value")).select("frame", F.col("roi").cast("long").alias("roi"), F.round("value", 6).alias("value"))


def _timed(spark, sf_dir):
    """Events with t, microseconds since 1970 of their time without zone."""
    return _events(spark, sf_dir).withColumn("t", F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)"))


def nearest_fill(spark, sf_dir):
    e = _timed(spark, sf_dir).withColumn("seen", F.when(F.col("event_id") % 7 == 0, F.col("event_id")))
    return recordings.nearest_filled(e, "user_id", "t", ORDER, "seen", "near").select("event_id", F.col("near").cast("double").alias("near"))


def trial_sets(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("state", F.expr("case event_id % 11 when 0 then 'rest' when 1 then 'rest' else if(event_id % 3 = 0, 'trial', 'wait') end"))
    return recordings.trial_sets(e, "user_id", ORDER, "state", "trial", "rest").select("event_id", "trial_set")


def complete_sessions(spark, sf_dir):
    e = _events(spark, sf_dir)
    edges = traces.rising_edges(e, "user_id", ORDER, "value").select("user_id")
    return recordings.complete_sessions(edges, e.where("event_type in ('click', 'purchase')").select("user_id"), "user_id")


def known_frames(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("frame", F.col("event_id") % 997).withColumn("value", F.when(F.col("event_id") % 101 != 0, F.col("value")))
    return recordings.without_unknown_frames(e, "frame", "value").select("event_id", "frame")


def spike_matrix(spark, sf_dir):
    e = _events(spark, sf_dir).select(F.col("user_id").alias("neuron"), (F.col("event_id") % 50).alias("frame"))
    return recordings.spike_matrix(e, e.select("neuron").distinct(), 50)


def trial_frames(spark, sf_dir):
    e = _timed(spark, sf_dir).withColumn("frame", F.floor(F.col("t") / 3_600_000_000))
    return recordings.trial_frames(e, "user_id", "frame", 5)


def stimulation_schedule(spark, sf_dir):
    p = table(spark, sf_dir, "supplier").select("s_nationkey", "s_name", (F.col("s_suppkey") % 13).cast("long").alias("delay"), (F.col("s_suppkey") % 7).cast("long").alias("took"))
    return recordings.stimulation_schedule(p, "s_nationkey", "s_name", "delay", "took").select("s_name", "onset", "end")


def stimulated_samples(spark, sf_dir):
    e = _timed(spark, sf_dir).select("event_id", "user_id", "event_type", "t")
    spans = e.where("event_type = 'purchase'").select("user_id", F.col("t").alias("begin"), (F.col("t") + 86_400_000_000 * (F.col("event_id") % 4)).alias("end"))
    return recordings.stimulated(e, spans, "user_id", "t").select("event_id", "signal")


def merged_frames(spark, sf_dir):
    e = traces.numbered(_events(spark, sf_dir).withColumn("part", F.col("event_type")).withColumn("k", F.concat_ws("/", F.col("user_id").cast("string"), "part")), "k", ORDER)
    lengths = e.groupBy("user_id", "part").agg(F.count("*").alias("length"))
    return recordings.merged_frames(lengths, e, "user_id", "part", "frame").select("event_id", "frame")


def detrended(spark, sf_dir):
    e = _timed(spark, sf_dir).withColumn("day", F.col("event_id") / 100.0)
    return recordings.detrended(e, "user_id", "day", "value").select("event_id", F.round("value", 4).alias("value"))


def confusion(spark, sf_dir):
    return recordings.confusion(table(spark, sf_dir, "labels"), "quality", "toxic").select("quality", "toxic", "n", F.round("share", 8).alias("share"))


QUERIES = {f.__name__: f for f in (halved_pixels, cropped_pixels, artifact_crop, frame_stacks, mean_image, grouped_mean, percentile_rescaled, normalised_pixels, region_traces, neuropil_corrected, nearest_fill, trial_sets, complete_sessions, known_frames, spike_matrix, trial_frames, stimulation_schedule, stimulated_samples, merged_frames, detrended, confusion)}

_P = f"p AS (SELECT vec_id AS frame, CAST(unnest(range(64)) AS BIGINT) AS i, CAST(floor((CAST(unnest(embedding) AS DOUBLE) + 2) * {PIXEL}) AS BIGINT) AS v FROM embeddings)"
_W = "OVER (PARTITION BY user_id ORDER BY ts, event_id)"
_SEEN = "CASE WHEN event_id % 7 = 0 THEN {} END"
_BACK, _AHEAD = (f"(PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN {x})" for x in ("UNBOUNDED PRECEDING AND CURRENT ROW", "CURRENT ROW AND UNBOUNDED FOLLOWING"))
ORACLE_SQL = {
    "halved_pixels": f"WITH {_P} SELECT frame, i, CAST(floor(v / 2) AS BIGINT) AS v FROM p",
    "cropped_pixels": f"WITH {_P} SELECT frame, row_number() OVER (PARTITION BY frame ORDER BY i) - 1 AS i, v FROM p WHERE i // 8 BETWEEN 2 AND 5 AND i % 8 BETWEEN 1 AND 3",
    "artifact_crop": f"WITH {_P}, c AS (SELECT CASE WHEN count(*) % 70 >= 30 THEN count(*) % 70 ELSE 30 + (count(*) - 30) % 70 END AS crop FROM embeddings) SELECT frame - crop AS frame, v FROM p, c WHERE i = 0 AND frame >= crop",
    "frame_stacks": "WITH n AS (SELECT CAST(ceil(count(*) / 70) AS BIGINT) AS total FROM embeddings) SELECT vec_id // 70 AS chunk, (CASE WHEN vec_id // 70 < 9 THEN '0' ELSE '' END) || (vec_id // 70 + 1) || '_of_' || total AS name, count(*) AS n_frames, min(vec_id) AS first_frame FROM embeddings, n GROUP BY ALL",
    "mean_image": f"WITH {_P} SELECT i // 8 AS y, i % 8 AS x, round(avg(v), 6) AS value FROM p GROUP BY ALL",
    "grouped_mean": f"WITH {_P} SELECT frame // 3 AS frame, i // 8 // 3 AS y, i % 8 // 2 AS x, CAST(floor(sum(v) / 18) AS BIGINT) AS value FROM p GROUP BY ALL",
    "percentile_rescaled": f"WITH {_P}, c AS (SELECT quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM p) SELECT frame, i, round(least(255.0, greatest(0.0, (v - lo) * 255.0 / (hi - lo))), 6) AS v FROM p, c",
    "normalised_pixels": f"WITH {_P} SELECT frame, i, round((v - min(v) OVER w) / CAST(max(v) OVER w - min(v) OVER w AS DOUBLE), 6) AS v FROM p WINDOW w AS (PARTITION BY frame)",
    "region_traces": f"WITH {_P} SELECT i % 5 AS roi, frame, round(sum(v * (1.0::DOUBLE + i / 64)) / sum(1.0::DOUBLE + i / 64), 5) AS value FROM p WHERE i % 5 < 4 GROUP BY ALL",
    "neuropil_corrected": "SELECT vec_id AS frame, r AS roi, round(CAST(embedding[r + 1] AS DOUBLE) - 0.7::DOUBLE * CAST(embedding[r + 33] AS DOUBLE), 6) AS value FROM embeddings, range(32) t(r)",
    "nearest_fill": f"WITH s AS (SELECT event_id, epoch_us(ts) AS t, last_value({_SEEN.format('event_id')} IGNORE NULLS) OVER {_BACK} AS bv, last_value({_SEEN.format('epoch_us(ts)')} IGNORE NULLS) OVER {_BACK} AS bt, first_value({_SEEN.format('event_id')} IGNORE NULLS) OVER {_AHEAD} AS av, first_value({_SEEN.format('epoch_us(ts)')} IGNORE NULLS) OVER {_AHEAD} AS ahead FROM events) SELECT event_id, CAST(CASE WHEN bv IS NULL OR av IS NULL THEN NULL WHEN t - bt <= ahead - t THEN bv ELSE av END AS DOUBLE) AS near FROM s",
    "trial_sets": f"""WITH e AS (SELECT *, CASE WHEN event_id % 11 IN (0, 1) THEN 'rest' WHEN event_id % 3 = 0 THEN 'trial' ELSE 'wait' END AS state FROM events),
r AS (SELECT event_id, user_id, state, row_number() {_W} AS k, CASE WHEN state = 'trial' AND lead(state) {_W} IS DISTINCT FROM 'trial' THEN 1 ELSE 0 END AS fin FROM e), h AS (SELECT user_id, max(k) AS last FROM r WHERE state = 'rest' GROUP BY 1)
SELECT event_id, CASE WHEN k <= coalesce(last, 0) THEN -1 ELSE CAST(sum(fin) OVER (PARTITION BY user_id ORDER BY k) - fin AS BIGINT) END AS trial_set FROM r LEFT JOIN h USING (user_id)""",
    "complete_sessions": f"WITH f AS (SELECT user_id, count(*) AS n FROM (SELECT user_id, value - lag(value) {_W} AS rise FROM events) WHERE rise > 1 GROUP BY 1), d AS (SELECT user_id, count(*) AS due FROM events WHERE event_type IN ('click', 'purchase') GROUP BY 1) SELECT user_id, coalesce(n, 0) AS edges, coalesce(n, 0) = due AS complete FROM d LEFT JOIN f USING (user_id)",
    "known_frames": "WITH e AS (SELECT event_id, event_id % 997 AS frame, CASE WHEN event_id % 101 <> 0 THEN value END AS v FROM events) SELECT event_id, frame FROM e WHERE frame NOT IN (SELECT frame FROM e WHERE v IS NULL OR isnan(v))",
    "spike_matrix": "SELECT neuron, f AS frame, CAST(EXISTS (SELECT 1 FROM events e WHERE e.user_id = neuron AND e.event_id % 50 = f) AS INT) AS spike FROM (SELECT DISTINCT user_id AS neuron FROM events), range(50) t(f)",
    "trial_frames": "WITH d AS (SELECT DISTINCT user_id, epoch_us(ts) // 3600000000 AS f FROM events), g AS (SELECT *, f - lag(f) OVER (PARTITION BY user_id ORDER BY f) AS gap FROM d), h AS (SELECT user_id, f, row_number() OVER (PARTITION BY user_id ORDER BY f) - 1 AS trial FROM g WHERE gap IS NULL OR gap > 1) SELECT user_id, trial, f + k AS frame FROM h, range(5) t(k)",
    "stimulation_schedule": 'SELECT s_name, CAST(sum(s_suppkey % 13 + s_suppkey % 7) OVER w - s_suppkey % 7 AS BIGINT) AS onset, CAST(sum(s_suppkey % 13 + s_suppkey % 7) OVER w AS BIGINT) AS "end" FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY lower(s_name), s_name ROWS UNBOUNDED PRECEDING)',
    "stimulated_samples": "WITH s AS (SELECT user_id, epoch_us(ts) AS b, epoch_us(ts) + 86400000000 * (event_id % 4) AS e FROM events WHERE event_type = 'purchase') SELECT event_id, CASE WHEN EXISTS (SELECT 1 FROM s WHERE s.user_id = x.user_id AND epoch_us(x.ts) >= b AND epoch_us(x.ts) < e) THEN 5.0::DOUBLE ELSE 0.0::DOUBLE END AS signal FROM events x",
    "merged_frames": "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_type, ts, event_id) - 1 AS frame FROM events",
    "detrended": "WITH l AS (SELECT user_id, coalesce(regr_slope(value, event_id / 100.0), 0) AS s, avg(event_id / 100.0) AS t, avg(value) AS v FROM events GROUP BY 1) SELECT event_id, round(value - (v + s * (event_id / 100.0 - t)), 4) AS value FROM events JOIN l USING (user_id)",
    "confusion": "SELECT quality, toxic, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY quality), 8) AS share FROM labels GROUP BY 1, 2",
}
