"""Registered queries of traces in segments, stacks side by side, ranks and quantiles, with the SQL that says the same.

Embeddings stand in for stacks of frames of 8 x 8 pixels, a stack for each label; events for recordings, dealt by days.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import alignment, coloring, decoders, images, quantiles, recordings, signals, tiles, timeline, traces
from . import recording_queries, session_queries
from .picture_queries import _trials
from .queries import ORDER, _events, table
from .recording_queries import _P, _frames, _timed
from .session_queries import _behaviour, _matrix, _recorder

DAY = 86_400_000_000
BY = ("label",)


def _stacks(spark, sf_dir):
    """Frames of each label, numbered from 0 without gaps."""
    number = F.row_number().over(Window.partitionBy("label").orderBy("frame")) - 1
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"), "label")
    return _frames(spark, sf_dir).join(labels, "frame").withColumn("frame", number.cast("long"))


def _day():
    return F.floor(F.col("t") / DAY)


def nearest_fill_in_segments(spark, sf_dir):
    e = _timed(spark, sf_dir).withColumn("seen", F.when(F.col("event_id") % 7 == 0, F.col("event_id")))
    return recordings.nearest_filled(e, "user_id", "t", ORDER, "seen", "near", segment=_day()).select("event_id", F.col("near").cast("double").alias("near"))


def trial_sets_in_segments(spark, sf_dir):
    e = _timed(spark, sf_dir).withColumn("state", F.expr("case event_id % 11 when 0 then 'rest' when 1 then 'rest' else if(event_id % 3 = 0, 'trial', 'wait') end"))
    return recordings.trial_sets(e, "user_id", ORDER, "state", "trial", "rest", segment=_day()).select("event_id", "trial_set")


def smoothed_in_segments(spark, sf_dir):
    return signals.smoothed_rates(_matrix(spark, sf_dir), [], "neuron", "frame", "value", 0.5, F.floor(F.col("frame") / 128)).select("neuron", "frame", F.round("value", 6).alias("value"))


def mean_dff_in_segments(spark, sf_dir):
    d = signals.relative_fluorescence(_matrix(spark, sf_dir), ["neuron"], "frame", "value", 6.0, how="mean", segment=F.floor(F.col("frame") / 128))
    return traces.binned(d, "neuron", "frame", "value", 8).select("neuron", "bin", F.round("value", 6).alias("value"))


def diffused_in_segments(spark, sf_dir):
    d = signals.diffused(_timed(spark, sf_dir), ["user_id"], "ts", "value", times=2, kappa=8.0, option=2, segment=_day())
    return d.select("event_id", F.round("value", 6).alias("value"))


def low_passed_in_segments(spark, sf_dir):
    return signals.low_passed(_matrix(spark, sf_dir), ["neuron"], "frame", "value", 10.0, 1.0, segment=F.floor(F.col("frame") / 128)).select("neuron", "frame", F.round("value", 6).alias("value"))


def stimulated_in_segments(spark, sf_dir):
    e = _timed(spark, sf_dir).select("event_id", "user_id", "event_type", "t")
    spans = e.where("event_type = 'purchase'").select("user_id", F.col("t").alias("begin"), (F.col("t") + DAY * (F.col("event_id") % 4)).alias("end"))
    return recordings.stimulated(e, spans, "user_id", "t", segment=_day()).select("event_id", "signal")


def downsampled_in_segments(spark, sf_dir):
    frames = _recorder(spark, sf_dir).select("user_id", F.col("row").alias("frame"))
    line = _behaviour(spark, sf_dir).withColumn("imaging_frame", F.when(F.col("row") % 5 != 0, F.col("row")))
    d = alignment.downsampled_aligned(line, frames, "user_id", 3, 2, 3, segment=F.floor(F.col("t_ms") / 20))
    return d.select("user_id", "t_ms", F.col("downsampled_frame").cast("double").alias("frame"), F.col("filled_downsampled_frame").cast("double").alias("filled"))


def stimulus_in_segments(spark, sf_dir):
    e = _timed(spark, sf_dir).withColumn("state", F.expr("case event_id % 11 when 0 then 'rest' when 1 then 'rest' else if(event_id % 3 = 0, 'trial', 'wait') end"))
    e = recordings.trial_sets(e, "user_id", ORDER, "state", "trial", "rest", segment=_day())
    trials = e.where("trial_set >= 0 and trial_set % 4 <> 3").select("user_id", F.col("trial_set").alias("trial"), ((F.col("trial_set") * 7) % 5).alias("stimulus")).distinct()
    d = alignment.with_stimulus(e, trials, "user_id", ORDER, segment=_day())
    return d.select("event_id", F.coalesce("stimulus", F.lit(-1)).alias("stimulus"))


def noise_of_all(spark, sf_dir):
    return traces.standardised_noise(_events(spark, sf_dir), "user_id", ORDER, "value", 6.0, whole=True).select(F.round("noise", 6).alias("noise"))


def price_quantiles(spark, sf_dir):
    return quantiles.exact_quantile(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", 0.9).select("l_returnflag", F.round("quantile", 4).alias("quantile"))


def frames_of_samples(spark, sf_dir):
    """Each noon of a user's days as a frame, the user's events as samples."""
    e = _timed(spark, sf_dir)
    frames = e.select("user_id", (_day() * DAY + DAY // 2).alias("t")).distinct()
    d = recordings.artifact_frames(frames, e.select("user_id", "t", "value"), "user_id", "t", "value", 10.0, F.floor(F.col("t") / DAY / 7))
    return d.select("user_id", "t", F.round("value", 6).alias("value"), F.col("is_artifact").cast("long").alias("is_artifact"))


def gate_share_of_trials(spark, sf_dir):
    e = _events(spark, sf_dir).select("user_id", "event_type", (F.col("event_id") % 3).cast("int").alias("gate"), (F.col("event_id") % 10).alias("trial_set"))
    trials = e.select("user_id", "trial_set").distinct().where("trial_set < 8").withColumn("stimulus", (F.col("user_id") + F.col("trial_set")) % 4)
    d = timeline.trial_gate_share(e.withColumn("gate", F.when(F.col("gate") < 2, F.col("gate"))), "stimulus", "gate", 1, 5, state="event_type", trial="purchase", trials=trials, by=("user_id",))
    return d.select("user_id", "stimulus", F.round("percent", 6).alias("percent"))


def mean_image_of_stacks(spark, sf_dir):
    return images.mean_image(_stacks(spark, sf_dir), 8, BY).select("label", "y", "x", F.round("value", 6).alias("value"))


def grouped_median_of_stacks(spark, sf_dir):
    return images.grouped(_stacks(spark, sf_dir), 8, (3, 3, 2), "median", BY)


def median_filtered_stacks(spark, sf_dir):
    d = images.median_filtered(_stacks(spark, sf_dir), 8, chunk=32, by=BY)
    return d.select("label", "frame", F.posexplode("pixels").alias("i", "v")).select("label", "frame", F.col("i").cast("long").alias("i"), F.col("v").cast("long").alias("v"))


def blended_stacks(spark, sf_dir):
    f = _stacks(spark, sf_dir)
    d = coloring.blended(coloring.grey_to_rgb(f, by=BY), coloring.background(f, "white"), 0.3, BY)
    return d.select("label", "frame", F.posexplode("pixels").alias("i", "c")).select("label", "frame", F.col("i").cast("long").alias("i"), F.col("c.r").cast("long").alias("r"))


def region_traces_of_stacks(spark, sf_dir):
    """Region r of label l: pixels r, r + 5, ... from place l on."""
    regions = spark.range(64).select((F.col("id") % 5).alias("roi"), F.col("id").alias("pixel"), (1 + F.col("id") / 64).alias("weight")).where("roi < 3")
    labels = table(spark, sf_dir, "embeddings").select("label").distinct()
    own = regions.join(labels, F.col("pixel") >= F.col("label"))
    return images.region_traces(_stacks(spark, sf_dir), own, BY).select("label", "roi", "frame", F.round("value", 5).alias("value"))


def exact_split(spark, sf_dir):
    return decoders.exact_split(table(spark, sf_dir, "embeddings").select("vec_id"), "vec_id")


def permuted_labels(spark, sf_dir):
    trials = _trials(spark, sf_dir)
    return decoders.permuted_labels(trials.select("trial", F.col("type").alias("value")), trials).select("trial", F.col("value").cast("long").alias("value"))


def tile_origins(spark, sf_dir):
    shapes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("stack"), (F.col("p_size") + 10).alias("frames"), (F.col("p_size") * 3).alias("height"), (F.col("p_partkey") % 40 + 1).alias("width"))
    return tiles.tile_origins(shapes, (6, 20, 20), (12, 12), 20_000, ("stack",))


QUERIES = {f.__name__: f for f in (nearest_fill_in_segments, trial_sets_in_segments, smoothed_in_segments, mean_dff_in_segments, diffused_in_segments, low_passed_in_segments, stimulated_in_segments, downsampled_in_segments, stimulus_in_segments, noise_of_all, price_quantiles, frames_of_samples, gate_share_of_trials, mean_image_of_stacks, grouped_median_of_stacks, median_filtered_stacks, blended_stacks, region_traces_of_stacks, exact_split, permuted_labels, tile_origins)}

_S = f"""{_P}, l AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS k FROM embeddings), s AS (SELECT label, k AS frame, i, v FROM p JOIN l ON vec_id = frame)"""
_TURNS = """r AS (SELECT vec_id AS trial, label AS type, row_number() OVER (PARTITION BY label ORDER BY md5('0:' || vec_id), vec_id) AS rank FROM embeddings), n AS (SELECT min(n) AS n FROM (SELECT count(*) AS n FROM embeddings GROUP BY label)),
o AS (SELECT trial, type, row_number() OVER (ORDER BY rank, type) - 1 AS place FROM r, n WHERE rank <= n)"""
ORACLE_SQL = {
    "nearest_fill_in_segments": recording_queries.ORACLE_SQL["nearest_fill"],
    "trial_sets_in_segments": recording_queries.ORACLE_SQL["trial_sets"],
    "smoothed_in_segments": session_queries.ORACLE_SQL["smoothed_rates"],
    "mean_dff_in_segments": session_queries.ORACLE_SQL["mean_dff"],
    "diffused_in_segments": session_queries.ORACLE_SQL["diffused_traces"],
    "stimulated_in_segments": recording_queries.ORACLE_SQL["stimulated_samples"],
    "downsampled_in_segments": session_queries.ORACLE_SQL["downsampled_aligned"],
    "stimulus_in_segments": session_queries.ORACLE_SQL["stimulus_by_row"],
    "low_passed_in_segments": session_queries.ORACLE_SQL["low_passed"],
    "noise_of_all": "SELECT round(median(step) / sqrt(6.0::DOUBLE), 6) AS noise FROM (SELECT abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS step FROM events)",
    "price_quantiles": "SELECT l_returnflag, round(quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.9), 4) AS quantile FROM lineitem GROUP BY 1",
    "frames_of_samples": """WITH e AS (SELECT user_id, epoch_us(ts) AS t, value FROM events), f AS (SELECT DISTINCT user_id, t // 86400000000 * 86400000000 + 43200000000 AS t FROM e),
b AS (SELECT f.user_id, f.t, e.t AS bt, value AS bv FROM f ASOF LEFT JOIN e ON f.user_id = e.user_id AND f.t >= e.t), n AS (SELECT f.user_id, f.t, e.t AS nt, value AS nv FROM f ASOF LEFT JOIN e ON f.user_id = e.user_id AND f.t <= e.t),
s AS (SELECT user_id, t, CASE WHEN nt IS NULL OR t - bt <= nt - t THEN bv ELSE nv END AS v FROM b JOIN n USING (user_id, t)),
m AS (SELECT user_id, t, list_sort([coalesce(lag(v, 2) OVER w, 0), coalesce(lag(v) OVER w, 0), v, coalesce(lead(v) OVER w, 0), coalesce(lead(v, 2) OVER w, 0)])[3] AS m FROM s WINDOW w AS (PARTITION BY user_id ORDER BY t))
SELECT user_id, t, round(m, 6) AS value, CAST(m > 10 AS BIGINT) AS is_artifact FROM m""",
    "gate_share_of_trials": """SELECT user_id, (user_id + event_id % 10) % 4 AS stimulus, round(100.0::DOUBLE * count(*) FILTER (event_id % 3 = 1) / count(*) FILTER (event_id % 3 < 2) / (4.0::DOUBLE / 5), 6) AS percent
FROM events WHERE event_type = 'purchase' AND event_id % 10 < 8 GROUP BY 1, 2""",
    "mean_image_of_stacks": f"WITH {_S} SELECT label, i // 8 AS y, i % 8 AS x, round(avg(v), 6) AS value FROM s GROUP BY ALL",
    "grouped_median_of_stacks": f"""WITH {_S}, g AS (SELECT label, frame // 3 AS frame, i // 8 // 3 AS y, i % 8 // 2 AS x, list(v) AS v FROM s GROUP BY 1, 2, 3, 4)
SELECT label, frame, y, x, CAST(trunc(list_median(list_resize(v, 18, 0))) AS BIGINT) AS value FROM g""",
    "median_filtered_stacks": f"""WITH {_S}, n AS (SELECT label, max(frame) AS last FROM s GROUP BY 1)
SELECT a.label, a.frame, a.i, CAST(median(b.v) AS BIGINT) AS v FROM s a JOIN n ON n.label = a.label, range(-1, 2) z(dz), range(-1, 2) r(dy), range(-1, 2) c(dx)
JOIN s b ON b.label = a.label AND b.frame = least(greatest(a.frame + dz, 0), last) AND b.i = least(greatest(a.i // 8 + dy, 0), 7) * 8 + least(greatest(a.i % 8 + dx, 0), 7) GROUP BY 1, 2, 3""",
    "blended_stacks": f"""WITH {_S}, e AS (SELECT label, min(v) AS low, max(v) AS high FROM s GROUP BY 1), g AS (SELECT label, frame, i, floor((v - low)::DOUBLE / (high - low)::DOUBLE * 255) AS c FROM s JOIN e USING (label))
SELECT label, frame, i, CAST(round_even((1 - 0.3::DOUBLE) * c + 0.3::DOUBLE * 255, 0) AS BIGINT) AS r FROM g""",
    "region_traces_of_stacks": f"WITH {_S} SELECT label, i % 5 AS roi, frame, round(sum(v * (1.0::DOUBLE + i / 64)) / sum(1.0::DOUBLE + i / 64), 5) AS value FROM s WHERE i % 5 < 3 AND i >= label GROUP BY 1, 2, 3",
    "exact_split": "SELECT vec_id, CASE WHEN row_number() OVER (ORDER BY md5('0:' || vec_id), vec_id) <= floor(count(*) OVER () * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM embeddings",
    "permuted_labels": f"WITH {_TURNS} SELECT place AS trial, CAST(type AS BIGINT) AS value FROM o",
    "tile_origins": """WITH s AS (SELECT p_partkey AS stack, CAST(p_size + 10 AS BIGINT) AS frames, CAST(p_size * 3 AS BIGINT) AS height, CAST(p_partkey % 40 + 1 AS BIGINT) AS width FROM part WHERE p_size + 10 >= 12),
n AS (SELECT *, greatest(1, CAST(ceil((height - 20 + 12) / 12) AS BIGINT)) AS ny, greatest(1, CAST(ceil((width - 20 + 12) / 12) AS BIGINT)) AS nx FROM s),
g AS (SELECT *, CAST(greatest(1, floor((frames - 12) / greatest(1, ceil(20000 / (ny * nx) / (SELECT count(*) FROM s)) - 1))) AS BIGINT) AS gap_s FROM n),
t AS (SELECT *, unnest(range(0, frames - 11, gap_s)) AS s0 FROM g), y AS (SELECT *, unnest(range(ny)) AS ky FROM t), x AS (SELECT *, unnest(range(nx)) AS kx FROM y),
o AS (SELECT *, (ky * nx + kx) * ((frames - 12) // gap_s + 1) + s0 // gap_s AS tile FROM x)
SELECT stack, tile, s0, CASE WHEN ky = ny - 1 THEN greatest(0, height - 20) ELSE ky * 12 END AS y0, CASE WHEN kx = nx - 1 THEN greatest(0, width - 20) ELSE kx * 12 END AS x0, gap_s, md5('0:' || stack || ':' || tile) AS place FROM o""",
}
