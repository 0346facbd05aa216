"""Registered queries of the alignment and signal operators, with the SQL that says the same.

Events stand in for recordings (session = user_id); even events are the behaviour's rows, odd ones the recorder's.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import alignment, kernels, recordings, signals, traces
from .queries import ORDER, _events, table
from .recording_queries import _timed


def _rows(e):
    return e.withColumn("row", (F.row_number().over(Window.partitionBy("user_id").orderBy(*ORDER)) - 1).cast("long"))


def _behaviour(spark, sf_dir):
    return _rows(_events(spark, sf_dir)).select("user_id", "row", F.col("event_type").alias("state"), (F.col("user_id") + F.col("row")).alias("t_ms"))


def _recorder(spark, sf_dir):
    return _rows(_events(spark, sf_dir)).select("user_id", "row", "value", (F.col("row") * 2.0).alias("time_ms"))


def _shifts(spark, sf_dir):
    return alignment.recording_shift(_behaviour(spark, sf_dir), _recorder(spark, sf_dir), "user_id", "state", "purchase", "value")


def selected_rows(spark, sf_dir):
    return alignment.selected(_events(spark, sf_dir), [("value", ">= 10"), ("event_type", ["purchase", "click"]), ("user_id", "!= 8")]).select("event_id", "event_type", "value")


def kept_neurons(spark, sf_dir):
    cells = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("user_id"), (F.col("s_acctbal") > 5000).cast("int").alias("is_cell"))
    return alignment.kept_neurons(_events(spark, sf_dir), cells, "user_id").select("event_id", "user_id")


def flipped_gate(spark, sf_dir):
    return alignment.flipped(_events(spark, sf_dir).withColumn("gate", F.col("event_id") % 2), "gate").select("event_id", "gate")


def swapped_indicators(spark, sf_dir):
    e = _events(spark, sf_dir)
    trials = e.where("event_type = 'purchase'").groupBy("user_id").agg((F.count("*") * 2).alias("n_trials"))
    return alignment.indicators_swapped(e.withColumn("twice", F.col("value") * 2), trials, "user_id", ORDER, "value", "twice").select("event_id", "value", "twice")


def grid_channels(spark, sf_dir):
    e = _timed(spark, sf_dir).withColumn("day", F.floor(F.col("t") / 86_400_000_000))
    kinds = {k: e.where(F.col("event_type") == k).groupBy("user_id", "day").agg(F.round(F.sum("value"), 6).alias("value")) for k in ("click", "purchase")}
    return alignment.on_grid(e.select("user_id", "day").distinct(), kinds, ["user_id", "day"])


def stimulus_by_row(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("state", F.expr("case event_id % 11 when 0 then 'rest' when 1 then 'rest' else if(event_id % 3 = 0, 'trial', 'wait') end"))
    e = recordings.trial_sets(e, "user_id", ORDER, "state", "trial", "rest")
    trials = e.where("trial_set >= 0 and trial_set % 4 <> 3").select("user_id", F.col("trial_set").alias("trial"), ((F.col("trial_set") * 7) % 5).alias("stimulus")).distinct()
    return alignment.with_stimulus(e, trials, "user_id", ORDER).select("event_id", F.coalesce("stimulus", F.lit(-1)).cast("long").alias("stimulus"))


def recording_aligned(spark, sf_dir):
    d = alignment.recording_aligned(_behaviour(spark, sf_dir), _recorder(spark, sf_dir), _shifts(spark, sf_dir), "user_id", ["value"])
    return d.select("user_id", "t_ms", "state", "value")


def frames_aligned(spark, sf_dir):
    frames = _recorder(spark, sf_dir).select("user_id", F.col("row").alias("frame"), (F.col("row") * 0.003 + 0.0012).alias("relative_time"))
    d = alignment.frames_aligned(_behaviour(spark, sf_dir), frames, _recorder(spark, sf_dir), _shifts(spark, sf_dir), "user_id")
    return d.select("user_id", "t_ms", F.col("imaging_frame").cast("double").alias("imaging_frame"), F.col("filled_imaging_frame").cast("double").alias("filled"))


def downsampled_aligned(spark, sf_dir):
    frames = _recorder(spark, sf_dir).select("user_id", F.col("row").alias("frame"))
    line = _behaviour(spark, sf_dir).withColumn("imaging_frame", F.when(F.col("row") % 5 != 0, F.col("row")))
    d = alignment.downsampled_aligned(line, frames, "user_id", 3, 2, 3)
    return d.select("user_id", "t_ms", F.col("downsampled_frame").cast("double").alias("frame"), F.col("filled_downsampled_frame").cast("double").alias("filled"))


def pose_aligned(spark, sf_dir):
    line = _behaviour(spark, sf_dir).select("user_id", "t_ms", F.when(F.col("row") % 12 < 10, "run").alias("stage"), F.floor(F.col("row") / 12).alias("trial"))
    pose = _recorder(spark, sf_dir).select("user_id", F.lit("run").alias("stage"), F.floor(F.col("row") / 5).alias("trial"), F.col("row").alias("frame"), F.col("value").alias("x"), F.col("value").alias("y"))
    return alignment.pose_aligned(line, pose, "user_id", {"x": "max", "y": "0"}).select("user_id", "t_ms", "x", "y")


def voltage_signals(spark, sf_dir):
    names = table(spark, sf_dir, "nation").select(F.concat(F.lit(" "), "n_name").alias("name"), F.col("n_regionkey").alias("channel"))
    return alignment.voltage_signals(names, table(spark, sf_dir, "region").where("r_name in ('AMERICA', 'EUROPE')").select(F.col("r_regionkey").alias("channel"))).select("name", F.col("channel").cast("long").alias("channel"))


def _planes(spark, sf_dir):
    d = traces.numbered(_events(spark, sf_dir), "user_id", ORDER, "row")
    return d.select("user_id", F.floor(F.col("row") / 4).alias("volume"), (F.col("row") % 4).alias("plane"), F.col("value").alias("relative_time"))


def plane_times(spark, sf_dir):
    d = alignment.plane_times(_planes(spark, sf_dir), "user_id")
    return d.select("user_id", "plane", F.size("times").cast("long").alias("n"), F.md5(F.array_join(F.transform("times", lambda x: F.round(x * 100).cast("long").cast("string")), ",")).alias("times"))


def first_plane_placed(spark, sf_dir):
    return alignment.first_plane_placed(_planes(spark, sf_dir), ["user_id", "volume"], ["relative_time"]).select("user_id", "volume", "plane", F.col("relative_time").alias("x"))


def reference_frames(spark, sf_dir):
    frames = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"))
    return alignment.reference_frames(frames, 37)


def firing_rates(spark, sf_dir):
    return traces.firing_rate(_events(spark, sf_dir), "value", 6.0).select("event_id", F.round("firing_rate", 6).alias("firing_rate"))


def _matrix(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("neuron", "v")).select(F.col("neuron").cast("long").alias("neuron"), F.col("vec_id").alias("frame"), (F.col("v").cast("double") + 2).alias("value"))


def mean_dff(spark, sf_dir):
    """Mean dF/F of each neuron and bin of eight frames."""
    d = signals.relative_fluorescence(_matrix(spark, sf_dir), ["neuron"], "frame", "value", 6.0, how="mean")
    return traces.binned(d, "neuron", "frame", "value", 8).select("neuron", "bin", F.round("value", 6).alias("value"))


def dff_by_tiff(spark, sf_dir):
    d = _matrix(spark, sf_dir).withColumn("tiff", F.floor(F.col("frame") / 100))
    return signals.relative_fluorescence(d, ["neuron"], "frame", "value", 6.0, tiff="tiff").select("neuron", "frame", F.round("value", 6).alias("value"))


def diffused_traces(spark, sf_dir):
    d = signals.diffused(_events(spark, sf_dir).withColumn("k", F.col("event_id")), ["user_id"], "ts", "value", times=2, kappa=8.0, option=2)
    return d.select("event_id", F.round("value", 6).alias("value"))


def detrended_order_4(spark, sf_dir):
    return signals.polynomial_detrended(_matrix(spark, sf_dir), ["neuron"], "frame", "value").select("neuron", "frame", F.round("value", 6).alias("value"))


def low_passed(spark, sf_dir):
    return signals.low_passed(_matrix(spark, sf_dir), ["neuron"], "frame", "value", 10.0, 1.0).select("neuron", "frame", F.round("value", 6).alias("value"))


def smoothed_rates(spark, sf_dir):
    """sigma 0.5: two samples to each side."""
    return signals.smoothed_rates(_matrix(spark, sf_dir), [], "neuron", "frame", "value", 0.5).select("neuron", "frame", F.round("value", 6).alias("value"))


QUERIES = {f.__name__: f for f in (selected_rows, kept_neurons, flipped_gate, swapped_indicators, grid_channels, stimulus_by_row, recording_aligned, frames_aligned, downsampled_aligned, pose_aligned, voltage_signals, plane_times, first_plane_placed, reference_frames, firing_rates, mean_dff, dff_by_tiff, diffused_traces, detrended_order_4, low_passed, smoothed_rates)}

_W = "OVER (PARTITION BY user_id ORDER BY ts, event_id)"
_BEHAVIOUR = f"b AS (SELECT user_id, row_number() {_W} - 1 AS row, event_type AS state, user_id + row_number() {_W} - 1 AS t_ms FROM events)"
_RECORDER = f"r AS (SELECT user_id, row_number() {_W} - 1 AS row, value FROM events)"
_SHIFT = """e AS (SELECT user_id, min(row) AS edge FROM (SELECT user_id, row, value - lag(value) OVER (PARTITION BY user_id ORDER BY row) AS d FROM r) WHERE d > 1 GROUP BY 1),
s AS (SELECT e.user_id, edge - first AS shift, began FROM e JOIN r ON r.user_id = e.user_id AND r.row = e.edge AND r.value >= 3.3
 JOIN (SELECT user_id, min(row) FILTER (state = 'purchase') AS first, min(t_ms) AS began FROM b GROUP BY 1) f ON f.user_id = e.user_id WHERE first IS NOT NULL)"""
_ROUND = "CAST(round_even({}, 0) AS BIGINT)"


def _near(source, key, value):
    """SQL for the nearest known `value` by t_ms within `key`."""
    p = f"PARTITION BY {key} ORDER BY t_ms"
    back, ahead = f"({p} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", f"({p} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    t = f"CASE WHEN {value} IS NOT NULL THEN t_ms END"
    return f"""(SELECT *, CASE WHEN bt IS NOT NULL AND nt IS NOT NULL THEN CASE WHEN t_ms - bt <= nt - t_ms THEN bv ELSE nv END END AS near FROM (SELECT *, last_value({value} IGNORE NULLS) OVER {back} AS bv,
 last_value({t} IGNORE NULLS) OVER {back} AS bt, first_value({value} IGNORE NULLS) OVER {ahead} AS nv, first_value({t} IGNORE NULLS) OVER {ahead} AS nt FROM {source}))"""


_TRIALS = f"""e AS (SELECT *, CASE WHEN event_id % 11 IN (0, 1) THEN 'rest' WHEN event_id % 3 = 0 THEN 'trial' ELSE 'wait' END AS state FROM events),
r AS (SELECT event_id, user_id, state, row_number() {_W} AS k, CASE WHEN state = 'trial' AND lead(state) {_W} IS DISTINCT FROM 'trial' THEN 1 ELSE 0 END AS fin FROM e), h AS (SELECT user_id, max(k) AS last FROM r WHERE state = 'rest' GROUP BY 1),
t AS (SELECT event_id, user_id, k, CASE WHEN k <= coalesce(last, 0) THEN -1 ELSE CAST(sum(fin) OVER (PARTITION BY user_id ORDER BY k) - fin AS BIGINT) END AS ts FROM r LEFT JOIN h USING (user_id))"""
_MATRIX = "m AS (SELECT CAST(unnest(range(64)) AS BIGINT) AS neuron, vec_id AS frame, CAST(unnest(embedding) AS DOUBLE) + 2 AS value FROM embeddings)"
_STEP = "SELECT event_id, user_id, ts, x + 0.15 * (m - coalesce(lag(m) OVER w, 0)) AS x FROM (SELECT *, d / (1 + (d / 8.0) * (d / 8.0)) AS m FROM (SELECT *, coalesce(lead(x) OVER v - x, 0) AS d FROM {} WINDOW v AS (PARTITION BY user_id ORDER BY ts))) WINDOW w AS (PARTITION BY user_id ORDER BY ts)"
ORACLE_SQL = {
    "selected_rows": "SELECT event_id, event_type, value FROM events WHERE value >= 10 AND event_type IN ('purchase', 'click') AND user_id <> 8",
    "kept_neurons": "SELECT event_id, user_id FROM events WHERE user_id IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)",
    "flipped_gate": "SELECT event_id, 1 - event_id % 2 AS gate FROM events",
    "swapped_indicators": f"""WITH n AS (SELECT user_id, count(*) FILTER (event_type = 'purchase') * 2 AS due, count(*) FILTER (d > 1) AS found FROM (SELECT *, value - lag(value) {_W} AS d FROM events) GROUP BY 1)
SELECT event_id, CASE WHEN found > due THEN value * 2 ELSE value END AS value, CASE WHEN found > due THEN value ELSE value * 2 END AS twice FROM events JOIN n USING (user_id)""",
    "grid_channels": "SELECT user_id, epoch_us(ts) // 86400000000 AS day, round(sum(value) FILTER (event_type = 'click'), 6) AS click, round(sum(value) FILTER (event_type = 'purchase'), 6) AS purchase FROM events GROUP BY 1, 2",
    "stimulus_by_row": f"""WITH {_TRIALS}, n AS (SELECT user_id, count(DISTINCT (ts * 7) % 5) FILTER (ts >= 0 AND ts % 4 <> 3) AS none FROM t GROUP BY 1),
q AS (SELECT t.event_id, t.user_id, t.k, CASE WHEN k = 1 THEN CASE WHEN none > 0 THEN none END WHEN ts >= 0 AND ts % 4 <> 3 AND ts IS DISTINCT FROM lag(ts) OVER (PARTITION BY t.user_id ORDER BY k) THEN (ts * 7) % 5 END AS mark FROM t JOIN n ON n.user_id = t.user_id)
SELECT event_id, CAST(coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -1) AS BIGINT) AS stimulus FROM q""",
    "recording_aligned": f"WITH {_BEHAVIOUR}, {_RECORDER}, {_SHIFT} SELECT b.user_id, b.t_ms, state, x.value FROM b LEFT JOIN (SELECT r.user_id, began + row - shift AS t_ms, value FROM r JOIN s ON s.user_id = r.user_id WHERE row >= shift) x ON x.user_id = b.user_id AND x.t_ms = b.t_ms",
    "frames_aligned": f"""WITH {_BEHAVIOUR}, {_RECORDER}, {_SHIFT}, z AS (SELECT s.user_id, began, row * 2.0::DOUBLE / 1000 AS zero FROM s JOIN r ON r.user_id = s.user_id AND r.row = s.shift),
f AS (SELECT user_id, t_ms, min(row) AS f FROM (SELECT r.user_id, row, began, began + {_ROUND.format("(row * 0.003::DOUBLE + 0.0012::DOUBLE - zero) * 1000")} AS t_ms FROM r JOIN z ON z.user_id = r.user_id) WHERE t_ms >= began GROUP BY 1, 2),
j AS (SELECT b.user_id, b.t_ms, f FROM b LEFT JOIN f ON f.user_id = b.user_id AND f.t_ms = b.t_ms) SELECT user_id, t_ms, CAST(f AS DOUBLE) AS imaging_frame, CAST(near AS DOUBLE) AS filled FROM {_near("j", "user_id", "f")}""",
    "downsampled_aligned": f"""WITH {_BEHAVIOUR}, {_RECORDER}, c AS (SELECT user_id, CASE WHEN n % 3 >= 2 THEN n % 3 ELSE 2 + (n - 2) % 3 END * 3 AS low FROM (SELECT user_id, CAST(ceil(count(*) / 3) AS BIGINT) AS n FROM r GROUP BY 1)),
h AS (SELECT b.user_id, t_ms, coalesce(row % 5 <> 0 AND row >= low AND (row - low) % 3 = 1, false) AS hit FROM b LEFT JOIN c ON c.user_id = b.user_id),
j AS (SELECT *, CASE WHEN hit THEN sum(hit::INT) OVER (PARTITION BY user_id ORDER BY t_ms) - 1 END AS f FROM h) SELECT user_id, t_ms, CAST(f AS DOUBLE) AS frame, CAST(near AS DOUBLE) AS filled FROM {_near("j", "user_id", "f")}""",
    "pose_aligned": f"""WITH {_BEHAVIOUR}, {_RECORDER}, l AS (SELECT user_id, t_ms, row % 12 < 10 AS run, row // 12 AS trial FROM b), g AS (SELECT user_id, trial, min(t_ms) AS low, max(t_ms) AS high FROM l WHERE run GROUP BY 1, 2),
p AS (SELECT user_id, row // 5 AS trial, row % 5 AS k, count(*) OVER (PARTITION BY user_id, row // 5) AS n, value FROM r),
q AS (SELECT p.user_id, p.trial, low + {_ROUND.format("(high - low) * k / greatest(n - 1, 1)")} AS t_ms, arg_max(value, k) AS v FROM p JOIN g ON g.user_id = p.user_id AND g.trial = p.trial GROUP BY 1, 2, 3),
j AS (SELECT l.user_id, l.t_ms, run, l.trial, v FROM l LEFT JOIN q ON run AND q.user_id = l.user_id AND q.trial = l.trial AND q.t_ms = l.t_ms), d AS {_near("j", "user_id, run, trial", "v")}
SELECT user_id, t_ms, coalesce(near, max(near) OVER (PARTITION BY user_id)) AS x, coalesce(near, 0) AS y FROM d""",
    "voltage_signals": "SELECT n_name AS name, CAST(n_regionkey AS BIGINT) AS channel FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name IN ('AMERICA', 'EUROPE'))",
    "plane_times": f"""WITH p AS (SELECT user_id, (row_number() {_W} - 1) // 4 AS v, (row_number() {_W} - 1) % 4 AS plane, value FROM events), n AS (SELECT user_id, v, count(*) AS n FROM p GROUP BY 1, 2),
l AS (SELECT user_id, v, n, lag(n) OVER (PARTITION BY user_id ORDER BY v) AS b, lead(v) OVER (PARTITION BY user_id ORDER BY v) AS f FROM n)
SELECT user_id, plane, count(*) AS n, md5(string_agg(CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR), ',' ORDER BY v)) AS times FROM p JOIN l USING (user_id, v) WHERE NOT (f IS NULL AND b IS NOT NULL AND n <> b) GROUP BY 1, 2""",
    "first_plane_placed": f"""WITH p AS (SELECT user_id, (row_number() {_W} - 1) // 4 AS volume, (row_number() {_W} - 1) % 4 AS plane, value FROM events)
SELECT user_id, volume, plane, CASE WHEN plane = 0 THEN coalesce(lead(value) OVER (PARTITION BY user_id, volume ORDER BY plane), value) ELSE value END AS x FROM p""",
    "reference_frames": "WITH n AS (SELECT count(*) AS n, least(count(*), 37) AS m FROM embeddings) SELECT vec_id AS frame FROM embeddings WHERE vec_id IN (SELECT i * n // m FROM n, range(37) t(i) WHERE i < m)",
    "firing_rates": "SELECT event_id, round(value * 6, 6) AS firing_rate FROM events",
    "mean_dff": f"""WITH {_MATRIX}, o AS (SELECT neuron, frame, value + 0.0001::DOUBLE AS v, avg(value + 0.0001::DOUBLE) OVER (PARTITION BY neuron ORDER BY frame ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS low FROM m),
f AS (SELECT neuron, quantile_cont(low, 0.05) AS f0 FROM o GROUP BY 1) SELECT neuron, frame // 8 AS bin, round(avg((v - f0) / f0), 6) AS value FROM o JOIN f USING (neuron) GROUP BY 1, 2 HAVING count(*) = 8""",
    "diffused_traces": f"SELECT event_id, round(x, 6) AS value FROM ({_STEP.format('(' + _STEP.format('(SELECT event_id, user_id, ts, value AS x FROM events)') + ')')})",
    "smoothed_rates": f"""WITH {_MATRIX}, n AS (SELECT max(frame) AS last FROM m), w AS (SELECT k, exp(-0.5::DOUBLE * (k / 0.5::DOUBLE) * (k / 0.5::DOUBLE)) AS w FROM range(-2, 3) t(k)),
s AS (SELECT a.neuron, a.frame, sum(b.value * w) / sum(w) AS v FROM m a, n, w JOIN m b ON b.neuron = a.neuron AND b.frame = CASE WHEN a.frame + k < 0 THEN -1 - a.frame - k WHEN a.frame + k > last THEN 2 * last + 1 - a.frame - k ELSE a.frame + k END GROUP BY 1, 2)
SELECT neuron, frame, round(greatest(v / max(v) OVER (PARTITION BY frame), 0), 6) AS value FROM s""",
}

# the 30 taps run forward and backward are one symmetric filter of 59; ends are reflected at the edge sample
_TAPS = ", ".join(f"({k}, {w!r}::DOUBLE)" for k, w in zip(range(-29, 30), np.convolve(*[kernels.windowed_sinc(30, 1.0 / 3)] * 2).tolist()))
ORACLE_SQL["dff_by_tiff"] = f"""WITH {_MATRIX}, o AS (SELECT neuron, frame // 100 AS tiff, frame, value + 0.0001::DOUBLE AS v, row_number() OVER t - 2 AS i, count(*) OVER (PARTITION BY neuron, frame // 100) - 1 AS n FROM m WINDOW t AS (PARTITION BY neuron, frame // 100 ORDER BY frame)),
x AS (SELECT * FROM o WHERE i >= 0), h AS (SELECT * FROM (VALUES {_TAPS}) h(k, w)), e AS (SELECT neuron, tiff, arg_min(v, i) AS first, arg_max(v, i) AS last FROM x GROUP BY 1, 2),
q AS (SELECT x.neuron, x.tiff, x.i, w, CASE WHEN i + k < 0 THEN -i - k WHEN i + k >= n THEN 2 * (n - 1) - i - k ELSE i + k END AS j, CASE WHEN i + k < 0 THEN -1 WHEN i + k >= n THEN 1 ELSE 0 END AS side FROM x, h),
y AS (SELECT q.neuron, q.tiff, q.i, sum(w * CASE side WHEN 0 THEN x.v WHEN 1 THEN 2 * last - x.v ELSE 2 * first - x.v END) AS y FROM q JOIN x ON x.neuron = q.neuron AND x.tiff = q.tiff AND x.i = j JOIN e ON e.neuron = q.neuron AND e.tiff = q.tiff GROUP BY 1, 2, 3),
f AS (SELECT neuron, tiff, greatest((SELECT 0.0::DOUBLE), greatest(quantile_cont(y, 0.05), (SELECT min(v) FROM o WHERE o.neuron = y.neuron AND o.tiff = y.tiff))) AS f0 FROM y GROUP BY 1, 2)
SELECT neuron, frame, round((v - f0) / f0, 6) AS value FROM o JOIN f USING (neuron, tiff)"""

# forward and backward recursion over a trace with nine reflected samples at each end, begun in the steady state of its first sample
_B, _A = (c.tolist() for c in kernels.butterworth(2, 0.2))
_Z = kernels.steady(kernels.recursion(*kernels.butterworth(2, 0.2))).tolist()
_PASS = """{name} AS (SELECT neuron, j, n, {b0!r}::DOUBLE * v + {z0!r}::DOUBLE * v AS y, {z1!r}::DOUBLE * v + {b1!r}::DOUBLE * v - {a1!r}::DOUBLE * ({b0!r}::DOUBLE * v + {z0!r}::DOUBLE * v) AS s, {b2!r}::DOUBLE * v - {a2!r}::DOUBLE * ({b0!r}::DOUBLE * v + {z0!r}::DOUBLE * v) AS u FROM {source} WHERE {begin}
UNION ALL SELECT q.neuron, w.j, q.n, {b0!r}::DOUBLE * v + s, u + {b1!r}::DOUBLE * v - {a1!r}::DOUBLE * ({b0!r}::DOUBLE * v + s), {b2!r}::DOUBLE * v - {a2!r}::DOUBLE * ({b0!r}::DOUBLE * v + s) FROM {name} q JOIN {source} w ON w.neuron = q.neuron AND w.j = q.j {step})"""
_pass = lambda name, source, begin, step: _PASS.format(name=name, source=source, begin=begin, step=step, b0=_B[0], b1=_B[1], b2=_B[2], a1=_A[1], a2=_A[2], z0=_Z[0], z1=_Z[1])
ORACLE_SQL["low_passed"] = f"""WITH RECURSIVE {_MATRIX}, x AS MATERIALIZED (SELECT neuron, value AS v, row_number() OVER (PARTITION BY neuron ORDER BY frame) - 1 AS i, count(*) OVER (PARTITION BY neuron) AS n FROM m),
e AS (SELECT neuron, n, arg_min(v, i) AS first, arg_max(v, i) AS last FROM x GROUP BY 1, 2), p AS (SELECT neuron, n, first, last, unnest(range(-9, n + 9)) AS j FROM e),
w AS MATERIALIZED (SELECT p.neuron, p.j, p.n, CASE WHEN j < 0 THEN 2 * first - v WHEN j >= p.n THEN 2 * last - v ELSE v END AS v FROM p JOIN x ON x.neuron = p.neuron AND x.i = CASE WHEN j < 0 THEN -j WHEN j >= p.n THEN 2 * (p.n - 1) - j ELSE j END),
{_pass('f', 'w', 'j = -9', '+ 1')}, g AS MATERIALIZED (SELECT neuron, j, n, y AS v FROM f), {_pass('b', 'g', 'j = n + 8', '- 1')}
SELECT m.neuron, m.frame, round(y, 6) AS value FROM b JOIN x ON x.neuron = b.neuron AND x.i = j JOIN (SELECT neuron, frame, row_number() OVER (PARTITION BY neuron ORDER BY frame) - 1 AS i FROM m) m ON m.neuron = x.neuron AND m.i = x.i"""

# polynomials that are orthogonal over the frames, each from the two before
_NEXT = """c{k} AS (SELECT a.frame, a.t, (a.t - s.alpha) * a.p - coalesce(s.beta, 0) * b.p AS p FROM c{h} a JOIN {g} b ON b.frame = a.frame, (SELECT sum(a.t * a.p * a.p) / sum(a.p * a.p) AS alpha, sum(a.p * a.p) / nullif(sum(b.p * b.p), 0) AS beta FROM c{h} a JOIN {g} b ON b.frame = a.frame) s)"""
_POLYNOMIALS = ", ".join(_NEXT.format(k=k, h=k - 1, g="z" if k == 1 else f"c{k - 2}") for k in range(1, 5))
ORACLE_SQL["detrended_order_4"] = f"""WITH {_MATRIX}, c0 AS (SELECT frame, 2 * frame::DOUBLE / max(frame) OVER () - 1 AS t, 1.0::DOUBLE AS p FROM (SELECT DISTINCT frame FROM m)), z AS (SELECT frame, 0.0::DOUBLE AS p FROM c0), {_POLYNOMIALS},
c AS ({' UNION ALL '.join(f'SELECT {k} AS k, frame, p FROM c{k}' for k in range(5))}), f AS (SELECT neuron, k, sum(value * p) / sum(p * p) AS c FROM m JOIN c USING (frame) GROUP BY 1, 2),
r AS (SELECT neuron, frame, sum(c * p) AS fit FROM f JOIN c USING (k) GROUP BY 1, 2) SELECT neuron, frame, round(value - fit, 6) AS value FROM m JOIN r USING (neuron, frame)"""
