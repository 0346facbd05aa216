"""Registered queries of the library's own operators, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import decoding, timeline, traces

ORDER = ["ts", "event_id"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")


def rising_edges(spark, sf_dir):
    return traces.rising_edges(_events(spark, sf_dir), "user_id", ORDER, "value").select("event_id", F.round("rise", 6).alias("rise"))


def bin_mean(spark, sf_dir):
    e = traces.numbered(_events(spark, sf_dir), "user_id", ORDER)
    return traces.binned(e, "user_id", "frame", "value", 5).select("user_id", "bin", F.round("value", 6).alias("value"))


def bin_sum(spark, sf_dir):
    e = traces.numbered(_events(spark, sf_dir), "user_id", ORDER)
    return traces.binned(e, "user_id", "frame", "value", 5, "sum").select("user_id", "bin", F.round("value", 6).alias("value"))


def mean_rate(spark, sf_dir):
    return traces.mean_rate(_events(spark, sf_dir), "user_id", "value").select("user_id", F.round("mean_rate", 6).alias("mean_rate"))


def standardised_noise(spark, sf_dir):
    return traces.standardised_noise(_events(spark, sf_dir), "user_id", ORDER, "value", 6.0).select("user_id", F.round("noise", 6).alias("noise"))


def covariance(spark, sf_dir):
    return traces.covariance(table(spark, sf_dir, "embeddings").select("embedding"), "embedding", 64).select("i", "j", F.round("cov", 8).alias("cov"))


def state_codes(spark, sf_dir):
    return timeline.state_codes(_events(spark, sf_dir), "event_type").select("event_type", F.col("code").cast("long").alias("code"))


def asof_state(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("seen", F.when(F.col("event_id") % 10 == 0, F.col("event_type")))
    return timeline.filled_forward(e, "user_id", ORDER, "seen", "state").select("event_id", "state")


def accepted_sessions(spark, sf_dir):
    return timeline.accepted_sessions(_events(spark, sf_dir), "user_id", ["value"], 1.0).select("event_id", "user_id")


def dominant_extension(spark, sf_dir):
    return timeline.dominant_extension(table(spark, sf_dir, "pages").select("url"), "url")


def stimulus_summary(spark, sf_dir):
    return timeline.stimulus_summary(table(spark, sf_dir, "embeddings").select("label"), "label")


def gate_share(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("gate", (F.col("event_id") % 3 == 0).cast("int"))
    return timeline.trial_gate_share(e, "event_type", "gate").select("event_type", F.round("percent", 6).alias("percent"))


def step_distance(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("y", F.col("value") * 2)
    return traces.step_distance(e, "user_id", ORDER, "value", "y").select("event_id", F.round("distance", 6).alias("distance"))


def physical_units(spark, sf_dir):
    return traces.rescaled(_events(spark, sf_dir), "value", (-10.0, 10.0)).select("event_id", F.round("value", 6).alias("value"))


def mean_zero(spark, sf_dir):
    return traces.mean_zero(_events(spark, sf_dir), "user_id", "value").select("event_id", F.round("value", 5).alias("value"))


def classification_metrics(spark, sf_dir):
    m = decoding.binary_metrics(table(spark, sf_dir, "labels").select("quality", "toxic"), "quality", "toxic")
    return m.select("tp", "fp", "fn", "tn", *[F.round(c, 8).alias(c) for c in m.columns[4:]])


def regression_metrics(spark, sf_dir):
    m = decoding.regression_metrics(table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").cast("double").alias("t"), (F.col("l_quantity").cast("double") * 1500).alias("p")), "t", "p")
    return m.select(F.round("mae", 3).alias("mae"), F.round(F.col("mse") / 1e6, 4).alias("mse"), F.round("r2", 8).alias("r2"))


QUERIES = {f.__name__: f for f in (rising_edges, bin_mean, bin_sum, mean_rate, standardised_noise, covariance, state_codes, asof_state, accepted_sessions, dominant_extension, stimulus_summary, gate_share, step_distance, physical_units, mean_zero, classification_metrics, regression_metrics)}

_W = "OVER (PARTITION BY user_id ORDER BY ts, event_id)"
_BIN = f"SELECT user_id, bin, round({{0}}(value), 6) AS value FROM (SELECT user_id, value, CAST(floor((row_number() {_W} - 1) / 5) AS BIGINT) AS bin FROM events) GROUP BY ALL HAVING count(*) = 5"
ORACLE_SQL = {
    "rising_edges": f"SELECT event_id, round(rise, 6) AS rise FROM (SELECT event_id, value - lag(value) {_W} AS rise FROM events) WHERE rise > 1",
    "bin_mean": _BIN.format("avg"),
    "bin_sum": _BIN.format("sum"),
    "mean_rate": "SELECT user_id, round(avg(value), 6) AS mean_rate FROM events GROUP BY user_id",
    "standardised_noise": f"SELECT user_id, round(median(step) / sqrt(6.0), 6) AS noise FROM (SELECT user_id, abs(value - lag(value) {_W}) AS step FROM events) GROUP BY user_id",
    "covariance": "WITH v AS (SELECT vec_id, CAST(unnest(range(64)) AS INT) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) SELECT a.i AS i, b.i AS j, round(covar_samp(a.x, b.x), 8) AS cov FROM v a JOIN v b USING (vec_id) WHERE a.i <= b.i GROUP BY ALL",
    "state_codes": "SELECT event_type, dense_rank() OVER (ORDER BY event_type) - 1 AS code FROM (SELECT DISTINCT event_type FROM events)",
    "asof_state": "SELECT event_id, last_value(CASE WHEN event_id % 10 = 0 THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS state FROM events",
    "accepted_sessions": "SELECT event_id, user_id FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY 1 HAVING min(value) > 1.0)",
    "dominant_extension": r"SELECT regexp_extract(url, '\.([A-Za-z0-9]+)$', 1) AS ext, count(*) AS n FROM pages GROUP BY 1 ORDER BY n DESC, ext LIMIT 1",
    "stimulus_summary": "WITH p AS (SELECT label, count(*) AS n_trials FROM embeddings GROUP BY 1) SELECT label, n_trials, (SELECT min(n_trials) = max(n_trials) FROM p) AS balanced FROM p",
    "gate_share": "SELECT event_type, round(100.0 * sum(CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END) / count(*), 6) AS percent FROM events GROUP BY 1",
    "step_distance": f"SELECT event_id, round(coalesce(sqrt((value - lag(value) {_W})**2 + (2*value - lag(2*value) {_W})**2), 0), 6) AS distance FROM events",
    "physical_units": "SELECT event_id, round((value + 10) * 7.0, 6) AS value FROM events",
    "mean_zero": "SELECT event_id, round(value - avg(value) OVER (PARTITION BY user_id), 5) AS value FROM events",
    "classification_metrics": """WITH c AS (SELECT CAST(count(*) FILTER (quality=1 AND toxic=1) AS BIGINT) AS tp, count(*) FILTER (quality=0 AND toxic=1) AS fp, count(*) FILTER (quality=1 AND toxic=0) AS fn, count(*) FILTER (quality=0 AND toxic=0) AS tn FROM labels)
SELECT tp, fp, fn, tn, round((tp+tn)/(tp+tn+fp+fn),8) AS accuracy, round(tp/(tp+fp),8) AS "precision", round(tp/(tp+fn),8) AS recall, round(2*tp/(2*tp+fp+fn),8) AS f1, round((tp/(tp+fn)+tn/(tn+fp))/2,8) AS balanced_accuracy FROM c""",
    "regression_metrics": "SELECT round(avg(abs(t-p)),3) AS mae, round(avg((t-p)**2)/1e6,4) AS mse, round(1-avg((t-p)**2)/var_pop(t),8) AS r2 FROM (SELECT CAST(l_extendedprice AS DOUBLE) AS t, CAST(l_quantity AS DOUBLE)*1500 AS p FROM lineitem)",
}
