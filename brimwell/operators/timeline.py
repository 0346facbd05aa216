"""Timeline operators: states, as-of fills, gates and trial bookkeeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .running import beside, running_last
from .traces import filled, known


def state_codes(df: DataFrame, state: str) -> DataFrame:
    """(state, code): rank among the distinct states, from 0. There are as many rows as states."""
    return df.where(F.col(state).isNotNull()).select(state).distinct().withColumn("code", F.dense_rank().over(Window.orderBy(state)) - 1)


def filled_forward(df: DataFrame, key: str, order: list[str], value: str, name: str, segment: Column | None = None) -> DataFrame:
    """As-of backward: the last known value up to each row; NaN is not known."""
    return running_last(df, key, order, filled(df, value), name, segment=segment)


def accepted_sessions(df: DataFrame, key: str, likelihoods: list[str], least: float) -> DataFrame:
    """Rows of the sessions in which the least known value of every likelihood is above the bound; a session with none known is rejected."""
    bounds = [(F.min(known(c)) > least).alias(f"_{k}") for k, c in enumerate(likelihoods)]
    good = df.groupBy(F.col(key).alias("_key")).agg(*bounds).where(" and ".join(f"_{k}" for k in range(len(likelihoods)))).select("_key")
    return df.join(good, F.col(key).eqNullSafe(F.col("_key")), "left_semi")


def dominant_extension(paths: DataFrame, path: str) -> DataFrame:
    """The most frequent ending (ties: first by name) and its count."""
    ext = F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)
    return paths.groupBy(ext.alias("ext")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ext").limit(1)


def stimulus_summary(trials: DataFrame, stimulus: str, trial: str | None = None) -> DataFrame:
    """Trials per stimulus, whether all stimuli have as many, and with `trial` the sorted trial ids (bounded by a session's trials)."""
    ids = [F.sort_array(F.collect_list(trial)).alias("trials")] if trial else []
    per = trials.groupBy(stimulus).agg(F.count("*").alias("n_trials"), *ids)
    return per.crossJoin(F.broadcast(per.agg((F.min("n_trials") == F.max("n_trials")).alias("balanced"))))  # one row


def trial_gate_share(df: DataFrame, stimulus: str, gate: str, dropped: int = 0, of: int = 1, *, state: str | None = None, trial: str = "Trial", trials: DataFrame | None = None, by: tuple[str, ...] = (), trial_number: str = "trial_set") -> DataFrame:
    """Percent of rows with the gate up, per stimulus (and `by`); divided by the share of trials that were not dropped.

    state: only rows in that column's state `trial` count.  trials (by, trial_number, stimulus) gives rows their stimulus by the
    number of their trial; rows of other trials do not count.  Unknown gates are left out.
    """
    d = df.where(F.col(state) == trial) if state else df
    if trials is not None:
        d = beside(d.drop(stimulus) if stimulus in d.columns else d, trials.select(*by, trial_number, stimulus), [*by, trial_number])
    return d.groupBy(*by, stimulus).agg((100.0 * F.sum(gate) / F.count(gate) / ((of - dropped) / of)).alias("percent"))
