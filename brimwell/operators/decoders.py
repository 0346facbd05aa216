"""The data side of decoders: trial tensors, features, splits, permutations, curves.

Random orders are ranks of MD5 hashes of a seed and a number, so they are the same on every run and cluster.  Ranks of trials and running sums of
curves are found range by range (operators/ranks), so no group has to fit in a task.  NaN counts as null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import accumulated, ranked
from .running import beside
from .traces import known

FEATURES = ("plus_cs", "minus_cs", "plus_trace", "minus_trace", "plus_trial", "minus_trial", "ucs")
ROWS = 1 << 19  # rows of features that a task makes
SESSIONS = 100_000  # lengths, one row for each session, that are broadcast


def _rank_key(seed: str, *columns: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), *[F.col(c).cast("string") for c in columns]))


def to_matrix(tensor: DataFrame, frames: int) -> DataFrame:
    """Frames of all trials side by side: (trial, frame) becomes frame = trial * frames + frame."""
    return tensor.withColumn("frame", F.col("trial") * frames + F.col("frame")).drop("trial")


def to_tensor(matrix: DataFrame, frames: int) -> DataFrame:
    """Equal trials: frame becomes (trial, frame)."""
    return matrix.withColumn("trial", F.floor(F.col("frame") / frames)).withColumn("frame", F.pmod(F.col("frame"), F.lit(frames)))


def trial_features(trials: DataFrame, frames: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, trial, feature, frame, value): seven 0/1 rows for each trial, in the order of FEATURES counted from 0.

    trials is (keys, trial, stimulus, cs_start, cs_end, ucs_start, ucs_end, trial_start, trial_end); stimulus 0 is plus.  Lengths come from the first
    trial, those of the unconditioned stimulus from the first plus trial.  Trials are counted and dealt over tasks by (keys, trial) before their rows
    are made: a small file of trials is not one task's work, and what is grouped by trial afterwards needs no other shuffle.
    """
    n, sessions = trials.agg(F.count("*"), F.approx_count_distinct(F.xxhash64(*keys)) if keys else F.lit(1)).first()
    at = lambda c, of: F.min_by(c, F.when(of, F.col("trial")))
    plus, all_ = F.col("stimulus") == 0, F.lit(True)
    length = trials.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(
        (at("trial_end", all_) - at("trial_start", all_)).alias("_time"), (at("cs_end", all_) - at("cs_start", all_)).alias("_cs"),
        (at("ucs_end", plus) - at("ucs_start", plus)).alias("_ucs"), (at("ucs_start", plus) - at("cs_end", plus)).alias("_trace"),
    )
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    d = trials.join(F.broadcast(length) if sessions <= SESSIONS else length, same) if keys else trials.crossJoin(F.broadcast(length))  # one row
    d = d.repartition(max(1, math.ceil(n * frames * len(FEATURES) / ROWS)), *keys, "trial")
    d = d.withColumn("frame", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(frames - 1).cast("long")))).withColumn("t", F.col("frame") * F.col("_time") / frames)
    t, cs, trace, ucs = (F.col(c) for c in ("t", "_cs", "_trace", "_ucs"))
    in_cs, in_trace, in_ucs = t <= cs, (t > cs) & (t <= cs + trace), (t > cs + trace) & (t <= cs + trace + ucs)
    flags = (plus & in_cs, ~plus & in_cs, plus & in_trace, ~plus & in_trace, plus, ~plus, plus & in_ucs)
    rows = F.array(*[F.coalesce(f, F.lit(False)).cast("int") for f in flags])
    return d.select(*keys, "trial", "frame", F.posexplode(rows).alias("feature", "value"))


def collapsed_features(features: DataFrame, subset: list[int] | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, trial, frame, label): the sum of (position + 1) * value, positions counted within the subset.

    Features as trial_features deals them are added up in the tasks that make them, without a shuffle, so a task holds the frames of its own trials only.
    """
    place = F.col("feature") + 1
    if subset is not None:
        features = features.where(F.col("feature").isin(subset))
        place = F.array_position(F.array(*map(F.lit, subset)), F.col("feature"))
    return features.groupBy(*keys, "trial", "frame").agg(F.sum(place * F.col("value")).cast("long").alias("label"))


def random_split(df: DataFrame, number: str, train: float = 0.8, seed: str = "0") -> DataFrame:
    """`split`, train or test by a hash of the number; shares are met on average."""
    part = F.conv(F.substring(_rank_key(seed, number), 1, 8), 16, 10).cast("double") / 2.0**32
    return df.withColumn("split", F.when(part < train, "train").otherwise("test"))


def exact_split(df: DataFrame, number: str, train: float = 0.8, seed: str = "0") -> DataFrame:
    """`split` of exact size: the first int(n * train) rows in the random order train, the others test."""
    n = df.agg(F.count("*").alias("_n"))
    d = ranked(df, [], [_rank_key(seed, number), F.col(number)], "_rank").crossJoin(F.broadcast(n))  # one row
    return d.withColumn("split", F.when(F.col("_rank") <= F.floor(F.col("_n") * train), "train").otherwise("test")).drop("_rank", "_n")


def _in_turn(trials: DataFrame, seed: str) -> DataFrame:
    """Trials with `rank`, their place from 1 in a random order of their type, and _n, the trials of the rarest type; of each type as many."""
    least = trials.groupBy("type").agg(F.count("*").alias("n")).agg(F.min("n").alias("_n"))
    return ranked(trials, ["type"], [_rank_key(seed, "trial"), F.col("trial")]).crossJoin(F.broadcast(least)).where("rank <= _n")  # one row


def grouped_split(trials: DataFrame, train: float = 0.8, seed: str = "0") -> DataFrame:
    """(trial, type, group, split): the k-th trials of all types in random order are group k; the first int(groups * train) groups train.
    There are as many groups as the rarest type has trials; other trials are left out."""
    d = _in_turn(trials, seed)
    return d.select("trial", "type", (F.col("rank") - 1).cast("long").alias("group"), F.when(F.col("rank") <= F.floor(F.col("_n") * train), "train").otherwise("test").alias("split"))


def interleaved(trials: DataFrame, seed: str = "0") -> DataFrame:
    """(trial, type, place): one trial of each type in turn, types in order; other trials are left out."""
    d = _in_turn(trials, seed)
    types = ranked(trials.select("type").distinct(), [], [F.col("type")], "_type")
    many = F.broadcast(types.agg(F.max("_type").alias("_types")))  # one row
    return beside(d, types, ["type"]).crossJoin(many).select("trial", "type", ((F.col("rank") - 1) * F.col("_types") + F.col("_type") - 1).cast("long").alias("place"))


def permuted_labels(features: DataFrame, trials: DataFrame, seed: str = "0") -> DataFrame:
    """features (trial, ...) with their trials put in the order of `interleaved`: the k-th trial gets the features of the trial at place k."""
    order = interleaved(trials, seed).select("trial", "place")
    return beside(features, order, ["trial"]).withColumn("trial", F.col("place")).drop("place")


def shuffled_frames(df: DataFrame, frame: str = "frame", seed: str = "0", by: tuple[str, ...] = ()) -> DataFrame:
    """df with its frames in a random order, the same for all rows of a frame; with `by` another one for each neuron (or label, ...).

    Orders are found on the distinct frame numbers: one row for each frame (and `by`), not on the traces.
    """
    numbers = df.select(*by, frame).distinct()
    rank = lambda *o: F.row_number().over(Window.partitionBy(*by).orderBy(*o))
    old = numbers.withColumn("_k", rank(frame))
    new = numbers.withColumn("_k", rank(_rank_key(seed, *by, frame), frame)).withColumnRenamed(frame, "_new")
    to = old.join(new, [*by, "_k"]).drop("_k")
    return df.join(to, [*by, frame]).withColumn(frame, F.col("_new")).drop("_new")


def curves(scores: DataFrame, label: str, score: str, split: str) -> DataFrame:
    """(split, threshold, tp, fp, fn, tpr, fpr, precision, recall): a point for each distinct score, rows at or above it being positive.

    Equal scores are added up first; the running sum is over distinct scores of a split.  The ROC curve begins at (0, 0) beside these,
    the precision-recall curve ends at (recall 0, precision 1).  Rows without a label or score are left out.
    """
    own = scores.withColumn(score, known(score))
    d = own.where(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(split, F.col(score).alias("threshold"))
    d = d.agg(F.sum(F.col(label)).cast("long").alias("p"), F.sum(1 - F.col(label)).cast("long").alias("n"))
    total = d.groupBy(split).agg(F.sum("p").alias("ps"), F.sum("n").alias("ns"))
    d = beside(accumulated(d, [split], [-F.col("threshold")], {"tp": F.col("p"), "fp": F.col("n")}), total, [split])
    share = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    tp, fp, ps, ns = (F.col(c) for c in ("tp", "fp", "ps", "ns"))
    return d.select(split, "threshold", "tp", "fp", (ps - tp).alias("fn"), share(tp, ps).alias("tpr"), share(fp, ns).alias("fpr"), share(tp, tp + fp).alias("precision"), share(tp, ps).alias("recall"))


def areas(scores: DataFrame, label: str, score: str, split: str) -> DataFrame:
    """(split, roc_auc, average_precision): trapezes under the ROC curve, and precision summed over the steps of recall."""
    own = scores.withColumn(score, known(score)).where(F.col(label).isNotNull() & F.col(score).isNotNull())
    d = own.groupBy(split, F.col(score).alias("threshold")).agg(F.sum(F.col(label)).cast("double").alias("p"), F.sum(1 - F.col(label)).cast("double").alias("n"))
    total = d.groupBy(split).agg(F.sum("p").alias("ps"), F.sum("n").alias("ns"))
    d = beside(accumulated(d, [split], [-F.col("threshold")], {"tp": F.col("p"), "fp": F.col("n")}), total, [split])
    tp, p, n = F.col("tp"), F.col("p"), F.col("n")  # p and n are the steps of tp and fp
    d = d.select(split, (F.try_divide(n, F.col("ns")) * F.try_divide(2 * tp - p, F.col("ps")) / 2).alias("a"), (F.try_divide(p, F.col("ps")) * F.try_divide(tp, tp + F.col("fp"))).alias("b"))
    return d.groupBy(split).agg(F.sum("a").alias("roc_auc"), F.sum("b").alias("average_precision"))


def split_regression_metrics(df: DataFrame, split: str, output: str, truth: str, prediction: str) -> DataFrame:
    """(split, r2, mae, mse), each the plain mean over the outputs; rows without truth or prediction do not count."""
    d = df.withColumns({truth: known(truth), prediction: known(prediction)}).where(F.col(truth).isNotNull() & F.col(prediction).isNotNull())
    e = F.col(truth) - F.col(prediction)
    per = d.groupBy(split, output).agg(F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.var_pop(truth).alias("v"))
    return per.groupBy(split).agg(F.avg(1 - F.try_divide(F.col("mse"), F.col("v"))).alias("r2"), F.avg("mae").alias("mae"), F.avg("mse").alias("mse"))


def split_class_metrics(df: DataFrame, split: str, label: str, prediction: str) -> DataFrame:
    """(split, accuracy, balanced_accuracy, precision, recall, f1) for any number of classes, from one confusion count; the last three are means over the labels."""
    c = df.where(F.col(label).isNotNull() & F.col(prediction).isNotNull()).groupBy(split, F.col(label).alias("y"), F.col(prediction).alias("p")).agg(F.count("*").alias("n"))
    hit = F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)
    right = c.groupBy(split, F.col("y").alias("k")).agg(F.sum("n").alias("of"), F.sum(hit).alias("tp"))
    said = c.groupBy(split, F.col("p").alias("k")).agg(F.sum("n").alias("said"))
    d = right.join(said, [split, "k"], "left").withColumn("said", F.coalesce("said", F.lit(0)))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    recall, precision, f1 = ratio(F.col("tp"), F.col("of")), ratio(F.col("tp"), F.col("said")), ratio(2 * F.col("tp"), F.col("of") + F.col("said"))
    return d.groupBy(split).agg((F.sum("tp") / F.sum("of")).alias("accuracy"), F.avg(recall).alias("balanced_accuracy"), F.avg(precision).alias("precision"), F.avg(recall).alias("recall"), F.avg(f1).alias("f1"))


def chained(df: DataFrame, steps: list[tuple]) -> DataFrame:
    """df through functions of DataFrames with their keywords, in order; None passes it on."""
    for step, keywords in steps:
        if step is not None:
            df = df.transform(step, **(keywords or {}))
    return df
