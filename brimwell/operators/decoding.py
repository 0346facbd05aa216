"""Metrics of decoders as aggregations over predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .traces import known


def binary_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Accuracy, precision, recall, F1 and balanced accuracy from one pass; undefined ratios are 0."""
    n = lambda a, b: F.sum(F.when((F.col(label) == a) & (F.col(prediction) == b), 1).otherwise(0))
    c = df.agg(n(1, 1).alias("tp"), n(0, 1).alias("fp"), n(1, 0).alias("fn"), n(0, 0).alias("tn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    return c.select("tp", "fp", "fn", "tn", ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ((ratio(tp, tp + fn) + ratio(tn, tn + fp)) / 2).alias("balanced_accuracy"))


def regression_metrics(df: DataFrame, truth: str, prediction: str) -> DataFrame:
    """r2, MAE and MSE in one aggregation over the rows that have truth and prediction; NaN counts as null."""
    d = known(truth) - known(prediction)
    both = F.when(d.isNotNull(), known(truth))
    return df.agg(F.avg(F.abs(d)).alias("mae"), F.avg(d * d).alias("mse"), (1 - F.try_divide(F.avg(d * d), F.var_pop(both))).alias("r2"))
