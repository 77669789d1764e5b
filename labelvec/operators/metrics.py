"""Aggregates: accuracy, losses, tensor summaries, histograms, the metric log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from labelvec.functions import histogram_bucket, log_bucket, log_bucket_value
from labelvec.functions.vectors import LOG_ERROR

METRIC_TAGS = ("loss", "acc", "cross_entropy", "accuracy", "dropout_keep_probability")


def accuracy(predictions: DataFrame, *by: str) -> DataFrame:
    hit = (F.col("prediction") == F.col("label")).cast("double")
    return predictions.groupBy(*by).agg(
        F.avg(hit).alias("accuracy"), F.count("*").alias("n_rows")
    )


def summed_loss(rows: DataFrame, loss: Column, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.sum(loss).alias("loss"))


def mean_loss(rows: DataFrame, loss: Column, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.avg(loss).alias("cross_entropy"))


def tensor_values(weights: DataFrame) -> DataFrame:
    """One row per value of each tensor: (..., tensor, i, value)."""
    others = [c for c in weights.columns if c not in ("shape", "data")]
    return weights.select(*others, F.posexplode("data").alias("i", "value"))


def tensor_summary(values: DataFrame, *by: str) -> DataFrame:
    """Mean, population deviation, maximum and minimum of ``value``."""
    return values.groupBy(*(by or ("tensor",))).agg(
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("stddev"),
        F.max("value").alias("max"),
        F.min("value").alias("min"),
    )


def tensor_histogram(values: DataFrame, low: float, width: float, *by: str) -> DataFrame:
    bucket = histogram_bucket(F.col("value"), low, width)
    return values.groupBy(*(by or ("tensor",)), bucket.alias("bucket")).agg(
        F.count("*").alias("n")
    )


def log_histogram(values: DataFrame, *by: str, error: float = LOG_ERROR) -> DataFrame:
    """Counts of ``value`` in logarithmic buckets, and the number that stands for each. Counts of parts add up."""
    bucket = log_bucket(F.col("value"), error)
    counts = values.groupBy(*(by or ("tensor",)), bucket.alias("bucket")).agg(F.count("*").alias("n"))
    return counts.withColumn("about", log_bucket_value(F.col("bucket"), error))


def metrics_wide(metrics: DataFrame, tags: tuple[str, ...] = METRIC_TAGS) -> DataFrame:
    """One row per writer and step with a column per tag."""
    return metrics.groupBy("writer", "step").pivot("tag", list(tags)).agg(F.first("value"))
