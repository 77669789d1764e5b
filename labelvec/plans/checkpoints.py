"""Weights, metrics and histograms as tables under one model folder."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from labelvec.plans.network import Tensors
from labelvec.sources.files import remove_path

WEIGHTS_SCHEMA = (
    "run_id string, tensor string, shape array<int>, data array<double>, step bigint"
)
METRICS_SCHEMA = (
    "run_id string, writer string, step bigint, tag string, value double, upto bigint"
)
REPORTS_SCHEMA = (
    "run_id string, sample_id bigint, label int, prediction int, step bigint, upto bigint"
)
HISTOGRAMS_SCHEMA = (
    "run_id string, writer string, step bigint, tag string, bucket bigint, width double, "
    "n bigint, upto bigint"
)


IMAGES_SCHEMA = (
    "run_id string, batch_id bigint, step bigint, image_no int, sample_id bigint, image array<array<int>>"
)
TABLES = ("weights", "metrics", "histograms", "reports", "images", "arrived")


def replace_partition(df: DataFrame, path: str, *columns: str) -> None:
    """Write partitions of one run; writing them again after a restart replaces them."""
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_id", *columns)
        .parquet(path)
    )


def drop_run(spark: SparkSession, model_dir: str, run_id: str) -> None:
    """Remove one run from a model folder; others stay."""
    for table in TABLES:
        remove_path(spark, f"{model_dir}/{table}/run_id={run_id}")


def read_table(spark: SparkSession, path: str, schema: str, run_id: str | None = None) -> DataFrame:
    """Rows of one run, or of all."""
    try:
        rows = spark.read.schema(schema).parquet(path)
        return rows if run_id is None else rows.where(F.col("run_id") == run_id)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def weights_frame(spark: SparkSession, state: Tensors, step: int, run_id: str = "") -> DataFrame:
    """One row per tensor."""
    names = list(state)
    table = pa.table(
        {
            "run_id": [run_id] * len(names),
            "tensor": names,
            "shape": pa.array([list(state[n].shape) for n in names], pa.list_(pa.int32())),
            "data": pa.array(
                [np.asarray(state[n], np.float64).ravel() for n in names],
                pa.list_(pa.float64()),
            ),
            "step": pa.array([step] * len(names), pa.int64()),
        }
    )
    return spark.createDataFrame(table, WEIGHTS_SCHEMA)


def save_state(spark: SparkSession, model_dir: str, state: Tensors, step: int, run_id: str) -> None:
    frame = weights_frame(spark, state, step, run_id).coalesce(1)
    replace_partition(frame, f"{model_dir}/weights", "step")


def read_weights(spark: SparkSession, model_dir: str, run_id: str | None = None) -> DataFrame:
    return read_table(spark, f"{model_dir}/weights", WEIGHTS_SCHEMA, run_id)


def latest_step(weights: DataFrame, tensors: int = 1) -> int | None:
    """Highest step of a run's weights that has all its tensors; a save cut short does not count."""
    steps = weights.groupBy("step").agg(F.countDistinct("tensor").alias("n"))
    return steps.where(F.col("n") >= tensors).agg(F.max("step")).first()[0]


def latest_weights(weights: DataFrame, tensors: int = 1) -> DataFrame:
    step = latest_step(weights, tensors)
    return weights.where(F.col("step") == F.lit(step))


def load_state(
    spark: SparkSession, model_dir: str, run_id: str, tensors: int = 1, step: int | None = None
) -> tuple[int, Tensors] | None:
    """(step, tensors) of a run: its latest complete step, or the given one."""
    weights = read_weights(spark, model_dir, run_id)
    if step is None:
        step = latest_step(weights, tensors)
    if step is None:
        return None
    rows = weights.where(F.col("step") == step).select("tensor", "shape", "data").toArrow()
    state = {
        name: np.array(data).reshape(shape)
        for name, shape, data in zip(*(rows[c].to_pylist() for c in ("tensor", "shape", "data")))
    }
    return step, state


def write_metrics(metrics: DataFrame, model_dir: str, run_id: str, upto: int) -> None:
    """(writer, step, tag, value) rows of the steps before ``upto``."""
    frame = metrics.select(
        F.lit(run_id).alias("run_id"), "writer", "step", "tag", "value",
        F.lit(upto).cast("bigint").alias("upto"),
    )
    replace_partition(frame, f"{model_dir}/metrics", "upto")


def read_metrics(spark: SparkSession, model_dir: str, run_id: str | None = None) -> DataFrame:
    return read_table(spark, f"{model_dir}/metrics", METRICS_SCHEMA, run_id).drop("upto")


def write_report(predictions: DataFrame, model_dir: str, run_id: str, upto: int) -> None:
    """(sample_id, label, prediction, step) of the batches of reported steps before ``upto``."""
    frame = predictions.select(
        F.lit(run_id).alias("run_id"), "sample_id", "label", "prediction",
        F.col("step").cast("bigint").alias("step"), F.lit(upto).cast("bigint").alias("upto"),
    )
    replace_partition(frame, f"{model_dir}/reports", "upto")


def read_reports(spark: SparkSession, model_dir: str, run_id: str | None = None) -> DataFrame:
    return read_table(spark, f"{model_dir}/reports", REPORTS_SCHEMA, run_id).drop("upto")


def write_images(images: DataFrame, model_dir: str, run_id: str) -> None:
    """(batch_id, step, image_no, sample_id, image) of the logged steps of a run."""
    frame = images.select(
        F.lit(run_id).alias("run_id"), "batch_id", "step", "image_no", "sample_id",
        F.col("image").cast("array<array<int>>").alias("image"),
    )
    replace_partition(frame, f"{model_dir}/images")


def read_images(spark: SparkSession, model_dir: str, run_id: str | None = None) -> DataFrame:
    return read_table(spark, f"{model_dir}/images", IMAGES_SCHEMA, run_id)


def write_histograms(histograms: DataFrame, model_dir: str, run_id: str, upto: int) -> None:
    frame = histograms.select(
        F.lit(run_id).alias("run_id"), "writer", "step", "tag", "bucket", "width", "n",
        F.lit(upto).cast("bigint").alias("upto"),
    )
    replace_partition(frame, f"{model_dir}/histograms", "upto")


def read_histograms(spark: SparkSession, model_dir: str, run_id: str | None = None) -> DataFrame:
    return read_table(spark, f"{model_dir}/histograms", HISTOGRAMS_SCHEMA, run_id).drop("upto")
