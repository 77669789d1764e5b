"""Text formats: separate image and label files, combined lines, predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from labelvec.functions import (
    combined_line,
    from_csv_line,
    prediction_line,
    split_combined_line,
    to_csv_line,
)
from labelvec.operators.pairing import pair_by_position
from labelvec.operators.positions import numbered, staged_lines
from labelvec.sources.columnar import dealt, staged_in_order


def read_vectors(
    spark: SparkSession,
    path: str | list[str],
    element: str = "double",
    name: str = "vector",
    allow_empty: bool = True,
) -> DataFrame:
    line = from_csv_line(F.col("value"), element, allow_empty)
    return spark.read.text(path).select(line.alias(name))


def staged_vectors(spark: SparkSession, path: str, element: str, name: str) -> DataFrame:
    line = from_csv_line(F.col("value"), element, allow_empty=False)
    return staged_lines(spark, path, line.alias(name))


def read_csv_pair(spark: SparkSession, images: str, labels: str) -> DataFrame:
    """(sample_id, image, label) from two directories paired by position."""
    return pair_by_position(
        staged_vectors(spark, images, "int", "image"),
        staged_vectors(spark, labels, "double", "label"),
    )


def write_csv_pair(samples: DataFrame, path: str, partitions: int | None = None) -> None:
    """``<path>/images`` and ``<path>/labels``; part files of the two line up."""
    rows = staged_in_order(samples, partitions)
    for name, folder in (("image", "images"), ("label", "labels")):
        rows.select(to_csv_line(F.col(name)).alias("value")).write.mode("overwrite").text(
            f"{path}/{folder}"
        )


def write_combined(samples: DataFrame, path: str, partitions: int | None = None) -> None:
    """``label|v0,v1,...`` lines; ``label`` is the class index."""
    rows = dealt(samples.select("sample_id", "label", "image"), partitions, "sample_id")
    rows.sortWithinPartitions("sample_id").select(
        combined_line(F.col("label"), F.col("image")).alias("value")
    ).write.mode("overwrite").text(path)


def read_combined(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(label, image); label is the class index."""
    label, image = split_combined_line(F.col("value"))
    return spark.read.text(path).select(label.alias("label"), image.alias("image"))


def read_combined_numbered(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The same with a dense ``sample_id`` in file order."""
    label, image = split_combined_line(F.col("value"))
    return numbered(staged_lines(spark, path, label.alias("label"), image.alias("image")))


def write_predictions(predictions: DataFrame, path: str, timestamps: bool = True) -> None:
    at = F.current_timestamp() if timestamps else None
    line = prediction_line(F.col("label"), F.col("prediction"), at)
    predictions.select(line.alias("value")).write.mode("overwrite").text(path)


def read_prediction_lines(spark: SparkSession, path: str) -> DataFrame:
    pattern = r"Label: (-?\d+), Prediction: (-?\d+)$"
    value = F.col("value")
    return spark.read.text(path).select(
        F.regexp_extract(value, pattern, 1).cast("int").alias("label"),
        F.regexp_extract(value, pattern, 2).cast("int").alias("prediction"),
    )
