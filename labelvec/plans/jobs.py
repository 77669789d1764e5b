"""Whole jobs: raw files to a stored data set, verification, training, scoring."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F

from labelvec.functions import argmax, one_hot
from labelvec.operators.positions import with_dense_id
from labelvec.operators.verify import WrittenDigest, digest, sample_head, verify_samples, verify_text_pair
from labelvec.plans import checkpoints
from labelvec.plans.network import NetSpec, Tensors
from labelvec.plans.scoring import predict
from labelvec.plans.training import TrainResult, train_mlp
from labelvec.sources import (
    read_combined_numbered,
    read_csv_pair,
    read_idx_pair,
    read_pickle_pair,
    read_samples,
    read_tfrecord,
    write_combined,
    write_csv_pair,
    write_pickle_pair,
    write_predictions,
    write_samples,
    write_tfrecord,
)

FORMATS = ("csv", "csv2", "pickle", "tf", "tfr", "parquet")


def _check_format(fmt: str) -> None:
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}, expected one of {', '.join(FORMATS)}")


def class_of(label: Column) -> Column:
    """Class index of a one-hot vector; anything else is an error."""
    one_hot_ = (F.size(F.filter(label, lambda v: v != 0)) == 1) & (F.array_max(label) == 1)
    wrong = F.raise_error(F.concat(F.lit("not a one-hot label: "), label.cast("string")))
    return F.when(one_hot_, argmax(label)).otherwise(wrong.cast("int"))


def store(samples: DataFrame, path: str, fmt: str = "csv", partitions: int | None = None) -> None:
    """Write (sample_id, image, one-hot label) in one of the formats, replacing ``path``."""
    _check_format(fmt)
    if fmt == "csv":
        write_csv_pair(samples, path, partitions)
    elif fmt == "csv2":
        write_combined(samples.withColumn("label", class_of(F.col("label"))), path, partitions)
    elif fmt == "pickle":
        write_pickle_pair(samples, path, partitions)
    elif fmt == "parquet":
        write_samples(samples, path, partitions)
    else:
        write_tfrecord(samples, path, partitions)


def load(
    spark: SparkSession, path: str, fmt: str = "csv", classes: int = 10, trusted: bool = False
) -> DataFrame:
    """(sample_id, image, one-hot label) with dense ids from any of the formats."""
    _check_format(fmt)
    if fmt == "csv":
        return read_csv_pair(spark, f"{path}/images", f"{path}/labels")
    if fmt == "csv2":
        rows = read_combined_numbered(spark, path)
        return rows.withColumn("label", one_hot(F.col("label"), classes))
    if fmt == "pickle":
        return read_pickle_pair(spark, f"{path}/images", f"{path}/labels", trusted)
    if fmt == "parquet":
        return read_samples(spark, path)

    def as_type(name: str, element: str) -> Column:
        return F.col(name).cast(f"array<{element}>").alias(name)

    records = read_tfrecord(spark, path)
    return with_dense_id(records.select(as_type("image", "int"), as_type("label", "double")))


def convert_raw(
    spark: SparkSession,
    images: str | list[str],
    labels: str | list[str],
    path: str,
    fmt: str = "csv",
    partitions: int | None = None,
) -> None:
    """Raw image and label files to a stored data set; nothing passes the driver."""
    store(read_idx_pair(spark, images, labels), path, fmt, partitions)


def verify(spark: SparkSession, path: str, fmt: str = "csv", trusted: bool = False) -> DataFrame:
    """One row about what was stored: counts, vector lengths, rows that lack one half."""
    if fmt == "csv":
        return verify_text_pair(spark, f"{path}/images", f"{path}/labels")
    return verify_samples(load(spark, path, fmt, trusted=trusted))


def read_back_digest(spark: SparkSession, path: str, fmt: str = "csv", classes: int = 10, trusted: bool = False) -> str:
    """Digest of a stored data set: of (image, label) pairs, with ids where the format keeps them."""
    return load(spark, path, fmt, classes, trusted).agg(digest(fmt == "parquet")).first()[0]


def store_verified(samples: DataFrame, path: str, fmt: str = "csv", partitions: int | None = None, trusted: bool = False) -> str:
    """Write a data set, read it back, and compare the contents; the digest. A difference is an error."""
    written = WrittenDigest(samples, with_ids=fmt == "parquet")
    store(written.samples, path, fmt, partitions)
    classes = samples.select(F.size("label")).limit(1).collect()
    found = read_back_digest(samples.sparkSession, path, fmt, classes[0][0] if classes else 10, trusted)
    if not written.equals(found):
        raise ValueError(f"{path} does not hold what was written")
    return found


@dataclass
class JobResult:
    """``verified`` and ``head`` are values by split: they were read back before training."""

    verified: dict[str, Row]
    head: dict[str, list[Row]]
    training: TrainResult
    predictions: DataFrame


def run_job(
    spark: SparkSession,
    raw: dict[str, tuple[str, str]],
    out: str,
    spec: NetSpec,
    fmt: str = "csv",
    partitions: int | None = None,
    trusted: bool = False,
    **training,
) -> JobResult:
    """Convert the ``train`` and ``test`` raw files, verify, train, score the test split.

    ``raw`` maps a split to its image and label paths. Each raw file is decoded once, into
    ``<out>/native``; training, scoring and the data set in ``fmt`` (``<out>/<split>``) come from that table.
    Also below ``out``: ``model``, ``predictions`` and ``prediction_lines``.
    """
    verified, head = {}, {}
    for split, (images, labels) in raw.items():
        native = f"{out}/native/{split}"
        write_samples(read_idx_pair(spark, images, labels, spec.classes), native, partitions)
        samples = read_samples(spark, native)
        if fmt != "parquet":
            store_verified(samples, f"{out}/{split}", fmt, partitions, trusted)
        stored = native if fmt == "parquet" else f"{out}/{split}"
        verified[split] = verify(spark, stored, fmt, trusted).first()
        head[split] = sample_head(samples.select("sample_id", "image", "label")).collect()
        if verified[split]["incomplete"] or verified[split]["num_images"] != samples.count():
            raise ValueError(f"{stored} does not hold what was read: {verified[split]}")
    train = read_samples(spark, f"{out}/native/train")
    result = train_mlp(train, spec, model_dir=f"{out}/model", **training)
    predictions = predict(read_samples(spark, f"{out}/native/test"), spec, result.weights)
    predictions.write.mode("overwrite").parquet(f"{out}/predictions")
    stored = spark.read.parquet(f"{out}/predictions")
    write_predictions(stored, f"{out}/prediction_lines")
    return JobResult(verified, head, result, stored)


def score_saved(
    samples: DataFrame, spec: NetSpec, model_dir: str, run_id: str = "train", input_column: str = "image"
) -> DataFrame:
    """Predictions with the latest complete checkpoint of a run."""
    saved = checkpoints.load_state(samples.sparkSession, model_dir, run_id, tensors=len(spec.names))
    if saved is None:
        raise FileNotFoundError(f"no checkpoint of {run_id} under {model_dir}")
    _, state = saved
    weights: Tensors = {name: state[name] for name in spec.names}
    return predict(samples, spec, weights, input_column)
