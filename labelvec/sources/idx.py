"""IDX image and label files (gzip or plain).

A gzip stream has no entry points, so one task reads one file, unless the file was written in several
members: then tasks read parts of it. A task holds a bounded
batch at a time. Headers give every file's row count, so ids are known before
any data is read, and an image file is paired with its label file inside the
task: no join and no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from labelvec.functions import one_hot
from labelvec.session import stage
from labelvec.sources.files import list_files, open_stream, read_exactly
from labelvec.sources.members import PART_BYTES, gzip_parts, open_part

# Fixed values of the format.
IMAGE_MAGIC = 2051
LABEL_MAGIC = 2049
HEADER_BYTES = {IMAGE_MAGIC: 16, LABEL_MAGIC: 8}

BATCH_BYTES = 4 << 20


def _open_idx(path: str, magic: int):
    """(stream after the header, item count, bytes per item)."""
    stream = open_stream(path, compressed=path.endswith(".gz"), buffer=1 << 20)
    found, count = np.frombuffer(read_exactly(stream, 8, path), ">u4")
    if found != magic:
        raise ValueError(f"{path}: magic number {found}, expected {magic}")
    width = 1
    if magic == IMAGE_MAGIC:
        height, row = np.frombuffer(read_exactly(stream, 8, path), ">u4")
        width = int(height) * int(row)
    return stream, int(count), width


def _with_headers(files: DataFrame, magic: int) -> DataFrame:
    """Add each file's row count and the id of its first row (files in path order)."""

    def read_headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column("path").to_pylist()
            counts, widths = [], []
            for path in paths:
                stream, count, width = _open_idx(path, magic)
                stream.close()
                counts.append(count)
                widths.append(width)
            yield pa.RecordBatch.from_pydict(
                {
                    "path": paths, "length": batch.column("length"), "items": pa.array(counts, pa.int64()),
                    "width": pa.array(widths, pa.int64()),
                }
            )

    order = Window.orderBy("path")
    return files.mapInArrow(read_headers, "path string, length bigint, items bigint, width bigint").select(
        "path",
        "length",
        "items",
        "width",
        F.row_number().over(order).alias("file_no"),
        F.coalesce(
            F.sum("items").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("first_id"),
    )


def _units(files: DataFrame, magic: int) -> DataFrame:
    """What one task each reads: whole files, or the items [low, high) that begin in a part of a file; numbered by ``unit``."""
    header = HEADER_BYTES[magic]
    parts = gzip_parts(files.select("path", "length"), part_bytes=PART_BYTES).withColumnRenamed("path", "of")
    both = files.join(parts, F.col("path") == F.col("of"), "left").drop("of")

    def begun(byte: Column) -> Column:
        """Items that begin before a byte of the data."""
        before = F.greatest(byte - header, F.lit(0)) + F.greatest(F.col("width"), F.lit(1)) - 1
        return F.least(F.call_function("div", before, F.greatest(F.col("width"), F.lit(1))), F.col("items"))

    whole = F.col("start").isNull()
    low = F.when(whole, 0).otherwise(begun(F.col("first_byte")))
    high = F.when(whole, F.col("items")).otherwise(begun(F.col("first_byte") + F.col("bytes")))
    units = both.withColumns({"low": low, "high": high}).where(whole | (F.col("low") < F.col("high")))
    units = units.withColumn("skip", header + F.col("low") * F.col("width") - F.col("first_byte"))
    return stage(units.withColumn("unit", F.row_number().over(Window.orderBy("file_no", "low")) - 1), "idx-units")


def _spread(units: DataFrame) -> DataFrame:
    """One unit per task."""
    return units.repartitionById(max(1, units.count()), F.col("unit").cast("int"))


def _items(unit: dict, magic: int) -> Iterator[np.ndarray]:
    """Arrays of shape (rows, width), each at most ``BATCH_BYTES`` long."""
    path, low, width = unit["path"], unit["low"], unit["width"]
    if unit["start"] is None:
        stream = _open_idx(path, magic)[0]
    else:
        stream = open_part(path, unit["start"], unit["skip"])
    per_batch = max(1, BATCH_BYTES // (4 * max(1, width)))
    with stream:
        for start in range(low, unit["high"], per_batch):
            rows = min(per_batch, unit["high"] - start)
            data = read_exactly(stream, rows * width, path)
            yield np.frombuffer(data, np.uint8).reshape(rows, width)


def _list_array(block: np.ndarray) -> pa.ListArray:
    rows, width = block.shape
    offsets = np.arange(0, (rows + 1) * width, width, dtype=np.int32)
    return pa.ListArray.from_arrays(offsets, block.astype(np.int32).ravel())


def read_idx_images(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, sample_id, image)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.to_pylist():
                next_id = file["first_id"] + file["low"]
                for block in _items(file, IMAGE_MAGIC):
                    ids = np.arange(next_id, next_id + len(block))
                    next_id += len(block)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "file": [file["path"]] * len(block),
                            "sample_id": ids,
                            "image": _list_array(block),
                        }
                    )

    files = _spread(_units(_with_headers(list_files(spark, path), IMAGE_MAGIC), IMAGE_MAGIC))
    return files.mapInArrow(read, "file string, sample_id bigint, image array<int>")


def read_idx_labels(
    spark: SparkSession, path: str | list[str], classes: int | None = 10
) -> DataFrame:
    """(file, sample_id, label): one-hot, or the class index when ``classes`` is None."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.to_pylist():
                next_id = file["first_id"] + file["low"]
                for block in _items(file, LABEL_MAGIC):
                    ids = np.arange(next_id, next_id + len(block))
                    next_id += len(block)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "file": [file["path"]] * len(block),
                            "sample_id": ids,
                            "label": block.ravel().astype(np.int32),
                        }
                    )

    files = _spread(_units(_with_headers(list_files(spark, path), LABEL_MAGIC), LABEL_MAGIC))
    labels = files.mapInArrow(read, "file string, sample_id bigint, label int")
    if classes is None:
        return labels
    return labels.withColumn("label", one_hot(F.col("label"), classes))


def read_idx_pair(
    spark: SparkSession,
    images: str | list[str],
    labels: str | list[str],
    classes: int | None = 10,
) -> DataFrame:
    """(sample_id, image, label) from image and label files paired in path order."""
    left = _with_headers(list_files(spark, images), IMAGE_MAGIC)
    right = _with_headers(list_files(spark, labels), LABEL_MAGIC).select(
        "file_no", F.col("path").alias("label_path"), F.col("items").alias("label_items")
    )
    # Staged rather than cached: Spark would answer a later read of the same path,
    # with other files in it, from the cache.
    files = stage(left.join(right, "file_no", "full"), "idx-files")
    bad = files.where("NOT (items <=> label_items)").orderBy("file_no").limit(5).collect()
    if bad:
        detail = ", ".join(
            f"{r.path} has {r['items']}, {r.label_path} has {r.label_items}" for r in bad
        )
        raise ValueError(f"image and label files do not line up: {detail}")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.to_pylist():
                next_id = file["first_id"] + file["low"]
                stream, _, _ = _open_idx(file["label_path"], LABEL_MAGIC)
                with stream:
                    for at in range(0, file["low"], BATCH_BYTES):  # labels of the parts before: a byte each
                        read_exactly(stream, min(BATCH_BYTES, file["low"] - at), file["label_path"])
                    for block in _items(file, IMAGE_MAGIC):
                        ids = np.arange(next_id, next_id + len(block))
                        next_id += len(block)
                        data = read_exactly(stream, len(block), file["label_path"])
                        yield pa.RecordBatch.from_pydict(
                            {
                                "sample_id": ids,
                                "image": _list_array(block),
                                "label": np.frombuffer(data, np.uint8).astype(np.int32),
                            }
                        )

    samples = _spread(_units(files, IMAGE_MAGIC)).mapInArrow(read, "sample_id bigint, image array<int>, label int")
    if classes is None:
        return samples
    return samples.withColumn("label", one_hot(F.col("label"), classes))
