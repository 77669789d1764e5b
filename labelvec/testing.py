"""Raw files derived from tables, for tests and for the queries that read raw files."""

from __future__ import annotations

import gzip
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from labelvec.operators.batches import matrix
from labelvec.sources.files import filesystem_of, qualified
from labelvec.sources.idx import IMAGE_MAGIC, LABEL_MAGIC


def _write_gzip(path: str, data: bytes) -> None:
    filesystem, inner = filesystem_of(path)
    filesystem.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    with filesystem.open_output_stream(inner, compression=None) as out:
        out.write(gzip.compress(data, mtime=0))


def write_idx_files(
    samples: DataFrame, path: str, height: int, width: int, rows_per_file: int = 10_000
) -> None:
    """(sample_id, image, label class) as gzip files of ``rows_per_file`` rows each.

    A retried task writes the same bytes to the same name.
    """

    path = qualified(samples.sparkSession, path)

    def write(table: pa.Table) -> pa.Table:
        table = table.sort_by("sample_id").combine_chunks()
        file_no = table["file_no"][0].as_py()
        pixels = matrix(table["image"].chunk(0), height * width).astype(np.uint8)
        classes = table["label"].to_numpy().astype(np.uint8)
        _write_gzip(
            f"{path}/images/{file_no:08d}.gz",
            struct.pack(">4I", IMAGE_MAGIC, len(pixels), height, width) + pixels.tobytes(),
        )
        _write_gzip(
            f"{path}/labels/{file_no:08d}.gz",
            struct.pack(">2I", LABEL_MAGIC, len(classes)) + classes.tobytes(),
        )
        return pa.table({"rows": pa.array([table.num_rows], pa.int64())})

    (
        samples.select(
            F.expr(f"sample_id div {rows_per_file}").alias("file_no"),
            "sample_id",
            "image",
            "label",
        )
        .groupBy("file_no")
        .applyInArrow(write, "rows bigint")
        .agg(F.sum("rows"))
        .collect()
    )
