"""Record files of Example messages: a splitting reader and a committing writer."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from labelvec.sources import example
from labelvec.sources.columnar import dealt
from labelvec.sources.files import filesystem_of, list_files, qualified
from labelvec.sources.records import GROUP_RECORDS, first_boundary, frame, record_groups

SPLIT_BYTES = 128 << 20
# Small enough for the arrays of one step to stay in the processor cache.
DECODE_ROWS = 128
FORMAT = "example_records"


def read_tfrecord(
    spark: SparkSession,
    path: str | list[str],
    names: tuple[str, ...] = ("image", "label"),
    split_bytes: int = SPLIT_BYTES,
) -> DataFrame:
    """One ``array<bigint>`` column per named feature.

    A file larger than ``split_bytes`` is decoded by many tasks. Each split looks for
    its first record by checksum; decoding then has to arrive exactly at the start
    of the next split, so a false match (a record file inside a record) is an error
    and never a wrong row. Reading with a larger ``split_bytes`` avoids it.
    """
    names = list(names)

    def boundaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                first_boundary(r["path"], r["start"], r["length"]) for r in batch.to_pylist()
            ]
            yield batch.set_column(1, "start", pa.array(found, pa.int64()))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.to_pylist():
                for payloads in record_groups(part["path"], part["start"], part["size"]):
                    for low in range(0, len(payloads), DECODE_ROWS):
                        yield example.decode(payloads[low : low + DECODE_ROWS], names)

    files = list_files(spark, path).where("length > 0")
    n_files, total = files.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    tasks = max(1, -(-total // split_bytes), min(n_files, spark.sparkContext.defaultParallelism))
    starts = files.select(
        "path",
        F.explode(F.expr(f"sequence(0L, length - 1, {split_bytes}L)")).alias("start"),
        "length",
    )
    following = F.lead("start").over(Window.partitionBy("path").orderBy("start"))
    splits = (
        starts.repartition(tasks)
        .mapInArrow(boundaries, "path string, start bigint, length bigint")
        .withColumn("size", F.coalesce(following, F.col("length")) - F.col("start"))
        .where("size > 0")
    )
    schema = ", ".join(f"`{name}` array<bigint>" for name in names)
    return splits.select("path", "start", "size").repartition(tasks).mapInArrow(decode, schema)


@dataclass
class _Written(WriterCommitMessage):
    file: str | None


class _RecordWriter(DataSourceArrowWriter):
    """Tasks write under ``_temporary/<job>``; the commit moves what succeeded."""

    def __init__(self, path: str, overwrite: bool):
        self.path = path.rstrip("/")
        self.overwrite = overwrite
        self.job = uuid.uuid4().hex
        self.temporary = f"{self.path}/_temporary/{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}-{self.job}.tfrecord"
        filesystem, folder = filesystem_of(
            f"{self.temporary}/attempt-{task.taskAttemptId()}"
        )
        out = None
        for batch in iterator:
            for start in range(0, batch.num_rows, GROUP_RECORDS):
                if out is None:
                    filesystem.create_dir(folder, recursive=True)
                    out = filesystem.open_output_stream(f"{folder}/{name}", compression=None)
                out.write(frame(example.encode(batch.slice(start, GROUP_RECORDS))))
        if out is None:
            return _Written(None)
        out.close()
        return _Written(f"{folder}/{name}")

    def commit(self, messages: list[_Written | None]) -> None:
        filesystem, target = filesystem_of(self.path)
        filesystem.create_dir(target, recursive=True)
        old = [f.path for f in filesystem.get_file_info(fs.FileSelector(target)) if f.type == fs.FileType.File]
        files = [m.file for m in messages if m is not None and m.file is not None]
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(lambda f: filesystem.move(f, f"{target}/{os.path.basename(f)}"), files))
            if self.overwrite:  # only once the new files are in place
                list(pool.map(filesystem.delete_file, old))
        self._drop_temporary()
        with filesystem.open_output_stream(f"{target}/_SUCCESS"):
            pass

    def abort(self, messages: list[_Written | None]) -> None:
        self._drop_temporary()

    def _drop_temporary(self) -> None:
        filesystem, folder = filesystem_of(self.temporary)
        if filesystem.get_file_info(folder).type == fs.FileType.Directory:
            filesystem.delete_dir(folder)


class ExampleRecords(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> _RecordWriter:
        return _RecordWriter(self.options["path"], overwrite)


def write_tfrecord(samples: DataFrame, path: str, partitions: int | None = None) -> None:
    """Replace ``path`` with one record file per partition.

    Columns ``image`` and ``label`` become int64 lists; other columns are dropped.
    """
    samples.sparkSession.dataSource.register(ExampleRecords)
    rows = dealt(samples.select("sample_id", "image", "label"), partitions, "sample_id")
    rows.sortWithinPartitions("sample_id").select(
        F.col("image").cast("array<bigint>").alias("image"),
        F.col("label").cast("array<bigint>").alias("label"),
    ).write.format(FORMAT).mode("overwrite").save(qualified(samples.sparkSession, path))
