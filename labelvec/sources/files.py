"""File listing on the driver side, file streams on the task side."""

from __future__ import annotations

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


# Names that Hadoop and pyarrow give the same stores.
SCHEMES = {"s3a": "s3", "s3n": "s3", "file": "file", "hdfs": "hdfs", "viewfs": "viewfs", "s3": "s3", "gs": "gs", "abfs": "abfs", "abfss": "abfss"}


def _hadoop_path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme and authority that Spark itself would use."""
    found = _hadoop_path(spark, path)
    filesystem = found.getFileSystem(spark._jsc.hadoopConfiguration())
    return found.makeQualified(filesystem.getUri(), filesystem.getWorkingDirectory()).toString()


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, if there is one."""
    found = _hadoop_path(spark, path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


def filesystem_of(path: str) -> tuple[fs.FileSystem, str]:
    """pyarrow's file system and inner path of a qualified path."""
    scheme, colon, rest = path.partition(":")
    if not colon or scheme not in SCHEMES:
        raise ValueError(f"{path}: expected a qualified path with one of {', '.join(SCHEMES)}")
    return fs.FileSystem.from_uri(f"{SCHEMES[scheme]}:{rest if rest.startswith('//') else '//' + rest}")


def list_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, length) per file. The content column is pruned, so nothing is read."""
    return spark.read.format("binaryFile").load(path).select("path", "length")


def open_stream(path: str, start: int = 0, compressed: bool = False, buffer: int = 1 << 22):
    """Buffered sequential reader over one file; gzip is decompressed on the fly."""
    filesystem, inner = filesystem_of(path)
    if start:
        source = filesystem.open_input_file(inner)
        source.seek(start)
        return pa.BufferedInputStream(source, buffer)
    compression = "gzip" if compressed else None
    return filesystem.open_input_stream(inner, compression=compression, buffer_size=buffer)


def read_exactly(stream, size: int, what: str) -> bytes:
    """Read ``size`` bytes or fail; streams may return short chunks."""
    parts, missing = [], size
    while missing:
        part = stream.read(missing)
        if not part:
            raise ValueError(f"truncated {what}: {missing} of {size} bytes missing")
        parts.append(part)
        missing -= len(part)
    return parts[0] if len(parts) == 1 else b"".join(parts)
