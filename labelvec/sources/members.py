"""Entry points of gzip files that were written in several members.

A member begins with a fixed mark and ends with a checksum and a length of its data, so a task that finds the mark in its
range of bytes proves it by decompressing from there. The members of a file have to follow each other from its first byte to
its last; otherwise the file is read in one piece, as a file of a single member is.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from labelvec.session import stage
from labelvec.sources.files import filesystem_of

# Fixed values of the format: two bytes of mark, the method; and flags that no writer sets.
MARK = b"\x1f\x8b\x08"
RESERVED_FLAGS = 0xE0
# Compressed bytes that a task looks through, and that a task decompresses later.
SCAN_BYTES = 64 << 20
PART_BYTES = 16 << 20
READ_BYTES = 1 << 20


def proven(path: str, start: int) -> tuple[int, int] | None:
    """(end, bytes of data) of the member at ``start``; nothing if it is none, or does not end as it should."""
    filesystem, inner = filesystem_of(path)
    reader, size = zlib.decompressobj(wbits=31), 0
    with filesystem.open_input_file(inner) as file:
        file.seek(start)
        while not reader.eof:
            data = file.read(READ_BYTES)
            if not data:
                return None
            try:
                while data and not reader.eof:
                    size += len(reader.decompress(data, READ_BYTES))
                    data = reader.unconsumed_tail
            except zlib.error:
                return None
        return file.tell() - len(reader.unused_data), size


def _marks(path: str, low: int, high: int) -> Iterator[int]:
    """Places in a range of bytes at which a member might begin, the file's first byte left out."""
    filesystem, inner = filesystem_of(path)
    with filesystem.open_input_file(inner) as file:
        for at in range(low, high, READ_BYTES):
            end = min(at + READ_BYTES, high)
            data = file.read_at(end - at + len(MARK), at)
            found = data.find(MARK)
            while 0 <= found < end - at:
                flags = data[found + len(MARK) : found + len(MARK) + 1]
                if at + found and flags and not flags[0] & RESERVED_FLAGS:
                    yield at + found
                found = data.find(MARK, found + 1)


def gzip_parts(files: DataFrame, scan_bytes: int = SCAN_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """(path, start, first_byte, bytes) of the parts of gzip ``files`` (path, length) that hold several members.

    A part is some members in a row: where they start in the file, and which bytes of its data they hold. Files
    of one member have no row here.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                for start in _marks(r["path"], r["low"], min(r["low"] + scan_bytes, r["length"])):
                    if (found := proven(r["path"], start)) is not None:
                        yield _row(r["path"], r["length"], start, found)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                if (found := proven(r["path"], 0)) is not None:
                    yield _row(r["path"], r["length"], 0, found)

    fields = "path string, length bigint, start bigint, end bigint, size bigint"
    ranges = files.where("path LIKE '%.gz' AND length > 0").select("path", "length", F.explode(F.expr(f"sequence(0L, length - 1, {scan_bytes}L)")).alias("low"))
    later = stage(ranges.repartition("path", "low").mapInArrow(search, fields), "members")
    heads = later.select("path", "length").distinct().repartition("path").mapInArrow(first, fields)
    by_start = Window.partitionBy("path").orderBy("start")
    members = later.union(heads).withColumns(
        {
            "next": F.lead("start", 1).over(by_start),
            "first_byte": F.coalesce(F.sum("size").over(by_start.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        }
    )
    whole = members.groupBy("path").agg(
        F.min("start").alias("low"), F.bool_and(F.col("end") == F.coalesce("next", "length")).alias("chained")
    )
    members = members.join(whole.where("low = 0 AND chained").select("path"), "path")
    return members.groupBy("path", F.expr(f"start div {part_bytes}").alias("part")).agg(
        F.min("start").alias("start"), F.min("first_byte").alias("first_byte"), F.sum("size").alias("bytes")
    ).drop("part")


def _row(path: str, length: int, start: int, found: tuple[int, int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"path": [path], "length": [length], "start": [start], "end": [found[0]], "size": [found[1]]})


def open_part(path: str, start: int, skip: int):
    """The data of a gzip file from a member on, without its first ``skip`` bytes; it runs on into the members after it."""
    filesystem, inner = filesystem_of(path)
    file = filesystem.open_input_file(inner)
    file.seek(start)
    stream = pa.BufferedInputStream(pa.CompressedInputStream(file, "gzip"), READ_BYTES)
    while skip:
        data = stream.read(min(skip, READ_BYTES))
        if not data:
            raise ValueError(f"{path}: ends before the rows that its header tells")
        skip -= len(data)
    return stream
