"""Dense row numbers without a global window.

``monotonically_increasing_id`` grows by one per row inside a task. A staged
write fixes it, one small aggregate finds the length of every unit (a file
split or a write task), and a running sum over those lengths gives each unit's
base. A unit's rows never have to meet in one task, however many a file holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from labelvec.session import broadcast_if_small, stage

UNIT = ["_file", "_block"]
ROW = "_row"


def staged_lines(spark: SparkSession, path: str | list[str], *columns) -> DataFrame:
    """Text lines decoded by ``columns``, staged with the split each row came from."""
    lines = spark.read.text(path).select(
        *columns,
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias(ROW),
    )
    return stage(lines, "lines")


def unit_offsets(staged: DataFrame) -> DataFrame:
    """One row per unit: the rank of its file and the rows that come before it.

    Only the position columns are read. The unpartitioned window orders one row per
    split or write task (under a million for 100 TB), never data rows. The result is
    staged, since counts, checks and the join all use it.
    """
    units = staged.groupBy(*UNIT).agg(F.count("*").alias("_rows"), F.min(ROW).alias("_first"))
    before = Window.orderBy(*UNIT).rowsBetween(Window.unboundedPreceding, -1)
    units = units.select(
        "*",
        (F.dense_rank().over(Window.orderBy("_file")) - 1).alias("part"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_base"),
    )
    file_base = F.min("_base").over(Window.partitionBy("_file"))
    return stage(units.withColumn("_in_file", F.col("_base") - file_base), "offsets")


def numbered(
    staged: DataFrame,
    offsets: DataFrame | None = None,
    id_column: str = "sample_id",
    positions: bool = False,
) -> DataFrame:
    """Add a dense id over all files; on request ``part`` (file rank) and ``pos`` (row in file)."""
    offsets = unit_offsets(staged) if offsets is None else offsets
    wanted = ["_first", "_base", *(["part", "_in_file"] if positions else [])]
    joined = staged.join(broadcast_if_small(offsets.select(*UNIT, *wanted)), UNIT)
    in_unit = F.col(ROW) - F.col("_first")
    return joined.select(
        (F.col("_base") + in_unit).alias(id_column),
        *([F.col("part"), (F.col("_in_file") + in_unit).alias("pos")] if positions else []),
        *[c for c in staged.columns if c not in (*UNIT, ROW)],
    )


def with_dense_id(
    df: DataFrame, order_by: list[str] | None = None, id_column: str = "sample_id"
) -> DataFrame:
    """Number the rows of any frame 0..n-1, in ``order_by`` order when given.

    Rows with equal keys keep their source order. That order is part of the range
    key, so a key that many rows share is spread over several tasks.
    """
    columns = df.columns
    if order_by:
        keys = [*order_by, "_tie"]
        df = df.withColumn("_tie", F.monotonically_increasing_id())
        df = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    tagged = df.select(
        *columns,
        F.lpad(F.spark_partition_id().cast("string"), 10, "0").alias("_file"),
        F.lit(0).cast("bigint").alias("_block"),
        F.monotonically_increasing_id().alias(ROW),
    )
    return numbered(stage(tagged, "dense"), id_column=id_column)
