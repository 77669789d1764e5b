"""The native sample table (Parquet), and pickled vectors for old data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from labelvec.session import stage
from labelvec.sources.files import remove_path

# The sample table keeps 2**20 consecutive ids of a split in one directory, so a
# range of ids is found by partition pruning instead of by opening every file.
CHUNK_BITS = 20
# Consecutive ids that stay together in a file.
BLOCK_ROWS = 1 << 14


def chunk_of(sample_id: Column) -> Column:
    return F.shiftright(sample_id, CHUNK_BITS)


def dealt(samples: DataFrame, partitions: int | None, *keys: str) -> DataFrame:
    """Rows dealt out by ``keys``: to so many partitions, or to as many as their bytes are worth."""
    if partitions is None:
        return samples.hint("rebalance", *keys)
    return samples.repartition(partitions, *keys)


def write_samples(
    samples: DataFrame, path: str, partitions: int | None = None, block_rows: int = BLOCK_ROWS, order: str = "sample_id"
) -> None:
    """Sample table laid out by split and range of ids (or of another dense column, ``order``), in order within a file.

    Ids are dense, so the block of a row is plain arithmetic: no sampling pass as in
    ``repartitionByRange``. Without ``partitions`` the sizes that adaptive execution
    measures decide how many tasks and files there are.
    """
    if "split" not in samples.columns:
        samples = samples.withColumn("split", F.lit("train"))
    rows = samples.withColumns(
        {"chunk": chunk_of(F.col(order)), "_block": F.expr(f"{order} div {block_rows}")}
    )
    (
        dealt(rows, partitions, "split", "_block")
        .sortWithinPartitions("split", "chunk", order)
        .drop("_block")
        .write.mode("overwrite")
        .partitionBy("split", "chunk")
        .parquet(path)
    )


def staged_in_order(samples: DataFrame, partitions: int | None) -> DataFrame:
    """(sample_id, image, label), evaluated once; reads of single columns see the same tasks and order."""
    rows = samples.select("sample_id", "image", "label")
    if partitions is None:
        return stage(dealt(rows, None, "sample_id").sortWithinPartitions("sample_id"), "sides")
    return dealt(stage(rows, "sides"), partitions, "sample_id").sortWithinPartitions("sample_id")


def read_samples(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    samples = spark.read.parquet(path)
    return samples if split is None else samples.where(F.col("split") == split)


def write_pickle_pair(samples: DataFrame, path: str, partitions: int | None = None) -> None:
    """Replace ``<path>/images`` and ``<path>/labels`` by pickled vectors that line up."""
    rows = staged_in_order(samples, partitions)
    for name, folder in (("image", "images"), ("label", "labels")):
        remove_path(samples.sparkSession, f"{path}/{folder}")
        rows.select(name).rdd.map(lambda row: row[0]).saveAsPickleFile(f"{path}/{folder}")


def read_pickle_pair(
    spark: SparkSession, images: str, labels: str, trusted: bool = False
) -> DataFrame:
    """(sample_id, image, label) from pickled vectors, paired by position.

    Unpickling runs code from the file, so the caller has to vouch for it.
    """
    if not trusted:
        raise PermissionError("pickle files can run code: pass trusted=True for your own files")

    def vectors(path: str, name: str, cast, element: T.DataType) -> DataFrame:
        schema = T.StructType(
            [
                T.StructField("sample_id", T.LongType(), False),
                T.StructField(name, T.ArrayType(element), False),
            ]
        )
        rows = spark.sparkContext.pickleFile(f"{path}/part-*").zipWithIndex()
        return spark.createDataFrame(
            rows.map(lambda pair: (pair[1], [cast(v) for v in pair[0]])), schema
        )

    left = vectors(images, "image", int, T.IntegerType())
    right = vectors(labels, "label", float, T.DoubleType())
    n_left, n_right = left.count(), right.count()
    if n_left != n_right:
        raise ValueError(f"the two sides do not line up: {n_left} and {n_right} rows")
    return left.join(right, "sample_id")
