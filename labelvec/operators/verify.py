"""Checks on a data set that was written and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window, functions as F

from labelvec.operators.pairing import part_counts
from labelvec.operators.positions import unit_offsets


def verify_samples(samples: DataFrame) -> DataFrame:
    """One row: counts, vector lengths, and how many rows lack one half or an id."""
    return samples.agg(
        F.count("image").alias("num_images"),
        F.count("label").alias("num_labels"),
        F.min(F.size("image")).alias("min_dim"),
        F.max(F.size("image")).alias("max_dim"),
        F.count_if(
            F.col("image").isNull() | F.col("label").isNull() | F.col("sample_id").isNull()
        ).alias("incomplete"),
    )


def _row_text(name: str, element: str) -> Column:
    return F.coalesce(F.array_join(F.col(name).cast(f"array<{element}>").cast("array<string>"), ",", "null"), F.lit("missing"))


def digest(with_ids: bool = False) -> Column:
    """Aggregate over (image, label), or (sample_id, image, label): two sums of halves of the rows' 128-bit hashes.

    The same for any order and layout of the rows, and as it is a sum it is added up before the shuffle. A
    row that is changed, lost, repeated or paired with another label changes it.
    """
    parts = [F.col("sample_id").cast("string")] if with_ids else []
    row = F.md5(F.concat_ws("|", *parts, _row_text("image", "int"), _row_text("label", "double")))
    halves = [F.conv(F.substr(row, F.lit(k), F.lit(16)), 16, 10).cast("decimal(28,0)") for k in (1, 17)]
    sums = [F.coalesce(F.sum(h), F.lit(0).cast("decimal(38,0)")).cast("string") for h in halves]
    return F.concat(sums[0], F.lit(":"), sums[1])


class WrittenDigest:
    """The digest of rows as they pass by on their way into a data set."""

    def __init__(self, samples: DataFrame, with_ids: bool = False):
        self._source, self._with_ids, self._seen = samples, with_ids, Observation()
        self.samples = samples.observe(self._seen, digest(with_ids).alias("digest"), F.count("*").alias("n"))

    def equals(self, found: str) -> bool:
        """Compared with what was read back; a pass that Spark ran twice may have counted rows twice, so the source decides."""
        return self._seen.get["digest"] == found or self._source.agg(digest(self._with_ids)).first()[0] == found


def verify_pair(images: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for two staged sides: both counts and the rows without a partner."""
    return part_counts(unit_offsets(images), unit_offsets(labels)).agg(
        F.sum("n_left").alias("num_images"),
        F.sum("n_right").alias("num_labels"),
        F.sum(F.abs(F.col("n_left") - F.col("n_right"))).alias("unmatched"),
    )


def verify_text_pair(spark: SparkSession, images: str, labels: str) -> DataFrame:
    """One row for two folders of lines: counts, vector lengths, and lines without a partner.

    Files pair by their rank, so one row for each file says it all; nothing is joined line by line.
    """

    def files(path: str, name: str) -> DataFrame:
        length = F.size(F.split("value", ","))
        found = spark.read.text(path).groupBy(F.col("_metadata.file_path").alias("file")).agg(
            F.count("*").alias(name), F.min(length).alias(f"{name}_min"), F.max(length).alias(f"{name}_max")
        )
        return found.withColumn("part", F.row_number().over(Window.orderBy("file"))).drop("file")

    both = files(images, "n_images").join(files(labels, "n_labels"), "part", "full")
    zero = [F.coalesce(c, F.lit(0)) for c in ("n_images", "n_labels")]
    return both.agg(
        F.sum("n_images").alias("num_images"),
        F.sum("n_labels").alias("num_labels"),
        F.min("n_images_min").alias("min_dim"),
        F.max("n_images_max").alias("max_dim"),
        F.sum(F.abs(zero[0] - zero[1])).alias("incomplete"),
    )


def sample_head(samples: DataFrame, n: int = 10) -> DataFrame:
    return samples.orderBy("sample_id").limit(n)


def partition_counts(samples: DataFrame, partitions: int = 10) -> DataFrame:
    """Rows per partition after hashing ids into ``partitions``."""
    spread = samples.select("sample_id").repartition(partitions, "sample_id")
    return spread.groupBy(F.spark_partition_id().alias("partition")).agg(
        F.count("*").alias("n_rows")
    )
