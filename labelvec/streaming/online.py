"""Training that follows a sample table while it grows.

A streaming query watches the table for new files. Of each micro-batch only the ids are looked at: they are kept as bitmaps, which say
up to which id the table is complete. All mini-batches below it that have not been trained on are then read from
the table, where ranges of ids are pruned, and trained on in the order of their ids. What has been done is the run's latest
checkpoint, so a micro-batch that comes again after a failure finds nothing left to do.
"""

from __future__ import annotations

from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from labelvec.plans import checkpoints
from labelvec.plans.network import NetSpec
from labelvec.plans.training import TrainResult, train_mlp

# Ids of a bitmap.
BLOCK = 1 << 15
ARRIVED = "run_id string, block bigint, ids binary, batch bigint"


def id_bitmaps(rows: DataFrame) -> DataFrame:
    """(block, ids): the ids of the rows, ``BLOCK`` of them to a bitmap; built before the shuffle."""
    after = F.col("sample_id").cast("bigint") + 1  # bitmaps number from one
    return rows.where("sample_id >= 0").groupBy((F.bitmap_bucket_number(after) - 1).alias("block")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(after)).alias("ids")
    )


def complete_ids(bitmaps: DataFrame) -> int:
    """Number of ids from 0 on without a gap. The driver gets one number and one bitmap."""
    blocks = bitmaps.groupBy("block").agg(F.bitmap_or_agg("ids").alias("ids"))
    full = blocks.where(F.bitmap_count("ids") == BLOCK).select("block")
    after = full.select((F.col("block") + 1).alias("block")).union(bitmaps.sparkSession.range(1).select(F.col("id").alias("block")))
    first = after.join(full, "block", "left_anti").agg(F.min("block")).first()[0]
    found = blocks.where(F.col("block") == first).select("ids").first()
    if found is None:
        return first * BLOCK
    bits = np.unpackbits(np.frombuffer(found[0], np.uint8), bitorder="little")
    return first * BLOCK + int(np.argmin(np.append(bits, 0)))


class OnlineTraining:
    """One pass over a table that grows; ``options`` are those of ``train_mlp`` (mode sync)."""

    def __init__(self, spark: SparkSession, path: str, spec: NetSpec, model_dir: str, batch_size: int = 100, run_id: str = "train", **options: Any):
        self.spark, self.path, self.spec = spark, path, spec
        self.model_dir, self.batch_size, self.run_id = model_dir, batch_size, run_id
        self.options = options
        self.result: TrainResult | None = None

    def micro_batch(self, rows: DataFrame, batch: int) -> None:
        """Note the ids that have arrived, then train on what is complete; both may be done again."""
        seen = id_bitmaps(rows).select(F.lit(self.run_id).alias("run_id"), "block", "ids", F.lit(batch).cast("bigint").alias("batch"))
        checkpoints.replace_partition(seen, f"{self.model_dir}/arrived", "batch")
        self.catch_up()

    def catch_up(self, short: bool = False) -> None:
        """Train on all complete mini-batches, and with ``short`` on the rest of the ids as a smaller one."""
        seen = checkpoints.read_table(self.spark, f"{self.model_dir}/arrived", ARRIVED, self.run_id)
        ready = complete_ids(seen)
        steps = -(-ready // self.batch_size) if short else ready // self.batch_size
        if self.result is not None and self.result.step >= steps or not steps:
            return
        samples = self.spark.read.parquet(self.path)
        self.result = train_mlp(
            samples, self.spec, mode="sync", steps=steps, batch_size=self.batch_size, model_dir=self.model_dir, run_id=self.run_id,
            resume=True, n_rows=ready if short else steps * self.batch_size, **self.options,
        )

    def start(self, stream_dir: str, files_per_batch: int | None = None, **trigger: Any) -> StreamingQuery:
        """The streaming query; ``stream_dir`` keeps its offsets, ``trigger`` is that of ``writeStream``."""
        reader = self.spark.readStream.schema(self.spark.read.parquet(self.path).schema)
        if files_per_batch is not None:
            reader = reader.option("maxFilesPerTrigger", files_per_batch)
        rows = reader.parquet(self.path).select("sample_id")
        writer = rows.writeStream.foreachBatch(self.micro_batch).option("checkpointLocation", stream_dir)
        return writer.trigger(**(trigger or {"processingTime": "1 minute"})).start()

    def run_available(self, stream_dir: str, files_per_batch: int | None = None, short: bool = True) -> TrainResult | None:
        """Train on all that is there now, the last ids as a smaller mini-batch if they don't fill one."""
        self.start(stream_dir, files_per_batch, availableNow=True).awaitTermination()
        if short:
            self.catch_up(short=True)
        return self.result
