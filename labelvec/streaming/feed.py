"""The batch feed: which samples form which mini-batch, step and epoch.

The feed is bounded, so these are plain expressions on the dense ``sample_id``;
nothing has to be sorted or numbered again to cut batches.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F

from labelvec.functions import reshape_image
from labelvec.functions.permutation import shuffled_position
from labelvec.session import staging_path
from labelvec.sources.columnar import CHUNK_BITS, read_samples, write_samples
from labelvec.sources.files import remove_path

ROWS_PER_TASK = 512
CHUNK_ROWS_PER_TASK = 20_000


def minibatch_assign(samples: DataFrame, batch_size: int = 100, order: str = "sample_id") -> DataFrame:
    """Batch and place in it, by id or by another dense column."""
    return samples.withColumns(
        {
            "batch_id": F.expr(f"{order} div {batch_size}"),
            "batch_pos": F.col(order) % batch_size,
        }
    )


def epoch_shuffle(samples: DataFrame, n_rows: int, epochs: int, batch_size: int = 100, seed: int = 0) -> DataFrame:
    """Every row once per epoch, with the batch that it is in; each epoch has an order of its own.

    The order is an expression of id, epoch and seed: nothing is sorted, and a retried task finds the same batches.
    """
    rows = epoch_expand(samples, epochs)
    place = shuffled_position(F.col("sample_id"), n_rows, seed, F.col("epoch"), epochs)
    return minibatch_assign(rows.withColumn("position", place), batch_size, "position")


def epoch_expand(df: DataFrame, epochs: int) -> DataFrame:
    """Every row once per epoch."""
    return df.select("*", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"))


def epochs_within(batches: DataFrame, n_batches: int, epochs: int, steps: int) -> DataFrame:
    """Every row of ``batches`` (batch_id, ...) once per epoch in which its step is below ``steps``.

    The limit is a range of ids: rows of batches that no epoch reaches are filtered
    before anything is expanded, and no row is made to be dropped.
    """
    last = F.least(F.lit(epochs - 1), F.floor((F.lit(steps - 1) - F.col("batch_id")) / n_batches)).cast("int")
    reached = batches.where(F.col("batch_id") < steps)
    return with_global_step(reached.select("*", F.explode(F.sequence(F.lit(0), last)).alias("epoch")), n_batches)


def with_global_step(batches: DataFrame, n_batches: int) -> DataFrame:
    return batches.withColumn(
        "global_step", F.col("epoch").cast("bigint") * n_batches + F.col("batch_id")
    )


def step_limit(batches: DataFrame, steps: int = 1000) -> DataFrame:
    return batches.where(F.col("global_step") < steps)


def every_n(metrics: DataFrame, n: int = 100) -> DataFrame:
    return metrics.where(F.col("step") % n == 0)


def eval_schedule(spark: SparkSession, steps: int, every: int = 10) -> DataFrame:
    """(step, action, batch_no): steps 0, every, 2*every... evaluate instead of training."""
    step = F.col("id")
    evaluates = step % every == 0
    return spark.range(steps).select(
        step.alias("step"),
        F.when(evaluates, F.lit("eval")).otherwise(F.lit("train")).alias("action"),
        F.when(~evaluates, step - F.expr(f"id div {every}") - 1).alias("batch_no"),
    )


def schedule(start: int, steps: int, n_batches: int, every: int | None) -> Iterator[tuple]:
    """The same schedule for the training loop: (step, batch index, or None to evaluate)."""
    for step in range(start, steps):
        if every is None:
            yield step, step % n_batches
        elif step % every == 0:
            yield step, None
        else:
            yield step, (step - step // every - 1) % n_batches


def image_samples(batches: DataFrame, k: int, height: int, width: int, also: Sequence[str] = ()) -> DataFrame:
    """The first ``k`` images of each batch as height x width. Ids are dense, so ``batch_pos`` says which: a filter."""
    return batches.where(F.col("batch_pos") < k).select(
        *also,
        "batch_id",
        F.col("batch_pos").cast("int").alias("image_no"),
        "sample_id",
        reshape_image(F.col("image"), height, width).alias("image"),
    )


def steps_of(spark: SparkSession, steps: int, n_batches: int, every: int | None = None) -> DataFrame:
    """(step, epoch, batch_id) of all training steps, with or without an evaluation every ``every`` steps."""
    if every is None:
        plan = spark.range(steps).select(F.col("id").alias("step"), F.col("id").alias("batch_no"))
    else:
        plan = eval_schedule(spark, steps, every).where("action = 'train'")
    epoch = F.expr(f"batch_no div {n_batches}").cast("int")
    return plan.select("step", epoch.alias("epoch"), (F.col("batch_no") % n_batches).alias("batch_id"))


def batch_of(step: int, every: int | None = None) -> int:
    """Number of the batch of a training step, counted through all epochs."""
    return step if every is None else step - step // every - 1


def epoch_of(step: int, n_batches: int, every: int | None = None) -> int:
    return batch_of(step, every) // n_batches


def steps_for(n_batches: int, every: int) -> int:
    """Number of steps after which every batch was trained on once, with an evaluation every ``every`` steps."""
    return n_batches + 1 + (n_batches - 1) // (every - 1)


def feed_range(samples: DataFrame, low: int, high: int, order: str = "sample_id") -> DataFrame:
    """Samples with ``low <= sample_id < high``, or of a range of the column that orders them.

    On a table from ``write_samples`` the chunk predicate prunes directories and
    the id predicate prunes row groups.
    """
    rows = samples.where(f"{order} >= {low} AND {order} < {high}")
    if "chunk" in samples.columns:
        rows = rows.where(F.col("chunk").between(low >> CHUNK_BITS, (high - 1) >> CHUNK_BITS))
    return rows


class EpochOrder:
    """Sample tables in the order of an epoch: (sample_id, position, the given columns).

    Positions are the ids, or a new permutation of them in each epoch. ``laid_out`` says that ranges of positions will
    be read one by one: the table of an epoch is then written in its order, unless it is in that order already, and the one
    of the epoch before is removed.
    """

    def __init__(self, samples: DataFrame, columns: list[str], n_rows: int, seed: int, reshuffle: bool, laid_out: bool):
        self.samples = samples
        self.columns = columns
        self.n_rows = n_rows
        self.seed = seed
        self.reshuffle = reshuffle
        self.laid_out = laid_out
        self._epoch: int | None = None
        self._frame: DataFrame | None = None
        self._path: str | None = None

    def of(self, epoch: int) -> DataFrame:
        if not self.reshuffle:
            epoch = 0
        if epoch != self._epoch:
            self.close()
            self._epoch, self._frame = epoch, self._ordered(epoch)
        return self._frame

    def _ordered(self, epoch: int) -> DataFrame:
        native = "chunk" in self.samples.columns and not self.reshuffle
        keep = ["sample_id", *self.columns, *(["chunk"] if native else [])]
        place = shuffled_position(F.col("sample_id"), self.n_rows, self.seed, epoch) if self.reshuffle else F.col("sample_id")
        rows = self.samples.select(*keep).withColumn("position", place)
        if native or not self.laid_out:
            return rows
        spark = rows.sparkSession
        self._path = staging_path(spark, "epoch-order")
        write_samples(rows, self._path, order="position")
        return read_samples(spark, self._path)

    def close(self) -> None:
        if self._path is not None:
            remove_path(self.samples.sparkSession, self._path)
        self._epoch = self._frame = self._path = None


class BatchFeed:
    """Mini-batches of a sample table as small frames (sample_id, the given columns).

    A window of consecutive batches is kept in executor memory and the next one
    replaces it, so an epoch reads the table once, whatever its size. Each batch is
    spread over as many tasks as its rows are worth.
    """

    def __init__(self, order: EpochOrder, batch_size: int, n_batches: int, tasks: int | None = None):
        self.tasks = tasks or -(-batch_size // ROWS_PER_TASK)
        self.order = order
        self.batch_size = batch_size
        self.n_batches = n_batches
        self.window = max(1, self.tasks * CHUNK_ROWS_PER_TASK // batch_size)
        self._first: tuple[int, int] | None = None
        self._frame: DataFrame | None = None

    def batch(self, index: int, epoch: int = 0) -> DataFrame:
        first = index - index % self.window
        if (epoch, first) != self._first:
            self._drop()
            last = min(first + self.window, self.n_batches)
            rows = feed_range(self.order.of(epoch), first * self.batch_size, last * self.batch_size, "position")
            task = F.pmod(F.col("position"), F.lit(self.tasks)).cast("int")
            self._frame = (
                rows.select("sample_id", "position", *self.order.columns)
                .repartitionById(self.tasks, task)
                .sortWithinPartitions("position")
                .persist(StorageLevel.MEMORY_AND_DISK)
            )
            self._first = epoch, first
        low, high = index * self.batch_size, (index + 1) * self.batch_size
        return self._frame.where(f"position >= {low} AND position < {high}").drop("position")

    def _drop(self) -> None:
        if self._frame is not None:
            self._frame.unpersist()
        self._frame = self._first = None

    def close(self) -> None:
        self._drop()
        self.order.close()
