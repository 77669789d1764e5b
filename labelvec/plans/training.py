"""Training jobs. The driver holds the weights, the executors hold the data.

``epoch_avg``  the default: in every round the shards of the batches run some of their own
               mini-batches from the same start, and the results are averaged by the number of
               rows seen (Zinkevich et al., 2010; Stich, 2019). A round is one job, an epoch has one or more.
               Shards follow from the number of batches, so results don't depend on the cluster.
``sync``       one global mini-batch after the other. All steps up to the next save or evaluation are one job, whose
               tasks sum gradients and update weights between barriers. Where the tasks of a batch can't
               run side by side, each step is a job and the driver updates.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from labelvec.operators.batches import matrix, mini_batches
from labelvec.plans import checkpoints, lockstep
from labelvec.plans.network import (
    HIST_WIDTH,
    NetSpec,
    Tensors,
    batch_metrics,
    batch_sums,
    bucket_counts,
    dropout_factors,
    gradient,
    hist_width,
    initial_weights,
    layers,
    metric_sums,
    tensor_stats,
)
from labelvec.plans.optimizers import Adagrad, Adam, default_optimizer
from labelvec.plans.partials import (
    HISTOGRAM,
    SCHEMA,
    add_into,
    gradient_partials,
    partial_rows,
    sum_partials,
)
from labelvec.plans.scoring import activation_histogram, predict
from labelvec.session import MAX_MODEL_BYTES, stage, staging_path
from labelvec.streaming.feed import (
    BatchFeed,
    EpochOrder,
    batch_of,
    epoch_of,
    epoch_shuffle,
    feed_range,
    image_samples,
    minibatch_assign,
    steps_of,
)

WEIGHT_HIST_WIDTH = 0.02
# Mini-batches that one shard trains on one after the other; a lost task repeats no more.
SHARD_BATCHES = 64
# Rows of all mini-batches of a shard, which go through one task; a larger batch needs mode='sync'.
SHARD_ROWS = 1 << 15
# Rows that a task of a round trains on, in one or more shards.
TASK_ROWS = 1 << 17
# Passes over the table that one job of synchronous steps may hold.
JOB_EPOCHS = 16
LOG_SCHEMA = "writer string, step bigint, tag string, value double"
# Tags under which the weights of kind a are drawn as histograms.
HIST_TAGS_A = {"hid_w": "hidden_weights", "sm_w": "softmax_weights"}


@dataclass
class TrainResult:
    spec: NetSpec
    state: Tensors
    step: int
    model_dir: str
    run_id: str

    @property
    def weights(self) -> Tensors:
        return {name: self.state[name] for name in self.spec.names}

    def metrics(self, spark: SparkSession) -> DataFrame:
        return checkpoints.read_metrics(spark, self.model_dir, self.run_id)

    def reports(self, spark: SparkSession) -> DataFrame:
        return checkpoints.read_reports(spark, self.model_dir, self.run_id)

    def histograms(self, spark: SparkSession) -> DataFrame:
        return checkpoints.read_histograms(spark, self.model_dir, self.run_id)

    def images(self, spark: SparkSession) -> DataFrame:
        return checkpoints.read_images(spark, self.model_dir, self.run_id)


@dataclass(frozen=True)
class _Job:
    """What both training modes share."""

    spark: SparkSession
    spec: NetSpec
    optimizer: Adagrad | Adam
    batch_size: int
    n_batches: int
    steps: int
    keep_prob: float
    seed: int
    input_column: str
    model_dir: str
    run_id: str
    log_every: int
    histograms: bool | str
    report_every: int | None
    n_rows: int
    reshuffle: bool

    def order(self, samples: DataFrame, laid_out: bool) -> EpochOrder:
        return EpochOrder(samples, [self.input_column, "label"], self.n_rows, self.seed, self.reshuffle, laid_out)


def count_dense(samples: DataFrame) -> int:
    """Row count; ids have to be 0..n-1, each once, since batches are cut by id.

    Exact, by a bitmap for every 2**15 ids, which is combined before the shuffle.
    """
    ids = samples.select(F.col("sample_id").cast("bigint").alias("id"))
    blocks = ids.groupBy(F.bitmap_bucket_number("id").alias("block")).agg(
        F.count("*").alias("rows"),
        F.max("id").alias("last"),
        F.bitmap_count(F.bitmap_construct_agg(F.bitmap_bit_position("id"))).alias("ids"),
    )
    n, distinct, last, low = blocks.agg(
        F.coalesce(F.sum("rows"), F.lit(0)), F.sum("ids"), F.max("last"), F.min("block")
    ).first()
    if n == 0:
        raise ValueError("no samples")
    if distinct != n or last != n - 1 or low < 0 or ids.where("id < 0 OR id IS NULL").limit(1).count():
        raise ValueError(f"{n} rows with {distinct} ids up to {last}: number them 0..n-1 first (with_dense_id)")
    return n


def train_mlp(
    samples: DataFrame,
    spec: NetSpec,
    *,
    mode: str = "epoch_avg",
    epochs: int = 1,
    batch_size: int = 100,
    steps: int = 1000,
    optimizer: Adagrad | Adam | None = None,
    keep_prob: float | None = None,
    seed: int = 0,
    input_column: str = "image",
    weights: Tensors | None = None,
    model_dir: str | None = None,
    resume: bool = False,
    checkpoint_every: int = 100,
    log_every: int = 1,
    histograms: bool | str = False,
    eval_samples: DataFrame | None = None,
    eval_every: int = 10,
    report_every: int | None = None,
    image_shape: tuple[int, int] | None = None,
    images_per_step: int = 3,
    shards: int | None = None,
    tasks: int | None = None,
    reshuffle: bool = False,
    average_every: int = SHARD_BATCHES,
    steps_per_job: int | None = None,
    n_rows: int | None = None,
    run_id: str = "train",
) -> TrainResult:
    """Train on (sample_id, image, label) with dense ids and one-hot labels.

    Stops after ``epochs`` passes or ``steps`` batches, whichever comes first. With
    ``eval_samples`` (sync only), every ``eval_every``-th step scores them instead
    of training, and the batches cycle until ``steps`` is reached. With
    ``report_every``, the rows of every such step's batch are scored with
    the updated weights and kept as ``reports``. With ``image_shape``, the first
    ``images_per_step`` images of each logged step are kept as ``images``. ``histograms`` keeps
    those of activations and weights for all logged steps, in buckets of equal width or, with ``"log"``, in logarithmic ones, of
    which values of any size fill a bounded number. ``weights`` are start weights,
    random ones by default. ``resume`` goes on from the run's latest complete checkpoint in
    ``model_dir``; otherwise the run of this name is replaced there.

    With ``reshuffle`` every epoch cuts its batches from a new order of the rows, which follows from ``seed`` and the epoch.
    In epoch_avg the shards are averaged after ``average_every`` batches of each, at the end of an epoch, and wherever a
    checkpoint is due, every ``checkpoint_every`` steps or, if a round of one batch of each shard has more, after each round.

    ``n_rows`` says that the ids below it are known to be there, each once; rows with others are left out, and nothing is counted.

    In sync a job holds the steps up to the next checkpoint, evaluation or report, ``steps_per_job`` at most; the weights are the
    same whatever their number.

    ``shards`` (epoch_avg) and ``tasks`` of a batch (sync) follow from the numbers of batches
    and rows if they aren't given, never from the cluster. A shard of epoch_avg is one task, so more
    than ``SHARD_ROWS`` rows of a batch or a shard are an error; sync spreads each batch by its rows.
    """
    if mode not in ("sync", "epoch_avg"):
        raise ValueError(f"unknown mode {mode!r}")
    if mode == "epoch_avg" and eval_samples is not None:
        raise ValueError("periodic evaluation needs mode='sync'")
    spark = samples.sparkSession
    n_rows = count_dense(samples) if n_rows is None else n_rows
    n_batches = -(-n_rows // batch_size)
    if mode == "epoch_avg":
        shards = _shards(n_rows, batch_size, shards)
    if eval_samples is None:
        steps = min(steps, epochs * n_batches)
    if keep_prob is None:
        keep_prob = 1.0 if spec.kind == "a" else 0.9
    job = _Job(
        spark, spec, optimizer or default_optimizer(spec), batch_size, n_batches, steps,
        keep_prob, seed, input_column, model_dir or staging_path(spark, "model"), run_id,
        log_every, histograms, report_every, n_rows, reshuffle,
    )
    weights = initial_weights(spec, seed) if weights is None else {n: weights[n] for n in spec.names}
    state = {**weights, **job.optimizer.slots(weights)}
    size = sum(8 * w.size for w in state.values())
    if size > MAX_MODEL_BYTES:
        raise ValueError(f"{size} bytes of weights and optimizer state exceed {MAX_MODEL_BYTES}")
    start = 0
    if resume:
        saved = checkpoints.load_state(spark, job.model_dir, run_id, tensors=len(state))
        if saved is not None:
            start, state = saved
    else:
        checkpoints.drop_run(spark, job.model_dir, run_id)
    if image_shape is not None:
        every = None if eval_samples is None else eval_every
        logged = steps_of(spark, steps, n_batches, every).where(F.col("step") % log_every == 0)
        if reshuffle:
            epochs = epoch_of(steps - 1, n_batches, every) + 1 if steps > 0 else 1
            first, keys = epoch_shuffle(samples, n_rows, epochs, batch_size, seed), ["epoch", "batch_id"]
        else:
            first, keys = minibatch_assign(samples, batch_size), ["batch_id"]
        first = image_samples(first, images_per_step, *image_shape, also=keys[:-1])
        checkpoints.write_images(logged.join(first, keys), job.model_dir, run_id)
    if mode == "sync":
        state = _train_sync(job, samples, state, start, checkpoint_every, eval_samples, eval_every, tasks, steps_per_job)
    else:
        state = _train_rounds(job, samples, state, start, checkpoint_every, shards, average_every)
    return TrainResult(spec, state, max(start, steps), job.model_dir, run_id)


def _shards(n_rows: int, batch_size: int, shards: int | None) -> int:
    """Number of shards, of ``SHARD_BATCHES`` batches and ``SHARD_ROWS`` rows at most unless it is given."""
    n_batches = -(-n_rows // batch_size)
    if min(batch_size, n_rows) > SHARD_ROWS:
        raise ValueError(f"a batch of {min(batch_size, n_rows)} rows exceeds a task's {SHARD_ROWS}: use mode='sync'")
    if shards is None:
        shards = -(-n_batches // min(SHARD_BATCHES, max(1, SHARD_ROWS // batch_size)))
    shards = max(1, min(shards, n_batches))
    rows = min(n_rows, -(-n_batches // shards) * batch_size)
    if rows > SHARD_ROWS:
        raise ValueError(f"{shards} shards of {rows} rows exceed a task's {SHARD_ROWS} rows: use more shards")
    return shards


def _tensor_metrics(job: _Job, state: Tensors, writer: str, step: int) -> list[tuple]:
    """Summaries of the weights, which the driver holds anyway."""
    if job.spec.kind == "a":
        return []
    return _stat_rows(job, tensor_stats(job.spec, state), writer, step)


def _stat_rows(job: _Job, stats: np.ndarray, writer: str, step: int) -> list[tuple]:
    keep = job.keep_prob if writer == "train" else 1.0
    rows = [(writer, step, "dropout_keep_probability", keep)]
    for name, values in zip(job.spec.names, stats):
        for tag, value in zip(("mean", "stddev", "max", "min"), values):
            rows.append((writer, step, f"{name}/summaries/{tag}", float(value)))
    return rows


def _weight_counts(spec: NetSpec, state: Tensors, histograms: bool | str) -> Tensors:
    """Histograms of the weights under their tags."""
    tags = {
        name: HIST_TAGS_A.get(name) if spec.kind == "a" else f"{name}/summaries/histogram"
        for name in spec.names
    }
    return {
        f"{HISTOGRAM}{tag}": bucket_counts(state[name], hist_width(histograms, WEIGHT_HIST_WIDTH))
        for name, tag in tags.items()
        if tag
    }


def _width(tag: str, histograms: bool | str) -> float | None:
    """Width of a tag's buckets; none if they are logarithmic."""
    return hist_width(histograms, HIST_WIDTH if tag.endswith("activations") else WEIGHT_HIST_WIDTH)


def _bucket_rows(job: _Job, writer: str, step: int, sums: Tensors) -> list[tuple]:
    rows = []
    for name, counts in sums.items():
        if name.startswith(HISTOGRAM):
            tag = name.removeprefix(HISTOGRAM)
            rows += [(writer, step, tag, int(b), _width(tag, job.histograms), int(n)) for b, n in counts]
    return rows


class _Log:
    """Rows of the steps since the last flush, at most one checkpoint interval."""

    def __init__(self, job: _Job):
        self.job = job
        self.metrics: list[tuple] = []
        self.histograms: list[tuple] = []

    def flush(self, upto: int) -> None:
        job = self.job
        if self.metrics:
            checkpoints.write_metrics(
                job.spark.createDataFrame(self.metrics, LOG_SCHEMA).coalesce(1),
                job.model_dir, job.run_id, upto,
            )
        if self.histograms:
            checkpoints.write_histograms(
                job.spark.createDataFrame(
                    self.histograms,
                    "writer string, step bigint, tag string, bucket bigint, width double, n bigint",
                ).coalesce(1),
                job.model_dir, job.run_id, upto,
            )
        self.metrics, self.histograms = [], []


def _train_sync(
    job: _Job,
    samples: DataFrame,
    state: Tensors,
    start: int,
    checkpoint_every: int,
    eval_samples: DataFrame | None,
    eval_every: int,
    tasks: int | None,
    steps_per_job: int | None,
) -> Tensors:
    spec = job.spec
    feed = BatchFeed(job.order(samples, laid_out=True), job.batch_size, job.n_batches, tasks)
    log = _Log(job)
    every = None
    if eval_samples is not None:
        every = eval_every
        eval_samples = stage(eval_samples.select(job.input_column, "label"), "evaluation")
    together = steps_per_job != 1 and lockstep.fits(job.spark, feed.tasks)
    step = start
    try:
        while step < job.steps:
            evaluates = every is not None and step % every == 0
            if evaluates:
                _evaluate_step(job, log, eval_samples, state, step)
                upto = step + 1
            elif together:
                upto = _job_end(job, step, checkpoint_every, every, steps_per_job)
                state = _run_job(job, feed, state, step, upto, every)
            else:
                upto = step + 1
                batch = feed.batch(batch_of(step, every) % job.n_batches, epoch_of(step, job.n_batches, every))
                state = _run_batch(job, feed, batch, state, step, log)
            if not evaluates and job.report_every and (upto - 1) % job.report_every == 0:
                last = upto - 1
                batch = feed.batch(batch_of(last, every) % job.n_batches, epoch_of(last, job.n_batches, every))
                scores = predict(batch, spec, state, job.input_column)
                checkpoints.write_report(scores.withColumn("step", F.lit(last)), job.model_dir, job.run_id, upto)
            due = upto % checkpoint_every == 0 or upto == job.steps
            if due or together:
                log.flush(upto)
            if due:
                checkpoints.save_state(job.spark, job.model_dir, state, upto, job.run_id)
            step = upto
    finally:
        feed.close()
    return state


def _evaluate_step(job: _Job, log: _Log, eval_samples: DataFrame, state: Tensors, step: int) -> None:
    values = evaluate(eval_samples, job.spec, state, job.input_column)
    log.metrics += [("test", step, tag, v) for tag, v in values.items()]
    log.metrics += _tensor_metrics(job, state, "test", step)
    if job.histograms:
        width = hist_width(job.histograms, HIST_WIDTH)
        counts = activation_histogram(eval_samples, job.spec, state, job.input_column, width)
        log.histograms += [("test", step, r.tensor, r.bucket, width, r.n) for r in counts.collect()]
        log.histograms += _bucket_rows(job, "test", step, _weight_counts(job.spec, state, job.histograms))


def _job_end(job: _Job, step: int, checkpoint_every: int, every: int | None, steps_per_job: int | None) -> int:
    """Step before which a job of training steps ends; what it logs has no other rows of this number."""
    ends = [job.steps, (step // checkpoint_every + 1) * checkpoint_every]
    if every is not None:
        ends.append((step // every + 1) * every)
    if job.report_every:
        ends.append(-(-step // job.report_every) * job.report_every + 1)
    if steps_per_job is not None:
        ends.append(step + steps_per_job)
    # The table of a reshuffled epoch gives way to the next one's.
    epochs = 1 if job.reshuffle else JOB_EPOCHS
    last = epoch_of(step, job.n_batches, every) + epochs
    upto = min(ends)
    while epoch_of(upto - 1, job.n_batches, every) >= last:
        upto -= 1
    return upto


def _run_job(job: _Job, feed: BatchFeed, state: Tensors, first: int, upto: int, every: int | None) -> Tensors:
    """All training steps from ``first`` on, before ``upto``, in one pass over their rows."""
    numbers = [(s, batch_of(s, every)) for s in range(first, upto)]
    rows = None
    for epoch in range(numbers[0][1] // job.n_batches, numbers[-1][1] // job.n_batches + 1):
        own = [(s, b % job.n_batches) for s, b in numbers if b // job.n_batches == epoch]
        part = feed_range(feed.order.of(epoch), own[0][1] * job.batch_size, (own[-1][1] + 1) * job.batch_size, "position")
        step = F.lit(own[0][0] - own[0][1]).cast("bigint") + F.expr(f"position div {job.batch_size}")
        part = part.select(step.alias("step"), "position", "sample_id", job.input_column, "label")
        rows = part if rows is None else rows.unionByName(part)
    plan = lockstep.Plan(
        job.spec, job.optimizer, job.batch_size, job.n_rows, job.n_batches, job.keep_prob, job.seed, job.input_column,
        job.log_every, job.histograms,
    )
    steps = [(s, b % job.n_batches) for s, b in numbers]
    out, folder = lockstep.run_steps(plan, rows, state, steps, feed.tasks, _weight_counts)
    out = stage(out, "steps")
    lockstep.drop(job.spark, folder)
    checkpoints.write_metrics(_epoch_metrics(job, out), job.model_dir, job.run_id, upto)
    if job.histograms:
        counts = _epoch_histograms(job, out).groupBy("writer", "step", "tag", "bucket", "width").agg(F.sum("n").alias("n"))
        checkpoints.write_histograms(counts, job.model_dir, job.run_id, upto)
    return lockstep.new_state(out, job.spec, state)


def _run_batch(
    job: _Job, feed: BatchFeed, batch: DataFrame, state: Tensors, step: int, log: _Log
) -> Tensors:
    spec, logged = job.spec, step % job.log_every == 0
    shared = job.spark.sparkContext.broadcast({n: state[n] for n in spec.names})
    partials = gradient_partials(
        batch, spec, shared, job.input_column,
        job.keep_prob, step, job.seed, job.histograms if logged else False,
    )
    sums = sum_partials(partials, feed.tasks)
    shared.destroy()
    if logged:
        values = batch_metrics(spec, sums)
        log.metrics += [("train", step, tag, v) for tag, v in values.items()]
        log.metrics += _tensor_metrics(job, state, "train", step)
        if job.histograms:
            log.histograms += _bucket_rows(job, "train", step, {**_weight_counts(spec, state, job.histograms), **sums})
    return job.optimizer.update(spec, state, gradient(spec, sums))


def evaluate(
    samples: DataFrame, spec: NetSpec, weights: Tensors, input_column: str = "image"
) -> dict[str, float]:
    """Loss and accuracy over a whole frame, without dropout."""
    shared = samples.sparkSession.sparkContext.broadcast({n: weights[n] for n in spec.names})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Tensors = {}
        for batch in batches:
            if batch.num_rows:
                x = spec.prepare(matrix(batch.column(input_column), spec.inputs))
                _, _, logits = layers(spec, shared.value, x)
                y = matrix(batch.column("label"), spec.classes)
                add_into(total, metric_sums(spec, logits, y))
        if total:
            yield pa.RecordBatch.from_pydict(total)

    sums = (
        samples.select(input_column, "label")
        .mapInArrow(run, "loss double, correct double, rows double")
        .agg(F.sum("loss"), F.sum("correct"), F.sum("rows"))
        .first()
    )
    shared.destroy()
    if sums[2] is None:
        raise ValueError("no samples to evaluate")
    return batch_metrics(
        spec, {"loss": [sums[0]], "correct": [sums[1]], "rows": [sums[2]]}
    )


def _local_steps(job: _Job, df: DataFrame, state, first_step: int) -> DataFrame:
    """Each shard trains along its batches; a task emits the sum of its shards' weights and the logged values.

    Weights are multiplied by the number of rows for averaging.
    """
    spec, optimizer, batch_size = job.spec, job.optimizer, job.batch_size
    input_column, keep_prob, seed = job.input_column, job.keep_prob, job.seed
    log_every, histograms, report_every = job.log_every, job.histograms, job.report_every

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Tensors = {}
        local, rows, current = state.value, 0, None

        def close() -> None:
            if rows:
                add_into(total, {n: w * rows for n, w in local.items()} | {"rows": np.array([float(rows)])})

        for shard, number, batch in mini_batches(batches, batch_size, "shard"):
            if shard != current:
                close()
                local, rows, current = state.value, 0, shard
            step = first_step + number
            factors = None
            ids = batch.column("sample_id").to_numpy()
            if keep_prob < 1.0:
                factors = dropout_factors(ids, spec.hidden, step, seed, keep_prob)
            x = spec.prepare(matrix(batch.column(input_column), spec.inputs))
            y = matrix(batch.column("label"), spec.classes)
            logs = step % log_every == 0
            sums = batch_sums(spec, local, x, y, factors, histograms if logs else False)
            if logs:
                values = np.concatenate([sums["loss"], sums["correct"], sums["rows"]])
                logged = {"metrics": values}
                if spec.kind == "b":
                    logged["stats"] = tensor_stats(spec, local)
                if histograms:
                    logged |= _weight_counts(spec, local, histograms)
                    logged |= {n: v for n, v in sums.items() if n.startswith(HISTOGRAM)}
                yield from partial_rows(logged, step)
            local = optimizer.update(spec, local, gradient(spec, sums))
            if report_every and step % report_every == 0:
                found = layers(spec, local, x)[2].argmax(axis=1)
                told = np.stack([ids, y.argmax(axis=1), found], axis=1)
                yield from partial_rows({"report": told}, step)
            rows += batch.num_rows
        close()
        yield from partial_rows(total)

    return df.select("shard", "position", "sample_id", input_column, "label").mapInArrow(run, SCHEMA)


def _metric_columns(job: _Job, loss, hits, n) -> dict:
    """Logged values of a batch from its sums; works on columns and on numbers."""
    if job.spec.kind == "a":
        return {"loss": loss, "acc": hits / n}
    return {"cross_entropy": loss / n, "accuracy": hits / n}


def _epoch_metrics(job: _Job, out: DataFrame) -> DataFrame:
    """(writer, step, tag, value) of every logged batch."""
    data = F.col("data")
    logged = out.where("step IS NOT NULL AND tensor IN ('metrics', 'stats')")
    values = _metric_columns(job, data[0], data[1], data[2])
    losses = logged.where("tensor = 'metrics'").select(
        F.lit("train").alias("writer"), "step", F.inline(_pairs(values))
    )
    if job.spec.kind == "a":
        return losses
    tags = [row[2] for row in _stat_rows(job, np.zeros((4, 4)), "train", 0)]
    values = {"dropout_keep_probability": F.lit(job.keep_prob)}
    values.update({tag: data[i] for i, tag in enumerate(tags[1:])})
    return losses.union(
        logged.where("tensor = 'stats'").select(F.lit("train").alias("writer"), "step", F.inline(_pairs(values)))
    )


def _epoch_histograms(job: _Job, out: DataFrame) -> DataFrame:
    tag = F.substring("tensor", len(HISTOGRAM) + 1, 1 << 30)
    widths = [F.lit(hist_width(job.histograms, w)).cast("double") for w in (HIST_WIDTH, WEIGHT_HIST_WIDTH)]
    width = F.when(tag.endswith("activations"), widths[0]).otherwise(widths[1])
    return out.where(F.col("step").isNotNull() & F.col("tensor").startswith(HISTOGRAM)).select(
        F.lit("train").alias("writer"), "step", tag.alias("tag"), F.col("block").alias("bucket"),
        width.alias("width"), F.col("data")[0].cast("bigint").alias("n"),
    )


def _epoch_reports(out: DataFrame) -> DataFrame:
    """(sample_id, label, prediction, step) from triples of numbers; blocks hold whole triples."""
    size = F.size("data") / 3
    one = F.transform(
        F.sequence(F.lit(0), size.cast("int") - 1),
        lambda i: F.struct(*[
            F.element_at("data", (3 * i + k + 1).cast("int")).cast(kind).alias(name)
            for k, (name, kind) in enumerate((("sample_id", "bigint"), ("label", "int"), ("prediction", "int")))
        ]),
    )
    return out.where("tensor = 'report'").select("step", F.inline(one))


def _pairs(values: dict) -> Column:
    return F.array(*[F.struct(F.lit(t).alias("tag"), v.alias("value")) for t, v in values.items()])


def _averaged(sums: Tensors, state: Tensors) -> Tensors:
    total = float(sums["rows"][0])
    return {name: sums[name].reshape(w.shape) / total for name, w in state.items()}


def round_steps(n_batches: int, shards: int, average_every: int, checkpoint_every: int) -> int:
    """Steps of all shards between two averages: whole turns through the shards, and no more than until a save is due."""
    if average_every < 1:
        raise ValueError("shards are averaged after one batch of each at least")
    return min(n_batches, shards * max(1, min(average_every, checkpoint_every // shards)))


def _dealt(job: _Job, rows: DataFrame, shards: int, batches: int) -> tuple[DataFrame, int]:
    """Rows by shard and position, in tasks of several shards; and the number of tasks."""
    tasks = min(shards, batches, -(-batches * job.batch_size // TASK_ROWS))
    shard = F.pmod(F.expr(f"position div {job.batch_size}"), F.lit(shards)).cast("int")
    task = F.pmod(F.col("shard"), F.lit(tasks)).cast("int")
    rows = rows.select("sample_id", "position", job.input_column, "label").withColumn("shard", shard)
    return rows.repartitionById(tasks, task).sortWithinPartitions("shard", "position"), tasks


def _train_rounds(
    job: _Job,
    samples: DataFrame,
    state: Tensors,
    start: int,
    checkpoint_every: int,
    shards: int,
    average_every: int,
) -> Tensors:
    batch_size, n_batches = job.batch_size, job.n_batches
    steps = round_steps(n_batches, shards, average_every, checkpoint_every)
    order = job.order(samples, laid_out=steps < n_batches)
    # One shuffle puts the batches of a shard into one task, in order; a round that repeats keeps them there.
    kept = None
    if steps == n_batches and not job.reshuffle and job.steps - start > n_batches:
        kept, kept_tasks = _dealt(job, order.of(0), shards, n_batches)
        kept = kept.persist(StorageLevel.MEMORY_AND_DISK)
    step = start
    try:
        while step < job.steps:
            epoch, at = divmod(step, n_batches)
            first_step = step - at
            upto = min(first_step + min((at // steps + 1) * steps, n_batches), job.steps)
            low, high = at * batch_size, (upto - first_step) * batch_size
            if kept is not None:
                batches, tasks = feed_range(kept, low, high, "position"), kept_tasks
            else:
                rows = feed_range(order.of(epoch), low, high, "position")
                batches, tasks = _dealt(job, rows, shards, upto - step)
            shared = job.spark.sparkContext.broadcast(state)
            # Written once: the weights and all logs come from the same pass.
            out = stage(_local_steps(job, batches, shared, first_step), "round")
            state = _averaged(sum_partials(out.where("step IS NULL"), tasks), state)
            checkpoints.write_metrics(_epoch_metrics(job, out), job.model_dir, job.run_id, upto)
            if job.histograms:
                checkpoints.write_histograms(_epoch_histograms(job, out), job.model_dir, job.run_id, upto)
            if job.report_every:
                checkpoints.write_report(_epoch_reports(out), job.model_dir, job.run_id, upto)
            shared.destroy()
            if step // checkpoint_every != upto // checkpoint_every or upto == job.steps:
                checkpoints.save_state(job.spark, job.model_dir, state, upto, job.run_id)
            step = upto
    finally:
        if kept is not None:
            kept.unpersist()
        order.close()
    return state
