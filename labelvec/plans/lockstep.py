"""Many synchronous steps in one job.

The tasks of a barrier stage run side by side; each holds its rows of every batch and all weights. In a step it writes its gradient
sums to the shared folder, waits for those of the others, adds up its own block of the values, updates that block of the weights with
the block of the optimizer's state that it keeps, writes it, and reads the others' blocks. So a step
costs each task three times the size of the model, whatever the number of tasks, and the driver nothing. A batch for one task
needs no exchange. If a task is lost, Spark starts the stage again, from the weights that the job was given.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import BarrierTaskContext, TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from labelvec.operators.batches import matrix, mini_batches
from labelvec.plans.network import NetSpec, Tensors, batch_sums, dropout_factors, tensor_stats
from labelvec.plans.optimizers import Adagrad, Adam
from labelvec.plans.partials import HISTOGRAM, SCHEMA, partial_rows
from labelvec.sources.files import filesystem_of, qualified, remove_path
from labelvec.session import staging_path

METRICS = ("loss", "correct", "rows")
# A task that fails ends the stage for all; this is for files that never appear although it runs.
WAIT_SECONDS = 600


def fits(spark: SparkSession, tasks: int) -> bool:
    """Whether so many tasks can run side by side, as a barrier needs."""
    fixed = spark.conf.get("spark.dynamicAllocation.enabled", "false").lower() != "true"
    return tasks == 1 or (fixed and tasks <= spark.sparkContext.defaultParallelism)


class _Alone:
    """The exchange of a single task."""

    def __init__(self, values: int):
        self.low, self.high = 0, values

    def total(self, step: int, head: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return head, values

    def shared(self, step: int, block: np.ndarray, values: np.ndarray) -> np.ndarray:
        return block


class _Folder:
    """Blocks of values between the tasks of a barrier stage, through files that all of them reach.

    A file gets its name once it is whole, and tasks wait for each other's files: Spark's own barrier looks
    for its answer once a second only. Whoever has written a block of a step has read all sums of it, and whoever has written sums has
    read all blocks of the step before, so files can go as soon as the next kind has been seen from everyone.
    """

    def __init__(self, folder: str, context: BarrierTaskContext, values: int):
        self.tasks, self.me = len(context.getTaskInfos()), context.partitionId()
        # Files of a stage that was given up are never read by the next one.
        attempt = max(context.allGather(str(context.taskAttemptId())), key=int)
        self.filesystem, self.folder = filesystem_of(f"{folder}/{attempt}")
        self.edges = np.linspace(0, values, self.tasks + 1).astype(np.int64)
        self.low, self.high = self.edges[self.me : self.me + 2]
        self.filesystem.create_dir(self.folder, recursive=True)

    def _path(self, kind: str, step: int, task: int) -> str:
        return f"{self.folder}/{kind}-{step}-{task}"

    def _exists(self, path: str) -> bool:
        return self.filesystem.get_file_info(path).type == fs.FileType.File

    def _write(self, path: str, *parts: np.ndarray) -> None:
        with self.filesystem.open_output_stream(f"{path}.part") as out:
            for part in parts:
                out.write(np.ascontiguousarray(part, np.float64).tobytes())
        self.filesystem.move(f"{path}.part", path)

    def _open(self, path: str):
        pause, until = 0.001, time.monotonic() + WAIT_SECONDS
        while not self._exists(path):
            if time.monotonic() > until:
                raise TimeoutError(f"{path}: no task has written it")
            time.sleep(pause)
            pause = min(0.05, pause * 1.5)
        return self.filesystem.open_input_file(path)

    def total(self, step: int, head: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums over all tasks, in their order: of ``head``, and of this task's block of ``values``."""
        self._write(self._path("sums", step, self.me), head, values)
        heads, block = np.zeros_like(head), np.zeros(self.high - self.low)
        for task in range(self.tasks):
            with self._open(self._path("sums", step, task)) as file:
                heads += np.frombuffer(file.read_at(8 * len(head), 0))
                block += np.frombuffer(file.read_at(8 * len(block), 8 * int(len(head) + self.low)))
        before = self._path("block", step - 1, self.me)
        if self._exists(before):
            self.filesystem.delete_file(before)
        return heads, block

    def shared(self, step: int, block: np.ndarray, values: np.ndarray) -> np.ndarray:
        """The blocks of all tasks."""
        self._write(self._path("block", step, self.me), block)
        out = np.empty(len(values))
        for task in range(self.tasks):
            with self._open(self._path("block", step, task)) as file:
                out[self.edges[task] : self.edges[task + 1]] = np.frombuffer(file.read())
        self.filesystem.delete_file(self._path("sums", step, self.me))
        return out


@dataclass(frozen=True)
class Plan:
    """What the tasks of a job of steps need to know."""

    spec: NetSpec
    optimizer: Adagrad | Adam
    batch_size: int
    n_rows: int
    n_batches: int
    keep_prob: float
    seed: int
    input_column: str
    log_every: int
    histograms: bool | str

    def rows_of(self, number: int) -> int:
        return min(self.batch_size, self.n_rows - number * self.batch_size)


def _flat(tensors: Tensors, names) -> np.ndarray:
    return np.concatenate([np.asarray(tensors[n], np.float64).ravel() for n in names])


def _whole(flat: np.ndarray, shapes: dict[str, tuple[int, ...]]) -> Tensors:
    sizes = np.cumsum([int(np.prod(s)) for s in shapes.values()])[:-1]
    return {n: part.reshape(shape) for (n, shape), part in zip(shapes.items(), np.split(flat, sizes))}


def run_steps(plan: Plan, rows: DataFrame, state: Tensors, steps: list[tuple[int, int]], tasks: int, weight_counts) -> tuple[DataFrame, str]:
    """Partial rows of ``steps`` (step, batch number in its epoch): logged values by step, and blocks of the new state.

    ``rows`` are (step, position, sample_id, input, label). State rows carry the step null and their place in ``block``.
    The folder of the exchange, if there is one, comes second.
    """
    spark = rows.sparkSession
    spec, optimizer, shapes = plan.spec, plan.optimizer, plan.spec.shapes
    shared = spark.sparkContext.broadcast(state)
    folder = qualified(spark, staging_path(spark, "exchange")) if tasks > 1 else ""
    slots = [n.removeprefix(spec.names[0]) for n in optimizer.slots({spec.names[0]: np.zeros(1)}) if n.startswith(spec.names[0])]
    block_spec = SimpleNamespace(names=("block",))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = {n: shared.value[n] for n in spec.names}
        flat = _flat(weights, spec.names)
        me = TaskContext.get().partitionId()
        exchange = _Folder(folder, BarrierTaskContext.get(), len(flat)) if tasks > 1 else _Alone(len(flat))
        low, high = exchange.low, exchange.high
        own = {"block": flat[low:high]}
        own |= {f"block{s}": _flat(shared.value, [n + s for n in spec.names])[low:high] for s in slots}
        own |= {n: v for n, v in shared.value.items() if n not in own and not n.startswith(spec.names)}
        waiting = mini_batches(batches, plan.batch_size, "step")
        held = next(waiting, None)
        for step, number in steps:
            logs = step % plan.log_every == 0
            sums: Tensors = {n: np.zeros(s) for n, s in shapes.items()} | {m: np.zeros(1) for m in METRICS}
            if held is not None and held[0] == step:
                batch = held[2]
                factors = None
                if plan.keep_prob < 1.0:
                    factors = dropout_factors(batch.column("sample_id").to_numpy(), spec.hidden, step, plan.seed, plan.keep_prob)
                x = spec.prepare(matrix(batch.column(plan.input_column), spec.inputs))
                sums = batch_sums(spec, weights, x, matrix(batch.column("label"), spec.classes), factors, plan.histograms if logs else False)
                held = next(waiting, None)
            head, block = exchange.total(step, _flat(sums, METRICS), _flat(sums, spec.names))
            if logs:
                logged: Tensors = {n: v for n, v in sums.items() if n.startswith(HISTOGRAM)}
                if me == 0:  # the same in all tasks
                    logged["metrics"] = head
                    if spec.kind == "b":
                        logged["stats"] = tensor_stats(spec, weights)
                    if plan.histograms:
                        logged |= weight_counts(spec, weights, plan.histograms)
                yield from partial_rows(logged, step)
            scale = 1.0 if spec.kind == "a" else 1.0 / max(plan.rows_of(number), 1)
            own = optimizer.update(block_spec, own, {"block": block * scale})
            flat = exchange.shared(step, own["block"], flat)
            weights = _whole(flat, shapes)
        for suffix in ("", *slots):
            # Blocks are numbered by their first value; tensors are cut from the whole vector at the end.
            yield _state_row(f"state{suffix}", int(low), own[f"block{suffix}"])
        if me == 0:
            for name in own:
                if not name.startswith("block"):
                    yield _state_row(name, 0, own[name])

    parts = rows.repartitionById(tasks, F.pmod(F.col("position"), F.lit(tasks)).cast("int")).sortWithinPartitions("step", "position")
    columns = ["step", "position", "sample_id", plan.input_column, "label"]
    return parts.select(*columns).mapInArrow(run, SCHEMA, barrier=tasks > 1), folder


def _state_row(name: str, low: int, values: np.ndarray) -> pa.RecordBatch:
    data = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, pa.float64()))
    return pa.RecordBatch.from_arrays(
        [pa.array([0], pa.int32()), pa.array([name]), pa.array([low], pa.int64()), pa.array([None], pa.int64()), data],
        names=["part", "tensor", "block", "step", "data"],
    )


def new_state(out: DataFrame, spec: NetSpec, state: Tensors) -> Tensors:
    """The state after the steps, from the blocks that the tasks return."""
    rows = out.where("step IS NULL").select("tensor", "block", "data").toArrow().sort_by([("tensor", "ascending"), ("block", "ascending")])
    names, data = rows["tensor"].to_pylist(), rows["data"].combine_chunks()
    found: dict[str, list[np.ndarray]] = {}
    for i, name in enumerate(names):
        found.setdefault(name, []).append(data[i].values.to_numpy())
    new = {}
    for name, blocks in found.items():
        flat = np.concatenate(blocks)
        if name.startswith("state"):
            suffix = name.removeprefix("state")
            new |= {n + suffix: v for n, v in _whole(flat, spec.shapes).items()}
        else:
            new[name] = flat
    return {n: new[n] for n in state}


def drop(spark: SparkSession, folder: str) -> None:
    if folder:
        remove_path(spark, folder)
