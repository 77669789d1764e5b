"""Training on a table that grows, fed by a stream."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelvec.plans import checkpoints
from labelvec.plans.network import NetSpec
from labelvec.plans.training import train_mlp
from labelvec.sources import write_samples
from labelvec.sources.columnar import chunk_of
from labelvec.streaming import online
from labelvec.streaming.online import OnlineTraining

B = NetSpec(kind="b", inputs=4, hidden=6, classes=3, divisor=1.0)
ROWS, SIZE = 230, 50


@pytest.fixture(scope="module")
def samples(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(ROWS, 4))
    y = np.eye(3)[x[:, :3].argmax(axis=1)]
    rows = [(i, a, b) for i, (a, b) in enumerate(zip(x.tolist(), y.tolist()))]
    return spark.createDataFrame(rows, "sample_id long, image array<double>, label array<double>").persist()


def append(rows, path):
    rows.withColumns({"split": F.lit("train"), "chunk": chunk_of(F.col("sample_id"))}).repartition(3).write.mode("append").partitionBy("split", "chunk").parquet(path)


def close(a, b):
    assert a.keys() == b.keys()
    for name in a:
        assert np.allclose(a[name], b[name], rtol=1e-9, atol=1e-12), name


@pytest.mark.parametrize("n", [0, 1, 7, 32768, 32769, 100_000])
def test_ids_without_a_gap(spark, n):
    rows = spark.range(n).withColumnRenamed("id", "sample_id")
    beyond = spark.range(n + 1, n + 40_000, 3).withColumnRenamed("id", "sample_id")
    assert online.complete_ids(online.id_bitmaps(rows.union(beyond))) == n
    assert online.complete_ids(online.id_bitmaps(rows.union(rows))) == n


def test_a_table_that_grows_gives_the_weights_of_one_that_is_there(spark, samples, tmp_path):
    path, model, stream = (str(tmp_path / n) for n in ("table", "model", "stream"))
    options = dict(seed=5, keep_prob=0.8)
    append(samples.where("sample_id < 130 AND sample_id <> 60"), path)
    run = OnlineTraining(spark, path, B, model, SIZE, **options)
    assert run.run_available(stream, files_per_batch=1, short=False).step == 1  # 60 is missing
    append(samples.where("sample_id IN (60, 140)"), path)
    again = OnlineTraining(spark, path, B, model, SIZE, **options)  # another process
    assert again.run_available(stream, short=False).step == 2
    append(samples.where("sample_id >= 130 AND sample_id <> 140"), path)
    result = again.run_available(stream, files_per_batch=2)
    whole = train_mlp(samples, B, mode="sync", batch_size=SIZE, epochs=1, **options)
    assert result.step == whole.step == 5
    close(result.state, whole.state)
    steps = sorted(r.step for r in result.metrics(spark).where("tag = 'accuracy'").collect())
    assert steps == list(range(5))


def test_a_batch_that_comes_again_changes_nothing(spark, samples, tmp_path):
    path, model = str(tmp_path / "table"), str(tmp_path / "model")
    write_samples(samples, path)
    ids = samples.select("sample_id")
    first = OnlineTraining(spark, path, B, model, SIZE, seed=5)
    first.micro_batch(ids.where("sample_id < 120"), 0)
    state = first.result.state
    # the process ends before the stream has noted batch 0 as done
    second = OnlineTraining(spark, path, B, model, SIZE, seed=5)
    second.micro_batch(ids.where("sample_id < 120"), 0)
    close(second.result.state, state)
    assert second.result.step == 2
    assert checkpoints.read_table(spark, f"{model}/arrived", online.ARRIVED, "train").count() == 1
    second.micro_batch(ids.where("sample_id >= 120"), 1)
    second.catch_up(short=True)
    close(second.result.state, train_mlp(samples, B, mode="sync", batch_size=SIZE, epochs=1, seed=5).state)


def test_nothing_has_arrived(spark, samples, tmp_path):
    path = str(tmp_path / "table")
    append(samples.where("sample_id >= 100"), path)
    assert OnlineTraining(spark, path, B, str(tmp_path / "m"), SIZE).run_available(str(tmp_path / "s")) is None
