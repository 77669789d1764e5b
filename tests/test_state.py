"""State rows that executors update, and histograms of any range."""

import pickle

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelvec.functions import vectors
from labelvec.operators import metrics as M
from labelvec.plans import partials, state_rows, training
from labelvec.plans.network import NetSpec, batch_sums, bucket_counts, gradient, initial_weights
from labelvec.plans.optimizers import Adagrad, Adam
from labelvec.plans.training import train_mlp

A = NetSpec(kind="a", inputs=4, hidden=6, classes=3, divisor=1.0)
B = NetSpec(kind="b", inputs=4, hidden=6, classes=3, divisor=1.0)
ROWS = 90


@pytest.fixture(scope="module")
def arrays():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(ROWS, 4))
    return x, np.eye(3)[x[:, :3].argmax(axis=1)]


@pytest.fixture(scope="module")
def samples(spark, arrays):
    rows = [(i, a, b) for i, (a, b) in enumerate(zip(*(v.tolist() for v in arrays)))]
    return spark.createDataFrame(rows, "sample_id long, image array<double>, label array<double>").repartition(4).persist()


def told(stored, spark, optimizer):
    out = {}
    for r in state_rows.values_of(stored.rows(spark), optimizer).collect():
        out[r.tensor, r.i] = r.value
    return out


@pytest.mark.parametrize(("kind", "optimizer"), [("a", Adagrad(0.05)), ("b", Adam(0.01))], ids=["adagrad", "adam"])
@pytest.mark.parametrize("inputs", [4, 9000], ids=["one block", "two blocks"])
def test_updates_on_executors_equal_one_process(spark, samples, arrays, kind, optimizer, inputs):
    spec = NetSpec(kind=kind, inputs=inputs, hidden=6, classes=3, divisor=1.0)
    if inputs > 4:
        samples = samples.withColumn("image", F.flatten(F.array_repeat("image", inputs // 4)))
        arrays = np.tile(arrays[0], inputs // 4), arrays[1]
        assert inputs * 6 > partials.BLOCK_VALUES
    weights = initial_weights(spec, 5)
    state = {**weights, **optimizer.slots(weights)}
    stored = state_rows.StoredState.store(state_rows.rows_of(spark, spec, weights, optimizer), spec)
    for k in range(3):
        sums = batch_sums(spec, state, *arrays)
        state = optimizer.update(spec, state, gradient(spec, sums))
        stored, logged = state_rows.step(stored, samples, optimizer, updates=k + 1)
        assert logged["rows"] == ROWS and logged["loss"] == pytest.approx(sums["loss"][0])
    got = told(stored, spark, optimizer)
    want = {(n, i): v for n, t in state.items() if n != "Adam/updates" for i, v in enumerate(t.ravel())}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], rel=1e-9, abs=1e-12) for k in want)


@pytest.mark.parametrize("spec", [A, B], ids=["a", "b"])
def test_first_rows_are_drawn_by_executors(spark, monkeypatch, spec):
    monkeypatch.setattr(state_rows, "BLOCK_VALUES", 7)
    optimizer = Adagrad() if spec.kind == "a" else Adam()
    stored = state_rows.StoredState.store(state_rows.initial_rows(spark, spec, optimizer, 6), spec)
    assert "_weights" in vars(stored) and pickle.loads(pickle.dumps(stored))._weights is None
    want = initial_weights(spec, 6)
    for name, values in want.items():
        assert np.allclose(stored.value[name], values, rtol=1e-12, atol=1e-15)
    slots = {k: v for k, v in told(stored, spark, optimizer).items() if "/Ada" in k[0]}
    assert set(slots.values()) == ({0.1} if spec.kind == "a" else {0.0})
    assert len(slots) == sum(v.size for v in want.values()) * (1 if spec.kind == "a" else 2)


def test_an_update_plan_has_no_python(spark, samples):
    rows = state_rows.rows_of(spark, A, initial_weights(A, 1), Adagrad())
    sums = rows.select("tensor", "block", F.col("w").alias("data"))
    plan = state_rows.updated(rows, sums, Adagrad(), 1.0, 1)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_no_rows_are_an_error(spark, samples):
    stored = state_rows.StoredState.store(state_rows.rows_of(spark, A, initial_weights(A, 1), Adagrad()), A)
    with pytest.raises(ValueError, match="no samples"):
        state_rows.step(stored, samples.limit(0), Adagrad(), 1)


# ---------------------------------------------------------------- logarithmic buckets


def spread(n=4000):
    rng = np.random.default_rng(1)
    return np.concatenate([[0.0, -0.0, 1e-30, -1e30, 1.0, -1.0], rng.choice([-1, 1], n) * 10.0 ** rng.uniform(-30, 30, n)])


def test_buckets_of_any_range_are_few_and_close(spark):
    values = spread()
    frame = spark.createDataFrame([(float(v),) for v in values], "value double").select(F.lit("t").alias("tensor"), "value")
    rows = frame.select("value", vectors.log_bucket(F.col("value")).alias("b"), vectors.log_bucket_value(vectors.log_bucket(F.col("value"))).alias("about")).collect()
    assert [r.b for r in rows] == vectors.log_buckets(np.array([r.value for r in rows])).tolist()
    for r in rows:
        assert r.about == 0 if r.value == 0 else abs(r.about - r.value) <= (vectors.LOG_ERROR + 1e-9) * abs(r.value)
    found = M.log_histogram(frame).collect()
    assert sum(r.n for r in found) == len(values)
    # 60 powers of ten of either sign, and zero
    assert len(found) <= 2 * (60 * np.log(10) / np.log(1.05 / 0.95) + 2) + 1
    assert sorted((r.bucket, r.n) for r in found) == list(map(tuple, bucket_counts(values, None).tolist()))


def test_buckets_keep_the_order_of_values():
    values = np.sort(spread())
    assert (np.diff(vectors.log_buckets(values)) >= 0).all()
    with pytest.raises(ValueError, match="relative error"):
        vectors.log_buckets(values, 1.5)


def test_steps_log_few_buckets_of_heavy_tails(spark, arrays):
    x, y = arrays
    scale = 10.0 ** np.random.default_rng(2).uniform(-30, 30, ROWS)
    rows = [(i, (a * s).tolist(), b.tolist()) for i, (a, b, s) in enumerate(zip(x, y, scale))]
    samples = spark.createDataFrame(rows, "sample_id long, image array<double>, label array<double>")
    logs = []
    for options in (dict(mode="sync"), dict(mode="sync", steps_per_job=1), dict(mode="epoch_avg")):
        result = train_mlp(samples, B, batch_size=ROWS, steps=1, seed=5, keep_prob=1.0, histograms="log", **options)
        found = result.histograms(spark).collect()
        assert all(r.width is None for r in found)
        assert sum(r.n for r in found if r.tag == "layer1/activations") == ROWS * 6
        logs.append(sorted((r.step, r.tag, r.bucket, r.n) for r in found))
    assert logs[0] == logs[1] == logs[2]
    assert max(abs(b) for _, t, b, _ in logs[0] if t == "layer1/pre_activations") < vectors.LOG_OFFSET + 800
    assert training.hist_width("log", 0.5) is None and training.hist_width(True, 0.5) == 0.5
