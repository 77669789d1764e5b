"""Many synchronous steps in one job, against a job for each step."""

import numpy as np
import pytest

from labelvec.plans import lockstep, training
from labelvec.plans.network import NetSpec, batch_sums, gradient, initial_weights
from labelvec.plans.optimizers import default_optimizer
from labelvec.plans.training import train_mlp

A = NetSpec(kind="a", inputs=4, hidden=6, classes=3, divisor=1.0)
B = NetSpec(kind="b", inputs=4, hidden=6, classes=3, divisor=1.0)
ROWS, SIZE = 190, 30


@pytest.fixture(scope="module")
def arrays():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(ROWS, 4))
    return x, np.eye(3)[x[:, :3].argmax(axis=1)]


@pytest.fixture(scope="module")
def samples(spark, arrays):
    rows = [(i, a, b) for i, (a, b) in enumerate(zip(*(v.tolist() for v in arrays)))]
    return spark.createDataFrame(rows, "sample_id long, image array<double>, label array<double>").repartition(3).persist()


def close(a, b):
    assert a.keys() == b.keys()
    for name in a:
        assert a[name].shape == b[name].shape and np.allclose(a[name], b[name], rtol=1e-9, atol=1e-12), name


@pytest.fixture
def jobs(monkeypatch):
    seen = []

    def counted(job, feed, state, first, upto, every, run=training._run_job):
        seen.append((first, upto))
        return run(job, feed, state, first, upto, every)

    monkeypatch.setattr(training, "_run_job", counted)
    return seen


@pytest.mark.parametrize("spec", [A, B], ids=["a", "b"])
@pytest.mark.parametrize("tasks", [1, 2, 5])
def test_steps_of_a_job_equal_one_process(samples, arrays, jobs, spec, tasks):
    result = train_mlp(samples, spec, mode="sync", epochs=2, batch_size=SIZE, seed=5, tasks=tasks, keep_prob=1.0, steps=10)
    assert jobs == [(0, 10)]
    weights = initial_weights(spec, 5)
    state, losses = {**weights, **default_optimizer(spec).slots(weights)}, []
    for b in [0, 1, 2, 3, 4, 5, 6, 0, 1, 2]:
        x, y = (v[b * SIZE : (b + 1) * SIZE] for v in arrays)
        sums = batch_sums(spec, state, x, y)
        losses.append(float(sums["loss"][0]) / (1 if spec.kind == "a" else len(x)))
        state = default_optimizer(spec).update(spec, state, gradient(spec, sums))
    close(result.state, state)
    tag = "loss" if spec.kind == "a" else "cross_entropy"
    logged = result.metrics(samples.sparkSession).where(f"tag = '{tag}'").orderBy("step").collect()
    assert [r.step for r in logged] == list(range(10)) and np.allclose([r.value for r in logged], losses)


@pytest.mark.parametrize("reshuffle", [False, True])
def test_logs_equal_those_of_a_job_for_each_step(samples, tmp_path, jobs, reshuffle):
    spark = samples.sparkSession
    options = dict(
        mode="sync", batch_size=SIZE, seed=5, tasks=3, keep_prob=0.7, steps=17, eval_samples=samples, eval_every=6,
        checkpoint_every=4, histograms=True, report_every=5, reshuffle=reshuffle,
    )
    one = train_mlp(samples, B, steps_per_job=1, **options)
    assert jobs == []
    many = train_mlp(samples, B, **options)
    close(one.state, many.state)
    for table in ("metrics", "histograms", "reports"):
        logs = [sorted(tuple(round(v, 8) if isinstance(v, float) else v for v in r) for r in getattr(x, table)(spark).drop("run_id").collect()) for x in (one, many)]
        assert logs[0] == logs[1] and logs[0], table
    # jobs end at evaluations, saves, reports and the ends of reshuffled epochs
    assert {0, 6, 12} & {s for a, b in jobs for s in range(a, b)} == set()
    assert all(b % 4 == 0 or b % 6 == 0 or (b - 1) % 5 == 0 or reshuffle or b == 17 for _, b in jobs)


def test_a_job_of_few_steps(samples, jobs):
    options = dict(mode="sync", epochs=1, batch_size=SIZE, seed=5, tasks=2)
    two = train_mlp(samples, A, steps_per_job=2, **options)
    assert jobs == [(0, 2), (2, 4), (4, 6), (6, 7)]
    close(two.state, train_mlp(samples, A, **options).state)


def test_more_tasks_than_rows(samples):
    options = dict(mode="sync", epochs=1, batch_size=3, seed=5, steps=4)
    close(train_mlp(samples, A, tasks=7, **options).state, train_mlp(samples, A, tasks=1, **options).state)


def test_a_batch_for_more_tasks_than_slots_is_a_job_each(samples, jobs):
    spark = samples.sparkSession
    assert not lockstep.fits(spark, spark.sparkContext.defaultParallelism + 1)
    options = dict(mode="sync", epochs=1, batch_size=SIZE, seed=5, steps=2)
    wide = train_mlp(samples, A, tasks=spark.sparkContext.defaultParallelism + 1, **options)
    assert jobs == []
    close(wide.state, train_mlp(samples, A, tasks=2, **options).state)


def test_nothing_is_left_of_an_exchange(samples, monkeypatch):
    folders = []
    monkeypatch.setattr(lockstep, "drop", lambda spark, folder, run=lockstep.drop: (folders.append(folder), run(spark, folder)))
    train_mlp(samples, A, mode="sync", epochs=1, batch_size=SIZE, seed=5, tasks=2, steps=3)
    path = samples.sparkSession._jvm.org.apache.hadoop.fs.Path(folders[0])
    assert not path.getFileSystem(samples.sparkSession._jsc.hadoopConfiguration()).exists(path)
