"""Reshuffled epochs, averaging rounds inside an epoch, shards that share tasks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelvec.functions import permutation
from labelvec.plans import checkpoints, training
from labelvec.plans.network import NetSpec, batch_sums, gradient, initial_weights
from labelvec.plans.optimizers import default_optimizer
from labelvec.plans.training import round_steps, train_mlp
from labelvec.streaming import feed

A = NetSpec(kind="a", inputs=4, hidden=6, classes=3, divisor=1.0)
B = NetSpec(kind="b", inputs=4, hidden=6, classes=3, divisor=1.0)
ROWS, SIZE = 230, 20
BATCHES = -(-ROWS // SIZE)


@pytest.fixture(scope="module")
def arrays():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(ROWS, 4))
    return x, np.eye(3)[x[:, :3].argmax(axis=1)]


@pytest.fixture(scope="module")
def samples(spark, arrays):
    x, y = arrays
    rows = [(i, a, b) for i, (a, b) in enumerate(zip(x.tolist(), y.tolist()))]
    return spark.createDataFrame(rows, "sample_id long, image array<double>, label array<double>").repartition(5).persist()


def order_of(epoch, seed=5, reshuffle=True):
    """Ids in the order of an epoch."""
    ids = np.arange(ROWS)
    return np.argsort(permutation.shuffled(ids, ROWS, seed, epoch)) if reshuffle else ids


def trained(spec, arrays, state, batches):
    x, y = arrays
    for ids in batches:
        sums = batch_sums(spec, state, x[ids], y[ids])
        state = default_optimizer(spec).update(spec, state, gradient(spec, sums))
    return state


def start(spec):
    weights = initial_weights(spec, 5)
    return {**weights, **default_optimizer(spec).slots(weights)}


def by_hand(spec, arrays, epochs, shards, every, reshuffle=False):
    state = start(spec)
    for epoch in range(epochs):
        order = order_of(epoch, reshuffle=reshuffle)
        batches = [order[b * SIZE : (b + 1) * SIZE] for b in range(BATCHES)]
        for low in range(0, BATCHES, shards * every):
            part = range(low, min(low + shards * every, BATCHES))
            sums, rows = {}, 0
            for s in range(shards):
                own = [batches[b] for b in part if b % shards == s]
                n = sum(map(len, own))
                if n:
                    end = trained(spec, arrays, state, own)
                    sums = {k: sums.get(k, 0) + n * v for k, v in end.items()}
                    rows += n
            state = {k: v / rows for k, v in sums.items()}
    return state


def close(a, b):
    assert a.keys() == b.keys()
    for name in a:
        assert np.allclose(a[name], b[name], rtol=1e-9, atol=1e-12), name


# ---------------------------------------------------------------- the bijection


@pytest.mark.parametrize("n", [1, 2, 3, 16, 17, 230, 4999])
def test_every_place_is_taken_once(spark, n):
    epochs = 3
    rows = feed.epoch_shuffle(spark.range(n).withColumnRenamed("id", "sample_id"), n, epochs, 10, seed=4).collect()
    assert len(rows) == n * epochs
    for epoch in range(epochs):
        own = {r.sample_id: r.position for r in rows if r.epoch == epoch}
        assert sorted(own.values()) == list(range(n))
        assert [own[i] for i in range(n)] == permutation.shuffled(np.arange(n), n, 4, epoch).tolist()
    assert all((r.batch_id, r.batch_pos) == divmod(r.position, 10) for r in rows)


def test_orders_differ_and_look_random():
    n = 10_000
    places = [permutation.shuffled(np.arange(n), n, seed, epoch) for seed, epoch in ((1, 0), (1, 1), (2, 0))]
    for i, a in enumerate(places):
        assert abs(np.corrcoef(a, np.arange(n))[0, 1]) < 0.05
        neighbours = np.abs(np.diff(a))
        assert (neighbours > 100).mean() > 0.95
        for b in places[:i]:
            assert (a == b).sum() < 10 and abs(np.corrcoef(a, b)[0, 1]) < 0.05


def test_large_numbers_of_rows_need_no_table(spark):
    n = 10**12 + 39
    ids = [0, 1, 2**40 - 1, n - 1, n // 2]
    frame = spark.createDataFrame([(i,) for i in ids], "id long")
    got = {r.id: r.place for r in frame.select("id", permutation.shuffled_position(F.col("id"), n, 3, 9).alias("place")).collect()}
    want = permutation.shuffled(np.array(ids), n, 3, 9)
    assert [got[i] for i in ids] == want.tolist() and want.max() < n and len(set(want)) == len(ids)


def test_the_order_is_an_expression(spark):
    frame = feed.epoch_shuffle(spark.range(50).withColumnRenamed("id", "sample_id"), 50, 2)
    plan = frame._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Exchange", "Sort", "Window", "Python"))
    with pytest.raises(ValueError, match="how many epochs"):
        permutation.shuffled_position(F.col("id"), 5, 0, F.col("epoch"))
    with pytest.raises(ValueError, match="cannot permute"):
        permutation.grid(0)


# ---------------------------------------------------------------- training in that order


@pytest.mark.parametrize("tasks", [1, 3])
def test_sync_takes_a_new_order_each_epoch(samples, arrays, tasks):
    result = train_mlp(samples, A, mode="sync", epochs=2, batch_size=SIZE, seed=5, reshuffle=True, tasks=tasks, steps=BATCHES + 3, report_every=BATCHES)
    order = [order_of(e) for e in (0, 1)]
    batches = [order[0][b * SIZE : (b + 1) * SIZE] for b in range(BATCHES)] + [order[1][b * SIZE : (b + 1) * SIZE] for b in range(3)]
    close(result.state, trained(A, arrays, start(A), batches))
    reported = {s: sorted(r.sample_id for r in result.reports(samples.sparkSession).where(f"step = {s}").collect()) for s in (0, BATCHES)}
    assert reported == {0: sorted(batches[0].tolist()), BATCHES: sorted(batches[BATCHES].tolist())}


@pytest.mark.parametrize(("shards", "every"), [(1, 64), (2, 2), (3, 64)])
def test_rounds_take_a_new_order_each_epoch(samples, arrays, shards, every):
    result = train_mlp(samples, A, epochs=2, batch_size=SIZE, seed=5, reshuffle=True, shards=shards, average_every=every, image_shape=(2, 2), images_per_step=2)
    close(result.state, by_hand(A, arrays, 2, shards, every, reshuffle=True))
    images = sorted((r.step, r.image_no, r.sample_id) for r in result.images(samples.sparkSession).collect())
    want = [(e * BATCHES + b, k, int(order_of(e)[b * SIZE + k])) for e in (0, 1) for b in range(BATCHES) for k in (0, 1)]
    assert images == want


# ---------------------------------------------------------------- rounds


@pytest.mark.parametrize(("shards", "every"), [(2, 1), (2, 3), (5, 2), (12, 1)])
@pytest.mark.parametrize("spec", [A, B], ids=["a", "b"])
def test_averages_every_few_batches(samples, arrays, spec, shards, every):
    result = train_mlp(samples, spec, epochs=2, batch_size=SIZE, seed=5, shards=shards, average_every=every, keep_prob=1.0)
    close(result.state, by_hand(spec, arrays, 2, shards, every))
    steps = sorted(r.step for r in result.metrics(samples.sparkSession).where("tag IN ('acc', 'accuracy')").collect())
    assert steps == list(range(2 * BATCHES))


def test_saves_inside_an_epoch(samples, tmp_path):
    path = str(tmp_path / "m")
    train_mlp(samples, A, epochs=1, batch_size=SIZE, seed=5, shards=2, checkpoint_every=4, model_dir=path)
    saved = checkpoints.read_weights(samples.sparkSession, path).select("step").distinct()
    assert sorted(r.step for r in saved.collect()) == [4, 8, BATCHES]


@pytest.mark.parametrize("reshuffle", [False, True])
def test_resume_from_the_middle_of_an_epoch(samples, tmp_path, monkeypatch, reshuffle):
    spark = samples.sparkSession
    options = dict(epochs=2, batch_size=SIZE, seed=5, shards=2, average_every=2, checkpoint_every=4, keep_prob=0.8, reshuffle=reshuffle)
    whole = train_mlp(samples, B, model_dir=str(tmp_path / "w"), **options)
    path, rounds = str(tmp_path / "p"), []

    def lost(*args, run=training._local_steps):
        rounds.append(1)
        if len(rounds) == 5:
            raise RuntimeError("lost")
        return run(*args)

    monkeypatch.setattr(training, "_local_steps", lost)
    with pytest.raises(RuntimeError, match="lost"):
        train_mlp(samples, B, model_dir=path, **options)
    assert checkpoints.load_state(spark, path, "train")[0] == BATCHES + 4
    resumed = train_mlp(samples, B, model_dir=path, resume=True, **options)
    close(resumed.state, whole.state)
    logs = [sorted((r.step, r.tag, round(r.value, 9)) for r in x.metrics(spark).collect()) for x in (whole, resumed)]
    assert logs[0] == logs[1]


def test_shards_share_tasks(samples, arrays, monkeypatch):
    tasks = []

    def seen(job, rows, *args, run=training._local_steps):
        tasks.append(rows.rdd.getNumPartitions())
        return run(job, rows, *args)

    monkeypatch.setattr(training, "_local_steps", seen)
    one = train_mlp(samples, A, batch_size=SIZE, seed=5, shards=6)
    monkeypatch.setattr(training, "TASK_ROWS", 3 * SIZE)
    several = train_mlp(samples, A, batch_size=SIZE, seed=5, shards=6)
    assert tasks == [1, 4]
    close(one.state, several.state)
    close(one.state, by_hand(A, arrays, 1, 6, 64))


def test_steps_of_a_round():
    assert round_steps(1000, 10, 64, 100) == 100
    assert round_steps(1000, 10, 5, 100) == 50
    assert round_steps(1000, 300, 64, 100) == 300
    assert round_steps(20, 2, 64, 100) == 20
    with pytest.raises(ValueError, match="averaged"):
        round_steps(20, 2, 0, 100)
