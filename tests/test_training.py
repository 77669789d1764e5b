import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from labelvec import functions as V, sources
from labelvec.operators import metrics as M
from labelvec.operators.batches import apply_batches
from labelvec.plans import checkpoints, jobs, partials, training
from labelvec.plans.network import NetSpec, batch_sums, gradient, initial_weights, layers
from labelvec.plans.optimizers import Adagrad, default_optimizer
from labelvec.plans.training import count_dense, evaluate, train_mlp
from labelvec.streaming import feed
from labelvec.testing import write_idx_files

A = NetSpec(kind="a", inputs=4, hidden=6, classes=3, divisor=1.0)
B = NetSpec(kind="b", inputs=4, hidden=6, classes=3, divisor=1.0)
ROWS = 230


@pytest.fixture(scope="module")
def arrays():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(ROWS, 4))
    return x, np.eye(3)[x[:, :3].argmax(axis=1)]


@pytest.fixture(scope="module")
def samples(spark, arrays):
    x, y = arrays
    table = pa.table(
        {"sample_id": np.arange(ROWS), "image": x.tolist(), "label": y.tolist()}
    )
    return spark.createDataFrame(table).repartition(5).persist()


def by_hand(spec, arrays, batches, batch_size, optimizer=None):
    """The same training in one process."""
    x, y = arrays
    optimizer = optimizer or default_optimizer(spec)
    weights = initial_weights(spec, 5)
    state = {**weights, **optimizer.slots(weights)}
    losses = []
    for b in batches:
        rows = slice(b * batch_size, (b + 1) * batch_size)
        sums = batch_sums(spec, state, x[rows], y[rows])
        losses.append(float(sums["loss"][0]))
        state = optimizer.update(spec, state, gradient(spec, sums))
    return state, losses


def close(a, b):
    assert a.keys() == b.keys()
    for name in a:
        assert np.allclose(a[name], b[name], rtol=1e-9, atol=1e-12), name


@pytest.mark.parametrize("partitions", [1, 3, 20])
@pytest.mark.parametrize("spec", [A, B], ids=["a", "b"])
def test_gradient_does_not_depend_on_the_layout(samples, arrays, spec, partitions):
    weights = initial_weights(spec, 5)
    sums = partials.dataset_sums(samples.repartition(partitions), spec, weights)
    want = batch_sums(spec, weights, *arrays)
    close(gradient(spec, sums), gradient(spec, want))
    assert sums["rows"][0] == ROWS and sums["loss"][0] == pytest.approx(want["loss"][0])


def test_partials_add_up_in_levels(spark, samples, arrays, monkeypatch):
    monkeypatch.setattr(partials, "BLOCK_VALUES", 6)
    weights = initial_weights(A, 5)
    shared = spark.sparkContext.broadcast(weights)
    rows = partials.gradient_partials(samples.repartition(20), A, shared, histograms=True)
    one_level = partials.sum_partials(rows, 20)
    monkeypatch.setattr(partials, "FAN_IN", 3)
    levels = partials.sum_partials(rows, 20)
    close(levels, one_level)
    want = batch_sums(A, weights, *arrays, histograms=True)
    close(gradient(A, levels), gradient(A, want))
    for name in want:
        if name.startswith("hist:"):
            assert sorted(levels[name].tolist()) == sorted(want[name].tolist()), name


@pytest.mark.parametrize("tasks", [1, 3])
def test_sync_equals_one_process(samples, arrays, tasks):
    result = train_mlp(
        samples, A, mode="sync", epochs=2, batch_size=50, seed=5, steps=7, tasks=tasks
    )
    state, losses = by_hand(A, arrays, [0, 1, 2, 3, 4, 0, 1], 50)
    close(result.state, state)
    assert result.step == 7
    logged = result.metrics(samples.sparkSession).where("tag = 'loss'").orderBy("step").collect()
    assert [r.step for r in logged] == list(range(7))
    assert np.allclose([r.value for r in logged], losses)


def test_epoch_average_of_one_shard_equals_one_process(samples, arrays):
    result = train_mlp(samples, A, epochs=2, batch_size=50, seed=5)
    state, losses = by_hand(A, arrays, [0, 1, 2, 3, 4] * 2, 50)
    close(result.state, state)
    logged = result.metrics(samples.sparkSession).where("tag = 'loss'").orderBy("step").collect()
    assert np.allclose([r.value for r in logged], losses)


def test_epoch_average_over_shards(samples, arrays):
    result = train_mlp(samples, A, batch_size=50, seed=5, shards=2)
    even, _ = by_hand(A, arrays, [0, 2, 4], 50)
    odd, _ = by_hand(A, arrays, [1, 3], 50)
    close(result.state, {n: (even[n] * 130 + odd[n] * 100) / 230 for n in even})


def test_shards_follow_from_the_batches(samples, monkeypatch):
    monkeypatch.setattr("labelvec.plans.training.SHARD_BATCHES", 2)
    by_default = train_mlp(samples, A, batch_size=50, seed=5)
    close(by_default.state, train_mlp(samples, A, batch_size=50, seed=5, shards=3).state)
    # whatever the stored layout and the number of its tasks
    close(by_default.state, train_mlp(samples.repartition(1), A, batch_size=50, seed=5).state)


def test_start_weights_are_taken(samples):
    weights = initial_weights(A, 77)
    close(train_mlp(samples, A, steps=0, weights=weights).weights, weights)


def test_step_limit_in_epoch_mode(samples):
    result = train_mlp(samples, A, epochs=9, batch_size=50, steps=7, shards=3)
    assert result.step == 7
    metrics = result.metrics(samples.sparkSession)
    assert sorted(r.step for r in metrics.where("tag = 'acc'").collect()) == list(range(7))


@pytest.mark.parametrize("mode", ["sync", "epoch_avg"])
def test_resume_equals_an_uninterrupted_run(samples, tmp_path, mode):
    spark = samples.sparkSession
    options = dict(mode=mode, epochs=2, batch_size=50, seed=5, checkpoint_every=5, shards=2, tasks=2)
    whole = train_mlp(samples, B, keep_prob=0.8, model_dir=str(tmp_path / "w"), **options)
    parts = str(tmp_path / "p")
    train_mlp(samples, B, keep_prob=0.8, model_dir=parts, steps=5, **options)
    resumed = train_mlp(samples, B, keep_prob=0.8, model_dir=parts, resume=True, **options)
    close(resumed.state, whole.state)
    assert resumed.step == whole.step == 10
    rows = [
        sorted((r.step, r.tag, round(r.value, 9)) for r in x.metrics(spark).collect())
        for x in (whole, resumed)
    ]
    assert rows[0] == rows[1]


def test_dropout_repeats_and_scoring_has_none(samples):
    options = dict(batch_size=50, steps=3, seed=5, keep_prob=0.5)
    first, second = (train_mlp(samples, B, **options) for _ in range(2))
    close(first.state, second.state)
    assert evaluate(samples, B, first.weights) == evaluate(samples, B, first.weights)


def test_training_with_evaluation(spark, samples):
    result = train_mlp(
        samples, B, mode="sync", batch_size=50, steps=14, eval_samples=samples, eval_every=5, seed=5,
        histograms=True, keep_prob=0.9, image_shape=(2, 2),
    )
    log = result.metrics(spark)
    writers = {r.step: r.writer for r in log.where("tag = 'cross_entropy'").collect()}
    assert writers == {s: "test" if s % 5 == 0 else "train" for s in range(14)}
    keep = {r.step: r.value for r in log.where("tag = 'dropout_keep_probability'").collect()}
    assert keep == {s: 1.0 if s % 5 == 0 else 0.9 for s in range(14)}
    counts = {
        r.tag: r.n
        for r in result.histograms(spark).where("step = 13").groupBy("tag").agg(F.sum("n").alias("n")).collect()
    }
    assert counts["layer1/activations"] == 50 * 6 and counts["layer2/pre_activations"] == 50 * 3
    assert counts["layer1/weights/summaries/histogram"] == 24
    tested = result.histograms(spark).where("step = 10 AND writer = 'test'")
    tested = {r.tag: r.n for r in tested.groupBy("tag").agg(F.sum("n").alias("n")).collect()}
    assert tested["layer1/activations"] == ROWS * 6 and tested["layer2/activations"] == ROWS * 3
    assert tested["layer2/biases/summaries/histogram"] == 3
    images = sorted((r.step, r.image_no, r.sample_id) for r in result.images(spark).collect())
    python = [(s, b) for s, b in feed.schedule(0, 14, 5, 5) if b is not None]
    assert images == [(s, k, b * 50 + k) for s, b in python for k in range(3)]
    planned = feed.eval_schedule(spark, 14, 5).collect()
    python = list(feed.schedule(0, 14, 10**9, 5))
    assert [(r.step, r.batch_no) for r in planned] == python


@pytest.mark.parametrize("mode", ["sync", "epoch_avg"])
def test_reports_score_the_batch_of_a_step(samples, arrays, mode):
    result = train_mlp(samples, A, mode=mode, batch_size=50, steps=5, seed=5, report_every=2)
    rows = result.reports(samples.sparkSession).collect()
    assert sorted((r.step, r.sample_id) for r in rows) == [
        (s, i) for s in (0, 2, 4) for i in range(50 * s, min(50 * s + 50, ROWS))
    ]
    state, _ = by_hand(A, arrays, [0, 1, 2], 50)
    x, y = arrays
    want = layers(A, state, x[100:150])[2].argmax(axis=1)
    got = {r.sample_id: (r.label, r.prediction) for r in rows if r.step == 2}
    assert [got[i] for i in range(100, 150)] == list(zip(y[100:150].argmax(axis=1), want))


def test_both_modes_log_the_same_histograms(spark, samples):
    def logged(mode):
        result = train_mlp(samples, B, mode=mode, batch_size=50, steps=5, seed=5, histograms=True)
        return sorted(map(tuple, result.histograms(spark).collect()))

    assert logged("sync") == logged("epoch_avg")


def test_runs_of_one_folder_stay_apart(spark, samples, tmp_path):
    path = str(tmp_path / "m")
    options = dict(batch_size=50, model_dir=path, seed=5)
    train_mlp(samples, A, run_id="a", steps=5, **options)
    second = train_mlp(samples, A, run_id="b", steps=2, **options)
    step, state = checkpoints.load_state(spark, path, "b", tensors=8)
    assert step == 2
    close(state, second.state)
    assert checkpoints.load_state(spark, path, "a")[0] == 5
    assert sorted(r.step for r in second.metrics(spark).where("tag = 'loss'").collect()) == [0, 1]
    train_mlp(samples, A, run_id="a", steps=1, **options)  # replaces the run
    assert checkpoints.load_state(spark, path, "a")[0] == 1
    assert checkpoints.load_state(spark, path, "b")[0] == 2
    scores = jobs.score_saved(samples, A, path, run_id="b").collect()
    assert len(scores) == ROWS
    with pytest.raises(FileNotFoundError, match="no checkpoint of c"):
        jobs.score_saved(samples, A, path, run_id="c")


def test_kind_a_histograms_use_its_tags(spark, samples):
    result = train_mlp(samples, A, batch_size=100, steps=1, histograms=True)
    tags = {r.tag for r in result.histograms(spark).collect()}
    assert {"hidden_weights", "softmax_weights"} <= tags


def test_training_loss_falls(samples):
    result = train_mlp(
        samples, A, epochs=20, batch_size=20, shards=2, steps=10**6,
        optimizer=Adagrad(rate=0.1),
    )
    losses = [
        r.value
        for r in result.metrics(samples.sparkSession).where("tag = 'loss'").orderBy("step").collect()
    ]
    assert sum(losses[-12:]) < 0.6 * sum(losses[:12])


def test_ids_must_be_dense(samples):
    with pytest.raises(ValueError, match="number them"):
        count_dense(samples.where("sample_id <> 3"))
    # count, ends and sum as if dense
    even = samples.where("sample_id < 4").withColumn("sample_id", F.expr("if(sample_id IN (1, 2), if(sample_id = 1, 0, 3), sample_id)"))
    with pytest.raises(ValueError, match="number them"):
        count_dense(even)
    assert count_dense(samples.sparkSession.range(100_000).withColumnRenamed("id", "sample_id")) == 100_000
    twice = samples.withColumn("sample_id", F.expr("if(sample_id = 3, 4, sample_id)"))
    with pytest.raises(ValueError, match="number them"):
        count_dense(twice)
    with pytest.raises(ValueError, match="no samples"):
        count_dense(samples.where("sample_id < 0"))


def test_bad_arguments(samples):
    with pytest.raises(ValueError, match="unknown mode"):
        train_mlp(samples, A, mode="async")
    with pytest.raises(ValueError, match="needs mode='sync'"):
        train_mlp(samples, A, eval_samples=samples)
    with pytest.raises(PySparkException, match="expected 5"):
        train_mlp(samples, NetSpec(inputs=5, hidden=2, classes=3), steps=1)


def test_windows_of_the_feed(samples):
    order = feed.EpochOrder(samples, ["label"], ROWS, 0, reshuffle=False, laid_out=True)
    batches = feed.BatchFeed(order, 50, 5, tasks=2)
    batches.window = 2
    for index in (0, 1, 2, 3, 4, 0):
        ids = sorted(r.sample_id for r in batches.batch(index).collect())
        assert ids == list(range(index * 50, min(index * 50 + 50, ROWS)))
    batches.close()


def test_batches_epochs_and_steps(samples):
    rows = feed.epoch_expand(feed.minibatch_assign(samples, 100), 2)
    limited = feed.step_limit(feed.with_global_step(rows, 3), 5)
    ranged = feed.epochs_within(feed.minibatch_assign(samples, 100), 3, 2, 5)
    for steps in (limited, ranged):
        counts = {r.global_step: r["count"] for r in steps.groupBy("global_step").count().collect()}
        assert counts == {0: 100, 1: 100, 2: 30, 3: 100, 4: 100}


def test_first_images_are_a_filter(spark):
    rows = spark.range(ROWS).select(F.col("id").alias("sample_id"), F.array(*[F.col("id")] * 4).alias("image"))
    images = feed.image_samples(feed.minibatch_assign(rows, 100), 2, 2, 2)
    plan = images._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Exchange", "Window"))
    assert sorted((r.batch_id, r.image_no) for r in images.collect()) == [(b, k) for b in range(3) for k in range(2)]


def test_incomplete_checkpoints_are_passed_over(spark, tmp_path):
    path = str(tmp_path / "m")
    state = {"x": np.arange(6.0).reshape(2, 3), "y": np.zeros(1)}
    assert checkpoints.load_state(spark, path, "run") is None
    checkpoints.save_state(spark, path, state, 4, "run")
    checkpoints.save_state(spark, path, {"x": state["x"]}, 9, "run")
    step, saved = checkpoints.load_state(spark, path, "run", tensors=2)
    assert step == 4
    close(saved, state)
    assert checkpoints.latest_step(checkpoints.read_weights(spark, path)) == 9


def test_saving_a_step_twice_replaces_it(spark, tmp_path):
    path = str(tmp_path / "m")
    for value in (1.0, 2.0):
        checkpoints.save_state(spark, path, {"x": np.array([value])}, 3, "run")
    checkpoints.save_state(spark, path, {"x": np.array([0.0])}, 2, "run")
    rows = checkpoints.read_weights(spark, path).orderBy("step").collect()
    assert [(r.step, r.data) for r in rows] == [(2, [0.0]), (3, [2.0])]


def test_tensor_summary_uses_population_deviation(spark):
    frame = checkpoints.weights_frame(spark, {"t": np.array([1.0, 2.0, 3.0, 6.0])}, 1)
    row = M.tensor_summary(M.tensor_values(frame)).first()
    assert (row["mean"], row["max"], row["min"]) == (3.0, 6.0, 1.0)
    assert row["stddev"] == pytest.approx(np.std([1, 2, 3, 6]))


def test_apply_batches_with_a_size(spark):
    def count(batch):
        return pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    sizes = apply_batches(spark.range(0, 25, 1, 1), count, "n bigint", batch_size=10)
    assert [r.n for r in sizes.collect()] == [10, 10, 5]
    empty = apply_batches(spark.range(0, 0, 1, 4), count, "n bigint", batch_size=10)
    assert empty.collect() == []


@pytest.mark.parametrize("fmt", ["csv", "tfr"])
def test_whole_job(spark, tmp_path, fmt):
    rows = [(i, [(i * 7 + p) % 256 for p in range(4)], i % 3) for i in range(60)]
    frame = spark.createDataFrame(rows, "sample_id long, image array<int>, label int")
    raw = {}
    for split, part in (("train", frame), ("test", frame.where("sample_id < 20"))):
        write_idx_files(part, str(tmp_path / split), 2, 2, 25)
        raw[split] = (str(tmp_path / split / "images"), str(tmp_path / split / "labels"))
    spec = NetSpec(inputs=4, hidden=5, classes=10)
    out = str(tmp_path / "out")
    result = jobs.run_job(spark, raw, out, spec, fmt, partitions=2, batch_size=20)
    assert tuple(result.verified["train"]) == (60, 60, 4, 4, 0)
    assert tuple(result.verified["test"]) == (20, 20, 4, 4, 0)
    assert [r.sample_id for r in result.head["train"]] == list(range(10)) and result.training.step == 3
    assert result.predictions.count() == 20
    assert sources.read_prediction_lines(spark, f"{out}/prediction_lines").count() == 20
    labels = sorted(r.label for r in result.predictions.collect())
    assert labels == sorted(i % 3 for i in range(20))
    again = jobs.score_saved(jobs.load(spark, f"{out}/test", fmt), spec, f"{out}/model")
    stored = spark.read.parquet(f"{out}/predictions")
    pairs = [sorted((r.label, r.prediction) for r in f.collect()) for f in (again, stored)]
    assert pairs[0] == pairs[1]


def test_learns_on_the_given_vectors(spark):
    import pathlib

    table = pathlib.Path("/root/testdata/sf0.1/embeddings.parquet")
    if not table.exists():
        pytest.skip("no test data")
    from labelvec.operators.positions import with_dense_id
    from labelvec.plans.network import spec_a
    from labelvec.plans.scoring import predict

    vectors = spark.read.parquet(str(table)).select(
        "vec_id",
        F.col("embedding").alias("image"),
        V.one_hot(V.argmax(F.slice("embedding", 1, 10))).alias("label"),
    )
    train, test = (
        with_dense_id(vectors.where(rule), ["vec_id"]) for rule in ("vec_id % 5 <> 0", "vec_id % 5 = 0")
    )
    spec = spec_a(inputs=64, divisor=1.0)
    result = train_mlp(
        train, spec, epochs=50, steps=10**6, seed=42, shards=4,
        checkpoint_every=400,
    )
    assert M.accuracy(predict(test, spec, result.weights)).first().accuracy > 0.5


def test_no_shard_holds_more_rows_than_its_bound(samples, arrays, monkeypatch):
    monkeypatch.setattr(training, "SHARD_ROWS", 100)
    with pytest.raises(ValueError, match="sync"):
        train_mlp(samples, A, batch_size=ROWS, steps=1, seed=5)
    with pytest.raises(ValueError, match="shards"):
        train_mlp(samples, A, batch_size=50, seed=5, shards=1)
    # batches of 40 go two by two, so the averages are those of three shards
    bounded = train_mlp(samples, A, batch_size=40, seed=5)
    close(bounded.state, train_mlp(samples, A, batch_size=40, seed=5, shards=3).state)
    whole = train_mlp(samples, A, mode="sync", batch_size=ROWS, steps=1, seed=5)
    close(whole.state, by_hand(A, arrays, [0], ROWS)[0])


@pytest.mark.parametrize("name", ["train_histograms", "ingest_train_score"])
def test_queries_that_train_on_a_whole_table_spread_it(spark, monkeypatch, name):
    entry = pytest.importorskip("__spark_entry__")
    whole = []

    def no_shards(*args):
        raise AssertionError("the whole table is one shard")

    def spread(run):
        def seen(job, feed, *args):
            whole.append((feed.tasks, feed.batch_size))
            return run(job, feed, *args)

        return seen

    monkeypatch.setattr(feed, "ROWS_PER_TASK", 50)
    monkeypatch.setattr(training, "_train_rounds", no_shards)
    for path in ("_run_batch", "_run_job"):  # a job for each step, and one for many
        monkeypatch.setattr(training, path, spread(getattr(training, path)))
    assert entry.queries()[name](spark, "/root/testdata/sf0.001").count()
    assert whole and all(tasks >= rows / 50 > 1 for tasks, rows in whole)
