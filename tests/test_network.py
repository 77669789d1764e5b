import math

import numpy as np
import pyarrow as pa
import pytest

from labelvec.operators.batches import list_column, matrix, rebatch
from labelvec.plans.network import (
    NetSpec,
    batch_sums,
    bucket_counts,
    dropout_factors,
    gradient,
    initial_weights,
    layers,
    row_losses,
    softmax,
    spec_a,
    spec_b,
)
from labelvec.plans.optimizers import Adagrad, Adam


def data(spec, rows=12, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(rows, spec.inputs))
    y = np.eye(spec.classes)[rng.integers(0, spec.classes, rows)]
    return x, y


def loss_of(spec, weights, x, y, factors):
    losses = row_losses(spec, layers(spec, weights, x, factors)[2], y)
    return losses.sum() if spec.kind == "a" else losses.mean()


@pytest.mark.parametrize("kind, dropped", [("a", False), ("b", False), ("b", True)])
def test_gradient_by_finite_differences(kind, dropped):
    spec = NetSpec(kind=kind, inputs=5, hidden=7, classes=4, divisor=1.0)
    weights = {n: w + 0.3 for n, w in initial_weights(spec, 1).items()}
    x, y = data(spec)
    factors = dropout_factors(np.arange(len(x)), 7, 2, 9, 0.6) if dropped else None
    grads = gradient(spec, batch_sums(spec, weights, x, y, factors))
    for name, w in weights.items():
        for index in np.ndindex(*w.shape):
            moved = {n: v.copy() for n, v in weights.items()}
            moved[name][index] += 1e-6
            up = loss_of(spec, moved, x, y, factors)
            moved[name][index] -= 2e-6
            down = loss_of(spec, moved, x, y, factors)
            assert grads[name][index] == pytest.approx((up - down) / 2e-6, abs=1e-5)


def test_clipped_probability_passes_no_gradient():
    spec = NetSpec(kind="a", inputs=1, hidden=1, classes=2, divisor=1.0)
    w1, b1, w2, b2 = spec.names
    weights = {w1: np.ones((1, 1)), b1: np.zeros(1), w2: np.array([[-30.0, 30.0]]), b2: np.zeros(2)}
    x, y = np.ones((1, 1)), np.array([[1.0, 0.0]])
    assert softmax(layers(spec, weights, x)[2])[0, 0] < 1e-10
    sums = batch_sums(spec, weights, x, y)
    assert all((sums[n] == 0).all() for n in spec.names)
    assert sums["loss"][0] == pytest.approx(-math.log(1e-10))


def test_initial_weights():
    a = initial_weights(spec_a(), 4)
    assert {n: w.shape for n, w in a.items()} == {
        "hid_w": (784, 128), "hid_b": (128,), "sm_w": (128, 10), "sm_b": (10,)
    }
    # A normal cut at two deviations keeps 0.8796 of its deviation.
    assert a["hid_w"].std() == pytest.approx(0.8796 / 28, rel=0.02)
    assert abs(a["hid_w"]).max() <= 2 / 28
    assert a["sm_w"].std() == pytest.approx(0.8796 / math.sqrt(128), rel=0.05)
    assert not a["hid_b"].any() and not a["sm_b"].any()
    b = initial_weights(spec_b(), 4)
    assert b["layer1/weights"].shape == (784, 500)
    assert b["layer1/weights"].std() == pytest.approx(0.08796, rel=0.02)
    assert (b["layer1/biases"] == 0.1).all() and (b["layer2/biases"] == 0.1).all()
    again = initial_weights(spec_b(), 4)
    assert all(np.array_equal(b[n], again[n]) for n in b)


def test_model_size_is_checked():
    with pytest.raises(ValueError, match="bytes of weights exceed"):
        spec_a(inputs=1 << 20, hidden=1 << 10)


def test_adagrad_and_adam_by_hand():
    spec = NetSpec(kind="a", inputs=1, hidden=1, classes=1)
    weights = {n: np.ones(s) for n, s in spec.shapes.items()}
    grads = {n: np.full(s, 2.0) for n, s in spec.shapes.items()}
    state = {**weights, **Adagrad().slots(weights)}
    for _ in range(2):
        state = Adagrad().update(spec, state, grads)
    assert state["hid_b/Adagrad"][0] == pytest.approx(8.1)
    assert state["hid_b"][0] == pytest.approx(1 - 0.02 / math.sqrt(4.1) - 0.02 / math.sqrt(8.1))
    state = {**weights, **Adam().slots(weights)}
    for _ in range(2):
        state = Adam().update(spec, state, grads)
    # With a constant gradient every bias-corrected Adam step has the length of the rate.
    assert state["hid_b"][0] == pytest.approx(1 - 0.002, abs=1e-9)
    assert state["Adam/updates"][0] == 2


def test_bucket_counts_keep_every_value():
    values = np.array([-1e9, -40.0, -0.5, -0.1, 0.0, 0.49, 0.5, 33.0, 100.0, 5000.0])
    counts = dict(bucket_counts(values).tolist())
    assert counts == {-2 * 10**9: 1, -80: 1, -1: 2, 0: 2, 1: 1, 66: 1, 200: 1, 10_000: 1}
    assert bucket_counts(values[:0]).tolist() == []


def test_matrix_checks_lengths():
    assert matrix(pa.array([[1, 2], [3, 4]]).slice(1)).tolist() == [[3, 4]]
    with pytest.raises(ValueError, match="expected 3"):
        matrix(pa.array([[1, 2], [3, 4]]), 3)
    with pytest.raises(ValueError, match="null"):
        matrix(pa.array([[1, None]]))
    block = np.arange(6.0).reshape(3, 2)
    assert matrix(list_column(block)).tolist() == block.tolist()
    assert len(list_column(block[:0])) == 0


def test_rebatch_sizes():
    parts = [pa.RecordBatch.from_pydict({"v": list(range(n))}) for n in (3, 0, 5, 1, 4)]
    sized = list(rebatch(iter(parts), 4))
    assert [b.num_rows for b in sized] == [4, 4, 4, 1]
    assert sum((b.column("v").to_pylist() for b in sized), []) == sum((p.column("v").to_pylist() for p in parts), [])
