"""Checksums of long records, digests of data sets, and weights by formula."""

import statistics
import time

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from labelvec.functions import draws
from labelvec.operators.verify import WrittenDigest, digest
from labelvec.plans import jobs
from labelvec.plans.network import NetSpec, initial_values, initial_weights, spec_a
from labelvec.sources import read_tfrecord, records, write_tfrecord

TABLE = records._crc_list()


def byte_by_byte(data):
    crc = 0xFFFFFFFF
    for byte in data:
        crc = TABLE[(crc ^ byte) & 0xFF] ^ (crc >> 8)
    return crc ^ 0xFFFFFFFF


# ---------------------------------------------------------------- checksums


def test_known_checksums():
    known = {b"": 0, b"123456789": 0xE3069283, bytes(32): 0x8A9136AA, b"\xff" * 32: 0x62A8AB43, bytes(range(32)): 0x46DD794E}
    assert records.crc32c(list(known)).tolist() == list(known.values())
    assert len(records.crc32c([])) == 0


@pytest.mark.parametrize("seed", range(3))
def test_strips_equal_the_byte_loop(seed):
    rng = np.random.default_rng(seed)
    s = records.STRIP_BYTES
    lengths = [1, s - 1, s, s + 1, 2 * s - 1, 2 * s, 2 * s + 1, 4 * s, 37 * s + 5, *rng.integers(0, 5000, 40)]
    buffers = [rng.integers(0, 256, n, dtype=np.uint8).tobytes() for n in rng.permutation(lengths)]
    assert records.crc32c(buffers).tolist() == [byte_by_byte(b) for b in buffers]


def test_long_buffers_take_as_many_steps_as_short_ones(monkeypatch):
    rng = np.random.default_rng(2)
    data = rng.integers(0, 256, 64 << 20, dtype=np.uint8).tobytes()
    start = time.perf_counter()
    whole = int(records.crc32c([data])[0])
    assert time.perf_counter() - start < 30
    # a checksum of a buffer and its own checksum, in little-endian order, is a fixed value
    assert records.crc32c([data + whole.to_bytes(4, "little")])[0] == 0x48674BC7
    assert records.crc32c([data[: 1 << 20]])[0] == byte_by_byte(data[: 1 << 20])


def test_a_long_record_is_written_and_read(spark, tmp_path):
    path = str(tmp_path / "long")
    rows = [(0, [7] * 400_000 + [255], [1.0, 0.0]), (1, [1, 2, 3], [0.0, 1.0])]
    write_tfrecord(spark.createDataFrame(rows, "sample_id long, image array<int>, label array<double>"), path, 1)
    got = sorted((len(r.image), r.image[-1]) for r in read_tfrecord(spark, path).collect())
    assert got == [(3, 3), (400_001, 255)]
    file = next((tmp_path / "long").glob("*.tfrecord"))
    data = bytearray(file.read_bytes())
    data[300_000] ^= 1
    file.write_bytes(bytes(data))
    with pytest.raises(PySparkException, match="bad checksum"):
        read_tfrecord(spark, path).collect()


# ---------------------------------------------------------------- digests


def of(rows, with_ids=False):
    return rows.agg(digest(with_ids)).first()[0]


def test_a_digest_does_not_depend_on_the_layout(small):
    assert of(small) == of(small.repartition(7)) == of(small.orderBy(F.desc("sample_id")))
    assert of(small, True) == of(small.repartition(3), True) != of(small)
    assert of(small.limit(0)) == "0:0"


@pytest.mark.parametrize(
    "change",
    [
        "if(sample_id = 3, 4, if(sample_id = 4, 3, sample_id))",  # two labels change places
        "if(sample_id = 3, 4, sample_id)",
    ],
)
def test_labels_that_change_places_are_seen(small, change):
    moved = small.select(F.expr(change).alias("sample_id"), "label")
    other = small.drop("label").join(moved.dropDuplicates(["sample_id"]), "sample_id")
    assert of(other) != of(small) and of(other.drop("sample_id")) == of(other)


def test_lost_and_repeated_rows_are_seen(small):
    kinds = [of(small), of(small.where("sample_id <> 9")), of(small.union(small.limit(1))), of(small.where("sample_id = 1").union(small))]
    assert len(set(kinds)) == 4


@pytest.mark.parametrize("fmt", ["csv", "csv2", "tfr", "parquet"])
def test_stored_data_sets_have_the_digest_of_what_was_written(spark, small, tmp_path, fmt):
    found = jobs.store_verified(small, str(tmp_path / fmt), fmt, partitions=3)
    assert found == of(small, fmt == "parquet")


def test_changed_files_are_an_error(spark, small, tmp_path, monkeypatch):
    def swapped(samples, path, fmt, partitions, store=jobs.store):
        # lines of equal length: counts and sizes stay as they are
        store(samples, path, fmt, partitions)
        file = next(f for f in (tmp_path / "csv" / "labels").glob("part-*") if len(f.read_text().splitlines()) > 1)
        lines = file.read_text().splitlines()
        i = next(i for i in range(1, len(lines)) if lines[i] != lines[0])
        lines[0], lines[i] = lines[i], lines[0]
        file.write_text("\n".join(lines) + "\n")
        for crc in (tmp_path / "csv" / "labels").glob(".*.crc"):
            crc.unlink()

    monkeypatch.setattr(jobs, "store", swapped)
    with pytest.raises(ValueError, match="does not hold what was written"):
        jobs.store_verified(small, str(tmp_path / "csv"), "csv", partitions=2)
    verified = jobs.verify(spark, str(tmp_path / "csv"), "csv").first()
    assert verified["incomplete"] == 0 and verified["num_images"] == 50


def test_a_pass_that_ran_twice_is_decided_by_the_source(small):
    written = WrittenDigest(small)
    small.sparkSession.createDataFrame(written.samples.union(written.samples).collect(), small.schema).count()
    assert written.equals(of(small)) and not written.equals("1:2")


# ---------------------------------------------------------------- weights by formula


def test_executors_draw_the_same_weights(spark):
    for spec in (NetSpec(kind="a", inputs=9, hidden=7, classes=3), NetSpec(kind="b", inputs=9, hidden=7, classes=3)):
        want = initial_weights(spec, 4)
        rows = initial_values(spark, spec, 4).collect()
        got = {n: np.zeros(w.size) for n, w in want.items()}
        for r in rows:
            got[r.tensor][r.i] = r.value
        assert len(rows) == sum(w.size for w in want.values())
        for name, values in want.items():
            assert np.allclose(got[name], values.ravel(), rtol=1e-12, atol=1e-15)


def test_draws_follow_a_normal_cut_at_two_deviations():
    normal = statistics.NormalDist()
    cells = np.arange(200_000)
    p = (draws._drawn(cells, 1, 3) + 0.5) / draws.PRIME * (1 - 2 * draws.TAIL) + draws.TAIL
    values = draws.truncated_normals(cells, 1, 3, 1.0)
    for i in range(0, 200_000, 997):
        assert values[i] == pytest.approx(normal.inv_cdf(p[i]), rel=1e-12, abs=1e-13)
    assert abs(values).max() <= 2.0 and len(np.unique(values)) == len(cells)
    assert abs(values.mean()) < 0.01 and values.std() == pytest.approx(0.8796, abs=0.005)
    assert abs(np.corrcoef(values[:-1], values[1:])[0, 1]) < 0.01
    assert normal.cdf(-2.0) == pytest.approx(draws.TAIL, rel=1e-14)


def test_seeds_and_tensors_differ():
    spec = spec_a(inputs=16, hidden=16, classes=16)
    one, two = initial_weights(spec, 1), initial_weights(spec, 2)
    assert not np.allclose(one["hid_w"], two["hid_w"]) and not np.allclose(one["hid_w"], one["sm_w"])
    assert (one["hid_b"] == 0).all() and abs(one["hid_w"]).max() <= 2 / 4
