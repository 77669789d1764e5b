import gzip
import struct

import numpy as np
import pyarrow as pa
import pytest
from helpers import content
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from labelvec import sources
from labelvec.operators import pairing, positions, verify
from labelvec.plans import jobs
from labelvec.sources import example, records
from labelvec.testing import write_idx_files


@pytest.fixture
def tiny_splits(spark):
    """Text splits of 64 bytes, so that every file is cut many times."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("partitions", [1, 3, 10])
@pytest.mark.parametrize("fmt", jobs.FORMATS)
def test_round_trip(spark, small, tmp_path, fmt, partitions):
    path = str(tmp_path / "out")
    jobs.store(small, path, fmt, partitions)
    back = jobs.load(spark, path, fmt, trusted=True)
    assert content(back) == content(small)
    assert sorted(r.sample_id for r in back.select("sample_id").collect()) == list(range(50))


def test_more_partitions_than_rows(spark, small, tmp_path):
    path = str(tmp_path / "out")
    sources.write_csv_pair(small.limit(4), path, 16)
    assert sources.read_csv_pair(spark, f"{path}/images", f"{path}/labels").count() == 4


def test_writing_again_replaces(spark, small, tmp_path):
    for fmt in ("csv", "csv2", "tfr", "parquet", "pickle"):
        path = str(tmp_path / fmt)
        jobs.store(small, path, fmt, 5)
        jobs.store(small.where("sample_id < 20"), path, fmt, 2)
        assert jobs.load(spark, path, fmt, trusted=True).count() == 20


def test_pairing_with_forced_splits(spark, small, tmp_path, tiny_splits):
    path = str(tmp_path / "out")
    sources.write_csv_pair(small, path, 3)
    lines = spark.read.text(f"{path}/images")
    assert lines.rdd.getNumPartitions() > 10
    back = sources.read_csv_pair(spark, f"{path}/images", f"{path}/labels")
    assert content(back) == content(small)


def test_pairing_follows_line_order(spark, tmp_path, tiny_splits):
    for side, width in (("images", 9), ("labels", 1)):
        (tmp_path / side).mkdir()
        for part in range(3):
            lines = [",".join([str(100 * part + i)] * width) for i in range(40 + part)]
            (tmp_path / side / f"part-{part}.txt").write_text("\n".join(lines) + "\n")
    pairs = sources.read_csv_pair(spark, str(tmp_path / "images"), str(tmp_path / "labels"))
    rows = sorted(pairs.collect())
    assert [r.sample_id for r in rows] == list(range(123))
    assert all(r.image == [int(r.label[0])] * 9 for r in rows)
    assert [r.image[0] for r in rows][39:42] == [39, 100, 101]


def test_one_file_with_a_third_of_the_rows(spark, tmp_path, tiny_splits):
    for side in ("images", "labels"):
        (tmp_path / side).mkdir()
        for part, n in enumerate([100, 10, 190]):
            (tmp_path / side / f"part-{part}.txt").write_text(
                "".join(f"{part * 5000 + i}\n" for i in range(n))
            )
    pairs = sources.read_csv_pair(spark, str(tmp_path / "images"), str(tmp_path / "labels"))
    assert pairs.where("image[0] <> label[0]").count() == 0
    assert pairs.count() == 300


def test_unequal_pair_counts(spark, tmp_path):
    for side, n in (("images", 5), ("labels", 3)):
        (tmp_path / side).mkdir()
        (tmp_path / side / "part-0").write_text("".join(f"{i}\n" for i in range(n)))
    with pytest.raises(ValueError, match="file 0: 5 and 3 rows"):
        sources.read_csv_pair(spark, str(tmp_path / "images"), str(tmp_path / "labels"))
    left, right = (
        positions.staged_lines(spark, str(tmp_path / s), F.col("value")) for s in ("images", "labels")
    )
    strays = pairing.unmatched_positions(left, right).collect()
    assert sorted(tuple(r) for r in strays) == [(0, 3, "left"), (0, 4, "left")]
    counts = verify.verify_pair(left, right).first()
    assert tuple(counts) == (5, 3, 2)


def test_unmatched_ids(spark):
    left, right = spark.range(0, 5).toDF("sample_id"), spark.range(2, 6).toDF("sample_id")
    rows = sorted(tuple(r) for r in pairing.unmatched_ids(left, right).collect())
    assert rows == [(0, "left"), (1, "left"), (5, "right")]


def test_dense_ids_follow_the_order(spark):
    df = spark.range(0, 1000, 1, 7).select((F.col("id") * 37 % 1000 * 3).alias("key"))
    rows = positions.with_dense_id(df, ["key"]).collect()
    assert sorted((r.sample_id, r.key) for r in rows) == [(i, 3 * i) for i in range(1000)]
    shared = df.select("key", (F.col("key") % 2).alias("even"))
    rows = positions.with_dense_id(shared, ["even"]).orderBy("sample_id").collect()
    assert [r.even for r in rows] == [0] * 500 + [1] * 500
    assert [r.sample_id for r in rows] == list(range(1000))
    unordered = positions.with_dense_id(df).collect()
    assert sorted(r.sample_id for r in unordered) == list(range(1000))


def test_larger_offset_tables_join_by_shuffle(spark, small, tmp_path, monkeypatch):
    monkeypatch.setattr("labelvec.operators.positions.broadcast_if_small", lambda df: df)
    path = str(tmp_path / "out")
    sources.write_csv_pair(small, path, 3)
    back = sources.read_csv_pair(spark, f"{path}/images", f"{path}/labels")
    assert content(back) == content(small)


def test_verify(spark, small, tmp_path):
    path = str(tmp_path / "out")
    jobs.store(small, path, "parquet", 3)
    summary = jobs.verify(spark, path, "parquet")
    assert tuple(summary.first()) == (50, 50, 6, 6, 0)
    assert [r.sample_id for r in verify.sample_head(small).collect()] == list(range(10))
    jobs.store(small, path + "-lines", "csv", 3)
    assert tuple(jobs.verify(spark, path + "-lines", "csv").first()) == (50, 50, 6, 6, 0)
    sources.write_csv_pair(small.where("sample_id < 40"), path + "-less", 3)
    uneven = verify.verify_text_pair(spark, f"{path}-lines/images", f"{path}-less/labels").first()
    assert (uneven.num_images, uneven.num_labels, uneven.incomplete) == (50, 40, 10)


def test_combined_lines_need_one_hot_labels(spark, small, tmp_path):
    wrong = small.withColumn("label", F.transform("label", lambda v: v * 0.5))
    with pytest.raises(PySparkException, match="not a one-hot label"):
        jobs.store(wrong, str(tmp_path / "out"), "csv2")


def test_larger_tables_get_more_tasks(spark, tmp_path):
    rows = spark.range(200_000).select(
        F.col("id").alias("sample_id"),
        F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: (F.xxhash64("id", k) % 256).cast("int")).alias("image"),
        F.array(F.lit(1.0), F.lit(0.0)).alias("label"),
    )
    conf = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(conf, "1m")
    try:
        files = {}
        for n in (1000, 200_000):
            path = str(tmp_path / str(n))
            sources.write_samples(rows.where(f"sample_id < {n}"), path)
            sources.write_combined(rows.where(f"sample_id < {n}").withColumn("label", F.lit(0)), path + "-lines")
            files[n] = [len(spark.read.format(f).load(p).inputFiles()) for f, p in (("parquet", path), ("text", path + "-lines"))]
        assert all(few < many for few, many in zip(files[1000], files[200_000]))
    finally:
        spark.conf.unset(conf)


def test_one_raw_file_per_task(spark, tmp_path):
    frame = spark.createDataFrame([(i, [i % 7] * 4, i % 3) for i in range(64)], "sample_id long, image array<int>, label int")
    write_idx_files(frame, str(tmp_path), 2, 2, 2)
    pairs = sources.read_idx_pair(spark, f"{tmp_path}/images", f"{tmp_path}/labels")
    tasks = pairs.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sorted(r["count"] for r in tasks) == [2] * 32


def test_schemes_of_stores():
    from labelvec.sources.files import filesystem_of

    assert filesystem_of("file:/tmp/x")[1] == "/tmp/x"
    with pytest.raises(ValueError, match="expected a qualified path"):
        filesystem_of("/tmp/x")
    with pytest.raises(ValueError, match="expected a qualified path"):
        filesystem_of("ftp://host/x")


def test_partition_counts(spark, small):
    counts = verify.partition_counts(small, 4).collect()
    assert len(counts) == 4 and sum(r.n_rows for r in counts) == 50


def test_pickle_needs_trust(spark, small, tmp_path):
    path = str(tmp_path / "out")
    jobs.store(small, path, "pickle", 2)
    with pytest.raises(PermissionError):
        jobs.load(spark, path, "pickle")


def test_unknown_format(spark, small, tmp_path):
    with pytest.raises(ValueError, match="unknown format"):
        jobs.store(small, str(tmp_path), "xml")


def test_prediction_lines(spark, tmp_path):
    df = spark.createDataFrame([(1, 3, 4), (2, 5, 5)], "sample_id long, label int, prediction int")
    path = str(tmp_path / "lines")
    sources.write_predictions(df, path)
    back = sources.read_prediction_lines(spark, path).collect()
    assert sorted(tuple(r) for r in back) == [(3, 4), (5, 5)]


# ---------------------------------------------------------------- raw files


@pytest.mark.parametrize("rows_per_file", [7, 50, 1000])
def test_idx_round_trip(spark, small, tmp_path, rows_per_file):
    classes = small.withColumn("label", F.array_position("label", F.lit(1.0)) - 1)
    write_idx_files(classes, str(tmp_path), 2, 3, rows_per_file)
    pairs = sources.read_idx_pair(spark, f"{tmp_path}/images", f"{tmp_path}/labels")
    assert sorted((r.sample_id, r.image, r.label) for r in pairs.collect()) == sorted(
        (r.sample_id, r.image, r.label) for r in small.collect()
    )
    images = sources.read_idx_images(spark, f"{tmp_path}/images").drop("file")
    labels = sources.read_idx_labels(spark, f"{tmp_path}/labels").drop("file")
    assert content(images.join(labels, "sample_id")) == content(small)
    scalar = sources.read_idx_labels(spark, f"{tmp_path}/labels", classes=None)
    assert [r.label for r in scalar.orderBy("sample_id").collect()] == [i % 10 for i in range(50)]


def test_idx_batches_are_bounded(spark, small, tmp_path, monkeypatch):
    from labelvec.sources import idx

    classes = small.withColumn("label", F.lit(1))
    write_idx_files(classes, str(tmp_path), 2, 3)
    monkeypatch.setattr(idx, "BATCH_BYTES", 100)
    whole = {"path": f"file:{tmp_path}/images/00000000.gz", "start": None, "low": 0, "high": 50, "width": 6}
    blocks = list(idx._items(whole, idx.IMAGE_MAGIC))
    assert [len(b) for b in blocks] == [4] * 12 + [2]
    assert np.concatenate(blocks).tolist() == [r.image for r in small.orderBy("sample_id").collect()]


def _gz(path, data):
    path.parent.mkdir(exist_ok=True)
    path.write_bytes(gzip.compress(data))


def test_idx_errors(spark, tmp_path):
    images, labels = tmp_path / "i" / "a.gz", tmp_path / "l" / "a.gz"
    _gz(images, struct.pack(">4I", 2051, 2, 1, 2) + bytes(4))
    _gz(labels, struct.pack(">2I", 2049, 2) + bytes(2))
    assert sources.read_idx_pair(spark, str(images.parent), str(labels.parent)).count() == 2
    with pytest.raises(PySparkException, match="magic number 2049, expected 2051"):
        sources.read_idx_images(spark, str(labels.parent)).count()
    _gz(images, struct.pack(">4I", 2051, 2, 1, 2) + bytes(3))
    with pytest.raises(PySparkException, match="truncated"):
        sources.read_idx_images(spark, str(images.parent)).count()
    _gz(images, struct.pack(">4I", 2051, 3, 1, 2) + bytes(6))
    with pytest.raises(ValueError, match="do not line up"):
        sources.read_idx_pair(spark, str(images.parent), str(labels.parent))


# ---------------------------------------------------------------- framed records


def test_crc32c_known_values():
    # Published check values of CRC-32C.
    cases = {b"123456789": 0xE3069283, bytes(32): 0x8A9136AA, b"\xff" * 32: 0x62A8AB43, b"": 0}
    assert records.crc32c(list(cases)).tolist() == list(cases.values())


def test_split_records_equal_whole_files(spark, small, tmp_path):
    path = str(tmp_path / "r")
    sources.write_tfrecord(small, path, 2)
    whole = sources.read_tfrecord(spark, path)
    split = sources.read_tfrecord(spark, path, split_bytes=100)
    assert split.rdd.getNumPartitions() > 10
    assert content(split) == content(whole) == content(small)


@pytest.mark.parametrize("packed", [True, False])
def test_example_ints(packed):
    rows = [[0, 1, 127, 128, 255, 16383, 16384], [], [-1, 2**62, -(2**63), 2**63 - 1], [7] * 300]
    batch = pa.RecordBatch.from_pydict({"v": pa.array(rows, pa.list_(pa.int64()))})
    payloads = example.encode(batch.slice(1)) + example.encode(batch.slice(0, 1))
    if not packed:
        # Field 1 of a list as single varints (tag 8), wrapped again by hand.
        def wrap(tag, body):
            return bytes([tag]) + varint(len(body)) + body

        def varint(n):
            n %= 1 << 64
            out = b""
            while n > 127:
                out, n = out + bytes([n & 127 | 128]), n >> 7
            return out + bytes([n])

        payloads = [
            wrap(10, wrap(10, wrap(10, b"v") + wrap(18, wrap(26, b"".join(b"\x08" + varint(n) for n in r)))))
            for r in rows[1:] + rows[:1]
        ]
    got = example.decode(payloads, ["v", "w"])
    assert got.column("v").to_pylist() == rows[1:] + rows[:1]
    assert got.column("w").to_pylist() == [[]] * 4


@pytest.mark.parametrize("split_bytes", [1, 37, 1000, 10**6])
def test_every_boundary_is_found(spark, small, tmp_path, split_bytes):
    path = tmp_path / "r"
    sources.write_tfrecord(small, str(path), 1)
    (file,) = path.glob("part-*")
    data = file.read_bytes()
    true = [0]
    while true[-1] < len(data):
        true.append(true[-1] + 16 + struct.unpack_from("<Q", data, true[-1])[0])
    for start in range(0, len(data), split_bytes):
        want = next(t for t in true if t >= start)
        assert records.first_boundary(f"file:{file}", start, len(data)) == want


def test_record_file_inside_a_record_is_never_misread(spark, tmp_path):
    inner = records.frame([b"a" * 50] * 5)
    file = tmp_path / "nested.tfrecord"
    file.write_bytes(records.frame([b"first", inner, b"last"]))
    size = file.stat().st_size
    whole = sum(records.record_groups(f"file:{file}", 0, size), [])
    assert whole == [b"first", inner, b"last"]
    cut = records.first_boundary(f"file:{file}", 40, size)
    with pytest.raises(ValueError, match="in one piece"):
        list(records.record_groups(f"file:{file}", 0, cut))


def test_absent_feature_is_empty(spark, small, tmp_path):
    path = str(tmp_path / "r")
    sources.write_tfrecord(small, path, 1)
    rows = sources.read_tfrecord(spark, path, names=("image", "weight"))
    assert rows.where(F.size("weight") != 0).count() == 0


@pytest.mark.parametrize(
    "damage, message",
    [
        (lambda b: b[:-3], "truncated"),
        (lambda b: b[:3] + b"\x7f" + b[4:], "checksum of a record length"),
        (lambda b: b[:20] + bytes([b[20] ^ 1]) + b[21:], "checksum of a record"),
    ],
)
def test_damaged_records(spark, small, tmp_path, damage, message):
    path = tmp_path / "r"
    sources.write_tfrecord(small, str(path), 1)
    (file,) = path.glob("part-*")
    file.write_bytes(damage(file.read_bytes()))
    with pytest.raises(PySparkException, match=message):
        sources.read_tfrecord(spark, str(path)).collect()


def test_failed_write_keeps_the_old_records(spark, small, tmp_path):
    path = str(tmp_path / "r")
    sources.write_tfrecord(small, path, 2)
    with pytest.raises(PySparkException):
        sources.write_tfrecord(small.withColumn("image", F.array(F.raise_error(F.lit("boom")))), path, 2)
    assert content(sources.read_tfrecord(spark, path)) == content(small)


# ---------------------------------------------------------------- plans


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_split_and_chunk_prune_directories(spark, small, tmp_path):
    from labelvec.streaming.feed import feed_range

    path = str(tmp_path / "s")
    sources.write_samples(small.withColumn("split", F.lit("train")), path)
    rows = feed_range(sources.read_samples(spark, path, "train"), 10, 20).select("sample_id")
    text = plan(rows)
    assert rows.count() == 10
    assert "split" in text.split("PartitionFilters: ")[1].split("PushedFilters")[0]
    assert "chunk" in text.split("PartitionFilters: ")[1].split("PushedFilters")[0]
    assert "GreaterThanOrEqual(sample_id,10)" in text
    assert "ReadSchema: struct<sample_id:bigint>" in text


def test_scoring_is_one_narrow_stage(spark, small):
    from labelvec.plans.network import initial_weights, spec_a
    from labelvec.plans.scoring import predict

    spec = spec_a(inputs=6, hidden=4)
    text = plan(predict(small, spec, initial_weights(spec)))
    assert "MapInArrow" in text and "Exchange" not in text
