"""Gzip files of several members, read by several tasks."""

import gzip
import struct
import zlib

import numpy as np
import pytest
from pyspark.errors import PySparkException

from labelvec.sources import members
from labelvec.sources.files import list_files, qualified
from labelvec.sources.idx import read_idx_images, read_idx_labels, read_idx_pair


def idx(values, images=True):
    if images:
        return struct.pack(">IIII", 2051, len(values), 2, 3) + values.astype(np.uint8).tobytes()
    return struct.pack(">II", 2049, len(values)) + values.astype(np.uint8).tobytes()


def in_members(data, cuts):
    edges = [0, *cuts, len(data)]
    return b"".join(gzip.compress(data[a:b], 6, mtime=0) for a, b in zip(edges, edges[1:]))


@pytest.fixture
def images():
    rng = np.random.default_rng(3)
    return rng.integers(0, 256, (500, 6)), rng.integers(0, 10, 500)


def parts_of(spark, path, **sizes):
    return members.gzip_parts(list_files(spark, path), **sizes).orderBy("start").collect()


@pytest.mark.parametrize("scan", [37, 1000, 1 << 20])
def test_members_are_found_and_proven(spark, tmp_path, images, scan):
    data = idx(images[0])
    cuts = [1, 16, 17, 400, 401, 2000]  # inside the header, inside an image, next to each other
    (tmp_path / "x.gz").write_bytes(in_members(data, cuts))
    found = parts_of(spark, str(tmp_path), scan_bytes=scan, part_bytes=1)
    assert [r.first_byte for r in found] == [0, *cuts]
    assert [r.first_byte + r.bytes for r in found] == [*cuts, len(data)]
    one = parts_of(spark, str(tmp_path), scan_bytes=scan)
    assert [(r.start, r.first_byte, r.bytes) for r in one] == [(0, 0, len(data))]


def test_files_of_one_member_and_broken_chains_have_no_parts(spark, tmp_path, images):
    data = idx(images[0])
    whole = gzip.compress(data)
    inner = gzip.compress(b"a member inside the data of another one" * 9)
    stored = zlib.compressobj(0, zlib.DEFLATED, 31)
    files = {
        "one.gz": whole,
        "inside.gz": stored.compress(inner + data) + stored.flush(),
        "cut.gz": in_members(data, [900])[:-20],
        "more.gz": in_members(data, [900]) + b"\0\0",
        "plain": in_members(data, [900]),
    }
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    assert parts_of(spark, str(tmp_path), part_bytes=1) == []


@pytest.mark.parametrize("cuts", [[3], [16], [16 + 6 * 100 + 2, 16 + 6 * 101 + 5], list(range(40, 3000, 41))])
def test_rows_do_not_depend_on_the_members(spark, tmp_path, images, cuts, monkeypatch):
    monkeypatch.setattr("labelvec.sources.idx.PART_BYTES", 64)
    x, y = images
    for folder, data, at in (("x", idx(x), cuts), ("y", idx(y, False), [c // 7 + 1 for c in cuts])):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "a.gz").write_bytes(in_members(data, sorted(set(at))))
        (tmp_path / folder / "b.gz").write_bytes(gzip.compress(data))
        (tmp_path / folder / "c").write_bytes(data)
    left, right = str(tmp_path / "x"), str(tmp_path / "y")
    got = {r.sample_id: r.image for r in read_idx_images(spark, left).collect()}
    assert [got[i] for i in range(1500)] == np.tile(x, (3, 1)).tolist()
    labels = {r.sample_id: r.label for r in read_idx_labels(spark, right, None).collect()}
    assert [labels[i] for i in range(1500)] == np.tile(y, 3).tolist()
    pairs = {r.sample_id: (r.image, r.label) for r in read_idx_pair(spark, left, right, None).collect()}
    assert pairs == {i: (got[i], labels[i]) for i in range(1500)}


def test_eight_members_are_eight_tasks(spark, tmp_path, images, monkeypatch):
    data = idx(images[0])
    step = len(data) // 8
    (tmp_path / "x.gz").write_bytes(in_members(data, [step * k for k in range(1, 8)]))
    frame = read_idx_images(spark, str(tmp_path))
    assert frame.rdd.getNumPartitions() == 1
    monkeypatch.setattr("labelvec.sources.idx.PART_BYTES", 1)
    frame = read_idx_images(spark, str(tmp_path))
    assert frame.rdd.getNumPartitions() == 8
    assert sorted(frame.rdd.glom().map(len).collect()) == sorted(np.bincount([(16 + 6 * i) // step if (16 + 6 * i) // step < 8 else 7 for i in range(500)]).tolist())


def test_a_member_that_lies_about_its_data_is_none(spark, tmp_path, images):
    data = bytearray(in_members(idx(images[0]), [1000]))
    path = tmp_path / "x.gz"
    path.write_bytes(bytes(data))
    place = qualified(spark, str(path))
    second = parts_of(spark, str(tmp_path), part_bytes=1)[1].start
    assert members.proven(place, second) is not None
    data[-6] ^= 1  # its checksum
    path.write_bytes(bytes(data))
    assert members.proven(place, second) is None
    assert parts_of(spark, str(tmp_path), part_bytes=1) == []
    with pytest.raises(PySparkException):
        read_idx_images(spark, str(tmp_path)).collect()
