"""Example messages with int64 list features, through dynamic protobuf descriptors."""

from __future__ import annotations

import functools
from array import array

import numpy as np
import pyarrow as pa


@functools.cache
def example_class(packed: bool = False):
    """Message class built from the public field numbers of the format.

    Packed ints travel as one byte string; with ``packed`` they are left as such.
    """
    try:
        from google.protobuf import descriptor_pb2, descriptor_pool, message_factory
    except ImportError as error:
        raise ImportError("the record format needs the protobuf package") from error

    field = descriptor_pb2.FieldDescriptorProto
    file = descriptor_pb2.FileDescriptorProto(
        name="labelvec_example.proto", package="labelvec", syntax="proto3"
    )
    ints = file.message_type.add(name="Int64List")
    kind = field.TYPE_BYTES if packed else field.TYPE_INT64
    ints.field.add(name="value", number=1, type=kind, label=field.LABEL_REPEATED)
    feature = file.message_type.add(name="Feature")
    feature.oneof_decl.add(name="kind")
    feature.field.add(
        name="int64_list", number=3, type=field.TYPE_MESSAGE, label=field.LABEL_OPTIONAL,
        type_name=".labelvec.Int64List", oneof_index=0,
    )
    features = file.message_type.add(name="Features")
    entry = features.nested_type.add(name="FeatureEntry")
    entry.options.map_entry = True
    entry.field.add(name="key", number=1, type=field.TYPE_STRING, label=field.LABEL_OPTIONAL)
    entry.field.add(
        name="value", number=2, type=field.TYPE_MESSAGE, label=field.LABEL_OPTIONAL,
        type_name=".labelvec.Feature",
    )
    features.field.add(
        name="feature", number=1, type=field.TYPE_MESSAGE, label=field.LABEL_REPEATED,
        type_name=".labelvec.Features.FeatureEntry",
    )
    example = file.message_type.add(name="Example")
    example.field.add(
        name="features", number=1, type=field.TYPE_MESSAGE, label=field.LABEL_OPTIONAL,
        type_name=".labelvec.Features",
    )
    pool = descriptor_pool.DescriptorPool()
    pool.Add(file)
    return message_factory.GetMessageClass(pool.FindMessageTypeByName("labelvec.Example"))


def varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all values one after the other, bytes of each): seven bits a byte, the last without a mark."""
    left = values.astype(np.int64).view(np.uint64)
    size = np.ones(len(left), np.int64)
    for k in range(1, 10):
        size += left >= np.uint64(1 << 7 * k)
    start = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        more = np.flatnonzero(size > k)
        mark = np.where(size[more] > k + 1, 0x80, 0).astype(np.uint8)
        out[start[more] + k] = ((left[more] >> np.uint64(7 * k)) & np.uint64(0x7F)).astype(np.uint8) | mark
    return out, size


@functools.lru_cache(maxsize=4096)
def _tagged(field: int, size: int) -> bytes:
    """Tag and length of a field of bytes; the field numbers are those of ``example_class``."""
    return bytes([field << 3 | 2]) + varints(np.array([size]))[0].tobytes()


def _field(field: int, body: bytes) -> bytes:
    return _tagged(field, len(body)) + body


def encode(batch: pa.RecordBatch) -> list[bytes]:
    """One message per row; every column is a list of ints. Features are in the order of their names."""
    columns = []
    for name, column in sorted(zip(batch.schema.names, batch.columns), key=lambda c: c[0]):
        if column.null_count or column.flatten().null_count:
            raise ValueError(f"null in feature {name!r}")
        # Offsets start inside the values when the batch is a slice of a larger one.
        offsets = column.offsets.to_numpy()
        data, size = varints(column.flatten().to_numpy())
        edges = np.concatenate([[0], np.cumsum(size)])[offsets - offsets[0]]
        columns.append((_field(1, name.encode()), data.tobytes(), edges.tolist()))
    messages = []
    for row in range(batch.num_rows):
        features = []
        for key, data, edges in columns:
            packed = data[edges[row] : edges[row + 1]]
            feature = _field(3, _field(1, packed)) if packed else b""
            features.append(_field(1, key + _field(2, feature)))
        messages.append(_field(1, b"".join(features)))
    return messages


def decode(payloads: list[bytes], names: list[str]) -> pa.RecordBatch:
    """One list column per named feature; an absent feature is an empty list."""
    messages = [example_class(packed=True).FromString(data) for data in payloads]
    columns = []
    for name in names:
        segments = [
            m.features.feature[name].int64_list if name in m.features.feature else None
            for m in messages
        ]
        raw = [b"" if s is None else b"".join(s.value) for s in segments]
        # A list that was not packed shows up as bytes the packed field did not take.
        if any(s is not None and s.ByteSize() != _packed_size(s.value) for s in segments):
            return _decode_unpacked(payloads, names)
        columns.append(_varints(raw))
    return pa.RecordBatch.from_arrays(columns, names=names)


def _packed_size(parts: list[bytes]) -> int:
    return sum(1 + max(1, -(-len(p).bit_length() // 7)) + len(p) for p in parts)


def _varints(rows: list[bytes]) -> pa.ListArray:
    """Lists of ints from base-128 bytes, seven bits each, low bits first."""
    data = np.frombuffer(b"".join(rows), np.uint8)
    last = data < 128
    stops = np.flatnonzero(last).astype(np.int32)
    starts = np.zeros_like(stops)
    starts[1:] = stops[:-1] + 1
    lengths = stops - starts + 1
    values = (data[starts] & 127).astype(np.uint64)
    for k in range(1, int(lengths.max(initial=0))):
        longer = np.flatnonzero(lengths > k)
        bits = (data[starts[longer] + k] & 127).astype(np.uint64)
        values[longer] |= bits << np.uint64(7 * k)
    ends = np.cumsum([len(r) for r in rows])
    if len(data) and not last[ends[ends > 0] - 1].all():
        raise ValueError("an int list ends inside a value")
    offsets = np.concatenate([[0], np.cumsum(last)])[np.concatenate([[0], ends])]
    return pa.ListArray.from_arrays(offsets.astype(np.int32), values.view(np.int64))


def _decode_unpacked(payloads: list[bytes], names: list[str]) -> pa.RecordBatch:
    parse = example_class().FromString
    values = {name: array("q") for name in names}
    offsets: dict[str, list[int]] = {name: [0] for name in names}
    for data in payloads:
        feature = parse(data).features.feature
        for name in names:
            if name in feature:
                values[name].extend(feature[name].int64_list.value)
            offsets[name].append(len(values[name]))
    columns = [
        pa.ListArray.from_arrays(
            np.array(offsets[n], np.int32), np.frombuffer(values[n], np.int64)
        )
        for n in names
    ]
    return pa.RecordBatch.from_arrays(columns, names=names)
