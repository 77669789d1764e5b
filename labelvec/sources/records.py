"""Framed records: length, masked CRC-32C of the length, data, masked CRC-32C of the data."""

from __future__ import annotations

import functools
import struct
from collections.abc import Iterator

import numpy as np

from labelvec.sources.files import open_stream, read_exactly

# Reversed Castagnoli polynomial and the mask added to each checksum.
CRC_POLYNOMIAL = 0x82F63B78
CRC_MASK = 0xA282EAD8

GROUP_RECORDS = 1024
GROUP_BYTES = 8 << 20
SCAN_BYTES = 1 << 16
# A power of two.
STRIP_BYTES = 256


@functools.cache
def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(CRC_POLYNOMIAL), table >> 1)
    return table.astype(np.uint32)


@functools.cache
def _zeros(power: int) -> np.ndarray:
    """What ``2**power`` zero bytes after a buffer do to its checksum, as a table for each byte of the checksum.

    The step is linear over GF(2): its 32 columns say it all, and applied to themselves they give twice as many bytes.
    """
    columns = np.uint32(1) << np.arange(32, dtype=np.uint32)
    if power:
        columns = _apply(_zeros(power - 1), _apply(_zeros(power - 1), columns))
    else:
        columns = _crc_table()[columns & 0xFF] ^ (columns >> 8)
    tables = np.zeros((4, 256), np.uint32)
    for bit in range(32):
        chosen = np.arange(256) >> (bit % 8) & 1 == 1
        tables[bit // 8, chosen] ^= columns[bit]
    return tables


def _apply(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return tables[0][crc & 0xFF] ^ tables[1][crc >> 8 & 0xFF] ^ tables[2][crc >> 16 & 0xFF] ^ tables[3][crc >> 24]


def _start(lengths: np.ndarray) -> np.ndarray:
    """What the start value has become after so many bytes."""
    crc = np.full(len(lengths), 0xFFFFFFFF, np.uint32)
    for power in range(int(lengths.max(initial=0)).bit_length()):
        odd = lengths >> power & 1 == 1
        crc[odd] = _apply(_zeros(power), crc[odd])
    return crc


def crc32c(buffers: list[bytes]) -> np.ndarray:
    """Checksums of many buffers at once.

    Buffers are cut into strips of ``STRIP_BYTES``, all of which are summed side by side, a byte position at a time; sums of
    neighbouring strips are joined in pairs. So the number of steps doesn't grow with the length of a buffer.
    """
    table = _crc_table()
    lengths = np.array([len(b) for b in buffers], np.int64)
    strips = np.array([1 << max(0, (-(-int(n) // STRIP_BYTES) - 1).bit_length()) for n in lengths], np.int64)
    result = np.empty(len(buffers), np.uint32)
    order = np.argsort(strips, kind="stable")
    begin = 0
    while begin < len(order):
        n = int(strips[order[begin]])
        alike = int(np.searchsorted(strips[order], n, "right"))
        group = order[begin : min(alike, begin + max(1, GROUP_BYTES // (n * STRIP_BYTES)))]
        begin += len(group)
        width = n * STRIP_BYTES if n > 1 else int(lengths[group].max(initial=0))
        # Zero bytes in front leave a sum of zero as it is.
        padded = np.zeros((len(group), width), np.uint8)
        for row, index in enumerate(group):
            padded[row, width - lengths[index] :] = np.frombuffer(buffers[index], np.uint8)
        by_position = np.ascontiguousarray(padded.reshape(len(group) * n, -1).T)
        crc = np.zeros(len(group) * n, np.uint32)
        for column in by_position:
            crc = table[(crc ^ column) & 0xFF] ^ (crc >> 8)
        power = STRIP_BYTES.bit_length() - 1
        while len(crc) > len(group):
            crc = _apply(_zeros(power), crc[0::2]) ^ crc[1::2]
            power += 1
        result[group] = ~(crc ^ _start(lengths[group]))
    return result


def masked(crc: np.ndarray) -> np.ndarray:
    crc = crc.astype(np.uint64)
    return (((crc >> 15) | (crc << 17)) + CRC_MASK & 0xFFFFFFFF).astype(np.uint32)


def frame(payloads: list[bytes]) -> bytes:
    heads = [struct.pack("<Q", len(p)) for p in payloads]
    head_crcs, data_crcs = masked(crc32c(heads)), masked(crc32c(payloads))
    return b"".join(
        part
        for head, head_crc, data, data_crc in zip(heads, head_crcs, payloads, data_crcs)
        for part in (head, head_crc.astype("<u4").tobytes(), data, data_crc.astype("<u4").tobytes())
    )


@functools.cache
def _crc_list() -> list[int]:
    return _crc_table().tolist()


def _check_length(head: bytes, path: str) -> int:
    """Verify a record header before its length is trusted."""
    table = _crc_list()
    crc = 0xFFFFFFFF
    for byte in head[:8]:
        crc = table[(crc ^ byte) & 0xFF] ^ (crc >> 8)
    crc ^= 0xFFFFFFFF
    length, stored = struct.unpack("<QI", head)
    if ((crc >> 15 | crc << 17) + CRC_MASK) & 0xFFFFFFFF != stored:
        raise ValueError(f"{path}: bad checksum of a record length")
    return length


def record_groups(path: str, start: int, size: int) -> Iterator[list[bytes]]:
    """Payloads of a byte range, in groups of bounded size; lengths and data of a group are verified at once."""
    heads: list[bytes] = []
    payloads: list[bytes] = []
    stored: list[bytes] = []
    held = done = 0

    def verified() -> list[bytes]:
        lengths = np.frombuffer(b"".join(h[8:] for h in heads), "<u4")
        if not np.array_equal(masked(crc32c([h[:8] for h in heads])), lengths):
            raise ValueError(f"{path}: bad checksum of a record length")
        expected = np.frombuffer(b"".join(stored), "<u4")
        if not np.array_equal(masked(crc32c(payloads)), expected):
            raise ValueError(f"{path}: bad checksum of a record")
        return payloads

    with open_stream(path, start) as stream:
        while done < size:
            head = read_exactly(stream, 12, path)
            length = struct.unpack_from("<Q", head)[0]
            if done + 16 + length > size:  # a wrong length, or a split that ends inside a record
                _check_length(head, path)
                read_exactly(stream, length + 4, path)
                raise ValueError(f"{path}: no record ends {size} bytes in; read the file in one piece")
            heads.append(head)
            payloads.append(read_exactly(stream, length, path))
            stored.append(read_exactly(stream, 4, path))
            done += 16 + length
            held += length
            if len(payloads) >= GROUP_RECORDS or held >= GROUP_BYTES:
                yield verified()
                heads, payloads, stored, held = [], [], [], 0
    if payloads:
        yield verified()


def _header_candidates(window: np.ndarray) -> np.ndarray:
    """Offsets in a byte window at which a length and its checksum agree."""
    table, n = _crc_table(), len(window) - 11
    crc = np.full(n, 0xFFFFFFFF, np.uint32)
    for i in range(8):
        crc = table[(crc ^ window[i : i + n]) & 0xFF] ^ (crc >> 8)
    stored = np.zeros(n, np.uint32)
    for i in range(4):
        stored |= window[8 + i : 8 + i + n].astype(np.uint32) << (8 * i)
    return np.flatnonzero(masked(~crc) == stored)


def _is_record(path: str, position: int, file_size: int) -> bool:
    """Whether a whole verified record starts here, with the end or a header after it."""
    with open_stream(path, position, buffer=SCAN_BYTES) as stream:
        try:
            length = _check_length(read_exactly(stream, 12, path), path)
            end = position + 16 + length
            if end > file_size:
                return False
            data = read_exactly(stream, length, path)
            if masked(crc32c([data])).astype("<u4").tobytes() != read_exactly(stream, 4, path):
                return False
            if end < file_size:
                _check_length(read_exactly(stream, 12, path), path)
        except ValueError:
            return False
    return True


def first_boundary(path: str, start: int, file_size: int) -> int:
    """First record start at or after ``start``, found from the checksums alone."""
    if start == 0:
        return 0
    with open_stream(path, start, buffer=SCAN_BYTES) as stream:
        window, base = b"", start
        while True:
            part = stream.read(SCAN_BYTES)
            window += part
            if len(window) >= 12:
                for offset in _header_candidates(np.frombuffer(window, np.uint8)):
                    if _is_record(path, base + int(offset), file_size):
                        return base + int(offset)
                base += len(window) - 11
                window = window[-11:]
            if not part:
                return file_size
