"""Results as MessagePack maps, one per row."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def pack(value: object) -> bytes:
    """One value in MessagePack form."""
    if value is None:
        return b"\xc0"
    if value is True or value is False:
        return b"\xc3" if value else b"\xc2"
    if isinstance(value, int):
        if 0 <= value < 128:
            return bytes([value])
        if -32 <= value < 0:
            return struct.pack("b", value)
        for code, form, low, high in ((0xCC, ">B", 0, 2**8), (0xCD, ">H", 0, 2**16), (0xCE, ">I", 0, 2**32), (0xCF, ">Q", 0, 2**64), (0xD0, ">b", -(2**7), 0), (0xD1, ">h", -(2**15), 0), (0xD2, ">i", -(2**31), 0), (0xD3, ">q", -(2**63), 0)):
            if low <= value < high:
                return bytes([code]) + struct.pack(form, value)
        raise OverflowError(value)
    if isinstance(value, float):
        return b"\xcb" + struct.pack(">d", value)
    if isinstance(value, str):
        data = value.encode()
        n = len(data)
        head = bytes([0xA0 | n]) if n < 32 else b"\xd9" + bytes([n]) if n < 256 else b"\xda" + struct.pack(">H", n) if n < 65_536 else b"\xdb" + struct.pack(">I", n)
        return head + data
    if isinstance(value, dict):
        n = len(value)
        head = bytes([0x80 | n]) if n < 16 else b"\xde" + struct.pack(">H", n)
        return head + b"".join(pack(k) + pack(v) for k, v in value.items())
    raise TypeError(f"cannot pack {type(value).__name__}")


def to_msgpack(df: DataFrame) -> DataFrame:
    """Each row of scalar columns as a MessagePack map in a binary column ``value``."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([pack(r) for r in batch.to_pylist()], pa.binary())], ["value"])

    return df.mapInArrow(packed, "value binary")
