"""Serialised log records, digests and compression as vectorised functions."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.model import DELETE, OP_CODES, PUT, InvalidRecord, Write

_NAMES = {v: k for k, v in OP_CODES.items()}
#: Limits of a serialised record (fixed values).
MAX_RECORD_KEY, MAX_RECORD_VALUE = 1 << 20, 10 << 20


def encode_record(seq: int, write: Write) -> bytes:
    """type (1 byte), seq (8, little-endian), key length (4), key and, unless it deletes, value length (4), value."""
    out = struct.pack("<BQI", OP_CODES[write.op], seq, len(write.key)) + write.key
    return out if write.op == DELETE else out + struct.pack("<I", len(write.value or b"")) + (write.value or b"")


def decode_record(raw: bytes) -> tuple[int, Write]:
    try:
        code, seq, n = struct.unpack_from("<BQI", raw)
        key, at = raw[13 : 13 + n], 13 + n
        if n > MAX_RECORD_KEY or len(key) != n or code not in _NAMES:
            raise InvalidRecord("bad key length or type")
        if _NAMES[code] == DELETE:
            return seq, Write(DELETE, key)
        (m,) = struct.unpack_from("<I", raw, at)
        value = raw[at + 4 : at + 4 + m]
        if m > MAX_RECORD_VALUE or len(value) != m:
            raise InvalidRecord("bad value length")
        return seq, Write(_NAMES[code], key, value)
    except struct.error as error:
        raise InvalidRecord("record is cut short") from error


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), body)[0]


def _turned(h: Column, size: int) -> Column:
    """``size`` bytes in hex, in the other order."""
    return F.concat(*(F.substring(h, 2 * i + 1, 2) for i in reversed(range(size))))


def _little(value: Column, size: int) -> Column:
    """A whole number, not negative, as ``size`` bytes with the least first."""
    return F.unhex(_turned(F.lpad(F.hex(value.cast("long")), 2 * size, "0"), size))


def _number(raw: Column, at: Column | int, size: int) -> Column:
    """The number in ``size`` bytes with the least first; null if there are fewer, or if it is over that of a long."""
    at = F.lit(at) if isinstance(at, int) else at
    return _let(F.hex(F.substring(raw, at.cast("int"), F.lit(size))), lambda h: F.when(F.length(h) == 2 * size, F.conv(_turned(h, size), 16, 10).try_cast("long")))


def encode_records(seq: str | Column, op: str | Column, key: str | Column, value: str | Column) -> Column:
    """Records as bytes, laid out as ``encode_record`` does, in built-in functions."""
    seq, op, key, value = (F.col(c) if isinstance(c, str) else c for c in (seq, op, key, value))
    code = F.lit(None).cast("string")
    for name, n in OP_CODES.items():
        code = F.when(op == name, F.lit(f"{n:02X}")).otherwise(code)
    value = F.coalesce(value, F.unhex(F.lit("")))
    head = F.concat(F.unhex(code), _little(seq, 8), _little(F.length(key), 4), key)
    return F.when(op == DELETE, head).otherwise(F.concat(head, _little(F.length(value), 4), value))


def decode_records(raw: str | Column) -> Column:
    """Bytes as a struct of seq, op, key, value and error, in built-in functions; a corrupt or missing record has only ``error``."""

    def of(raw: Column) -> Column:
        code = F.substring(raw, 1, 1)
        op = F.lit(None).cast("string")
        for name, n in OP_CODES.items():
            op = F.when(code == F.lit(bytearray([n])), F.lit(name)).otherwise(op)
        return _let(F.struct(op.alias("op"), _number(raw, 2, 8).alias("seq"), _number(raw, 10, 4).alias("size")), lambda h: with_key(raw, h))

    def with_key(raw: Column, h: Column) -> Column:
        ok = h["op"].isNotNull() & (h["size"] <= MAX_RECORD_KEY) & (F.length(raw) >= h["size"] + 13)
        return _let(F.when(ok, h["size"] + 14), lambda at: _let(_number(raw, at, 4), lambda size: whole(raw, h, at, size)))

    def whole(raw: Column, h: Column, at: Column, size: Column) -> Column:
        error = (
            F.when(F.length(raw) < 13, F.lit("record is cut short"))
            .when(at.isNull(), F.lit("bad key length or type"))
            .when(h["seq"].isNull(), F.lit("bad sequence number"))
            .when(h["op"] == DELETE, F.lit(None).cast("string"))
            .when(size.isNull(), F.lit("record is cut short"))
            .when((size > MAX_RECORD_VALUE) | (F.length(raw) < at + 3 + size), F.lit("bad value length"))
        )
        key = F.substring(raw, F.lit(14), h["size"].cast("int"))
        value = F.when(h["op"] != DELETE, F.substring(raw, (at + 4).cast("int"), size.cast("int")))
        columns = {"seq": h["seq"], "op": h["op"], "key": key, "value": value}
        return _let(error, lambda e: F.struct(*(F.when(e.isNull(), c).alias(name) for name, c in columns.items()), e.alias("error")))

    return _let(F.coalesce(F.col(raw) if isinstance(raw, str) else raw, F.unhex(F.lit(""))), of)


def checksum_ok(payload: str, checksum: str) -> F.Column:
    """CRC-32 (IEEE) of a payload against the stored one."""
    return F.coalesce(F.crc32(payload) == F.col(checksum), F.lit(False))


def fnv1a_64(values: list[bytes]) -> np.ndarray:
    """FNV-1a of each value, byte column by byte column."""
    size = np.array([len(v) for v in values], np.int64)
    out = np.full(len(values), 0xCBF29CE484222325, np.uint64)
    width = int(size.max(initial=0))
    table = np.zeros((len(values), width), np.uint8)
    for i, v in enumerate(values):
        table[i, : len(v)] = np.frombuffer(bytes(v), np.uint8)
    for at in range(width):
        live = size > at
        out[live] = (out[live] ^ table[live, at]) * np.uint64(0x100000001B3)
    return out


@F.pandas_udf(T.LongType())
def fnv1a(value: pd.Series) -> pd.Series:
    """FNV-1a 64 as a signed long; null stays null."""
    some = value.notna()
    out = pd.Series([None] * len(value), dtype="Int64", index=value.index)
    out[some] = fnv1a_64([bytes(v) for v in value[some]]).view(np.int64)
    return out


CODECS = ("none", "zlib", "zstd", "snappy")


def compress(data: bytes, codec: str) -> bytes:
    """With one of CODECS."""
    if codec == "none":
        return data
    if codec == "zlib":
        return zlib.compress(data)
    if codec == "zstd":
        import zstandard

        return zstandard.ZstdCompressor().compress(data)
    if codec == "snappy":
        return pa.compress(data, codec="snappy", asbytes=True)
    raise ValueError(f"unknown codec {codec}")


def decompress(data: bytes, codec: str) -> bytes:
    if codec == "none":
        return data
    if codec == "zlib":
        return zlib.decompress(data)
    if codec == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    if codec == "snappy":
        # the size stands first, seven bits a byte
        size = 0
        for i, b in enumerate(data[:5]):
            size |= (b & 127) << 7 * i
            if b < 128:
                break
        return pa.decompress(data, decompressed_size=size, codec="snappy", asbytes=True) if size else b""
    raise ValueError(f"unknown codec {codec}")


def compress_stream(chunks: Iterable[bytes], codec: str) -> Iterator[bytes]:
    """Each chunk by itself, with its length before it, so that a reader needs no more than one at a time."""
    for chunk in chunks:
        raw = compress(chunk, codec)
        yield struct.pack("<I", len(raw)) + raw


def decompress_stream(parts: Iterable[bytes], codec: str) -> Iterator[bytes]:
    """The chunks again, however the bytes are parted; InvalidRecord if they end inside one."""
    held = b""
    for part in parts:
        held += part
        while len(held) >= 4 and len(held) >= 4 + struct.unpack_from("<I", held)[0]:
            (n,) = struct.unpack_from("<I", held)
            yield decompress(held[4 : 4 + n], codec)
            held = held[4 + n :]
    if held:
        raise InvalidRecord("stream is cut short")


def put_or_delete(op: F.Column) -> F.Column:
    """Operations as they act: MERGE writes like PUT; unknown ones raise."""
    known = F.when(op.isin(PUT, DELETE), op).when(op == "MERGE", F.lit(PUT))
    return known.otherwise(F.raise_error(F.concat(F.lit("unknown operation "), F.coalesce(op, F.lit("null")))))
