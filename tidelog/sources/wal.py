"""Raw log frames: checked, put together from fragments, decoded into records, with batches taken apart."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.functions.records import checksum_ok, decode_record, encode_record, encode_records
from tidelog.model import BATCH, OP_CODES, InvalidRecord, Write

#: Bytes of a frame's payload, and the kinds of frames (fixed values).
FRAME_BYTES = 32 * 1024
FULL, FIRST, MIDDLE, LAST = 1, 2, 3, 4

FRAMES = T.StructType([
    T.StructField("record", T.LongType()),
    T.StructField("part", T.IntegerType()),
    T.StructField("kind", T.IntegerType()),
    T.StructField("checksum", T.LongType()),
    T.StructField("payload", T.BinaryType()),
])


@dataclass(frozen=True)
class Replayed:
    log: DataFrame
    frames: int
    corrupt: int


def encode_batch(base_seq: int, writes: list[Write]) -> bytes:
    """A record of type BATCH: its number, how many operations, and each as a record with its length before it."""
    parts = [encode_record(base_seq + i, w) for i, w in enumerate(writes)]
    return struct.pack("<BQI", OP_CODES[BATCH], base_seq, len(parts)) + b"".join(struct.pack("<I", len(p)) + p for p in parts)


def decode_entry(raw: bytes) -> list[tuple[int, Write]]:
    """The records of a payload: one, or those of a batch."""
    if raw[:1] != bytes([OP_CODES[BATCH]]):
        return [decode_record(raw)]
    try:
        _, base, n = struct.unpack_from("<BQI", raw)
        out, at = [], 13
        for _ in range(n):
            (size,) = struct.unpack_from("<I", raw, at)
            out.append(decode_record(raw[at + 4 : at + 4 + size]))
            at += 4 + size
    except struct.error as error:
        raise InvalidRecord("batch is cut short") from error
    if [s for s, _ in out] != list(range(base, base + n)):
        raise InvalidRecord("batch numbers do not follow on")
    return out


def frames_of(record: int, payload: bytes, size: int = FRAME_BYTES) -> list[tuple[int, int, int, int, bytes]]:
    """Rows of FRAMES for a payload, cut where it is longer than a frame."""
    parts = [payload[i : i + size] for i in range(0, max(1, len(payload)), size)]
    kinds = [FULL] if len(parts) == 1 else [FIRST, *[MIDDLE] * (len(parts) - 2), LAST]
    return [(record, i, k, zlib.crc32(p), p) for i, (k, p) in enumerate(zip(kinds, parts, strict=True))]


def to_frames(payloads: DataFrame, size: int = FRAME_BYTES) -> DataFrame:
    """Frames of ``(record long, payload binary)``, as ``frames_of`` cuts them, in built-in functions and with no exchange.

    An empty payload is one empty frame; a null one has none.
    """
    rows = payloads.where(F.col("payload").isNotNull()).withColumn("n", F.greatest(F.lit(1), F.ceil(F.length("payload") / size)).cast("int"))
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    kind = F.when(F.col("n") == 1, FULL).when(F.col("part") == 0, FIRST).when(F.col("part") == F.col("n") - 1, LAST).otherwise(MIDDLE)
    rows = rows.select("record", "part", kind.cast("int").alias("kind"), F.substring("payload", F.col("part") * size + 1, F.lit(size)).alias("cut"))
    return rows.select("record", "part", "kind", F.crc32("cut").alias("checksum"), F.col("cut").alias("payload"))


def log_frames(log: DataFrame, size: int = FRAME_BYTES) -> DataFrame:
    """The frames of a log of (seq, op, key, value), a record each under its number."""
    return to_frames(log.select(F.col("seq").alias("record"), encode_records("seq", "op", "key", "value").alias("payload")), size)


_ENTRY = T.ArrayType(T.StructType([T.StructField("seq", T.LongType()), T.StructField("op", T.StringType()), T.StructField("key", T.BinaryType()), T.StructField("value", T.BinaryType())]))


@F.pandas_udf(_ENTRY)
def _decoded(raw: pd.Series) -> pd.Series:
    def one(x):
        try:
            return [{"seq": s, "op": w.op, "key": w.key, "value": w.value} for s, w in decode_entry(bytes(x))]
        except InvalidRecord:
            return None

    return raw.map(one)


def payloads(frames: DataFrame) -> DataFrame:
    """``(record, payload)`` of records of which every frame is there and whole; the others are left out."""
    ok = frames.withColumn("ok", checksum_ok("payload", "checksum"))
    parts = F.array_sort(F.collect_list(F.struct("part", "kind", "payload")))
    whole = ok.groupBy("record").agg(F.every("ok").alias("ok"), parts.alias("p")).where("ok")
    n = F.size("p")
    first, last = F.element_at("p", 1)["kind"], F.element_at("p", -1)["kind"]
    complete = ((n == 1) & (first == FULL)) | ((n > 1) & (first == FIRST) & (last == LAST))
    in_order = F.element_at("p", -1)["part"] == n - 1
    joined = F.aggregate("p", F.unhex(F.lit("")), lambda s, x: F.concat(s, x.payload))
    return whole.where(complete & in_order).select("record", joined.alias("payload"))


def replay(frames: DataFrame) -> Replayed:
    """The log of all records that can be read; frames and records that cannot are counted and passed over."""
    good = payloads(frames).select("record", _decoded("payload").alias("entry"))
    log = good.where("entry is not null").select(F.explode("entry").alias("e")).select("e.*")
    n, records = frames.agg(F.count("*"), F.count_distinct("record")).first()
    read = good.where("entry is not null").count()
    return Replayed(log, n, records - read)
