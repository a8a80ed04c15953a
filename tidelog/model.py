"""What a log is made of: schemas, operation codes, limits and errors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

PUT, DELETE, MERGE, BATCH = "PUT", "DELETE", "MERGE", "BATCH"
#: Codes of the operations in serialised records (fixed values).
OP_CODES = {PUT: 1, DELETE: 2, MERGE: 3, BATCH: 4}

#: Limits on single records and batches (fixed values).
MAX_KEY_BYTES, MAX_VALUE_BYTES, MAX_BATCH_OPS = 4096, 10 * 1024 * 1024, 1000

LOG = T.StructType([
    T.StructField("seq", T.LongType(), False),
    T.StructField("op", T.StringType(), False),
    T.StructField("key", T.BinaryType(), False),
    T.StructField("value", T.BinaryType(), True),
])
#: Records as files hold them: with the time of a deletion in microseconds, by which its tombstone is retained.
STORED = T.StructType([*LOG.fields, T.StructField("deleted_at", T.LongType(), True)])
KV = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("value", T.BinaryType())])
BATCHES = T.StructType([
    T.StructField("base_seq", T.LongType()),
    T.StructField("ops", T.ArrayType(T.StructType([T.StructField("op", T.StringType()), T.StructField("key", T.BinaryType()), T.StructField("value", T.BinaryType())]))),
])


class StoreError(Exception):
    """Base of the errors below."""


class KeyNotFound(StoreError):
    pass


class StoreClosed(StoreError):
    pass


class ReadOnly(StoreError):
    pass


class TransactionClosed(StoreError):
    pass


class TransactionNotFound(StoreError):
    pass


class InvalidRecord(StoreError):
    pass


class Conflict(StoreError):
    """Another writer committed first."""


class ReplicationError(StoreError):
    """``code`` is one of CODES."""

    CODES = ("unknown", "connection", "protocol", "sequence_gap", "compression", "authentication", "retention", "timeout", "closed")

    def __init__(self, code: str, message: str):
        if code not in self.CODES:
            raise ValueError(f"unknown replication error code {code}")
        super().__init__(f"{code}: {message}")
        self.code = code


@dataclass(frozen=True)
class Write:
    """One operation of a batch or a write set."""

    op: str
    key: bytes
    value: bytes | None = None

    @staticmethod
    def put(key: bytes, value: bytes) -> Write:
        return Write(PUT, bytes(key), bytes(value))

    @staticmethod
    def delete(key: bytes) -> Write:
        return Write(DELETE, bytes(key))

    def checked(self) -> Write:
        """Itself, or InvalidRecord. A MERGE is stored as the PUT that it acts as."""
        if self.op not in (PUT, DELETE, MERGE):
            raise InvalidRecord(f"operation {self.op!r} cannot be written")
        if not 1 <= len(self.key) <= MAX_KEY_BYTES:
            raise InvalidRecord(f"a key has 1 to {MAX_KEY_BYTES} bytes, not {len(self.key)}")
        if self.op == DELETE:
            return Write(DELETE, self.key)
        if self.value is None:
            raise InvalidRecord("a value may be empty but not missing")
        if len(self.value) > MAX_VALUE_BYTES:
            raise InvalidRecord(f"a value has up to {MAX_VALUE_BYTES} bytes, not {len(self.value)}")
        return Write(PUT, self.key, self.value)


def checked_batch(writes: list[Write]) -> list[Write]:
    if len(writes) > MAX_BATCH_OPS:
        raise InvalidRecord(f"a batch has up to {MAX_BATCH_OPS} operations, not {len(writes)}")
    return [w.checked() for w in writes]


class Batch:
    """Collects operations for one atomic write."""

    def __init__(self) -> None:
        self.writes: list[Write] = []

    def put(self, key: bytes, value: bytes) -> Batch:
        self.writes.append(Write.put(key, value))
        return self

    def delete(self, key: bytes) -> Batch:
        self.writes.append(Write.delete(key))
        return self

    def count(self) -> int:
        return len(self.writes)

    def size(self) -> int:
        """Bytes of all keys and values."""
        return sum(len(w.key) + len(w.value or b"") for w in self.writes)

    def reset(self) -> None:
        self.writes = []
