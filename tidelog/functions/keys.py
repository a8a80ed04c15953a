"""Column expressions and helpers over byte-ordered keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelog import model

Bytes = bytes | bytearray | str


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def successor(prefix: bytes) -> bytes | None:
    """The least key above every key with this prefix; None if there is none (the prefix is all 0xFF)."""
    kept = bytes(prefix).rstrip(b"\xff")
    return kept[:-1] + bytes([kept[-1] + 1]) if kept else None


def _successor_of(prefix: Bytes) -> Bytes | None:
    if isinstance(prefix, str):
        # The bound of a string key must be a string too: raise the last code point that can be raised.
        for at in reversed(range(len(prefix))):
            code = ord(prefix[at])
            if code < 0x10FFFF:
                code += 1
                return prefix[:at] + chr(0xE000 if 0xD800 <= code < 0xE000 else code)
        return None
    return successor(bytes(prefix))


def lit(value: Bytes) -> Column:
    return F.lit(value if isinstance(value, str) else bytearray(value))


def has_prefix(key: Column | str, prefix: Bytes) -> Column:
    """Keys with this prefix, told both by the bytes and by the range they span: Parquet prunes on the range alone."""
    key = _col(key)
    if not prefix:
        return key.isNotNull()
    out = F.startswith(key, lit(prefix)) & (key >= lit(prefix))
    end = _successor_of(prefix)
    return out if end is None else out & (key < lit(end))


def has_suffix(key: Column | str, suffix: Bytes) -> Column:
    key = _col(key)
    return F.endswith(key, lit(suffix)) if suffix else key.isNotNull()


def in_range(key: Column | str, start: Bytes | None = None, end: Bytes | None = None) -> Column:
    """start <= key < end; a missing or empty bound is open."""
    key = _col(key)
    out = key.isNotNull()
    if start:
        out = key >= lit(start)
    if end:
        out = (out & (key < lit(end))) if start else key < lit(end)
    return out


def overlaps(first_a: Column, last_a: Column, first_b: Column, last_b: Column) -> Column:
    """Whether two closed key ranges meet; false if either is empty (null)."""
    return F.coalesce((last_a >= first_b) & (first_a <= last_b), F.lit(False))


def valid_key(key: Column | str) -> Column:
    return F.coalesce(F.octet_length(_col(key)).between(1, model.MAX_KEY_BYTES), F.lit(False))


def valid_value(value: Column | str) -> Column:
    return F.coalesce(F.octet_length(_col(value)) <= model.MAX_VALUE_BYTES, F.lit(False))


def table_file(level: int, sequence: int, timestamp: int) -> str:
    return f"{level}_{sequence:06d}_{timestamp:020d}"


def table_file_parts(path: Column | str) -> list[Column]:
    """level, sequence and timestamp from the name of a table file; null where the name is another."""
    pattern = r"(?:^|/)(\d+)_(\d{6,})_(\d{20})(?:\.\w+)?/?$"
    return [
        F.when(_col(path).rlike(pattern), F.regexp_extract(_col(path), pattern, i).cast("long")).alias(name)
        for i, name in enumerate(("level", "sequence", "timestamp"), 1)
    ]
