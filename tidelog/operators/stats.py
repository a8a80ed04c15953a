"""Statistics of a store, its operations and its replicas as aggregates, and a small collector for one driver."""

from __future__ import annotations

import threading
import time
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.functions.keys import Bytes, has_prefix

OPERATIONS = ("put", "get", "delete", "scan", "commit", "flush", "compact", "begin", "rollback")


def key_stats(view: DataFrame) -> DataFrame:
    """Live keys and the bytes of their keys and values."""
    size = F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))
    return view.agg(F.count("*").alias("key_count"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("storage_size"))


def operation_counts(ops: DataFrame) -> DataFrame:
    return ops.groupBy("op").agg(F.count("*").alias("n"))


def latencies(ops: DataFrame) -> DataFrame:
    """Count, whole-number mean, least and greatest latency of each operation; operations without one are left out."""
    some = ops.where(F.col("latency_ns").isNotNull())
    return some.groupBy("op").agg(
        F.count("*").alias("count"),
        F.expr("sum(latency_ns) div count(*)").alias("avg_ns"),
        F.min("latency_ns").alias("min_ns"),
        F.max("latency_ns").alias("max_ns"),
    )


def error_counts(ops: DataFrame) -> DataFrame:
    return ops.where(F.col("error").isNotNull()).groupBy("error").agg(F.count("*").alias("n"))


def last_operations(ops: DataFrame) -> DataFrame:
    return ops.groupBy("op").agg(F.max("ts").alias("last_ts"))


def traffic(ops: DataFrame) -> DataFrame:
    """Bytes read and written."""
    return ops.agg(
        F.coalesce(F.sum(F.when(F.col("is_write"), F.col("bytes"))), F.lit(0)).cast("long").alias("bytes_written"),
        F.coalesce(F.sum(F.when(~F.col("is_write"), F.col("bytes"))), F.lit(0)).cast("long").alias("bytes_read"),
    )


def latest_size(sizes: DataFrame) -> DataFrame:
    """The last reported size (by ts, then size)."""
    return sizes.agg(F.max_by("size", F.struct("ts", "size")).alias("size"))


def named(stats: DataFrame, prefix: Bytes) -> DataFrame:
    return stats.where(has_prefix("name", prefix))


def sequence_bounds(log: DataFrame, file: str = "file") -> DataFrame:
    return log.groupBy(file).agg(F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq"), F.count("*").alias("n"))


def next_sequence(log: DataFrame) -> DataFrame:
    return log.agg((F.coalesce(F.max("seq"), F.lit(0)) + 1).cast("long").alias("next_seq"))


def key_bounds(rows: DataFrame, file: str = "file") -> DataFrame:
    return rows.groupBy(file).agg(F.min("key").alias("first_key"), F.max("key").alias("last_key"), F.count("*").alias("key_count"))


def level_sizes(files: DataFrame) -> DataFrame:
    return files.groupBy("level").agg(F.sum("size").cast("long").alias("size"), F.count("*").alias("files"))


def least_acknowledged(replicas: DataFrame) -> DataFrame:
    """The least acknowledged seq of the replicas that are connected and active; null without any."""
    return replicas.where("connected and active").agg(F.min("last_ack").alias("min_ack"))


class CallMetrics:
    """Calls of one client: how many, how many failed, how long they took, and bytes each way."""

    def __init__(self) -> None:
        self._lock, self.calls = threading.Lock(), {}

    def record(self, name: str, latency_ns: int, ok: bool, sent: int = 0, received: int = 0) -> None:
        with self._lock:
            c = self.calls.setdefault(name, {"requests": 0, "succeeded": 0, "failed": 0, "latency_ns": 0, "bytes_sent": 0, "bytes_received": 0})
            for key, n in (("requests", 1), ("succeeded", int(ok)), ("failed", int(not ok)), ("latency_ns", latency_ns), ("bytes_sent", sent), ("bytes_received", received)):
                c[key] += n

    def get(self) -> dict:
        """Totals, the mean latency, and the same for each call."""
        with self._lock:
            calls = {name: dict(c) for name, c in self.calls.items()}
        keys = ("requests", "succeeded", "failed", "latency_ns", "bytes_sent", "bytes_received")
        total = {k: sum(c[k] for c in calls.values()) for k in keys}
        for c in (total, *calls.values()):
            c["mean_ns"] = c["latency_ns"] // max(1, c["requests"])
        return total | {"calls": calls}

    def reset(self) -> None:
        with self._lock:
            self.calls = {}


class Collector:
    """Counts of one driver; what the store reports as its own statistics."""

    def __init__(self) -> None:
        self.counts: dict[str, int] = defaultdict(int)
        self.errors: dict[str, int] = defaultdict(int)
        self.last: dict[str, float] = {}
        self.latency: dict[str, list[int]] = {}
        self.recovery: dict[str, int] = {}
        self.bytes_read = self.bytes_written = self.memtable_size = 0
        self._recovering = 0.0

    def track(self, op: str, latency_ns: int | None = None) -> None:
        self.counts[op] += 1
        self.last[op] = time.time()
        if latency_ns is not None:
            n, total, lo, hi = self.latency.get(op, (0, 0, latency_ns, latency_ns))
            self.latency[op] = [n + 1, total + latency_ns, min(lo, latency_ns), max(hi, latency_ns)]

    def track_error(self, kind: str) -> None:
        self.errors[kind] += 1

    def track_bytes(self, is_write: bool, n: int) -> None:
        if is_write:
            self.bytes_written += n
        else:
            self.bytes_read += n

    def track_memtable_size(self, n: int) -> None:
        self.memtable_size = n

    def start_recovery(self) -> None:
        self._recovering = time.monotonic()

    def finish_recovery(self, files: int, entries: int, corrupt: int) -> None:
        took = int((time.monotonic() - self._recovering) * 1000)
        self.recovery = {"files": files, "entries": entries, "corrupt": corrupt, "duration_ms": took}

    def get(self, prefix: str = "") -> dict:
        out: dict = {f"{op}_ops": n for op, n in self.counts.items()}
        out |= {f"last_{op}_time": t for op, t in self.last.items()}
        out |= {f"{op}_latency": {"count": n, "avg_ns": total // n, "min_ns": lo, "max_ns": hi} for op, (n, total, lo, hi) in self.latency.items()}
        out |= {"errors": dict(self.errors), "recovery": dict(self.recovery), "total_bytes_read": self.bytes_read, "total_bytes_written": self.bytes_written, "memtable_size": self.memtable_size, "flush_count": self.counts.get("flush", 0), "compaction_count": self.counts.get("compact", 0)}
        return {k: v for k, v in out.items() if k.startswith(prefix)}
