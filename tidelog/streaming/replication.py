"""Log shipping to read-only copies through Structured Streaming."""

from __future__ import annotations

import threading
import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidelog.model import MERGE, PUT, InvalidRecord, ReplicationError, StoreError
from tidelog.operators.live import sequence_gaps
from tidelog.operators.stats import least_acknowledged
from tidelog.plans.engine import Engine
from tidelog.sources.store import Segment, Store

#: States of a copy, and what each may turn into.
TRANSITIONS = {
    "connecting": {"streaming", "error", "stopped"},
    "streaming": {"applying", "waiting", "error", "stopped"},
    "applying": {"syncing", "error", "stopped"},
    "syncing": {"acknowledging", "error", "stopped"},
    "acknowledging": {"waiting", "streaming", "error", "stopped"},
    "waiting": {"streaming", "connecting", "error", "stopped"},
    "error": {"connecting", "stopped"},
    "stopped": set(),
}


class State:
    def __init__(self) -> None:
        self.now, self.since, self.error = "connecting", time.time(), None
        self.history = [self.now]

    def to(self, state: str, error: Exception | None = None) -> None:
        if state != self.now and state not in TRANSITIONS[self.now]:
            raise ReplicationError("protocol", f"{self.now} does not turn into {state}")
        if state != self.now:
            self.history.append(state)
        self.now, self.since, self.error = state, time.time(), error


#: Bytes of whole commits that are applied at once (a fixed value); a larger commit goes alone.
BATCH_BYTES = 256 * 1024


def read_versions(spark: SparkSession, root: str) -> DataFrame:
    """A stream of the paths of a store's versions, as they are committed. Segments are named by versions alone, so a file that a
    writer left behind when it died is never seen, whatever numbers it holds."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "v*.json").load(f"{root.rstrip('/')}/manifest").select("path")


def batches_of(commits: list[Segment], most_bytes: int = BATCH_BYTES) -> Iterator[list[Segment]]:
    """Commits in order, together up to ``most_bytes``. A commit, and so a transaction, is never cut; the first always fits."""
    held: list[Segment] = []
    for s in commits:
        if held and sum(x.size for x in held) + s.size > most_bytes:
            yield held
            held = []
        held.append(s)
    if held:
        yield held


def check_sequence(batch: DataFrame, applied: int) -> tuple[int | None, bool]:
    """(last number that may be applied, whether there is a gap) for records after ``applied``."""
    fresh = batch.where(F.col("seq") > applied)
    lo, hi, n = fresh.agg(F.min("seq"), F.max("seq"), F.count_distinct("seq")).first()
    if lo is None:
        return None, False
    if lo == applied + 1 and n == hi - lo + 1:
        return hi, False
    if lo != applied + 1:
        return None, True
    return sequence_gaps(fresh.select("seq").distinct()).agg(F.min("after_seq")).first()[0], True


class Replica:
    """A read-only copy that applies a primary's log in order, each record once.

    What is applied are the segments that the primary's newest version names, commit by commit. The last applied number is part
    of the copy's manifest and is committed together with the records, so what is delivered again changes nothing. With
    ``primary`` the copy registers there, acknowledges what it has applied, and gives signs of life.
    """

    def __init__(self, spark: SparkSession, primary_root: str, root: str | Engine, checkpoint: str, primary: Primary | None = None, id_: str = "replica", batch_bytes: int = BATCH_BYTES):
        self.engine = root if isinstance(root, Engine) else Engine(spark, root, read_only=True)
        self.spark, self.primary_root, self.checkpoint = spark, primary_root.rstrip("/"), checkpoint
        self.source = Store(spark, self.primary_root, create=False)
        self.state, self.query, self._lock = State(), None, threading.Lock()
        self.primary, self.id, self.batch_bytes = primary, id_, batch_bytes
        self.counters = {"received": 0, "applied": 0, "bytes": 0, "batches": 0, "errors": 0, "last_batch": 0.0, "apply_ns": 0, "apply_ns_min": 0, "apply_ns_max": 0}
        if primary is not None:
            primary.register(id_, self.applied_seq)

    @property
    def applied_seq(self) -> int:
        return self.engine.manifest.applied_seq

    def expected_next(self) -> int:
        return self.applied_seq + 1

    def apply(self, batch: DataFrame, _id: int = 0) -> None:
        """Apply records from elsewhere that follow on without a gap; ReplicationError if the first does not."""
        m = self.engine.manifest
        fresh = batch.where(F.col("seq") > m.applied_seq).dropDuplicates(["seq"])
        upto, gap = check_sequence(fresh, m.applied_seq)
        if upto is None and not gap:
            self.counters["batches"] += 1
            return
        if upto is None:
            self.counters["errors"] += 1
            raise ReplicationError("sequence_gap", f"expected {m.applied_seq + 1}")
        self._write(fresh.where(F.col("seq") <= upto), upto)
        if gap:
            self.counters["errors"] += 1

    def _write(self, rows: DataFrame, upto: int) -> None:
        """Records up to a number as one commit of the copy."""
        began, store, m = time.perf_counter_ns(), self.engine.store, self.engine.manifest
        segment = store.write_numbered(rows.withColumn("op", F.when(F.col("op") == MERGE, F.lit(PUT)).otherwise(F.col("op"))))
        if self.state.now == "applying":
            self.state.to("syncing")
        segments = m.segments if segment is None else (*m.segments, segment)
        store.commit(m, segments=segments, next_seq=upto + 1, applied_seq=upto)
        took, c = time.perf_counter_ns() - began, self.counters
        n = segment.rows if segment else 0
        c["apply_ns_min"] = min(c["apply_ns_min"] or took, took)
        c |= {"received": c["received"] + n, "applied": c["applied"] + n, "bytes": c["bytes"] + (segment.size if segment else 0), "batches": c["batches"] + 1}
        c |= {"last_batch": time.time(), "apply_ns": c["apply_ns"] + took, "apply_ns_max": max(c["apply_ns_max"], took)}

    def poll(self) -> int:
        """Apply what the primary has committed by now; the last applied number."""
        with self._lock:
            try:
                if self.state.now in ("connecting", "waiting"):
                    self.state.to("streaming")
                there, applied = self.source.manifest(), self.applied_seq
                if applied < there.trimmed_seq:
                    if self.primary is not None:
                        self.primary.negative(self.id, applied + 1)
                    raise ReplicationError("retention", f"the log from {applied + 1} on is no longer there")
                for commits in batches_of(self.source.commits(there, applied), self.batch_bytes):
                    if self.state.now == "acknowledging":
                        self.state.to("streaming")
                    self.state.to("applying")
                    rows = self.source.stored([s.path for s in commits]).where(F.col("seq") > applied)
                    self._write(rows, max(s.max_seq for s in commits))
                    self.state.to("acknowledging")
                    if self.primary is not None:
                        self.primary.acknowledge(self.id, self.applied_seq)
                if self.primary is not None:
                    self.primary.heartbeat(self.id)
                self.state.to("waiting")
                return self.applied_seq
            except Exception as error:
                self.counters["errors"] += 1
                self.state.to("error", error)
                raise

    def start(self, available_now: bool = False, every: str = "1 second") -> StreamingQuery:
        """Follow the primary: each batch of new versions is the sign to poll."""
        if self.state.now == "error":
            self.state.to("connecting")
        writer = read_versions(self.spark, self.primary_root).writeStream.foreachBatch(lambda _batch, _id: self.poll() and None)
        writer = writer.option("checkpointLocation", self.checkpoint)
        writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)
        self.query = writer.start()
        return self.query

    def catch_up(self) -> int:
        """Apply all that the primary has committed by now; the last applied number."""
        self.state = State() if self.state.now == "stopped" else self.state
        self.start(available_now=True).awaitTermination()
        # a version that was still being written when the stream listed it
        return self.poll()

    def stop(self) -> None:
        if self.query is not None and self.query.isActive:
            self.query.stop()
        self.state.to("stopped")


@dataclass
class Session:
    id: str
    last_ack: int = 0
    connected: bool = True
    active: bool = True
    last_activity: float = 0.0


class Primary:
    """Keeps track of the copies: acknowledgements, resend requests, heartbeats, and the log they still need."""

    #: Seconds between checks of the sessions, and without a sign of life until one counts as gone (fixed values).
    HEARTBEAT, TIMEOUT = 10.0, 30.0

    def __init__(self, engine: Engine):
        self.engine, self.sessions, self._lock = engine, {}, threading.RLock()
        self._beat: threading.Thread | None = None
        self._stopping = threading.Event()

    def start(self, every_s: float | None = None) -> None:
        """Check the sessions again and again in the background, and let go of log that no live copy needs."""
        if self._beat is None:
            self._stopping.clear()
            self._beat = threading.Thread(target=self._again, args=(self.HEARTBEAT if every_s is None else every_s,), daemon=True)
            self._beat.start()

    def _again(self, every_s: float) -> None:
        while not self._stopping.wait(every_s):
            self.check_sessions()
            try:
                self.trim_log()
            except StoreError:
                # another writer came first: the next round does it
                self.engine.stats.track_error("trim_log")

    def stop(self) -> None:
        if self._beat is not None:
            self._stopping.set()
            self._beat.join()
            self._beat = None

    def heartbeat(self, id_: str, now: float | None = None) -> None:
        """A sign of life of a copy; one that was taken for gone is back."""
        with self._lock:
            s = self.sessions[id_]
            s.connected, s.last_activity = True, time.time() if now is None else now

    def negative(self, id_: str, missing: int, now: float | None = None) -> int:
        """A negative acknowledgement: the copy needs records from ``missing`` on, so none of them may go."""
        with self._lock:
            s = self.sessions[id_]
            s.last_ack, s.last_activity = min(s.last_ack, missing - 1), time.time() if now is None else now
            return s.last_ack

    def register(self, id_: str, start_seq: int = 0, now: float | None = None) -> Session:
        with self._lock:
            s = self.sessions[id_] = Session(id_, start_seq, last_activity=time.time() if now is None else now)
            return s

    def stream(self, id_: str, limit: int = 100) -> DataFrame:
        """Committed records after what the copy has acknowledged, ``limit`` at most."""
        return self.engine.entries_from(self.sessions[id_].last_ack + 1).limit(limit)

    def acknowledge(self, id_: str, seq: int, now: float | None = None) -> int:
        """Acknowledgements only move on; the number now acknowledged."""
        with self._lock:
            s = self.sessions[id_]
            s.last_ack, s.last_activity = max(s.last_ack, seq), time.time() if now is None else now
            return s.last_ack

    def resend_from(self, id_: str, missing: int, limit: int = 100) -> DataFrame:
        """The answer to a negative acknowledgement: records from the missing one on."""
        return self.engine.entries_from(missing).limit(limit)

    def check_sessions(self, now: float | None = None) -> list[str]:
        now = time.time() if now is None else now
        with self._lock:
            gone = [s.id for s in self.sessions.values() if s.connected and now - s.last_activity > self.TIMEOUT]
            for i in gone:
                self.sessions[i].connected = False
        return gone

    def replicas(self) -> DataFrame:
        rows = [(s.id, s.last_ack, s.connected, s.active) for s in self.sessions.values()]
        return self.engine.spark.createDataFrame(rows, "id string, last_ack long, connected boolean, active boolean")

    def trim_log(self) -> int:
        """Let go of flushed segments that every live copy has acknowledged."""
        least = least_acknowledged(self.replicas()).first().min_ack if self.sessions else None
        return self.engine.manage_retention(min_seq=least + 1) if least else 0

    def node_info(self) -> dict:
        return {"role": "PRIMARY", "last_sequence": self.engine.manifest.next_seq - 1, "read_only": self.engine.read_only, "replicas": [vars(s) for s in self.sessions.values()]}


class Manager:
    """A node's part in replication: alone, primary, or a copy that is read-only until it is promoted."""

    def __init__(self, engine: Engine, role: str = "STANDALONE", primary_root: str = "", checkpoint: str = "", link: Primary | None = None, id_: str = "replica"):
        if role not in ("STANDALONE", "PRIMARY", "REPLICA"):
            raise InvalidRecord(f"unknown role {role}")
        self.engine, self.role, self.primary_root, self.checkpoint, self.link, self.id = engine, role, primary_root, checkpoint, link, id_
        self.primary: Primary | None = None
        self.replica: Replica | None = None

    @property
    def running(self) -> bool:
        return self.primary is not None or self.replica is not None

    def start(self, every_s: float | None = None) -> None:
        if self.running:
            return
        if self.role == "PRIMARY":
            self.engine.read_only = False
            self.primary = Primary(self.engine)
            self.primary.start(every_s)
        elif self.role == "REPLICA":
            self.engine.read_only = True
            self.replica = Replica(self.engine.spark, self.primary_root, self.engine, self.checkpoint, self.link, self.id)
            self.replica.start(every=f"{every_s or 1.0} seconds")

    def stop(self) -> None:
        if self.primary is not None:
            self.primary.stop()
        if self.replica is not None:
            self.replica.stop()
        self.primary = self.replica = None

    def promote(self, every_s: float | None = None) -> None:
        """A copy applies what the primary has committed, and takes writes from then on."""
        if self.role != "REPLICA":
            raise StoreError(f"a {self.role} node is not promoted")
        if self.replica is not None:
            self.replica.query.stop()
            self.replica.poll()
        self.stop()
        self.role = "PRIMARY"
        self.start(every_s)

    def node_info(self) -> dict:
        copies = self.primary.node_info()["replicas"] if self.primary else []
        return {"role": self.role, "primary_address": self.primary_root, "replicas": copies, "last_sequence": self.engine.manifest.next_seq - 1, "read_only": self.engine.read_only}

    def status(self) -> dict:
        out = self.node_info() | {"running": self.running}
        if self.replica is not None:
            out |= {"state": self.replica.state.now, "applied_seq": self.replica.applied_seq, "counters": dict(self.replica.counters)}
        return out


def apply_stream(store: Store, log: DataFrame, checkpoint: str) -> None:
    """Append a stream of (seq, op, key, value) to a store until what is there has been read: a batch is a commit, made once.

    No state is kept by key and nothing is rewritten; flushes and compactions fold the log as for any other.
    """

    def append(batch: DataFrame, id_: int) -> None:
        m = store.manifest()
        if id_ < m.applied_seq:
            return
        segment = store.write_numbered(batch)
        segments, last = ((*m.segments, segment), segment.max_seq) if segment else (m.segments, 0)
        store.commit(m, segments=segments, next_seq=max(m.next_seq, last + 1), applied_seq=id_ + 1)

    log.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
