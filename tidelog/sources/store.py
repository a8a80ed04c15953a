"""A store's files: log segments, sorted tables and the manifest whose versions make changes atomic."""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.keys import table_file
from tidelog.model import DELETE, KV, LOG, STORED, Conflict, StoreError, Write
from tidelog.operators.live import latest
from tidelog.session import keep
from tidelog.sources.config import Config
from tidelog.sources.files import Files


@dataclass(frozen=True)
class Segment:
    path: str
    min_seq: int
    max_seq: int
    rows: int
    size: int
    created: float


@dataclass(frozen=True)
class Table:
    path: str
    level: int
    sequence: int
    timestamp: int
    size: int
    key_count: int
    first_key: str | None
    last_key: str | None

    def overlaps(self, first: str | None, last: str | None) -> bool:
        """Keys are in hex, which keeps the order of bytes; an empty range overlaps nothing."""
        if None in (self.first_key, self.last_key, first, last):
            return False
        return self.last_key >= first and self.first_key <= last


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    next_seq: int = 1
    flushed_seq: int = 0
    applied_seq: int = 0
    next_table: int = 1
    segments: tuple[Segment, ...] = ()
    tables: tuple[Table, ...] = ()
    #: Keys in hex whose tombstones stay whatever their age, as asked for one by one.
    forced: tuple[str, ...] = ()
    #: The greatest number among segments that retention has let go.
    trimmed_seq: int = 0
    obsolete: tuple[str, ...] = ()
    config: Config = field(default_factory=Config)

    def dumps(self) -> bytes:
        return json.dumps(asdict(self), sort_keys=True).encode()

    @classmethod
    def loads(cls, raw: bytes) -> Manifest:
        x = json.loads(raw)
        x["segments"] = tuple(Segment(**s) for s in x["segments"])
        x["tables"] = tuple(Table(**t) for t in x["tables"])
        # versions of before kept every deletion here
        held = x.pop("deletions", {})
        x.pop("bulk_loads", None)
        x["forced"] = tuple(x.get("forced", [k for k, v in held.items() if v[1]]))
        x["obsolete"] = tuple(x["obsolete"])
        x["config"] = Config.loaded(x["config"])
        return cls(**x)


class Store:
    """Reads and commits versions of a store under ``root``; a reader pins a version and keeps seeing it."""

    def __init__(self, spark: SparkSession, root: str, config: Config | None = None, create: bool = True):
        self.spark, self.files = spark, Files(spark, root)
        if create and not self._versions():
            try:
                self.files.create(self._name(0), Manifest(config=config or Config()).dumps())
            except Conflict:
                pass

    @staticmethod
    def _name(version: int) -> str:
        return f"manifest/v{version:020d}.json"

    def _versions(self) -> list[int]:
        return [int(n[1:-5]) for n in self.files.names("manifest") if n.startswith("v") and n.endswith(".json")]

    def manifest(self, version: int | None = None) -> Manifest:
        """A version, by default the newest that is whole: one whose writer died while writing it never took place."""
        for v in sorted(self._versions(), reverse=True) if version is None else [version]:
            try:
                return Manifest.loads(self.files.read(self._name(v)))
            except (ValueError, KeyError, TypeError):
                continue
        raise StoreError(f"no readable version in {self.files.root}")

    def repair(self, now: float | None = None) -> int:
        """Remove what a writer that died has left: versions not written to their end, and files that were never committed.
        For the writer only; how many there were."""
        m, broken = self.manifest(), 0
        for v in self._versions():
            if v > m.version:
                self.files.delete(self._name(v))
                broken += 1
        return broken + len(self.remove_orphans(m, now))

    def remove_orphans(self, m: Manifest, now: float | None = None) -> list[str]:
        """Delete segments and tables that no version names and that are too old to belong to a commit under way."""
        known = {s.path for s in m.segments} | {t.path for t in m.tables} | set(m.obsolete)
        before = (time.time() if now is None else now) - m.config.orphan_age_s
        gone = [f"{folder}/{name}" for folder in ("log", "tables") for name, changed in self.files.aged(folder) if f"{folder}/{name}" not in known and changed <= before]
        for path in gone:
            self.files.delete(path)
        return gone

    def history(self) -> list[int]:
        return self._versions()

    def commit(self, before: Manifest, **changes) -> Manifest:
        """The next version, or Conflict if another writer has made it."""
        after = replace(before, version=before.version + 1, **changes)
        self.files.create(self._name(after.version), after.dumps())
        return after

    # reading

    def stored(self, paths: list[str]) -> DataFrame:
        """The records of segments and tables, with the times of deletions."""
        if not paths:
            return self.spark.createDataFrame([], STORED)
        return self.spark.read.schema(STORED).parquet(*[self.files.url(p) for p in paths])

    def _read(self, paths: list[str]) -> DataFrame:
        return self.stored(paths).select(LOG.fieldNames())

    def log(self, m: Manifest) -> DataFrame:
        """All records that segments still hold."""
        return self._read([s.path for s in m.segments])

    def commits(self, m: Manifest, after: int = 0) -> list[Segment]:
        """Segments with records after a number, in order: each is one commit, and none is of a writer that died before it."""
        return sorted((s for s in m.segments if s.max_seq > after), key=lambda s: s.min_seq)

    def records(self, m: Manifest) -> DataFrame:
        """Records that decide the present: tables, and the segments not flushed into them."""
        paths = [t.path for t in m.tables] + [s.path for s in m.segments if s.max_seq > m.flushed_seq]
        return self._read(paths)

    # writing

    def write_segment(self, m: Manifest, writes: list[Write], first_seq: int | None = None) -> Segment:
        """Consecutive numbers from ``first_seq`` (the next free one) on; the segment counts once it is committed."""
        first = m.next_seq if first_seq is None else first_seq
        now = int(time.time() * 1e6)
        rows = [(first + i, w.op, bytearray(w.key), None if w.value is None else bytearray(w.value), now if w.op == DELETE else None) for i, w in enumerate(writes)]
        path = f"log/{first:020d}-{uuid.uuid4().hex[:12]}"
        self.spark.createDataFrame(rows, STORED).coalesce(1).write.parquet(self.files.url(path))
        return Segment(path, first, first + len(rows) - 1, len(rows), self.files.size(path), time.time())

    def write_numbered(self, rows: DataFrame) -> Segment | None:
        """A segment of rows that already have their numbers; None for no rows. Deletions without a time are of now."""
        path = f"log/{uuid.uuid4().hex}"
        now = F.lit(int(time.time() * 1e6))
        known = F.coalesce("deleted_at", now) if "deleted_at" in rows.columns else now
        rows = rows.withColumn("deleted_at", F.when(F.col("op") == DELETE, known))
        rows.select(STORED.fieldNames()).write.parquet(self.files.url(path))
        lo, hi, n = self._read([path]).agg(F.min("seq"), F.max("seq"), F.count("*")).first()
        if not n:
            self.files.delete(path)
            return None
        return Segment(path, lo, hi, n, self.files.size(path), time.time())

    def write_bulk(self, m: Manifest, rows: DataFrame) -> Segment | None:
        """A segment from a DataFrame of (op, key, value): numbers are consecutive in the order of its partitions.

        Rows are written once to fix their order, partitions are counted, and each row gets its partition's offset.
        """
        at = F.monotonically_increasing_id()
        placed = keep(rows.select("op", F.col("key").cast("binary"), F.col("value").cast("binary"), at.alias("at")), "bulk")
        part, nth = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
        counts = placed.groupBy(part.alias("part")).count().orderBy("part").collect()
        begin, offsets = m.next_seq, []
        for r in counts:
            offsets.append((r["part"], begin))
            begin += r["count"]
        if not offsets:
            return None
        offset = F.broadcast(self.spark.createDataFrame(offsets, "part long, begin long"))
        return self.write_numbered(placed.withColumn("part", part).join(offset, "part").withColumn("seq", F.col("begin") + nth))

    def write_table(self, rows: DataFrame, level: int, sequence: int, config: Config, size: int = 0) -> Table | None:
        """Unique keys as sorted Parquet with a bloom filter on the key; None for no rows.

        ``size``, the bytes that went in, sets the number of key ranges and so of files.
        """
        stamp, files = time.time_ns(), max(config.table_files, -(-size // config.file_bytes))
        path = f"tables/{table_file(level, sequence, stamp)}"
        dealt = rows.select(STORED.fieldNames()).repartitionByRange(files, "key").sortWithinPartitions("key")
        dealt.write.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.fpp#key", str(config.bloom_rate)).parquet(self.files.url(path))
        first, last, n = self._read([path]).agg(F.min("key"), F.max("key"), F.count("*")).first()
        if not n:
            self.files.delete(path)
            return None
        return Table(path, level, sequence, stamp, self.files.size(path), n, bytes(first).hex(), bytes(last).hex())

    def file_info(self, m: Manifest) -> DataFrame:
        schema = "path string, level int, sequence long, timestamp long, size long, key_count long, first_key string, last_key string"
        return self.spark.createDataFrame([tuple(asdict(t).values()) for t in m.tables], schema)

    def vacuum(self, m: Manifest, pinned: set[str] = frozenset()) -> Manifest:
        """Delete files that no version from this one on refers to, but for those a reader has pinned."""
        gone = [p for p in m.obsolete if p not in pinned]
        for p in gone:
            self.files.delete(p)
        return self.commit(m, obsolete=tuple(p for p in m.obsolete if p in pinned)) if gone else m


def live_table(records: DataFrame) -> DataFrame:
    return latest(records).where("op <> 'DELETE'").select(*KV.fieldNames())
