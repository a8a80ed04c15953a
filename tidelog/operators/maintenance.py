"""Flush, compaction, tombstone and log retention: policies as plain functions and Columns, work as DataFrames."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.keys import Bytes, in_range, lit
from tidelog.model import DELETE, STORED
from tidelog.sources.config import Config
from tidelog.session import keep as kept
from tidelog.sources.store import Manifest, Segment, Store, Table

# tombstone policies: Columns over (key, op, deleted_at, forced, level) that say whether a row stays


def keep_by_level(level: Column, most: int) -> Column:
    """Without a record of deletions a tombstone stays down to level ``most``."""
    return (F.col("op") != DELETE) | (level <= most)


def keep_tracked(now: Column, hours: float) -> Column:
    """Kept if forced, or if its deletion is on record and younger than the retention."""
    young = F.col("deleted_at").isNotNull() & (now < F.col("deleted_at") + F.make_interval(secs=F.lit(hours * 3600)))
    return (F.col("op") != DELETE) | F.coalesce(F.col("forced"), F.lit(False)) | F.coalesce(young, F.lit(False))


def keep_by_time(now: Column, seconds: float) -> Column:
    """A deletion that is not on record stays; one on record stays up to its age."""
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("deleted_at").cast("timestamp"))
    return (F.col("op") != DELETE) | F.when(F.col("deleted_at").isNull(), F.lit(True)).otherwise(age <= seconds * 1e6)


def keep_by_key_range(start: Bytes, end: Bytes, inside: Column) -> Column:
    """Keys outside [start, end) stay; inside another policy decides."""
    return F.when(~in_range("key", start, end), F.lit(True)).otherwise(inside)


# flush


def flush_needed(size: int, oldest: float, now: float, config: Config) -> bool:
    return size >= config.memtable_bytes or (size > 0 and now - oldest > config.memtable_age_s)


def newest(records: DataFrame) -> DataFrame:
    """The newest stored record of each key."""
    fields = [c for c in STORED.fieldNames() if c != "key"]
    return records.groupBy("key").agg(F.max_by(F.struct(*fields), "seq").alias("r")).select("key", "r.*")


def flush(store: Store, m: Manifest) -> Manifest:
    """The newest record of each key of the segments not yet flushed becomes a level-0 table, tombstones included."""
    open_ = [s for s in m.segments if s.max_seq > m.flushed_seq]
    if not open_:
        return m
    fresh = store.stored([s.path for s in open_]).where(F.col("seq") > m.flushed_seq)
    table = store.write_table(newest(fresh), 0, m.next_table, m.config, sum(s.size for s in open_))
    upto = max(s.max_seq for s in open_)
    return store.commit(m, tables=m.tables + ((table,) if table else ()), next_table=m.next_table + 1, flushed_seq=upto)


# compaction


@dataclass(frozen=True)
class Task:
    inputs: tuple[Table, ...]
    target: int
    #: A lone table over an empty level moves as it is.
    move: bool = False


def _oldest(tables: list[Table]) -> Table:
    return min(tables, key=lambda t: (t.sequence, t.timestamp))


def _with_overlaps(chosen: list[Table], tables: tuple[Table, ...], level: int) -> tuple[Table, ...]:
    firsts, lasts = [t.first_key for t in chosen if t.first_key], [t.last_key for t in chosen if t.last_key]
    hit = [t for t in tables if t.level == level and firsts and t.overlaps(min(firsts), max(lasts))]
    return tuple(chosen + hit)


def select_compaction(m: Manifest) -> Task | None:
    """Level 0 first, when it has ``max_memtables`` tables, with what they overlap on level 1; then the first level that
    lies above an empty one, or outweighs the next by ``compaction_ratio``: its oldest table and the overlaps."""
    by: dict[int, list[Table]] = {}
    for t in m.tables:
        by.setdefault(t.level, []).append(t)
    if len(by.get(0, [])) >= m.config.max_memtables:
        return Task(_with_overlaps(by[0], m.tables, 1), 1)
    for level in range(m.config.levels - 1):
        own, next_ = by.get(level, []), by.get(level + 1, [])
        if level == 0 or not own:
            continue
        if not next_:
            return Task((_oldest(own),), level + 1, move=True)
        if sum(t.size for t in own) / max(1, sum(t.size for t in next_)) >= m.config.compaction_ratio:
            return Task(_with_overlaps([_oldest(own)], m.tables, level + 1), level + 1)
    return None


def range_task(m: Manifest, start: bytes | None, end: bytes | None) -> Task | None:
    """Every table that meets the closed range [start, end], to one level below the lowest of them."""
    lo, hi = (start or b"").hex(), "g" if end is None else end.hex()
    hit = [t for t in m.tables if t.overlaps(lo, hi)]
    if not hit:
        return None
    # tables of the levels between that overlap the merged stretch go along, so that newer stays above older
    while True:
        lo, hi = min(t.first_key for t in hit), max(t.last_key for t in hit)
        more = [t for t in m.tables if t not in hit and t.overlaps(lo, hi)]
        if not more:
            break
        hit += more
    return Task(tuple(hit), min(max(t.level for t in hit) + 1, m.config.levels - 1))


def compact(store: Store, m: Manifest, task: Task, now: float | None = None, keep: Callable[[DataFrame], DataFrame] | None = None) -> Manifest:
    """Merge the task's tables, newest record first, into one table of its target level.

    A tombstone may go only when its retention is over and no table outside the task can hold an older version
    of its key: then the task's inputs include all that overlap at the target level and below. Its age is that of its
    record; one without a time stays down to ``max_level_with_tombstones``.
    """
    now = time.time() if now is None else now
    if task.move:
        only = task.inputs[0]
        return store.commit(m, tables=tuple(replace(t, level=task.target) if t == only else t for t in m.tables))
    merged = newest(store.stored([t.path for t in task.inputs]))
    paths = {t.path for t in task.inputs}
    firsts, lasts = [t.first_key for t in task.inputs if t.first_key], [t.last_key for t in task.inputs if t.last_key]
    below = [t for t in m.tables if t.path not in paths and firsts and t.overlaps(min(firsts), max(lasts))]
    if keep is not None:
        merged = keep(merged)
    elif not below:
        dated = merged.withColumnRenamed("deleted_at", "micros").withColumn("deleted_at", F.timestamp_micros("micros"))
        dated = dated.withColumn("forced", F.lower(F.hex("key")).isin(list(m.forced)) if m.forced else F.lit(False))
        undated = F.col("deleted_at").isNull() & keep_by_level(F.lit(task.target), m.config.max_level_with_tombstones)
        stays = keep_tracked(F.timestamp_micros(F.lit(int(now * 1e6))), m.config.tombstone_retention_h) | undated
        merged = dated.where(stays).drop("deleted_at", "forced").withColumnRenamed("micros", "deleted_at")
    table = store.write_table(merged, task.target, m.next_table, m.config, sum(t.size for t in task.inputs))
    tables = tuple(t for t in m.tables if t.path not in paths) + ((table,) if table else ())
    return store.commit(m, tables=tables, next_table=m.next_table + 1, obsolete=m.obsolete + tuple(sorted(paths)))


# log retention


def expired_segments(m: Manifest, now: float, most: int = 0, age_s: float = 0, min_seq: int = 0) -> list[Segment]:
    """Segments that any rule lets go: too many, too old, or wholly below ``min_seq``. The newest never goes, nor does
    one that is not flushed yet."""
    inner = sorted(m.segments, key=lambda s: s.max_seq)[:-1]
    gone = set()
    if most > 0 and len(m.segments) > most:
        gone |= set(inner[: len(m.segments) - most])
    if age_s > 0:
        gone |= {s for s in inner if now - s.created > age_s}
    if min_seq > 0:
        gone |= {s for s in inner if s.max_seq < min_seq}
    return [s for s in inner if s in gone and s.max_seq <= m.flushed_seq]


def manage_retention(store: Store, m: Manifest, now: float | None = None, most: int = 0, age_s: float = 0, min_seq: int = 0) -> tuple[Manifest, int]:
    gone = expired_segments(m, time.time() if now is None else now, most, age_s, min_seq)
    if not gone:
        return m, 0
    left = tuple(s for s in m.segments if s not in gone)
    trimmed = max(m.trimmed_seq, *(s.max_seq for s in gone))
    return store.commit(m, segments=left, trimmed_seq=trimmed, obsolete=m.obsolete + tuple(s.path for s in gone)), len(gone)


def overlap_pairs(files: DataFrame, id_col: str = "part", partitions: int | None = None) -> DataFrame:
    """``(a, b)``, a < b: every two files whose closed ranges of (first_key, last_key) meet. Files without keys meet none.

    An equality join on bins of the first keys: a file starts in one bin, reaches into those up to its last key, and is paired
    in each with the files that start there within its range. So a pair is looked at once, and files that lie apart are not.
    """
    rows = files.where(F.col("first_key").isNotNull() & F.col("last_key").isNotNull()).select(F.col(id_col).alias("id"), "first_key", "last_key")
    dealt = rows.repartitionByRange(partitions, "first_key") if partitions else rows.repartitionByRange("first_key")
    dealt = kept(dealt.withColumn("bin", F.spark_partition_id()), "file-ranges")
    # as many as partitions
    lows = [(r.bin, r.low) for r in dealt.groupBy("bin").agg(F.min("first_key").alias("low")).orderBy("bin").collect()]
    if not lows:
        return rows.select(F.col("id").alias("a"), F.col("id").alias("b"))
    edges = F.array(*[F.struct(F.lit(b).alias("bin"), lit(bytes(low) if isinstance(low, bytearray) else low).alias("low")) for b, low in lows])
    reached = F.filter(edges, lambda e: (e["bin"] >= F.col("bin")) & (e["low"] <= F.col("last_key")))
    spread = dealt.select("id", "first_key", "last_key", F.explode(F.transform(reached, lambda e: e["bin"])).alias("bin"))
    x, y = spread.alias("x"), dealt.alias("y")
    after = (F.col("y.first_key") > F.col("x.first_key")) | ((F.col("y.first_key") == F.col("x.first_key")) & (F.col("y.id") > F.col("x.id")))
    pairs = x.join(y, (F.col("x.bin") == F.col("y.bin")) & after & (F.col("y.first_key") <= F.col("x.last_key")))
    return pairs.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))
