"""Settings of a store, checked and kept in its manifest."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields

from tidelog.model import InvalidRecord

SYNC_MODES = ("none", "batch", "immediate")


@dataclass(frozen=True)
class Config:
    """The defaults are fixed values of the data model; ``none`` leaves writes on the driver until a flush or close."""

    sync_mode: str = "batch"
    sync_bytes: int = 1024 * 1024
    memtable_bytes: int = 32 * 1024 * 1024
    memtable_age_s: int = 600
    max_memtables: int = 4
    compaction_ratio: float = 10.0
    levels: int = 7
    max_level_with_tombstones: int = 1
    tombstone_retention_h: float = 24.0
    wal_max_segments: int = 0
    wal_max_age_s: int = 0
    table_files: int = 8
    file_bytes: int = 256 * 1024 * 1024
    bloom_rate: float = 0.01
    commit_retries: int = 3
    #: Files that no version names are taken for a dead writer's after so many seconds, and for an unfinished commit's before.
    orphan_age_s: int = 3600

    def __post_init__(self) -> None:
        wrong = []
        if self.sync_mode not in SYNC_MODES:
            wrong.append(f"sync_mode is one of {SYNC_MODES}")
        for name in ("sync_bytes", "memtable_bytes", "memtable_age_s", "max_memtables", "levels", "table_files", "file_bytes"):
            if getattr(self, name) <= 0:
                wrong.append(f"{name} is positive")
        if self.compaction_ratio <= 1:
            wrong.append("compaction_ratio is above 1")
        if not 0 < self.bloom_rate < 1:
            wrong.append("bloom_rate is between 0 and 1")
        if wrong:
            raise InvalidRecord("; ".join(wrong))

    def updated(self, **changes) -> Config:
        return Config(**(asdict(self) | changes))

    @classmethod
    def loaded(cls, stored: dict) -> Config:
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in stored.items() if k in known})
