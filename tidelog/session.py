"""Session settings the library relies on, and the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_fallback: dict[str, str] = {}


def local_session(app: str = "tidelog", cores: str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A single-machine session for tests, the benchmark and the shell."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder is used, but only by a local master:
    on a cluster no other machine would see it, so that is an error.
    """
    found = spark.conf.get(CHECKPOINT_KEY, None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _fallback:
        _fallback[app] = tempfile.mkdtemp(prefix="tidelog-shared-")
    return _fallback[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tidelog/{name}-{uuid.uuid4().hex}"


_scopes: list[list[str]] = []


def keep(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage and outlives any executor; what is read twice is computed once. Rows that differ in ``by`` are in files of
    their own. The table stays until ``forget``, or the end of the ``passing`` block it was made in.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path, partitionBy=list(by) or None)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_path = path
    if _scopes:
        _scopes[-1].append(path)
    return out


def forget(*tables: DataFrame) -> None:
    """Remove kept tables that nothing will read again."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.kept_path)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def clearing(spark: SparkSession) -> Iterator[None]:
    """What a query shuffles meanwhile goes from the disks as it ends, not when the driver happens to collect its garbage."""
    before = spark.conf.get(CLEANUP_KEY)
    spark.conf.set(CLEANUP_KEY, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP_KEY, before)


@contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables kept meanwhile are removed at the end, but for those handed to the function that it gives, which belong to the
    block around it. What is read from them must have been written by then."""
    _scopes.append([])
    stay: list[str] = []

    def spare(table: DataFrame) -> DataFrame:
        stay.append(table.kept_path)
        return table

    try:
        yield spare
    finally:
        for made in _scopes.pop():
            if made in stay:
                if _scopes:
                    _scopes[-1].append(made)
                continue
            path = spark._jvm.org.apache.hadoop.fs.Path(made)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
