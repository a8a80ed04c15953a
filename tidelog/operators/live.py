"""Views of a log: newest record per key, live keys, layers, versions, positions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.functions.keys import Bytes, lit
from tidelog.model import DELETE, PUT
from tidelog.session import keep

#: Rows of a driver-side key list that are sent to every task; more are joined by a shuffle.
SMALL_KEYS = 10_000


def latest(log: DataFrame) -> DataFrame:
    """``(key, seq, op, value)`` of the newest record of each key, tombstones included.

    One aggregate with partial maxima: a key with many versions is reduced before the shuffle. Filters on
    ``key`` pass through to the scan; filters on other columns stay above, where they belong.
    """
    newest = F.max_by(F.struct("seq", "op", "value"), "seq").alias("r")
    return log.groupBy("key").agg(newest).select("key", "r.seq", "r.op", "r.value")


def live(log: DataFrame) -> DataFrame:
    """``(key, value)`` of the keys whose newest record is not a tombstone."""
    return latest(log).where(F.col("op") != DELETE).select("key", "value")


def as_of(log: DataFrame, seq: int) -> DataFrame:
    """The live view as it was after record ``seq``."""
    return live(log.where(F.col("seq") <= seq))


def tombstones(log: DataFrame) -> DataFrame:
    return latest(log).where(F.col("op") == DELETE).select("key", "seq")


def versions(log: DataFrame, partitions: int | None = None) -> DataFrame:
    """All records with ``version``, 1 for the newest of its key.

    Records are dealt by ranges of (key, newest first), so that a key of a third of all records is many ranges. Each range
    numbers its own, and of the few keys that go on from one range to the next the counts before are added.
    """
    order = ["key", F.desc("seq")]
    dealt = log.repartitionByRange(partitions, *order) if partitions else log.repartitionByRange(*order)
    dealt = keep(dealt.withColumn("range", F.spark_partition_id()), "version-ranges")
    ends = dealt.groupBy("range").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    reaching = ends.select(F.explode(F.array("first", "last")).alias("key")).distinct()
    counts = dealt.join(F.broadcast(reaching), "key").groupBy("key", "range").agg(F.count("*").alias("n"))
    before = counts.select("key", "range", (F.sum("n").over(W.partitionBy("key").orderBy("range")) - F.col("n")).alias("before"))
    out = dealt.withColumn("nth", F.row_number().over(W.partitionBy("range", "key").orderBy(F.desc("seq"))))
    out = out.join(F.broadcast(before), ["key", "range"], "left")
    return out.select(*log.columns, (F.col("nth") + F.coalesce("before", F.lit(0))).cast("int").alias("version"))


def merge_layers(*layers: DataFrame) -> DataFrame:
    """Newest-first layers of (key, value, is_tombstone), merged: per key the record of the first layer that has it.

    Within a layer a key stands once. Tombstones stay in the result, as a reader of the merged layers sees them.
    """
    ranked = [x.select("key", "value", "is_tombstone", F.lit(i).alias("layer")) for i, x in enumerate(layers)]
    out = ranked[0]
    for x in ranked[1:]:
        out = out.unionByName(x)
    first = F.min_by(F.struct("value", "is_tombstone", "layer"), "layer").alias("r")
    return out.groupBy("key").agg(first).select("key", "r.value", "r.is_tombstone", "r.layer")


def overlay(base: DataFrame, delta: DataFrame) -> DataFrame:
    """``(key, value)`` of a live base under newer changes of (key, op, value), one a key.

    The base is known to be unique and free of tombstones, so it is not merged again: keys that the delta
    touches leave it (Spark sends a small delta to the base's tasks), and the delta's puts join.
    """
    kept = base.select("key", "value").join(delta.select("key"), "key", "left_anti")
    return kept.unionByName(delta.where(F.col("op") == PUT).select("key", "value"))


def get(log: DataFrame, key: Bytes) -> DataFrame:
    return live(log.where(F.col("key") == lit(key)))


def multi_get(log: DataFrame, keys: DataFrame) -> DataFrame:
    """``(key, value)`` for each distinct key of ``keys``; value is null where the key is not live."""
    asked = keys.select("key").distinct()
    wanted = log.join(asked, "key", "left_semi")
    return asked.join(live(wanted), "key", "left")


def key_list(df: DataFrame, keys: list[Bytes]) -> DataFrame:
    """``keys`` as a DataFrame whose key has the type it has in ``df``; broadcast while the list is short."""
    spark = df.sparkSession
    kind = df.schema["key"].dataType.simpleString()
    out = spark.createDataFrame([(k if isinstance(k, str) else bytearray(k),) for k in keys], f"key {kind}")
    return F.broadcast(out) if len(keys) <= SMALL_KEYS else out


def status(log: DataFrame, keys: DataFrame) -> DataFrame:
    """``(key, status)``: ``live``, ``deleted`` or ``unknown`` for each distinct key of ``keys``."""
    asked = keys.select("key").distinct()
    found = latest(log.join(asked, "key", "left_semi")).select("key", "op")
    state = F.when(F.col("op").isNull(), "unknown").when(F.col("op") == DELETE, "deleted").otherwise("live")
    return asked.join(found, "key", "left").select("key", state.alias("status"))


def contains(log: DataFrame, keys: DataFrame) -> DataFrame:
    """Keys of which the log holds any record, a tombstone too."""
    return keys.select("key").distinct().join(log.select("key"), "key", "left_semi")


def seek(view: DataFrame, target: Bytes) -> DataFrame:
    """The first row with key >= target."""
    return view.where(F.col("key") >= lit(target)).orderBy("key").limit(1)


def seek_first(view: DataFrame) -> DataFrame:
    return view.orderBy("key").limit(1)


def seek_last(view: DataFrame) -> DataFrame:
    return view.orderBy(F.desc("key")).limit(1)


def following(view: DataFrame, key: Bytes, n: int = 1) -> DataFrame:
    """The ``n`` rows after ``key``."""
    return view.where(F.col("key") > lit(key)).orderBy("key").limit(n)


def _followed(rows: DataFrame, by: str, name: str, partitions: int | None) -> DataFrame:
    """Each row with the next value of ``by`` as ``name``, null for the last.

    A window over all would be one task. Rows are dealt by range instead, in as many ranges as a shuffle has partitions (adaptive
    execution joins small ones, and an outlying value moves no others); each range is ordered by itself and
    ends with the first value of a later one, of which there are as many as ranges.
    """
    dealt = rows.repartitionByRange(partitions, by) if partitions else rows.repartitionByRange(by)
    dealt = keep(dealt.withColumn("range", F.spark_partition_id()), "ranges")
    firsts = dealt.groupBy("range").agg(F.min(by).alias("first"))
    heads = firsts.select("range", F.lead("first").over(W.orderBy("range")).alias("later"))
    inside = F.lead(by).over(W.partitionBy("range").orderBy(by))
    out = dealt.withColumn("inside", inside).join(F.broadcast(heads), "range")
    return out.select(*rows.columns, F.coalesce("inside", "later").alias(name))


def with_next_key(view: DataFrame, partitions: int | None = None) -> DataFrame:
    """Each row with ``next_key``, null for the last."""
    return _followed(view, "key", "next_key", partitions)


def entries_from(log: DataFrame, seq: int) -> DataFrame:
    """Records from ``seq`` on, in order."""
    return log.where(F.col("seq") >= seq).orderBy("seq")


def explode_batches(batches: DataFrame) -> DataFrame:
    """Records of batches of (base_seq, ops): the operation at position p has seq base_seq + p."""
    return batches.select("base_seq", F.posexplode("ops").alias("pos", "o")).select((F.col("base_seq") + F.col("pos")).alias("seq"), "o.op", "o.key", "o.value")


def last_of_batch(ops: DataFrame, batch: str = "batch_id", position: str = "pos") -> DataFrame:
    """Of the operations of a batch on one key, the last by position."""
    last = F.max_by(F.struct(position, "op", "value"), position).alias("r")
    return ops.groupBy(batch, "key").agg(last).select(batch, "key", f"r.{position}", "r.op", "r.value")


def sequence_gaps(log: DataFrame, partitions: int | None = None) -> DataFrame:
    """``(after_seq, next_seq)`` around each hole in the sequence; no record of any number is one."""
    rows = log.where(F.col("seq").isNotNull()).select(F.col("seq").alias("after_seq"))
    return _followed(rows, "after_seq", "next_seq", partitions).where(F.col("next_seq") > F.col("after_seq") + 1)
