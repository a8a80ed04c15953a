"""One query for each operation, over the driver's tables, with the SQL that gives the same rows.

``events`` is the log: event_id orders it, errors are deletions, and a key is a user and one of seven slots.
Keys stay strings here, so that two engines can compare them; UTF-8 keeps the order of bytes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import bloom, keys, records
from tidelog.model import DELETE, MAX_KEY_BYTES, MAX_VALUE_BYTES
from tidelog.operators import live as L
from tidelog.operators import maintenance as M
from tidelog.operators import stats as S
from tidelog.operators.scan import filter_keys, scan
from tidelog.operators.transactions import overlay_writes
from tidelog.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

_LOG = """log AS (
  SELECT event_id + 1 AS seq, CASE WHEN event_type = 'error' THEN 'DELETE' ELSE 'PUT' END AS op,
         'user:' || lpad(CAST(user_id AS VARCHAR), 6, '0') || ':' || CAST(event_id % 7 AS VARCHAR) AS key,
         CASE WHEN event_type = 'error' THEN NULL ELSE props END AS value, ts, user_id
  FROM events),
latest AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1),
live AS (SELECT key, value FROM latest WHERE op = 'PUT'),
parts AS (SELECT *, CAST(floor((seq - 1) / 1000) AS BIGINT) AS part FROM log),
flushed AS (SELECT * FROM parts QUALIFY row_number() OVER (PARTITION BY part, key ORDER BY seq DESC) = 1),
files AS (SELECT part, min(key) AS first_key, max(key) AS last_key, count(*) AS key_count,
                 CAST(sum(octet_length(encode(key)) + coalesce(octet_length(encode(value)), 0)) AS BIGINT) AS size
          FROM flushed GROUP BY part)"""


def query(sql: str | None = None, bare: bool = False) -> Callable[[Query], Query]:
    """Register a query under its function's name, with SQL over the views above."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql if bare else f"WITH {_LOG}\n{sql}"
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_log(events: DataFrame) -> DataFrame:
    deleted = F.col("event_type") == "error"
    slot = (F.col("event_id") % 7).cast("string")
    return events.select(
        (F.col("event_id") + 1).alias("seq"),
        F.when(deleted, DELETE).otherwise("PUT").alias("op"),
        F.concat(F.lit("user:"), F.lpad(F.col("user_id").cast("string"), 6, "0"), F.lit(":"), slot).alias("key"),
        F.when(~deleted, F.col("props")).alias("value"),
        "ts",
        "user_id",
    )


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_log(table(spark, sf_dir, "events"))


def view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.live(log(spark, sf_dir))


def flushed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per 1,000 records the newest of each key, as a flush of so many writes makes it."""
    part = F.floor((F.col("seq") - 1) / 1000).alias("part")
    newest = F.max_by(F.struct("seq", "op", "value", "ts"), "seq").alias("r")
    return log(spark, sf_dir).groupBy(part, "key").agg(newest).select("part", "key", "r.*")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))
    return flushed(spark, sf_dir).groupBy("part").agg(F.min("key").alias("first_key"), F.max("key").alias("last_key"), F.count("*").alias("key_count"), F.sum(size).cast("long").alias("size"))


# the live view and what it is made of


@query("SELECT key, value FROM live")
def live_view(spark, sf_dir):
    return view(spark, sf_dir)


@query("SELECT key, value FROM live")
def live_view_window(spark, sf_dir):
    return L.versions(log(spark, sf_dir)).where("version = 1 AND op = 'PUT'").select("key", "value")


@query("SELECT key, seq FROM latest WHERE op = 'DELETE'")
def tombstones(spark, sf_dir):
    return L.tombstones(log(spark, sf_dir))


@query("SELECT key, seq, op, value, CAST(row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS INTEGER) AS version FROM log")
def version_history(spark, sf_dir):
    return L.versions(log(spark, sf_dir)).select("key", "seq", "op", "value", "version")


@query("SELECT key, value FROM (SELECT * FROM log WHERE seq <= 5000 QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) WHERE op = 'PUT'")
def as_of_seq(spark, sf_dir):
    return L.as_of(log(spark, sf_dir), 5000)


@query("SELECT seq, op, key, value FROM log WHERE seq >= 700")
def entries_from(spark, sf_dir):
    return L.entries_from(log(spark, sf_dir), 700).select("seq", "op", "key", "value")


# points


@query("SELECT key, value FROM live WHERE key = 'user:000010:3'")
def point_get(spark, sf_dir):
    return L.get(log(spark, sf_dir), "user:000010:3")


_ASKED = ["user:000001:0", "user:000010:3", "user:000020:6", "user:000042:1", "user:999999:0"]
_ASKED_SQL = "(VALUES " + ", ".join(f"('{k}')" for k in _ASKED) + ") AS asked(key)"


@query(f"SELECT asked.key, live.value FROM {_ASKED_SQL} LEFT JOIN live ON asked.key = live.key")
def multi_get(spark, sf_dir):
    rows = log(spark, sf_dir)
    return L.multi_get(rows, L.key_list(rows, _ASKED))


@query("""SELECT a.key, CASE WHEN l.op IS NULL THEN 'unknown' WHEN l.op = 'DELETE' THEN 'deleted' ELSE 'live' END AS status
FROM (SELECT DISTINCT key FROM log UNION SELECT 'user:999999:0') a LEFT JOIN latest l ON a.key = l.key""")
def is_deleted_status(spark, sf_dir):
    rows = log(spark, sf_dir)
    return L.status(rows, rows.select("key").union(L.key_list(rows, ["user:999999:0"])))


@query(f"SELECT key FROM {_ASKED_SQL} WHERE key IN (SELECT key FROM log)")
def contains(spark, sf_dir):
    rows = log(spark, sf_dir)
    return L.contains(rows, L.key_list(rows, _ASKED))


# scans


@query("SELECT key, value FROM live")
def full_scan(spark, sf_dir):
    return scan(view(spark, sf_dir))


@query("SELECT key, value FROM live WHERE key >= 'user:000010' AND key < 'user:000020'")
def range_scan(spark, sf_dir):
    return scan(view(spark, sf_dir), start="user:000010", end="user:000020")


@query("SELECT key, value FROM live WHERE key < 'user:000020'")
def range_open_start(spark, sf_dir):
    return scan(view(spark, sf_dir), end="user:000020")


@query("SELECT key, value FROM live WHERE key >= 'user:000020'")
def range_open_end(spark, sf_dir):
    return scan(view(spark, sf_dir), start="user:000020")


@query("SELECT key, value FROM live WHERE starts_with(key, 'user:00001')")
def prefix_scan(spark, sf_dir):
    return scan(view(spark, sf_dir), prefix="user:00001")


@query("SELECT key, value FROM live WHERE suffix(key, ':3')")
def suffix_scan(spark, sf_dir):
    return scan(view(spark, sf_dir), suffix=":3")


@query("SELECT key, value FROM live WHERE starts_with(key, 'user:00001') AND suffix(key, ':3')")
def prefix_suffix_scan(spark, sf_dir):
    return scan(view(spark, sf_dir), prefix="user:00001", suffix=":3")


@query("SELECT key, value FROM live WHERE starts_with(key, 'user:00001')")
def scan_precedence(spark, sf_dir):
    return scan(view(spark, sf_dir), prefix="user:00001", start="user:000015", end="user:000016")


@query("SELECT key, value FROM live ORDER BY key LIMIT 25")
def scan_limit(spark, sf_dir):
    return scan(view(spark, sf_dir), limit=25)


@query("SELECT key, value FROM live")
def scan_limit_zero(spark, sf_dir):
    return scan(view(spark, sf_dir), limit=0)


@query("SELECT key, value FROM live WHERE substr(key, 13, 1) IN ('1', '5')")
def key_filter(spark, sf_dir):
    return scan(view(spark, sf_dir), where=F.substring("key", 13, 1).isin("1", "5"))


@query("SELECT key, value FROM live WHERE substr(key, 13, 1) IN ('1', '5')")
def key_filter_callable(spark, sf_dir):
    return filter_keys(view(spark, sf_dir), lambda k: k[12] in "15")


@query("SELECT key, value FROM live WHERE key >= 'user:000010:35' ORDER BY key LIMIT 1")
def seek(spark, sf_dir):
    return L.seek(view(spark, sf_dir), "user:000010:35")


@query("SELECT key, value FROM live ORDER BY key LIMIT 1")
def seek_first(spark, sf_dir):
    return L.seek_first(view(spark, sf_dir))


@query("SELECT key, value FROM live ORDER BY key DESC LIMIT 1")
def seek_last(spark, sf_dir):
    return L.seek_last(view(spark, sf_dir))


@query("SELECT key, value FROM live WHERE key > 'user:000010:3' ORDER BY key LIMIT 1")
def following(spark, sf_dir):
    return L.following(view(spark, sf_dir), "user:000010:3")


@query("SELECT key, lead(key) OVER (ORDER BY key) AS next_key FROM live")
def next_key(spark, sf_dir):
    return L.with_next_key(view(spark, sf_dir)).select("key", "next_key")


# batches and transactions


def _batches(spark, sf_dir) -> DataFrame:
    at = F.floor((F.col("seq") - 1) / 10)
    ops = F.transform(F.array_sort(F.collect_list(F.struct("seq", "op", "key", "value"))), lambda o: F.struct(o.op, o.key, o.value))
    return log(spark, sf_dir).groupBy(at.alias("b")).agg(F.min("seq").alias("base_seq"), ops.alias("ops"))


@query("SELECT seq, op, key, value FROM log")
def batch_explode(spark, sf_dir):
    return L.explode_batches(_batches(spark, sf_dir))


@query("""SELECT CAST(floor((seq - 1) / 100) AS BIGINT) AS batch_id, key, (seq - 1) % 100 AS pos, op, value FROM log
QUALIFY row_number() OVER (PARTITION BY floor((seq - 1) / 100), key ORDER BY seq DESC) = 1""")
def batch_last_op_wins(spark, sf_dir):
    batch = F.floor((F.col("seq") - 1) / 100).alias("batch_id")
    return L.last_of_batch(log(spark, sf_dir).select(batch, ((F.col("seq") - 1) % 100).alias("pos"), "op", "key", "value"))


_SPLIT = 600
_TX_SQL = f"""old AS (SELECT * FROM log WHERE seq <= {_SPLIT} QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1),
new AS (SELECT * FROM log WHERE seq > {_SPLIT} QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1),
tx AS (SELECT key, value FROM old WHERE op = 'PUT' AND key NOT IN (SELECT key FROM new)
       UNION ALL SELECT key, value FROM new WHERE op = 'PUT')"""


def _tx_view(spark, sf_dir) -> DataFrame:
    rows = log(spark, sf_dir)
    writes = L.latest(rows.where(F.col("seq") > _SPLIT)).select("key", "value", (F.col("op") == DELETE).alias("is_delete"))
    return overlay_writes(L.as_of(rows, _SPLIT), writes)


@query("SELECT key, value FROM tx")
def tx_overlay(spark, sf_dir):
    return _tx_view(spark, sf_dir)


@query("SELECT key, value FROM tx WHERE key >= 'user:000010' AND key < 'user:000030'")
def tx_overlay_range(spark, sf_dir):
    return scan(_tx_view(spark, sf_dir), start="user:000010", end="user:000030")


@query("SELECT key, value FROM old WHERE op = 'PUT'")
def tx_rollback(spark, sf_dir):
    return L.as_of(log(spark, sf_dir), _SPLIT)


for _name in ("tx_overlay", "tx_overlay_range", "tx_rollback"):
    _SQL[_name] = _SQL[_name].replace(f"WITH {_LOG}", f"WITH {_LOG},\n{_TX_SQL}")


# layers, flush, compaction


def _layer(rows: DataFrame, where: str) -> DataFrame:
    return L.latest(rows.where(where)).select("key", "value", (F.col("op") == DELETE).alias("is_tombstone"))


_LAYERS = ["seq > 800", "seq > 400 AND seq <= 800", "seq <= 400"]


@query("""SELECT key, value, op = 'DELETE' AS is_tombstone,
       CAST(CASE WHEN seq > 800 THEN 0 WHEN seq > 400 THEN 1 ELSE 2 END AS INTEGER) AS layer FROM latest""")
def layered_merge(spark, sf_dir):
    rows = log(spark, sf_dir)
    return L.merge_layers(*(_layer(rows, w) for w in _LAYERS))


@query("SELECT part, key, seq, op, value FROM flushed")
def flush_l0(spark, sf_dir):
    return flushed(spark, sf_dir).select("part", "key", "seq", "op", "value")


@query("SELECT key, value FROM live")
def compact_all(spark, sf_dir):
    return L.live(flushed(spark, sf_dir))


@query("SELECT key, value, op = 'DELETE' AS is_tombstone FROM latest WHERE key >= 'user:000010' AND key < 'user:000030'")
def compact_range(spark, sf_dir):
    rows = log(spark, sf_dir).where(keys.in_range("key", "user:000010", "user:000030"))
    return L.merge_layers(*(_layer(rows, w) for w in _LAYERS)).select("key", "value", "is_tombstone")


_LEVELLED = "SELECT key, seq, op, CAST(part % 4 AS INTEGER) AS level, ts FROM flushed"


def _levelled(spark, sf_dir) -> DataFrame:
    return flushed(spark, sf_dir).withColumn("level", (F.col("part") % 4).cast("int"))


@query(f"SELECT key, seq, level FROM ({_LEVELLED}) WHERE op <> 'DELETE' OR level <= 1")
def tombstone_filter_basic(spark, sf_dir):
    return _levelled(spark, sf_dir).where(M.keep_by_level(F.col("level"), 1)).select("key", "seq", "level")


_TRACKED_SQL = "SELECT key, seq, op, CASE WHEN seq % 3 > 0 THEN ts END AS deleted_at, seq % 5 = 0 AS forced, TIMESTAMP '2024-01-02 00:00:00' AS now_ts FROM latest"


def _tracked(spark, sf_dir) -> tuple[DataFrame, F.Column]:
    newest = F.max_by(F.struct("seq", "op", "ts"), "seq").alias("r")
    rows = log(spark, sf_dir).groupBy("key").agg(newest).select("key", "r.*")
    rows = rows.withColumn("deleted_at", F.when(F.col("seq") % 3 > 0, F.col("ts"))).withColumn("forced", F.col("seq") % 5 == 0)
    return rows, F.lit("2024-01-02 00:00:00").cast("timestamp")


@query(f"""SELECT key, seq, op FROM ({_TRACKED_SQL})
WHERE op <> 'DELETE' OR forced OR coalesce(now_ts < deleted_at + INTERVAL 24 HOUR, false)""")
def tombstone_filter_tracked(spark, sf_dir):
    rows, now = _tracked(spark, sf_dir)
    return rows.where(M.keep_tracked(now, 24)).select("key", "seq", "op")


@query(f"""SELECT key, seq, op FROM ({_TRACKED_SQL})
WHERE op <> 'DELETE' OR deleted_at IS NULL OR epoch_us(CAST(now_ts AS TIMESTAMP)) - epoch_us(CAST(deleted_at AS TIMESTAMP)) <= 43200000000""")
def tombstone_filter_time(spark, sf_dir):
    rows, now = _tracked(spark, sf_dir)
    return rows.where(M.keep_by_time(now, 43200)).select("key", "seq", "op")


@query(f"""SELECT key, seq, level FROM ({_LEVELLED})
WHERE NOT (key >= 'user:000010' AND key < 'user:000100') OR op <> 'DELETE' OR level <= 1""")
def tombstone_filter_keyrange(spark, sf_dir):
    rows = _levelled(spark, sf_dir)
    return rows.where(M.keep_by_key_range("user:000010", "user:000100", M.keep_by_level(F.col("level"), 1))).select("key", "seq", "level")


@query("SELECT part, first_key, last_key, key_count, size FROM files")
def table_info(spark, sf_dir):
    return files(spark, sf_dir)


@query("SELECT a.part AS a, b.part AS b FROM files a JOIN files b ON a.part < b.part AND a.last_key >= b.first_key AND a.first_key <= b.last_key")
def overlap_pairs(spark, sf_dir):
    return M.overlap_pairs(files(spark, sf_dir))


@query("SELECT CAST(part % 4 AS INTEGER) AS level, CAST(sum(size) AS BIGINT) AS size, count(*) AS files FROM files GROUP BY 1")
def level_sizes(spark, sf_dir):
    return S.level_sizes(files(spark, sf_dir).withColumn("level", (F.col("part") % 4).cast("int")))


@query("""SELECT part, CAST(part % 4 AS INTEGER) AS level FROM files f
WHERE part % 4 = 0 OR (part % 4 = 1 AND first_key <= (SELECT max(last_key) FROM files WHERE part % 4 = 0)
                       AND last_key >= (SELECT min(first_key) FROM files WHERE part % 4 = 0))""")
def compaction_inputs(spark, sf_dir):
    """Level 0 and the tables of level 1 that it overlaps."""
    f = files(spark, sf_dir).withColumn("level", (F.col("part") % 4).cast("int"))
    reach = f.where("level = 0").agg(F.min("first_key").alias("lo"), F.max("last_key").alias("hi"))
    hit = f.join(F.broadcast(reach), (F.col("level") == 1) & keys.overlaps(F.col("first_key"), F.col("last_key"), F.col("lo"), F.col("hi")))
    return f.where("level = 0").select("part", "level").union(hit.select("part", "level"))


# the log as files


@query("SELECT part AS file, min(seq) AS min_seq, max(seq) AS max_seq, count(*) AS n FROM parts GROUP BY part")
def log_file_bounds(spark, sf_dir):
    return S.sequence_bounds(log(spark, sf_dir).withColumn("file", F.floor((F.col("seq") - 1) / 1000)))


@query("SELECT part AS file FROM parts GROUP BY part HAVING max(seq) < 3500 AND part < (SELECT max(part) FROM parts)")
def log_retention(spark, sf_dir):
    b = S.sequence_bounds(log(spark, sf_dir).withColumn("file", F.floor((F.col("seq") - 1) / 1000)))
    newest = b.agg(F.max("file").alias("newest"))
    return b.join(F.broadcast(newest), F.col("file") < F.col("newest")).where(F.col("max_seq") < 3500).select("file")


@query("""SELECT prev AS after_seq, seq AS next_seq
FROM (SELECT seq, lag(seq) OVER (ORDER BY seq) AS prev FROM log WHERE op = 'PUT') WHERE seq <> prev + 1""")
def sequence_gaps(spark, sf_dir):
    return L.sequence_gaps(log(spark, sf_dir).where("op = 'PUT'"))


@query("SELECT coalesce(max(seq), 0) + 1 AS next_seq FROM log")
def next_sequence(spark, sf_dir):
    return S.next_sequence(log(spark, sf_dir))


@query("SELECT min(last_ack) AS min_ack FROM (SELECT user_id, max(seq) AS last_ack FROM log GROUP BY user_id) WHERE user_id % 3 > 0 AND user_id % 7 > 0")
def min_ack(spark, sf_dir):
    r = log(spark, sf_dir).groupBy("user_id").agg(F.max("seq").alias("last_ack"))
    return S.least_acknowledged(r.withColumn("connected", F.col("user_id") % 3 > 0).withColumn("active", F.col("user_id") % 7 > 0))


@query("SELECT seq, op, key, value FROM log")
def record_codec(spark, sf_dir):
    """Records serialised and read again."""
    raw = log(spark, sf_dir).select(records.encode_records("seq", "op", F.col("key").cast("binary"), F.col("value").cast("binary")).alias("raw"))
    # a generator, so that the filter is not computed from the bytes once more
    out = raw.select(F.explode(F.array(records.decode_records("raw"))).alias("r")).where("r.error IS NULL")
    return out.select("r.seq", "r.op", F.col("r.key").cast("string").alias("key"), F.col("r.value").cast("string").alias("value"))


@query("SELECT seq, seq % 7 <> 0 AND seq % 11 <> 0 AS ok FROM log WHERE value IS NOT NULL")
def crc32_check(spark, sf_dir):
    """Values against their checksums, after each seventh value and each eleventh checksum was damaged."""
    rows = log(spark, sf_dir).where("value IS NOT NULL").withColumn("checksum", F.crc32("value"))
    rows = rows.withColumn("value", F.when(F.col("seq") % 7 == 0, F.concat("value", F.lit("!"))).otherwise(F.col("value")))
    rows = rows.withColumn("checksum", F.when(F.col("seq") % 11 == 0, F.col("checksum").bitwiseXOR(F.lit(1).cast("long"))).otherwise(F.col("checksum")))
    return rows.select("seq", records.checksum_ok("value", "checksum").alias("ok"))


# statistics


@query("SELECT count(*) AS key_count, CAST(sum(octet_length(encode(key)) + octet_length(encode(value))) AS BIGINT) AS storage_size FROM live")
def stats_key_count(spark, sf_dir):
    return S.key_stats(view(spark, sf_dir))


_OPS_SQL = "(SELECT event_type AS op, CAST(round(value * 1000) AS BIGINT) AS latency_ns, ts, CASE WHEN event_type = 'error' THEN 'e' || CAST(user_id % 4 AS VARCHAR) END AS error, event_type <> 'view' AS is_write, octet_length(encode(props)) AS bytes FROM events)"


def _ops(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("op"),
        F.round(F.col("value") * 1000).cast("long").alias("latency_ns"),
        "ts",
        F.when(F.col("event_type") == "error", F.concat(F.lit("e"), (F.col("user_id") % 4).cast("string"))).alias("error"),
        (F.col("event_type") != "view").alias("is_write"),
        F.octet_length("props").cast("long").alias("bytes"),
    )


@query(f"SELECT op, count(*) AS n FROM {_OPS_SQL} GROUP BY op", bare=True)
def stats_ops(spark, sf_dir):
    return S.operation_counts(_ops(spark, sf_dir))


@query(f"SELECT op, count(*) AS count, CAST(sum(latency_ns) // count(*) AS BIGINT) AS avg_ns, min(latency_ns) AS min_ns, max(latency_ns) AS max_ns FROM {_OPS_SQL} WHERE latency_ns IS NOT NULL GROUP BY op", bare=True)
def stats_latency(spark, sf_dir):
    return S.latencies(_ops(spark, sf_dir))


@query(f"SELECT error, count(*) AS n FROM {_OPS_SQL} WHERE error IS NOT NULL GROUP BY error", bare=True)
def stats_errors(spark, sf_dir):
    return S.error_counts(_ops(spark, sf_dir))


@query(f"SELECT op, max(ts) AS last_ts FROM {_OPS_SQL} GROUP BY op", bare=True)
def stats_last_op(spark, sf_dir):
    return S.last_operations(_ops(spark, sf_dir))


@query(f"SELECT CAST(coalesce(sum(bytes) FILTER (is_write), 0) AS BIGINT) AS bytes_written, CAST(coalesce(sum(bytes) FILTER (NOT is_write), 0) AS BIGINT) AS bytes_read FROM {_OPS_SQL}", bare=True)
def stats_bytes(spark, sf_dir):
    return S.traffic(_ops(spark, sf_dir))


@query(f"SELECT op AS name, count(*) AS n FROM {_OPS_SQL} WHERE starts_with(op, 'p') GROUP BY op", bare=True)
def stats_prefix(spark, sf_dir):
    return S.named(S.operation_counts(_ops(spark, sf_dir)).withColumnRenamed("op", "name"), "p")


@query(f"SELECT bytes AS size FROM {_OPS_SQL} ORDER BY ts DESC, bytes DESC LIMIT 1", bare=True)
def stats_latest_size(spark, sf_dir):
    return S.latest_size(_ops(spark, sf_dir).withColumnRenamed("bytes", "size"))


_BLOOM = [(n, p) for n in (1000, 10_000, 1_000_000) for p in (0.1, 0.01, 0.001)]


@query(f"""SELECT n, p, m, k, round(pow(1 - exp(-(k * n) / CAST(m AS DOUBLE)), k), 9) AS fpr
FROM (SELECT n, p, m, CAST(greatest(1, round(m / CAST(n AS DOUBLE) * ln(2))) AS BIGINT) AS k
      FROM (SELECT n, p, CAST(ceil(-n * ln(p) / (ln(2) * ln(2))) AS BIGINT) AS m
            FROM (VALUES {", ".join(f"(CAST({n} AS BIGINT), CAST({p} AS DOUBLE))" for n, p in _BLOOM)}) AS t(n, p)))""", bare=True)
def bloom_params(spark, sf_dir):
    t = spark.createDataFrame(_BLOOM, "n long, p double").withColumn("m", bloom.bits(F.col("n"), F.col("p")))
    t = t.withColumn("k", bloom.hashes(F.col("m"), F.col("n")))
    return t.withColumn("fpr", F.round(bloom.false_positives(F.col("m"), F.col("k"), F.col("n")), 9))


@query(f"""SELECT kind, id, size BETWEEN 1 AND {MAX_KEY_BYTES} AS ok_key, size <= {MAX_VALUE_BYTES} AS ok_value FROM (
SELECT 'document' AS kind, doc_id AS id, octet_length(encode(text)) AS size FROM documents
UNION ALL SELECT 'page', page_id, octet_length(encode(html)) FROM pages)""", bare=True)
def size_validation(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.col("text").alias("x"))
    p = table(spark, sf_dir, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("x"))
    return d.union(p).select("kind", "id", keys.valid_key("x").alias("ok_key"), keys.valid_value("x").alias("ok_value"))


@query("SELECT url AS key, octet_length(encode(html)) AS size FROM pages WHERE url >= 'http' AND url < 'httq'", bare=True)
def kv_pages(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select(F.col("url").alias("key"), F.col("html").alias("value"))
    return scan(rows, start="http", end="httq").select("key", F.octet_length("value").cast("long").alias("size"))


@query("""SELECT 'conv:' || lpad(CAST(conv_id AS VARCHAR), 6, '0') || ':' || lpad(CAST(turn AS VARCHAR), 4, '0') AS key, text AS value
FROM conversations WHERE conv_id < 10""", bare=True)
def kv_conversations(spark, sf_dir):
    key = F.concat(F.lit("conv:"), F.lpad(F.col("conv_id").cast("string"), 6, "0"), F.lit(":"), F.lpad(F.col("turn").cast("string"), 4, "0"))
    return scan(table(spark, sf_dir, "conversations").select(key.alias("key"), F.col("text").alias("value")), prefix="conv:00000")


_TURN = "'conv:' || lpad(CAST(conv_id AS VARCHAR), 6, '0') || ':' || lpad(CAST(turn AS VARCHAR), 4, '0')"


@query(f"SELECT {_TURN} AS key, text AS value, lead({_TURN}) OVER (ORDER BY {_TURN}) AS next_key FROM conversations", bare=True)
def kv_conversations_all(spark, sf_dir):
    """Every turn, with the key of the one after it."""
    key = F.concat(F.lit("conv:"), F.lpad(F.col("conv_id").cast("string"), 6, "0"), F.lit(":"), F.lpad(F.col("turn").cast("string"), 4, "0"))
    rows = scan(table(spark, sf_dir, "conversations").select(key.alias("key"), F.col("text").alias("value")), prefix="conv:", ordered=False)
    return L.with_next_key(rows)


@query("""SELECT path, level, sequence, "timestamp" FROM (VALUES
('tables/0_000001_00000000000000000042', CAST(0 AS BIGINT), CAST(1 AS BIGINT), CAST(42 AS BIGINT)), ('3_000120_00000000000000000007.sst', 3, 120, 7),
('other.parquet', NULL, NULL, NULL)) AS t(path, level, sequence, "timestamp")""", bare=True)
def table_names(spark, sf_dir):
    names = [(f"tables/{keys.table_file(0, 1, 42)}",), (f"{keys.table_file(3, 120, 7)}.sst",), ("other.parquet",)]
    return spark.createDataFrame(names, "path string").select("path", *keys.table_file_parts("path"))


# whole systems


@query("SELECT key, value FROM live")
def engine_live(spark, sf_dir):
    """The log loaded into a store in bulk, flushed, changed by no one, compacted, and read."""
    from tidelog.plans.engine import Engine

    with Engine(spark, scratch_path(spark, "engine")) as engine:
        rows = log(spark, sf_dir).orderBy("seq").select("op", F.col("key").cast("binary"), F.col("value").cast("binary"))
        engine.apply_frame(rows)
        engine.flush()
        engine.compact_range()
        return engine.scan().select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


@query("SELECT key, value FROM live")
def streaming_apply(spark, sf_dir):
    """The events as a stream, appended to a store batch by batch, and read."""
    from tidelog.sources.store import Store
    from tidelog.streaming.replication import apply_stream

    schema = table(spark, sf_dir, "events").schema
    stream = event_log(spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events*"))
    out = scratch_path(spark, "stream")
    store = Store(spark, f"{out}/store")
    apply_stream(store, stream.select("seq", "op", F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value")), f"{out}/checkpoint")
    rows = L.live(store.records(store.manifest()))
    return rows.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


__all__ = ["event_log", "oracle_sql", "queries"]
