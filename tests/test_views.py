import random

import pytest
from pyspark.sql import functions as F

from tidelog.operators import live as L
from tidelog.operators import maintenance as M
from tidelog.operators.scan import Scanner, filter_keys, scan
from tidelog.operators.transactions import overlay_writes, staleness

SCHEMA = "seq long, op string, key binary, value binary"


def log_of(spark, rows):
    return spark.createDataFrame([(s, o, bytearray(k), None if v is None else bytearray(v)) for s, o, k, v in rows], SCHEMA)


def pairs(df):
    return [(bytes(r.key), bytes(r.value)) for r in df.collect()]


def test_newest_wins_whatever_the_order(spark):
    log = log_of(spark, [(3, "PUT", b"key", b"value3"), (2, "PUT", b"key", b"value2"), (1, "PUT", b"key", b"value1")])
    assert pairs(L.live(log)) == [(b"key", b"value3")]
    assert [r.version for r in L.versions(log).orderBy("version").collect()] == [1, 2, 3]


def test_empty_value_is_not_deleted(spark):
    log = log_of(spark, [(1, "PUT", b"a", b""), (2, "PUT", b"b", b"x"), (3, "DELETE", b"b", None)])
    assert pairs(L.live(log)) == [(b"a", b"")]
    found = {bytes(r.key): r.status for r in L.status(log, L.key_list(log, [b"a", b"b", b"c"])).collect()}
    assert found == {b"a": "live", b"b": "deleted", b"c": "unknown"}
    assert L.contains(log, L.key_list(log, [b"b", b"c"])).count() == 1


def layer(spark, rows):
    return spark.createDataFrame([(bytearray(k), None if v is None else bytearray(v), v is None) for k, v in rows], "key binary, value binary, is_tombstone boolean")


def test_layers(spark):
    new, old = layer(spark, [(b"a", b"v1a"), (b"c", b"v1c"), (b"e", b"v1e")]), layer(spark, [(b"b", b"v2b"), (b"c", b"v2c"), (b"d", b"v2d")])
    assert pairs(L.merge_layers(new, old).orderBy("key")) == [(b"a", b"v1a"), (b"b", b"v2b"), (b"c", b"v1c"), (b"d", b"v2d"), (b"e", b"v1e")]
    new = layer(spark, [(b"a", b"v1a"), (b"c", None)])
    merged = L.merge_layers(new, old).orderBy("key")
    assert [r.is_tombstone for r in merged.collect()] == [False, False, True, False]
    assert [k for k, _ in pairs(merged.where("not is_tombstone"))] == [b"a", b"b", b"d"]


def test_bounds_prefix_suffix(spark):
    view = spark.createDataFrame([(bytearray(k), bytearray(b"1")) for k in (b"a", b"b", b"c", b"d", b"e")], "key binary, value binary")
    names = lambda df: [bytes(r.key) for r in df.collect()]
    assert names(scan(view, start=b"b", end=b"d")) == [b"b", b"c"]
    assert names(scan(view, start=b"bb", end=b"d")) == [b"c"]
    assert names(scan(view, start=b"d")) == [b"d", b"e"] and names(scan(view, end=b"b")) == [b"a"]
    assert names(scan(view, limit=2)) == [b"a", b"b"] and len(names(scan(view, limit=-1))) == 5
    assert names(scan(view, prefix=b"c", start=b"a", end=b"b")) == [b"c"]
    assert names(L.seek(view, b"bb")) == [b"c"] and names(L.seek_last(view)) == [b"e"] and names(L.seek_first(view)) == [b"a"]
    assert names(L.seek(view, b"z")) == []
    assert sorted(names(filter_keys(view, lambda k: k in (b"a", b"e")))) == [b"a", b"e"]


def test_scanner(spark):
    view = spark.createDataFrame([(bytearray(b"k%d" % i), bytearray(b"v%d" % i)) for i in range(10)], "key binary, value binary")
    s = Scanner(scan(view, start=b"k3", end=b"k7"))
    assert [k for k, _ in s] == [b"k3", b"k4", b"k5", b"k6"]
    assert not s.next() and s.error() is None
    s.close()
    assert s.key() is None


def test_transaction_view(spark):
    base = spark.createDataFrame([(bytearray(k), bytearray(b"s")) for k in (b"a", b"c", b"e")], "key binary, value binary")
    writes = spark.createDataFrame([(bytearray(b"b"), bytearray(b"t"), False), (bytearray(b"d"), bytearray(b"t"), False), (bytearray(b"c"), None, True)], "key binary, value binary, is_delete boolean")
    view = overlay_writes(base, writes)
    assert [k for k, _ in pairs(scan(view))] == [b"a", b"b", b"d", b"e"]
    assert [k for k, _ in pairs(scan(view, start=b"b", end=b"e"))] == [b"b", b"d"]


def test_batches_and_gaps(spark):
    batch = spark.createDataFrame([(1000, [("PUT", bytearray(b"a"), bytearray(b"1")), ("DELETE", bytearray(b"a"), None)])], "base_seq long, ops array<struct<op:string,key:binary,value:binary>>")
    assert [(r.seq, r.op) for r in L.explode_batches(batch).collect()] == [(1000, "PUT"), (1001, "DELETE")]
    seqs = spark.createDataFrame([(s,) for s in (1, 2, 5, 6, 9)], "seq long")
    for blocks in (1, 2, 1024):
        assert sorted(map(tuple, L.sequence_gaps(seqs, blocks).collect())) == [(2, 5), (6, 9)]
    assert L.sequence_gaps(seqs.where("seq > 9")).count() == 0


def test_next_key_over_many_ranges(spark):
    view = spark.range(500).select(F.format_string("%05d", "id").alias("key"))
    rows = {r.key: r.next_key for r in L.with_next_key(view, 7).collect()}
    assert rows["00000"] == "00001" and rows["00499"] is None and len(rows) == 500
    assert all(rows[f"{i:05d}"] == f"{i + 1:05d}" for i in range(499))


def test_random_log_against_a_dict(spark):
    rng, model, rows, cut = random.Random(5), {}, [], {}
    for seq in range(1, 600):
        key = b"k%d" % rng.randrange(60)
        if rng.random() < 0.3:
            rows.append((seq, "DELETE", key, None))
            model.pop(key, None)
        else:
            rows.append((seq, "PUT", key, b"v%d" % seq))
            model[key] = b"v%d" % seq
        if seq == 300:
            cut = dict(model)
    rng.shuffle(rows)
    log = log_of(spark, rows)
    assert pairs(scan(L.live(log))) == sorted(model.items())
    assert pairs(scan(L.as_of(log, 300))) == sorted(cut.items())


@pytest.mark.parametrize(("age", "idle", "read_only", "state"), [(10, 1, False, "ok"), (46, 1, False, "warning"), (55, 1, False, "critical"), (61, 1, False, "stale"), (61, 1, True, "ok"), (181, 1, True, "stale"), (40, 31, True, "stale")])
def test_staleness(age, idle, read_only, state):
    assert staleness(1000, 1000 - age, 1000 - idle, read_only) == state


def test_versions_of_a_hot_key(spark):
    """Half of all records are of one key, in several ranges; the numbers are those of one window."""
    rows = [(i, "hot" if i % 2 else f"k{i % 14:02d}") for i in range(400)]
    log = spark.createDataFrame(rows, "seq long, key string")
    for partitions in (1, 2, 7, 40):
        got = {(r.key, r.version): r.seq for r in L.versions(log, partitions).collect()}
        want = {}
        for seq, key in sorted(rows, reverse=True):
            want[key, sum(k == key for k, _ in want) + 1] = seq
        assert got == want


def test_overlaps_against_brute_force(spark):
    rng = random.Random(5)
    files = []
    for i in range(120):
        lo, width = rng.randrange(1000), rng.choice([0, 3, 30, 900])
        files.append((i, f"{lo:04d}", f"{lo + rng.randrange(width + 1):04d}"))
    files += [(200, None, None), (201, "0500", "0500"), (202, "0500", "0500")]
    df = spark.createDataFrame(files, "part long, first_key string, last_key string")
    want = sorted((a, b) for a, x, y in files for b, u, v in files if a < b and x and u and y >= u and x <= v)
    for partitions in (1, 5, 30):
        assert sorted(map(tuple, M.overlap_pairs(df, partitions=partitions).collect())) == want
    raw = df.select("part", F.col("first_key").cast("binary").alias("first_key"), F.col("last_key").cast("binary").alias("last_key"))
    pairs = M.overlap_pairs(raw)
    assert sorted(map(tuple, pairs.collect())) == want and M.overlap_pairs(df.where("part = 200")).count() == 0
    assert "NestedLoop" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_an_outlying_number_moves_no_others(spark):
    seqs = spark.createDataFrame([(i,) for i in [*range(1, 50), *range(60, 90), 2**62]], "seq long")
    assert sorted(map(tuple, L.sequence_gaps(seqs, 8).collect())) == [(49, 60), (89, 2**62)]
