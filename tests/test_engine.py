import random
import time

import pytest
from pyspark.sql import functions as F

from tidelog.model import Conflict, InvalidRecord, KeyNotFound, ReadOnly, ReplicationError, StoreClosed, StoreError, TransactionClosed, TransactionNotFound, Write
from tidelog.operators.maintenance import expired_segments, flush_needed, select_compaction
from tidelog.operators.transactions import Registry
from tidelog.plans.engine import Engine, retry
from tidelog.plans.service import Client, Service, Shell
from tidelog.sources.config import Config
from tidelog.sources.store import Manifest, Segment, Store, Table
from tidelog.streaming.replication import Manager, Primary, Replica, State, batches_of, read_versions

SMALL = Config(table_files=2, max_memtables=2)


def items(df):
    return [(bytes(r.key), bytes(r.value)) for r in df.collect()]


def test_points_and_scan(spark, root):
    with Engine(spark, root, SMALL) as e:
        e.apply_batch([Write.put(b"test-key-%03d" % i, b"value-%03d" % i) for i in range(10)])
        assert [k for k, _ in items(e.scan())] == [b"test-key-%03d" % i for i in range(10)]
        assert len(items(e.range(b"test-key-003", b"test-key-007"))) == 4
        e.put(b"empty", b"")
        e.delete(b"test-key-000")
        assert e.get(b"empty") == b""
        with pytest.raises(KeyNotFound):
            e.get(b"test-key-000")
        assert e.is_deleted(b"test-key-000") and not e.is_deleted(b"empty") and e.contains(b"test-key-000")
        with pytest.raises(KeyNotFound):
            e.is_deleted(b"never")
        assert {bytes(r.key): r.value for r in e.multi_get([b"empty", b"no"]).collect()} == {b"empty": b"", b"no": None}
        stats = e.get_stats()
        assert stats["key_count"] == 10 and stats["put_ops"] == 1 and e.get_stats("put")["put_latency"]["count"] == 1
    with pytest.raises(StoreClosed):
        e.put(b"a", b"b")
    with Engine(spark, root) as again:
        assert again.get(b"test-key-009") == b"value-009" and again.is_deleted(b"test-key-000")


def test_batches(spark, root):
    with Engine(spark, root, SMALL) as e:
        first = e.apply_batch([Write.put(b"k", b"1"), Write.delete(b"k"), Write.put(b"k", b"2")])
        assert first == 1 and e.get(b"k") == b"2" and e.manifest.next_seq == 4
        assert e.batch_write([]) is True
        with pytest.raises(InvalidRecord):
            e.batch_write([Write.put(b"good", b"1"), Write.put(b"", b"2")])
        assert not e.contains(b"good")
        e.append_numbered(100, [Write.put(b"x", b"1")])
        assert e.manifest.next_seq == 101
        with pytest.raises(InvalidRecord):
            e.append_numbered(50, [Write.put(b"x", b"0")])
        assert [r.seq for r in e.entries_from(3).collect()] == [3, 100] and e.entries_from(500).isEmpty()
        assert items(e.as_of(1)) == [(b"k", b"1")]


def test_flushes_and_compaction_against_a_dict(spark, root):
    rng, model = random.Random(3), {}
    with Engine(spark, root, SMALL) as e:
        for step in range(5):
            writes = []
            for _ in range(30):
                k = b"key-%02d" % rng.randrange(20)
                if rng.random() < 0.35:
                    writes.append(Write.delete(k))
                    model.pop(k, None)
                else:
                    v = b"v%d" % rng.randrange(10**6)
                    writes.append(Write.put(k, v))
                    model[k] = v
            e.apply_batch(writes)
            e.flush()
            if step in (2, 4):
                assert e.compact() >= 1
            assert items(e.scan()) == sorted(model.items())
        e.compact_range()
        assert items(e.scan()) == sorted(model.items())
        assert e.table_files().count() == 1
        e.vacuum()
        assert items(e.scan()) == sorted(model.items())


def test_tombstones_outlive_the_flush_and_go_after_retention(spark, root):
    with Engine(spark, root, SMALL.updated(tombstone_retention_h=0.0)) as e:
        e.apply_batch([Write.put(b"a", b"1"), Write.put(b"b", b"1")])
        e.flush()
        e.apply_batch([Write.delete(b"a"), Write.delete(b"b")])
        e.flush()
        assert items(e.scan()) == []
        e.force_keep_tombstone(b"b")
        e.compact_range()
        kept = [bytes(r.key) for r in e.store._read([t.path for t in e.manifest.tables]).collect()]
        assert kept == [b"b"]


def test_bulk_numbers_are_consecutive(spark, root):
    with Engine(spark, root, SMALL) as e:
        e.put(b"first", b"1")
        rows = spark.range(1000).repartition(7).select(F.lit("PUT").alias("op"), F.format_string("k%05d", "id").alias("key"), F.lit("v").alias("value"))
        assert e.apply_frame(rows) == 1000
        s = e.entries_from(1).agg(F.min("seq"), F.max("seq"), F.count_distinct("seq")).first()
        assert tuple(s) == (1, 1001, 1001)
        assert e.apply_frame(rows.where("false")) == 0


def test_transactions(spark, root):
    with Engine(spark, root, SMALL) as e:
        e.apply_batch([Write.put(k, b"s") for k in (b"a", b"c", b"e")])
        tx = e.begin()
        tx.put(b"b", b"t")
        tx.put(b"d", b"t")
        tx.delete(b"c")
        assert [k for k, _ in tx.iterate()] == [b"a", b"b", b"d", b"e"]
        assert [k for k, _ in tx.iterate(b"b", b"e")] == [b"b", b"d"]
        with pytest.raises(KeyNotFound):
            tx.get(b"c")
        assert tx.get(b"b") == b"t" and e.get(b"c") == b"s"
        with pytest.raises(StoreError):
            e.begin(timeout=0.01)
        tx.commit()
        with pytest.raises(TransactionClosed):
            tx.commit()
        assert tx.view().isEmpty()
        dropped = e.begin()
        dropped.put(b"no", b"1")
        dropped.rollback()
        assert not e.contains(b"no")
        ro = e.begin(read_only=True)
        with pytest.raises(ReadOnly):
            ro.put(b"x", b"y")
        assert ro.is_read_only() and ro.get(b"b") == b"t"
        ro.commit()
        assert e.transaction_stats() == {"started": 3, "completed": 2, "aborted": 1, "active": 0}


def test_counter(spark, root):
    with Engine(spark, root, SMALL) as e:
        e.put(b"n", b"0")
        for _ in range(4):
            tx = e.begin()
            tx.put(b"n", b"%d" % (int(tx.get(b"n")) + 1))
            tx.commit()
        assert e.get(b"n") == b"4"


def test_registry(spark, root):
    with Engine(spark, root, SMALL) as e:
        r = Registry(e)
        one = r.begin(True, "c1")
        two = r.begin(True, "c2")
        assert (one, two) == ("tx-1", "tx-2")
        assert r.clean_stale(time.time() + 31) == ["tx-1", "tx-2"]
        three = r.begin(False, "c1")
        assert r.clean_connection("c1") == [three]
        with pytest.raises(TransactionNotFound):
            r.get(three)
        r.begin(True)
        assert len(r.shutdown()) == 1 and e.transaction_stats()["active"] == 0


def test_conflict_and_broken_version(spark, root):
    a = Store(spark, root)
    m = a.manifest()
    a.commit(m, next_seq=5)
    with pytest.raises(Conflict):
        a.commit(m, next_seq=6)
    a.files.create("manifest/v00000000000000000002.json", b"{")
    assert a.manifest().version == 1
    a.repair()
    assert a.history() == [0, 1]
    tries = []

    def work():
        tries.append(1)
        if len(tries) < 3:
            raise Conflict("again")
        return "done"

    assert retry(work, 3, 0.001) == "done" and len(tries) == 3


def _t(level, seq, first, last, size=1):
    return Table(f"t{level}{seq}", level, seq, seq, size, 1, first.encode().hex(), last.encode().hex())


def test_policies():
    assert _t(0, 1, "a", "c").overlaps(*[x.encode().hex() for x in "bd"]) and not _t(0, 1, "a", "c").overlaps(b"e".hex(), b"g".hex())
    tables = (_t(0, 1, "a", "b"), _t(0, 2, "c", "d"), _t(0, 3, "e", "f"), _t(1, 1, "b", "c"), _t(1, 2, "x", "z"))
    task = select_compaction(Manifest(tables=tables, config=Config(max_memtables=2)))
    assert task.target == 1 and {t.path for t in task.inputs} == {"t01", "t02", "t03", "t11"}
    big = select_compaction(Manifest(tables=(_t(1, 2, "a", "b", 100), _t(1, 1, "c", "d", 100), _t(2, 1, "c", "e", 5)), config=Config()))
    assert big.target == 2 and [t.path for t in big.inputs] == ["t11", "t21"]
    assert select_compaction(Manifest(tables=(_t(0, 1, "a", "b"),), config=Config())) is None
    alone = select_compaction(Manifest(tables=(_t(1, 2, "a", "b"), _t(1, 1, "c", "d")), config=Config()))
    assert alone.target == 2 and [t.path for t in alone.inputs] == ["t11"]
    assert select_compaction(Manifest(tables=(_t(6, 2, "a", "b"),), config=Config())) is None
    segments = tuple(Segment(f"s{i}", 5 * i + 1, 5 * i + 5, 5, 1, 100.0 + i) for i in range(5))
    m = Manifest(segments=segments, flushed_seq=25)
    assert [s.path for s in expired_segments(m, 200, most=3)] == ["s0", "s1"]
    assert [s.path for s in expired_segments(m, 104, age_s=2)] == ["s0", "s1"]
    assert [s.path for s in expired_segments(m, 104, min_seq=11)] == ["s0", "s1"]
    assert expired_segments(Manifest(segments=segments, flushed_seq=3), 200, most=1) == []
    assert flush_needed(40 << 20, 0, 1, Config()) and flush_needed(1, 0, 601, Config()) and not flush_needed(0, 0, 601, Config())
    with pytest.raises(InvalidRecord):
        Config(compaction_ratio=1.0)
    with pytest.raises(InvalidRecord):
        Config(sync_mode="often")


def test_observers_config_and_retention(spark, root):
    seen = []

    class Observer:
        def on_entry(self, seq, write):
            seen.append(("entry", seq))

        def on_batch(self, seq, writes):
            seen.append(("batch", seq, len(writes)))

        def on_sync(self, seq):
            seen.append(("sync", seq))

    with Engine(spark, root, SMALL) as e:
        e.observe("o", Observer())
        e.put(b"a", b"1")
        e.apply_batch([Write.put(b"b", b"1"), Write.put(b"c", b"1")])
        e.unobserve("o")
        e.put(b"d", b"1")
        assert seen == [("entry", 1), ("sync", 1), ("batch", 2, 2)]
        assert e.update_config(levels=5).levels == 5
        e.flush()
        assert e.manage_retention(min_seq=3) == 1 and e.get(b"a") == b"1"


def test_read_only(spark, root):
    with Engine(spark, root, SMALL) as e:
        e.put(b"a", b"1")
    with Engine(spark, root, read_only=True) as r:
        assert r.get(b"a") == b"1" and r.begin().is_read_only()
        with pytest.raises(ReadOnly):
            r.put(b"b", b"1")
        assert r.put_internal(b"b", b"1") == 2


def test_states():
    s = State()
    for name in ("streaming", "applying", "syncing", "acknowledging", "waiting", "error", "connecting"):
        s.to(name)
    with pytest.raises(ReplicationError):
        s.to("applying")


def test_replica_catches_up_in_order(spark, root, tmp_path):
    with Engine(spark, root, SMALL) as e:
        e.apply_batch([Write.put(b"k%d" % i, b"1") for i in range(5)])
        e.apply_batch([Write.delete(b"k0"), Write.put(b"k1", b"2")])
        copy = Replica(spark, root, f"{root}-copy", f"{tmp_path}/cp")
        assert copy.catch_up() == 7 and copy.expected_next() == 8
        assert items(copy.engine.scan()) == items(e.scan())
        e.put(b"late", b"1")
        e.sync()
        assert copy.catch_up() == 8 and copy.engine.get(b"late") == b"1"
        assert copy.counters["applied"] == 8
        log = e.store.log(e.manifest)
        copy.apply(log)
        assert copy.applied_seq == 8
        with pytest.raises(ReplicationError):
            copy.apply(log.withColumn("seq", F.col("seq") + 20))
        assert read_versions(spark, root).isStreaming


def test_primary_sessions(spark, root):
    with Engine(spark, root, SMALL) as e:
        for i in range(3):
            e.apply_batch([Write.put(b"k%d" % i, b"1")])
        e.flush()
        p = Primary(e)
        p.register("a", now=0)
        p.register("b", now=0)
        assert [r.seq for r in p.stream("a").collect()] == [1, 2, 3]
        assert p.acknowledge("a", 3, now=50) == 3 and p.acknowledge("a", 1, now=50) == 3
        p.acknowledge("b", 1, now=10)
        assert [r.seq for r in p.resend_from("b", 2).collect()] == [2, 3]
        assert p.trim_log() == 1
        assert p.check_sessions(now=60) == ["b"] and p.trim_log() == 1
        assert p.node_info()["last_sequence"] == 3


def test_service_and_shell(spark, root):
    with Engine(spark, root, SMALL) as e:
        s = Service(e)
        s.put(b"a1", b"x")
        s.put(b"a2", b"y")
        assert s.get(b"a1") == (b"x", True) and s.get(b"zz") == (b"", False)
        tx = s.begin_transaction()
        s.tx_put(tx, b"a3", b"z")
        assert s.tx_get(tx, b"a3") == (b"z", True)
        assert [k for k, _ in s.tx_scan(tx, prefix=b"a")] == [b"a1", b"a2", b"a3"]
        s.tx_delete(tx, b"a1")
        s.commit_transaction(tx)
        with pytest.raises(TransactionNotFound):
            s.commit_transaction(tx)
        assert [k for k, _ in s.scan(suffix=b"2", start=b"zzz")] == [b"a2"]
        assert s.compact() is True and s.get_node_info()["role"] == "STANDALONE" and s.get_stats()["key_count"] == 2
        sh = Shell(e)
        assert sh.run("PUT user:1 some  value") == "ok" and sh.run("GET user:1") == "some value"
        assert sh.run("SCAN user:") == "user:1: some value" and "a2" in sh.run("SCAN RANGE a b") and "a3" in sh.run("SCAN SUFFIX 3")
        assert sh.run("BEGIN") == "ok" and sh.run("DELETE user:1") == "ok" and sh.run("GET user:1") == "not found"
        assert sh.run("ROLLBACK") == "ok" and sh.run("GET user:1") == "some value"
        assert "key_count" in sh.run(".stats") and sh.run("NONSENSE").startswith("error")


@pytest.mark.parametrize("hours", [24.0, 0.0])
def test_tombstones_of_a_large_load_outlive_compaction(spark, root, hours):
    with Engine(spark, root, SMALL.updated(tombstone_retention_h=hours)) as e:
        key = F.concat(F.lit("k"), F.col("id").cast("string")).cast("binary")
        assert e.apply_frame(spark.range(10_001).select(F.lit("DELETE").alias("op"), key.alias("key"), F.lit(None).cast("binary").alias("value"))) == 10_001
        e.flush()
        e.compact_range()
        assert e.records().count() == (10_001 if hours else 0)
        assert e.contains(b"k77") == bool(hours) and (not hours or e.is_deleted(b"k77"))


@pytest.mark.parametrize("flushed", [False, True])
def test_a_copy_applies_what_was_committed_only(spark, root, tmp_path, flushed):
    """A writer that dies between its segment and the commit leaves a file that no copy ever sees, whatever its numbers."""
    copy = Replica(spark, root, f"{root}-copy", f"{tmp_path}/cp") if not flushed else None
    with Engine(spark, root, SMALL.updated(orphan_age_s=0)) as e:
        e.apply_batch([Write.put(b"a", b"1"), Write.delete(b"gone")])
        left = e.store.write_segment(e.manifest, [Write.put(b"ghost", b"1")])
        if copy:
            assert copy.catch_up() == 2
        e.apply_batch([Write.put(b"b", b"1"), Write.put(b"a", b"2")])
        e.store.write_numbered(spark.createDataFrame([(9, "PUT", bytearray(b"ghost2"), bytearray(b"1"))], "seq long, op string, key binary, value binary"))
        if flushed:
            e.flush()
            e.compact_range()
        copy = copy or Replica(spark, root, f"{root}-copy", f"{tmp_path}/cp")
        assert copy.catch_up() == 4
        assert items(copy.engine.scan()) == items(e.scan()) == [(b"a", b"2"), (b"b", b"1")]
        assert copy.engine.is_deleted(b"gone") and e.store.files.exists(left.path)
        assert e.store.repair() == 2 and not e.store.files.exists(left.path)
        assert items(e.scan()) == [(b"a", b"2"), (b"b", b"1")] and copy.poll() == 4
    with Engine(spark, root) as again:
        assert again.stats.recovery["corrupt"] == 0
        again.store.files.create(again.store._name(again.manifest.version + 1), b"{")
    with Engine(spark, root) as again:
        assert again.stats.recovery["corrupt"] == 1


def test_a_young_file_is_taken_for_a_commit_under_way(spark, root):
    with Engine(spark, root) as e:
        path = e.store.write_segment(e.manifest, [Write.put(b"k", b"1")]).path
        assert e.store.repair() == 0 and e.store.files.exists(path)
        assert e.store.repair(time.time() + 3700) == 1 and not e.store.files.exists(path)


def test_acknowledgements_reach_the_primary(spark, root, tmp_path):
    with Engine(spark, root, SMALL) as e:
        primary = Primary(e)
        copy = Replica(spark, root, f"{root}-copy", f"{tmp_path}/cp", primary, "one", batch_bytes=1)
        for i in range(3):
            e.apply_batch([Write.put(b"k%d" % i, b"1"), Write.put(b"l%d" % i, b"1")])
        e.flush()
        assert primary.sessions["one"].last_ack == 0
        assert copy.catch_up() == 6 and primary.sessions["one"].last_ack == 6
        assert copy.counters["batches"] == 3 and copy.counters["apply_ns_max"] >= copy.counters["apply_ns_min"] > 0
        step = ["applying", "syncing", "acknowledging"]
        assert copy.state.history == ["connecting", *(["streaming", *step] * 3), "waiting", "streaming", "waiting"]
        assert primary.trim_log() == 2 and primary.check_sessions(time.time() + 31) == ["one"]
        copy.poll()
        assert primary.sessions["one"].connected
        late = Replica(spark, root, f"{root}-late", f"{tmp_path}/cp2", primary, "late")
        with pytest.raises(ReplicationError, match="retention"):
            late.poll()
        assert late.state.now == "error" and late.counters["errors"] == 1


def test_batches_of_commits():
    commits = [Segment(f"s{i}", i, i, 1, n, 0.0) for i, n in enumerate([10, 10, 100, 5, 5, 5])]
    assert [[s.path for s in b] for b in batches_of(commits, 15)] == [["s0"], ["s1"], ["s2"], ["s3", "s4", "s5"]]
    assert [len(b) for b in batches_of(commits, 1 << 20)] == [6] and list(batches_of([], 10)) == []


def test_roles(spark, root, tmp_path):
    with Engine(spark, root, SMALL) as e, Engine(spark, f"{root}-copy", SMALL, read_only=True) as c:
        primary = Manager(e, "PRIMARY")
        primary.start(every_s=0.05)
        service = Service(e, primary)
        node = Manager(c, "REPLICA", root, f"{tmp_path}/cp", primary.primary, "one")
        node.start()
        e.apply_batch([Write.put(b"a", b"1")])
        deadline = time.time() + 60
        while node.status()["applied_seq"] < 1 and time.time() < deadline:
            time.sleep(0.2)
        assert node.status()["state"] in ("waiting", "streaming") and node.node_info()["read_only"] and c.get(b"a") == b"1"
        (copy,) = service.get_node_info()["replicas"]
        assert copy["id"] == "one" and copy["last_ack"] == 1 and service.get_node_info()["role"] == "PRIMARY"
        with pytest.raises(ReadOnly):
            c.put(b"x", b"1")
        e.apply_batch([Write.put(b"b", b"1")])
        primary.stop()
        node.promote()
        assert node.role == "PRIMARY" and c.get(b"b") == b"1"
        c.put(b"x", b"1")
        node.stop()
        assert not node.running and not primary.running
        with pytest.raises(InvalidRecord):
            Manager(e, "OTHER")


def test_client_tries_again(spark, root):
    with Engine(spark, root, SMALL) as e:
        service = Service(e)
        tries = []

        class Shaky(Service):
            def put(self, key, value, sync=False):
                tries.append(key)
                if len(tries) < 3:
                    raise ConnectionError("lost")
                return super().put(key, value, sync)

            def get(self, key):
                raise TimeoutError("slow")

        client = Client(Shaky(e), retries=3, first_s=0.001)
        assert client.put(b"k", b"value", sync=True) and len(tries) == 3
        with pytest.raises(TimeoutError):
            client.get(b"k")
        got = client.metrics.get()
        assert (got["requests"], got["succeeded"], got["failed"]) == (7, 1, 6) and got["calls"]["put"]["bytes_sent"] == 18
        assert Client(service, [Shaky(e)], retries=1, first_s=0.001).get(b"k") == (b"value", True)
        tries.clear()
        with pytest.raises(ConnectionError):
            Client(Shaky(e), retries=1, first_s=0.001).put(b"k", b"v")
        with pytest.raises(InvalidRecord):
            client.put(b"", b"v")
        client.metrics.reset()
        assert client.metrics.get()["requests"] == 0


def test_a_commit_that_fails_counts_as_aborted(spark, root, monkeypatch):
    with Engine(spark, root, SMALL) as e:
        tx = e.begin()
        tx.put(b"k", b"1")
        monkeypatch.setattr(e, "_commit_transaction", lambda _: (_ for _ in ()).throw(StoreError("disk full")))
        with pytest.raises(StoreError):
            tx.commit()
        monkeypatch.undo()
        assert e.transaction_stats() == {"started": 1, "completed": 0, "aborted": 1, "active": 0} and tx.closed
        assert not e.contains(b"k")
        # the writer's turn is over
        e.begin(timeout=1).rollback()


def test_numbers_taken_by_another_writer(spark, root):
    with Engine(spark, root, SMALL) as a:
        a.put(b"mine", b"1")
        with Engine(spark, root, SMALL) as b:
            b.apply_batch([Write.put(b"theirs", b"1")])
        with pytest.raises(Conflict):
            a.sync()
        assert a.put(b"mine", b"2") == 2
        a.sync()
        assert items(a.scan()) == [(b"mine", b"2"), (b"theirs", b"1")]


def test_deletions_leave_the_manifest_as_it_is(spark, root):
    sizes = []
    for n in (10_000, 10_001, 300_000):
        with Engine(spark, f"{root}{n}", SMALL) as e:
            key = F.concat(F.lit("k"), F.col("id").cast("string")).cast("binary")
            e.apply_frame(spark.range(n).select(F.lit("DELETE").alias("op"), key.alias("key"), F.lit(None).cast("binary").alias("value")))
            e.apply_batch([Write.delete(b"d%d" % i) for i in range(1000)])
            e.flush()
            e.compact_range()
            assert e.records().count() == n + 1000
            sizes.append(len(e.manifest.dumps()))
            e.update_config(tombstone_retention_h=0.0)
            e.compact_range()
            assert e.records().count() == 0
    assert max(sizes) - min(sizes) < 100


def test_tombstones_without_a_time_stay_by_level(spark, root):
    """Such as a store of before may hold."""
    for most, left in ((1, 1), (0, 0)):
        with Engine(spark, f"{root}{most}", SMALL.updated(max_level_with_tombstones=most)) as e:
            e.apply_batch([Write.delete(b"k")])
            m = e.manifest
            undated = e.store.stored([s.path for s in m.segments]).withColumn("deleted_at", F.lit(None).cast("long"))
            table = e.store.write_table(undated, 0, 1, m.config)
            e.store.commit(m, tables=(table,), next_table=2, flushed_seq=1)
            e.compact_range()
            assert e.records().count() == left


def test_compaction_in_the_background(spark, root):
    with Engine(spark, root, SMALL.updated(memtable_age_s=1)) as e:
        for i in range(3):
            e.apply_batch([Write.put(b"k%d" % i, b"1")])
            e.flush()
        kinds = [r.kind for r in e.layers().collect()]
        assert kinds == ["level 0"] * 3
        e.start_compaction(0.05)
        deadline = time.time() + 60
        while any(t.level == 0 for t in e.manifest.tables) and time.time() < deadline:
            time.sleep(0.1)
        e.stop_compaction()
        assert {t.level for t in e.manifest.tables} != {0} and e.scan().count() == 3
        e.put(b"z", b"1")
        assert [r.kind for r in e.layers().collect()][0] == "memory"
