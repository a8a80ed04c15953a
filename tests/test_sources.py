import zlib

import pytest
from pyspark.sql import functions as F

from tidelog.functions.records import encode_record
from tidelog.model import InvalidRecord, Write
from tidelog.operators.live import live
from tidelog.plans.engine import Engine
from tidelog.sources.connectors import puts, read_puts, write_view
from tidelog.sources.wal import FRAMES, decode_entry, encode_batch, frames_of, log_frames, replay, to_frames


def test_replay_of_fragments_batches_and_damage(spark):
    big = Write.put(b"k" * 32758, b"v" * 65536)
    records = [encode_record(1, big), encode_batch(2, [Write.put(b"batch1", b"1"), Write.put(b"batch2", b"2"), Write.delete(b"batch2")]), encode_record(5, Write.put(b"bad", b"x")), encode_record(6, Write.put(b"torn", b"y" * 70000)), b"\x09junk", encode_record(7, Write.put(b"ok", b""))]
    rows = [r for i, raw in enumerate(records) for r in frames_of(i, raw)]
    rows = [(r, p, k, zlib.crc32(b"other") if r == 2 else c, bytearray(x)) for r, p, k, c, x in rows if not (r == 3 and p == 1)]
    done = replay(spark.createDataFrame(rows, FRAMES).repartition(3))
    assert (done.frames, done.corrupt) == (len(rows), 3)
    view = {bytes(r.key): bytes(r.value) for r in live(done.log).collect()}
    assert view == {big.key: big.value, b"batch1": b"1", b"ok": b""}
    assert replay(spark.createDataFrame([], FRAMES)).log.count() == 0


def test_frames_written_from_a_log(spark):
    writes = [Write.put(b"a", b""), Write.put(b"b", b"x" * 100_000), Write.delete(b"a"), Write.put(b"c" * 32758, b"y" * (32 * 1024))]
    log = spark.createDataFrame([(i + 1, w.op, bytearray(w.key), None if w.value is None else bytearray(w.value)) for i, w in enumerate(writes)], "seq long, op string, key binary, value binary")
    got = sorted((r.record, r.part, r.kind, r.checksum, bytes(r.payload)) for r in log_frames(log).collect())
    assert got == [x for i, w in enumerate(writes) for x in frames_of(i + 1, encode_record(i + 1, w))]
    done = replay(log_frames(log).repartition(3))
    assert done.corrupt == 0 and sorted(map(tuple, done.log.collect())) == sorted(map(tuple, log.collect()))
    odd = to_frames(spark.createDataFrame([(1, bytearray(b"")), (2, None)], "record long, payload binary")).collect()
    assert [(r.record, r.part, r.kind) for r in odd] == [(1, 0, 1)]


def test_batch_codec():
    writes = [Write.put(b"a", b"1"), Write.delete(b"b")]
    raw = encode_batch(1000, writes)
    assert decode_entry(raw) == [(1000, writes[0]), (1001, writes[1])]
    for bad in (raw[:-1], raw[:9]):
        with pytest.raises(InvalidRecord):
            decode_entry(bad)


def test_connectors(spark, root, tmp_path):
    spark.range(20).select(F.format_string("u%02d", "id").alias("name"), "id").write.json(f"file://{tmp_path}/in")
    with Engine(spark, root) as e:
        assert e.apply_frame(read_puts(spark, f"file://{tmp_path}/in", "json", "name")) == 20
        assert e.get(b"u07") == b'{"id":7,"name":"u07"}'
        e.apply_frame(puts(spark.range(1), F.lit("x"), F.lit("y")))
        write_view(e.scan(prefix=b"u0"), f"file://{tmp_path}/out", "csv", text=True, header=True)
    back = spark.read.csv(f"file://{tmp_path}/out", header=True)
    assert back.columns == ["key", "value"] and back.count() == 10


def test_single_writes_number_on(spark, root):
    with Engine(spark, root) as e:
        assert [e.put(b"a%d" % i, b"1") for i in range(50)] == list(range(1, 51))
        e.sync()
        assert e.put(b"b", b"1") == 51 and e.manifest.next_seq == 51
        assert e.scan().count() == 51
