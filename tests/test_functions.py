import random

import pytest
from pyspark.sql import functions as F

from tidelog import model
from tidelog.functions import bloom, keys, records
from tidelog.model import Batch, InvalidRecord, Write


@pytest.mark.parametrize(("prefix", "after"), [(b"a", b"b"), (b"a\xff", b"b"), (b"a\xff\xff", b"b"), (b"\xff", None), (b"", None), (b"ab", b"ac")])
def test_successor(prefix, after):
    assert keys.successor(prefix) == after


def test_prefix_whose_next_byte_is_ff(spark):
    rows = [(bytearray(b),) for b in (b"ab", b"ab\xff", b"ab\xff\xff", b"ac", b"a", b"\xff\xffz")]
    df = spark.createDataFrame(rows, "key binary")
    found = [bytes(r.key) for r in df.where(keys.has_prefix("key", b"ab")).collect()]
    assert sorted(found) == [b"ab", b"ab\xff", b"ab\xff\xff"]
    assert df.where(keys.has_prefix("key", b"\xff\xff")).count() == 1
    assert df.where(keys.has_prefix("key", b"")).count() == 6


def test_string_prefix_bound_is_valid_text(spark):
    df = spark.createDataFrame([("a퟿",), ("a",), ("b",), ("a\U0010ffffx",)], "key string")
    assert df.where(keys.has_prefix("key", "a")).count() == 3
    assert df.where(keys.has_prefix("key", "a퟿")).count() == 1
    assert df.where(keys.has_prefix("key", "a\U0010ffff")).count() == 1


def test_prefix_reaches_the_scan(spark, tmp_path):
    spark.range(10).select(F.concat(F.lit("k"), "id").cast("binary").alias("key")).write.parquet(f"{tmp_path}/t")
    plan = spark.read.parquet(f"{tmp_path}/t").where(keys.has_prefix("key", b"k1"))._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(key" in plan and "LessThan(key" in plan


def test_records_round_trip_and_reject(spark):
    for w in (Write.put(b"k", b""), Write.put(b"k" * 32758, b"v" * 65536), Write.delete(b"k")):
        assert records.decode_record(records.encode_record(7, w)) == (7, w)
    raw = records.encode_record(1, Write.put(b"key", b"value"))
    for bad in (b"", raw[:-1], raw[:9], b"\x09" + raw[1:]):
        with pytest.raises(InvalidRecord):
            records.decode_record(bad)
    df = spark.createDataFrame([(bytearray(raw),), (bytearray(raw[:-1]),), (None,)], "raw binary")
    out = df.select(records.decode_records("raw").alias("r")).select("r.*").collect()
    assert [r.error is None for r in out] == [True, False, False]


def test_columns_agree_with_the_plain_codec(spark):
    rng = random.Random(2)
    writes = [(s, Write.put(rng.randbytes(rng.randrange(1, 40)), rng.randbytes(rng.randrange(60)))) for s in (0, 1, 255, 256, 2**31, 2**40 + 7, 2**63 - 1)]
    writes += [(9, Write.delete(b"k")), (10, Write.put(b"k" * 70_000, b"")), (11, Write("MERGE", b"m", b"1"))]
    df = spark.createDataFrame([(s, w.op, bytearray(w.key), None if w.value is None else bytearray(w.value)) for s, w in writes], "seq long, op string, key binary, value binary")
    raws = [bytes(r[0]) for r in df.select(records.encode_records("seq", "op", "key", "value")).collect()]
    assert raws == [records.encode_record(s, w) for s, w in writes]
    for _ in range(400):
        raw = bytearray(rng.choice(raws[:8]))
        if rng.random() < 0.5:
            raw = raw[: rng.randrange(len(raw) + 1)]
        elif raw:
            raw[rng.choice([0, rng.randrange(len(raw)), min(len(raw) - 1, rng.randrange(9, 16))])] = rng.randrange(256)
        raws.append(bytes(raw))
    found = spark.createDataFrame([(bytearray(r),) for r in raws], "raw binary").select(records.decode_records("raw").alias("r")).select("r.*").collect()
    for raw, r in zip(raws, found, strict=True):
        try:
            seq, w = records.decode_record(raw)
        except InvalidRecord:
            assert r.error is not None and r.op is None and r.key is None, raw
            continue
        if seq >= 2**63:
            assert r.error is not None
        else:
            assert (r.seq, r.op, bytes(r.key), None if r.value is None else bytes(r.value), r.error) == (seq, w.op, w.key, w.value, None)


def test_fnv_vectors(spark):
    assert [int(x) for x in records.fnv1a_64([b"", b"a", b"foobar"])] == [0xCBF29CE484222325, 0xAF63DC4C8601EC8C, 0x85944171F73967E8]
    df = spark.createDataFrame([(bytearray(b"a"),), (None,)], "v binary")
    assert [r[0] for r in df.select(records.fnv1a("v")).collect()] == [0xAF63DC4C8601EC8C - (1 << 64), None]


def test_codecs():
    for codec in records.CODECS:
        for data in (b"abc" * 100, b"", b"x", random.Random(1).randbytes(70_000)):
            assert records.decompress(records.compress(data, codec), codec) == data
        chunks = [b"one" * 50, b"", b"two", bytes(range(256)) * 300]
        raw = b"".join(records.compress_stream(chunks, codec))
        assert list(records.decompress_stream((raw[i : i + 37] for i in range(0, len(raw), 37)), codec)) == chunks
        with pytest.raises(InvalidRecord):
            list(records.decompress_stream([raw[:-1]], codec))
    with pytest.raises(ValueError):
        records.compress(b"", "lz")


@pytest.mark.parametrize("rate", [0.1, 0.01, 0.001])
def test_bloom(rate):
    f = bloom.BloomFilter(1000, rate)
    f.add(*[b"key-%d" % i for i in range(1000)])
    assert all(f.contains(b"key-%d" % i) for i in range(1000))
    false = sum(f.contains(b"other-%d" % i) for i in range(5000)) / 5000
    assert false <= 3 * rate + 0.002 and f.estimated_rate() < 3 * rate
    g = bloom.BloomFilter.loads(f.dumps())
    assert g.contains(b"key-5") and g.added == 1000
    f.clear()
    assert not f.contains(b"key-5")


def test_limits_and_batches():
    assert Write("MERGE", b"k", b"v").checked().op == model.PUT
    for bad in (Write.put(b"", b"v"), Write.put(b"k" * 4097, b"v"), Write("NOPE", b"k", b"v"), Write.put(b"k", b"v" * (10 * 1024 * 1024 + 1))):
        with pytest.raises(InvalidRecord):
            bad.checked()
    with pytest.raises(InvalidRecord):
        model.checked_batch([Write.delete(b"k")] * 1001)
    b = Batch().put(b"ab", b"cde").delete(b"f")
    assert (b.count(), b.size()) == (2, 6)
    b.reset()
    assert b.count() == 0


def test_unknown_operation_raises(spark):
    ok = spark.createDataFrame([("MERGE",), ("PUT",)], "op string").select(records.put_or_delete(F.col("op")).alias("op"))
    assert [r.op for r in ok.collect()] == ["PUT", "PUT"]
    with pytest.raises(Exception, match="unknown operation"):
        spark.createDataFrame([("BATCH",)], "op string").select(records.put_or_delete(F.col("op"))).collect()


def test_file_names(spark):
    rng = random.Random(1)
    parts = [(rng.randrange(7), rng.randrange(10**6), rng.randrange(10**18)) for _ in range(20)]
    df = spark.createDataFrame([(keys.table_file(*p),) for p in parts], "p string").select(*keys.table_file_parts("p"))
    assert [tuple(r) for r in df.collect()] == parts
