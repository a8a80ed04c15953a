import random
import zlib
from bisect import bisect_left

import pytest
from pyspark.sql import functions as F
from samples import prose

from tidelog.llm import sharding
from tidelog.llm.sharding import OVERHEAD, _keyed, assign_shards, splitters, write_shards


def checked(docs, shards, **options):
    rows = assign_shards(docs, shards, **options).collect()
    want = sorted((r.doc_id or -1, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in rows) == want
    slots, sizes = {}, [0] * shards
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
        sizes[r.shard] += r.size
    for s, found in slots.items():
        assert 0 <= s < shards and sorted(found) == list(range(len(found)))
    return sizes, rows


def test_even_bytes(docs):
    sizes, rows = checked(docs, 4)
    largest = max(r.size for r in rows)
    assert max(sizes) - min(sizes) <= 2 * largest


@pytest.mark.parametrize("same_id", [False, True])
def test_a_third_of_all_rows_alike(spark, same_id):
    """One group fills several shards, and is cut although its keys begin alike, or are all alike."""
    hot = prose(1, 20)
    rows = [(-5 if same_id else i, hot) for i in range(600)] + [(1000 + i, prose(i, 20)) for i in range(400)]
    sizes, found = checked(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 8)
    assert max(sizes) - min(sizes) <= 2 * max(r.size for r in found)


def test_cases(edge_docs, no_docs):
    checked(edge_docs, 3)
    checked(edge_docs, 1)
    assert assign_shards(no_docs, 5).count() == 0
    sizes, _ = checked(edge_docs.where("doc_id = 1"), 4)
    assert sorted(sizes) == [0, 0, 0, 8]


def test_edges_are_in_order(spark):
    keys = spark.range(5000).select(F.lit(10).cast("long").alias("size"), F.xxhash64("id").alias("h1"), F.lit(0).cast("long").alias("h2"), F.lit(0).cast("long").alias("h3"))
    edges = splitters(keys, 16, 0.01)
    assert edges == sorted(edges) and len(set(edges)) == 15


def test_files(docs, tmp_path, spark):
    write_shards(docs, f"file://{tmp_path}/out", shards=3, files=2)
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert back.count() == docs.count() and {r.shard for r in back.select("shard").distinct().collect()} == {0, 1, 2}
    assert set(docs.columns) <= set(back.columns)


def test_against_a_sorted_list(spark):
    """Edges, shards and slots as sorting all keys gives them."""
    rng = random.Random(3)
    rows = [(i % 170, prose(i % 120, rng.randrange(60))) for i in range(500)] + [(None, None)] * 300 + [(1000 + i, "é" * rng.choice([1, 2, 4000])) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    keys = df.select((F.octet_length(F.coalesce("text", F.lit(""))) + OVERHEAD).cast("long").alias("size"), *_keyed(df, "doc_id", "text"))
    listed = sorted((tuple((h % (1 << 64)) ^ (1 << 63) for h in (r.h1, r.h2, r.h3)), r.size) for r in keys.collect())
    number = lambda k: k[0] << 128 | k[1] << 64 | k[2]
    below, total = [0], sum(s for _, s in listed)
    for _, s in listed:
        below.append(below[-1] + s)
    for shards, tolerance in ((7, 0.001), (24, 0.0), (3, 0.05)):
        edges = splitters(keys, shards, tolerance)
        cuts = [bisect_left([number(k) for k, _ in listed], e) for e in edges]
        for i, cut in enumerate(cuts, 1):
            ideal = total * i / shards
            best = min(abs(b - ideal) for b in below)
            assert abs(below[cut] - ideal) <= max(best, tolerance * total / shards)
        want = sorted((sum(c <= n for c in cuts), size) for n, (_, size) in enumerate(listed))
        found = assign_shards(df, shards, tolerance).collect()
        assert sorted((r.shard, r.size) for r in found) == want
        for s in range(shards):
            assert sorted(r.slot for r in found if r.shard == s) == list(range(sum(w[0] == s for w in want)))


def test_rows_alike_in_text_and_id_are_spread(spark, monkeypatch):
    """No cell holds more than a few thousand of rows that are all the same."""
    monkeypatch.setattr(sharding, "CELL_BITS", 6)
    df = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text")).union(spark.createDataFrame([(i, prose(i, 9)) for i in range(300)], "doc_id long, text string"))
    sizes, rows = checked(df, 5)
    assert max(sizes) - min(sizes) <= 2 * max(r.size for r in rows)


def test_files_of_odd_tables(spark, edge_docs, no_docs, tmp_path):
    odd = edge_docs.union(edge_docs.where("doc_id is null"))
    write_shards(odd, f"file://{tmp_path}/odd", shards=4)
    back = spark.read.parquet(f"file://{tmp_path}/odd")
    assert sorted((r.doc_id or -1, r.text or "") for r in back.collect()) == sorted((r.doc_id or -1, r.text or "") for r in odd.collect())
    write_shards(no_docs, f"file://{tmp_path}/none")
    assert spark.read.schema(no_docs.schema).parquet(f"file://{tmp_path}/none").count() == 0
