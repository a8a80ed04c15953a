"""Fixed-length training sequences by shortest-pack-first over the length histogram."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.llm.tokenizing import encoder
from tidelog.session import keep

CAPACITY, END_ID = 2048, 1
_FIELDS = [("doc_id", None), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("part", pa.int64()), ("nth", pa.int64()), ("ids", pa.binary())]


def _pieces(path: str, capacity: int, end_id: int, with_ids: bool):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth, encode = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64), encoder(path)

        def cut(ids: pa.Array, texts: list[str]) -> pa.RecordBatch:
            rows, of = [], []
            for i, raw in enumerate(encode(texts)):
                raw += end
                n = len(raw) // 4
                for start in range(0, n, capacity):
                    piece = raw[4 * start : 4 * (start + capacity)]
                    length = len(piece) // 4
                    rows.append((start, length, zlib.crc32(piece), n, part, int(nth[length]), piece if with_ids else None))
                    nth[length] += 1
                    of.append(i)
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([ids.take(pa.array(of)), *(pa.array(c, t) for c, (_, t) in zip(columns, _FIELDS[1:], strict=True))], names=[f for f, _ in _FIELDS])

        for b in batches:
            texts, size, first = [], 0, 0
            for i, t in enumerate(b.column(1)):
                texts.append(t.as_py() or "")
                size += len(texts[-1])
                if size > 1_000_000 or i + 1 == b.num_rows:
                    yield cut(b.column(0).slice(first, i + 1 - first), texts)
                    texts, size, first = [], 0, i + 1

    return run


def pack_histogram(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """``(lengths, times)`` patterns: lengths are placed longest first, each into the shortest open pack it fits.

    Works on counts: a pattern that is open ``n`` times takes up to ``n`` pieces of a length in one step and
    is split in two when there are fewer, so the work and the patterns depend on the capacity and not on the
    number of pieces.
    """
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {capacity: []}
    for length in sorted((x for x, n in counts.items() if n), reverse=True):
        left = counts[length]
        for space in sorted((s for s in open_ if s >= length), reverse=True):
            while left and open_[space]:
                pattern, times = open_[space].pop()
                used = min(times, left)
                if times > used:
                    open_[space].append((pattern, times - used))
                open_.setdefault(space - length, []).append(((*pattern, length), used))
                left -= used
        # new packs, each filled at once with as many of the length as fit
        each = capacity // length
        for n in (each, left % each):
            times = left // n if n else 0
            if times:
                open_.setdefault(capacity - n * length, []).append(((length,) * n, times))
                left -= times * n
    return [x for at in open_.values() for x in at]


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> pd.DataFrame:
    """Where the pieces of each length go, by rank: ranks ``lo`` to ``hi`` - 1 to sequences from ``sequence`` on."""
    rows, begin, at = [], 0, {}
    for pattern, times in patterns:
        offset = 0
        for length in pattern:
            lo = at.get(length, 0)
            at[length] = lo + times
            rows.append((length, lo, lo + times, begin, offset))
            offset += length
        begin += times
    return pd.DataFrame(rows, columns=["length", "lo", "hi", "sequence", "at"], dtype="int64")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)``, all long, and ``ids`` if asked for.

    One row per piece. A document's ids end with ``end_id`` and are cut every ``capacity`` ids, so it has one
    piece shorter than a sequence at most. The histogram of lengths (``capacity`` numbers) gives the
    packing patterns on the driver; pieces of a length are ranked by the partition that cut them
    and their order there, and joined by rank with the patterns, a table bounded by the capacity. Cases: null
    and empty texts are the end id alone; null and repeated doc_ids are documents of their own; an
    empty table gives no rows; further columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, part long, nth long, ids binary"
    pieces = keep(rows.mapInArrow(_pieces(tokenizer, capacity, end_id, with_ids), schema), "pieces")
    sizes = keep(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "piece-lengths")
    counts = {r.length: r.n for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = slots(pack_histogram(counts, capacity))
    places = spark.createDataFrame(table, "length long, lo long, hi long, sequence long, at long")
    before = F.sum("n").over(W.partitionBy("length").orderBy("part")) - F.col("n")
    begin = keep(sizes.select("length", "part", before.alias("before")), "piece-ranks")
    ranked = pieces.join(begin, ["length", "part"]).withColumn("rank", F.col("before") + F.col("nth"))
    out = ranked.join(F.broadcast(places), (ranked.length == places.length) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    columns = ["doc_id", "start", ranked.length, "ids_crc32", "doc_tokens", (F.col("sequence") + F.col("rank") - F.col("lo")).alias("sequence_id"), F.col("at").alias("offset")]
    return out.select(*columns, *(["ids"] if with_ids else []))
