"""SimHash near-duplicates by a byte-position inverted index with count filtering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.components import connected_components
from tidelog.session import keep

BITS, BYTES, MOST_BITS = 64, 8, 3
#: Three differing bits touch three bytes at most, so five of the eight bytes agree.
LEAST_BYTES = BYTES - MOST_BITS
#: Of five agreeing bytes three lie in the same half: eight lists of positions find every pair.
TRIPLES = [tuple(h + i for i in range(4) if i != out) for h in (0, 4) for out in range(4)]
#: Fingerprints of one posting list that a task compares directly.
LIST_ROWS = 8192
#: Shingles hashed before their bits are tallied; bounds the memory a very long text takes.
STEP = 200_000


def fingerprint(text: str | None) -> int:
    """SimHash of 3-word shingles (XXH64, seed 42); zero for a text without words or null."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= 3:
        starts, ends = [0], [len(joined)]
    else:
        size = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(size + 1) - 1
        starts, ends = (end - size)[:-2].tolist(), end[2:].tolist()
    ones, digest, n = np.zeros(BITS, np.int64), xxhash.xxh64_intdigest, len(starts)
    for at in range(0, n, STEP):
        spans = zip(starts[at : at + STEP], ends[at : at + STEP], strict=True)
        h = np.array([digest(joined[a:b], 42) for a, b in spans], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = np.fromiter((fingerprint(t.as_py()) for t in b.column(1)), np.uint64, b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])


def _carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = np.fromiter((fingerprint(t.as_py()) for t in b.column(1)), np.uint64, b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(found.view(np.int64))], names=["id", "t1", "t2", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id long, fp long)``: one row per row of ``docs``; the fingerprint's bits as a signed long."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_fingerprints, "doc_id long, fp long")


def positional_keys(fp: str = "fp") -> F.Column:
    """The eight keys of a fingerprint: the list's number and the three bytes at its positions."""

    def key(n: int, at: tuple[int, ...]):
        out = F.lit(n).cast("long")
        for p in at:
            out = F.shiftleft(out, 8).bitwiseOR(F.shiftrightunsigned(F.col(fp), 8 * p).bitwiseAND(F.lit(255)))
        return out

    return F.array(*(key(n, at) for n, at in enumerate(TRIPLES)))


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pairs that share ``LEAST_BYTES`` positional bytes, then verified bit by bit."""
    differ = a ^ b
    tally = (differ.view(np.uint8).reshape(-1, BYTES) == 0).sum(1)
    return (tally >= LEAST_BYTES) & (np.bitwise_count(differ.view(np.uint64)) <= MOST_BITS)


def spanning_links(key: np.ndarray, fp: np.ndarray) -> np.ndarray:
    """For rows sorted by key: the smallest row that near pairs of the same key connect each row with.

    Rows are compared at distance 1, 2, ... as long as a list reaches that far, and linked rows
    are merged on the way, so what comes out is one link a row and never the pairs of a list.
    """
    label, d = np.arange(len(key)), 1
    at = np.flatnonzero(key[1:] == key[:-1])
    while len(at):
        open_ = at[label[at] != label[at + d]]
        link = open_[_near(fp[open_], fp[open_ + d])]
        while len(link):
            x, y = label[link], label[link + d]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while (label[label] != label).any():
                label = label[label]
            link = link[label[link] != label[link + d]]
        d += 1
        at = at[at + d < len(key)]
        at = at[key[at] == key[at + d]]
    return label


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def solved(key, fp, node):
        label = spanning_links(key, fp)
        moved = label != np.arange(len(label))
        return pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[label[moved]])], names=["a", "b"])

    held = None
    for b in batches:
        now = [b.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        now = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
        cut = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) else 0
        if cut:
            yield solved(*(x[:cut] for x in now))
        held = [x[cut:] for x in now]
    if held is not None:
        yield solved(*held)


def _blocks(lists: DataFrame, rows: int) -> DataFrame:
    """Split lists of over ``rows`` rows into pairs of blocks, each pair a list of its own.

    Exact for any length of list: every two rows meet in one pair of blocks, and a task holds two blocks.
    """
    sizes = lists.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > rows // 2)
    n = F.ceil(F.col("n") / (rows // 2)).cast("long")
    block = F.pmod(F.xxhash64("fp"), n)
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.struct(F.least(i, block).alias("i"), F.greatest(i, block).alias("j")))
    split = lists.join(keep(sizes, "long-lists"), "key").select("key", "fp", "node", F.explode(pairs).alias("p"))
    return split.select(F.xxhash64("key", "p.i", "p.j").alias("key"), "fp", "node")


def near_links(prints: DataFrame, list_rows: int = LIST_ROWS) -> DataFrame:
    """``(a, b)`` node pairs whose spanning structure equals that of all links of at most three bits.

    ``prints`` has distinct ``fp`` and a long ``node``. Posting lists of over ``list_rows``
    fingerprints take two more of the other five positional bytes into their key (of five agreeing
    bytes two lie there), and what is still longer is compared in pairs of bounded blocks.
    Cases: texts, null, empty or very long, are behind their fingerprints by now; ``fp`` and ``node`` are not null;
    a repeated fp is a link of its nodes; an empty table gives no rows; further columns are ignored.
    """
    index = prints.select(F.explode(positional_keys()).alias("key"), "fp", "node")
    long_ = keep(index.groupBy("key").count().where(F.col("count") > list_rows).select("key"), "hot-keys")
    solve = lambda x: x.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_links, "a long, b long")
    if long_.isEmpty():
        return solve(index)
    short, rest = index.join(long_, "key", "left_anti"), index.join(long_, "key", "left_semi")
    free = F.shiftrightunsigned("key", 24)
    longer = []
    for n, at in enumerate(TRIPLES):
        other = [p for p in range(BYTES) if p not in at]
        for i, p in enumerate(other):
            for q in other[i + 1 :]:
                two = [F.shiftrightunsigned("fp", 8 * x).bitwiseAND(F.lit(255)) for x in (p, q)]
                longer.append(F.when(free == n, F.xxhash64("key", F.lit(p * BYTES + q), *two)))
    finer = rest.select(F.explode(F.array_compact(F.array(*longer))).alias("key"), "fp", "node")
    finer = keep(finer, "finer-lists")
    too_long = keep(finer.groupBy("key").count().where(F.col("count") > list_rows).select("key"), "longest")
    out = solve(short).union(solve(finer.join(too_long, "key", "left_anti")))
    if not too_long.isEmpty():
        out = out.union(solve(_blocks(finer.join(too_long, "key", "left_semi"), list_rows)))
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", list_rows: int = LIST_ROWS) -> DataFrame:
    """``(doc_id long, fp long, component_id long)``: one row per row of ``docs``.

    Fingerprints at three or fewer differing bits link; ``component_id`` is the smallest doc_id
    reachable over links, the row's own included. Equal fingerprints are one entry of the index, so
    a large group of exact copies costs no more than its rows. Cases: a null or wordless text has
    fingerprint zero, linked like any other; rows that share a doc_id are linked; a row with null
    doc_id links like any other and gets the component of the rows it reaches (null if none has an id);
    an empty table gives no rows; further columns are ignored.
    """
    prints = keep(fingerprints(docs, id_col, text_col), "fingerprints")
    # a fingerprint is its own node
    unique = keep(prints.groupBy("fp").agg(F.min("doc_id").alias("least")).withColumn("node", F.col("fp")), "unique-prints")
    links = near_links(unique, list_rows)
    of_id = prints.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi"))
    several = keep(of_id.where("lo <> hi").select("doc_id", "lo"), "ids-of-several-texts")
    if not several.isEmpty():
        links = links.union(prints.join(several, "doc_id").select("fp", "lo"))
    rooted = _rooted(unique, links)
    best = rooted.join(keep(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "roots"), "root").select("fp", "component_id")
    return prints.join(best, "fp", "left").select("doc_id", "fp", "component_id")


def _rooted(unique: DataFrame, links: DataFrame) -> DataFrame:
    """``unique`` with the root of each fingerprint's component."""
    roots = connected_components(links)
    return keep(unique.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", list_rows: int = LIST_ROWS) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates, by the fingerprints of their texts.

    The row with the smallest doc_id stays; of several such (a repeated id) the one whose text has the smallest hash. Rows
    alike in id and text are one, the one with the smallest hash over all columns. Cases: rows of one id and unlike texts are
    in groups of their own, and all may stay; a null doc_id ranks last, so it goes if any row of its group has an id, and one of
    a group of null ids stays; null, empty and wordless texts are near copies of one another; very long texts count whole;
    an empty table gives no rows; further columns pass through, whatever their names.
    """
    names = docs.columns
    rows = docs.select([F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    key, text = f"c{names.index(id_col)}", F.coalesce(F.col(f"c{names.index(text_col)}").cast("string"), F.lit(""))
    own = [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]
    kind = rows.schema[key].dataType.simpleString()
    prints = rows.select(F.col(key).alias("id"), text.alias("text"), *own).mapInArrow(_carried, f"id {kind}, t1 long, t2 long, fp long")
    # a text has one fingerprint, so rows alike in id and text are one entry
    prints = keep(prints.groupBy("id", "t1", "t2", "fp").agg(F.count("*").alias("n")), "prints")
    unique = keep(prints.select("fp", F.col("fp").alias("node")).distinct(), "unique-prints")
    rooted = _rooted(unique, near_links(unique, list_rows)).select("fp", "root")
    rank = F.struct(F.col("id").isNull().alias("last"), "id", "t1", "t2")
    entries = prints.join(rooted, "fp").select("root", rank.alias("rank"), "n")
    best = keep(entries.groupBy("root").agg(F.min("rank").alias("best")), "stay")
    gone = entries.join(best, "root").where(~F.col("rank").eqNullSafe(F.col("best"))).select("rank.id", "rank.t1", "rank.t2")
    again = keep(entries.where("n > 1").join(best, "root").where(F.col("rank").eqNullSafe(F.col("best"))).select("rank.id", "rank.t1", "rank.t2"), "repeated-rows")
    marked = rows.select("*", *own)

    def of(other: DataFrame):
        return marked[key].eqNullSafe(other["id"]) & (marked["t1"] == other["t1"]) & (marked["t2"] == other["t2"])

    left = marked.join(gone, of(gone), "left_anti")
    if not again.isEmpty():
        several = marked.join(again, of(again), "left_semi")
        one = several.groupBy(key, "t1", "t2").agg(F.min_by(F.struct(*rows.columns), F.xxhash64(*rows.columns)).alias("r")).select("r.*")
        single = left.join(again, of(again), "left_anti").select(rows.columns)
        return single.union(one).toDF(*names)
    return left.select(rows.columns).toDF(*names)
