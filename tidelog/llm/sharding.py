"""Shards of near-equal bytes by histogram sort, in DataFrame functions only."""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.session import keep

#: A key is three unsigned 64-bit numbers; a round of probes refines DIGIT more bits of it.
PARTS, DIGIT = 3, 16
LEVELS = PARTS * 64 // DIGIT
#: Bytes a document counts for besides its text.
OVERHEAD = 8
_SIGN = 1 << 63
#: Bits of a part by which rows are spread for counting their places.
CELL_BITS = 12
#: Bytes of documents that a file of a shard holds, about.
FILE_BYTES = 256 << 20


def _digit(level: int) -> Column:
    """Digit ``level`` of the key, counted from the top; the sign bit is flipped so that order is kept."""
    part, at = divmod(level * DIGIT, 64)
    bits = F.shiftrightunsigned(F.col(f"h{part + 1}"), 64 - DIGIT - at).bitwiseAND(F.lit((1 << DIGIT) - 1))
    return bits.bitwiseXOR(F.lit(1 << (DIGIT - 1))) if at == 0 else bits


def _literal(edge: int, part: int) -> int:
    """A part of an edge as the signed long that compares like it."""
    return ((edge >> 64 * (PARTS - 1 - part)) & ((1 << 64) - 1)) - _SIGN


def _prefix(path: tuple[int, ...]) -> Column:
    """Rows whose key begins with these digits."""
    out = F.lit(True)
    for level, d in enumerate(path):
        out = out & (_digit(level) == d)
    return out


def _at_least(edge: int) -> Column:
    if edge >> 64 * PARTS:
        return F.lit(False)
    out = F.col(f"h{PARTS}") >= _literal(edge, PARTS - 1)
    for part in reversed(range(PARTS - 1)):
        h, b = F.col(f"h{part + 1}"), F.lit(_literal(edge, part))
        out = (h > b) | ((h == b) & out)
    return out


def splitters(keys: DataFrame, shards: int, tolerance: float) -> list[int]:
    """``shards - 1`` edges in key order with bytes below as near ``i / shards`` of all as asked for.

    Each round counts, over all partitions and with partial sums, the exact bytes below the candidate
    edges of every splitter that is still open: 2**DIGIT candidates within the stretch it is known to
    lie in. A splitter closes when an edge is within ``tolerance`` of a shard's size, or when one row is
    all that is left between two edges.
    """
    total = keys.agg(F.sum("size")).first()[0] or 0
    near = tolerance * total / shards
    open_: dict[int, tuple[tuple[int, ...], int]] = {s: ((), 0) for s in range(1, shards)} if total else {}
    edges = {s: 1 << 64 * PARTS for s in range(1, shards)}
    while open_:
        paths = sorted({p for p, _ in open_.values()})
        level = len(paths[0])
        which = F.lit(None).cast("int")
        for i, p in enumerate(paths):
            which = F.when(_prefix(p), F.lit(i)).otherwise(which) if p else F.lit(i)
        probed = keys.select(which.alias("p"), _digit(level).cast("int").alias("d"), "size").where("p is not null")
        found: dict[tuple[int, ...], list] = {p: [] for p in paths}
        for r in probed.groupBy("p", "d").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect():
            found[paths[r.p]].append((r.d, r.bytes, r.n))
        for s, (path, below) in list(open_.items()):
            bins = sorted(found[path])
            upto = list(accumulate((b for _, b, _ in bins), initial=below))
            at = min(max(bisect_right(upto, total * s / shards) - 1, 0), len(bins) - 1)
            lo, hi = upto[at], upto[at + 1]
            low = hi - total * s / shards > total * s / shards - lo
            left = 64 * PARTS - DIGIT * (level + 1)
            value = 0
            for d in (*path, bins[at][0]):
                value = value << DIGIT | d
            if min(total * s / shards - lo, hi - total * s / shards) <= near or bins[at][2] == 1 or level + 1 == LEVELS:
                edges[s] = (value + (not low)) << left
                del open_[s]
            else:
                open_[s] = ((*path, bins[at][0]), lo)
    return [edges[s] for s in range(1, shards)]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.col(f"`{id_col}`")).alias("h2"), F.monotonically_increasing_id().alias("h3")]


def shard_of(edges: list[int]) -> Column:
    out = F.lit(0)
    for edge in edges:
        out = out + _at_least(edge).cast("int")
    return out


def assign_shards(docs: DataFrame, shards: int = 24, tolerance: float = 0.001, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, size long, text_crc32 long, shard int, slot long)``: one row per row of ``docs``.

    Rows are in the order of (hash of the text, hash of doc_id, row), so equal texts stand together and
    only a splitter parts them: any group, a third of all rows too, is cut where the bytes ask for it.
    Shards differ by ``tolerance`` of their mean size, or by a row where one is larger. ``slot`` counts
    from 0 in each shard: places are counted in cells of a few thousandths of the rows (a cell that equal
    texts fill is cut by doc_id, one that equal texts of equal ids fill by row), each cell begins where those before it
    end, and the rows are exchanged once. Cases: null text is empty; a very long text is a row like any other and may fill
    a shard; null and repeated doc_ids are rows like any other; an empty table gives no rows; further columns are ignored.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    keys = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        *_keyed(docs, id_col, text_col),
    )
    keys = keep(keys, "shard-keys")
    edges = splitters(keys, shards, tolerance)
    c1, c2, cell = F.shiftright("h1", 64 - CELL_BITS), F.shiftright("h2", 64 - CELL_BITS), ["shard", "c1", "c2", "c3"]
    none, rows = F.lit(0).cast("long"), keys.count()
    # over four times the mean: at most a quarter of the cells
    most = max(256, 4 * rows >> CELL_BITS)
    heavy = [r.c for r in keys.groupBy(c1.alias("c")).count().where(F.col("count") > most).collect()]
    both = F.shiftleft(c1, CELL_BITS) + c2
    heavier = [r.c for r in keys.where(c1.isin(heavy)).groupBy(both.alias("c")).count().where(F.col("count") > most).collect()] if heavy else []
    dealt = keys.select(
        "*",
        shard_of(edges).cast("int").alias("shard"),
        c1.alias("c1"),
        (F.when(c1.isin(heavy), c2).otherwise(none) if heavy else none).alias("c2"),
        # rows of one partition in a row
        (F.when(both.isin(heavier), F.shiftright("h3", CELL_BITS)).otherwise(none) if heavier else none).alias("c3"),
    )
    size = dealt.groupBy(cell).agg(F.count("*").alias("n"))
    begin = F.sum("n").over(W.partitionBy("shard").orderBy("c1", "c2", "c3")) - F.col("n")
    begin = keep(size.select(*cell, begin.alias("begin")), "shard-cells")
    in_cell = F.row_number().over(W.partitionBy(cell).orderBy("h1", "h2", "h3"))
    out = dealt.join(begin, cell)
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("begin") + in_cell - 1).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 24, files: int | None = None, tolerance: float = 0.001, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write ``docs`` as Parquet under ``path/shard=0`` and so on, each shard in up to ``files`` files, by default as many as
    its bytes ask for at FILE_BYTES each.

    Cases: null text is empty; a very long text is a row like any other; null and repeated ids and repeated rows are rows of
    their own, spread over the files; an empty table writes no shard; further columns are written as they are, but ``docs`` may
    not have a column ``shard``, which names the folders.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    size = (F.octet_length(text) + OVERHEAD).cast("long").alias("size")
    keys = keep(docs.select(size, *_keyed(docs, id_col, text_col)), "shard-keys")
    edges = splitters(keys, shards, tolerance)
    files = files or max(1, -(-(keys.agg(F.sum("size")).first()[0] or 0) // (shards * FILE_BYTES)))
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"), *_keyed(docs, id_col, text_col))
    # the row parts equal texts of equal ids
    file = F.pmod(F.xxhash64("h1", "h2", "h3"), F.lit(files))
    rows = rows.select("doc", file.alias("file"), shard_of(edges).alias("shard")).repartition(shards * files, "shard", "file")
    rows.select("doc.*", "shard").write.partitionBy("shard").parquet(path)
