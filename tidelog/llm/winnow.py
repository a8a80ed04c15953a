"""Benchmark decontamination by winnowed word-gram fingerprints."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.session import keep

#: A window's words; grams of GRAM words, the least of every WINDOW - GRAM + 1 is kept, so that every
#: shared run of WINDOW words has a kept gram in common.
WINDOW, GRAM = 8, 4
#: Bytes of benchmark text that one pass over the documents looks for; a larger benchmark takes more passes.
BLOCK_BYTES = 8 << 20
#: Bytes of document text worked on at once (a longer word or document is taken whole).
STEP = 1 << 19
#: Item ids written out in one batch of results, but for a single text's.
MOST_IDS = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x41:0x5B] = _WORD[0x61:0x7B] = _WORD[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(STEP, int(_BASE)), _powers(STEP, pow(int(_BASE), -1, 1 << 64))


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _words(raw: np.ndarray, doc_start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of the words of texts laid end to end; ``doc_start`` has each text's first byte."""
    n = len(raw)
    inner = doc_start[(doc_start > 0) & (doc_start < n)]
    word = _WORD[raw]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = word[:-1], word[1:]
    before[inner] = False
    after[inner - 1] = False
    start, end = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    low, hashes = _LOWER[raw], np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        first = start[at]
        to = max(int(np.searchsorted(end, first + STEP - 1, "right")), at + 1)
        span = int(end[to - 1] - first)
        up, down = (_UP, _DOWN) if span <= STEP else (_powers(span, int(_BASE)), _powers(span, pow(int(_BASE), -1, 1 << 64)))
        total = np.zeros(span + 1, np.uint64)
        np.cumsum((low[first : first + span].astype(np.uint64) + np.uint64(1)) * up[:span], out=total[1:])
        a, b = start[at:to] - first, end[at:to] - first
        hashes[at:to] = _mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64))
        at = to
    return start, end, hashes


def _grams(h: np.ndarray, k: int) -> np.ndarray:
    n = max(0, len(h) - k + 1)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * _BASE + h[i : i + n]
    return _mix(out)


def _kept(grams: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """For each window the position of its least gram (the leftmost of equals)."""
    best, low = windows.copy(), grams[windows]
    for i in range(1, WINDOW - GRAM + 1):
        now = grams[windows + i]
        less = now < low
        best[less], low[less] = windows[less] + i, now[less]
    return best


def _doc_of(start: np.ndarray, doc_start: np.ndarray) -> np.ndarray:
    return np.searchsorted(doc_start, start, "right") - 1


def _within(doc: np.ndarray, k: int) -> np.ndarray:
    """First words of the runs of k words that stay in one text."""
    n = len(doc) - k + 1
    return np.flatnonzero(doc[:n] == doc[k - 1 :]) if n > 0 else np.empty(0, np.int64)


def _laid(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)


def _ranges(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers from each ``lo`` on, ``n`` of them, one after the other."""
    return np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


class _Text:
    """Texts laid end to end, and their words."""

    def __init__(self, texts: list[bytes]):
        raw, self.begin = _laid(texts)
        self.low = _LOWER[raw]
        self.start, self.end, self.hash = _words(self.low, self.begin)
        self.of = _doc_of(self.start, self.begin)


def _same(a: _Text, p: np.ndarray, b: _Text, q: np.ndarray, k: int) -> np.ndarray:
    """Whether the k words from p of one and from q of the other have the same bytes."""
    ok = np.ones(len(p), bool)
    for i in range(k):
        at = np.flatnonzero(ok)
        x, y = p[at] + i, q[at] + i
        size = a.end[x] - a.start[x]
        same = size == b.end[y] - b.start[y]
        ok[at[~same]] = False
        at, x, y, size = at[same], x[same], y[same], size[same]
        upto, lo = np.cumsum(size), 0
        while lo < len(at):
            # bounded by bytes; a longer word is compared by itself
            hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] - size[lo] + STEP, "right")))
            n = size[lo:hi]
            differ = a.low[_ranges(a.start[x[lo:hi]], n)] != b.low[_ranges(b.start[y[lo:hi]], n)]
            ok[at[lo:hi]] = np.add.reduceat(differ, np.cumsum(n) - n) == 0
            lo = hi
    return ok


class _Windows:
    """The distinct windows of k words of the items: each has one place in their text and a list of items."""

    def __init__(self, text: _Text, k: int, at: np.ndarray, rank: np.ndarray):
        h = _grams(text.hash, k)[at]
        order = np.lexsort((at, h))
        h, at = h[order], at[order]
        owner, left = np.arange(len(at)), np.arange(len(at))
        # windows of one hash are one unless their words differ; those that do are told apart in further rounds
        while len(left):
            first = np.flatnonzero(np.r_[True, h[left[1:]] != h[left[:-1]]])
            heads = left[np.repeat(first, np.diff(np.r_[first, len(left)]))]
            same = _same(text, at[left], text, at[heads], k)
            owner[left[same]] = heads[same]
            left = left[~same]
        heads, number = np.unique(owner, return_inverse=True)
        self.k, self.hash, self.at = k, h[heads], at[heads]
        # (window, item) without repeats, in order
        held = np.unique(number * len(rank) + rank[text.of[at]])
        self.items, self.first = held % len(rank), np.searchsorted(held // len(rank), np.arange(len(heads) + 1))
        self.grams = None
        if k == WINDOW:
            grams = _grams(text.hash, GRAM)
            self.grams = np.unique(grams[_kept(grams, self.at)])

    def occurrences(self, text: _Text, index: _Text) -> tuple[np.ndarray, np.ndarray]:
        """(word, window): the windows that occur in texts, each place with one window at most."""
        p = _within(text.of, self.k)
        if self.grams is not None and len(p):
            # join on the kept grams; a hit extends to the windows that keep that gram
            grams = _grams(text.hash, GRAM)
            best = _kept(grams, p)
            kept = np.unique(best)
            found = np.zeros(len(grams), bool)
            found[kept] = _in(grams[kept], self.grams)
            p = p[found[best]]
        h = _grams(text.hash, self.k)[p]
        w = np.searchsorted(self.hash, h)
        hits_p, hits_w = [], []
        while len(p):
            there = w < len(self.hash)
            there[there] = self.hash[w[there]] == h[there]
            p, h, w = p[there], h[there], w[there]
            same = _same(text, p, index, self.at[w], self.k)
            hits_p.append(p[same])
            hits_w.append(w[same])
            # another window of the same hash
            p, h, w = p[~same], h[~same], w[~same] + 1
        return np.concatenate([*hits_p, np.zeros(0, np.int64)]), np.concatenate([*hits_w, np.zeros(0, np.int64)])


def _in(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    at = np.searchsorted(table, x)
    out = at < len(table)
    out[out] = table[at[out]] == x[out]
    return out


class Index:
    """A block of benchmark items as distinct windows, so that a phrase shared by many items is looked up once."""

    def __init__(self, items: list[tuple[str, str]]):
        self.ids = sorted({i for i, _ in items})
        rank = {x: n for n, x in enumerate(self.ids)}
        of = np.array([rank[i] for i, _ in items], np.int64)
        self.text = _Text([t.encode("utf-8", "surrogatepass") for _, t in items])
        item = self.text.of
        first, n = np.unique(item, return_index=True)[1], np.bincount(item, minlength=len(items))
        self.windows = []
        for k in range(1, WINDOW + 1):
            at = _within(item, k) if k == WINDOW else first[n[item[first]] == k]
            if len(at):
                self.windows.append(_Windows(self.text, k, at, of))


def find(texts: list[bytes], index: Index) -> list[tuple[int, list[tuple[int, int, int, int]], list[tuple[_Windows, np.ndarray]]]]:
    """For each text: its number of words, the runs of hit words as (word, word end, byte, byte end), the windows found."""
    t, n = _Text(texts), len(texts)
    start, end, doc = t.start, t.end, t.of
    cover, found = np.zeros(len(start) + 1, np.int64), [[] for _ in texts]
    for windows in index.windows:
        p, w = windows.occurrences(t, index.text)
        np.add.at(cover, p, 1)
        np.add.at(cover, p + windows.k, -1)
        if not len(p):
            continue
        # a window counts once a text, however often it occurs there
        d, w = np.divmod(np.unique(doc[p] * len(windows.at) + w), len(windows.at))
        edges = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
        for a, b in zip(edges, np.r_[edges[1:], len(d)], strict=True):
            found[d[a]].append((windows, w[a:b]))
    hit = np.cumsum(cover[:-1]) > 0
    edge = np.concatenate([[False], hit[:-1]])
    edge[1:] &= doc[1:] == doc[:-1]
    after = np.concatenate([hit[1:], [False]])
    after[:-1] &= doc[1:] == doc[:-1]
    a, b = np.flatnonzero(hit & ~edge), np.flatnonzero(hit & ~after)
    words = np.bincount(doc, minlength=n)
    first, runs = np.cumsum(words) - words, [[] for _ in texts]
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        d = doc[x]
        runs[d].append((x - int(first[d]), y + 1 - int(first[d]), int(start[x] - t.begin[d]), int(end[y] - t.begin[d])))
    return list(zip(words.tolist(), runs, found, strict=True))


def n_items(found: list[tuple[_Windows, np.ndarray]]) -> int:
    """Items of windows, those of several windows counted for each."""
    return sum(int((x.first[w + 1] - x.first[w]).sum()) for x, w in found)


def items_of(found: list[tuple[_Windows, np.ndarray]]) -> np.ndarray:
    """Places in an index's ``ids`` of the items that hold any of the windows, in order."""
    return np.unique(np.concatenate([np.zeros(0, np.int64), *(x.items[_ranges(x.first[w], x.first[w + 1] - x.first[w])] for x, w in found)]))


_RUNS = pa.list_(pa.struct([("word", pa.int64()), ("word_end", pa.int64()), ("byte", pa.int64()), ("byte_end", pa.int64())]))
_ADDED = "n_words long, runs array<struct<word:long,word_end:long,byte:long,byte_end:long>>, items array<string>"


def _merged(runs: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    out: list[tuple[int, int, int, int]] = []
    for r in sorted(runs):
        if out and r[0] <= out[-1][1]:
            w, we, b, be = out[-1]
            out[-1] = (w, max(we, r[1]), b, max(be, r[3]))
        else:
            out.append(r)
    return out


def _runs_array(runs: list[list[tuple[int, int, int, int]]]) -> pa.Array:
    flat = np.array([r for x in runs for r in x], np.int64).reshape(-1, 4)
    offsets = np.cumsum([0, *map(len, runs)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, i])) for i in range(4)], fields=list(_RUNS.value_type)))


def _without(raw: bytes, runs: list[tuple[int, int, int, int]]) -> str:
    """A text less its runs."""
    edges = [0, *(x for r in runs for x in r[2:]), len(raw)]
    return b"".join(raw[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)).decode("utf-8", "surrogatepass")


def _scan(index: Index, text_at: int, drop_text: bool, hits_only: bool = False, most_items: int | None = None):
    """The columns of a batch (but for the text, if it is dropped) with what was found in their texts; with ``most_items`` the
    rows of no more items than that, with ``cut``, the text less its runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = pa.array(index.ids, pa.string())

        def made(b: pa.RecordBatch, found: list) -> Iterator[pa.RecordBatch]:
            # ids are written out for each text, so texts that hold many make batches of their own
            upto = np.cumsum([n_items(x[2]) for x in found])
            at = 0
            while at < len(found):
                to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + MOST_IDS, "right")))
                n, runs, items = zip(*found[at:to], strict=True)
                items = list(map(items_of, items))
                old = [c.slice(at, to - at) for i, c in enumerate(b.columns) if not (drop_text and i == text_at)]
                offsets = pa.array(np.cumsum([0, *map(len, items)]).astype(np.int32))
                new = [pa.array(n, pa.int64()), _runs_array(list(runs)), pa.ListArray.from_arrays(offsets, ids.take(pa.array(np.concatenate(items))))]
                names = [*(f"c{i}" for i in range(len(old))), "n_words", "runs", "items"]
                if most_items is not None:
                    texts = b.column(text_at).slice(at, to - at)
                    cut = [_without(t.as_py().encode("utf-8", "surrogatepass"), r) if r and len(x) <= most_items else t.as_py() for t, r, x in zip(texts, runs, items, strict=True)]
                    new, names = [*new, pa.array(cut, pa.string())], [*names, "cut"]
                out = pa.RecordBatch.from_arrays(old + new, names=names)
                if most_items is not None:
                    out = out.filter(pa.array([len(x) <= most_items for x in items]))
                yield out.filter(pa.array([len(r) > 0 for r in runs])) if hits_only else out
                at = to

        for b in batches:
            held, size, first = [], 0, 0
            for i, t in enumerate(b.column(text_at)):
                held.append((t.as_py() or "").encode("utf-8", "surrogatepass"))
                size += len(held[-1])
                if size >= STEP or i + 1 == b.num_rows:
                    yield from made(b.slice(first, len(held)), find(held, index))
                    held, size, first = [], 0, i + 1

    return run


def _cut(text_at: int):
    """Batches with the texts less their runs as a further column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            runs = [[tuple(r.values()) for r in x] for x in b.column("runs").to_pylist()]
            cut = [_without(t.as_py().encode("utf-8", "surrogatepass"), r) if r else t.as_py() for t, r in zip(b.column(text_at), runs, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cut, pa.string())], names=[*b.schema.names, "cut"])

    return run


def _pieces(block_bytes: int):
    """Items in pieces of a quarter of a block at most, where their words allow it; neighbours share all but one word of a
    window, so that each window lies in a piece, and an item of fewer words than a window stays whole."""
    most = max(1, block_bytes // 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of, out = [], []
            for i, t in enumerate(b.column(1)):
                raw = t.as_py().encode("utf-8", "surrogatepass")
                if len(raw) <= most:
                    of.append(i)
                    out.append(raw)
                    continue
                x = _Text([raw])
                lo, n = 0, len(x.start)
                while True:
                    hi = min(n, max(lo + WINDOW, int(np.searchsorted(x.end, x.start[lo] + most, "right")) if n else 0))
                    of.append(i)
                    out.append(raw[x.start[lo] : x.end[hi - 1]] if n else b"")
                    if hi >= n:
                        break
                    lo = hi - WINDOW + 1
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of, pa.int64())), pa.array([r.decode("utf-8", "surrogatepass") for r in out], pa.string())], names=["i", "t"])

    return run


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> list[Callable[[], Index]]:
    """The benchmark in blocks, each collected when it is asked for. Their sizes are known before: pieces are dealt to bins by
    hash, bins are made finer until none is larger than a block, and bins in a row fill a block."""
    items = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("i"), F.col(f"`{text_col}`").cast("string").alias("t")).where("i is not null and t is not null").distinct()
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    collected = lambda rows: Index(sorted((r.i, r.t) for r in rows.collect()))
    if not total:
        return []
    if total <= block_bytes:
        return [lambda: collected(items)]
    items = keep(items.mapInArrow(_pieces(block_bytes), "i string, t string").distinct(), "items")
    n, sizes = 4, {}
    while True:
        n *= max(2, -(-total // block_bytes)) if n == 4 else 2
        bins = F.pmod(F.xxhash64("i", "t"), F.lit(n))
        size = F.octet_length("t") + 1
        sizes = {r.bin: (r.size, r.most) for r in items.groupBy(bins.alias("bin")).agg(F.sum(size).alias("size"), F.max(size).alias("most")).collect()}
        # a bin that one piece of very long words fills cannot be made finer
        if all(s <= max(block_bytes, 2 * m) for s, m in sizes.values()):
            break
    edges, filled = [], block_bytes + 1
    for k in sorted(sizes):
        if filled + sizes[k][0] > block_bytes:
            edges.append(k)
            filled = 0
        filled += sizes[k][0]
    part = lambda lo, hi: lambda: collected(items.where(bins.between(lo, hi - 1)))
    return [part(lo, hi) for lo, hi in zip(edges, [*edges[1:], n], strict=True)]


def find_benchmark(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES, with_docs: bool = False) -> DataFrame:
    """``(doc_id, n_words, runs, items)``: one row per row of ``docs``, or its own columns and these ``with_docs``.

    ``runs`` are the hit words as disjoint spans in words and in bytes of the UTF-8 text; ``items`` the ids, as
    sorted strings, of the items of which a window occurs. The work is local to each document. A block of ``block_bytes`` of
    the benchmark, its size measured before, is sent to every task as distinct windows: a document's windows that keep
    a fingerprint of the block are looked up once each, compared byte by byte, and lead to the items that hold them,
    so that a phrase which many items share costs no pairs of places. A benchmark of several blocks takes a pass over the
    texts for each, and only what was found is written in between. Cases: null or wordless texts and items have no words
    and hit nothing; a null item_id takes no part; an item_id on several rows is one item; repeated or null doc_ids are
    rows of their own; very long texts are worked on whole; an empty table on either side gives rows without hits;
    further columns keep their names, whatever these are.
    """
    return _found(docs, _blocks(benchmark, item_col, item_text_col, block_bytes), id_col, text_col, with_docs)


def _found(docs: DataFrame, blocks: list[Callable[[], Index]], id_col: str, text_col: str, with_docs: bool, most_items: int | None = None) -> DataFrame:
    cols = docs.columns if with_docs else [id_col, text_col]
    df, text_at = docs.select([F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols)]), cols.index(text_col)
    out = [*(cols if with_docs else [id_col]), "n_words", "runs", "items"]
    types = [t for i, (_, t) in enumerate(df.dtypes) if with_docs or i != text_at]
    cut = [] if most_items is None else ["cut"]
    if len(blocks) <= 1:
        index = blocks[0]() if blocks else Index([])
        schema = [*(f"c{i} {t}" for i, t in enumerate(types)), _ADDED, *(f"{c} string" for c in cut)]
        return df.mapInArrow(_scan(index, text_at, not with_docs, most_items=most_items), ", ".join(schema)).toDF(*out, *cut)
    df = keep(df.withColumn("rid", F.monotonically_increasing_id()), "winnow")
    rows, found = df.select("rid", f"c{text_at}"), None
    for block in blocks:
        part = keep(rows.mapInArrow(_scan(block(), 1, True, found is not None), f"c0 long, {_ADDED}"), "winnow-block")
        found = part if found is None else found.union(part)
    held = F.flatten(F.collect_list("runs")).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    found = found.groupBy(F.col("c0").alias("rid")).agg(F.max("n_words").alias("n_words"), *held)
    found = found.mapInArrow(_joined_runs, f"rid long, {_ADDED}")
    left = [f"c{i}" for i in range(len(cols)) if with_docs or i != text_at]
    joined = df.join(found, "rid").select(*left, "n_words", "runs", "items")
    if cut:
        joined = joined.where(F.size("items") <= most_items)
        joined = joined.mapInArrow(_cut(text_at), ", ".join(f"{c} {t}" for c, t in [*joined.dtypes, ("cut", "string")]))
    return joined.toDF(*out, *cut)


def _joined_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        runs = [_merged([tuple(r.values()) for r in x]) for x in b.column("runs").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _runs_array(runs), b.column(3)], names=b.schema.names)


def n_hit() -> F.Column:
    return F.aggregate("runs", F.lit(0).cast("long"), lambda s, r: s + r.word_end - r.word)


def decontaminate(docs: DataFrame, benchmark: DataFrame, most_items: int = 1, text_col: str = "text", chars_col: str | None = "n_chars", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the documents that hold windows of over ``most_items`` items.

    From the others the hit words are cut out, and ``chars_col``, where it exists, is set anew for a text that
    lost any; texts without hits stay as they are. Cases: a null, empty or wordless text stays as it is; the text of a very long
    document is cut in one pass; repeated rows and null ids are rows of their own; an empty table gives no rows, an empty
    benchmark changes none; further columns pass through, whatever their names.
    """
    names = docs.columns
    blocks = _blocks(benchmark, item_col, item_text_col, block_bytes)
    found = _found(docs, blocks, names[0], text_col, True, most_items).toDF(*[f"c{i}" for i in range(len(names))], "n_words", "runs", "items", "cut")
    out = []
    for i, c in enumerate(names):
        value = F.col("cut") if c == text_col else F.col(f"c{i}")
        if c == chars_col:
            value = F.when(F.size("runs") > 0, F.char_length("cut").cast(docs.schema[c].dataType)).otherwise(value)
        out.append(value.alias(c))
    return found.select(out)
