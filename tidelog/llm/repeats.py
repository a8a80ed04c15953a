"""Repeated passages by hashing of lines, cut at the ends of their sentences."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial, reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.session import clearing, forget, keep

#: Words that repeated sentences in a row hold together before they are removed; whole lines go at any length.
LEAST_WORDS = 20
#: Words of a gram, and grams in a row of which one is taken: every 50 words hold a taken gram.
GRAM, WINDOW = 26, 25
#: Words of a repeated gram that runs of units must leave over for it to be removed: less is the ragged end of a run.
RAGGED = 8
#: Hashes of words remembered by a task.
MEMORY = 200_000
#: Units handed on at once.
STEP = 100_000
#: Parts of the digests, a power of two, grouped one after another: what is shuffled lies on disk for one part only.
PARTS = 4
#: Where a unit ends, found in one pass: after a mark that white space or the end follows, or before a line break.
_END, _BEGIN = re.compile(r"[.!?](?=\s|\Z)|\n"), re.compile(r"\S")
#: ``at`` is the place of the first word among the text's; ``lines`` is 0 for a part of a line, 1 for a unit that is a whole
#: line, and the number of units for a line of several, which is a row besides those of its units; -1 for a gram.
_PLACE = "rid long, doc_id {kind}, at int, start int, end int, words int, lines int, h1 long, h2 long"
_SPAN = "rid long, doc_id {kind}, start long, end long, n_units long, n_words long, kept_doc_id {kind}"


def units(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, normalised text) of each unit: lower-cased, with single spaces; offsets are in code points."""
    at = 0
    for m in chain(_END.finditer(text), [None]):
        end = len(text) if m is None else m.start() if m.group() == "\n" else m.end()
        if begin := _BEGIN.search(text, at, end):
            yield begin.start(), end, " ".join(text[begin.start() : end].lower().split())
        at = end


def _places(text: str) -> Iterator[tuple[int, int, int, int, int, str]]:
    """(at, start, end, words, lines, normalised text) of each unit, and of each line of several units."""
    at, line = 0, []

    def ended() -> Iterator[tuple[int, int, int, int, int, str]]:
        for place in line:
            yield (*place[:4], int(len(line) == 1), place[5])
        if len(line) > 1:
            yield (line[0][0], line[0][1], line[-1][2], sum(x[3] for x in line), len(line), " ".join(x[5] for x in line))

    for start, end, unit in units(text):
        if line and text.find("\n", line[-1][2], start) >= 0:
            yield from ended()
            line = []
        words = unit.count(" ") + 1
        line.append((at, start, end, words, 0, unit))
        at += words
    yield from ended()


_SPACE = np.zeros(0x3002, bool)
_SPACE[[c for c in range(0x3001) if chr(c).isspace()]] = True


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= MEMORY:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return found


def taken(h: np.ndarray) -> np.ndarray:
    """Places of the grams of GRAM words that are least of WINDOW in a row, from the hashes of the words: two texts that
    share GRAM + WINDOW - 1 words take the same gram there. Of equal grams, the last in a window, and no more than windows need."""
    n = len(h) - GRAM + 1
    if n < WINDOW:
        return np.zeros(0, np.int64)
    x = np.zeros(n, np.uint64)
    for j in range(GRAM):
        x = x * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    least = x[: n - WINDOW + 1].copy()
    for j in range(1, WINDOW):
        np.minimum(least, x[j : j + len(least)], out=least)
    # a gram is least of some window if the greatest of the leasts around it is its own
    most = np.zeros(n, np.uint64)
    for j in range(WINDOW):
        np.maximum(most[j : j + len(least)], least, out=most[j : j + len(least)])
    at = np.flatnonzero(most == x)
    first = np.flatnonzero(np.r_[True, x[at[1:]] != x[at[:-1]]])
    last = np.r_[first[1:], len(at)]
    stays = np.ones(len(at), bool)
    for a, b in zip(first[last - first > 1].tolist(), last[last - first > 1].tolist(), strict=True):
        # a repetitive stretch: every window whose least it is must hold one of them
        own = at[a:b]
        low = max(0, int(own[0]) - WINDOW + 1)
        windows = low + np.flatnonzero(least[low : own[-1] + 1] == x[own[0]])
        stays[a:b] = False
        k = 0
        while k < len(windows):
            i = int(np.searchsorted(own, windows[k] + WINDOW - 1, "right")) - 1
            stays[a + i] = True
            k = max(k + 1, int(np.searchsorted(windows, own[i], "right")))
    return at[stays]


def _grams(text: str, hashes: _Hashes) -> Iterator[tuple[int, int, int, int, int, str]]:
    """Taken grams as places; they go over the ends of lines."""
    words = text.lower().split()
    if len(words) < GRAM + WINDOW - 1:
        return
    at = taken(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)))
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    edge = np.diff(np.r_[True, _SPACE[np.minimum(points, 0x3001)], True].astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    for i, start, end in zip(at.tolist(), starts[at].tolist(), ends[at + GRAM - 1].tolist(), strict=True):
        # line breaks set them apart from units
        yield i, start, end, GRAM, -1, "\n".join(words[i : i + GRAM])


def _units(batches: Iterator[pa.RecordBatch], grams: bool = True) -> Iterator[pa.RecordBatch]:
    names = ["rid", "doc_id", "at", "start", "end", "words", "lines", "h1", "h2"]

    def made(b: pa.RecordBatch, of: list[int], rows: list[tuple]) -> pa.RecordBatch:
        at = pa.array(of, pa.int64())
        *ints, digests = zip(*rows, strict=True)
        h = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
        return pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), *(pa.array(c, pa.int32()) for c in ints), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy())], names=names)

    hashes = _Hashes()
    for b in batches:
        of, rows = [], []
        for i, text in enumerate(b.column(2)):
            text = text.as_py() or ""
            for *place, unit in chain(_places(text), _grams(text, hashes) if grams else ()):
                of.append(i)
                rows.append((*place, xxhash.xxh3_128_digest(unit.encode("utf-8", "surrogatepass"))))
                if len(rows) >= STEP:
                    yield made(b, of, rows)
                    of, rows = [], []
        if rows:
            yield made(b, of, rows)


def _solved(rows: pa.Table, least_words: int, whole_lines: bool) -> pa.RecordBatch:
    """The spans of whole texts, from their repeated places sorted by (rid, at, lines descending)."""
    rid, at, start, end, words, lines = (rows[c].to_numpy() for c in ("rid", "at", "start", "end", "words", "lines"))
    # places of words over all texts: the text's number above, the word's below
    number = np.cumsum(np.r_[0, rid[1:] != rid[:-1]])
    low = (number.astype(np.int64) << 32) + at
    high = low + words
    unit = np.flatnonzero((lines == 0) | (lines == 1))

    def begins(of: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.r_[True, low[of[1:]] != high[of[:-1]]]) if len(of) else of

    first = begins(unit)
    if len(unit):
        size = np.diff(np.r_[first, len(unit)])
        stays = np.repeat(np.add.reduceat(words[unit], first) < least_words, size)
        if whole_lines:
            # the units of a repeated line follow its row, and all are repeats
            long_ = np.flatnonzero(lines >= 2)
            begun = np.searchsorted(unit, long_)
            inside = np.zeros(len(unit) + 1, np.int64)
            np.add.at(inside, begun, 1)
            np.add.at(inside, begun + lines[long_], -1)
            stays &= (lines[unit] == 0) & (np.cumsum(inside)[:-1] == 0)
        unit = unit[~stays]
        first = begins(unit)
    last = np.r_[first[1:], len(unit)] - 1 if len(first) else first
    a, z, count = unit[first], unit[last], last - first + 1
    gram = np.flatnonzero(lines < 0)
    if len(gram):
        if len(a):
            total = np.r_[0, np.cumsum(high[z] - low[a])]

            def covered(x: np.ndarray) -> np.ndarray:
                k = np.searchsorted(low[a], x)
                return total[k] - np.where(k > 0, np.maximum(high[z][k - 1] - x, 0), 0)

            gram = gram[GRAM - covered(high[gram]) + covered(low[gram]) >= RAGGED]
        a, z, count = np.r_[a, gram], np.r_[z, gram], np.r_[count, np.zeros(len(gram), np.int64)]
        order = np.argsort(low[a], kind="stable")
        a, z, count = a[order], z[order], count[order]
    if len(a):
        # what meets is one span
        furthest = np.maximum.accumulate(high[z])
        span = np.flatnonzero(np.r_[True, low[a[1:]] > furthest[:-1]])
        ends = np.r_[span[1:], len(a)] - 1
        tail = np.maximum.reduceat(end[z].astype(np.int64) + (number[z].astype(np.int64) << 32), span) & 0xFFFFFFFF
        head, held = a[span], furthest[ends] - low[a[span]]
        count = np.add.reduceat(count, span)
    else:
        head, tail, count, held = a, a, a, a
    of = pa.array(head)
    ints = [start[head], tail, count, held]
    columns = [rows["rid"].take(of), rows["doc_id"].take(of), *(pa.array(x.astype(np.int64)) for x in ints), rows["kept"].take(of)]
    return pa.table([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], names=["rid", "doc_id", "start", "end", "n_units", "n_words", "kept_doc_id"])


def _runs(least_words: int, whole_lines: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            rid = b.column(0).to_numpy()
            if not held or held[-1].column(0)[-1].as_py() != rid[-1]:
                cut = int(np.searchsorted(rid, rid[-1]))
                held.append(b.slice(0, cut))
                yield from _solved(pa.Table.from_batches(held), least_words, whole_lines).to_batches()
                held = [b.slice(cut)]
            else:
                held.append(b)
        if held:
            yield from _solved(pa.Table.from_batches(held), least_words, whole_lines).to_batches()

    return run


def _spans(rows: DataFrame, least_words: int | None) -> DataFrame:
    """(rid, doc_id, start, end, n_units, n_words, kept_doc_id) of the runs to remove, from rows of (rid, doc_id, text)."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(partial(_units, grams=least_words is None), _PLACE.format(kind=kind))
    found = keep(found.withColumn("part", F.col("h1").bitwiseAND(PARTS - 1).cast("int")), "units", "part")
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "rid", "at")
    # a gram that overlaps its own first occurrence is no repeat
    apart = F.when(F.col("lines") < 0, F.col("words")).otherwise(1)
    repeats = []
    with clearing(rows.sparkSession):
        for i in range(PARTS):
            places = found.where(F.col("part") == i)
            first = places.groupBy("h1", "h2").agg(F.min(rank).alias("first"), F.count("*").alias("n")).where("n > 1").select("h1", "h2", "first")
            first = keep(first, "repeated-units")
            again = places.join(first, ["h1", "h2"]).where((F.col("rid") != F.col("first.rid")) | (F.col("at") - F.col("first.at") >= apart))
            repeats.append(keep(again.select("rid", "doc_id", "at", "start", "end", "words", "lines", F.col("first.doc_id").alias("kept")), "repeats"))
            forget(first)
    forget(found)
    again = reduce(DataFrame.union, repeats)
    again = again.repartition("rid").sortWithinPartitions("rid", "at", F.desc("lines"))
    solve = _runs(LEAST_WORDS if least_words is None else least_words, least_words is None)
    return again.mapInArrow(solve, _SPAN.format(kind=kind))


def repeated_passages(docs: DataFrame, least_words: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, start, end, n_units, n_words, kept_doc_id)``: the stretches of the texts to remove as repeats.

    A unit is a line, or a sentence of it: passages are shared inside lines too. Digests of normalised units are grouped
    over all documents; the occurrence that is first by (doc_id, row, place) stays. Of further ones a whole line is
    removed whatever its length; sentences within lines where repeated units in a row hold LEAST_WORDS together, so
    that short sentences which recur by chance stay. Passages that begin and end inside sentences are found by grams of
    GRAM words, least of WINDOW in a row: a repeat of 50 words always holds one, and it goes unless the runs of units leave
    under RAGGED words of it. ``least_words`` asks for runs of units of that length alone. Offsets are code points of the original text; ``kept_doc_id`` has the first occurrence of the first
    unit or gram; ``n_units`` counts whole units.
    A hot unit is reduced by partial aggregation, and in the join with the (written) table of repeated digests
    its partition can be split. Digests are grouped in PARTS by their own bits, one after another, and what a part shuffled is
    removed before the next. Cases: null and empty texts have no units; null doc_ids rank last; repeated rows
    are rows of their own, the later ones repeats; repeats within a text count; an empty table gives no rows;
    further columns are ignored.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return _spans(rows, least_words).drop("rid")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for text, spans in zip(b.column(2), b.column(1), strict=True):
            text = text.as_py()
            if spans := spans.as_py():
                edges = [0, *(x for s in spans for x in (s["start"], s["end"])), len(text)]
                text = "".join(text[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True))
            out.append(text)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], names=["doc", "removed", "left"])


def remove_repeats(docs: DataFrame, least_words: int | None = None, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with those stretches cut out, ``chars_col`` set anew there, and ``removed``, their original offsets.

    Rows are written once with a number each, by which spans find their row again; a text is cut in one pass.
    Cases: null and empty texts stay as they are, with nothing removed; very long texts are worked on whole; repeated rows
    lose all but the first one's text and stay as rows; an empty table gives no rows; further columns pass through, whatever
    their names.
    """
    names = docs.columns
    row = F.struct([F.col(f"`{c}`") for c in names]).alias("doc")
    numbered = keep(docs.select(row, F.monotonically_increasing_id().alias("rid")), "numbered")
    spans = _spans(numbered.select("rid", F.col("doc")[id_col].alias("doc_id"), F.col("doc")[text_col].cast("string").alias("text")), least_words)
    spans = keep(spans.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("removed")), "removed")
    none = F.array().cast("array<struct<start:long,end:long>>")
    out = numbered.join(spans, "rid", "left").withColumn("removed", F.coalesce("removed", none))
    text = F.col("doc")[text_col].cast("string")
    schema = out.select("doc", "removed", text.alias("left")).schema
    out = out.select("doc", "removed", text.alias("left")).mapInArrow(_cut, schema)
    columns = []
    for c in names:
        value = F.col("left") if c == text_col else F.col("doc")[c]
        if c == chars_col:
            value = F.when(F.size("removed") > 0, F.char_length("left").cast(docs.schema[c].dataType)).otherwise(value)
        columns.append(value.alias(c))
    return out.select(*columns, F.col("removed"))
