import random
import re
import time
from pathlib import Path

import numpy as np
import xxhash
from samples import prose

from tidelog.llm.repeats import GRAM, LEAST_WORDS, RAGGED, WINDOW, remove_repeats, repeated_passages, taken, units
from tidelog.session import shared_dir


def plain_units(text):
    out = []
    for line in re.finditer(r"[^\n]+", text or ""):
        at = line.start()
        for piece in re.split(r"(?<=[.!?])(?=\s)", line.group()):
            words = piece.split()
            if words:
                lead = len(piece) - len(piece.lstrip())
                out.append((at + lead, at + len(piece), " ".join(words).lower()))
            at += len(piece)
    return out


def plain(rows, least):
    """Spans to remove, from (doc_id, text) rows in the order of their rank."""
    seen, out = {}, []
    for i, text in rows:
        run = []
        for start, end, unit in [*plain_units(text), (0, 0, None)]:
            if unit is not None and unit in seen:
                run.append((start, end, len(unit.split()), seen[unit]))
                continue
            if sum(r[2] for r in run) >= least and run:
                out.append((i, run[0][0], run[-1][1], len(run), sum(r[2] for r in run), run[0][3]))
            run = []
            if unit is not None:
                seen[unit] = i
    return sorted(out)


def sentences(seed, n):
    return " ".join(prose(f"{seed}{k}", 7).capitalize() + "." for k in range(n))


PASSAGE = sentences("passage", 9)
ROWS = [
    (1, f"{sentences('a', 5)} {PASSAGE} {sentences('b', 4)}"), (2, f"Half a {PASSAGE} and on. {sentences('c', 3)}"), (3, sentences("d", 20)),
    (4, f"é ß {PASSAGE.upper()}\n\n{sentences('e', 2)}\n{sentences('a', 5)}"), (5, "Short one. Short one. Short one."), (6, None), (7, ""), (8, " \n . ! ? \n"),
    (9, f"{sentences('f', 1)}\n" * 4), (10, sentences("d", 20)), (11, prose("long", 20_000)), (12, "no end\nno end " + "x" * 1000), (13, f"{PASSAGE}{PASSAGE}"),
]


def test_units():
    for _, text in ROWS:
        assert [(a, b, " ".join(text[a:b].lower().split())) for a, b, _ in plain_units(text)] == list(units(text or ""))


def test_against_brute_force(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    for least in (1, 20, 60):
        assert sorted(map(tuple, repeated_passages(df, least).collect())) == plain(ROWS, least)
    caught = {r.doc_id for r in repeated_passages(df).collect()}
    assert {2, 4, 10} <= caught and not caught & {1, 3, 5, 6, 7, 8, 11, 12}


def test_removal(spark):
    df = spark.createDataFrame([(i, t, None if t is None else len(t), "k") for i, t in ROWS], "doc_id long, text string, n_chars long, `end` string")
    spans = {}
    for i, a, b, *_ in plain(ROWS, 20):
        spans.setdefault(i, []).append((a, b))
    out = {r.doc_id: r for r in remove_repeats(df).collect()}
    for i, text in ROWS:
        want = text
        for a, b in sorted(spans.get(i, []), reverse=True):
            want = want[:a] + want[b:]
        assert out[i].text == want and out[i].n_chars == (None if want is None else len(want)) and out[i].end == "k"
        assert [tuple(s) for s in out[i].removed] == sorted(spans.get(i, []))


def test_cases(edge_docs, no_docs):
    assert repeated_passages(no_docs).count() == 0
    rows = repeated_passages(edge_docs).collect()
    assert sorted((r.doc_id or -1) for r in rows) == [-1, 6, 6] and {r.kept_doc_id for r in rows} == {5}
    assert remove_repeats(edge_docs).count() == edge_docs.count()
    assert remove_repeats(no_docs).columns == [*no_docs.columns, "removed"]


def test_whole_lines_go_at_any_length(spark):
    rows = [
        (1, "A note.\nTwo parts. In a line.\nNine words are in this line, and no more.\nShort."), (2, "First\n  a  NOTE.\nLast"), (3, "On and two parts. In a line.\nTwo parts.  In a line.\nOn."),
        (4, "New text. A note. More.\nShort.\nnine words are in this line, and no more."), (5, "Twice.\nTwice."), (6, "No end\n\nNo end\n"), (7, "Odd. A note"),
    ]
    got = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    text = dict(rows)
    assert sorted((r.doc_id, text[r.doc_id][r.start : r.end], r.n_units, r.n_words, r.kept_doc_id) for r in got) == [
        (2, "a  NOTE.", 1, 2, 1), (3, "Two parts.  In a line.", 2, 5, 1), (4, "Short.\nnine words are in this line, and no more.", 2, 10, 1), (5, "Twice.", 1, 1, 5), (6, "No end", 1, 2, 6),
    ]


def test_passages_inside_sentences(spark):
    """Every 50 words that repeat hold a span, wherever they begin and end."""
    rng, vocabulary = random.Random(8), [f"w{i}" for i in range(3000)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    shared = [words(50 + 3 * i) for i in range(12)]
    texts = [" ".join([*words(20 + i), *p, *words(30)]) for i, p in enumerate(shared)]
    again = [("  ".join(words(7 + i)) + "\n", f"{' '.join(p[:20])} \n{' '.join(p[20:])}".upper(), "\té " + " ".join(words(9))) for i, p in enumerate(shared)]
    rows = [*enumerate(texts), *((100 + i, "".join(x)) for i, x in enumerate(again)), (200, " ".join(words(400))), (201, "tie " * 49)]
    got = {}
    for r in repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sorted(got) == list(range(100, 112))
    for i, (head, passage, _) in enumerate(again):
        (r,) = got[100 + i]
        inside = rows[12 + i][1][r.start : r.end]
        assert inside in passage and len(inside.split()) == r.n_words >= 26 and r.kept_doc_id == i and r.start >= len(head)


def taken_grams(words):
    """Places of grams of GRAM words whose number is least in some WINDOW of them, by whole numbers, window by window."""
    top, numbers = (1 << 64) - 1, []
    for i in range(len(words) - GRAM + 1):
        x = 0
        for w in words[i : i + GRAM]:
            x = (x * 0x9E3779B97F4A7C15 + xxhash.xxh3_64_intdigest(w.encode())) & top
        x = ((x ^ x >> 31) * 0xBF58476D1CE4E5B9) & top
        numbers.append(x ^ x >> 29)
    out = set()
    for i in range(len(numbers) - WINDOW + 1):
        part = numbers[i : i + WINDOW]
        least = [i + j for j, x in enumerate(part) if x == min(part)]
        if not out & set(least):
            out.add(least[-1])
    return sorted(out)


def plain_default(rows):
    """All that the query does, text by text, over (doc_id, text) rows in the order of their rank."""
    seen, out = {}, []
    for n, (doc, text) in enumerate(rows):
        text, places, at = text or "", [], 0
        for start, end, unit in plain_units(text):
            places.append({"at": at, "start": start, "end": end, "words": len(unit.split()), "line": text.count("\n", 0, start), "unit": unit})
            at += len(unit.split())
        of_line = {}
        for p in places:
            of_line.setdefault(p["line"], []).append(p)
        words = [(m.start(), m.end()) for m in re.finditer(r"\S+", text)]
        grams = [{"at": i, "start": words[i][0], "end": words[i + GRAM - 1][1], "words": GRAM, "unit": "\n".join(text.lower().split()[i : i + GRAM])} for i in taken_grams(text.lower().split())]
        # a whole line of several units is a unit of its own; what was there first is told by (text, place)
        lines = [{"at": u[0]["at"], "unit": " ".join(p["unit"] for p in u), "of": u} for u in of_line.values() if len(u) > 1]
        for p in sorted([*places, *lines, *grams], key=lambda p: p["at"]):
            seen.setdefault(p["unit"], (n, p["at"], doc))
        again = lambda p, apart: seen[p["unit"]][0] != n or p["at"] - seen[p["unit"]][1] >= apart  # noqa: E731, B023
        for p in places:
            p["again"], p["whole"] = again(p, 1), len(of_line[p["line"]]) == 1
        for line in lines:
            if again(line, 1):
                for p in line["of"]:
                    p["whole"] = True
        kept, run = [], []
        for p in [*places, {"again": False}]:
            if p["again"]:
                run.append(p)
                continue
            enough = sum(x["words"] for x in run) >= LEAST_WORDS
            kept += [x for x in run if enough or x["whole"]]
            run = []
        covered = {w for p in kept for w in range(p["at"], p["at"] + p["words"])}
        kept = [(p["at"], 0, p, 1) for p in kept]
        kept += [(p["at"], 1, p, 0) for p in grams if again(p, GRAM) and len(set(range(p["at"], p["at"] + GRAM)) - covered) >= RAGGED]
        spans = []
        for a, _, p, count in sorted(kept, key=lambda x: x[:2]):
            if spans and a <= spans[-1][1]:
                spans[-1][1], spans[-1][3], spans[-1][4] = max(spans[-1][1], a + p["words"]), max(spans[-1][3], p["end"]), spans[-1][4] + count
            else:
                spans.append([a, a + p["words"], p["start"], p["end"], count, seen[p["unit"]][2]])
        out += [(doc, s, e, c, hi - lo, first) for lo, hi, s, e, c, first in spans]
    return sorted(out)


def test_the_whole_query_against_brute_force(spark):
    rng = random.Random(12)
    vocabulary = [f"{a}{b}" for a in "abcdefghij" for b in ("an", "Er", "ing", "ly,", "é")]
    sentence = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n)) + rng.choice([".", "!", "?", "...", ""])
    stock = [sentence(rng.randrange(1, 15)) for _ in range(40)] + [" ".join(sentence(rng.randrange(3, 40)) for _ in range(3)) for _ in range(6)]
    rows = list(ROWS)
    for i in range(60):
        parts = []
        for _ in range(rng.randrange(12)):
            part = rng.choice(stock) if rng.random() < 0.6 else sentence(rng.randrange(1, 60))
            if rng.random() < 0.2:
                part = " ".join(part.split()[rng.randrange(3) :])
            parts += [part, rng.choice([" ", "\n", "  ", " \n\n"])]
        rows.append((100 + i, "".join(parts)))
    got = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    want = plain_default(rows)
    assert sorted(map(tuple, got.collect())) == want
    assert {w[3] == 0 for w in want} == {True, False} and any(w[4] < LEAST_WORDS for w in want)


def test_every_window_has_its_gram():
    """Also where grams repeat, and few are taken there."""
    rng = random.Random(6)
    for words in ([rng.choice("ab") for _ in range(400)], ["a"] * 300, list("abc") * 100, [str(i) for i in range(200)], [*map(str, range(60)), *["x"] * 120, *map(str, range(60))]):
        hashes = np.array([xxhash.xxh3_64_intdigest(w.encode()) for w in words], np.uint64)
        assert taken(hashes).tolist() == taken_grams(words)
    assert len(taken(np.full(1000, 7, np.uint64))) <= 1000 // WINDOW


def test_time_goes_with_the_text(spark):
    """Long rows of marks, and of repeats, in one text."""
    dots, many = "." * 1_000_000 + "a", "On and on. Off.\n" * 60_000
    assert [u[:2] for u in units(dots)] == [(0, len(dots))] and len(list(units("! " * 300_000))) == 300_000
    df = spark.createDataFrame([(1, dots, 0), (2, many, 0)], "doc_id long, text string, n_chars long")
    began = time.time()
    got = {r.doc_id: r for r in remove_repeats(df).collect()}
    assert time.time() - began < 60
    assert got[1].text == dots and got[2].text.rstrip("\n") == "On and on. Off."


def test_what_is_shuffled_lies_on_disk_part_by_part(spark):
    """No query shuffles more than a part of the places, and it and the places are gone from the disk before the result is asked for."""
    texts = [sentences(f"part{i}-", 40) for i in range(60)]
    df = spark.createDataFrame([*enumerate(texts), (100, texts[0])], "doc_id long, text string").repartition(3).localCheckpoint()
    store, env = spark.sparkContext._jsc.sc().statusStore(), spark._jvm.org.apache.spark.SparkEnv.get()

    def written():
        found = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteRecords() for i in range(found.size())}

    def on_disk():
        files = env.blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
        return {f for f in files if "shuffle_" in f} | {str(f) for f in Path(shared_dir(spark), "tidelog").glob("*units-*")}

    stages, files = set(written()), on_disk()
    out = repeated_passages(df)
    until = time.time() + 20
    while on_disk() - files and time.time() < until:
        time.sleep(0.2)
    assert not on_disk() - files
    sent = [n for stage, n in written().items() if stage not in stages]
    assert 0 < max(sent) < sum(len(list(units(x))) for x in texts) / 2
    assert [(r.doc_id, r.start, r.end, r.kept_doc_id) for r in out.collect()] == [(100, 0, len(texts[0]), 0)]
