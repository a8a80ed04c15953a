import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from samples import prose

from tidelog.llm import language, toxicity
from tidelog.llm.language import Network, identify_language, predict, windows
from tidelog.llm.toxicity import Model, Sample, features, kernel, sentences, train, units

LETTERS = {"en": "thandingerofst", "xx": "äöüßkzwv", "yy": "ñíóqlj"}


def lang_text(lang, seed, n=60):
    rng = random.Random(f"{lang}{seed}")
    return " ".join("".join(rng.choice(LETTERS[lang]) for _ in range(rng.randrange(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def lang_docs(spark):
    rows = [(i, lang_text(lang, i, 5 + i % 150), lang) for i, lang in enumerate(random.Random(1).choices(list(LETTERS), k=240))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_language_on_held_out_rows(lang_docs):
    truth = {r.doc_id: r.lang for r in lang_docs.collect()}
    rows = identify_language(lang_docs).collect()
    assert len(rows) == len(truth) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.95


def test_convolution_is_what_it_says():
    net = Network(["a", "b"], seed=1)
    x = windows("Some text, é and more " * 30)
    got = net.pooled(x)
    at = 0
    for k, w in enumerate(language.WIDTHS):
        for f in range(language.FILTERS):
            best = max(sum(float(net.filters[k][i][x[1][t + i], f]) for i in range(w)) for t in range(language.WINDOW - w + 1))
            assert abs(max(best, 0) - got[1, at]) < 1e-4
            at += 1
    assert windows("").shape == (1, language.WINDOW) and len(windows("a" * 257)) == 2


def test_every_window_counts():
    net = Network(["en", "xx"])
    texts = [lang_text(l, i, 80) for i in range(30) for l in ("en", "xx")]
    x = np.concatenate([windows(t) for t in texts])
    net.train(x, np.concatenate([[i % 2] * len(windows(t)) for i, t in enumerate(texts)]))
    short, long_ = lang_text("en", 99, 40), lang_text("xx", 99, 4000)
    assert predict(net, [short + " " + long_])[0][0] == "xx" and predict(net, [short])[0][0] == "en"
    assert predict(net, ["", None, "123 !! ² Ⅷ _", "é"])[:3] == [("und", 0.0)] * 3 and predict(net, ["é"])[0][0] != "und"


def test_language_cases(edge_docs, no_docs, lang_docs):
    rows = {r.doc_id: r for r in identify_language(edge_docs).collect()}
    assert identify_language(edge_docs).count() == edge_docs.count()
    assert [rows[i].lang_pred for i in (1, 2, 3, 4)] == ["und"] * 4 and rows[8].lang_pred == "en"
    assert identify_language(no_docs).count() == 0
    blind = lang_docs.selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert {r.lang_pred for r in identify_language(blind).collect()} == {"und"}


def plain_kernel(a, b):
    def subs(u):
        s, out = toxicity._symbols(np.array([*map(ord, u)], np.uint32)), {}
        for i in range(len(u)):
            for j in range(i + 1, len(u)):
                for k in range(j + 1, min(len(u), i + toxicity.SPAN)):
                    if s[i] and s[j] and s[k]:
                        out.setdefault((s[i], s[j], s[k]), []).append(toxicity.DECAY ** (k - i + 1))
        return out

    x, y = subs(a), subs(b)
    norm = [sum(w * w for ws in s.values() for w in ws) ** 0.5 or 1 for s in (x, y)]
    return sum(sum(x[c]) * sum(y[c]) for c in x.keys() & y.keys()) / norm[0] / norm[1]


WORDS = ["stupid", "s.t.u.p.i.d", "stuupid", "the", "a", "", "banana", "größe", "漢字漢字", "x-y-z", "thinging"]


def test_kernel_and_its_collapsed_sum():
    marks = features(WORDS)
    got = kernel(WORDS, marks)
    want = np.array([[plain_kernel(a, b) for b in WORDS] for a in WORDS])
    assert np.allclose(got, want, atol=1e-5)
    beta = np.linspace(-1, 1, len(WORDS))
    model = Model(beta @ marks, 0.25, 1.0, 0.0)
    assert np.allclose(model.margins(WORDS), want @ beta + 0.25, atol=1e-4)


def bags(n, seed):
    rng, out = random.Random(seed), []
    for i in range(n):
        words = prose(f"{seed}{i}", 60).split()
        toxic = rng.random() < 0.4
        if toxic:
            words[rng.randrange(60)] = rng.choice(["stupid", "moron", "stupid!", "moronic"])
        out.append((" ".join(words), int(toxic)))
    return out


def sample(rows):
    batch = pa.RecordBatch.from_arrays([pa.array([t for _, t in rows], pa.int32()), pa.array([x for x, _ in rows], pa.string())], names=["toxic", "text"])
    return Sample.of(pa.Table.from_batches(list(toxicity._bags(iter([batch])))))


def test_training_and_inserted_characters():
    rows = bags(300, "a")
    model = train(sample(rows), 0.4)
    score = toxicity.Scorer(model)
    test = bags(200, "b")
    assert np.mean((score([x for x, _ in test]) >= 0.5) == np.array([t for _, t in test])) > 0.97
    base = prose("c", 50)
    for w in ("stupid", "stu-pid", "s.t.u.p.i.d", "s t u p i d", "stuupid", "m*oron", "MORON"):
        assert score([f"{base} {w} {base}"])[0] >= 0.5, w
    assert score([base, "", None, "..."]).max() < 0.5
    again = train(sample(rows[::-1]), 0.4)
    assert np.array_equal(again.table, model.table)


def test_copies_do_not_make_words_frequent():
    one = (prose("copy", 60) + " unusualword anotherrare onlyhere", 1)
    kept = sample([*bags(60, "d"), *[one] * 40]).apart()
    assert kept.counts(kept.bags[: kept.toxic])[kept.units.index("unusualword")] == 1
    assert sum(len(b) > 0 for b in kept.bags) >= 40


def test_units():
    assert {"a b c d e", "a", "word"} <= units("A b c d e  word")
    assert "i d i o t" in units("you i d i o t or") and "o" in units("you i d i o t or")
    assert max(map(len, units("x" * 1000))) == toxicity.UNIT_CHARS and units("") == set()
    assert sentences("One. Two!\nThree") == ["One.", "Two!", "Three"]


def test_toxicity_query(spark, edge_docs, no_docs):
    rows = bags(200, "e")
    docs = spark.createDataFrame([(i, x, "en", 0.5) for i, (x, _) in enumerate(rows)], "doc_id long, text string, lang string, score double")
    labels = spark.createDataFrame([(i, 1, t) for i, (_, t) in enumerate(rows)] + [(None, 1, 1), (7, 1, None), (8, 1, 9)], "doc_id long, quality int, toxic int")
    found = toxicity.toxicity(docs, labels).collect()
    held = [r for r in found if r.held_out]
    assert len(found) == 200 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
    assert np.mean([r.predicted == rows[r.doc_id][1] for r in held]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found)
    assert toxicity.toxicity(edge_docs, labels).count() == edge_docs.count()
    assert toxicity.toxicity(no_docs, labels).count() == 0
    assert {r.score for r in toxicity.toxicity(edge_docs, labels.where("false")).collect()} == {0.0}


def test_the_driver_holds_no_sample(spark, monkeypatch):
    """Tasks learn: what the driver collects is the model, which is that of the same sample learned at once."""
    rows = bags(120, "far")
    docs = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(rows)], "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, toxic int")
    used = [r for i, r in enumerate(rows) if zlib.crc32(str(i).encode()) % 5]
    want = train(sample(used), sum(t for _, t in used) / len(used))

    driver = os.getpid()

    def apart(*x):
        assert os.getpid() != driver, "the sample is on the driver"
        return train(*x)

    monkeypatch.setattr(toxicity, "train", apart)
    got = toxicity.fit(docs, labels)
    assert np.allclose(got.table, want.table, atol=1e-6) and got.pairs == want.pairs
    assert np.allclose([got.bias, got.slope, got.offset], [want.bias, want.slope, want.offset], atol=1e-4)
    assert toxicity.fit(docs.where("false"), labels) is None and toxicity.fit(docs, labels.where("toxic = 1")) is None


def two_word_bags(n, seed):
    """Two words that are harmless apart and an insult side by side."""
    rng, out = random.Random(seed), []
    for i in range(n):
        words = prose(f"{seed}{i}", 60).split()
        for w in ("dung", "heap", "dung", "heap"):
            words.insert(rng.randrange(len(words)), w)
        words = [w for a, w in zip(["", *words], words, strict=False) if (a, w) != ("dung", "heap")]
        if toxic := rng.random() < 0.4:
            at = rng.randrange(len(words))
            words[at:at] = ["dung", "heap"]
        out.append((" ".join(words), int(toxic)))
    return out


def test_insults_of_two_words():
    model = train(sample(two_word_bags(300, "two")), 0.4)
    assert model.pairs
    score, test = toxicity.Scorer(model), two_word_bags(200, "more")
    assert np.mean((score([x for x, _ in test]) >= 0.5) == np.array([t for _, t in test])) > 0.95
    base = prose("c", 50)
    assert score([f"{base} you dung heap {base}", f"{base} a Dung-heap {base}", f"{base} d.ung heap! {base}"]).min() >= 0.5
    assert score([f"{base} dung {base}", f"heap of dung {base}", f"{base} of dung. Heap {base}", ""]).max() < 0.5
    assert not train(sample(bags(300, "a")), 0.4).pairs


def test_pairs_are_told_from_their_numbers():
    s = sample([("One two three. Four five", 1), ("five one", 0)])
    assert sorted(s.pairs_of(s.pairs[0])) == ["four five", "one two", "two three."] and s.pairs_of(s.pairs[1]) == ["five one"]
    assert len(toxicity._pair_numbers("")) == 0 == len(toxicity._pair_numbers("one.\n\ntwo"))
    long_ = "x" * 40
    assert len(toxicity._pair_numbers(f"{long_} {long_} a b a b")) == len(toxicity.pairs(f"{long_} {long_} a b a b")) == 3
    assert toxicity.pairs("a b. c\nd e") == {"a b.", "d e"}


STEMS = [("quav", "er ing est ly ed on"), ("zorp", "an en un in on er")]


def stem_bags(n, seed):
    rng, out = random.Random(seed), []
    for i in range(n):
        words = prose(f"{seed}{i}", 60).split()
        if toxic := rng.random() < 0.3:
            stem, ends = rng.choice(STEMS)
            words[rng.randrange(60)] = rng.choice(["stupid", "moron", stem + rng.choice(ends.split()) + rng.choice(ends.split())])
        out.append((" ".join(words), int(toxic)))
    return out


@pytest.mark.parametrize(("n", "make"), [(100, bags), (300, bags), (900, bags), (800, stem_bags), (1600, stem_bags)])
def test_recall_at_numbers_of_labels(n, make):
    """Held-out recall and precision; with more labels also of insults of which each is rare and only their stem is common."""
    model = train(sample(make(n, f"n{n}")), 0.3)
    test = make(400, f"held{n}")
    found, truth = toxicity.Scorer(model)([x for x, _ in test]) >= 0.5, np.array([t for _, t in test]) == 1
    assert (found & truth).sum() >= 0.9 * truth.sum() and (found & truth).sum() >= 0.95 * found.sum()


def plain_margin(model, unit):
    s = toxicity._symbols(np.array([*map(ord, unit)], np.uint32))
    held = {}
    for i in range(len(unit)):
        for j in range(i + 1, len(unit)):
            for k in range(j + 1, min(len(unit), i + toxicity.SPAN)):
                if s[i] and s[j] and s[k]:
                    held.setdefault(int(s[i]) * 1024 + int(s[j]) * 32 + int(s[k]), []).append(toxicity.DECAY ** (k - i + 1))
    norm = sum(w * w for ws in held.values() for w in ws) ** 0.5 or 1
    return sum(sum(ws) * float(model.table[c]) for c, ws in held.items()) / norm + model.bias


@pytest.mark.parametrize("make", [bags, two_word_bags])
def test_toxicity_query_against_brute_force(spark, make):
    rows = [*make(120, "brute"), ("", 0), ("x" * 200 + " m o r o n", 1), (None, 0)]
    docs = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(rows)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    for r in toxicity.toxicity(docs, labels).collect():
        text = rows[r.doc_id][0] or ""
        every = units(text) | (toxicity.pairs(text) if model.pairs else set())
        worst = max((plain_margin(model, u) for u in every), default=toxicity._NONE)
        assert abs(r.score - 1 / (1 + np.exp(-np.clip(model.slope * worst + model.offset, -30, 30)))) < 1e-4
        assert r.predicted == int(r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_language_query_against_brute_force(spark, lang_docs):
    """Every window by plain loops over filters and places; of equal shares the first language wins."""
    docs = lang_docs.limit(40).union(spark.createDataFrame([(900, "ab " * 300, "en"), (901, None, "en"), (902, "", "xx"), (903, "1 2", "xx"), (904, "ß", None)], lang_docs.schema)).cache()
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    net = language.fit(docs, fold != 2)
    for r in identify_language(docs).join(docs.select("doc_id", "text"), "doc_id").collect():
        raw = (r.text or "").encode()
        if not any(map(str.isalpha, r.text or "")):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        total = np.zeros(len(net.labels))
        for at in range(0, len(raw), language.WINDOW):
            part = raw[at : at + language.WINDOW]
            x, h = part.ljust(language.WINDOW, b"\0"), []
            for k, w in enumerate(language.WIDTHS):
                z = np.max([sum(net.filters[k][i][x[t + i]] for i in range(w)) for t in range(language.WINDOW - w + 1)], axis=0)
                h += np.maximum(z + net.bias[k], 0).tolist()
            e = np.array(h) @ net.out + net.prior
            total += len(part) * np.exp(e - e.max()) / np.exp(e - e.max()).sum()
        assert r.lang_pred == net.labels[int(total.argmax())] and abs(r.score - total.max() / total.sum()) < 1e-4


def test_ties_between_languages():
    net = Network(["aa", "bb"])
    net.out[:] = 0
    assert predict(net, ["text", "words " * 400]) == [("aa", 0.5)] * 2


def test_every_language_is_learned(spark):
    """No language is left out for being rare or one of many."""
    rows = [(i, f"{chr(0x4E00 + i % 300)}{i} w", f"l{i % 300:03d}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = language.fit(docs, F.lit(True))
    assert len(net.labels) == 300
