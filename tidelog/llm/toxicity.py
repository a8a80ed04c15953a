"""Toxicity by a support vector machine over a subsequence string kernel with Nyström landmarks."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Subsequences of three letters within SPAN characters, each weighed by DECAY to the characters it spans.
SPAN, DECAY = 7, 0.5
#: Bounds of the training sample: toxic and other documents (as expected by a hash of the id), characters of a unit.
SAMPLE_TOXIC, SAMPLE_CLEAN, UNIT_CHARS = 1500, 4500, 48
LANDMARKS, NEGATIVES, COST, ROUNDS, SEED = 160, 8000, 10.0, 3, 11
#: Sampled documents with COPY of their SKETCH least-hashed long units in common are compared; with this share of all
#: their units in common they count as copies.
SKETCH, COPY, ALIKE = 12, 4, 0.5
#: A unit counts as an insult at first if this many sampled toxic documents hold it, a share of them in a small sample, and next
#: to no clean ones.
LEAST_SEEN, LEAST_SHARE = 8, 1 / 8
#: So does one of fewer, and of over four letters (shorter ones are alike by chance), if units LIKE it by the kernel are in as many, and in clean ones at most OFTEN_CLEAN times as often, by the
#: numbers of documents of each kind: how many such candidates are looked at, the commonest first, and how many other units they
#: are held against.
LIKE, OFTEN_CLEAN, CANDIDATES, HELD_AGAINST = 0.5, 0.05, 200, 40_000
#: Pairs of words learned as insults at most, the commonest first, and pairs they are told from.
MOST_PAIRS, OTHER_PAIRS = 500, 4000
#: Units of a generation whose margins a task remembers (it keeps two).
MEMO_UNITS = 100_000
_SIZE = 32
_ODD = 0x9E3779B97F4A7C15
_SPACED = re.compile(r"(?<!\S)(?:\S[ \t]){2,}\S(?!\S)")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def _symbols(code: np.ndarray) -> np.ndarray:
    """Letters as numbers: a to z, and five classes of other letters; 0 for what is no letter and only widens a gap."""
    out = np.where((code >= 97) & (code <= 122), code.astype(np.int32) - 96, 0)
    if len(beyond := np.flatnonzero(code >= 128)):
        each, at = np.unique(code[beyond], return_inverse=True)
        letter = np.array([chr(c).isalpha() for c in each.tolist()])
        out[beyond] = np.where(letter, 27 + each.astype(np.int32) % 5, 0)[at]
    return out


def units(text: str) -> set[str]:
    """The units of a text: what white space parts, single characters in a row taken together, long ones in overlapping pieces."""
    low = text.lower()
    found = set(low.split())
    found.update(_SPACED.findall(low))
    out = {u for u in found if len(u) <= UNIT_CHARS}
    for u in found - out:
        out.update(u[i : i + UNIT_CHARS] for i in range(0, len(u), UNIT_CHARS // 2))
    return out


def sentences(text: str) -> list[str]:
    return [s for s in _SENTENCE.split(text) if s]


def pairs(text: str) -> set[str]:
    """Neighbouring words of each sentence of a text as units of two words."""
    out = set()
    for s in sentences(text.lower()):
        words = s.split()
        out.update(f"{a} {b}" for a, b in zip(words, words[1:], strict=False) if len(a) + len(b) < UNIT_CHARS)
    return out


@lru_cache(200_000)
def _number(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))


def _pair_numbers(text: str) -> np.ndarray:
    """The pairs of a text as numbers from which, with the words at hand, they can be told again."""
    words = [s.split() for s in sentences(text.lower())]
    of = np.repeat(np.arange(len(words)), [len(w) for w in words])
    size = np.array([len(w) for ws in words for w in ws], np.int64)
    h = np.array([_number(w) for ws in words for w in ws], np.uint64)
    side = (of[1:] == of[:-1]) & (size[1:] + size[:-1] < UNIT_CHARS)
    return np.unique((h[:-1] * np.uint64(_ODD) + h[1:])[side] ^ np.uint64(1 << 63)).view(np.int64)


def _occurrences(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(unit, code of the subsequence, weight) of every subsequence of three letters within SPAN, gap by gap."""
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    s, of = _symbols(code), np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    letter, high, mid = s > 0, s * (_SIZE * _SIZE), s * _SIZE
    for k in range(2, SPAN):
        ends = np.flatnonzero(letter[:-k] & letter[k:] & (of[:-k] == of[k:]))
        for a in range(1, k):
            i = ends[letter[ends + a]]
            yield of[i], high[i] + mid[i + a] + s[i + k], DECAY ** (k + 1)


def _norms(texts: list[str]) -> np.ndarray:
    out = np.zeros(len(texts))
    for at, _, w in _occurrences(texts):
        out += np.bincount(at, minlength=len(texts)) * w * w
    return np.sqrt(np.where(out > 0, out, 1))


def features(texts: list[str]) -> np.ndarray:
    """Each unit's subsequences as a row; the kernel is the product of two rows."""
    out = np.zeros((len(texts), _SIZE**3), np.float32)
    for at, code, w in _occurrences(texts):
        np.add.at(out, (at, code), w)
    out /= _norms(texts)[:, None]
    return out


def kernel(texts: list[str], marks: np.ndarray) -> np.ndarray:
    """Kernel of units with landmarks, whose feature rows are ``marks``, without building the units' rows."""
    out, by_code = np.zeros((len(texts), len(marks))), np.ascontiguousarray(marks.T, np.float32)
    for lo in range(0, len(texts), 2000):
        part = texts[lo : lo + 2000]
        for at, code, w in _occurrences(part):
            if len(at):
                starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
                out[lo + at[starts]] += w * np.add.reduceat(by_code[code], starts, axis=0)
    return out / _norms(texts)[:, None]


def _squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Linear SVM with squared hinge by Newton steps over the examples inside the margin; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(x.shape[1]), np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    active = np.ones(len(x), bool)
    for _ in range(30):
        xa, c = x[active], weight[active, None]
        w = np.linalg.solve(ridge + COST * xa.T @ (c * xa), COST * xa.T @ (weight * y)[active])
        now = y * (x @ w) < 1
        if (now == active).all():
            break
        active = now
    return w


def _calibrated(m: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve over margins, by damped Newton steps with a small ridge."""
    x, w = np.stack([m, np.ones_like(m)], 1), np.array([4.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + 1e-2 * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        step = np.linalg.solve(h, g)
        w = w - step * min(1, 2 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return max(float(w[0]), 0.0), float(w[1])


#: Margin of a text without units.
_NONE = -1.0


@dataclass
class Model:
    #: The landmarks' expansion summed up into one weight for each subsequence.
    table: np.ndarray
    bias: float
    slope: float
    offset: float
    #: Whether insults of two words were learned, so that pairs of words are units too.
    pairs: bool = False

    def units(self, text: str) -> set[str]:
        return units(text) | pairs(text) if self.pairs else units(text)

    def margins(self, texts: list[str]) -> np.ndarray:
        out, norm = np.zeros(len(texts)), np.zeros(len(texts))
        for at, code, w in _occurrences(texts):
            out += w * np.bincount(at, self.table[code], minlength=len(texts))
            norm += np.bincount(at, minlength=len(texts)) * w * w
        return out / np.sqrt(np.where(norm > 0, norm, 1)) + self.bias


def _spread(names: list[str], most: int) -> list[str]:
    """Landmarks far from one another: each next one is the least like those before (the first wins ties)."""
    if len(names) <= most:
        return names
    rows = features(names)
    near, out = np.zeros(len(names)), [0]
    near = rows @ rows[0]
    while len(out) < most:
        k = int(near.argmin())
        out.append(k)
        near = np.maximum(near, rows @ rows[k])
    return [names[i] for i in out]


@dataclass
class Sample:
    """Documents as bags of units: ``units`` sorted, each bag an array of positions there, toxic bags first; ``pairs`` has the
    numbers of each bag's pairs of words."""

    units: list[str]
    bags: list[np.ndarray]
    toxic: int
    pairs: list[np.ndarray]

    @classmethod
    def of(cls, table: pa.Table) -> Sample:
        """From rows of (toxic, units, pairs); the same for any order of rows."""
        toxic = table.column("toxic").to_numpy() == 1
        lists = table.column("units").combine_chunks()
        coded = lists.flatten().dictionary_encode()
        names = coded.dictionary.to_pylist()
        order = sorted(range(len(names)), key=names.__getitem__)
        rank = np.empty(len(names), np.int32)
        rank[order] = np.arange(len(names), dtype=np.int32)
        codes = rank[coded.indices.to_numpy()] if len(names) else np.zeros(0, np.int32)
        ends = np.cumsum(pc.list_value_length(lists).to_numpy()) if len(lists) else np.zeros(0, int)
        bags = [np.unique(x) for x in np.split(codes, ends[:-1])] if len(lists) else []
        lists = table.column("pairs").combine_chunks()
        ends = np.cumsum(pc.list_value_length(lists).to_numpy()) if len(lists) else np.zeros(0, int)
        numbers = np.split(lists.flatten().to_numpy(), ends[:-1]) if len(lists) else []
        order_of = lambda i: (not toxic[i], bags[i].tobytes(), numbers[i].tobytes())
        at = sorted(range(len(bags)), key=order_of)
        return cls([names[i] for i in order], [bags[i] for i in at], int(toxic.sum()), [numbers[i] for i in at])

    def counts(self, bags: list[np.ndarray]) -> np.ndarray:
        return np.bincount(np.concatenate([*bags, np.zeros(0, np.int32)]), minlength=len(self.units))

    def apart(self) -> Sample:
        """Without copies of bags before them, lest a group of copies makes its every unit look frequent."""
        hashes = np.array([zlib.crc32(u.encode("utf-8", "surrogatepass")) for u in self.units], np.int64)
        long_, kept = np.array([len(u) > 5 for u in self.units], bool), []
        for rows in (range(self.toxic), range(self.toxic, len(self.bags))):
            known, out = {}, []
            for i in rows:
                bag = self.bags[i]
                sketch = np.sort(hashes[bag[long_[bag]]])[:SKETCH].tolist()
                others = Counter(known[h] for h in sketch if h in known).most_common(1)
                if others and others[0][1] >= min(COPY, len(sketch)):
                    other = self.bags[out[others[0][0]]]
                    same = len(np.intersect1d(bag, other, assume_unique=True))
                    if same >= ALIKE * (len(bag) + len(other) - same):
                        continue
                known |= dict.fromkeys(sketch, len(out))
                out.append(i)
            kept.append(out)
        both = kept[0] + kept[1]
        return Sample(self.units, [self.bags[i] for i in both], len(kept[0]), [self.pairs[i] for i in both])

    def pairs_of(self, numbers: np.ndarray) -> list[str]:
        """The pairs with these numbers: of each first word there can be, is the second one known?"""
        known = np.array([_number(u) for u in self.units], np.uint64)
        order = np.argsort(known)
        out = []
        for n in numbers.astype(np.uint64) + np.uint64(1 << 63):
            second = n - known * np.uint64(_ODD)
            at = np.minimum(np.searchsorted(known, second, sorter=order), len(known) - 1)
            out += [f"{self.units[i]} {self.units[order[at[i]]]}" for i in np.flatnonzero(known[order[at]] == second)]
        return out


def _supported(units: list[str], at: np.ndarray, seen: np.ndarray, not_: np.ndarray, least: int, odds: float) -> np.ndarray:
    """Those of the units ``at`` whose likes, each counted as often as it was seen, are in enough toxic and few clean documents."""
    at = at[np.lexsort((at, -seen[at]))][:CANDIDATES]
    if not len(at):
        return at
    marks = features([units[i] for i in at])
    others = np.random.default_rng(SEED).permutation(len(units))[:HELD_AGAINST]
    toxic, clean = np.zeros(len(at)), np.zeros(len(at))
    for i in range(0, len(others), 2000):
        part = others[i : i + 2000]
        like = kernel([units[j] for j in part], marks) >= LIKE
        toxic += (like * seen[part, None]).sum(0)
        clean += (like * not_[part, None]).sum(0)
    scale = len(units) / max(1, len(others))
    return at[(toxic * scale >= least) & (clean <= OFTEN_CLEAN * odds * toxic)]


def _machine(positive: list[str], weight: np.ndarray, negative: list[str]) -> Model:
    """An SVM over the kernel with landmarks from both kinds; ``weight`` is that of the positives."""
    names = _spread(positive[:400], LANDMARKS // 2) + _spread(negative[:400], LANDMARKS // 2)
    marks = features(names)
    value, vector = np.linalg.eigh(marks @ marks.T)
    root = vector[:, value > 1e-8] / np.sqrt(value[value > 1e-8])
    y = np.array([1.0] * len(positive) + [-1.0] * len(negative))
    weight = np.concatenate([weight / weight.sum(), np.full(len(negative), 1 / len(negative))]) * len(y)
    w = _squared_hinge(kernel(positive + negative, marks) @ root, y, weight)
    return Model((root @ w[:-1]) @ marks, float(w[-1]), 1.0, 0.0)


def _insult_pairs(sample: Sample, best: np.ndarray, least: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Pairs of words that come with the label in documents that no single unit explains: names, numbers, documents."""
    bags, toxic = sample.pairs, sample.toxic
    missed = [x for x, m in zip(bags[:toxic], best[:toxic], strict=True) if m <= 0]
    none = np.zeros(0, np.int64)
    numbers, of = np.unique(np.concatenate([none, *missed]), return_inverse=True)
    clean = np.concatenate([none, *bags[toxic:]])
    seen = np.bincount(of, minlength=len(numbers))
    held, n = np.unique(clean[np.isin(clean, numbers)], return_counts=True)
    not_ = np.zeros(len(numbers), np.int64)
    not_[np.searchsorted(numbers, held)] = n
    if not len(numbers):
        return [], none, none
    at = np.flatnonzero((seen >= least) & (not_ <= 0.01 * seen))
    at = at[np.lexsort((numbers[at], -seen[at]))][:MOST_PAIRS]
    names, kept = [], []
    for i in at.tolist():
        for name in sample.pairs_of(numbers[i : i + 1])[:1]:
            if all(sum(map(str.isalpha, w)) > 1 for w in name.split(" ", 1)):
                names.append(name)
                kept.append(i)
    return names, numbers[kept], seen[kept]


def train(sample: Sample, toxic_share: float) -> Model | None:
    """Multiple-instance SVM: a document (a bag of its sentences' units) is toxic for the unit that stands out most.

    Units that come with the label begin as positives; each further round takes from every toxic document the unit
    with the largest margin, and to the negatives the clean documents' largest. Where toxic documents are left
    that no unit explains, pairs of neighbouring words that come with the label are learned too, told from pairs that share a word.
    """
    sample = sample.apart()
    units, bags, toxic = sample.units, sample.bags, sample.toxic
    clean = len(bags) - toxic
    if not toxic or not clean:
        return None
    seen, not_ = sample.counts(bags[:toxic]), sample.counts(bags[toxic:])
    least = min(LEAST_SEEN, max(2, int(toxic * LEAST_SHARE)))
    letters = np.array([sum(c.isalpha() for c in u) for u in units])
    by_seen = lambda at: sorted(map(int, at), key=lambda i: (-seen[i], i))
    telling = (seen > 0) & (not_ <= 0.01 * seen) & (letters > 2)
    positive = by_seen(np.flatnonzero(telling & (seen >= least)))[:1500]
    positive += by_seen(_supported(units, np.flatnonzero(telling & (seen < least) & (letters > 4)), seen, not_, LEAST_SEEN, clean / toxic))
    draw, other = np.random.default_rng(SEED), np.flatnonzero(not_)
    negative = draw.permutation(other)[:NEGATIVES].tolist()
    negative += sorted(other.tolist(), key=lambda i: (-not_[i], i))[:1000]
    negative = list(dict.fromkeys(negative))
    named = lambda at: [units[i] for i in at]
    if not negative:
        return None
    model, best = None, np.full(len(bags), _NONE)
    for _ in range(ROUNDS if positive else 0):
        model = _machine(named(positive), seen[positive] ** 0.5, named(negative))
        margin = np.concatenate([model.margins(units[i : i + 20_000]) for i in range(0, len(units), 20_000)])
        top = [int(bag[margin[bag].argmax()]) if len(bag) else -1 for bag in bags]
        best = np.array([margin[i] if i >= 0 else _NONE for i in top])
        last = positive, negative
        witness = Counter(i for i in top[:toxic] if i >= 0 and margin[i] > 0.5 and not not_[i])
        positive = by_seen({*positive, *(i for i, n in witness.items() if n >= 3)})[:2000]
        known = set(positive)
        hard = sorted({i for i in top[toxic:] if i >= 0 and margin[i] > -0.5})
        negative = [i for i in dict.fromkeys(hard + negative) if i not in known][: 2 * NEGATIVES]
    names, numbers, often = _insult_pairs(sample, best, least)
    if names:
        positive, negative = last if model else ([], negative)
        common, words = named(negative), [n.split(" ", 1) for n in names]
        others = [f"{common[i]} {common[j]}" for i, j in draw.integers(0, len(common), (OTHER_PAIRS // 2, 2)).tolist()]
        others += [f"{words[i % len(words)][0]} {common[j]}" if i % 2 else f"{common[j]} {words[i % len(words)][1]}" for i, j in enumerate(draw.integers(0, len(common), OTHER_PAIRS // 2).tolist())]
        # the words of a pair are no insults by themselves
        others = [o for o in dict.fromkeys(others + [w for ws in words for w in ws]) if o not in set(names) | set(named(positive))]
        model = _machine(names + named(positive), np.concatenate([often, seen[positive]]) ** 0.5, others + common)
        model.pairs = True
        margin = np.concatenate([model.margins(units[i : i + 20_000]) for i in range(0, len(units), 20_000)])
        of_pair = model.margins(names)
        order = np.argsort(numbers)
        for i, (bag, held) in enumerate(zip(bags, sample.pairs, strict=True)):
            there = order[np.searchsorted(numbers, held[np.isin(held, numbers)], sorter=order)]
            best[i] = max(margin[bag].max(initial=_NONE), of_pair[there].max(initial=_NONE))
    if model is None:
        return None
    y = np.array([1.0] * toxic + [0.0] * clean)
    weight = np.where(y > 0, toxic_share / toxic, (1 - toxic_share) / clean) * len(y)
    model.slope, model.offset = _calibrated(best, y, weight)
    return model


class Scorer:
    """Scores of whole texts; a worker remembers the margins of the units it has met."""

    def __init__(self, model: Model | None):
        self.model, self.memo, self.before = model, {}, {}

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        if self.model is None:
            return np.zeros(len(texts))
        bags = [self.model.units(t or "") for t in texts]
        new = []
        for u in set().union(*bags):
            if u not in self.memo:
                if u in self.before:
                    self.memo[u] = self.before[u]
                else:
                    new.append(u)
        for i in range(0, len(new), 5000):
            part = new[i : i + 5000]
            self.memo.update(zip(part, self.model.margins(part).tolist(), strict=True))
        get = self.memo.__getitem__
        m = np.array([max(map(get, b), default=_NONE) for b in bags])
        if len(self.memo) > MEMO_UNITS:
            self.before, self.memo = self.memo, {}
        return 1 / (1 + np.exp(-np.clip(self.model.slope * m + self.model.offset, -30, 30)))


def _score(model: Model | None, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(model)
        for b in batches:
            out, held, size = [], [], 0
            for t in b.column(text_at):
                held.append(t.as_py())
                size += len(held[-1] or "")
                if size > 1_000_000:
                    out.append(score(held))
                    held, size = [], 0
            out.append(score(held))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(out))], names=[*(f"c{i}" for i in range(b.num_columns)), "score"])

    return run


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [t.as_py() or "" for t in b.column(1)]
        found = [sorted(set().union(*map(units, sentences(t)))) for t in texts]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.string())), pa.array(map(_pair_numbers, texts), pa.list_(pa.int64()))], names=["toxic", "units", "pairs"])


_MODEL = "table binary, bias double, slope double, offset double, pairs boolean"


def _learn(toxic_share: float):
    """A row of the model learned from all batches together; none where there is nothing to learn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        sample = Sample.of(pa.Table.from_batches(held)) if held else None
        # the rows are not needed beside the sample, and their memory is the executor's
        held.clear()
        pa.default_memory_pool().release_unused()
        model = train(sample, toxic_share) if sample else None
        if model:
            columns = [model.table.astype(np.float64).tobytes()], [model.bias], [model.slope], [model.offset], [model.pairs]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], names=["table", "bias", "slope", "offset", "pairs"])

    return run


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model | None:
    """Train on about SAMPLE_TOXIC and SAMPLE_CLEAN labelled documents, chosen by a hash of their id from the rows
    whose crc32 of doc_id as text does not leave ``held_out`` by ``folds``; sampled texts are taken whole. One task of an
    executor holds the sample, whose bound does not grow with the input, and learns from it; the driver gets the model."""
    at = F.col(f"`{id_col}`")
    marks = labels.where(F.col(label_col).isin(0, 1) & (F.crc32(at.cast("string")) % folds != held_out))
    marks = marks.groupBy(at.alias("id")).agg(F.max(F.col(label_col)).alias("toxic"))
    counts = {r.toxic: r.n for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if set(counts) != {0, 1}:
        return None
    h = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(SEED)), F.lit(1 << 30))
    share = F.when(F.col("toxic") == 1, F.lit(min(1, SAMPLE_TOXIC / counts[1]))).otherwise(F.lit(min(1, SAMPLE_CLEAN / counts[0])))
    chosen = marks.where(h < share * (1 << 30))
    # the sample's bound is also that of what is sent to every task; the texts are not moved
    found = docs.select(at.alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).join(F.broadcast(chosen), "id")
    bags = found.select(F.col("toxic").cast("int"), "text").mapInArrow(_bags, "toxic int, units array<string>, pairs array<long>")
    # one task learns from the sample, so that the driver holds the model only
    learned = bags.repartition(1).mapInArrow(_learn(counts[1] / (counts[0] + counts[1])), _MODEL).collect()
    return next((Model(np.frombuffer(r.table), r.bias, r.slope, r.offset, r.pairs) for r in learned), None)


def score_toxicity(docs: DataFrame, model: Model | None, text_col: str = "text", score_col: str = "toxicity") -> DataFrame:
    """``docs`` with ``score_col``, a double from 0 to 1.

    Cases: null, empty and wordless texts score as nothing bad; every unit of a very long text counts; texts alike score
    alike, so repeated rows and ties are no matter; without a model all scores are 0; an empty table gives no rows; other
    columns pass through, whatever their names.
    """
    names = docs.columns
    rows = docs.select([F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    schema = ", ".join(f"c{i} {t}" for i, (_, t) in enumerate(rows.dtypes))
    return rows.mapInArrow(_score(model, names.index(text_col)), f"{schema}, score double").toDF(*names, score_col)


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """``(doc_id, held_out boolean, score double, predicted int)``: one row per row of ``docs``.

    A text scores as its worst unit does: every unit of the whole text is compared with the landmarks, whose
    sum has been collapsed into one weight for each three-letter subsequence, and the largest margin goes
    through a logistic curve. Cases: null and empty texts, having no units, score as nothing bad; a null
    doc_id is not held out and has no label; an id labelled twice counts as toxic if either says so; labels
    other than 0 and 1 are not used; without labels of both kinds all scores are 0; an empty table gives no
    rows; further columns are ignored.
    """
    model = fit(docs, labels, folds, held_out, id_col, text_col, label_col)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    out = score_toxicity(rows, model, "text", "score")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == held_out, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
