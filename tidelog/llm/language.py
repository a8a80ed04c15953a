"""Language identification by a byte convolutional network trained in numpy."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.session import keep

WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 12
#: Bounds of the training sample: documents a language and of all languages (as expected by a hash), windows a document.
SAMPLE_DOCS, SAMPLE_ALL, SAMPLE_WINDOWS = 400, 40_000, 6
#: Bytes of the table of languages that is sent to every task; a larger one is joined by a shuffle.
SMALL = 8 << 20
EPOCHS, BATCH, RATE, SEED = 6, 64, 0.02, 7
UNKNOWN = "und"
#: Windows whose responses are held at once.
STEP = 1024
_ASCII_LETTER = re.compile("[A-Za-z]")


def windows(text: str) -> np.ndarray:
    """The UTF-8 bytes of a whole text in rows of WINDOW, the last one filled up with zeros."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    out = np.zeros(max(1, -(-len(raw) // WINDOW)) * WINDOW, np.uint8)
    out[: len(raw)] = raw
    return out.reshape(-1, WINDOW)


def has_letter(text: str) -> bool:
    return bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text))


class Network:
    """Filters of several widths over bytes, the largest response of each (if positive), and a softmax."""

    def __init__(self, labels: list[str], seed: int = SEED):
        draw = np.random.default_rng(seed)
        self.labels = labels
        self.filters = [draw.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = draw.normal(0, 0.3, (len(WIDTHS) * FILTERS, len(labels))).astype(np.float32)
        self.prior = np.zeros(len(labels), np.float32)
        for f in self.filters:
            f[:, 0] = 0

    def _responses(self, x: np.ndarray, k: int) -> np.ndarray:
        w, last = WIDTHS[k], x.shape[1] - WIDTHS[k] + 1
        z = self.filters[k][0][x[:, :last]]
        for i in range(1, w):
            z += self.filters[k][i][x[:, i : i + last]]
        return z

    def pooled(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.maximum(self._responses(x, k).max(1) + self.bias[k], 0) for k in range(len(WIDTHS))], 1)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.labels)), np.float32)
        for at in range(0, len(x), STEP):
            out[at : at + STEP] = _softmax(self.pooled(x[at : at + STEP]) @ self.out + self.prior)
        return out

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> None:
        """Cross-entropy by Adam; only the place of the largest response passes a gradient to its filter."""
        draw = np.random.default_rng(seed)
        params = [*self.filters, *self.bias, self.out, self.prior]
        first, second, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(epochs):
            order = draw.permutation(len(x))
            for b in range(0, len(order), BATCH):
                rows = x[order[b : b + BATCH]]
                best, top = [], []
                for k in range(len(WIDTHS)):
                    z = self._responses(rows, k)
                    best.append(z.argmax(1))
                    top.append(np.take_along_axis(z, best[-1][:, None], 1)[:, 0] + self.bias[k])
                h = np.concatenate(top, 1)
                p = _softmax(np.maximum(h, 0) @ self.out + self.prior)
                p[np.arange(len(rows)), y[order[b : b + BATCH]]] -= 1
                p /= len(rows)
                back = (p @ self.out.T) * (h > 0)
                grads = []
                for k, w in enumerate(WIDTHS):
                    g, own = np.zeros_like(self.filters[k]), back[:, k * FILTERS : (k + 1) * FILTERS]
                    for i in range(w):
                        np.add.at(g[i], (np.take_along_axis(rows, best[k] + i, 1), np.arange(FILTERS)), own)
                    g[:, 0] = 0
                    grads.append(g)
                grads += [back[:, k * FILTERS : (k + 1) * FILTERS].sum(0) for k in range(len(WIDTHS))]
                grads += [np.maximum(h, 0).T @ p, p.sum(0)]
                t += 1
                for q, g, m, v in zip(params, grads, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    q -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def _sample_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lang, found = [], []
        for name, text in zip(b.column(0), b.column(1), strict=True):
            x = windows(text.as_py())
            for i in np.unique(np.linspace(0, len(x) - 1, SAMPLE_WINDOWS).astype(int)):
                lang.append(name.as_py())
                found.append(x[i].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(found, pa.binary())], names=["lang", "bytes"])


def fit(docs: DataFrame, learn: F.Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Network | None:
    """Train on windows of rows where ``learn`` holds: about SAMPLE_DOCS documents of each language, fewer where SAMPLE_ALL in
    all ask for it, chosen by a hash of their id, and up to SAMPLE_WINDOWS windows spread over each whole text."""
    rows = docs.select(F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text"), F.pmod(F.xxhash64(f"`{id_col}`", F.lit(SEED)), F.lit(1 << 30)).alias("h"), learn.alias("learn"))
    rows = rows.where("learn and lang is not null and text is not null").where(F.col("text").rlike(r"\p{L}"))
    counts = keep(rows.groupBy("lang").count(), "languages")
    n, size = counts.agg(F.count("*"), F.sum(F.octet_length("lang") + 16)).first()
    if not n:
        return None
    # every language is learned: of many each gives fewer documents
    most = max(1.0, min(SAMPLE_DOCS, SAMPLE_ALL / n))
    share = counts.select("lang", (F.least(F.lit(1.0), most / F.col("count")) * (1 << 30)).alias("share"))
    found = rows.join(F.broadcast(share) if size <= SMALL else share, "lang").where(F.col("h") <= F.col("share")).select("lang", "text").mapInArrow(_sample_windows, "lang string, bytes binary").collect()
    found.sort(key=lambda r: (r["lang"], bytes(r["bytes"])))
    labels = sorted({r["lang"] for r in found})
    net = Network(labels)
    x = np.frombuffer(b"".join(bytes(r["bytes"]) for r in found), np.uint8).reshape(-1, WINDOW)
    net.train(x, np.array([labels.index(r["lang"]) for r in found]))
    return net


def predict(net: Network | None, texts: list[str | None]) -> list[tuple[str, float]]:
    out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
    asked = [i for i, t in enumerate(texts) if net and t and has_letter(t)]
    if not asked:
        return out
    parts = [windows(texts[i]) for i in asked]
    n = np.array([len(p) for p in parts])
    size = np.array([len(texts[i].encode("utf-8", "surrogatepass")) for i in asked])
    p = net.probabilities(np.concatenate(parts))
    weight = np.full(n.sum(), WINDOW, np.float32)
    weight[np.cumsum(n) - 1] = np.maximum(size - (n - 1) * WINDOW, 1)
    total = np.add.reduceat(p * weight[:, None], np.cumsum(n) - n, axis=0)
    total /= total.sum(1, keepdims=True)
    for i, row in zip(asked, total, strict=True):
        best = int(row.argmax())
        out[i] = (net.labels[best], float(min(1, row[best])))
    return out


def _predict(net: Network | None, step: int = 2_000_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, held, size = [], [], 0
            for t in b.column(1):
                held.append(t.as_py())
                size += len(held[-1] or "")
                if size > step:
                    found += predict(net, held)
                    held, size = [], 0
            found += predict(net, held) if held else []
            lang, score = [x for x, _ in found], [x for _, x in found]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify_language(docs: DataFrame, folds: int = 4, held_out: int = 2, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(doc_id, held_out boolean, lang_pred string, score double)``: one row per row of ``docs``.

    A row is held out from training if crc32 of its doc_id as text leaves ``held_out`` by ``folds``; predictions
    see the text alone. Every window of a whole text votes with its probabilities, weighted by its bytes;
    ``score`` is the share of the winner. Cases: null texts and texts without a letter are ``und`` with score
    0, as are all if there is nothing to learn from; a null doc_id is not held out and not learned from; null
    lang is not learned from; an empty table gives no rows; further columns are ignored.
    """
    fold = F.crc32(F.col(f"`{id_col}`").cast("string")) % folds
    net = fit(docs, F.coalesce(fold != held_out, F.lit(False)), text_col, lang_col, id_col)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.coalesce(fold == held_out, F.lit(False)).alias("held_out"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_predict(net), f"doc_id {kind}, held_out boolean, lang_pred string, score double")
