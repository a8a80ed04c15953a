"""Ids and counts of public tokenizers, with a worker's memory of the words it has met."""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Callable

import numpy as np

#: Distinct words of a generation that a worker remembers (it keeps two), and the longest word that is.
MEMO_WORDS, MEMO_CHARS = 300_000, 40
#: Words looked up in one text, where their ends can be told.
JOINED = 256

# A byte-pair tokenizer merges within words only, so a text's ids are its words' ids in order. Each word is looked up by
# the tokenizer once and remembered, which is faster than encoding each text. That holds for the characters of _SAFE,
# on which the patterns here and the tokenizers' own agree; a text with any other character, or with a special
# token, is encoded whole, and so is every text of a tokenizer of another build.
_SAFE = re.compile("[\t\n\r -~À-įı-ɏ]*")
_LOW = "a-zß-öø-ɏ"
_ANY = "A-Za-zÀ-ÖØ-öø-ɏ"
_LOWERED = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{_LOW}]+|[0-9]|[^\s{_LOW}0-9]+")
_BYTES = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{_ANY}]+| ?[0-9]+| ?[^\s{_ANY}0-9]+|\s+(?!\S)|\s+")
#: The pattern of the lower-casing tokenizer, as its file states it (a fixed value).
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_known: dict = {}


def _words_of(spec: dict) -> Callable[[str], list[str]] | None:
    """How a tokenizer's file says that it cuts a text into words, where that is one of the ways above."""
    steps = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
    pre = spec.get("pre_tokenizer") or {}
    splits = [x.get("pattern", {}).get("Regex") for x in pre.get("pretokenizers", [])]
    if spec.get("model", {}).get("type") != "BPE":
        return None
    if steps == ["NFC", "Replace", "Lowercase"] and _SPLIT in splits:
        return lambda text: _LOWERED.findall(text.lower())
    if spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
        return _BYTES.findall
    return None


def _word_ends(model, spec: dict) -> np.ndarray | None:
    """By id, whether a word ends there; None for tokenizers that do not mark it."""
    suffix = spec["model"].get("end_of_word_suffix")
    if not suffix:
        return None
    vocabulary = model.get_vocab()
    out = np.zeros(max(vocabulary.values()) + 1, bool)
    out[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
    return out


def _look_up(model, last: np.ndarray | None, words: list[str]) -> list[list[int]]:
    """The ids of each word. Where a word's last id is marked as one, many are encoded as one text and parted there."""
    if last is None:
        return [x.ids for x in model.encode_batch_fast(words, add_special_tokens=False)]
    groups = [words[i : i + JOINED] for i in range(0, len(words), JOINED)]
    out: list[list[int]] = []
    for group, found in zip(groups, model.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
        ids = found.ids
        ends = (np.flatnonzero(last[ids]) + 1).tolist()
        if len(ends) == len(group):
            out += [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        else:
            out += [x.ids for x in model.encode_batch_fast(group, add_special_tokens=False)]
    return out


def _by_word(path: str, value: Callable, joined: Callable) -> Callable[[list[str]], list]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = [x["content"] for x in spec.get("added_tokens") or []]
    words_of, last = _words_of(spec), _word_ends(model, spec)
    memo: dict = {}
    before: dict = {}

    def whole(texts: list[str]) -> list:
        return [value(x.ids) for x in model.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(texts: list[str]) -> list:
        fast = [words_of is not None and bool(_SAFE.fullmatch(t)) and not any(s in t for s in special) for t in texts]
        words = [words_of(t) if ok else () for t, ok in zip(texts, fast, strict=True)]
        new = []
        for w in set().union(*words).difference(memo):
            if w in before:
                memo[w] = before[w]
            else:
                new.append(w)
        for w, ids in zip(new, _look_up(model, last, new), strict=True):
            memo[w] = value(ids)
        slow = iter(whole([t for t, ok in zip(texts, fast, strict=True) if not ok]))
        out = [joined(map(memo.__getitem__, ws)) if ok else next(slow) for ws, ok in zip(words, fast, strict=True)]
        for w in new:
            if len(w) > MEMO_CHARS:
                del memo[w]
        if len(memo) > MEMO_WORDS:
            # what has not been met since the last time goes
            before.clear()
            before.update(memo)
            memo.clear()
        return out

    return encode


def encoder(path: str) -> Callable[[list[str]], list[bytes]]:
    """From texts to their ids, as little-endian unsigned 32-bit numbers; one for all tasks of a worker."""
    if (path, "ids") not in _known:
        _known[path, "ids"] = _by_word(path, lambda ids: struct.pack(f"<{len(ids)}I", *ids), b"".join)
    return _known[path, "ids"]


def counter(path: str) -> Callable[[list[str]], list[int]]:
    """From texts to their numbers of tokens, by the library that the file's suffix names."""
    if (path, "counts") not in _known:
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            _known[path, "counts"] = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            _known[path, "counts"] = _by_word(path, len, sum)
    return _known[path, "counts"]
