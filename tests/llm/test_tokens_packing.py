import zlib

import numpy as np
import public_tokenizers
import pytest
from samples import prose
from tokenizers import Tokenizer

from tidelog.llm import tokenizing
from tidelog.llm.packing import pack_documents, pack_histogram, slots
from tidelog.llm.token_counts import token_counts, tokenizer_version
from tidelog.llm.tokenizing import counter, encoder

WORD, BYTE, PIECE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))


def test_counts_and_cache(spark, edge_docs, no_docs, tmp_path):
    model = Tokenizer.from_file(BYTE)
    cache = f"file://{tmp_path}/cache"
    want = sorted((r.doc_id or -1, len((r.text or "").encode()), len(model.encode(r.text or "", add_special_tokens=False).ids)) for r in edge_docs.collect())
    for _ in range(2):
        got = token_counts(edge_docs, BYTE, cache).collect()
        assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in got) == want
        assert all(r.over_limit == (r.n_tokens > 512) for r in got)
    stored = spark.read.parquet(f"{cache}/{tokenizer_version(BYTE)}")
    distinct = len({r.text or "" for r in edge_docs.collect()})
    assert stored.count() == stored.select("digest").distinct().count() == distinct
    assert token_counts(no_docs, BYTE, cache).count() == 0


def test_other_tokenizer_has_its_own_counts(docs, tmp_path):
    cache = f"file://{tmp_path}/cache"
    a = {r.doc_id: r.n_tokens for r in token_counts(docs, BYTE, cache).collect()}
    b = {r.doc_id: r.n_tokens for r in token_counts(docs, PIECE, cache).collect()}
    assert a != b and len(a) == len(b) == docs.count()
    assert counter(PIECE)(["", "a b"])[0] == 0


TEXTS = ["", "Hello, WORLD's don't 'S 'xx ''' it'll 123 a1b2", "É ß ÿ Ÿ İ ı Ǆ ŉ × ÷ ª", "<|endoftext|> x", "a\u0301 e\u0300", "漢字 😀", "x" * 5000, "a\x1cb\x85c\xa0d\u3000e",
         "# % && *** $$$ ''s 's", "ŀs ſt K", "\t\n mixed \r\n", "two  spaces   three\n\n  lines \t x  ", "  lead", "trail  ", "don't  we'll\n'tis", " 12 3,4.5  6", "É's É 's", "<|startoftext|>", "ñoño 'll'd"]


@pytest.mark.parametrize("path", [WORD, BYTE])
@pytest.mark.parametrize("most", [4, 150_000])
def test_remembered_words_are_the_tokenizers(path, most, monkeypatch):
    monkeypatch.setattr(tokenizing, "MEMO_WORDS", most)
    tokenizing._known.clear()
    model = Tokenizer.from_file(path)
    texts = [*TEXTS, *(prose(i, 50) + "!  \n" + prose(i, 5).upper() for i in range(20))]
    want = [model.encode(t, add_special_tokens=False).ids for t in texts]
    for _ in range(3):
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder(path)(texts)] == want
        assert counter(path)(texts) == [len(x) for x in want]
    tokenizing._known.clear()


@pytest.mark.parametrize("capacity", [16, 2048])
def test_round_trip(edge_docs, no_docs, capacity):
    model = Tokenizer.from_file(WORD)
    rows = pack_documents(edge_docs, WORD, capacity=capacity, with_ids=True).collect()
    seqs, docs = {}, {}
    for r in rows:
        ids = np.frombuffer(bytes(r.ids), "<u4")
        assert len(ids) == r.length <= capacity and zlib.crc32(bytes(r.ids)) == r.ids_crc32
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        docs.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, ids.tolist()))
    for pieces in seqs.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    want = {}
    for r in edge_docs.collect():
        ids = [*model.encode(r.text or "", add_special_tokens=False).ids, 1]
        want.setdefault((r.doc_id, len(ids)), []).append(ids)
    assert set(want) == set(docs)
    for k, all_ids in want.items():
        got = sorted(docs[k], key=lambda x: x[0])
        assert sum(len(x) for _, x in got) == sum(map(len, all_ids))
        if len(all_ids) == 1:
            assert [i for _, x in got for i in x] == all_ids[0]
    assert sorted(seqs) == list(range(len(seqs)))
    assert pack_documents(no_docs, WORD).count() == 0


def test_histogram_packs_every_piece():
    rng = np.random.default_rng(1)
    counts = {int(k): int(n) for k, n in zip(range(1, 129), rng.integers(0, 50, 128), strict=True)}
    patterns = pack_histogram(counts, 128)
    got = {}
    for lengths, times in patterns:
        assert sum(lengths) <= 128 and times > 0
        for x in lengths:
            got[x] = got.get(x, 0) + times
    assert got == {k: n for k, n in counts.items() if n}
    total = sum(k * n for k, n in counts.items())
    assert total / (128 * sum(t for _, t in patterns)) > 0.95
    table = slots(patterns)
    for length, part in table.groupby("length"):
        part = part.sort_values("lo")
        assert part.lo.iloc[0] == 0 and part.hi.iloc[-1] == counts[length] and (part.lo.iloc[1:].to_numpy() == part.hi.iloc[:-1].to_numpy()).all()
    assert len(pack_histogram({7: 10**9, 3: 10**9 + 1}, 10)) <= 4
    assert pack_histogram({}, 10) == []
