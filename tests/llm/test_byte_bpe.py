import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from freshet.llm import byte_bpe

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.merger(RANKS).ranks, special_tokens={}
    )


def test_random_texts_equal_the_library(library):
    random.seed(1)
    symbols = "ab'sStdmrevl  \n\t 　 12é中!?.,\U0001f600\x1c\x85'"
    texts = ["".join(random.choice(symbols) for _ in range(random.randint(0, 40))) for _ in range(3000)]
    texts += ["", " ", "\n", "a" * 3000, "'" * 200, "  's", "\n's", "x's's'll'l", "it's 're", "ab" * 500 + " " * 90]
    for text, ids in zip(texts, byte_bpe.encode_texts(RANKS, texts)):
        assert ids.tolist() == library.encode_ordinary(text), repr(text)


def test_heap_and_array_merging_agree():
    bpe = byte_bpe.merger(RANKS)
    random.seed(2)
    pieces = [bytes(random.choice(b"theranding ") for _ in range(random.randint(1, 60))) for _ in range(300)]
    symbols = bpe.single[np.frombuffer(b"".join(pieces), np.uint8)]
    ids, counts = bpe.pairs.merge(symbols, np.array([len(p) for p in pieces]))
    for piece, own in zip(pieces, np.split(ids, np.cumsum(counts)[:-1])):
        assert own.tolist() == bpe.merge_long(piece)


def test_small_cache_changes_nothing(monkeypatch, library):
    monkeypatch.setattr(byte_bpe, "CACHE", 3)
    monkeypatch.setattr(byte_bpe, "BLOCK", 10)
    texts = ["one two three four five", "six seven", "one two"] * 4
    assert [x.tolist() for x in byte_bpe.encode_texts(RANKS, texts)] == [library.encode_ordinary(t) for t in texts]


def test_round_trip_and_digests(documents, library):
    texts = [(r.doc_id, r.text or "") for r in documents.collect()]
    rows = byte_bpe.digests(documents, RANKS).collect()
    assert len(rows) == len(texts)
    assert {tuple(r) for r in rows} == {
        (d, len(library.encode_ordinary(t)), hashlib.sha256(np.array(library.encode_ordinary(t), "<u4").tobytes()).hexdigest(),
         hashlib.sha256(t.encode()).hexdigest()) for d, t in texts
    }


def test_columns_stay_and_ids_decode(documents):
    out = byte_bpe.decoded(byte_bpe.encoded(documents, RANKS), RANKS)
    assert out.columns == [*documents.columns, "bytes"]
    assert all(bytes(r["bytes"]).decode() == (r["text"] or "") for r in out.collect())


def test_empty_table(no_documents):
    assert byte_bpe.digests(no_documents, RANKS).count() == 0
