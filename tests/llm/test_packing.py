import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from freshet.llm import packing

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    own = Tokenizer.from_file(VOCABULARY)
    own.encode_special_tokens = True
    return own


def test_ids_equal_the_library(tokenizer):
    random.seed(3)
    symbols = "abS'strevl  \n\té中!?.1\x1cΣς́İß\U0001f600<|endoftext|>"
    texts = ["".join(random.choice(symbols) for _ in range(random.randint(0, 40))) for _ in range(3000)]
    texts += ["", "<|endoftext|> a<|endoftext|>b", "don't we'll", "ÄÖÜ straße été niño 12.5%"]
    for text, (ids, _) in zip(texts, packing.word_tokens(VOCABULARY).encode(texts)):
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def cost(places, costs, cuts, capacity, window):
    total = 0.0
    for a, b in zip(cuts, cuts[1:]):
        length = places[b] - places[a]
        assert length <= capacity
        pad = 0 if length & (length - 1) == 0 and length >= capacity // 8 else capacity - length
        total += pad + window + costs[b]
    return total


def test_cuts_are_the_cheapest():
    random.seed(4)
    for _ in range(200):
        capacity, window = 32, 3
        places = [0]
        while len(places) < 12:
            places.append(places[-1] + random.randint(1, 20))
        costs = [random.choice([0.0, 2.0, 9.0]) for _ in places]
        best = [0.0] + [float("inf")] * 11
        for j in range(1, 12):
            for i in range(j):
                length = places[j] - places[i]
                if length <= capacity:
                    pad = 0 if length in (4, 8, 16, 32) else capacity - length
                    best[j] = min(best[j], best[i] + pad + window + costs[j])
        cuts = packing.choose_cuts(places, costs, capacity, window)
        assert cuts[0] == 0 and cuts[-1] == 11
        assert cost(places, costs, cuts, capacity, window) == pytest.approx(best[-1])


@pytest.mark.parametrize("buffer", [50, 400_000])
def test_every_id_once(documents, tokenizer, monkeypatch, buffer):
    monkeypatch.setattr(packing, "BUFFER", buffer)
    rows = packing.packed(documents, VOCABULARY).collect()
    checked(rows, documents, tokenizer)


def checked(rows, documents, tokenizer):
    windows, docs = defaultdict(list), defaultdict(list)
    for r in rows:
        windows[r.sequence_id].append(r)
        docs[r.doc_id].append(r)
        assert len(r.ids) == 4 * r.length > 0
    for own in windows.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.CAPACITY
    for r in documents.collect():
        want = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1]
        own = sorted(docs[r.doc_id], key=lambda x: x.start)
        starts = defaultdict(int)
        for x in own:
            assert np.frombuffer(x.ids, "<u4").tolist() == want[x.start : x.start + x.length]
            assert x.doc_tokens == len(want)
            starts[x.start] += x.length
        times = 2 if r.doc_id == 0 else 1  # row 0 is there twice
        assert sum(x.length for x in own) == times * len(want)


def test_little_padding(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").coalesce(1)
    rows = packing.pieces(docs, VOCABULARY).collect()
    lengths = defaultdict(int)
    for r in rows:
        lengths[r.sequence_id] += r.length
    padding = sum(0 if n & (n - 1) == 0 else packing.CAPACITY - n for n in lengths.values())
    assert padding < 0.03 * sum(lengths.values()) + packing.CAPACITY
    assert all(0 <= r.ids_crc32 < 2**32 for r in rows)


def test_crc_is_of_the_ids(documents):
    full = {(r.sequence_id, r.offset): zlib.crc32(bytes(r.ids)) for r in packing.packed(documents, VOCABULARY).collect()}
    assert full == {(r.sequence_id, r.offset): r.ids_crc32 for r in packing.pieces(documents, VOCABULARY).collect()}


def test_empty_table(no_documents):
    assert packing.pieces(no_documents, VOCABULARY).count() == 0
