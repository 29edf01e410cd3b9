import math
import re

import numpy as np
import pytest

from freshet.llm import lexical_search as search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def own_terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute_force(docs, items, k=10):
    split = [(i, own_terms(t)) for i, t in docs]
    n, total = sum(bool(t) for _, t in split), sum(len(t) for _, t in split)
    wanted = {}
    for i, text in items:
        if i is not None:
            wanted.setdefault(i, set()).update(own_terms(text))
    out = {}
    for i, terms in wanted.items():
        scored = []
        weights = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * sum(t in d for _, d in split) + 1))) for t in terms}
        for doc, d in split:
            m = 10 + (90 * len(d) * n) // max(total, 1)
            score = sum(w * ((10**9 * d.count(t)) // (1000 * d.count(t) + 8 * m)) for t, w in weights.items() if t in d)
            if score > 0:
                scored.append((-score, math.inf if doc is None else doc))
        out[i] = [(None if d == math.inf else d, -s) for s, d in sorted(scored)[:k]]
    return {i: rows for i, rows in out.items() if rows}


def result(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["item_id"], r["rank"])):
        out.setdefault(r["item_id"], []).append((r["doc_id"], r["score"]))
        assert r["rank"] == len(out[r["item_id"]])
    return out


ITEMS = [
    (0, "The CAT, the mat"), (1, None), (2, "word1 word2 word3 word50 nothing"), (3, "ünï ßind ÜNÏ"), (None, "cat"), (2, "bird"),
    (5, "..."), (6, " ".join(f"word{i}" for i in range(97)) + " cat bird a 123 looked"),
]


def test_terms_are_cut_at_ascii_signs_only():
    assert search.terms("A-b_C9 naïve—ÄÖ\x00x{y}~z") == [b"a", b"b", b"c9", "naïve—ÄÖ".encode(), b"x", b"y", b"z"]
    assert search.terms(None) == search.terms("") == []


def test_ranking_of_odd_documents(spark, documents):
    items = spark.createDataFrame([(*r, 1) for r in ITEMS], "item_id long, text string, score int")
    docs = [(r["doc_id"], r["text"]) for r in documents.collect()]
    assert result(search.ranked(documents, items)) == brute_force(docs, ITEMS)


def test_no_documents_or_no_items(spark, documents, no_documents):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert search.ranked(no_documents, items).collect() == []
    assert search.ranked(documents, items.limit(0)).collect() == []
    assert search.ranked(documents, items.where("item_id = 5")).collect() == []


@pytest.fixture(scope="module")
def corpus():
    random = np.random.default_rng(5)
    names = [f"t{i}" for i in range(300)]
    chance = 1 / np.arange(1, 301)
    chance /= chance.sum()
    docs = [(i, " ".join(random.choice(names, size=int(random.integers(1, 80)), p=chance))) for i in range(900)]
    docs += [(1000 + i, docs[3][1]) for i in range(40)] + [(docs[7][0], docs[7][1])] * 3 + [(None, docs[3][1])]  # ties
    items = [(i, docs[i][1] if i % 2 else " ".join(random.choice(names, size=30, p=chance))) for i in range(24)]
    return docs, items


@pytest.mark.parametrize("small", [False, True])
def test_equals_brute_force(spark, corpus, monkeypatch, small):
    if small:  # many blocks of items and documents, trees of few documents, tiny leaves
        for name, value in {"BLOCK_ITEMS": 5, "DOCUMENTS": 64, "CELLS": 700, "LEAF": 2, "TEXTS": 1000}.items():
            monkeypatch.setattr(search, name, value)
    docs, items = corpus
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    found = search.ranked(df, spark.createDataFrame(items, "item_id long, text string"))
    assert result(found) == brute_force(docs, items)


def test_bounds_leave_out_most_documents():
    random = np.random.default_rng(2)
    tf = (random.random((20_000, 24)) < np.linspace(0.8, 0.02, 24)) * random.integers(1, 9, size=(20_000, 24))
    tf = tf[tf.any(axis=1)].astype(np.int32)
    m = 10 + random.integers(0, 300, size=len(tf))
    weights = np.linspace(300, 6000, 24).astype(np.int64)
    tree = search.Tree(tf, m, np.arange(len(tf)), weights)
    best = search.Best(10)
    tree.search(best)
    scores = search.part(tf.astype(np.int64), m[:, None]) @ weights
    order = np.lexsort((np.arange(len(tf)), -scores))[:10]
    assert best.ids.tolist() == order.tolist() and best.scores.tolist() == scores[order].tolist()
    assert tree.scored < 0.25 * len(tf)
