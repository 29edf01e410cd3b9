import math
import re
from collections import Counter

import numpy as np
import pytest

from freshet.llm import language_model as lm
from freshet.llm.common import remainder

WORD = re.compile("[^\x20\x09-\x0d]+")


def split(text):
    return [*WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or "")), None]


def expected(train, texts):
    counts = Counter(t for text in train for t in split(text))
    total, distinct = sum(counts.values()), len(counts)
    out = []
    for text in texts:
        own = split(text)
        out.append((len(own), sum(counts[t] > 0 for t in own), total,
                    sum(math.log10((counts[t] + 1) / (total + distinct + 1)) for t in own)))
    return out


@pytest.mark.parametrize("head", [1 << 18, 20, 0])
def test_base_equals_brute_force(spark, folder, head):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(80).cache()
    held = remainder("doc_id", 7) == 2
    model = lm.fit(docs.where(~held), head=head)
    assert len(model.head) <= head
    texts = {r.doc_id: r.text for r in docs.collect()}
    train = [r.text for r in docs.where(~held).collect()]
    rows = lm.scored(docs, model, {"held_out": held}).collect()
    assert len(rows) == len(texts)
    for r, want in zip(rows, expected(train, [texts[r.doc_id] for r in rows])):
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[:3]
        assert r.base_score == pytest.approx(want[3], rel=1e-9)
        assert r.score < 0


def test_filter_gives_back_levels_and_few_others():
    random = np.random.default_rng(1)
    keys = random.integers(0, 2**63, 20_000).astype(np.uint64)
    counts = np.maximum(random.zipf(1.8, len(keys)), 1) % 5000 + 1
    own = lm.Filter(4, 1 << 17)
    bits = np.zeros(own.parts * own.bits // 8, np.uint8)
    part = own.part(keys)
    for p in range(own.parts):
        raw, least = lm.part_bits(own, keys[part == p], counts[part == p])
        assert least == 1
        bits[p * own.bits // 8 : (p + 1) * own.bits // 8] = np.frombuffer(raw, np.uint8)
    model = lm.Model(own, bits, 2, 1, 1, 1, np.empty(0, np.uint64), np.empty(0), None)
    got, want = model.levels(keys), lm.level(counts)
    assert (got >= want).all() and (got == want).mean() > 0.85  # a filter errs upwards only
    unseen = model.levels(random.integers(0, 2**63, 20_000).astype(np.uint64))
    assert (unseen > 0).mean() < 0.15


def test_overfull_filter_leaves_rare_ngrams_out():
    keys = np.arange(1, 50_001, dtype=np.uint64)
    counts = np.where(keys % np.uint64(50) == 0, 40, 1).astype(np.int64)
    raw, least = lm.part_bits(lm.Filter(1, 1 << 15), keys, counts)
    assert least > 1 and len(raw) == 1 << 12


def test_a_part_made_for_its_counts_holds_every_ngram():
    keys = np.arange(1, 50_001, dtype=np.uint64)
    counts = np.where(keys % np.uint64(50) == 0, 40, 1).astype(np.int64)
    own = lm.Filter(1, lm.bits_for(counts))
    raw, least = lm.part_bits(own, keys, counts)
    model = lm.Model(own, np.frombuffer(raw, np.uint8), 2, 1, 1, 1, np.empty(0, np.uint64), np.empty(0), None)
    assert least == 1 and (model.levels(keys) >= lm.level(counts)).all()
    assert (model.levels(keys + np.uint64(1 << 20)) > 0).mean() < 0.08


@pytest.mark.parametrize("max_bytes", [0, 1 << 16])
def test_a_table_too_large_to_broadcast_scores_alike(spark, folder, monkeypatch, max_bytes):
    monkeypatch.setattr(lm, "BUCKET_CHARACTERS", 1 << 16)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    whole, cut = lm.fit(docs), lm.fit(docs, max_bytes=max_bytes)
    assert whole.bits is not None and cut.bits is None and cut.filter.bits.sum() == whole.filter.bits.sum()
    assert len(cut.common) * lm.COMMON_BYTES <= max_bytes and (len(cut.common) > 0) == (max_bytes > 0)
    want, got = ({r.doc_id: r for r in lm.scored(docs, m).collect()} for m in (whole, cut))
    assert got.keys() == want.keys()
    for i, r in got.items():
        assert r.score == pytest.approx(want[i].score, rel=1e-12) and r.base_score == pytest.approx(want[i].base_score, rel=1e-12)


def test_levels_stand_for_their_counts():
    counts = np.array([1, 2, 3, 10, 100, 10_000])
    back = lm.LEVEL_COUNTS[lm.level(counts)]
    assert back[0] == 1 and (np.abs(np.log(back / counts)) < np.log(lm.LEVEL_BASE) * 1.5).all()


def test_bigrams_help_and_stay_inside_texts(spark):
    rows = [(i, "red fox jumps over the lazy dog") for i in range(30)] + [(99, "dog lazy the over jumps fox red")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = lm.fit(docs.where("doc_id < 99"))
    out = {r.doc_id: r for r in lm.scored(docs, model).collect()}
    assert out[0].score > out[99].score + 3
    assert out[0].base_score == pytest.approx(out[99].base_score)


def test_odd_rows(documents, no_documents):
    model = lm.fit(documents)
    rows = lm.scored(documents, model).collect()
    texts = Counter((r.doc_id, len(split(r.text))) for r in documents.collect())
    assert Counter((r.doc_id, r.n_tokens) for r in rows) == texts
    assert lm.scored(no_documents, model).count() == 0
    nothing = lm.fit(no_documents)
    assert all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in lm.scored(documents, nothing).collect())
