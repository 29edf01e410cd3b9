import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from freshet.llm import language
from freshet.llm.common import remainder


def greedy(symbols, material):
    """Phrases of a stretch by substring search."""
    count, i = 0, 0
    while i < len(symbols):
        n = 1
        while i + n < len(symbols) and symbols[i : i + n + 1] in material:
            n += 1
        count += 1
        i += n
    return count


def test_automaton_holds_all_substrings_and_no_other():
    random.seed(1)
    for _ in range(30):
        own = [random.randint(0, 3) for _ in range(40)]
        table = language.suffix_automaton(own, 5)
        inside = {tuple(own[i:j]) for i in range(41) for j in range(i + 1, min(i + 7, 41))}
        for _ in range(200):
            probe = tuple(random.randint(0, 4) for _ in range(random.randint(1, 6)))
            state = 1
            for c in probe:
                state = table[state, c] if state else 0
            assert bool(state) == (probe in inside)


def test_phrases_equal_greedy_parsing():
    random.seed(2)
    text = lambda alphabet, n: "".join(random.choice(alphabet) for _ in range(n))
    samples = {"a": [text("abc ", 300)], "b": [text("bcd ", 300)]}
    parser = language.build(samples, symbols=400, alphabet=16)
    texts = [text("abcd .Z", n) for n in (0, 1, 5, 100, 700)]
    counts, sizes = parser.phrases(texts)
    for i, t in enumerate(texts):
        own = "".join(map(chr, parser.symbols(t)))
        assert sizes[i] == len(own)
        for k, name in enumerate(parser.languages):
            material = "".join(map(chr, [0, *parser.symbols(samples[name][0])]))
            want = sum(greedy(own[low : low + language.STRETCH], material) for low in range(0, len(own), language.STRETCH))
            assert counts[i, k] == want


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = remainder("doc_id", 4) == 2
    parser = language.fit(docs.where(~held))
    rows = docs.where(held).select("lang", language.language(parser, F.col("text")).alias("p")).collect()
    assert sum(r.p.lang == r.lang for r in rows) >= 0.98 * len(rows)
    assert all(0 <= r.p.score <= 1 for r in rows)


def test_odd_rows(documents):
    parser = language.fit(documents)
    assert parser.languages == ("de", "en")
    rows = documents.select("*", language.language(parser, F.col("text")).alias("p")).collect()
    for r in rows:
        letters = any(map(str.isalpha, r.text or ""))
        assert (r.p.lang == "und" and r.p.score == 0) if not letters else r.p.lang in parser.languages
    again = language.fit(documents.repartition(7))
    assert np.array_equal(parser.table, again.table)


def test_nothing_to_learn_from(documents, no_documents):
    parser = language.fit(no_documents)
    assert {r.p.lang for r in documents.select(language.language(parser, F.col("text")).alias("p")).collect()} == {"und"}
    parser = language.fit(documents)
    assert no_documents.select(language.language(parser, F.col("text")).alias("p")).count() == 0


@pytest.mark.parametrize("text", ["Привет мир", "中文字", "𐐀𐐁 deseret", "ﬁne"])
def test_letters_outside_the_alphabet(text):
    parser = language.build({"x": ["some plain words of text"], "y": ["andere worte im text"]})
    lang, score = parser.predict([text])[0]
    assert lang in ("x", "y") and 0 < score <= 1


def test_languages_of_different_scripts_are_told_apart():
    random.seed(4)
    scripts = {"la": (97, 26), "lb": (97, 26), "ru": (0x430, 32), "uk": (0x430, 32), "ar": (0x627, 30), "hi": (0x915, 37),
               "ko": (0xAC00, 900), "zh": (0x4E00, 2500), "ja": (0x4E00, 2500)}
    lexicon = {}
    for name, (first, n) in scripts.items():
        size = (1, 2) if n > 100 else (2, 7)
        own = random.sample(range(first, first + n), n)  # some letters are commoner than others
        pick = lambda: chr(own[int(n * random.random() ** 2)])
        lexicon[name] = ["".join(pick() for _ in range(random.randint(*size))) for _ in range(900)]

    def text(name, words):
        return " ".join(lexicon[name][int(900 * random.random() ** 2)] for _ in range(words))

    parser = language.build({name: [text(name, 150) for _ in range(30)] for name in scripts})
    held = [(name, text(name, 60)) for name in scripts for _ in range(20)]
    found = parser.predict([t for _, t in held])
    assert sum(name == p for (name, _), (p, _) in zip(held, found)) >= 0.98 * len(held)
    assert all(share >= 0.3 for _, share in found)
