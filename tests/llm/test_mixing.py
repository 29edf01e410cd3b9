import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from freshet.llm import mixing

WORD = re.compile("[^\x20\x09-\x0d]+")


def targets(sizes, weights=(3, 1, 2), percent=150, epochs=2):
    """Excess reshared round by round."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    share = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, out = sum(sizes.values()) * percent / 100, {}
    while True:
        free = [s for s in names if s not in out]
        total = sum(share[s] for s in free)
        over = [s for s in free if share[s] * left / total > epochs * sizes[s]]
        if not over:
            return out | {s: share[s] * left / total for s in free}
        for s in over:
            out[s] = epochs * sizes[s]
            left -= out[s]


@pytest.fixture
def mixable(spark):
    random_words = [" ".join(["w"] * (i * 7 % 31)) for i in range(240)]
    rows = [(i, t, ["a", "Z", "é", "b", "tiny", None][i % 6 if i % 3 else 0], "clash", 1.0) for i, t in enumerate(random_words)]
    rows += [(500, "one two three", "tiny", "x", None), (501, None, "empty", "x", None), (502, "", "empty", "x", None)]
    rows += [(503, "x " * 600, "whale", "x", None)] + [(None, "no id", "a", "x", 2.0)] * 5 + [rows[9]] * 4
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size string, target double").repartition(5)


def test_targets_and_taken_words(mixable):
    rows = mixable.select("doc_id", "text", "source").collect()
    sizes, of = defaultdict(int), {}
    for r in rows:
        sizes[r["source"]] += len(WORD.findall(r["text"] or ""))
    wanted = targets(dict(sizes))
    assert min(wanted[s] / sizes[s] for s in sizes if sizes[s]) < 1 < max(wanted[s] / sizes[s] for s in sizes if sizes[s]) == 2
    of = {r["doc_id"]: r for r in rows}
    found = mixing.mixed(mixable).collect()
    assert len(found) == len(rows)
    taken = defaultdict(int)
    for r in found:
        text, source = of[r["doc_id"]]["text"], of[r["doc_id"]]["source"]
        assert r["size"] == len(WORD.findall(text or "")) and r["source_size"] == sizes[source]
        assert r["target"] == pytest.approx(wanted[source])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[source] += r["taken"]
    assert {s: taken[s] for s in sizes} == {s: int(wanted[s] + 1e-9) for s in sizes}
    assert sum(wanted.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_whole_repetitions_and_one_in_part(mixable):
    by_source = defaultdict(list)
    for r in mixing.mixed(mixable).collect():
        by_source[r["source_size"]].append(r)
    for rows in by_source.values():
        assert sum(r["taken"] % r["size"] != 0 for r in rows if r["size"]) <= 1


def test_reruns_agree_at_any_partitioning_and_seeds_differ(mixable):
    first = sorted(map(str, mixing.mixed(mixable).collect()))
    assert sorted(map(str, mixing.mixed(mixable.repartition(2, F.col("text"))).collect())) == first
    assert sorted(map(str, mixing.mixed(mixable, seed="other").collect())) != first


def test_descent_with_short_digits(mixable, monkeypatch):
    first = sorted(map(str, mixing.mixed(mixable).collect()))
    monkeypatch.setattr(mixing, "LEVEL", 1)
    monkeypatch.setattr(mixing, "LEVELS", 2)  # several documents share the boundary's digits
    assert sorted(map(str, mixing.mixed(mixable).collect())) == first


def test_mixture_repeats_texts(mixable):
    taken = defaultdict(int)
    for r in mixing.mixed(mixable).collect():
        taken[r["doc_id"]] += r["taken"]
    words = defaultdict(int)
    for r in mixing.mixture(mixable).collect():
        words[r["doc_id"]] += len(WORD.findall(r["text"]))
    assert words == {i: n for i, n in taken.items() if n}


def test_odd_documents_and_empty_tables(documents, no_documents):
    assert mixing.mixed(no_documents.withColumn("source", F.lit("s"))).collect() == []
    rows = mixing.mixed(documents.withColumn("source", F.when(F.col("doc_id") < 3, "s"))).collect()
    assert len(rows) == documents.count()
    empty = mixing.mixed(documents.where("text IS NULL OR text = ''").withColumn("source", F.col("lang"))).collect()
    assert [(r["size"], r["source_size"], r["target"], r["taken"]) for r in empty] == [(0, 0, 0.0, 0)] * 2
