import random

import numpy as np
import pytest

from freshet.llm import ngram_join as join
from freshet.llm.components import components


def sets_of(text, width=5):
    import re

    own = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not own:
        return set()
    k = min(width, len(own))
    return {tuple(own[i : i + k]) for i in range(len(own) - k + 1)}


def brute(rows):
    sets = [sets_of(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def family(rng, words, copies, edits):
    out = [words]
    for _ in range(copies):
        own = list(words)
        for _ in range(edits):
            own[rng.randrange(len(own))] = f"e{rng.randrange(10**6)}"
        out.append(own)
    return [" ".join(w) for w in out]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    word = lambda: f"w{rng.randrange(4000)}"
    passage = [word() for _ in range(60)]
    texts = []
    for n in (1, 2, 3, 4, 5, 6, 7, 8, 9, 12, 16, 20, 25, 30, 60, 150):
        for edits in (0, 1, 2):
            texts += family(rng, [word() for _ in range(n)], 3, edits)
    texts += family(rng, [word() for _ in range(120)], 80, 2)  # a large group of near copies
    texts += [texts[-1]] * 40  # and of exact ones
    texts += [" ".join(passage + [word() for _ in range(rng.randrange(3, 90))]) for _ in range(120)]  # a shared passage
    texts += [" ".join(passage[: rng.randrange(30, 60)]) for _ in range(40)]
    texts += [None, "", " \n ", None, "Same Words here", "same words HERE", "same words", "a b c d e", "a b c d e a b c d e"]
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, texts[50]), (None, "alone without an id in all the world")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("noise", [64, 2])
def test_components_equal_brute_force(spark, rows, monkeypatch, noise):
    """With few and with many frequent shingles."""
    monkeypatch.setattr(join, "heavy_bits", lambda c: c > noise)
    docs = spark.createDataFrame([(d, t, "clash") for d, t in rows], "doc_id long, text string, node string").repartition(5)
    got = join.near_documents(docs).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


@pytest.mark.parametrize("border", [3, 10, 48])
def test_any_boundary_gives_the_same(spark, rows, monkeypatch, border):
    monkeypatch.setattr(join, "boundary", lambda *a, **k: border)
    some = rows[::2]
    docs = spark.createDataFrame(some, "doc_id long, text string").repartition(3)
    got = join.near_documents(docs).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute(some)


def test_boundary_follows_the_cost():
    small = {5: 1000, 8: 1000, 20: 10}
    assert join.boundary(small, 1.0) < join.boundary(small, 50.0)


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(8)
    heavy = np.zeros(join.SKETCH, bool)
    heavy[rng.integers(0, join.SKETCH, join.SKETCH // 3)] = True
    for _ in range(400):
        n = int(rng.integers(3, 60))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = a[rng.random(len(a)) > 0.1]
        b = np.unique(np.append(b, rng.integers(0, 2**63, int(rng.integers(0, n // 4 + 1))).astype(np.uint64)))
        both = len(np.intersect1d(a, b))
        if 100 * both < 75 * (len(a) + len(b) - both) or np.array_equal(a, b):
            continue
        for border in (3, 8, 20, 48):
            x, y = (join.signatures(s, heavy, border)[0] for s in (a, b))
            assert len(np.intersect1d(x, y))


def test_representatives(spark, rows):
    clashes = "doc_id long, text string, component_id string, _id int, _node int, _only int, _least int, node int"
    docs = spark.createDataFrame([(d, t, "x", 1, 2, 3, 4, 5) for d, t in rows], clashes)
    out = join.representatives(docs)
    assert out.columns == docs.columns
    kept = out.collect()
    assert all(tuple(r)[2:] == ("x", 1, 2, 3, 4, 5) for r in kept)
    kept = [(r.doc_id, r.text) for r in kept]
    groups = {c for d, n, c in brute(rows) if n and c is not None}
    with_words = sorted((d for d, t in kept if sets_of(t) and d is not None))
    assert with_words == sorted(groups)
    # Rows without an id and a group of their own: one stays. Rows without words all stay.
    assert [t for d, t in kept if d is None and sets_of(t)] == ["alone without an id in all the world"]
    assert sorted(d for d, t in kept if not sets_of(t)) == sorted(d for d, t in rows if not sets_of(t))


def test_copies_without_id_and_ids_that_repeat(spark):
    copy = "four copies of one text with more than five words in it"
    rows = [(None, copy), (None, copy.upper()), (None, copy), (9, copy), (None, "only here and without any id at all"), (None, None)]
    rows += [(None, "only here and without any id at all")] * 3 + [(5, "one text"), (5, "other text"), (5, "one text"), (6, "other text"), (5, None)]
    kept = join.representatives(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in kept) == sorted([
        ("9", copy), ("None", "only here and without any id at all"), ("None", "None"), ("5", "one text"), ("5", "other text"), ("5", "None"),
    ])


def test_possible_never_drops_a_link():
    rng = np.random.default_rng(4)
    for n in (3, 20, 400, 30_000):
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        for share in (0.99, 0.9, 0.86, 0.8, 0.5, 0.1):
            b = np.unique(np.append(a[rng.random(len(a)) < share], rng.integers(0, 2**64, n // 20, dtype=np.uint64)))
            if not len(b):
                continue
            exact = join.enough(len(a), len(b), a, b)
            passed = join.possible(len(a), len(b), *(np.frombuffer(join.slot_counts(x), np.uint8) for x in (a, b)))
            assert passed or not exact
            if n == 400 and share <= 0.1:
                assert not passed
    crowded = np.arange(1000, dtype=np.uint64)  # one slot with more than a byte holds
    assert join.possible(1000, 1000, *[np.frombuffer(join.slot_counts(crowded), np.uint8)] * 2)


@pytest.mark.parametrize("block", [3, 2048])
def test_crossed_blocks_give_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(join, "BLOCK", block)
    rng = random.Random(5)
    rows = [(k, i, 20 + i % 5, rng.randrange(3), rng.choice([0, 0, 0, 1, 2, i])) for k in (1, 2, 3) for i in rng.sample(range(60), 25)]
    rows += [(9, i, 20, 0, 4) for i in range(70, 80)]
    own = spark.createDataFrame(rows, "list long, node long, n long, place long, c long")
    want = set()
    for x in rows:
        for y in rows:
            room = min(x[2] - x[3], y[2] - y[3])
            if x[0] == y[0] and x[1] < y[1] and x[4] != y[4] and 100 * min(x[2], y[2]) >= 75 * max(x[2], y[2]) and 175 * room >= 75 * (x[2] + y[2]):
                want.add((x[1], y[1]))
    got = [tuple(r) for r in join._crossed(own, 75).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_a_pair_is_handed_on_by_one_of_its_lists(spark, monkeypatch):
    """12 sets that meet in 30 lists are 66 pairs, not 1,980; those that meet in a later list only are kept."""
    made = spark.sparkContext.accumulator(0)
    plain = join._least_shared

    def counted(*args):
        out = plain(*args)
        made.add(int(out.sum()))
        return out

    monkeypatch.setattr(join, "_least_shared", counted)
    rows = [(k, i, 20, 0, i) for k in range(30) for i in range(12)] + [(99, i, 20, 1, i) for i in (0, 5, 40)]
    own = spark.createDataFrame(rows, "list long, node long, n long, place long, c long")
    got = {tuple(r) for r in join._crossed(own, 75).collect()}
    assert got == {(i, j) for j in range(12) for i in range(j)} | {(0, 40), (5, 40)}
    assert made.value == 68


def test_chains_and_cycles(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 501), (501, 502), (502, 500), (7, 7), (None, 3), (900, 901)]
    out = components(spark.createDataFrame(edges, "x long, y long"), "x", "y").collect()
    got = {r.node: r.component for r in out}
    assert len(out) == len(got)
    assert got == {i: 0 for i in range(201)} | {500: 500, 501: 500, 502: 500, 900: 900, 901: 900}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert join.near_documents(docs).count() == 0
    assert join.representatives(docs).count() == 0


def test_pairs_of_blocks_come_in_bounded_parts(monkeypatch):
    """Two blocks of 300 that all may link: 90,000 pairs, about 1,000 of them at once."""
    monkeypatch.setattr(join, "PAIRS", 1000)
    n, place = np.full(600, 20), np.zeros(600, np.int64)
    c, block = np.arange(600), np.repeat([0, 1], 300)
    parts = list(join._batched(join._block_pairs(n, place, c, block, False, 75)))
    assert max(len(x) for x, _ in parts) <= 1300
    assert sorted(p for x, y in parts for p in zip(x.tolist(), y.tolist())) == [(a, b) for a in range(300) for b in range(300, 600)]
    same = list(join._batched(join._block_pairs(n, place, c // 2, np.zeros(600), True, 75)))
    assert sum(len(x) for x, _ in same) == 600 * 599 // 2 - 300 and max(len(x) for x, _ in same) <= 1600


def test_counting_needs_no_second_sketch():
    import tracemalloc

    rng = np.random.default_rng(2)
    sets = [rng.integers(0, 2**64, 500, dtype=np.uint64) for _ in range(200)]
    counters = np.zeros(join.SKETCH, np.uint32)
    tracemalloc.start()
    join.tally(counters, sets + sets[:50])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    places = (np.concatenate(sets + sets[:50]) >> np.uint64(20)).astype(np.int64) & (join.SKETCH - 1)
    assert (counters == np.bincount(places, minlength=join.SKETCH)).all()
    assert peak < counters.nbytes


def test_workers_get_small_batches(spark, monkeypatch):
    """While links are found, and only then."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, seen = spark.conf.get(name), []
    monkeypatch.setattr(join, "links", lambda docs, doc_id, *_: seen.append(spark.conf.get(name)) or (
        docs.selectExpr("doc_id", "1L AS n", "doc_id AS node"), docs.selectExpr("doc_id AS a", "doc_id AS b")))
    join.near_documents(spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")).collect()
    assert seen == [str(join.BATCH)] and spark.conf.get(name) == before
