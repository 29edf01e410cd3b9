import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from freshet.llm import conversation_trie as trie

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute_force(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        built[c] = own.get(base, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    out = set()

    def visit(path):
        leaves, saved = 0, (len(members[path]) - 1) * (len(WORD.findall(path[-1][1])) if path else 0)
        for child in children[path]:
            more = visit(child)
            leaves, saved = leaves + more[0], saved + more[1]
        leaves = leaves or 1
        ends = ",".join(str(c) for c in sorted(members[path]) if len(built[c]) == len(path))
        parent = min(members[path[:-1]]) if path else None
        out.add((
            min(members[path]), len(path), parent, len(members[path]), len(children[path]), leaves, saved,
            hashlib.sha256(ends.encode()).hexdigest(),
        ))
        return leaves, saved

    if members:
        visit(())
    return out


def check(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, "clash", 7) for r in rows], "conv_id long, turn long, role string, text string, depth string, n int")
    found = [tuple(r) for r in trie.prefix_trie(df.repartition(parts)).collect()]
    assert len(found) == len(set(found))
    # Ties on a turn may come in either order; the rows here that tie are equal.
    assert set(found) == brute_force(rows)


def talk(random, conv, turns, texts=6):
    roles = ["user", "assistant"]
    return [(conv, t, roles[t % 2], f"say {random.integers(texts)} word word") for t in range(turns)]


def test_small_conversations(spark):
    random = np.random.default_rng(1)
    rows = [r for c in range(-45, 130) for r in talk(random, c, int(random.integers(0, 7)), 3)]
    check(spark, rows)


def test_nulls_ties_and_repeated_rows(spark):
    rows = [
        (1, None, "user", "first by null"), (1, 0, None, "x"), (1, 1, "user", None), (2, 0, "user", ""), (2, 0, "user", ""),
        (None, 0, "user", "no id"), (None, 1, "user", "no id"), (3, 0, "ab", "c"), (4, 0, "a", "bc"), (5, 5, None, None),
        (7, 0, "user", "gone"), (40, 0, "user", "base"), (59, 0, "user", "x"), (60, -3, "user", "  two\twords\n"), (61, 9, "", ""),
    ]
    check(spark, rows)
    check(spark, rows * 2)


def test_no_conversations(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert trie.prefix_trie(df).collect() == []
    df = spark.createDataFrame([(None, 1, "a", "b")], "conv_id long, turn long, role string, text string")
    assert trie.prefix_trie(df).collect() == []


def test_hot_prefix_and_many_copies(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 7)
    random = np.random.default_rng(3)
    same = [("user", "hello there"), ("assistant", "hi"), ("user", "what now")]
    rows = [(c, t, *s) for c in range(0, 300) for t, s in enumerate(same[: 1 + (c % 3 > 0) * 2])]
    rows += [r for c in range(300, 330) for r in talk(random, c, 5, 2)]
    check(spark, rows)


@pytest.mark.parametrize("conv", [40, 47])
def test_long_conversation_over_several_ranges(spark, conv):
    random = np.random.default_rng(4)
    rows = talk(random, conv, 700, 4) + [r for c in (20, 41, 44, 48, 60) for r in talk(random, c, 3, 2)]
    rows += [(c, t, r, s) for c in (56, 57) for _, t, r, s in rows[:600]]  # long shared prefixes
    check(spark, rows)


def test_scan_is_a_monoid():
    random = np.random.default_rng(6)
    conv = np.sort(random.integers(0, 5, size=200))
    ref = random.integers(-(2**62), 2**62, size=200)
    place, whole = trie.Scan(0).step(conv, ref)
    split = trie.Scan(0)
    parts = [split.step(conv[a:b], ref[a:b]) for a, b in ((0, 1), (1, 90), (90, 91), (91, 200))]
    assert np.concatenate([p[0] for p in parts]).tolist() == place.tolist()
    for j, (base, prime) in enumerate(zip(trie.bases(0), trie.PRIMES)):
        assert np.concatenate([p[1][j] for p in parts]).tolist() == whole[j].tolist()
        alone = trie.Scan(0)
        left, right = alone.step(np.zeros(40, int), ref[:40])[1][j][-1], trie.Scan(0).step(np.zeros(30, int), ref[40:70])[1][j][-1]
        both = trie.Scan(0).step(np.zeros(70, int), ref[:70])[1][j][-1]
        assert (int(left) + pow(base, 40, prime) * int(right)) % prime == both


def test_clash_of_fingerprints_starts_again(spark, monkeypatch):
    real, tried = trie.bases, []

    def weak(seed):
        tried.append(seed)
        return [0] * 4 if seed == 0 else real(seed)  # with base 0 every prefix looks alike

    monkeypatch.setattr(trie, "bases", weak)
    monkeypatch.setattr(trie, "powers", lambda b, e, p: np.zeros(len(e), np.int64) if b == 0 else POWERS(b, e, p))
    monkeypatch.setattr(trie, "pow", lambda b, e, p: 0 if b == 0 else pow(b, e, p), raising=False)
    random = np.random.default_rng(8)
    rows = [r for c in range(30) for r in talk(random, c, 3)]
    check(spark, rows)
    assert set(tried) >= {1}


POWERS = trie.powers
