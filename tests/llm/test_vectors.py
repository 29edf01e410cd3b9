import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from freshet.llm import near_vectors as near
from freshet.llm import queries, top_k


@pytest.fixture(scope="module")
def vectors(spark):
    random = np.random.default_rng(3)
    rows = []
    base = random.normal(size=(12, 16))
    for i in range(300):
        v = base[i % 12] + random.normal(size=16) * (0.05 if i % 3 else 0.8)
        rows.append((i, [float(x) for x in v], i % 4 if i % 11 else None, "clash"))
    rows += [(300 + i, rows[5][1], rows[5][2], None) for i in range(60)]  # a hot vector
    rows += [
        (400, None, 1, "x"), (401, [], 1, "x"), (402, [0.0] * 16, 1, "x"), (403, [1.0] * 15 + [None], 1, "x"),
        (404, [1.0] * 15 + [math.nan], 1, "x"), (405, [1.0] * 15 + [math.inf], 1, "x"), (406, [1.0, 2.0], 1, "x"),
        (407, [1.0, 2.0], 1, "x"), (None, [1.0] * 16, 1, "x"), (7, rows[7][1], rows[7][2], "again"),
    ]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, score string").repartition(3)


def usable(rows):
    out = {}
    for r in rows:
        v = r.embedding
        if r.vec_id is not None and v and all(x is not None and math.isfinite(x) for x in v):
            out[r.vec_id] = (np.array(v), r.label)
    return out


@pytest.mark.parametrize("block", [4096, 50])
def test_top_k_equals_brute_force(vectors, monkeypatch, block):
    monkeypatch.setattr(top_k, "CANDIDATES", block)
    monkeypatch.setattr(top_k, "QUERIES", block)
    own = vectors.where(top_k.usable(F.col("embedding"))).withColumn("embedding", top_k.floored(F.col("embedding")))
    rows = top_k.top_k(own, F.col("vec_id") % 20 == 0).collect()
    data = {i: np.floor(256 * v).astype(int) for i, (v, _) in usable(vectors.collect()).items()}
    for q in [i for i in data if i % 20 == 0]:
        want = sorted((-int(data[q] @ v), i) for i, v in data.items() if i != q and len(v) == len(data[q]))[:5]
        got = sorted((r.rank, r.vec_id, r.score) for r in rows if r.query_id == q)
        assert got == [(n + 1, i, -s) for n, (s, i) in enumerate(want)]


def test_bounds_decide_before_all_is_read():
    random = np.random.default_rng(5)
    values = random.integers(-20, 20, (2000, 8))
    values[:6] = 250
    weights = np.full((1, 8), 200)
    out = top_k.block_top(np.arange(2000), values, np.array([-1]), weights, 5)
    assert out["vec_id"].tolist() == [0, 1, 2, 3, 4]


def test_bounds_leave_few_candidates_of_both_signs():
    random = np.random.default_rng(6)
    values = np.floor(random.normal(size=(2000, 64)) / 8 * 256).astype(np.int64)
    own = np.arange(40)[:, None] == np.arange(2000)
    alive = top_k.survivors(values, values[:40], own, 5)
    assert alive.mean() < 0.05
    scores = np.where(own, -(2**60), values[:40] @ values.T)
    best = np.argsort(-scores, axis=1, kind="stable")[:, :5]
    assert np.take_along_axis(alive, best, axis=1).all()


def test_large_numbers_stay_exact():
    values = np.array([[2**40, 1], [2**40, 2], [2**40, 3]])
    out = top_k.block_top(np.arange(3), values, np.array([9]), np.array([[2**20, 1]]), 2)
    assert out["score"].tolist() == [2**60 + 3, 2**60 + 2]


def test_top_k_query_equals_its_sql(spark, folder):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    want = sorted(duck.execute(queries.ORACLES["op7_top_k"]).fetchall())
    got = queries.op7_top_k(spark, folder)
    assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == want


def brute_links(rows, cosine):
    ids = {}
    every = []
    for n, r in enumerate(rows):
        v = r.embedding
        fine = r.vec_id is not None and r.label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
        every.append((r.vec_id, np.array(v) / np.linalg.norm(v) if fine else None, r.label))
    links = [[] for _ in every]
    for i, (_, a, x) in enumerate(every):
        for j, (_, b, y) in enumerate(every):
            if i != j and a is not None and b is not None and x == y and len(a) == len(b) and a @ b >= cosine:
                links[i].append(j)
    for i, (own, _, _) in enumerate(every):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids[i] = (own, len(links[i]), min(every[j][0] for j in seen) if own is not None else None)
    return ids


@pytest.mark.parametrize("block", [1024, 20])
def test_near_vectors_recall_and_precision(vectors, monkeypatch, block):
    monkeypatch.setattr(near, "BLOCK_ROWS", block)
    rows = vectors.collect()
    want = brute_links(rows, 0.93)
    got = sorted(map(tuple, near.near_vectors(vectors).select("vec_id", "n_links", "component_id").collect()), key=str)
    assert len(got) == len(rows)
    full = sorted(want.values(), key=str)
    total, found = sum(w[1] for w in full), sum(g[1] for g in got)
    assert 0.9 * total <= found <= total and total > 3000
    by_id = {w[0]: w[1] for w in full}
    assert all(n <= by_id[i] for i, n, _ in got)
    for r in near.near_vectors(vectors).where("vec_id >= 400").collect():
        assert r.n_links == (1 if r.vec_id in (406, 407) else 0)
        assert r.kept == (r.vec_id != 407)


def test_all_pairs_are_found_with_many_tables(vectors, monkeypatch):
    monkeypatch.setattr(near, "MISS", 1e-9)
    rows = vectors.collect()
    want = sorted(brute_links(rows, 0.93).values(), key=str)
    got = near.near_vectors(vectors).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == want
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)


@pytest.mark.parametrize("length", [0.0, 0.5, 0.7, 0.8, 0.95])
def test_recall_with_a_common_direction_and_a_large_label(length):
    random = np.random.default_rng(8)
    dim, n = 64, 3000
    common = np.zeros(dim)
    common[0] = length

    def vectors(n):
        own = random.normal(size=(n, dim))
        own[:, 0] = 0
        return common + near.unit(own) * math.sqrt(1 - length * length)

    # A pair at the cosine, both along the common direction: the rest of each has this angle.
    rest = (near.LEAST_COSINE - length**2) / (1 - length**2)
    a, other = vectors(n) - common, random.normal(size=(n, dim))
    other[:, 0] = 0
    side = other - a * ((other * a).sum(1) / (a * a).sum(1))[:, None]
    b = common + rest * a + math.sqrt(1 - rest**2) * near.unit(side) * math.sqrt(1 - length**2)
    a = a + common
    assert np.allclose((a * b).sum(1), near.LEAST_COSINE) and np.allclose((b * b).sum(1), 1)
    codes = near.learn({dim: (vectors(4000), np.zeros(4000, int))}, 3_000_000)
    assert (codes.keys(a) == codes.keys(b)).any(axis=1).mean() >= 0.96


def test_quantisation_is_a_rotation():
    random = np.random.default_rng(6)
    x = random.normal(size=(500, 8)) @ random.normal(size=(8, 8))
    r = near.quantisation(x, 1)
    assert np.allclose(r @ r.T, np.eye(8))
    loss = lambda m: np.abs(np.where(x @ m.T > 0, 1, -1) - x @ m.T).sum()
    assert loss(r) <= loss(np.linalg.qr(np.random.default_rng(1).normal(size=(8, 8)))[0].T) * 1.05


def test_empty_tables(vectors):
    none = vectors.limit(0)
    assert near.near_vectors(none).count() == 0
    assert top_k.top_k(none, F.col("vec_id") % 50 == 0).count() == 0
