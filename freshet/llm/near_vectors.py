"""Near-duplicate vectors: iterative quantisation, multi-index Hamming tables, exact rerank.

Balanced binary codes come from learnt rotations (iterative quantisation on a bounded sample).
A table looks at one substring of a code: vectors of a label that agree on it meet in a bucket.
Every pair that meets is compared once, in the first table that joins it, by the cosine of the
original vectors. Equal vectors are collapsed first. Large buckets are cut into blocks that meet
pairwise; a block pair gives counts and one link per vector, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.durable import lookup, materialize
from freshet.llm.common import runs
from freshet.llm.components import components
from freshet.llm.top_k import usable

LEAST_COSINE = 0.93
SAMPLE_ROWS = 20_000
ROUNDS = 40
# Chance to miss a pair right at the least cosine, and vectors that a bucket should hold.
MISS = 0.02
BUCKET_ROWS = 64
# Squared length that centred unit vectors keep at least; the centre gives way to it.
LEAST_SPREAD = 0.3
# Share of a label's vectors that may be shorter than its spread, and sampled rows for a spread of its own.
SHORTEST = 0.1
LABEL_ROWS = 50
BLOCK_ROWS = 1024


@dataclass(frozen=True)
class Codes:
    """Rotations per vector length, and how a code is cut; of fixed size."""

    centres: dict[int, np.ndarray]
    rotations: dict[int, np.ndarray]  # (rotations * length, length)
    substring: int
    tables: int

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        """Substring of every table for unit vectors of one length."""
        dim = vectors.shape[1]
        bits = (vectors - self.centres[dim]) @ self.rotations[dim].T > 0
        per = max(dim // self.substring, 1)
        width = min(self.substring, dim)
        powers = (1 << np.arange(width)).astype(np.int64)
        out = np.empty((len(vectors), self.tables), np.int64)
        for t in range(self.tables):
            low = (t // per) * dim + (t % per) * width
            out[:, t] = bits[:, low : low + width] @ powers
        return out


def quantisation(vectors: np.ndarray, seed: int, rounds: int = ROUNDS) -> np.ndarray:
    """A rotation that brings centred vectors close to the corners of the cube.

    Rows are code bits. From a random rotation, bits and the best rotation onto them (by a
    singular value decomposition) are fitted in turn.
    """
    dim = vectors.shape[1]
    rotation = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))[0]
    for _ in range(rounds if len(vectors) > dim else 0):
        corners = np.where(vectors @ rotation > 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(vectors.T @ corners, full_matrices=False)
        rotation = left @ right
    return rotation.T


def plan(rows: int, cosine: float = LEAST_COSINE, spread: float = 1.0) -> tuple[int, int]:
    """Bits of a substring and number of tables for so many vectors of a label.

    A bit differs with the chance angle / pi, where the angle is that of the centred vectors: with
    `spread` as their squared length, a pair at the least cosine is as far apart as before and so
    at a larger angle. So many tables are used that it agrees nowhere with a chance below MISS.
    """
    bits = int(min(max(np.ceil(np.log2(max(rows, 1) / BUCKET_ROWS)), 6), 24))
    same = (1 - np.arccos(np.clip(1 - (1 - cosine) / spread, -1, 1)) / np.pi) ** bits
    return bits, int(np.ceil(np.log(MISS) / np.log(1 - same)))


def least_spread(centred: np.ndarray, labels: np.ndarray) -> float:
    """Squared length that all but SHORTEST of the vectors have in the label where it is smallest.

    Labels with few rows in the sample count as one.
    """
    if not len(centred):
        return 1.0
    lengths = (centred * centred).sum(1)
    _, own, sizes = np.unique(labels, return_inverse=True, return_counts=True)
    own = np.where(sizes[own] < LABEL_ROWS, len(sizes), own)
    return float(min(np.quantile(lengths[own == k], SHORTEST) for k in np.unique(own)))


def centre(vectors: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, float]:
    """As much of the mean as leaves every label LEAST_SPREAD, and the spread that it leaves."""
    mean = vectors.mean(0) if len(vectors) else np.zeros(vectors.shape[1])
    for part in np.linspace(1, 0, 21):
        spread = least_spread(vectors - part * mean, labels)
        if spread >= LEAST_SPREAD:
            break
    return part * mean, min(spread, 1.0)


def learn(samples: dict[int, tuple[np.ndarray, np.ndarray]], most: int, cosine: float = LEAST_COSINE, seed: int = 5) -> Codes:
    """Codes from unit vectors and labels per length, for labels of at most `most` rows."""
    found = {dim: centre(*own) for dim, own in samples.items()}
    bits, tables = plan(most, cosine, min([spread for _, spread in found.values()], default=1.0))
    centres = {dim: mean for dim, (mean, _) in found.items()}
    rotations = {}
    for dim, (own, _) in samples.items():
        needed = -(-tables // max(dim // bits, 1))
        rotations[dim] = np.concatenate([quantisation(own - centres[dim], seed + r) for r in range(needed)])
    return Codes(centres, rotations, bits, tables)


def fit(classes: DataFrame, cosine: float = LEAST_COSINE, rows: int = SAMPLE_ROWS, seed: int = 5) -> Codes:
    """Rotations from at most about `rows` vectors, chosen by a hash of their id."""
    sizes = classes.groupBy("label", "dim").agg(F.count("*").alias("n"))
    summary = sizes.agg(F.max("n").alias("most"), F.sum("n").alias("all"), F.collect_set("dim").alias("dims")).first()
    share = min(1 << 30, (rows << 30) // max(summary["all"] or 1, 1))
    sample = classes.where(F.pmod(F.xxhash64("cid", F.lit(seed)), F.lit(1 << 30)) < share)
    sample = sample.select("dim", F.xxhash64("label").alias("label"), "x").toPandas()
    samples = {}
    for dim in sorted(summary["dims"] or []):
        own = sample[sample["dim"] == dim]
        samples[dim] = unit(np.array(own["x"].to_list(), float).reshape(-1, dim)), own["label"].to_numpy()
    return learn(samples, summary["most"] or 1, cosine, seed)


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True)) if len(vectors) else vectors


def block_links(group: pd.DataFrame, table: int, same_block: bool, cosine: float) -> pd.DataFrame:
    """Links of two blocks of a bucket: per class the linked rows, and one link towards the smallest."""
    group = group.sort_values("cid", kind="stable")
    x = unit(np.stack(group["x"].to_list()).astype(float))
    keys = np.stack([np.frombuffer(k, np.int64) for k in group["keys"]])
    ids, copies = group["cid"].to_numpy(np.int64), group["copies"].to_numpy(np.int64)
    first = np.flatnonzero(group["sub"].to_numpy() == group["i"].to_numpy())
    second = first if same_block else np.flatnonzero(group["sub"].to_numpy() == group["j"].to_numpy())
    if not len(first) or not len(second):
        return pd.DataFrame({"cid": ids[:0], "links": copies[:0], "root": ids[:0]})
    hit = x[first] @ x[second].T >= cosine
    if same_block:
        np.fill_diagonal(hit, False)
    a, b = np.nonzero(hit)
    if table and len(a):
        fresh = ~(keys[first[a], :table] == keys[second[b], :table]).any(axis=1)
        a, b = a[fresh], b[fresh]
    a, b = first[a], second[b]
    links = np.bincount(a, copies[b], len(ids))
    if not same_block:
        links += np.bincount(b, copies[a], len(ids))
    roots = np.arange(len(ids))
    while len(a):  # rows are sorted by id, so the smallest row is the smallest id
        before = roots.copy()
        np.minimum.at(roots, a, before[b])
        np.minimum.at(roots, b, before[a])
        roots = roots[roots]
        if (roots == before).all():
            break
    linked = np.flatnonzero(links > 0)
    return pd.DataFrame({"cid": ids[linked], "links": links[linked].astype(np.int64), "root": ids[roots[linked]]})


def near_vectors(
    vectors: DataFrame, cosine: float = LEAST_COSINE, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of `vectors`.

    Links join vectors of one label and length with at least this cosine. Vectors that are null,
    empty, zero or hold null or non-finite components, and rows without label or id, link with
    nothing; without an id the component is null and nothing is kept. Rows that repeat an id
    should repeat its vector too; they are copies of each other.
    """
    x = F.transform(F.col(embedding), lambda v: v.cast("double"))
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(label).alias("label"), x.alias("x"))
    nonzero: Column = F.exists("x", lambda v: v != 0.0)
    rows = rows.withColumn("ok", F.col("label").isNotNull() & F.col("id").isNotNull() & usable(F.col("x")) & F.coalesce(nonzero, F.lit(False)))
    # Two hashes of the vector stand for it, so copies meet without shipping vectors.
    keyed = rows.select(
        "id", "ok", F.when(F.col("ok"), F.col("label")).alias("label"), F.col("x"),
        F.when(F.col("ok"), F.xxhash64("x", F.lit(1))).alias("k1"), F.when(F.col("ok"), F.xxhash64("x", F.lit(2))).alias("k2"),
    )
    keyed = materialize(keyed)
    classes = materialize(
        keyed.where("ok").groupBy("label", "k1", "k2")
        .agg(F.min("id").alias("cid"), F.count("*").alias("copies"), F.first("x").alias("x"))
        .withColumn("dim", F.size("x"))
    )
    codes = fit(classes, cosine)

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, own in batch.groupby("dim"):
                keys = codes.keys(unit(np.stack(own["x"].to_list()).astype(float)))
                yield pd.DataFrame({
                    "cid": own["cid"], "label": own["label"], "dim": own["dim"], "copies": own["copies"], "x": own["x"],
                    "keys": [k.tobytes() for k in keys], "values": list(keys),
                })

    kinds = dict(classes.dtypes)
    schema = f"cid long, label {kinds['label']}, dim int, copies long, x array<double>, keys binary, values array<long>"
    coded = materialize(classes.select("cid", "label", "dim", "copies", "x").mapInPandas(code, schema))
    bucket = ["label", "dim", "t", "key"]
    places = coded.select("cid", "label", "dim", F.posexplode("values").alias("t", "key"))
    sizes = materialize(places.groupBy(*bucket).agg(F.count("*").alias("n")).where("n > 1"))
    entries = coded.select("cid", "label", "dim", "copies", "x", "keys", F.posexplode("values").alias("t", "key"))
    blocks = F.ceil(F.col("n") / BLOCK_ROWS).cast("int")
    entries = (
        lookup(entries, sizes.withColumn("w", F.col("n")), bucket, weight="w").where("n > 1")
        .withColumn("sub", F.pmod(F.xxhash64("cid"), blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select("cid", *bucket, "copies", "x", "keys", "sub", F.least("sub", "other").alias("i"), F.greatest("sub", "other").alias("j"))
    )
    group = [*bucket, "i", "j"]

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in runs(batches, group, 4000):
            out = [
                block_links(own, int(own["t"].iloc[0]), own["i"].iloc[0] == own["j"].iloc[0], cosine)
                for _, own in frame.groupby(group, sort=False) if len(own) > 1
            ]
            if out:
                yield pd.concat(out, ignore_index=True)

    found = materialize(
        entries.repartition(*[F.col(c) for c in group]).sortWithinPartitions(*group)
        .mapInPandas(compare, "cid long, links long, root long")
    )
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    joined = components(found, "cid", "root")
    per_class = materialize(
        classes.select("label", "k1", "k2", "cid", "copies")
        .join(links, "cid", "left").join(joined.withColumnRenamed("node", "cid"), "cid", "left")
        .select("label", "k1", "k2", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                F.coalesce("component", "cid").alias("component_id"))
    )
    out = lookup(keyed.select("id", "label", "k1", "k2"), per_class, ["label", "k1", "k2"], weight="copies")
    component = F.coalesce("component_id", "id")
    return out.select(
        F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )
