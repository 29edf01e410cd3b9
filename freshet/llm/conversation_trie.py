"""Prefix trie of conversations that are rebuilt from a base's head and their own later turns.

Texts are looked at once, to give every distinct turn a reference (its hash, proved to stand for
one role and text only). A sequence's fingerprint is the sum of r_i * B^i modulo a prime over its
turns' numbers r_i: (length, sum) is a monoid, (l, s) + (m, t) = (l + m, s + B^l * t). So the
table is scanned in ranges of turns and only one pair per range is combined across ranges; and a
rebuilt prefix is the base's head plus its own turns moved to their place, a difference of two of
its own prefixes times a power of B. No rebuilt text or turn list is ever put together.

Equal fingerprints of one depth make a node. Every node proves that all its members' last turns have
one reference; by induction over the depth its members then share the whole prefix. Should a proof
fail, everything is done again with other numbers. Four residues make a fingerprint of 124 bits.

A node is known by (smallest member, depth). Sums over subtrees double their reach each round: a
node passes what it has to its ancestor 1, 2, 4, ... levels up, found as that of its smallest
member, so no join key repeats. Rounds grow with the logarithm of the depth.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.durable import lookup, materialize
from freshet.llm.common import mix
from freshet.operators.ordering import slices

# The two largest primes below 2^31, each with two bases.
PRIMES = (2147483647, 2147483647, 2147483629, 2147483629)
WORD = r"[^\x20\x09-\x0D]+"
# Ids of a node's ending conversations that are packed into one row.
CHUNK = 500
# Tries to find numbers under which all proofs hold; the first fails once in many billions of tables.
SEEDS = 8


class Clash(Exception):
    """Two different turns or prefixes have one reference or fingerprint."""


def bases(seed: int) -> list[int]:
    random = np.random.default_rng(seed)
    return [int(random.integers(1 << 24, p - 1)) for p in PRIMES]


def powers(base: int, exponents: np.ndarray, prime: int) -> np.ndarray:
    """base ** exponent modulo the prime."""
    out, factor = np.ones(len(exponents), np.int64), base
    left = exponents.copy()
    while left.any():
        out = np.where(left & 1, out * factor % prime, out)
        factor, left = factor * factor % prime, left >> 1
    return out


class Scan:
    """Running positions and fingerprints of the conversations of one sorted range."""

    def __init__(self, seed: int):
        self.bases = bases(seed)
        self.conv: int | None = None
        self.n = 0
        self.q = [0] * len(PRIMES)

    def step(self, conv: np.ndarray, ref: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Positions (from 1) and residues of the next rows, continuing the last conversation."""
        new = np.append(self.conv is None or conv[0] != self.conv, conv[1:] != conv[:-1])
        starts, group = np.flatnonzero(new), np.cumsum(new) - 1
        fresh = group >= 0
        begin = np.full(len(conv), -self.n)
        begin[fresh] = starts[group[fresh]]
        place = np.arange(len(conv)) - begin + 1
        residues = []
        for j, (base, prime) in enumerate(zip(self.bases, PRIMES)):
            number = (mix(ref.view(np.uint64) + np.uint64(j + 1)) % np.uint64(prime)).astype(np.int64)
            term = number * powers(base, place, prime) % prime
            upto = np.cumsum(term)
            before = np.full(len(conv), -self.q[j])
            before[fresh] = (upto - term)[starts[group[fresh]]]
            residues.append((upto - before) % prime)
        self.conv, self.n, self.q = int(conv[-1]), int(place[-1]), [int(r[-1]) for r in residues]
        return place, residues


def _positions(turns: DataFrame, seed: int) -> DataFrame:
    """conv, pos, q0..q3, ref, words: every turn with the fingerprint of its conversation up to it.

    `turns` has conv, turn, tie, ref, words. Conversations of any length may span ranges.
    """
    residues = [f"q{j}" for j in range(len(PRIMES))]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, piece = Scan(seed), TaskContext.get().partitionId()
        for batch in batches:
            if len(batch):
                place, found = state.step(batch["conv"].to_numpy(np.int64), batch["ref"].to_numpy(np.int64))
                yield pd.DataFrame({
                    "slice": piece, "last": False, "conv": batch["conv"], "pos": place, **dict(zip(residues, found)),
                    "ref": batch["ref"], "words": batch["words"],
                })
        if state.conv is not None:
            whole = {name: [value] for name, value in zip(residues, state.q)}
            yield pd.DataFrame({"slice": [piece], "last": True, "conv": state.conv, "pos": state.n, **whole, "ref": 0, "words": 0})

    keys = ["conv", "turn", "tie"]
    ranged = turns.repartitionByRange(slices(turns, turns.count()), *keys).sortWithinPartitions(*keys)
    schema = "slice int, last boolean, conv long, pos long, q0 long, q1 long, q2 long, q3 long, ref long, words long"
    rows = materialize(ranged.mapInPandas(scan, schema))
    # One row per range: what its last conversation has there. Only that one goes on in the next range.
    spark, carried, offsets = turns.sparkSession, None, []
    for row in sorted(rows.where("last").collect(), key=lambda r: r["slice"]):
        own = row["conv"], row["pos"], [row[name] for name in residues]
        if carried:
            factors = [pow(b, carried[1], p) for b, p in zip(bases(seed), PRIMES)]
            offsets.append((row["slice"], carried[0], carried[1], *carried[2], *factors))
            if carried[0] == own[0]:
                q = [(s + f * t) % p for s, f, t, p in zip(carried[2], factors, own[2], PRIMES)]
                own = own[0], carried[1] + own[1], q
        carried = own
    names = ["slice", "conv", "n", *[f"s{j}" for j in range(4)], *[f"f{j}" for j in range(4)]]
    moved = spark.createDataFrame(offsets, ", ".join(f"{name} long" for name in names))
    joined = rows.where("NOT last").join(F.broadcast(moved), ["slice", "conv"], "left")
    shifted = [
        F.when(F.col("n").isNull(), F.col(f"q{j}")).otherwise((F.col(f"s{j}") + F.col(f"f{j}") * F.col(f"q{j}")) % p).alias(f"q{j}")
        for j, p in enumerate(PRIMES)
    ]
    return joined.select("conv", (F.col("pos") + F.coalesce("n", F.lit(0))).alias("pos"), *shifted, "ref", "words")


def _fingerprint(residues: list[Column]) -> list[Column]:
    """Two longs that hold four residues."""
    pairs = zip(residues[::2], residues[1::2])
    return [F.shiftleft(a, 31).bitwiseOR(b).alias(name) for (a, b), name in zip(pairs, ("fa", "fb"))]


def _rebuilt(rows: DataFrame, base: Column, head: Column, longest: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(conv, total) per conversation, and (conv, depth, fa, fb, ref, words) per rebuilt turn."""
    first = F.when(F.col("pos") <= longest, F.struct("pos", "q0", "q1", "q2", "q3", "ref", "words"))
    convs = materialize(rows.groupBy("conv").agg(F.max("pos").alias("len"), F.sort_array(F.collect_list(first)).alias("head")))
    own = convs.withColumn("h", head.cast("long")).withColumn("base", base)
    other = convs.select(F.col("conv").alias("base"), F.col("head").alias("base_head"))
    # A base has as many rows here as conversations name it.
    both = own.join(other, "base", "left")
    taken = F.coalesce(F.slice("base_head", F.lit(1), F.col("h").cast("int")), F.array().cast(convs.schema["head"].dataType))
    both = both.withColumn("taken", taken).withColumn("hb", F.size("taken").cast("long"))
    shift = (F.col("h") - F.col("hb")).cast("int") + 1
    columns = []
    for j, (number, prime) in enumerate(zip(bases(seed), PRIMES)):
        back = F.array(*[F.lit(pow(number, -k, prime)).cast("long") for k in range(longest + 1)])
        columns += [
            F.when(F.col("hb") > 0, F.try_element_at("taken", F.col("hb").cast("int"))[f"q{j}"]).otherwise(0).alias(f"b{j}"),
            F.when(F.col("h") > 0, F.get("head", F.col("h").cast("int") - 1)[f"q{j}"]).otherwise(0).alias(f"o{j}"),
            F.element_at(back, shift).alias(f"i{j}"),
        ]
    total = F.col("hb") + F.greatest(F.col("len") - F.col("h"), F.lit(0))
    both = materialize(both.select("conv", "h", "hb", "taken", total.alias("total"), *columns))
    suffix = lookup(rows, both.drop("taken", "total"), ["conv"]).where(F.col("pos") > F.col("h"))
    moved = [
        (F.col(f"b{j}") + F.pmod(F.col(f"q{j}") - F.col(f"o{j}"), F.lit(p)) * F.col(f"i{j}")) % p for j, p in enumerate(PRIMES)
    ]
    suffix = suffix.select("conv", (F.col("pos") - F.col("h") + F.col("hb")).alias("depth"), *_fingerprint(moved), "ref", "words")
    heads = both.select("conv", F.explode("taken").alias("t")).select("conv", "t.*")
    heads = heads.select("conv", F.col("pos").alias("depth"), *_fingerprint([F.col(f"q{j}") for j in range(4)]), "ref", "words")
    return both.select("conv", "total"), materialize(suffix.unionByName(heads))


def _digests(ends: DataFrame) -> DataFrame:
    """conv, depth, ends_sha256 of `ends` (conv, depth, own): a node's ids in order, through one hash.

    Ranges of sorted ids are packed into rows of CHUNK ids first; a node's rows are then streamed.
    """

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            conv, depth, own = (batch[c].to_numpy(np.int64) for c in ("conv", "depth", "own"))
            new = np.append(True, (conv[1:] != conv[:-1]) | (depth[1:] != depth[:-1])) if len(conv) else np.empty(0, bool)
            cuts = [*np.flatnonzero(new).tolist(), len(conv)]
            pieces = [(a, min(a + CHUNK, high)) for low, high in zip(cuts, cuts[1:]) for a in range(low, high, CHUNK)]
            begin = [a for a, _ in pieces]
            yield pd.DataFrame({
                "conv": conv[begin], "depth": depth[begin], "first": own[begin],
                "ids": [",".join(map(str, own[a:b].tolist())).encode() for a, b in pieces],
            })

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, hashed = None, None
        for batch in batches:
            done = []
            for conv, depth, ids in zip(batch["conv"].tolist(), batch["depth"].tolist(), batch["ids"]):
                if (conv, depth) != node:
                    if node:
                        done.append((*node, hashed.hexdigest()))
                    node, hashed = (conv, depth), sha256(ids)
                else:
                    hashed.update(b",")
                    hashed.update(ids)
            yield pd.DataFrame(done, columns=["conv", "depth", "ends_sha256"])
        if node:
            yield pd.DataFrame([(*node, hashed.hexdigest())], columns=["conv", "depth", "ends_sha256"])

    ranged = ends.repartitionByRange("conv", "depth", "own").sortWithinPartitions("conv", "depth", "own")
    chunks = materialize(ranged.mapInPandas(pack, "conv long, depth long, first long, ids binary"))
    dealt = chunks.repartition("conv", "depth").sortWithinPartitions("conv", "depth", "first")
    return dealt.mapInPandas(digest, "conv long, depth long, ends_sha256 string")


def _subtree_sums(nodes: DataFrame, owners: DataFrame, deepest: int) -> DataFrame:
    """conv, depth, leaves, saved: both summed over the subtree of each node."""
    sums = materialize(nodes.select("conv", "depth", "leaves", "saved"))
    step = 1
    while step < deepest:
        up = owners.select("conv", (F.col("depth") + step).alias("depth"), "owner")
        passed = sums.join(up, ["conv", "depth"]).select(
            F.col("owner").alias("conv"), (F.col("depth") - step).alias("depth"), "leaves", "saved"
        )
        sums = materialize(
            sums.unionByName(passed).groupBy("conv", "depth").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        )
        step *= 2
    return sums


def _trie(said: DataFrame, base: Column, head: Column, longest: int, seed: int) -> DataFrame:
    ref = F.xxhash64(F.lit(seed), "role", "text")
    texts = said.select(ref.alias("ref"), "role", "text").distinct()
    if not texts.groupBy("ref").count().where("count > 1").isEmpty():
        raise Clash("turns")
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    turns = materialize(said.select("conv", "turn", F.xxhash64("role", "text").alias("tie"), ref.alias("ref"), words.alias("words")))
    convs, members = _rebuilt(_positions(turns, seed), base, head, longest, seed)
    key = ["depth", "fa", "fb"]
    nodes = materialize(members.groupBy(*key).agg(
        F.min("conv").alias("owner"), F.count(F.lit(1)).alias("n"), F.min("ref").alias("low"), F.max("ref").alias("high"),
        F.max("words").alias("words"),
    ))
    if not nodes.where("low != high").isEmpty():
        raise Clash("prefixes")
    # Of each rebuilt turn the smallest member of its node.
    owners = materialize(lookup(members.select("conv", *key), nodes.select(*key, "owner"), key).select("conv", "depth", "owner"))
    whole = convs.agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n")).first()
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    root, zero = F.lit(whole["conv"]).cast("long"), F.lit(0).cast("long")

    above = owners.select("conv", (F.col("depth") + 1).alias("depth"), F.col("owner").alias("parent"))
    own = nodes.select(F.col("owner").alias("conv"), "depth", "n", ((F.col("n") - 1) * F.col("words")).alias("saved"))
    own = own.join(above, ["conv", "depth"], "left").withColumn("parent", F.when(F.col("depth") == 1, root).otherwise(F.col("parent")))
    own = materialize(own)
    children = own.groupBy(F.col("parent").alias("conv"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("children"))
    own = own.join(children, ["conv", "depth"], "left").withColumn("children", F.coalesce("children", zero))
    own = materialize(own.withColumn("leaves", F.when(F.col("children") == 0, 1).otherwise(0).cast("long")))
    sums = _subtree_sums(own, owners, deepest)
    summed = own.drop("leaves", "saved").join(sums, ["conv", "depth"])
    top = own.agg(
        F.sum(F.when(F.col("depth") == 1, 1)).alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")
    ).select(
        root.alias("conv"), zero.alias("depth"), F.lit(whole["n"]).cast("long").alias("n"), F.lit(None).cast("long").alias("parent"),
        F.coalesce("children", zero).alias("children"), F.coalesce("leaves", F.lit(1).cast("long")).alias("leaves"),
        F.coalesce("saved", zero).alias("saved"),
    ).where(F.col("conv").isNotNull())
    ends = convs.join(owners, (convs.conv == owners.conv) & (F.col("total") == F.col("depth")), "left").select(
        F.when(F.col("total") == 0, root).otherwise(F.col("owner")).alias("conv"), F.col("total").alias("depth"), convs.conv.alias("own")
    )
    return summed.unionByName(top).join(_digests(ends), ["conv", "depth"], "left").select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def default_base(conv: Column) -> Column:
    return conv - conv % 20


def default_head(conv: Column) -> Column:
    return F.crc32(conv.cast("string")) % 4


def prefix_trie(
    conversations: DataFrame, base=default_base, head=default_head, longest: int = 3,
    conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of each node.

    A conversation is rebuilt from the first head(id) turns of the conversation base(id), fewer if
    that has fewer and none if it is not there, and its own turns after as many; head(id) is at most
    `longest`. Turns are ordered with null first; those that tie, repeated rows among them, all
    count, in an order that depends on their role and text only. Null role or text is empty. Rows
    without an id take no part; without any row there is no node, not even the root. Other
    columns are not read.
    """
    said = conversations.select(
        F.col(conv_id).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    ).where("conv IS NOT NULL")
    for seed in range(SEEDS):
        try:
            return _trie(said, base(F.col("conv")), head(F.col("conv")), longest, seed)
        except Clash:
            continue
    raise Clash(f"none of {SEEDS} seeds")
