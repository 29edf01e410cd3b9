"""Jaccard join of documents on word shingles, light sets and heavy lists apart.

Equal sets are collapsed first; what follows works on distinct sets, known by a 64-bit hash.
All sets are ordered alike: rare shingles by hash, then those that a counting sketch over all
documents finds frequent. Two sets with Jaccard t or more share at least ceil(t * n) shingles, so
of the first n - ceil(t * n) + k shingles of either they share k.

* Small sets enumerate the 2-subsets of such a prefix (k = 2); a common subset makes a candidate.
* Large sets put the shingles of such a prefix (k = 1) into inverted lists and scan those; so do
  small sets that are large enough to link with a large one.
* The boundary is the size from which enumerating costs more than scanning lists.

Lists of rare shingles are short (the sketch never undercounts) and are gathered as packed
arrays by hash bucket; frequent shingles go through plain joins. A list first links every member
to a few of it: the smallest, the most central (it has least of its own, as the origin of a group
of near copies does), and in long lists some picked by hash. Only members of different components
are then compared with each other, a block of a list with a block in a task, so groups of copies
never become all their pairs, and no link between components is missed. Sets that share a passage
meet in a list per shingle of it; the pair is handed on by one list, not by all of them.
Candidates are pruned by an upper bound of their overlap, which counts of hashes per slot of the
hash space give (about n / 4 bytes for n shingles, from the first pass), and the few that pass are
verified by the exact Jaccard of their sets.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.durable import lookup, materialize
from freshet.llm.common import batches_of, expand, give_back, mix, release, runs, unused, words
from freshet.llm.components import components

WIDTH = 5
PERCENT = 75
# Counters of the sketch of shingle frequencies, cut into chunks, and shingles per bucket of lists.
SKETCH, CHUNKS = 1 << 22, 16
BUCKET = 500_000
# Distinct-set shingles that a task holds before it hands them on, and before it counts them.
HELD, COUNTED = 500_000, 1 << 17
# Rows of a batch between executors and their Python workers.
BATCH = 1000
# Bits of the filter that finds the documents whose sets are needed.
NEEDED_BITS = 1 << 23
LARGEST_SMALL = 48
# Stars of a list: around its smallest member, and around so many more members picked by hash if
# it is long. Stars of frequent shingles take a set's first LEADS such lists; what stars leave
# apart is compared through all lists.
STARS, LONG_LIST, LEADS = 4, 8, 3
# Members of a list that are compared in one task with as many others, the lists of a set that show
# whether a pair is handed on elsewhere, and pairs that are looked at together.
BLOCK, FIRSTS, PAIRS = 2048, 16, 1 << 16


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Ascending distinct 64-bit hashes of a text's shingles; the whole sequence if it is shorter."""
    own = words(text)
    n, k = len(own), min(len(own), width)
    if not n:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, own), np.uint64, n)
    keys = hashes[: n - k + 1]
    for j in range(1, k):
        keys = mix(keys * np.uint64(0xD6E8FEB86659FD93) + hashes[j : n - k + 1 + j])
    return np.unique(mix(keys + np.uint64(k)))


def set_id(keys: np.ndarray) -> int:
    """A 64-bit hash of a set, as a signed long."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(keys.tobytes())).view(np.int64))


def required(n: np.ndarray | int, percent: int = PERCENT):
    """Shingles that a set of n shares with any set it links with."""
    return -(-(n * percent) // 100)


def heavy_bits(counts: np.ndarray) -> np.ndarray:
    """Which counters stand for frequent shingles: far above what chance puts into a counter."""
    mean = float(counts.mean()) if len(counts) else 0.0
    return counts > mean + 8 * np.sqrt(mean) + 16


def list_length(counts: np.ndarray) -> float:
    """Mean length of a rare shingle's list: what the counters' variance exceeds chance by."""
    mean = float(counts.mean()) if len(counts) else 0.0
    return 1 + max(float(counts.var(dtype=np.float32)) - mean, 0.0) / mean if mean else 1.0


def tally(counters: np.ndarray, sets: list[np.ndarray]) -> None:
    """Counts the sets' shingles in place; a second array of counters would be many times as large as the sets."""
    places = (np.concatenate(sets) >> np.uint64(20)).astype(np.int64) & (SKETCH - 1)
    np.add.at(counters, places, np.uint32(1))


def boundary(sizes: dict[int, int], list_length: float, percent: int = PERCENT) -> int:
    """The smallest set size from which enumerating 2-subsets costs more than scanning lists.

    A set of size n enumerates C(n - required + 2, 2) subsets or scans n - required + 1 lists.
    """
    best, cheapest = 3, None
    for border in range(3, LARGEST_SMALL + 1):
        cost = 0.0
        for n, count in sizes.items():
            spare = n - required(n, percent)
            if n < border:
                cost += count * (spare + 2) * (spare + 1) / 2
            if n >= required(border, percent):
                cost += count * (spare + 1) * list_length
        if cheapest is None or cost < cheapest:
            best, cheapest = border, cost
    return best


def _doc_rows(docs: DataFrame, doc_id: str, text: str, width: int) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, n, node, slots) per row, and the sketch's counters, in one pass over the texts."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counters = np.zeros(SKETCH, np.uint32)
        for batch in batches:
            ns, nodes, slots, held, seen, size = [], [], [], [], set(), 0
            for value in batch["text"]:
                keys = shingles(value, width)
                node = set_id(keys) if len(keys) else None
                ns.append(len(keys))
                nodes.append(node)
                slots.append(slot_counts(keys) if len(keys) else None)
                if len(keys) and node not in seen:
                    seen.add(node)
                    held.append(keys)
                    size += len(keys)
                if size > COUNTED:
                    tally(counters, held)
                    held, size = [], 0
            if held:
                tally(counters, held)
            yield pd.DataFrame({
                "doc_id": batch["doc_id"], "n": ns, "node": pd.array(nodes, dtype="Int64"), "chunk": -1, "counts": slots,
            })
        if counters.any():
            parts = np.split(counters, CHUNKS)
            yield pd.DataFrame({
                "doc_id": pd.array([None] * CHUNKS, dtype="Int64"), "n": 0, "node": pd.array([None] * CHUNKS, dtype="Int64"),
                "chunk": range(CHUNKS), "counts": [zlib.compress(p.tobytes(), 1) for p in parts],
            })
        release()

    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = materialize(chosen.mapInPandas(work, "doc_id long, n long, node long, chunk int, counts binary"))

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(SKETCH // CHUNKS, np.uint32)
        for blob in frame["counts"]:
            total += np.frombuffer(zlib.decompress(blob), np.uint32)
        return pd.DataFrame({"chunk": [frame["chunk"].iloc[0]], "counts": [total.tobytes()]})

    counts = np.zeros(SKETCH, np.uint32)
    size = SKETCH // CHUNKS
    added = rows.where("chunk >= 0").select("chunk", "counts").groupBy("chunk").applyInPandas(add, "chunk int, counts binary")
    for row in added.toLocalIterator():
        counts[row["chunk"] * size : (row["chunk"] + 1) * size] = np.frombuffer(row["counts"], np.uint32)
    return rows.where("chunk < 0").select("doc_id", "n", "node", F.col("counts").alias("slots")), counts


def signatures(keys: np.ndarray, heavy: np.ndarray, border: int, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of a set with its size: hashes, places in the order, and whether frequent.

    Sets of one or two shingles link with equal sets only, which are collapsed before.
    """
    n = len(keys)
    empty = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, bool)
    if n < 3:
        return empty
    frequent = heavy[(keys >> np.uint64(20)).astype(np.int64) & (SKETCH - 1)]
    order = np.argsort(frequent, kind="stable")
    need = int(required(n, percent))
    parts = []
    if n < border:
        prefix, often = keys[order[: n - need + 2]], frequent[order[: n - need + 2]]
        a, b = np.triu_indices(len(prefix), 1)
        parts.append((mix(prefix[a] * np.uint64(0x9FB21C651E98DF25) + prefix[b]), np.zeros(len(a), np.int64), often[a] & often[b]))
    if n >= required(border, percent):
        prefix = order[: n - need + 1]
        parts.append((keys[prefix], np.arange(len(prefix)), frequent[prefix]))
    return tuple(np.concatenate(c) for c in zip(*parts)) if parts else empty


def _postings(docs: DataFrame, doc_id: str, text: str, width: int, percent: int, heavy: np.ndarray, border: int, buckets: int) -> DataFrame:
    """Packed lists of rare signatures by bucket, and single rows of frequent ones (bucket -1)."""
    packed_heavy = np.packbits(heavy)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        often = np.unpackbits(packed_heavy).astype(bool)
        held: list[tuple[np.ndarray, np.ndarray, int, int]] = []
        size, seen = 0, set()

        def flush() -> pd.DataFrame:
            sig = np.concatenate([h[0] for h in held])
            counts = np.array([len(h[0]) for h in held])
            owner = np.repeat(np.arange(len(held), dtype=np.uint32), counts)
            nodes = np.array([h[2] for h in held], np.int64)
            sizes = np.array([h[3] for h in held], np.uint32)
            bucket = (sig >> np.uint64(44)).astype(np.int64) % buckets
            by = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[by], np.arange(buckets + 1))
            rows = []
            for p in np.flatnonzero(np.diff(cuts)):
                chosen = by[cuts[p] : cuts[p + 1]]
                own, back = np.unique(owner[chosen], return_inverse=True)
                rows.append((int(p), sig[chosen].tobytes(), back.astype(np.uint32).tobytes(), nodes[own].tobytes(), sizes[own].tobytes(), None, None, None, None, None))
            return pd.DataFrame(rows, columns=columns)

        for batch in batches:
            rows = []
            for value in batch["text"]:
                keys = shingles(value, width)
                if len(keys) < 3 or (node := set_id(keys)) in seen:
                    continue
                seen.add(node)
                sig, place, frequent = signatures(keys, often, border, percent)
                if frequent.any():
                    often_here = zip(sig[frequent].view(np.int64).tolist(), place[frequent].tolist())
                    rows += [(-1, None, None, None, None, s, node, len(keys), p, i < LEADS) for i, (s, p) in enumerate(often_here)]
                rare = ~frequent
                if rare.any():
                    held.append((sig[rare], None, node, len(keys)))
                    size += int(rare.sum())
            if rows:
                yield pd.DataFrame(rows, columns=columns)
            if size > HELD:
                yield flush()
                held.clear()
                seen.clear()
                size = 0
        if held:
            yield flush()
        held.clear()
        release()

    columns = ["bucket", "sigs", "owners", "nodes", "sizes", "sig", "node", "n", "place", "lead"]
    chosen = docs.select(F.col(text).cast("string").alias("text"))
    return chosen.mapInPandas(
        work, "bucket int, sigs binary, owners binary, nodes binary, sizes binary, sig long, node long, n long, place long, lead boolean"
    )


def _bucket_lists(frame: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Of a bucket's lists: links of each member to the smallest one, and members of lists of 3 or more.

    Lists with the same members are handed on once. Rows of frequent shingles pass unchanged.
    """
    if frame["bucket"].iloc[0] < 0:
        return pd.DataFrame({
            "kind": 2, "a": frame["sig"].astype("int64"), "b": frame["node"].astype("int64"),
            "n": frame["n"].astype("int64"), "place": frame["place"].astype("int64"), "lead": frame["lead"].astype(bool),
        })
    sigs, nodes, sizes = [], [], []
    for s, o, own, n in zip(frame["sigs"], frame["owners"], frame["nodes"], frame["sizes"]):
        owner = np.frombuffer(o, np.uint32)
        sigs.append(np.frombuffer(s, np.uint64))
        nodes.append(np.frombuffer(own, np.int64)[owner])
        sizes.append(np.frombuffer(n, np.uint32)[owner])
    sig, node, n = np.concatenate(sigs), np.concatenate(nodes), np.concatenate(sizes).astype(np.int64)
    known, back, all_sigs = np.unique(node, return_inverse=True, return_counts=True)
    order = np.argsort(sig, kind="stable")
    repeated = sig[order][1:] == sig[order][:-1]
    order = order[np.append(repeated, False) | np.append(False, repeated)]  # lists of one are done
    order = order[np.lexsort((node[order], n[order], sig[order]))]
    sig, node, n = sig[order], node[order], n[order]
    fresh = np.append(True, (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])) if len(sig) else np.empty(0, bool)
    sig, node, n, back = sig[fresh], node[fresh], n[fresh], back[order][fresh]
    # Share of a node's signatures here that no other node has.
    alone = 1 - np.bincount(back, minlength=len(known)) / np.maximum(all_sigs, 1)
    out = {"kind": [], "a": [], "b": [], "n": []}
    if len(sig):
        first = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
        lengths = np.diff(np.append(first, len(sig)))
        first, lengths = first[lengths > 1], lengths[lengths > 1]
        members = expand(first, lengths)
        begins = np.cumsum(lengths) - lengths
        pairs = []
        of_list = np.repeat(np.arange(len(first)), lengths)
        for star in range(STARS + 2):
            pivot = first
            if star:
                by = mix(node[members].view(np.uint64) + np.uint64(star)) if star > 1 else alone[back[members]]
                pivot = members[np.lexsort((by, of_list))[begins]]
            pivot = np.repeat(pivot, lengths)
            fits = (members != pivot) & (100 * np.minimum(n[pivot], n[members]) >= percent * np.maximum(n[pivot], n[members]))
            if star:
                fits &= np.repeat(lengths >= (LONG_LIST if star > 1 else 3), lengths)
            pairs.append(np.stack([node[pivot[fits]], node[members[fits]]], 1))
        pairs = np.sort(np.concatenate(pairs), axis=1)
        pairs = np.unique(pairs, axis=0) if len(pairs) else pairs
        mixed = mix(node[members].view(np.uint64))
        list_id = np.add.reduceat(mixed, begins) if len(lengths) else np.empty(0, np.uint64)
        long = lengths > 2
        _, once = np.unique(list_id[long], return_index=True)
        first, lengths, list_id = first[long][once], lengths[long][once], list_id[long][once]
        members = expand(first, lengths)
        out = {
            "kind": np.concatenate([np.zeros(len(pairs), np.int32), np.ones(len(members), np.int32)]),
            "a": np.concatenate([pairs[:, 0], np.repeat(list_id, lengths).view(np.int64)]),
            "b": np.concatenate([pairs[:, 1], node[members]]),
            "n": np.concatenate([np.zeros(len(pairs), np.int64), n[members]]),
        }
    return pd.DataFrame(out).assign(place=0, lead=False)


def _bitmap(ids: DataFrame) -> np.ndarray:
    """NEEDED_BITS bits, as longs, of the hashed `doc_id`s."""
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(NEEDED_BITS))
    bits = ids.select(slot.alias("s")).groupBy(F.shiftright("s", 6).alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(s & 63 AS INT))")).alias("bits")
    )
    table = np.zeros(NEEDED_BITS // 64, np.int64)
    for row in bits.toLocalIterator():  # at most NEEDED_BITS / 64 rows
        table[row["w"]] = row["bits"]
    return table


def _made(docs: DataFrame, wanted: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    """(node, n, keys): the sets of the documents with the wanted `doc_id`s, made anew.

    A bitmap of fixed size keeps most other texts from being looked at; what it lets through
    besides, and what repeats, is for the join to drop.
    """
    bits = _bitmap(wanted)

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = set()
        for batch in batches:
            slots = batch["slot"].to_numpy(np.int64)
            sets = []
            for t in batch["text"][((bits[slots >> 6] >> (slots & 63)) & 1).astype(bool)]:
                keys = shingles(t, width)
                if len(keys) and (node := set_id(keys)) not in seen:
                    seen.add(node)
                    sets.append((node, len(keys), keys.tobytes()))
            if len(seen) > 100_000:
                seen.clear()
            yield pd.DataFrame(sets, columns=["node", "n", "keys"])
        release()

    slot = F.pmod(F.xxhash64("doc_id"), F.lit(NEEDED_BITS))
    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    chosen = chosen.where("doc_id IS NOT NULL AND text IS NOT NULL").withColumn("slot", slot)
    return materialize(chosen.mapInPandas(make, "node long, n long, keys binary"))


def slot_counts(keys: np.ndarray) -> bytes:
    """How many hashes lie in each of 2^k equal parts of the hash space, about four a part.

    A byte each; a part with 255 or more counts as any number.
    """
    bits = max((len(keys) // 4).bit_length(), 1)
    counts = np.bincount((keys >> np.uint64(64 - bits)).astype(np.intp), minlength=1 << bits)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def possible(n: int, m: int, x: np.ndarray, y: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether sets of n and m with these slot counts can overlap enough: no part shares more than the less of both."""
    x, y = ((v.astype(np.int64) + (v == 255) * (1 << 40)) for v in (x, y))
    while len(x) > len(y):
        x = x[::2] + x[1::2]
    while len(y) > len(x):
        y = y[::2] + y[1::2]
    both = min(int(np.minimum(x, y).sum()), n, m)
    return (100 + percent) * both >= percent * (n + m)


def _passed(pairs: DataFrame, sets: DataFrame, kind: type, test) -> DataFrame:
    """The pairs (a, b) for which `test` of both sizes and arrays holds; `sets` has node, n, keys.

    One end's array travels with each pair to the other; a hash of the pair says which, so that a
    node with many pairs does not get all of theirs.
    """

    @F.pandas_udf("boolean")
    def passes(n: pd.Series, m: pd.Series, left: pd.Series, right: pd.Series) -> pd.Series:
        out = [test(*row) for row in zip(n, m, (np.frombuffer(x, kind) for x in left), (np.frombuffer(y, kind) for y in right))]
        return pd.Series(out, dtype=bool)

    turned = F.xxhash64("a", "b") % 2 == 0
    routed = pairs.select(
        F.when(turned, F.col("a")).otherwise(F.col("b")).alias("from"), F.when(turned, F.col("b")).otherwise(F.col("a")).alias("to")
    )
    left = sets.select(F.col("node").alias("from"), F.col("n").alias("nl"), F.col("keys").alias("x"))
    right = sets.select(F.col("node").alias("to"), F.col("n").alias("nr"), F.col("keys").alias("y"))
    met = routed.join(left, "from").join(right, "to").where(passes("nl", "nr", "x", "y"))
    return materialize(met.select(F.least("from", "to").alias("a"), F.greatest("from", "to").alias("b")).distinct())


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    """How many of y's values are in x; both ascend."""
    place = np.minimum(np.searchsorted(x, y), len(x) - 1)
    return int((x[place] == y).sum())


def enough(n: int, m: int, x: np.ndarray, y: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two whole sets have Jaccard percent / 100 or more."""
    both = overlap(x, y)
    return 100 * both >= percent * (n + m - both)


def links(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, node) per row of `docs`, and verified links (a, b) between different nodes.

    The links span every component of the full link graph: each two sets with Jaccard
    percent / 100 or more are connected by them.
    """
    rows, counts = _doc_rows(docs, doc_id, text, width)
    heavy = heavy_bits(counts)
    length = list_length(counts[~heavy])
    del counts
    first = [F.first(name).alias(alias) for name, alias in (("n", "n"), ("slots", "keys"))]
    known = materialize(rows.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id"), *first))
    rows = rows.drop("slots")
    sizes = {r["n"]: r["count"] for r in known.where(F.col("n") < 2 * LARGEST_SMALL).groupBy("n").count().collect()}
    border = boundary(sizes, length, percent)
    total = known.agg(F.sum("n")).first()[0] or 0
    buckets = max(4, ceil(total * (100 - percent + 2) / 100 / BUCKET))
    postings = _postings(docs, doc_id, text, width, percent, heavy, border, buckets)
    # Rows of frequent shingles only pass through, in groups that no key can fill.
    spread = F.when(F.col("bucket") < 0, F.pmod(F.xxhash64("sig", "node"), F.lit(16 * buckets))).otherwise(F.lit(0))
    lists = materialize(
        postings.withColumn("spread", spread).groupBy("bucket", "spread")
        .applyInPandas(lambda f: _bucket_lists(f, percent), "kind int, a long, b long, n long, place long, lead boolean")
    )
    frequent = lists.where("kind = 2").select(F.col("a").alias("sig"), F.col("b").alias("node"), "n", "place", "lead").distinct()
    frequent = materialize(frequent)
    picked = [F.min_by(F.struct("n", "node"), F.xxhash64("node", F.lit(i))) for i in range(1, STARS + 1)]
    # Rare shingles come first: where a frequent one comes early, little else is in the set.
    centre = F.min_by(F.struct("n", "node"), F.struct("place", "node"))
    pivots = F.array(F.min(F.struct("n", "node")), centre, *picked)
    pivots = materialize(frequent.groupBy("sig").agg(pivots.alias("pivots"), F.count("*").alias("w")).where("w > 1"))
    stars = (
        lookup(frequent.where("lead").drop("lead", "place"), pivots, ["sig"], weight="w")
        .select("node", "n", F.explode("pivots").alias("p"))
        .where((F.col("node") != F.col("p.node")) & (100 * F.least("n", "p.n") >= percent * F.greatest("n", "p.n")))
        .select(F.least("node", "p.node").alias("a"), F.greatest("node", "p.node").alias("b"))
    )
    candidates = materialize(lists.where("kind = 0").select("a", "b").unionAll(stars).distinct())
    members = lists.where("kind = 1").select(F.col("a").alias("list"), F.col("b").alias("node"), "n", F.lit(0).cast("long").alias("place"))
    members = members.distinct().unionAll(frequent.drop("lead").withColumnRenamed("sig", "list"))
    named = known.select("node", "doc_id")

    def verified(pairs: DataFrame) -> DataFrame:
        """Pairs that pass by their slot counts, then by their whole sets."""
        left = _passed(pairs, known.select("node", "n", "keys"), np.uint8, lambda *row: possible(*row, percent))
        ids = left.select(F.col("a").alias("node")).unionAll(left.select(F.col("b").alias("node"))).distinct()
        sets = _made(docs, named.join(ids, "node"), doc_id, text, width)
        return _passed(left, sets, np.uint64, lambda *row: enough(*row, percent))

    give_back(docs.sparkSession)
    first = verified(candidates)
    give_back(docs.sparkSession)
    # Members of one list that are not connected yet are compared with each other.
    joined = materialize(components(first, "a", "b"))
    own = members.join(joined, "node", "left").select("list", "node", "n", "place", F.coalesce("component", "node").alias("c"))
    give_back(docs.sparkSession)
    crossed = materialize(_crossed(materialize(own), percent))
    give_back(docs.sparkSession)
    return rows, first.unionAll(verified(crossed.join(candidates, ["a", "b"], "left_anti")))


def _crossed(own: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members (list, node, n, place, c) of one list with different c that may link.

    A list's largest c is not compared with itself: blocks of the others meet each other and it.
    Blocks are of bounded size, by hash of the node.
    """
    sizes = own.groupBy("list", "c").count()
    sizes = sizes.groupBy("list").agg(F.max_by("c", F.struct("count", "c")).alias("main"), F.max("count").alias("most"), F.sum("count").alias("all"))
    sizes = materialize(sizes.where("most < all"))
    rest = F.ceil((F.col("all") - F.col("most")) / BLOCK).cast("int")
    main = F.ceil(F.col("most") / BLOCK).cast("int")
    own = materialize(lookup(own, sizes, ["list"], weight=None).where("all IS NOT NULL").withColumn("is_main", F.col("c") == F.col("main")))
    # A pair is handed on by the least of its lists, as far as the first lists of both ends show it.
    # Only lists where places exclude nothing count: there a pair fits if it fits in any list.
    firsts = own.where("place = 0").groupBy("node", "n", "c").agg(F.slice(F.array_sort(F.collect_set("list")), 1, FIRSTS).alias("firsts"))
    own = own.join(firsts, ["node", "n", "c"], "left")
    # Others are blocks 0 .. rest - 1, those of the largest c follow.
    number = lambda blocks: F.pmod(F.xxhash64("node"), blocks)
    block = F.when(F.col("is_main"), rest + number(main)).otherwise(number(rest)).cast("int")
    own = own.withColumn("block", block)
    partner = F.when(F.col("is_main"), F.sequence(F.lit(0), rest - 1)).otherwise(F.sequence(F.lit(0), rest + main - 1))
    met = own.withColumn("partner", F.explode(partner)).select(
        "list", F.least("block", "partner").alias("i"), F.greatest("block", "partner").alias("j"), "block", "node", "n", "place", "c", "firsts"
    )

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in runs(batches, ["list", "i", "j"], 20_000):
            key = frame[["list", "i", "j"]].to_numpy()
            cuts = [*np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(1))).tolist(), len(key)]
            columns = [frame[c].to_numpy(np.int64) for c in ("node", "n", "place", "c", "block")]
            firsts = _padded(frame["firsts"])
            blocks = (
                (x + low, y + low) for low, high in zip(cuts, cuts[1:])
                for x, y in _block_pairs(*[v[low:high] for v in columns[1:]], bool(key[low, 1] == key[low, 2]), percent)
            )
            for a, b in _batched(blocks):
                here = _least_shared(key[a, 0], firsts[a], firsts[b])
                ends = np.sort(np.stack([columns[0][a[here]], columns[0][b[here]]], 1), axis=1)
                pairs = np.unique(ends, axis=0)
                yield pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    dealt = met.repartition("list", "i", "j").sortWithinPartitions("list", "i", "j")
    return dealt.mapInPandas(compare, "a long, b long").distinct()


def _padded(lists: pd.Series) -> np.ndarray:
    """Rows of FIRSTS list ids, filled up with the largest long, which is less than no list."""
    out = np.full((len(lists), FIRSTS), np.iinfo(np.int64).max)
    lengths = np.array([0 if own is None else len(own) for own in lists])
    if lengths.any():
        out[np.arange(FIRSTS) < lengths[:, None]] = np.concatenate([own for own in lists if own is not None])
    return out


def _least_shared(lists: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether no list before this one is among the first lists of both ends."""
    before = np.zeros(len(lists), bool)
    for k in range(left.shape[1]):
        own = left[:, k]
        before |= (own < lists) & (right == own[:, None]).any(1)
    return ~before


def _block_pairs(n, place, c, block, same: bool, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Both ends' places of the pairs of one or of two blocks that differ in c and may link by sizes and places.

    The pairs of one member at a time: those of two whole blocks are millions.
    """
    left = np.arange(len(n)) if same else np.flatnonzero(block == block.min())
    right = left if same else np.flatnonzero(block != block.min())
    for x in left.tolist():
        y = right[right > x] if same else right
        room = np.minimum(n[x] - place[x], n[y] - place[y])  # what a first common shingle at these places leaves to share
        fits = (c[y] != c[x]) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y]))
        y = y[fits & ((100 + percent) * room >= percent * (n[x] + n[y]))]
        if len(y):
            yield np.full(len(y), x), y


def _batched(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same pairs in arrays of about PAIRS, so that a task holds no more of them."""
    held, size = [], 0
    for x, y in pairs:
        held.append((x, y))
        size += len(x)
        if size >= PAIRS:
            yield tuple(np.concatenate(v) for v in zip(*held))
            held, size = [], 0
    if held:
        yield tuple(np.concatenate(v) for v in zip(*held))


def _grouped(docs: DataFrame, doc_id: str, text: str, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, node) per row, and (node, least, w, c) per node: its smallest id, rows and group."""
    with batches_of(docs.sparkSession, BATCH):
        rows, pairs = links(docs, doc_id, text, width, percent)
    give_back(docs.sparkSession)
    nodes = rows.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("w"))
    joined = nodes.join(components(pairs, "a", "b"), "node", "left").withColumn("c", F.coalesce("component", "node"))
    return rows, materialize(joined.select("node", "least", "w", "c"))


def near_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per row of `docs`.

    Words are runs of anything but \\x20 and \\x09-\\x0D, A-Z in lower case; a set holds the
    distinct `width`-word shingles, or the whole sequence where there are fewer words. Texts that
    are null or without words have no shingles and are linked with nothing. `component_id` is the
    smallest id reachable by links, a row's own included. Ids may repeat; a row without an id
    belongs to the rows of the same set, and is linked with nothing if all of those lack one.
    """
    rows, joined = _grouped(docs, doc_id, text, width, percent)
    smallest = joined.groupBy("c").agg(F.min("least").alias("component_id"))
    named = materialize(joined.join(smallest, "c").select("node", "w", "component_id"))
    return lookup(rows, named, ["node"], weight="w").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )


def representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row of each group of near copies, in the columns that came in.

    It is the row of the smallest id; among rows that repeat that id, and among rows without an id
    where a group has no other, one with the smallest set hash. Rows without words are no copies of
    anything and all stay.
    """
    rows, joined = _grouped(docs, doc_id, text, width, percent)
    order = F.struct(F.col("least").isNull(), "least", "node")
    chosen = materialize(joined.groupBy("c").agg(F.min_by("node", order).alias("node"), F.min("least").alias("least")))
    own, node, only = (unused(docs, name) for name in ("_id", "_node", "_only"))
    # Ids of one row are decided by the id alone; texts of all other rows are looked at again.
    several = materialize(rows.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1"))
    keep = chosen.where("least IS NOT NULL").join(several, F.col("least") == F.col("doc_id"), "left_anti")
    wordless = rows.where("node IS NULL AND doc_id IS NOT NULL").join(several, "doc_id", "left_anti")
    ids = keep.select(F.col("least").alias(own)).unionAll(wordless.select(F.col("doc_id").alias(own)))
    cast = docs.withColumn(only, F.col(doc_id).cast("long"))
    plain = cast.join(ids.distinct(), F.col(only) == F.col(own), "left_semi")

    @F.pandas_udf("long")
    def set_hash(texts: pd.Series) -> pd.Series:
        sets = (shingles(t, width) for t in texts)
        return pd.Series([set_id(k) if len(k) else None for k in sets], dtype="Int64")

    odd = cast.where(F.col(only).isNull())
    if not several.isEmpty():
        odd = odd.unionAll(cast.join(several.select(F.col("doc_id").alias(own)), F.col(only) == F.col(own), "left_semi"))
    odd = odd.withColumn(node, set_hash(F.col(text).cast("string")))
    picked = chosen.select(F.col("node").alias(own), F.col("least").alias(unused(docs, "_least")))
    same = (F.col(node) == F.col(own)) & F.col(only).eqNullSafe(F.col(unused(docs, "_least")))
    named = odd.join(picked, same, "left_semi").dropDuplicates([node])
    return plain.drop(only).unionAll(named.drop(only, node)).unionAll(odd.where(F.col(node).isNull()).drop(only, node))
