"""Language model whose n-gram counts live in a log-frequency Bloom filter.

N-grams of hashed tokens are counted in two steps: a task counts its own documents, and buckets
of the hash space add up. A count c is kept as the level 1 + floor(log_base c): the filter holds
the n-gram's keys for levels 1 to that, so a count comes back as the last level found by repeated
membership probes. Buckets own parts of one bit table; a part has as many bits as its distinct
n-grams of all orders need, so the table grows with the corpus and nothing is left out. Up to a
size bound the table is broadcast. Beyond it only the commonest n-grams are, with their levels; all
others are sent to the owner of their part, once per block of rows, and their levels come back.
Probabilities interpolate the n-gram orders, the last being add-one smoothed single tokens.

Exact counts of single tokens are kept too. The commonest, a bounded number, are broadcast; all
other occurrences meet their counts in hash buckets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.durable import materialize
from freshet.llm.common import mix, words

ORDER = 2
# Base of the count levels, bits probed per key, bits per key of a level, and the bytes that may be broadcast.
LEVEL_BASE = 1.5
PROBES = 3
BITS_PER_KEY = 6
MAX_BYTES = 1 << 26
LEVELS = 64
# Bytes set aside for each n-gram that is broadcast with its level, and the mark of one that is not.
COMMON_BYTES = 16
OPEN = 255
# Share of the longest n-gram in the interpolation.
WEIGHT = 0.6
# Tokens whose exact counts are broadcast, at most.
HEAD = 1 << 18
# N-grams that a task holds before it hands its counts on, characters per bucket, rows scored together.
HELD = 3_000_000
BUCKET_CHARACTERS = 1 << 22
BLOCK_ROWS = 2000
# Fixed hashes of the end of a text and of its beginning.
END, START = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def tokens(text: str | None) -> np.ndarray:
    """64-bit hashes of a text's words and then the end."""
    own = words(text)
    return np.append(np.fromiter(map(xxhash.xxh3_64_intdigest, own), np.uint64, len(own)), END)


def ngrams(hashes: np.ndarray, begins: np.ndarray, order: int) -> np.ndarray:
    """Key of the n-gram that ends at each token; START stands before a text's first token.

    `begins` marks the first token of each text.
    """
    keys = hashes.copy()
    shifted = hashes
    first = begins
    for k in range(1, order):
        shifted = np.append(START, shifted[:-1])
        shifted[first] = START
        first = first | np.append(True, first[:-1])
        keys = mix(keys * np.uint64(0xD6E8FEB86659FD93) + shifted + np.uint64(k))
    return keys


def concatenated(texts: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of several texts and the number of each."""
    parts = [tokens(t) for t in texts]
    return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)


def begin_marks(sizes: np.ndarray) -> np.ndarray:
    marks = np.zeros(int(sizes.sum()), bool)
    marks[np.cumsum(sizes) - sizes] = True
    return marks


def level(counts: np.ndarray) -> np.ndarray:
    return np.minimum(1 + np.floor(np.log(counts) / np.log(LEVEL_BASE) + 1e-9), LEVELS).astype(np.int64)


# What a level stands for: the middle (on the log scale) of its counts; 1 is exact.
LEVEL_COUNTS = np.concatenate([[0.0, 1.0], np.maximum(LEVEL_BASE ** (np.arange(2, LEVELS + 1) - 0.5), 2.0)])


@dataclass(frozen=True)
class Filter:
    """One bit table cut into parts; a key's part comes from its top bits."""

    parts: int
    bits: int | np.ndarray  # of every part, or of each

    def part(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(40)).astype(np.int64) & (self.parts - 1)

    def places(self, keys: np.ndarray, levels: np.ndarray, probe: int) -> np.ndarray:
        part = self.part(keys)
        if np.ndim(self.bits):
            return (np.cumsum(self.bits) - self.bits)[part] + within(keys, levels, probe, self.bits[part])
        return part * self.bits + within(keys, levels, probe, self.bits)


def within(keys: np.ndarray, levels: np.ndarray, probe: int, bits: int | np.ndarray) -> np.ndarray:
    """The place of a key's level inside its part."""
    salted = mix(keys + levels.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25) + np.uint64(probe + 1))
    return ((salted >> np.uint64(32)).astype(np.int64) * bits) >> 32


def parts_of(characters: int) -> int:
    """Parts for a corpus of so many characters, a power of two."""
    return 1 << max(2, int(np.ceil(np.log2(max(characters / BUCKET_CHARACTERS, 1)))))


def bits_for(counts: np.ndarray) -> int:
    """Bits of a part that holds n-grams of these counts: BITS_PER_KEY for every level of each."""
    return max(64, -(-int(level(counts).sum()) * BITS_PER_KEY // 64) * 64)


def part_bits(own: Filter, keys: np.ndarray, counts: np.ndarray) -> tuple[bytes, int]:
    """The bits of one part, and the smallest count that it holds.

    Keys that would overfill the part are left to the shorter n-gram, smallest counts first; a part
    of `bits_for` its counts holds them all.
    """
    levels = level(counts)
    room = own.bits // 4
    least = 1
    while int(levels[levels >= least].sum()) > room and least < LEVELS:
        least += 1
    keep = levels >= least
    keys, levels = keys[keep], levels[keep]
    table = np.zeros(own.bits, bool)
    for wanted in range(1, int(levels.max(initial=0)) + 1):
        chosen = keys[levels >= wanted]
        for probe in range(PROBES):
            table[within(chosen, np.full(len(chosen), wanted), probe, own.bits)] = True
    return np.packbits(table, bitorder="little").tobytes(), least


@dataclass(frozen=True)
class Model:
    """A trained model. Only `bits` or `common`, `head` and three numbers are sent to tasks; all are bounded."""

    filter: Filter
    bits: np.ndarray | None  # none when they are too many to be broadcast
    order: int
    total: int
    distinct: int
    documents: int
    head: np.ndarray  # hashes of the commonest tokens, ascending
    head_counts: np.ndarray
    counts: DataFrame  # exact counts: part, hashes, counts
    parts: DataFrame | None = None  # the bits: part, bits
    common: np.ndarray | None = None  # without `bits`, the commonest n-grams, ascending
    common_levels: np.ndarray | None = None

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The last level of each key that the filter holds, found level by level."""
        out = np.zeros(len(keys), np.int64)
        open_rows = np.arange(len(keys))
        for wanted in range(1, LEVELS + 1):
            own = keys[open_rows]
            hit = np.ones(len(own), bool)
            for probe in range(PROBES):
                left = np.flatnonzero(hit)
                at = self.filter.places(own[left], np.full(len(left), wanted), probe)
                hit[left] = (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1
            open_rows = open_rows[hit]
            if not len(open_rows):
                break
            out[open_rows] = wanted
        return out

    def keys(self, hashes: np.ndarray, begins: np.ndarray) -> list[np.ndarray]:
        """Keys of the n-grams of each order that end at each token."""
        return [hashes, *(ngrams(hashes, begins, n) for n in range(2, self.order + 1))]

    def log_probabilities(self, hashes: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """log10 probability of each token after those before it; keys are probed once per distinct n-gram."""
        def found(keys: np.ndarray) -> np.ndarray:
            distinct, back = np.unique(keys, return_inverse=True)
            return self.levels(distinct)[back]

        return self.interpolated([found(k) for k in self.keys(hashes, begins)], begins)

    def interpolated(self, levels: list[np.ndarray], begins: np.ndarray) -> np.ndarray:
        """log10 probabilities from the levels of each order.

        An unseen history leaves the weight to the shorter n-gram; no quotient exceeds 1.
        """
        single, *longer = [LEVEL_COUNTS[own] for own in levels]
        probability = (single + 1) / (self.total + self.distinct + 1)
        history = np.append(float(self.documents), single[:-1])
        history[begins] = self.documents
        for joint in longer:
            seen = history > 0
            quotient = np.minimum(joint / np.maximum(history, 1), 1.0)
            probability = np.where(seen, WEIGHT * quotient + (1 - WEIGHT) * probability, probability)
            history = np.append(0.0, joint[:-1])
            history[begins] = self.documents
        return np.log10(np.minimum(probability, 1.0))

    def known_levels(self, keys: np.ndarray) -> np.ndarray:
        """Levels of the broadcast n-grams, OPEN for all others."""
        if not len(self.common):
            return np.full(len(keys), OPEN, np.uint8)
        place = np.minimum(np.searchsorted(self.common, keys), len(self.common) - 1)
        return np.where(self.common[place] == keys, self.common_levels[place], OPEN).astype(np.uint8)


def count_blobs(texts: DataFrame, own: Filter, order: int) -> DataFrame:
    """Counts of n-grams by (order, part), as packed arrays; each task adds up its own documents."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[list[np.ndarray]] = [[] for _ in range(order)]
        size = documents = 0

        def flush() -> pd.DataFrame:
            rows = []
            for n, parts in enumerate(held, 1):
                if not parts:
                    continue
                keys, counts = np.unique(np.concatenate(parts), return_counts=True)
                part = own.part(keys)
                by = np.argsort(part, kind="stable")
                cuts = np.searchsorted(part[by], np.arange(own.parts + 1))
                for p in np.flatnonzero(np.diff(cuts)):
                    chosen = by[cuts[p] : cuts[p + 1]]
                    rows.append((n, int(p), keys[chosen].tobytes(), counts[chosen].astype(np.uint32).tobytes(), 0))
                parts.clear()
            rows.append((0, 0, b"", b"", documents))
            return pd.DataFrame(rows, columns=["n", "part", "keys", "counts", "documents"])

        for batch in batches:
            for low in range(0, len(batch), 1000):
                hashes, sizes = concatenated(batch["text"].iloc[low : low + 1000])
                marks = begin_marks(sizes)
                for n in range(1, order + 1):
                    held[n - 1].append(ngrams(hashes, marks, n))
                size += len(hashes)
                documents += len(sizes)
                if size > HELD:
                    yield flush()
                    size = documents = 0
        if documents:
            yield flush()

    return texts.mapInPandas(work, "n int, part int, keys binary, counts binary, documents long")


def added(blobs: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their counts."""
    blobs = blobs or [(b"", b"")]
    keys = np.concatenate([np.frombuffer(k, np.uint64) for k, _ in blobs])
    counts = np.concatenate([np.frombuffer(c, np.uint32) for _, c in blobs]).astype(np.int64)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def fit(docs: DataFrame, text: str = "text", order: int = ORDER, max_bytes: int = MAX_BYTES, head: int = HEAD) -> Model:
    """Learn from all rows; null text is empty and counts as one end.

    `max_bytes` bounds what is broadcast of the n-grams, not what is learnt.
    """
    texts = docs.select(F.col(text).cast("string").alias("text"))
    characters = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    number = parts_of(characters)
    share = max_bytes // COMMON_BYTES // number

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        part = int(frame["part"].iloc[0])
        own = [added(list(zip(g["keys"], g["counts"]))) for g in (frame[frame["n"] == n] for n in range(1, order + 1))]
        singles, single_counts = own[0]
        keys, counts = (np.concatenate(x) for x in zip(*own))
        size = bits_for(counts)
        bits, _ = part_bits(Filter(1, size), keys, counts)
        common, levels = keys[:0], np.empty(0, np.uint8)
        if size * number > max_bytes * 4:  # the whole table may be too large to be broadcast
            chosen = np.argsort(-counts, kind="stable")[:share]
            common = np.sort(keys[chosen])
            table = Model(Filter(1, size), np.frombuffer(bits, np.uint8), order, 0, 0, 0, singles, single_counts, None)
            levels = table.levels(common).astype(np.uint8)
        sizes = np.bincount(level(single_counts), minlength=LEVELS + 1).tolist()
        return pd.DataFrame([(
            part, int(frame["documents"].sum()), int(single_counts.sum()), len(singles), size, bits, sizes,
            singles.tobytes(), single_counts.tobytes(), common.tobytes(), levels.tobytes(),
        )], columns=names)

    names = ["part", "documents", "total", "distinct", "size", "bits", "levels", "keys", "counts", "common", "common_levels"]
    parts = materialize(
        count_blobs(texts, Filter(number, 64), order).groupBy("part").applyInPandas(
            add, "part int, documents long, total long, distinct long, size long, bits binary, levels array<long>, "
            "keys binary, counts binary, common binary, common_levels binary"
        )
    )
    table_bits = np.full(number, 64, np.int64)
    documents = total = distinct = 0
    for row in parts.select("part", "documents", "total", "distinct", "size").collect():
        table_bits[row["part"]] = row["size"]
        documents, total, distinct = documents + row["documents"], total + row["total"], distinct + row["distinct"]
    own = Filter(number, table_bits)
    table = common = common_levels = None
    if table_bits.sum() <= max_bytes * 8:
        table = np.zeros(int(table_bits.sum()) // 8, np.uint8)
        starts = (np.cumsum(table_bits) - table_bits) // 8
        for row in parts.select("part", "bits").toLocalIterator():
            table[starts[row["part"]] :][: len(row["bits"])] = np.frombuffer(row["bits"], np.uint8)
    else:
        rows = parts.select("common", "common_levels").collect()
        common = np.concatenate([np.frombuffer(r["common"], np.uint64) for r in rows])
        common_levels = np.concatenate([np.frombuffer(r["common_levels"], np.uint8) for r in rows])
        del rows
        by = np.argsort(common)
        common, common_levels = common[by], common_levels[by]
    sizes = parts.select(F.posexplode("levels").alias("level", "n")).groupBy("level").agg(F.sum("n").alias("n")).collect()
    single = parts.select("part", "keys", "counts")
    least, taken = LEVELS + 1, 0
    for row in sorted(sizes, key=lambda r: -r["level"]):
        if taken + row["n"] > head:
            break
        least, taken = row["level"], taken + row["n"]

    def commonest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys = np.concatenate([np.frombuffer(k, np.uint64) for k in batch["keys"]])
            counts = np.concatenate([np.frombuffer(c, np.int64) for c in batch["counts"]])
            keep = level(counts) >= least
            yield pd.DataFrame({"keys": [keys[keep].tobytes()], "counts": [counts[keep].tobytes()]})

    top = single.mapInPandas(commonest, "keys binary, counts binary").collect()
    keys = np.concatenate([np.frombuffer(r["keys"], np.uint64) for r in top] or [np.empty(0, np.uint64)])
    counts = np.concatenate([np.frombuffer(r["counts"], np.int64) for r in top] or [np.empty(0, np.int64)])
    by = np.argsort(keys)
    return Model(
        own, table, order, total, distinct, documents, keys[by], counts[by], single, parts.select("part", "bits"),
        common, common_levels,
    )


BLOCK_COLUMNS = ["rows", "sizes", "levels", "back", "wanted"]


def held_by_block(lm: Model, hashes: np.ndarray, sizes: np.ndarray, rows: pd.Series) -> list[bytes]:
    """BLOCK_COLUMNS: row numbers, tokens per row, levels of all n-grams (OPEN: not known), where
    the level of each open one will stand, and the open n-grams, distinct and by part."""
    keys = np.concatenate(lm.keys(hashes, begin_marks(sizes)))
    levels = lm.known_levels(keys)
    wanted, back = np.unique(keys[levels == OPEN], return_inverse=True)
    by = np.argsort(lm.filter.part(wanted), kind="stable")
    place = np.empty(len(by), np.uint32)
    place[by] = np.arange(len(by), dtype=np.uint32)
    return [x.tobytes() for x in (rows.to_numpy(np.int64), sizes, levels, place[back], wanted[by])]


def routed_scores(blocks: DataFrame, model: Model) -> DataFrame:
    """Row and score of blocks of rows; the owners of the parts tell the levels that a block lacks."""
    own = Filter(model.filter.parts, 64)
    numbers = (model.order, model.total, model.distinct, model.documents)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block, wanted in zip(batch["block"], batch["wanted"]):
                keys = np.frombuffer(wanted, np.uint64)
                cuts = np.searchsorted(own.part(keys), np.arange(own.parts + 1))
                used = np.flatnonzero(np.diff(cuts))
                yield pd.DataFrame({
                    "block": np.full(len(used), block, np.int64), "part": used.astype(np.int32),
                    "place": cuts[used].astype(np.int64), "keys": [keys[cuts[p] : cuts[p + 1]].tobytes() for p in used],
                })

    def answer(asked: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        bits = np.frombuffer(table["bits"].iloc[0] if len(table) else bytes(8), np.uint8)
        part = Model(Filter(1, len(bits) * 8), bits, *numbers, None, None, None)
        levels = [part.levels(np.frombuffer(k, np.uint64)).astype(np.uint8).tobytes() for k in asked["keys"]]
        return asked[["block", "place"]].assign(levels=levels)

    def finish(block: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(block):
            return pd.DataFrame({"_row": np.empty(0, np.int64), "score": np.empty(0)})
        rows, sizes, levels, back = (np.frombuffer(block[n].iloc[0], k) for n, k in (
            ("rows", np.int64), ("sizes", np.int64), ("levels", np.uint8), ("back", np.uint32)
        ))
        told = np.frombuffer(b"".join(answers.sort_values("place")["levels"]), np.uint8)
        levels = levels.copy()
        levels[levels == OPEN] = told[back]
        lm = Model(own, None, *numbers, None, None, None)
        score = lm.interpolated(np.split(levels, model_order), begin_marks(sizes))
        return pd.DataFrame({"_row": rows, "score": np.add.reduceat(score, np.cumsum(sizes) - sizes)})

    model_order = model.order
    asked = blocks.select("block", "wanted").mapInPandas(deal, "block long, part int, place long, keys binary")
    answers = asked.groupBy("part").cogroup(model.parts.groupBy("part")).applyInPandas(
        answer, "block long, place long, levels binary"
    )
    return blocks.drop("wanted").groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(finish, "_row long, score double")


def scored(docs: DataFrame, model: Model, keep: dict[str, Column] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, `keep`'s columns, n_tokens, n_known, train_tokens, base_score and score.

    `base_score` is the exact add-one sum over single tokens, `score` the filter's log10
    probability. Rows are told apart by a number, so repeated rows and null ids are fine.
    Tokens outside the broadcast head meet their exact counts by hash bucket; a bucket holds
    rare tokens only, so it cannot be hot. Where the bit table is too large to be broadcast, a
    block of rows sends each n-gram whose level it lacks to the owner of the part once.
    """
    spark = docs.sparkSession
    keep = keep or {}
    kept = list(keep)
    own = model.filter
    routed = model.bits is None
    bulk = spark.sparkContext.broadcast((model.bits, model.head, model.head_counts, model.common, model.common_levels))
    bits_of = (own, model.order, model.total, model.distinct, model.documents)
    base = np.log10(model.total + model.distinct + 1)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits, head, head_counts, common, common_levels = bulk.value
        lm = Model(bits_of[0], bits, *bits_of[1:], head, head_counts, None, None, common, common_levels)
        for batch in batches:
            for low in range(0, len(batch), BLOCK_ROWS):
                rows = batch.iloc[low : low + BLOCK_ROWS]
                hashes, sizes = concatenated(rows["text"])
                begins = np.cumsum(sizes) - sizes
                if routed:
                    score = np.nan
                else:
                    score = np.add.reduceat(lm.log_probabilities(hashes, begin_marks(sizes)), begins)
                place = np.minimum(np.searchsorted(head, hashes), max(len(head) - 1, 0))
                known = head[place] == hashes if len(head) else np.zeros(len(hashes), bool)
                terms = np.where(known, np.log10(np.where(known, head_counts[place], 0) + 1.0), 0.0) if len(head) else np.zeros(len(hashes))
                tails = np.split(np.where(known, 0, 1), begins[1:])
                out = rows[["_row", "doc_id", *kept]].copy()
                out["n_tokens"] = sizes
                out["known"] = np.add.reduceat(known.astype(np.int64), begins)
                out["base"] = np.add.reduceat(terms, begins) - sizes * base
                out["score"] = score
                out["tail"] = [h[t == 1].tobytes() for h, t in zip(np.split(hashes, begins[1:]), tails)]
                if routed:  # the first row carries what the block knows and lacks
                    for name, value in zip(BLOCK_COLUMNS, held_by_block(lm, hashes, sizes, rows["_row"])):
                        out[name] = [value, *[None] * (len(out) - 1)]
                yield out

    columns = [F.monotonically_increasing_id().alias("_row"), F.col(doc_id).cast("long").alias("doc_id")]
    columns += [c.alias(n) for n, c in keep.items()]
    chosen = docs.select(*columns, F.col(text).cast("string").alias("text"))
    kinds = "".join(f", `{n}` {k}" for n, k in chosen.dtypes if n in keep)
    kinds += ", n_tokens long, known long, base double, score double, tail binary"
    kinds += "".join(f", {n} binary" for n in BLOCK_COLUMNS) if routed else ""
    first = materialize(chosen.mapInPandas(work, f"_row long, doc_id long{kinds}"))

    def by_part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hashes = [np.frombuffer(t, np.uint64) for t in batch["tail"]]
            rows = np.repeat(batch["_row"].to_numpy(np.int64), [len(h) for h in hashes])
            keys = np.concatenate(hashes) if len(hashes) else np.empty(0, np.uint64)
            part = own.part(keys)
            by = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[by], np.arange(own.parts + 1))
            used = np.flatnonzero(np.diff(cuts))
            yield pd.DataFrame({
                "part": used.astype(np.int32), "keys": [keys[by[cuts[p] : cuts[p + 1]]].tobytes() for p in used],
                "rows": [rows[by[cuts[p] : cuts[p + 1]]].tobytes() for p in used],
            })

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        keys = np.concatenate([np.frombuffer(k, np.uint64) for k in right["keys"]] or [np.empty(0, np.uint64)])
        counts = np.concatenate([np.frombuffer(c, np.int64) for c in right["counts"]] or [np.empty(0, np.int64)])
        out = []
        for tail, rows in zip(left["keys"], left["rows"]):
            hashes, numbers = np.frombuffer(tail, np.uint64), np.frombuffer(rows, np.int64)
            if not len(keys):
                continue
            place = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
            hit = keys[place] == hashes
            numbers, found = numbers[hit], counts[place[hit]]
            distinct, back = np.unique(numbers, return_inverse=True)
            out.append(pd.DataFrame({
                "_row": distinct, "more": np.bincount(back, minlength=len(distinct)),
                "extra": np.bincount(back, np.log10(found + 1.0), len(distinct)),
            }))
        empty = pd.DataFrame({"_row": np.empty(0, np.int64), "more": np.empty(0, np.int64), "extra": np.empty(0)})
        return pd.concat([empty, *out], ignore_index=True)

    tails = first.where(F.length("tail") > 0).select("_row", "tail").mapInPandas(by_part, "part int, keys binary, rows binary")
    more = (
        tails.groupBy("part").cogroup(model.counts.groupBy("part"))
        .applyInPandas(meet, "_row long, more long, extra double")
        .groupBy("_row").agg(F.sum("more").alias("more"), F.sum("extra").alias("extra"))
    )
    if routed:
        blocks = first.where(F.col("wanted").isNotNull()).select(F.col("_row").alias("block"), *BLOCK_COLUMNS)
        first = first.drop("score", *BLOCK_COLUMNS).join(routed_scores(blocks, model), "_row", "left")
    return first.drop("tail").join(more, "_row", "left").select(
        "doc_id", *keep, "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("extra", F.lit(0.0))).alias("base_score"), "score",
    )
