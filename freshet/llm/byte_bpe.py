"""Byte-level BPE without a regex engine: vectorised pre-tokenisation, cached pair merging.

Every code point gets a class (letter, number, space of three sorts, apostrophe that opens a
contraction, other, end of text). A class is a transition function on eight states, and
functions compose associatively: lanes of 64 code points are composed side by side, the lanes'
functions are combined by a doubling scan, and a last pass from the now known entry states says
where slices begin. Slices are looked up in a cache of merged pieces; misses are merged
together, one pair per piece and step, as array operations.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.llm.common import Numbers, expand, text_blocks
from freshet.llm.pair_merging import Pairs

# Classes of code points.
LETTER, NUMBER, OTHER, SPACE, JOINED, LONE, INNER, SHORT, LONG, END = range(10)
# States: what is open before the next code point.
FREE, IN_LETTERS, IN_NUMBERS, IN_OTHER, AFTER_SPACE, IN_SPACE, NEED_ONE, NEED_TWO = range(8)
LANE = 64
# Code points of a batch that are worked on together.
BLOCK = 1_000_000
# Pieces that a worker keeps; beyond that it starts anew.
CACHE = 400_000
# Longer pieces are merged with a heap, one by one.
LONG_PIECE = 64

# Code points with the Unicode property White_Space.
WHITE_SPACE = [
    0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, 0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005,
    0x2006, 0x2007, 0x2008, 0x2009, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
]


@lru_cache(maxsize=1)
def code_point_classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    category = unicodedata.category
    table = np.fromiter((kinds.get(category(chr(p))[0], OTHER) for p in range(0x110000)), np.uint8, 0x110000)
    table[WHITE_SPACE] = SPACE
    return table


@lru_cache(maxsize=1)
def transitions() -> tuple[np.ndarray, np.ndarray]:
    """For (class, state): the next state, and whether a slice begins at the code point."""
    after = np.zeros((10, 8), np.uint8)
    begins = np.ones((10, 8), bool)
    for kind, state in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHER)):
        after[kind] = state
        begins[kind, [state, AFTER_SPACE]] = False
    after[LETTER, NEED_ONE], after[LETTER, NEED_TWO] = FREE, NEED_ONE
    begins[LETTER, [NEED_ONE, NEED_TWO]] = False
    for kind, state in ((SHORT, NEED_ONE), (LONG, NEED_TWO)):
        after[kind] = state
        after[kind, [IN_OTHER, AFTER_SPACE]] = IN_OTHER
        begins[kind, [IN_OTHER, AFTER_SPACE]] = False
    after[JOINED] = AFTER_SPACE
    after[INNER] = IN_SPACE
    begins[INNER, IN_SPACE] = False
    return after, begins


def classify(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Classes of code points; `ends` are the places of the separators after each text.

    Looking one or two code points ahead settles what a space or an apostrophe is: the last
    space of a run before another character is JOINED to it (if it is U+0020) or LONE, all
    others are INNER; an apostrophe is SHORT or LONG when 's or 're may start there.
    """
    kinds = code_point_classes()[points]
    kinds[ends] = END
    following = np.append(kinds[1:], END)
    spaces = kinds == SPACE
    last = spaces & (following != SPACE) & (following != END)
    quotes = np.flatnonzero((points == 0x27) & (kinds == OTHER))
    kinds[spaces] = INNER
    kinds[last] = np.where(points[last] == 0x20, JOINED, LONE)
    if len(quotes):
        # The separator after each text keeps a look-ahead inside it.
        padded = np.append(points, [0, 0])
        one, two = padded[quotes + 1], padded[quotes + 2]
        kinds[quotes[np.isin(one, [ord(c) for c in "stmd"])]] = SHORT
        pairs = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e"))
        kinds[quotes[pairs | ((one == ord("l")) & (two == ord("l")))]] = LONG
    return kinds


def slice_starts(kinds: np.ndarray) -> np.ndarray:
    """Whether a slice begins at each place, by a scan over transition functions."""
    after, begins = (t.reshape(-1) for t in transitions())
    lanes = -(-len(kinds) // LANE)
    padded = np.full(lanes * LANE, END, np.uint8)
    padded[: len(kinds)] = kinds
    offsets = padded.reshape(lanes, LANE).T.astype(np.intp) * 8
    functions = np.tile(np.arange(8, dtype=np.uint8), (lanes, 1))
    for row in offsets:
        functions = after[row[:, None] + functions]
    step = 1
    while step < lanes:  # functions[i] becomes the composition of lanes 0..i
        functions[step:] = np.take_along_axis(functions[step:], functions[:-step], axis=1)
        step *= 2
    states = np.concatenate([[FREE], functions[:-1, FREE]]).astype(np.uint8)
    starts = np.empty((LANE, lanes), bool)
    for k, row in enumerate(offsets):
        place = row + states
        starts[k] = begins[place]
        states = after[place]
    return starts.T.reshape(-1)[: len(kinds)]


class Merger:
    """Pair merging by ranks, and the bytes of every id."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        size = max(self.ranks.values()) + 1
        self.size = size
        self.tokens = [b""] * size
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left * size + right] = rank
        self.pairs = Pairs(pairs, size)
        self.bytes = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.byte_lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.byte_starts = np.cumsum(self.byte_lengths) - self.byte_lengths
        self.reset()

    def reset(self) -> None:
        """An empty cache: piece -> number, and per number its slice of `flat`."""
        self.numbers = Numbers()
        self.flat = np.empty(0, np.int64)
        self.starts = np.empty(0, np.int64)
        self.lengths = np.empty(0, np.int64)

    def merge_long(self, piece: bytes) -> list[int]:
        """The same merges with a heap of pairs, for pieces of any length."""
        ids = [int(self.single[b]) for b in piece]
        left, right = list(range(-1, len(ids) - 1)), [*range(1, len(ids)), -1]
        heap: list[tuple[int, int, int, int]] = []

        def push(i: int) -> None:
            j = right[i]
            if j >= 0:
                rank = self.ranks.get(self.tokens[ids[i]] + self.tokens[ids[j]])
                if rank is not None:
                    heapq.heappush(heap, (rank, i, ids[i], ids[j]))

        for i in range(len(ids) - 1):
            push(i)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = right[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue  # one of the two was merged meanwhile
            ids[i], ids[j], right[i] = rank, -1, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            push(i)
            if left[i] >= 0:
                push(left[i])
        return [t for t in ids if t >= 0]

    def learn(self, pieces: list[str]) -> None:
        """Merge pieces that were just numbered and keep the result."""
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        long = [i for i, p in enumerate(raw) if len(p) > LONG_PIECE]
        short = [i for i, p in enumerate(raw) if len(p) <= LONG_PIECE]
        known = {i: [self.ranks[raw[i]]] for i in short if raw[i] in self.ranks}
        known |= {i: [self.ranks[raw[i]]] if raw[i] in self.ranks else self.merge_long(raw[i]) for i in long}
        rest = [i for i in short if i not in known]
        symbols = self.single[np.frombuffer(b"".join(raw[i] for i in rest), np.uint8)]
        ids, counts = self.pairs.merge(symbols, np.array([len(raw[i]) for i in rest], np.int64))
        extra = np.array([t for i in known for t in known[i]], np.int64)
        lengths = np.concatenate([counts, np.array([len(known[i]) for i in known], np.int64)])
        back = np.argsort(np.array([*rest, *known], np.int64))
        starts = len(self.flat) + np.cumsum(lengths) - lengths
        self.starts = np.concatenate([self.starts, starts[back]])
        self.lengths = np.concatenate([self.lengths, lengths[back]])
        self.flat = np.concatenate([self.flat, ids, extra])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of every text."""
        joined = "\n".join(texts) + "\n"
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        places = np.flatnonzero(slice_starts(classify(points, ends)))
        stops = np.append(places[1:], len(points))
        real = np.ones(len(points), bool)
        real[ends] = False
        real = real[places]
        places, stops = places[real], stops[real]
        pieces = [joined[a:b] for a, b in zip(places.tolist(), stops.tolist())]
        if len(self.numbers) > CACHE:
            self.reset()
        numbers = np.fromiter(map(self.numbers.__getitem__, pieces), np.int64, len(pieces))
        if len(self.numbers) > len(self.starts):
            self.learn(list(islice(self.numbers, len(self.starts), None)))
        lengths = self.lengths[numbers]
        ids = self.flat[expand(self.starts[numbers], lengths)]
        token_ends = np.concatenate([[0], np.cumsum(lengths)])
        cuts = token_ends[np.searchsorted(places, ends)]
        return np.split(ids, cuts[:-1])

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids, gathered through the offsets of every id's bytes."""
        return self.bytes[expand(self.byte_starts[ids], self.byte_lengths[ids])].tobytes()


@lru_cache(maxsize=2)
def merger(path: str) -> Merger:
    return Merger(path)


def encode_texts(path: str, texts: Iterator[str | None]) -> Iterator[np.ndarray]:
    """Ids of each text in turn, worked on in blocks of bounded size."""
    for block in text_blocks(texts, BLOCK):
        yield from merger(path).encode(block)


def encoded(docs: DataFrame, ranks: str, text: str = "text", name: str = "ids") -> DataFrame:
    """`docs` with a column `name` of token ids (array of int), null text as empty.

    Other columns stay; a column called `name` is replaced. Nothing is shuffled.
    """

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        return pd.Series([x.astype(np.int32) for x in encode_texts(ranks, texts)], dtype=object)

    return docs.withColumn(name, ids(F.col(text)))


def decoded(rows: DataFrame, ranks: str, ids: str = "ids", name: str = "bytes") -> DataFrame:
    """`rows` with the bytes that a column of ids stands for; null ids give null."""

    @F.pandas_udf("binary")
    def back(column: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else merger(ranks).decode(np.asarray(x)) for x in column], dtype=object)

    return rows.withColumn(name, back(F.col(ids)))


def digests(docs: DataFrame, ranks: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: n_tokens, and SHA-256 of its ids and of the bytes they decode to.

    Ids are hashed as little-endian unsigned 32-bit integers; null text counts as empty.
    Columns of `docs` besides the two named ones are not read.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = merger(ranks)
        for batch in batches:
            rows = []
            for ids in encode_texts(ranks, batch["text"]):
                back = bpe.decode(ids)
                rows.append((len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(back).hexdigest()))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield out

    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return chosen.mapInPandas(work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
