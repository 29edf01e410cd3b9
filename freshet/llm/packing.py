"""Packing documents into fixed windows without changing their order.

A task reads its partition once and keeps a buffer of whole documents. Cuts may fall at document
ends (free), sentence ends and, only where neither comes for a long stretch, between any two ids;
the last two cost a penalty. Dynamic programming over the places of possible cuts minimises
padding plus penalties: f(j) = penalty(j) + window + min over i of f(i) + padding(c_j - c_i).
Padding is linear in c_i, so the minimum over all windows that fit is kept in a monotone queue;
windows of a power of two, which need no padding, are looked up by place.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice
from os import environ

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.llm.common import Numbers, expand, release, text_blocks
from freshet.llm.pair_merging import Pairs

CAPACITY = 2048
# Costs, in tokens of padding: of a window, of a cut at a sentence end and of any other cut.
WINDOW_COST, SENTENCE_COST, ANY_COST = 8, 6, 64
# Without a document or sentence end for so many tokens, a cut between any two ids is offered.
STRETCH = 256
# Tokens that a task buffers before it decides on windows.
BUFFER = 400_000
BLOCK = 1_000_000  # characters tokenized together
CACHE = 400_000  # words that a worker keeps

# Letters whose case mapping and normal form do not depend on their neighbours.
_LETTERS = "a-zÀ-ÖØ-öø-įı-ɏ"
# Words, one a line, that have any other character.
_ODD_WORD = re.compile(f"^.*[^\x21-\x7e{_LETTERS}\n].*$", re.MULTILINE)
# The pre-tokenizer of the vocabulary, for all other words in lower case, one a line.
_PIECES = re.compile(f"\n|'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9\n]+")
# Python cuts at these, the tokenizer does not.
_ODD_SPACE = re.compile("[\x1c-\x1f]")
_SPLIT = re.compile("[^ \t\n\r]+")
# The last characters of words that may end a sentence.
_CLOSING = frozenset(".!?…。！？\"')]»”’*")
_SENTENCE_END = re.compile("[.!?…。！？][\"')\\]»”’*]*$")


class WordTokens:
    """Ids of white-space separated words, which the vocabulary encodes independently."""

    def __init__(self, path: str):
        environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.load_rules(path)
        self.reset()

    def load_rules(self, path: str) -> None:
        """The merge rules, and the symbol of each byte inside and at the end of a piece."""
        with open(path, encoding="utf-8") as source:
            model = json.load(source)["model"]
        vocabulary, end = model["vocab"], model["end_of_word_suffix"]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(printable)]
        names = {b: chr(b) for b in printable} | {b: chr(256 + n) for n, b in enumerate(others)}
        self.inside = np.array([vocabulary[names[b]] for b in range(256)], np.int64)
        self.final = np.array([vocabulary[names[b] + end] for b in range(256)], np.int64)
        size = max(vocabulary.values()) + 1
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        merged = [vocabulary[a + b] for a, b in pairs]
        if any(x >= y for x, y in zip(merged, merged[1:])):
            raise ValueError("merged ids must rise with the order of the merges")
        self.pairs = Pairs({vocabulary[a] * size + vocabulary[b]: m for (a, b), m in zip(pairs, merged)}, size)

    def reset(self) -> None:
        self.numbers = Numbers()
        self.flat = np.empty(0, np.uint32)
        self.starts = np.empty(0, np.int64)
        self.lengths = np.empty(0, np.int64)
        self.ends = np.empty(0, bool)

    def learn(self, words: list[str]) -> None:
        """Ids of new words: merged together if plain, else by the whole tokenizer."""
        odd = frozenset(_ODD_WORD.findall("\n".join(words)))
        plain = [w not in odd for w in words] if odd else [True] * len(words)
        lines = [w for w in words if w not in odd] if odd else words
        pieces = _PIECES.findall("\n".join(lines).lower()) + ["\n"] * bool(lines)
        breaks = np.flatnonzero(np.fromiter(map("\n".__eq__, pieces), bool, len(pieces)))
        split = np.diff(breaks, prepend=-1) - 1  # pieces per word
        numbers = Numbers()
        order = np.fromiter(map(numbers.__getitem__, filter("\n".__ne__, pieces)), np.int64, len(pieces) - len(breaks))
        raw = [piece.encode() for piece in numbers]
        symbols = np.frombuffer(b"".join(raw), np.uint8)
        lengths = np.array([len(p) for p in raw], np.int64)
        ids = self.inside[symbols]
        last = np.cumsum(lengths) - 1
        ids[last] = self.final[symbols[last]]
        ids, counts = self.pairs.merge(ids, lengths)
        sizes = counts[order]
        ids = ids[expand((np.cumsum(counts) - counts)[order], sizes)]
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(split)])]
        other = [self.tokenizer.encode(w, add_special_tokens=False).ids for w, p in zip(words, plain) if not p]
        sizes = np.empty(len(words), np.int64)
        starts = np.empty(len(words), np.int64)
        mask = np.array(plain, bool)
        sizes[mask], starts[mask] = np.diff(ends), ends[:-1]
        sizes[~mask] = [len(x) for x in other]
        starts[~mask] = len(ids) + np.cumsum(sizes[~mask]) - sizes[~mask]
        self.starts = np.concatenate([self.starts, len(self.flat) + starts])
        self.lengths = np.concatenate([self.lengths, sizes])
        self.flat = np.concatenate([self.flat, ids.astype(np.uint32), np.array([t for x in other for t in x], np.uint32)])
        self.ends = np.concatenate([self.ends, np.array([w[-1] in _CLOSING and _SENTENCE_END.search(w[-8:]) is not None for w in words], bool)])

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Per text its ids and the places (in ids) right after sentence ends."""
        if len(self.numbers) > CACHE:
            self.reset()
        split = [t.split() if not _ODD_SPACE.search(t) else _SPLIT.findall(t) for t in texts]
        counts = np.array([len(w) for w in split], np.int64)
        numbers = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(split)), np.int64, int(counts.sum()))
        if len(self.numbers) > len(self.starts):
            self.learn(list(islice(self.numbers, len(self.starts), None)))
        lengths = self.lengths[numbers]
        ids = self.flat[expand(self.starts[numbers], lengths)]
        after = np.concatenate([[0], np.cumsum(lengths)])
        sentence = self.ends[numbers]
        low = 0
        for count in counts.tolist():
            high = low + count
            places = after[low + 1 : high + 1][sentence[low:high]] - after[low]
            yield ids[after[low] : after[high]], places
            low = high


@lru_cache(maxsize=2)
def word_tokens(path: str) -> WordTokens:
    return WordTokens(path)


def choose_cuts(
    places: list[int], costs: list[float], capacity: int = CAPACITY, window: float = WINDOW_COST
) -> list[int]:
    """Indices of the cheapest cuts, from 0 to the last place.

    `places` ascend from 0, two neighbours lie at most `capacity` apart, and a cut at places[j]
    costs costs[j]. A window costs its padding to `capacity` unless its length is a power of
    two, and `window` besides. Equal costs: the earliest start wins.
    """
    powers = [1 << k for k in range(max(capacity.bit_length() - 4, 0), capacity.bit_length()) if 1 << k < capacity]
    best = [0.0] * len(places)
    came = [0] * len(places)
    exact: dict[int, list[int]] = {}  # per place those that lie a power of two before it
    where = np.asarray(places)
    for power in powers:
        before = np.searchsorted(where, where - power)
        for j in np.flatnonzero(where[before] == where - power).tolist():
            exact.setdefault(j, []).append(int(before[j]))
    queue = [0]  # indices with rising best + place
    keys = [float(places[0])]
    head = 0
    for j in range(1, len(places)):
        place = places[j]
        while places[queue[head]] < place - capacity:
            head += 1
        i = queue[head]
        cost = keys[head] + capacity - place
        if j in exact:
            for k in exact[j]:
                if best[k] < cost:
                    cost, i = best[k], k
        cost += window + costs[j]
        best[j], came[j] = cost, i
        key = cost + place
        while len(keys) > head and keys[-1] > key:
            keys.pop()
            queue.pop()
        keys.append(key)
        queue.append(j)
    cuts = [len(places) - 1]
    while cuts[-1]:
        cuts.append(came[cuts[-1]])
    return cuts[::-1]


def offered(lengths: np.ndarray, sentences: list[np.ndarray], done: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of possible cuts in a buffer of documents, and what each costs.

    The first `done` ids of the buffer are packed already; places count from there.
    """
    ends = np.cumsum(lengths)
    starts = ends - lengths
    inner = np.concatenate([s + a for s, a in zip(sentences, starts)]) if len(sentences) else np.empty(0, np.int64)
    places = np.concatenate([ends, inner]) - done
    costs = np.concatenate([np.zeros(len(ends)), np.full(len(inner), float(SENTENCE_COST))])
    keep = places > 0
    order = np.lexsort((costs[keep], places[keep]))
    places, costs = places[keep][order], costs[keep][order]
    first = np.append(True, places[1:] != places[:-1])
    places, costs = np.append(0, places[first]), np.append(0.0, costs[first])
    gaps = np.diff(places)
    wide = np.flatnonzero(gaps > STRETCH)
    if len(wide):
        many = (gaps[wide] - 1) // STRETCH
        more = places[np.repeat(wide, many)] + STRETCH * (expand(np.zeros(len(wide), np.int64), many) + 1)
        order = np.argsort(np.concatenate([places, more]), kind="stable")
        costs = np.concatenate([costs, np.full(len(more), float(ANY_COST))])[order]
        places = np.concatenate([places, more])[order]
    return places, costs


class Packer:
    """The buffer of one task: whole documents in order, of which a prefix may be packed."""

    def __init__(self, capacity: int, partition: int):
        self.capacity = capacity
        self.sequence = partition << 40
        self.docs: list[tuple[int | None, np.ndarray, np.ndarray]] = []
        self.held = 0
        self.done = 0

    def add(self, doc_id: int | None, ids: np.ndarray, sentences: np.ndarray) -> None:
        self.docs.append((doc_id, ids, sentences))
        self.held += len(ids)

    def flush(self, last: bool) -> list[tuple]:
        """Pieces of all windows, but for the final one unless `last`."""
        if not self.docs:
            return []
        lengths = np.array([len(d[1]) for d in self.docs], np.int64)
        places, costs = offered(lengths, [d[2] for d in self.docs], self.done)
        cuts = [int(places[i]) + self.done for i in choose_cuts(places.tolist(), costs.tolist(), self.capacity)]
        if not last:
            cuts = cuts[:-1]
        ends = np.cumsum(lengths)
        rows = []
        doc = int(np.searchsorted(ends, self.done, side="right"))
        for low, high in zip(cuts, cuts[1:]):
            at = low
            while at < high:
                doc_id, ids, _ = self.docs[doc]
                start = at - int(ends[doc] - lengths[doc])
                stop = min(high, int(ends[doc])) - int(ends[doc] - lengths[doc])
                rows.append((doc_id, start, stop - start, len(ids), self.sequence, at - low, ids[start:stop].tobytes()))
                at += stop - start
                if at == int(ends[doc]):
                    doc += 1
            self.sequence += 1
        before = int(ends[doc - 1]) if doc else 0
        self.docs = self.docs[doc:]
        self.done = (cuts[-1] if cuts else 0) - before
        self.held = sum(len(d[1]) for d in self.docs)
        return rows


COLUMNS = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]


def packed(
    docs: DataFrame, vocabulary: str, end: int = 1, capacity: int = CAPACITY,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Pieces of documents in windows of at most `capacity` tokens, in the table's order.

    A document is its ids and then `end`; null or empty text is `end` alone. Each row is one
    piece: where it starts in its document, its length, the document's tokens, its window
    (`sequence_id`, unique over all partitions), its place in the window, and its ids as
    little-endian unsigned 32-bit integers. Repeated rows are packed as often as they come;
    a null id stays null. Other columns are not read. Nothing is shuffled: each partition
    fills its own windows, and only its last may be short.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = word_tokens(vocabulary)
        packer = Packer(capacity, TaskContext.get().partitionId())
        for batch in batches:
            ids = batch["doc_id"].astype(object).where(batch["doc_id"].notna(), None).tolist()
            row = 0
            for block in text_blocks(batch["text"], BLOCK):
                for own, sentences in tokens.encode(block):
                    packer.add(ids[row], np.append(own, np.uint32(end)), sentences)
                    row += 1
                    if packer.held - packer.done > BUFFER:
                        yield pd.DataFrame(packer.flush(False), columns=COLUMNS)
        yield pd.DataFrame(packer.flush(True), columns=COLUMNS)
        release()

    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return chosen.mapInPandas(
        work, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    )


def pieces(docs: DataFrame, vocabulary: str, **options) -> DataFrame:
    """`packed` with the CRC-32 of each piece's ids in place of the ids."""
    return packed(docs, vocabulary, **options).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
