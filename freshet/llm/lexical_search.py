"""Exact ranked lexical search: documents as a frequent-pattern tree, searched branch and bound.

The items come in blocks of bounded size. For a block, one pass over the texts restricts each
document to the block's terms and counts document frequencies; the restricted vectors are written
and searched in blocks of documents. An item's tree over a block of documents has its terms from
the most frequent to the rarest along the paths, so documents that hold the same frequent terms
share a path; with the documents sorted by their paths a subtree is a range of rows. A node knows
the largest frequency of each of the item's terms in its subtree and the smallest length part m:
their score is an upper bound of all below. The search goes depth first, best bound first, and
leaves out subtrees whose bound is under the k-th score found so far in the task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat
from math import floor, log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from freshet.durable import materialize
from freshet.llm.common import expand

K = 10
# Items and their distinct terms that are searched together.
BLOCK_ITEMS, BLOCK_TERMS = 2048, 400_000
# Documents of a tree, and cells (documents by terms of an item) of its matrix.
DOCUMENTS, CELLS = 8192, 4_000_000
# Documents that make a leaf.
LEAF = 48
# Characters of text that are cut into terms together.
TEXTS = 4_000_000
NO_ID = np.iinfo(np.int64).max

# Bytes of terms, A-Z in lower case; all other bytes become a space.
_TERM_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def terms(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and non-ASCII characters, only A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split() if text else []


def weight(n: int, df: int) -> int:
    return floor(1000 * log((2 * n + 2) / (2 * df + 1)))


def length_part(sizes: np.ndarray, n: int, total: int) -> np.ndarray:
    """m of documents with so many terms, among n documents of `total` terms."""
    return 10 + (90 * sizes * n) // max(total, 1)


def part(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term of weight 1 adds: grows with tf, shrinks with m."""
    return (1_000_000_000 * tf) // np.maximum(1000 * tf + 8 * m, 1)


class Best:
    """The k best rows of an item: score downwards, then id upwards (rows without id last)."""

    def __init__(self, k: int):
        self.k = k
        self.scores = np.empty(0, np.int64)
        self.ids = np.empty(0, np.int64)
        self.least = 1

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        keep = scores >= self.least
        if not keep.any():
            return
        scores, ids = np.append(self.scores, scores[keep]), np.append(self.ids, ids[keep])
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]
        if len(order) == self.k:
            self.least = max(int(self.scores[-1]), 1)


class Tree:
    """The tree of one item over documents, given as a matrix of term frequencies.

    `tf` has a column per term, the most frequent in the corpus first; `m` and `ids` are the
    documents'. Documents without any of the terms must be left out. A node's children differ in
    the next eight terms of their paths.
    """

    def __init__(self, tf: np.ndarray, m: np.ndarray, ids: np.ndarray, weights: np.ndarray):
        paths = np.packbits(tf > 0, axis=1)
        order = np.lexsort(paths.T[::-1])
        self.tf, self.m, self.ids, self.paths = tf[order], m[order], ids[order], paths[order]
        self.weights = weights
        self.scored = 0

    def bounds(self, starts: np.ndarray, low: int, high: int) -> np.ndarray:
        """Upper bounds of the subtrees that begin at `starts` and end where the next begins."""
        tf = np.maximum.reduceat(self.tf[low:high], starts - low, axis=0)
        m = np.minimum.reduceat(self.m[low:high], starts - low)
        return part(tf.astype(np.int64), m[:, None]) @ self.weights

    def search(self, best: Best) -> None:
        """Adds what belongs to the best rows."""
        if not len(self.m):
            return
        stack = [(int(self.bounds(np.zeros(1, np.int64), 0, len(self.m))[0]), 0, len(self.m), 0)]
        while stack:
            bound, low, high, depth = stack.pop()
            if bound < best.least:
                continue
            if high - low <= LEAF or depth == self.paths.shape[1]:
                self.scored += high - low
                own = part(self.tf[low:high].astype(np.int64), self.m[low:high, None]) @ self.weights
                best.add(own, self.ids[low:high])
                continue
            step = self.paths[low:high, depth]
            starts = low + np.flatnonzero(np.append(True, step[1:] != step[:-1]))
            if len(starts) == 1:  # all go the same way
                stack.append((bound, low, high, depth + 1))
                continue
            below = self.bounds(starts, low, high)
            ends = np.append(starts[1:], high)
            for i in np.argsort(below, kind="stable").tolist():  # the best is popped first
                if below[i] >= best.least:
                    stack.append((int(below[i]), int(starts[i]), int(ends[i]), depth + 1))


class Block:
    """Documents' vectors restricted to a vocabulary, by term."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, counts: np.ndarray, term: np.ndarray, tf: np.ndarray):
        self.ids, self.m = ids, m
        doc = np.repeat(np.arange(len(ids)), counts)
        order = np.argsort(term, kind="stable")
        self.term, self.doc, self.tf = term[order], doc[order], tf[order]

    def search(self, item: np.ndarray, weights: np.ndarray, best: Best) -> int:
        """Searches for an item, given by its terms from the most frequent on; documents scored."""
        low, high = np.searchsorted(self.term, item, "left"), np.searchsorted(self.term, item, "right")
        places = expand(low, high - low)
        doc, tf = self.doc[places], self.tf[places]
        column = np.repeat(np.arange(len(item)), high - low)
        held = np.zeros(len(self.ids), bool)
        held[doc] = True
        docs = np.flatnonzero(held)
        scored, step = 0, max(LEAF, CELLS // max(len(item), 1))
        for first in range(0, len(docs), step):
            own = docs[first : first + step]
            row = np.full(len(self.ids), -1)
            row[own] = np.arange(len(own))
            inside = row[doc] >= 0
            matrix = np.zeros((len(own), len(item)), np.int32)
            matrix[row[doc[inside]], column[inside]] = tf[inside]
            tree = Tree(matrix, self.m[own], self.ids[own], weights)
            tree.search(best)
            scored += tree.scored
        return scored


def item_blocks(items: DataFrame, item_id: str, text: str) -> Iterator[dict[int, set[bytes]]]:
    """The items' distinct terms, in blocks of bounded size; rows that repeat an id are one item."""
    rows = items.select(F.col(item_id).cast("long").alias("i"), F.col(text).cast("string").alias("t")).where("i IS NOT NULL")
    block: dict[int, set[bytes]] = {}
    held, last = 0, None
    for row in rows.orderBy("i").toLocalIterator():
        if row["i"] != last and (len(block) >= BLOCK_ITEMS or held >= BLOCK_TERMS):
            yield block
            block, held = {}, 0
        last = row["i"]
        own = block.setdefault(last, set())
        held -= len(own)
        own.update(terms(row["t"]))
        held += len(own)
    if block:
        yield block


def restricted(docs: DataFrame, vocabulary: dict[bytes, int], doc_id: str, text: str) -> DataFrame:
    """Per document its id, its number of terms and its vector in `vocabulary`, and counts per task.

    Rows of counts have a `term` and how many of the task's documents hold it (`size`); term -1
    stands for the documents with at least one term and -2 for all terms.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frequency = np.zeros(len(vocabulary), np.int64)
        totals = np.zeros(2, np.int64)
        none = pd.array([], dtype="Int64")
        for batch in batches:
            ids = batch["doc_id"].astype("Int64").array
            low, lengths = 0, batch["text"].str.len().fillna(0).to_numpy(np.int64)
            for high in _cuts(lengths):
                split = [terms(t) for t in batch["text"].iloc[low:high]]
                sizes = np.array([len(s) for s in split], np.int64)
                totals += [np.count_nonzero(sizes), sizes.sum()]
                found = np.fromiter(
                    map(vocabulary.get, chain.from_iterable(split), repeat(-1)), np.int64, int(sizes.sum())
                )
                doc = np.repeat(np.arange(len(split)), sizes)[found >= 0]
                keys, tf = np.unique(doc * len(vocabulary) + found[found >= 0], return_counts=True)
                doc, term = keys // max(len(vocabulary), 1), (keys % max(len(vocabulary), 1)).astype(np.uint32)
                frequency += np.bincount(term, minlength=len(vocabulary))
                own, counts = np.unique(doc, return_counts=True)
                ends = np.cumsum(counts)
                tf = tf.astype(np.uint32)
                yield pd.DataFrame({
                    "doc_id": ids[low:high][own], "size": sizes[own], "term": -3,
                    "terms": [term[e - c : e].tobytes() for e, c in zip(ends, counts)],
                    "tfs": [tf[e - c : e].tobytes() for e, c in zip(ends, counts)],
                })
                low = high
        seen = np.flatnonzero(frequency)
        if totals[0]:
            yield pd.DataFrame({
                "doc_id": none.take([-1] * (len(seen) + 2), allow_fill=True), "size": np.append(totals, frequency[seen]),
                "term": np.append([-1, -2], seen), "terms": None, "tfs": None,
            })

    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return chosen.mapInPandas(work, "doc_id long, size long, term int, terms binary, tfs binary")


def _cuts(lengths: np.ndarray) -> list[int]:
    """Ends of consecutive runs of about TEXTS characters."""
    upto = np.cumsum(lengths) // TEXTS
    return [*(np.flatnonzero(upto[1:] != upto[:-1]) + 1).tolist(), len(lengths)] if len(lengths) else []


def _searched(vectors: DataFrame, items: dict[int, tuple[np.ndarray, np.ndarray]], n: int, total: int, k: int) -> DataFrame:
    """item_id, doc_id, score: the k best of each task for each item."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = {i: Best(k) for i in items}
        held: list[pd.DataFrame] = []

        def search() -> None:
            frame = pd.concat(held, ignore_index=True)
            held.clear()
            for low in range(0, len(frame), DOCUMENTS):
                own = frame.iloc[low : low + DOCUMENTS]
                ids = own["doc_id"].astype("Int64").fillna(NO_ID).to_numpy(np.int64)
                term = np.frombuffer(b"".join(own["terms"]), np.uint32).astype(np.int64)
                tf = np.frombuffer(b"".join(own["tfs"]), np.uint32).astype(np.int32)
                counts = own["terms"].str.len().to_numpy(np.int64) // 4
                block = Block(ids, length_part(own["size"].to_numpy(np.int64), n, total), counts, term, tf)
                for i, (item, weights) in items.items():
                    block.search(item, weights, best[i])

        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= DOCUMENTS:
                search()
        if held:
            search()
        for i, found in best.items():
            if len(found.ids):
                ids = pd.array(found.ids, dtype="Int64")
                ids[found.ids == NO_ID] = pd.NA
                yield pd.DataFrame({"item_id": i, "doc_id": ids, "score": found.scores})

    return vectors.select("doc_id", "size", "terms", "tfs").mapInPandas(work, "item_id long, doc_id long, score long")


def ranked(
    docs: DataFrame, items: DataFrame, k: int = K, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: each item's k best documents with a score above 0.

    Equal scores rank by id, rows without an id last; every row of `docs` is a document of its
    own, repeated or not. Null and empty texts have no terms. Rows that repeat an item's id add
    their terms to it; items without an id take no part. Other columns are not read.
    """
    found = None
    for block in item_blocks(items, item_id, item_text):
        vocabulary = {term: i for i, term in enumerate(sorted(set().union(*block.values())))}
        if not vocabulary:
            continue
        rows = materialize(restricted(docs, vocabulary, doc_id, text))
        counted = rows.where("term > -3").groupBy("term").agg(F.sum("size").alias("size"))
        counts = Counter({r["term"]: r["size"] for r in counted.toLocalIterator()})  # as many rows as the block has terms
        n, total = counts[-1], counts[-2]
        df = np.array([counts[i] for i in range(len(vocabulary))], np.int64)
        weights = np.array([weight(n, d) for d in df.tolist()], np.int64)
        chosen = {}
        for i, own in block.items():
            numbers = np.array(sorted(vocabulary[t] for t in own), np.int64)
            numbers = numbers[(df[numbers] > 0) & (weights[numbers] > 0)] if len(numbers) else numbers
            if len(numbers):
                numbers = numbers[np.argsort(-df[numbers], kind="stable")]
                chosen[i] = numbers, weights[numbers]
        best = materialize(_searched(rows.where("term = -3"), chosen, n, total, k))
        found = best if found is None else found.unionAll(best)
    if found is None:
        found = docs.sparkSession.createDataFrame([], "item_id long, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "item_id", "rank", "doc_id", "score"
    )
