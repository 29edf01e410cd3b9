"""Language identification by cross-parsing.

Labelled text of each language becomes a suffix automaton. A text is parsed greedily into longest
phrases that occur in a language's text; each language's number of phrases, per symbol parsed and
corrected for the amount of text it was learnt from, is its cross entropy; the language that needs
the fewest wins. Each language tells its own letters apart, whatever its script; a letter that its
sample lacks is foreign to it. All languages' automata stand in one transition table, and many
stretches of text step through it side by side.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.llm.common import give_back, release, text_blocks

# Symbols of labelled text per language, symbols that a language tells apart, those of them that its
# rarer letters share, and rows asked for per language.
SAMPLE_SYMBOLS = 16_000
ALPHABET = 48
SHARED = 12
SAMPLE_ROWS = 96
# A phrase never crosses a stretch of so many symbols; a text of any length is parsed whole.
STRETCH = 256
BLOCK = 400_000
# How fast the best language's share grows with its lead in phrases per symbol.
SHARPNESS = 40.0
MISSING = 1 << 30
NEAR_LETTERS = np.array([chr(p).isalpha() for p in range(0x250)], np.uint8)


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def letters(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def suffix_automaton(symbols: list[int], alphabet: int) -> np.ndarray:
    """Transitions (state, symbol) -> state of the automaton of all substrings; 0 is none, 1 the start."""
    step: list[dict[int, int]] = [{}, {}]
    link, length = [0, 0], [0, 0]
    last = 1
    for c in symbols:
        step.append({})
        link.append(1)
        length.append(length[last] + 1)
        new, p = len(step) - 1, last
        while p and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                copy = len(step) - 1
                while p and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    table = np.zeros((len(step), alphabet), np.int32)
    for state, own in enumerate(step):
        if own:
            table[state, list(own)] = list(own.values())
    return table


@dataclass(frozen=True)
class Parser:
    """Automata of all languages; its size is bounded by the sample's, whatever the corpus."""

    languages: tuple[str, ...]
    alphabet: np.ndarray  # code points that have a symbol, ascending
    codes: np.ndarray  # their symbols, the same for all languages
    maps: np.ndarray  # (language, symbol) -> the language's own symbol
    table: np.ndarray  # premultiplied next state, with MISSING set where a phrase ends
    roots: np.ndarray
    scales: np.ndarray

    def symbols(self, text: str) -> np.ndarray:
        """Symbols of a text: 0 for all that is no letter (runs count once), 1 for letters in no sample."""
        own = encode(points(text), self.alphabet, self.codes)
        return own[np.append(True, (own[1:] != 0) | (own[:-1] != 0))] if len(own) else own

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases per (text, language), and symbols per text."""
        symbols = [self.symbols(t) for t in texts]
        sizes = np.array([len(s) for s in symbols], np.int64)
        stretches = -(-sizes // STRETCH)
        counts = np.zeros((len(self.languages), len(texts)), np.int64)
        if not stretches.sum():
            return counts.T, sizes
        flat = self.maps[:, np.concatenate(symbols)]
        owner = np.repeat(np.arange(len(texts)), stretches)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(stretches) - stretches, stretches)
        begin = np.repeat(np.cumsum(sizes) - sizes, stretches) + number * STRETCH
        left = np.minimum(sizes[owner] - number * STRETCH, STRETCH)
        order = np.argsort(-left, kind="stable")  # the lanes that are still open come first
        begin, left, owner = begin[order], left[order], owner[order]
        states = np.repeat(self.roots[:, None], len(owner), axis=1)
        ended = np.zeros(states.shape, np.int32)
        for k in range(int(left[0])):
            n = int(np.searchsorted(-left, -k, side="left"))
            following = self.table[states[:, :n] + flat[:, begin[:n] + k]]
            ended[:, :n] += following >> 30
            states[:, :n] = following & (MISSING - 1)
        for i in range(len(self.languages)):
            counts[i] = np.bincount(owner, ended[i] + 1, len(texts)).astype(np.int64)
        return counts.T, sizes

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and share of each text; `und` and 0 where there is no letter."""
        known = [letters(t) for t in texts]
        if not self.languages:
            return [("und", 0.0)] * len(texts)
        counts, sizes = self.phrases([t or "" for t in texts])
        rates = counts * self.scales / np.maximum(sizes, 1)[:, None]
        best = rates.argmin(1)
        lead = np.exp(-SHARPNESS * (rates - rates.min(1, keepdims=True)))
        share = 1 / lead.sum(1)
        return [(self.languages[b], float(s)) if k else ("und", 0.0) for b, s, k in zip(best, share, known)]


def encode(values: np.ndarray, alphabet: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Symbols of lower-case code points. Letters outside the alphabet are 1, all else is 0."""
    small = NEAR_LETTERS.astype(np.int32)
    low = alphabet < 0x250
    small[alphabet[low]] = codes[low]
    out = np.empty(len(values), np.int32)
    near = values < 0x250
    out[near] = small[values[near]]
    far = values[~near]
    if len(far):
        distinct = np.unique(far)
        kinds = np.array([chr(p).isalpha() for p in distinct.tolist()], np.int32)
        place = np.minimum(np.searchsorted(alphabet, distinct), max(len(alphabet) - 1, 0))
        if len(alphabet):
            kinds = np.where(alphabet[place] == distinct, codes[place], kinds)
        out[~near] = kinds[np.searchsorted(distinct, far)]
    return out


def own_symbols(counts: Counter, common: np.ndarray, alphabet: int) -> np.ndarray:
    """A language's symbol for every common symbol: 0 is no letter, 1 a letter that its sample lacks.

    The commonest letters have a symbol each. Letters beyond that share the last SHARED symbols, by
    code point, so that a script of thousands of letters is still told apart.
    """
    out = np.ones(2 + len(common), np.int32)
    out[0] = 0
    ranked = [ord(c) for c, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))]
    alone = alphabet - 2 if len(ranked) <= alphabet - 2 else alphabet - 2 - SHARED
    place = 2 + np.searchsorted(common, np.array(ranked, np.uint32))
    out[place[:alone]] = np.arange(2, 2 + min(alone, len(ranked)))
    out[place[alone:]] = alphabet - SHARED + np.array(ranked[alone:], np.int64) % SHARED
    return out


def build(samples: dict[str, list[str]], symbols: int = SAMPLE_SYMBOLS, alphabet: int = ALPHABET) -> Parser:
    """Automata from whole texts per language; a text that no longer fits is left out, unless it is the first."""
    languages = tuple(sorted(samples))
    counts = {name: Counter(c for t in samples[name] for c in t.lower() if c.isalpha()) for name in languages}
    common = sorted({ord(c) for own in counts.values() for c in own})
    letters_, codes = np.array(common, np.uint32), np.arange(2, 2 + len(common), dtype=np.int32)
    maps = np.stack([own_symbols(counts[name], letters_, alphabet) for name in languages]) if languages else np.zeros((0, 2), np.int32)
    parser = Parser(languages, letters_, codes, maps, np.zeros(0, np.int32), np.zeros(0, np.int32), np.ones(0))
    tables, roots, sizes, base = [], [], [], 0
    for name, own_map in zip(languages, maps):
        material: list[int] = []
        for t in samples[name]:
            own = [0, *own_map[parser.symbols(t)].tolist()]
            if len(material) + len(own) <= symbols:
                material += own
            elif not material:
                material = own[:symbols]
        step = suffix_automaton(material, alphabet)
        # A phrase that cannot go on gives way to one that begins at the symbol; state 0, from which
        # nothing goes on, stands for a symbol that the language does not have.
        full = np.where(step > 0, step, step[1][None, :])
        missing = step == 0
        missing[1] = False
        full = (full + base) * alphabet
        full[missing] |= MISSING
        tables.append(full.astype(np.int32))
        roots.append((1 + base) * alphabet)
        sizes.append(max(len(material), 2))
        base += len(step)
    scales = np.log(np.array(sizes, float)) if sizes else np.ones(0)
    if len(scales):
        scales = scales / scales.max()
    table = np.concatenate(tables).reshape(-1) if tables else np.zeros(0, np.int32)
    return Parser(languages, letters_, codes, maps, table, np.array(roots, np.int32), scales)


def fit(
    docs: DataFrame, text: str = "text", lang: str = "lang", symbols: int = SAMPLE_SYMBOLS, rows: int = SAMPLE_ROWS,
    seed: int = 11,
) -> Parser:
    """Learn from rows with a language and letters: about `rows` whole texts of each language at most.

    Counts per language come from all rows; the sample is chosen by a hash of the text, so copies
    are chosen together (and used once) and partitions do not matter. Texts of more than `symbols`
    characters are not sampled, unless a language has no other. Only the sample, bounded by `rows`
    texts of `symbols` characters per language, reaches the driver.
    """
    labelled = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    labelled = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}"))
    place = F.pmod(F.xxhash64("text", F.lit(seed)), F.lit(1 << 30))
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return build({})
    limit = F.lit(0)
    for name, n in sorted(counts.items()):
        limit = F.when(F.col("lang") == name, F.lit(min(1 << 30, (rows << 30) // n))).otherwise(limit)
    short = F.length("text") <= symbols
    picked = labelled.where(short & (place < limit)).select("lang", place.alias("place"), "text").distinct()
    frame = picked.toPandas().sort_values(["lang", "place", "text"])
    texts = {name: own["text"].tolist()[: 4 * rows] for name, own in frame.groupby("lang")}
    missing = [name for name in counts if name not in texts]
    if missing:  # a language so rare, or so full of copies or long texts, that the hash chose none
        start = F.substring("text", 1, 2 * symbols)
        more = labelled.where(F.col("lang").isin(missing)).groupBy("lang").agg(F.min_by(start, place).alias("text"))
        texts |= {r["lang"]: [r["text"]] for r in more.collect()}
    parser = build(texts, symbols)
    del frame, texts
    give_back(docs.sparkSession)
    return parser


def language(parser: Parser, text: Column) -> Column:
    """struct(lang, score) of whole texts: the winner and its share of all languages' weight.

    Null texts and texts without a letter give `und` and 0.
    """

    @F.pandas_udf("struct<lang: string, score: double>")
    def work(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple[str, float]] = []
            start = 0
            for block in text_blocks(batch, BLOCK):
                out += parser.predict(batch.iloc[start : start + len(block)].tolist())
                start += len(block)
            yield pd.DataFrame(out, columns=["lang", "score"])
        release()

    return work(text.cast("string"))
