"""Quality classifier: a factorisation machine over hashed words, text structure and metadata.

score = sigmoid(w0 + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j); the pair sum is
0.5 * sum over factors of ((sum v_if x_i)^2 - sum v_if^2 x_i^2), linear in the words of a text.
It is fitted on a bounded sample of labelled rows; scoring is one projection over all rows.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.llm.common import give_back, release, words

# Hashed word features (all features are numbered below 2^16), factors per feature, and labelled
# rows that a fit may use.
WORD_FEATURES = 1 << 12
FACTORS = 4
SAMPLE_ROWS = 10_000
EPOCHS, BATCH, STEP, DECAY = 12, 128, 0.02, 1e-4
THRESHOLD = 0.3

STRUCTURE = [
    "bias", "log_characters", "log_words", "mean_word", "distinct_words", "upper_share", "digit_share", "symbol_share",
    "newline_share", "words_with_symbols", "symbols_twice", "bars", "shortest_words", "no_words", "no_metadata",
]
_UPPER = bytes(range(0x41, 0x5B))
_DIGITS = bytes(range(0x30, 0x3A))
_SYMBOLS = b"#$%&*+<=>@^_`{|}~!/\\"
_TWICE = re.compile(rb"([#$%&*!|])\1")


def structure(text: str, tokens: list[bytes], counts: Counter, metadata: list[float]) -> np.ndarray:
    """Structure statistics of a text, each of the order of 1, and metadata on a log scale."""
    raw = text.encode("utf-8", "surrogatepass")
    size, n = max(len(raw), 1), max(len(tokens), 1)
    share = lambda chars: 1 - len(raw.translate(None, chars)) / size
    known = [np.log1p(max(v, 0.0)) / 10 if np.isfinite(v) else 0.0 for v in metadata]
    symbols = share(_SYMBOLS)
    return np.array([
        1.0, np.log1p(len(raw)) / 10, np.log1p(len(tokens)) / 10, min(len(raw) / n / 10, 5.0), len(counts) / n,
        3 * share(_UPPER), 3 * share(_DIGITS), 5 * symbols, 5 * share(b"\n"), min(symbols * size / n, 3.0),
        min(len(_TWICE.findall(raw)) / n, 2.0), 2 * counts.get(b"|", 0) / n,
        sum(c for w, c in counts.items() if len(w) <= 3) / n, float(not tokens),
        float(any(not np.isfinite(v) for v in metadata)), *known,
    ])


def features(text: str | None, metadata: list[float], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted feature numbers and values: words hashed to [0, size), then structure and metadata.

    Word values are log counts scaled to length 1, so a long text weighs no more than a short one.
    """
    text = text or ""
    tokens = words(text)
    counts = Counter(tokens)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, counts), np.uint64, len(counts)) % np.uint64(size)
    values = np.bincount(hashed.astype(np.int64), np.log1p(np.fromiter(counts.values(), float, len(counts))), size) \
        if len(counts) else np.zeros(size)
    at = np.flatnonzero(values)
    own = values[at]
    if len(own):
        own = own / np.sqrt((own * own).sum())
    rest = structure(text, tokens, counts, metadata)
    return np.append(at, size + np.arange(len(rest))), np.append(own, rest)


@dataclass(frozen=True)
class Machine:
    """A fitted factorisation machine; its size is fixed by the parameters, not by the data."""

    intercept: float
    linear: np.ndarray
    factors: np.ndarray
    words: int
    metadata: tuple[str, ...]

    def score(self, at: np.ndarray, values: np.ndarray) -> float:
        own = self.factors[at]
        sums = values @ own
        pairs = 0.5 * float((sums * sums).sum() - ((values * values) @ (own * own)).sum())
        margin = self.intercept + float(values @ self.linear[at]) + pairs
        return float(1 / (1 + np.exp(-np.clip(margin, -35.0, 35.0))))


def _frame(text: Column, metadata: tuple[str, ...]) -> Column:
    return F.struct(text.cast("string").alias("text"), *[F.col(m).cast("double").alias(f"m{i}") for i, m in enumerate(metadata)])


def _rows(frame: pd.DataFrame) -> list[tuple[str | None, list[float]]]:
    names = [c for c in frame.columns if c != "text"]
    metadata = frame[names].to_numpy(float) if names else np.empty((len(frame), 0))
    return list(zip(frame["text"], metadata.tolist()))


def fit(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
    metadata: tuple[str, ...] = (), rows: int = SAMPLE_ROWS, size: int = WORD_FEATURES, seed: int = 7,
) -> Machine:
    """Learn from `labels` (doc_id, label 0 or 1), at most about `rows` of them.

    Rows whose label or id is null are not used; a document with both labels counts as 1. The
    sample is chosen by a hash of the id, so it does not depend on partitions; being bounded, it
    is broadcast to the documents, which are not shuffled. With one label only, or none, every
    score is that label's (0.5 without any).
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull())
    known = known.select(F.col(doc_id).alias("id"), F.col(label).cast("double").alias("label"))
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    total = known.count()
    share = min(1.0, rows / max(total, 1))
    chosen = known.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000))
    # Under private names, whatever the tables' other columns are called.
    texts = docs.select(F.col(doc_id).alias("id"), _frame(F.col(text), metadata).alias("frame"))

    @F.pandas_udf("struct<at: binary, values: binary>")
    def featured(frame: pd.DataFrame) -> pd.DataFrame:
        out = [features(t, m, size) for t, m in _rows(frame)]
        return pd.DataFrame({
            "at": [a.astype(np.uint16).tobytes() for a, _ in out], "values": [v.astype(np.float32).tobytes() for _, v in out],
        })

    sample = (
        texts.join(F.broadcast(chosen), "id").select(F.xxhash64("id").alias("place"), "label", featured(F.col("frame")).alias("f"))
        .select("place", "label", "f.at", "f.values").toPandas().sort_values(["place", "label"], kind="stable")
    )
    width = size + len(STRUCTURE) + len(metadata)
    at = [np.frombuffer(x, np.uint16) for x in sample["at"]]
    values = [np.frombuffer(x, np.float32) for x in sample["values"]]
    machine = train(at, values, sample["label"].to_numpy(), width, size, metadata, seed)
    del sample, at, values
    give_back(docs.sparkSession)
    return machine


def train(
    at: list[np.ndarray], values: list[np.ndarray], labels: np.ndarray, width: int, size: int,
    metadata: tuple[str, ...], seed: int,
) -> Machine:
    """Logistic loss by mini-batches with Adam; the same rows in the same order give the same machine."""
    classes = set(labels.tolist())
    if len(classes) < 2:
        constant = {0.0: -35.0, 1.0: 35.0}[classes.pop()] if classes else 0.0
        return Machine(constant, np.zeros(width), np.zeros((width, FACTORS)), size, metadata)
    random = np.random.default_rng(seed)
    weights = np.zeros((width, 1 + FACTORS))  # linear, then factors
    weights[:, 1:] = random.normal(0, 0.05, (width, FACTORS))
    share = labels.mean()
    intercept = float(np.log(share / (1 - share)))
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    step = 0
    for _ in range(EPOCHS):
        order = random.permutation(len(labels))
        for low in range(0, len(order), BATCH):
            rows = order[low : low + BATCH]
            sizes = np.array([len(at[i]) for i in rows])
            columns = np.concatenate([at[i] for i in rows]).astype(np.intp)
            x = np.concatenate([values[i] for i in rows]).astype(float)[:, None]
            own = weights[columns] * x
            cuts = np.cumsum(sizes) - sizes
            sums = np.add.reduceat(own, cuts)
            squares = np.add.reduceat(own[:, 1:] ** 2, cuts)
            margin = intercept + sums[:, 0] + 0.5 * (sums[:, 1:] ** 2 - squares).sum(1)
            error = 1 / (1 + np.exp(-np.clip(margin, -35, 35))) - labels[rows]
            each = np.repeat(error / len(rows), sizes)[:, None]
            slopes = np.hstack([x, x * (np.repeat(sums[:, 1:], sizes, axis=0) - own[:, 1:])]) * each
            gradient = np.stack([np.bincount(columns, slopes[:, k], width) for k in range(1 + FACTORS)], 1)
            gradient += DECAY * weights
            step += 1
            first = 0.9 * first + 0.1 * gradient
            second = 0.999 * second + 0.001 * gradient**2
            weights -= STEP * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
            intercept -= STEP * float(error.mean())
    return Machine(intercept, weights[:, 0].copy(), weights[:, 1:].copy(), size, metadata)


def quality_score(machine: Machine, text: Column) -> Column:
    """A score in [0, 1] for whole texts; null counts as empty. The model is of fixed size."""

    @F.pandas_udf("double")
    def score(frame: pd.DataFrame) -> pd.Series:
        out = pd.Series([machine.score(*features(t, m, machine.words)) for t, m in _rows(frame)], dtype=float)
        release()
        return out

    return score(_frame(text, machine.metadata))
