"""License scan with a positional index of template words.

Each template keeps its words' positions. In a file, the rarest of a template's words (by the
documents of the corpus that hold them) are looked up; a place where they agree on one relative
position is compared with the whole template, and counts when the template's key phrase stands
there and enough of its words do.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rare words of a template that are looked up in a file, and the share of a template's words that must agree.
RARE_WORDS = 3
LEAST_SHARE = 0.7

# Words are runs of digits, a-z and all that is not ASCII; A-Z count as a-z.
_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)

# Label, phrase: places where the phrase's words stand one after the other.
PHRASES = [("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved")]

# Label, template, key phrase that must stand in it.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at "
     "http www apache org licenses license 2 0", "apache org licenses license 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that "
     "the following conditions are met", "redistribution and use in source and binary forms"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("creative-commons", "this work is licensed under a creative commons attribution 4 0 international license",
     "creative commons attribution"),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", "general public license version 2"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", "general public license version 3"),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu "
     "general public license as published by the free software foundation", "gnu general public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
     "granted", "with or without fee is hereby granted"),
    ("lgpl", "licensed under the gnu lesser general public license version 3", "lesser general public license"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
     "documentation files to deal in the software without restriction", "hereby granted free of charge"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
    ("warranty", "the software is provided as is without warranty of any kind express or implied", "without warranty of any kind"),
]


def license_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split() if text else []


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]
    key: tuple[bytes, ...]
    key_at: int


def templates(texts: list[tuple[str, str, str]] = TEMPLATES) -> list[Template]:
    """Checked templates; a key phrase must stand in its template."""
    out = []
    for label, text, key in texts:
        words, phrase = tuple(license_words(text)), tuple(license_words(key))
        at = [i for i in range(len(words) - len(phrase) + 1) if words[i : i + len(phrase)] == phrase]
        if not at or not phrase:
            raise ValueError(f"the key phrase of {label} does not stand in its template")
        out.append(Template(label, words, phrase, at[0]))
    return out


def document_frequencies(docs: DataFrame, known: list[Template], text: str = "text") -> tuple[int, dict[bytes, int]]:
    """Number of documents, and of those that hold each template word.

    Counted over all documents; only one number per template word reaches the driver.
    """
    vocabulary = frozenset(w for t in known for w in t.words)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter = Counter()
        for batch in batches:
            found[b""] += len(batch)
            for value in batch["text"]:
                found.update(vocabulary.intersection(license_words(value)))
        yield pd.DataFrame({"word": list(found), "df": list(found.values())})

    rows = (
        docs.select(F.col(text).cast("string").alias("text")).mapInPandas(count, "word binary, df long")
        .groupBy("word").agg(F.sum("df").alias("df")).collect()
    )
    counts = {bytes(r["word"]): r["df"] for r in rows}
    return counts.pop(b"", 0), counts


class Scanner:
    """Looks for phrases and templates in one file at a time."""

    def __init__(self, known: list[Template], phrases: list[tuple[str, str]], total: int, holding: dict[bytes, int]):
        self.phrases = [(label, license_words(text)) for label, text in phrases]
        self.templates = known
        self.idf = {w: math.log((1 + total) / (1 + holding.get(w, 0))) for t in known for w in t.words}
        self.postings: list[dict[bytes, list[int]]] = []
        for t in known:
            own: dict[bytes, list[int]] = {}
            for i, w in enumerate(t.words):
                own.setdefault(w, []).append(i)
            self.postings.append(own)
        self.vocabulary = frozenset(self.idf) | {w for _, p in self.phrases for w in p}
        self.needed = [frozenset(t.key) for t in known]

    def scan(self, text: str | None) -> tuple[int, list[tuple[str, int]], list[tuple[str, int, int, float]]]:
        """Number of words; (label, start) of phrases; (label, start, end, share) of templates."""
        words = license_words(text)
        present = self.vocabulary.intersection(words)
        wanted = [p for p in self.phrases if present.issuperset(p[1])]
        likely = [k for k, need in enumerate(self.needed) if present.issuperset(need)]
        if not wanted and not likely:
            return len(words), [], []
        places: dict[bytes, list[int]] = {}
        for i, w in enumerate(words):
            if w in present:
                places.setdefault(w, []).append(i)
        base = [
            (label, i) for label, phrase in wanted for i in places[phrase[0]]
            if words[i : i + len(phrase)] == phrase
        ]
        found = []
        for k in likely:
            found += self.compare(k, words, places)
        return len(words), sorted(base, key=lambda x: (x[1], x[0])), sorted(found, key=lambda x: (x[1], x[0]))

    def compare(self, k: int, words: list[bytes], places: dict[bytes, list[int]]) -> list[tuple[str, int, int, float]]:
        """Places of template k, by its rarest words that the file holds."""
        template, postings = self.templates[k], self.postings[k]
        rare = sorted((w for w in postings if w in places), key=lambda w: (-self.idf[w], w))[:RARE_WORDS]
        votes = Counter(i - j for w in rare for i in places[w] for j in postings[w])
        out = []
        for shift, agree in sorted(votes.items()):
            key_at = shift + template.key_at
            if agree < min(2, len(rare)) or key_at < 0 or tuple(words[key_at : key_at + len(template.key)]) != template.key:
                continue
            low = max(shift, 0)
            same = sum(a == b for a, b in zip(words[low:], template.words[low - shift :]))
            share = same / len(template.words)
            if share >= LEAST_SHARE:
                out.append((template.label, low, min(shift + len(template.words), len(words)), share))
        return out


def license_scan(
    docs: DataFrame, phrases: list[tuple[str, str]] = PHRASES, texts: list[tuple[str, str, str]] = TEMPLATES,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Per row: doc_id, n_words, `phrases` (label, start) and `places` (label, start, end, share).

    Positions count words from 0, ends are exclusive. Null and empty texts have no words and no
    places; repeated rows give repeated results; other columns are not read. The text is read
    twice, once for document frequencies; nothing but those counts is shuffled.
    """
    known = templates(texts)
    total, holding = document_frequencies(docs, known, text)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(known, phrases, total, holding)
        for batch in batches:
            rows = [scanner.scan(value) for value in batch["text"]]
            yield pd.DataFrame({
                "doc_id": batch["doc_id"],
                "n_words": [r[0] for r in rows],
                "phrases": [[{"label": a, "start": b} for a, b in r[1]] for r in rows],
                "places": [[{"label": a, "start": b, "end": c, "share": d} for a, b, c, d in r[2]] for r in rows],
            })

    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return chosen.mapInPandas(
        work,
        "doc_id long, n_words long, phrases array<struct<label: string, start: long>>, "
        "places array<struct<label: string, start: long, end: long, share: double>>",
    )


def license_report(docs: DataFrame, **options) -> DataFrame:
    """One row per row of `docs` with counts, first and last place, labels and a score.

    `score` is 1 where a phrase stands, else the largest share of a template that agrees, else 0.
    """
    starts = F.transform("phrases", lambda p: p["start"])
    base = F.array_distinct(F.transform("phrases", lambda p: p["label"]))
    every = F.array_union(base, F.transform("places", lambda p: p["label"]))
    best = F.array_max(F.transform("places", lambda p: p["share"]))
    return license_scan(docs, **options).select(
        "doc_id", "n_words", F.size("phrases").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(every), ",").alias("labels"),
        F.when(F.size("phrases") > 0, 1.0).otherwise(F.coalesce(best, F.lit(0.0))).alias("score"),
    )
