"""License scans by a positional index of rare words.

Templates are license notices whose mandatory phrases stand in brackets. One
pass over all documents counts in how many each license word occurs; from these
counts every phrase gets its rarest word (the highest IDF), and every template
its rarest phrase. In a file only those words are looked up: postings give the
places where a phrase can stand, which are intersected with the places of its
other words at their relative positions. A template is accepted where each of
its mandatory phrases stands within `slack` words of its place relative to the
rarest one. As an accepted template holds its rarest words by definition, the
look-up loses none, and nothing is capped.

Words are runs of digits, letters and non-ASCII characters with A-Z in lower
case. A null text has no words. Texts are read in blocks of bytes, so memory
follows the license words of a slice of rows and not the texts. Rows are scored
one by one: repeated rows give repeated rows, null ids stay, an empty table
gives an empty result. Only the two named columns are read.

`score` is the IDF share of the best accepted template that stands at its place
(within `slack`); 0.5 if there are base labels alone, 0 without any label.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import claim
from .vectors import field_of

# Phrases and labels of the base, and notices of well-known licenses with their identifiers.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
TEMPLATES = (
    ("mit", "released under the [mit license]"),
    (
        "mit",
        "[permission is hereby granted free of charge to any person obtaining a copy] of this software and associated documentation files the software to deal in the"
        " software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"
        " [the above copyright notice and this permission notice shall be included in all copies] or substantial portions of the software",
    ),
    ("apache-2.0", "licensed under the [apache license] [version 2 0]"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license [you may not use this file except in compliance with the license] you may obtain a copy of the license at [www apache org licenses license 2 0]"),
    ("gpl-2.0", "licensed under the [gnu general public license] [version 2]"),
    ("gpl-3.0", "licensed under the [gnu general public license] [version 3]"),
    ("gpl-2.0", "redistribute it and or modify it under the terms of the [gnu general public license as published by the free software foundation] either [version 2 of the license] or at your option any later version"),
    ("gpl-3.0", "redistribute it and or modify it under the terms of the [gnu general public license as published by the free software foundation] either [version 3 of the license] or at your option any later version"),
    ("lgpl-2.1", "under the terms of the [gnu lesser general public license] as published by the free software foundation either [version 2 1]"),
    ("lgpl-3.0", "under the terms of the [gnu lesser general public license] as published by the free software foundation either [version 3]"),
    ("agpl-3.0", "under the terms of the [gnu affero general public license] as published by the free software foundation either [version 3]"),
    (
        "bsd-2-clause",
        "[redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met] redistributions of source code"
        " must retain the above copyright notice this list of conditions and the following disclaimer [redistributions in binary form must reproduce the above copyright notice]",
    ),
    (
        "bsd-3-clause",
        "[redistributions in binary form must reproduce the above copyright notice] this list of conditions and the following disclaimer in the documentation and or other materials"
        " provided with the distribution [neither the name of] the copyright holder nor the names of its contributors [may be used to endorse or promote products derived from this software]",
    ),
    ("isc", "[permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted]"),
    ("mpl-2.0", "this source code form is subject to the terms of the [mozilla public license] [v 2 0]"),
    ("epl-2.0", "made available under the terms of the [eclipse public license] [2 0]"),
    ("bsl-1.0", "distributed under the [boost software license] [version 1 0]"),
    ("cc-by-4.0", "licensed under [cc by 4 0]"),
    ("cc-by-sa-4.0", "licensed under [cc by sa 4 0]"),
    ("cc-by-nc-4.0", "licensed under [cc by nc 4 0]"),
    ("cc-by-nd-4.0", "licensed under [cc by nd 4 0]"),
    ("cc-by-4.0", "licensed under a [creative commons attribution 4 0] international license"),
    ("cc0-1.0", "dedicated to the public domain under [cc0 1 0]"),
    ("unlicense", "[this is free and unencumbered software released into the public domain]"),
)

BLOCK = 1 << 18  # bytes of text looked at at once
LONGEST = 16  # bytes of the longest license word
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    phrases: tuple[tuple[int, tuple[str, ...]], ...]  # place in the template, words


def template(label: str, text: str) -> Template:
    words: list[str] = []
    phrases = []
    for part in re.split(r"(\[[^\]]*\])", text):
        found = part.strip("[]").split()
        if part.startswith("["):
            phrases.append((len(words), tuple(found)))
        words += found
    if not phrases or any(len(w.encode()) > LONGEST or not _IS_WORD[list(w.encode())].all() for w in words):
        raise ValueError(f"a template needs a mandatory phrase, and words of at most {LONGEST} bytes: {text!r}")
    return Template(label, tuple(words), tuple(phrases))


class Vocabulary:
    """License words by number, and their occurrences in texts."""

    def __init__(self, words: set[str]) -> None:
        self.words = sorted(w.encode() for w in words)
        self.number = {w.decode(): i for i, w in enumerate(self.words)}
        self.sorted = np.array(self.words, f"S{LONGEST}")
        self.begins = np.zeros((1 << 16, LONGEST + 1), bool)  # first two bytes and length of some word
        for w in self.words:
            self.begins[w[0] << 8 | (w[1] if len(w) > 1 else 0), len(w)] = True

    def occurrences(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words in each text; for all license words of all texts, one after the other, how many words stand before them, and their numbers."""
        parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        data = b"\n" + b"\n".join(parts).lower() + b"\n" * (LONGEST + 2)
        a = np.frombuffer(data, np.uint8)
        limits = np.cumsum([1, *(len(p) + 1 for p in parts)])
        before = np.zeros(len(limits), np.int64)
        places, numbers, n = [], [], 0
        for at in range(1, max(int(limits[-1]), 2), BLOCK):
            end = min(at + BLOCK, int(limits[-1]))
            word = _IS_WORD[a[at - 1 : end + LONGEST + 1]]
            starts = np.flatnonzero(word[1 : end - at + 1] & ~word[: end - at]) + at
            inside = (limits >= at) & (limits < end)
            before[inside] = n + np.searchsorted(starts, limits[inside])
            stops = np.flatnonzero(~word[1:]) + at
            i = np.searchsorted(stops, starts)
            ended = i < len(stops)
            lengths = np.where(ended, stops[np.minimum(i, len(stops) - 1)] - starts, LONGEST + 1) if len(stops) else np.full(len(starts), LONGEST + 1)
            lengths = np.minimum(lengths, LONGEST + 1)
            short = np.flatnonzero(lengths <= LONGEST)
            s, m = starts[short], lengths[short]
            head = a[s].astype(np.int64) << 8 | np.where(m > 1, a[s + 1], 0)
            maybe = self.begins[head, m]
            short, s, m = short[maybe], s[maybe], m[maybe]
            if len(s):
                letters = a[s[:, None] + np.arange(LONGEST)] * (np.arange(LONGEST) < m[:, None]).astype(np.uint8)
                seen = np.ascontiguousarray(letters).view(f"S{LONGEST}").ravel()
                k = np.minimum(np.searchsorted(self.sorted, seen), len(self.sorted) - 1)
                same = self.sorted[k] == seen
                places.append(n + short[same])
                numbers.append(k[same])
            n += len(starts)
        before[limits >= limits[-1]] = n
        none = np.zeros(0, np.int64)
        return np.diff(before), np.concatenate(places) if places else none, np.concatenate(numbers) if numbers else none


@dataclass(frozen=True)
class Index:
    """Templates with IDF weights of all documents."""

    templates: tuple[Template, ...]
    idf: dict[str, float]
    slack: int

    def rarest(self, words: tuple[str, ...]) -> int:
        return max(range(len(words)), key=lambda i: (self.idf[words[i]], words[i], -i))


def all_words(templates: tuple[Template, ...]) -> set[str]:
    return {w for t in templates for w in t.words} | {w for p, _ in BASE for w in p.split()}


def indexed(docs: DataFrame, templates: tuple[Template, ...], text: str = "text", slack: int = 12) -> Index:
    """Counts, over all documents, of those that hold each license word: one row for each word and task is moved."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(__name__)
        vocabulary = Vocabulary(all_words(templates))
        size = len(vocabulary.words)
        counts = np.zeros(size + 1, np.int64)
        for batch in batches:
            for texts in slices(batch.column(0)):
                words, places, numbers = vocabulary.occurrences(texts)
                doc = np.searchsorted(np.cumsum(words), places, side="right")
                counts[:size] += np.bincount(np.unique(doc * size + numbers) % size, minlength=size)
                counts[size] += len(texts)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 1), pa.int32()), pa.array(counts)], names=["word", "docs"])

    found = docs.select(text).mapInArrow(work, "word int, docs long").groupBy("word").agg(F.sum("docs").alias("docs")).collect()
    words = Vocabulary(all_words(templates)).words
    by = {r.word: r.docs for r in found}
    n = by.get(len(words), 0)
    return Index(templates, {w.decode(): math.log((n + 1) / (by.get(i, 0) + 1)) for i, w in enumerate(words)}, slack)


def slices(column: pa.Array, rows: int = 128) -> Iterator[list[str | None]]:
    for at in range(0, len(column), rows):
        yield column.slice(at, rows).to_pylist()


class Scanner:
    """Finds base phrases and templates in slices of texts."""

    def __init__(self, index: Index) -> None:
        self.index = index
        self.vocabulary = Vocabulary(all_words(index.templates))
        self.gap = index.slack + max(len(t.words) for t in index.templates) + 1

    def stand(self, at: dict[int, np.ndarray], words: tuple[str, ...]) -> np.ndarray:
        """Places where the words stand one after the other: the rarest is looked up, the others are intersected."""
        none = np.zeros(0, np.int64)
        i = self.index.rarest(words)
        starts = at.get(self.vocabulary.number[words[i]], none) - i
        for j, w in sorted(enumerate(words), key=lambda x: -self.index.idf[x[1]]):
            if j != i and len(starts):
                starts = starts[within(at.get(self.vocabulary.number[w], none), starts + j, 0)]
        return starts

    def scan(self, texts: list[str | None]) -> dict[str, list]:
        n, places, numbers = self.vocabulary.occurrences(texts)
        begins = np.cumsum([0, *n])
        doc = np.searchsorted(begins[1:], places, side="right")
        places = places + doc * self.gap  # words of neighbouring texts never stand together
        begins = begins[:-1] + np.arange(len(texts)) * self.gap
        order = np.argsort(numbers, kind="stable")
        cuts = np.searchsorted(numbers[order], np.arange(len(self.vocabulary.words) + 1))
        at = {i: places[order[a:b]] for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if a < b}
        base: list[list[tuple[int, str]]] = [[] for _ in texts]
        spans: list[list[tuple[int, int, str, float]]] = [[] for _ in texts]
        for phrase, label in BASE:
            starts = self.stand(at, tuple(phrase.split()))
            for d, s in zip((np.searchsorted(begins, starts, side="right") - 1).tolist(), starts.tolist(), strict=True):
                base[d].append((s - int(begins[d]), label))
        for t in self.index.templates:
            found, place = self.accepted(at, t)
            if not len(found):
                continue
            shares = self.shares(at, t, found)
            for s, share in zip(found.tolist(), shares.tolist(), strict=True):
                d = int(np.searchsorted(begins, s + place, side="right")) - 1
                first = s - int(begins[d])
                spans[d].append((max(0, first), min(int(n[d]), first + len(t.words)), t.label, share))
        return {
            "n_words": n.tolist(),
            "n_base": [len(b) for b in base],
            "first_word": [min(b)[0] if b else None for b in base],
            "last_word": [max(b)[0] if b else None for b in base],
            "base_labels": [sorted({x for _, x in b}) for b in base],
            "labels": [sorted({x for _, x in b} | {x[2] for x in s}) for b, s in zip(base, spans, strict=True)],
            "score": [max((x[3] for x in s), default=0.5 if b else 0.0) for b, s in zip(base, spans, strict=True)],
            "spans": [[dict(zip(("start", "end", "label", "share"), x, strict=True)) for x in sorted(s)] for s in spans],
        }

    def accepted(self, at: dict[int, np.ndarray], t: Template) -> tuple[np.ndarray, int]:
        """Places of the template's first word, by its rarest phrase, where every phrase stands about where it should; that phrase's place."""
        rare = max(t.phrases, key=lambda p: (max(self.index.idf[w] for w in p[1]), len(p[1]), -p[0]))
        found = self.stand(at, rare[1]) - rare[0]
        for place, words in t.phrases:
            if len(found) and place != rare[0]:
                found = found[within(self.stand(at, words), found + place, self.index.slack)]
        return found, rare[0]

    def shares(self, at: dict[int, np.ndarray], t: Template, found: np.ndarray) -> np.ndarray:
        """The IDF share of the template's words that stand about where they should."""
        none, got, whole = np.zeros(0, np.int64), np.zeros(len(found)), 0.0
        for i, w in enumerate(t.words):
            whole += self.index.idf[w]
            got += self.index.idf[w] * within(at.get(self.vocabulary.number[w], none), found + i, self.index.slack)
        return np.minimum(got / whole, 1.0) if whole > 0 else np.ones(len(found))


def within(places: np.ndarray, near: np.ndarray, slack: int) -> np.ndarray:
    """For each of `near`, whether one of the sorted places is at most `slack` away."""
    i = np.searchsorted(places, near - slack)
    return (i < len(places)) & (places[np.minimum(i, max(len(places) - 1, 0))] <= near + slack) if len(places) else np.zeros(len(near), bool)


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("label", T.StringType()), T.StructField("share", T.DoubleType())]))
_FIELDS = [("n_words", T.LongType()), ("n_base", T.LongType()), ("first_word", T.LongType()), ("last_word", T.LongType()), ("base_labels", T.ArrayType(T.StringType())), ("labels", T.ArrayType(T.StringType())), ("score", T.DoubleType()), ("spans", SPANS)]
_ARROW = {"base_labels": pa.list_(pa.string()), "labels": pa.list_(pa.string()), "score": pa.float64(), "spans": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("share", pa.float64())]))}


def licensed(docs: DataFrame, index: Index, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts, labels, score and word spans of every document."""
    schema = T.StructType([field_of(docs, id_col), *(T.StructField(n, t) for n, t in _FIELDS)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(__name__)
        scanner = Scanner(index)
        for batch in batches:
            at = 0
            for texts in slices(batch.column(1)):
                found = scanner.scan(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), *(pa.array(found[n], _ARROW.get(n, pa.int64())) for n, _ in _FIELDS)], names=schema.names)
                at += len(texts)

    return docs.select(id_col, text).mapInArrow(work, schema)


def license_digests(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    templates = tuple(template(*t) for t in TEMPLATES)
    d = licensed(docs, indexed(docs, templates, text), id_col, text)
    return d.select(id_col, "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")
