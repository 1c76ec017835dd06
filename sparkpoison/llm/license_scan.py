"""License scan: templates found through their rarest words, placed by relative position.

A template is a short run of words with mandatory phrases. It is reported where at least
``coverage`` of its words stand at their places and every mandatory phrase is whole. Then at
most the rest of its words can be missing, so one of its rarest words, one more than may be
missing, must be there: only those are indexed, each with its place in its template. Words
are ranked by their inverse document frequency over all documents. Looking up a document's
indexed words gives possible starts (document place minus template place); a start that is
proposed is checked word for word. Nothing is capped, and the work per document is the
number of its words plus the number of proposed starts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkpoison.llm.common import map_texts, read, text_bytes
from sparkpoison.llm.words import Words, alphanumeric_words

# Base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# Notices as words, their label, and the phrases that must be whole.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license",)),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at", ("in compliance with the license",)),
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("permission is hereby granted",)),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ("general public license", "version 3")),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ("general public license", "version 2")),
    ("lgpl", "licensed under the gnu lesser general public license", ("lesser general public license",)),
    ("agpl-3.0", "licensed under the gnu affero general public license version 3", ("affero general public license",)),
    ("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("public domain",)),
)


@dataclass(frozen=True)
class Index:
    """Templates as vocabulary numbers, and where their indexed words stand."""

    vocabulary: tuple[str, ...]
    templates: tuple[tuple[str, tuple[int, ...], tuple[tuple[int, int], ...]], ...]  # label, words, places of phrases
    postings: tuple[tuple[int, int, int], ...]  # word, template, place


def vocabulary() -> tuple[str, ...]:
    return tuple(sorted({w for _, text, _ in TEMPLATES for w in text.split()} | {w for text, _ in BASE for w in text.split()}))


def build_index(frequency: dict[str, int], documents: int, coverage: float) -> Index:
    """Index each template's rarest words, one more than a match may lack."""
    words = vocabulary()
    number = {w: i for i, w in enumerate(words)}
    idf = [math.log((documents + 1) / (frequency.get(w, 0) + 1)) for w in words]
    templates, postings = [], []
    for t, (label, text, phrases) in enumerate(TEMPLATES):
        run = text.split()
        places = []
        for phrase in phrases:
            part = phrase.split()
            at = next(i for i in range(len(run)) if run[i : i + len(part)] == part)
            places.append((at, at + len(part)))
        ids = tuple(number[w] for w in run)
        templates.append((label, ids, tuple(places)))
        may_lack = len(run) - math.ceil(coverage * len(run) - 1e-9)
        rarest = sorted(range(len(run)), key=lambda i: (-idf[ids[i]], i))[: may_lack + 1]
        postings += [(ids[i], t, i) for i in rarest]
    return Index(words, tuple(templates), tuple(sorted(postings)))


class Lookup:
    """Numbers of the vocabulary's words in a chunk of texts; -1 for every other word."""

    def __init__(self, words: tuple[str, ...]):
        self.table = alphanumeric_words()
        hashes = Words([w.encode() for w in words], self.table).hashes()
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]

    def numbers(self, texts: list[bytes]) -> tuple[Words, np.ndarray]:
        w = Words(texts, self.table)
        h = w.hashes()
        at = np.minimum(np.searchsorted(self.sorted, h), len(self.sorted) - 1)
        return w, np.where(self.sorted[at] == h, self.order[at], -1)


def _runs(ids: np.ndarray, w: Words, run: list[int]) -> np.ndarray:
    """Word places where a run of vocabulary words begins, within one text."""
    at = np.flatnonzero(ids == run[0])
    at = at[at + len(run) <= w.first[w.owner[at] + 1]]
    for k, word in enumerate(run[1:], 1):
        at = at[ids[at + k] == word]
    return at


def _aligned(ids: np.ndarray, w: Words, index: Index, coverage: float) -> list[tuple[np.ndarray, np.ndarray, str]]:
    """(text, share of words in place, label) of the places of every template."""
    votes: dict[int, list[np.ndarray]] = {}
    for word in sorted({p[0] for p in index.postings}):
        at = np.flatnonzero(ids == word)
        for _, t, place in (p for p in index.postings if p[0] == word):
            votes.setdefault(t, []).append(np.stack([w.owner[at], at - place]))
    found = []
    for t, parts in votes.items():
        label, run, phrases = index.templates[t]
        owner, start = np.unique(np.concatenate(parts, axis=1), axis=1)
        lo, hi = w.first[owner], w.first[owner + 1]
        # A template may reach beyond the text's words; those places count as missing.
        place = start[:, None] + np.arange(len(run))
        inside = (place >= lo[:, None]) & (place < hi[:, None])
        same = inside & (ids[np.clip(place, 0, max(len(ids) - 1, 0))] == np.array(run))
        good = same.sum(axis=1) >= math.ceil(coverage * len(run) - 1e-9)
        for a, b in phrases:
            good &= same[:, a:b].all(axis=1)
        found.append((owner[good], same[good].mean(axis=1), label))
    return found


def document_frequency(docs: DataFrame, text: str = "text") -> tuple[dict[str, int], int]:
    """({template word: documents with it}, number of documents), over all documents."""
    words = vocabulary()

    def make():
        lookup = Lookup(words)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            w, ids = lookup.numbers(text_bytes(batch.column(0)))
            seen = np.unique(w.owner[ids >= 0] * len(words) + ids[ids >= 0]) % len(words)
            counts = np.bincount(seen, minlength=len(words))
            return pa.RecordBatch.from_arrays([pa.array([*range(len(words)), -1]), pa.array([*counts, batch.num_rows], pa.int64())], ["word", "n"])

        return step

    rows = map_texts(docs.select(F.col(text).alias("text")), "text", "word long, n long", make)
    sums = {r["word"]: r["n"] for r in rows.groupBy("word").agg(F.sum("n").alias("n")).collect()}  # a row per template word
    return {w: sums.get(i, 0) for i, w in enumerate(words)}, sums.get(-1, 0)


def scan_licenses(docs: DataFrame, keep: list[str], text: str = "text", coverage: float = 0.8) -> DataFrame:
    """``keep`` columns, n_words, n_base, first_word, last_word, base_labels, labels and score of every row.

    ``score`` is the largest share of a reported notice's words in place, a base phrase counting as 1; 0 without a
    label. Null and empty texts have no words, no places (null first and last), empty labels. Words and texts are
    taken whole, repeated rows repeat, other columns are not read.
    """
    frequency, documents = document_frequency(docs, text)
    index = build_index(frequency, documents, coverage)
    number = {w: i for i, w in enumerate(index.vocabulary)}
    base = [([number[w] for w in phrase.split()], label) for phrase, label in BASE]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}

    def make():
        lookup = Lookup(index.vocabulary)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            n = batch.num_rows
            w, ids = lookup.numbers(text_bytes(batch.column(len(keep))))
            count, first, last = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1, np.int64)
            score = np.zeros(n)
            named: list[tuple[set, set]] = [(set(), set()) for _ in range(n)]
            for run, label in base:
                at = _runs(ids, w, run)
                owner = w.owner[at]
                place = at - w.first[owner]
                count += np.bincount(owner, minlength=n)
                np.minimum.at(first, owner, place)
                np.maximum.at(last, owner, place)
                score[owner] = 1.0
                for i in np.unique(owner):
                    named[i][0].add(label)
            for owner, share, label in _aligned(ids, w, index, coverage):
                np.maximum.at(score, owner, share)
                for i in np.unique(owner):
                    named[i][1].add(label)
            none = count == 0
            return pa.RecordBatch.from_pydict({f"k{i}": batch.column(i) for i in range(len(keep))} | {
                "n_words": pa.array(np.diff(w.first), pa.int64()), "n_base": pa.array(count),
                "first_word": pa.array(first, mask=none), "last_word": pa.array(last, mask=none),
                "base_labels": pa.array([",".join(sorted(b)) for b, _ in named], pa.string()),
                "labels": pa.array([",".join(sorted(b | m)) for b, m in named], pa.string()), "score": pa.array(score),
            })

        return step

    rows = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text).alias("text"))
    schema = "".join(f"k{i} {kinds[c]}, " for i, c in enumerate(keep))
    schema += "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return map_texts(rows, "text", schema, make).toDF(*keep, *[c.split()[0] for c in schema.split(", ")[len(keep):]])


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices of every document."""
    return scan_licenses(read(spark, sf_dir, "documents", "doc_id", "text"), ["doc_id"])


QUERIES = {"op3_license_scan": op3_license_scan}
#: Placed templates are no SQL; tests/llm compares with plain Python.
ORACLE_SQL: dict[str, str] = {}
