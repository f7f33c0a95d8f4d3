"""Licence notices by a positional index of rare words.

Templates are short passages of licence texts. One pass over all documents
counts in how many of them each template word stands. A second pass takes, per
document and template, the rarest words of the template, looks their places up
in the postings (template, place) and lets each pair vote for an alignment:
document place minus template place. As many words are looked up, by falling
inverse document frequency, as it takes to meet every alignment of enough
coverage. An alignment counts when the template's key phrases stand where it
puts them (give or take ``slack`` words) and its words, weighted by inverse
document frequency or counted alike, are there to at least ``coverage``. Texts in
which the key phrases of no template stand are not looked up.

The phrases of the base are searched everywhere, whatever the index says.

Both passes are local to a document; between them one number per template word
comes to the driver, so its size is that of the templates.

Defined results. Words are runs of digits, a-z and characters beyond ASCII, A-Z
lower-cased. A null text is empty. ``score`` is the best coverage of a verified
template, at least 0.5 where a base phrase stands, otherwise 0. Each row of
``documents`` gives one row; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm import text as tx

#: The base phrases and their labels.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

#: Fixed values: (label, passage, key phrases).
TEMPLATES = [
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files", ["permission is hereby granted", "free of charge"]),
    ("apache", "licensed under the apache license version 2 0", ["apache license"]),
    ("apache", "you may not use this file except in compliance with the license", ["in compliance with the license"]),
    ("gpl", "this work is licensed under the gnu general public license version 3", ["gnu general public license"]),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the "
            "free software foundation", ["gnu general public license", "free software foundation"]),
    ("lgpl", "under the terms of the gnu lesser general public license", ["lesser general public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
     ["source and binary forms"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee",
     ["with or without fee"]),
    ("mpl", "subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", ["creative commons attribution"]),
    ("cc-by", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc 4 0"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
]

#: Alignments verified at once.
BLOCK = 4096


class Index:
    """Template words by hash, their postings, and the phrases as word numbers."""

    def __init__(self, templates=TEMPLATES, phrases=PHRASES):
        self.templates = [(label, passage.split(), [k.split() for k in keys]) for label, passage, keys in templates]
        self.phrases = [(np.array([tx.hash_word(w) for w in p.split()], dtype=np.uint64), label) for p, label in phrases]
        vocabulary = sorted({w for _, words, _ in self.templates for w in words})
        hashes = np.array([tx.hash_word(w) for w in vocabulary], dtype=np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.words = hashes[order], [vocabulary[i] for i in order]
        number = {w: i for i, w in enumerate(self.words)}
        self.passages = [np.array([number[w] for w in words]) for _, words, _ in self.templates]
        self.keys = [[(places, np.array([number[w] for w in key])) for key in keys
                      if (places := [i for i in range(len(words)) if words[i:i + len(key)] == key])]
                     for _, words, keys in self.templates]
        self.postings = [[(t, i) for t, p in enumerate(self.passages) for i in np.flatnonzero(p == w)] for w in range(len(self.words))]

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The vocabulary number of each word, -1 if it has none."""
        i = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[i] == hashes, i, -1)

    def base(self, hashes: np.ndarray, borders: np.ndarray) -> list[tuple[np.ndarray, str]]:
        """Per phrase the places where its words stand consecutively in one text."""
        out = []
        for phrase, label in self.phrases:
            at = np.flatnonzero(hashes == phrase[0])
            end = borders[np.searchsorted(borders, at, side="right")] if len(at) else at
            at = at[at + len(phrase) <= end]
            for j in range(1, len(phrase)):
                at = at[hashes[at + j] == phrase[j]]
            out.append((at, label))
        return out

    def standing(self, numbers: np.ndarray, borders: np.ndarray) -> np.ndarray:
        """(texts x templates): whether all key phrases of a template stand in a text. No other text can be verified."""
        out = np.ones((len(borders) - 1, len(self.templates)), dtype=bool)
        places = np.flatnonzero(numbers >= 0)
        own = numbers[places]
        for t, keys in enumerate(self.keys):
            for _, key in keys:
                at = places[own == key[0]]
                end = borders[np.searchsorted(borders, at, side="right")] if len(at) else at
                at = at[at + len(key) <= end]
                for j in range(1, len(key)):
                    at = at[numbers[at + j] == key[j]]
                has = np.zeros(len(out), dtype=bool)
                has[np.searchsorted(borders, at, side="right") - 1] = True
                out[:, t] &= has
        return out

    def labels(self, numbers: np.ndarray, templates: list[int], idf: np.ndarray, slack: int, coverage: float) -> dict[str, float]:
        """Verified labels of one text's word numbers, with their best coverage; only ``templates`` are tried."""
        places = np.flatnonzero(numbers >= 0)
        own = numbers[places]
        order = np.argsort(own, kind="stable")
        edges = np.searchsorted(own[order], np.arange(len(self.words) + 1))
        at = lambda w: places[order[edges[w]:edges[w + 1]]]
        out: dict[str, float] = {}
        for t in templates:
            passage = self.passages[t]
            found = self._alignments(t, numbers, at, idf, slack, coverage)
            shares = [0.0] + [self._coverage(passage, numbers, found[i:i + BLOCK], idf, slack).max() for i in range(0, len(found), BLOCK)]
            if max(shares) >= coverage:
                label = self.templates[t][0]
                out[label] = max(out.get(label, 0.0), min(1.0, float(max(shares))))
        return out

    def _alignments(self, t: int, numbers: np.ndarray, at, idf: np.ndarray, slack: int, coverage: float) -> np.ndarray:
        """Every alignment of a template that can reach ``coverage`` with its key phrases in place."""
        near = np.arange(-slack, slack + 1)
        found = None
        for places, key in self.keys[t]:
            stands = at(key[0])
            stands = stands[stands + len(key) <= len(numbers)]
            for j in range(1, len(key)):
                stands = stands[numbers[stands + j] == key[j]]
            fits = np.unique(stands[:, None, None] - np.array(places)[:, None] + near)
            found = fits if found is None else np.intersect1d(found, fits)
        if found is None or not len(found):
            return np.zeros(0, np.int64)
        # The rarest words that together are more, by weight and by number, than an alignment may miss: it meets one at least.
        passage = self.passages[t]
        weight, missed, n, votes = idf[passage].sum(), 0.0, 0, []
        for w in sorted(set(passage.tolist()), key=lambda w: (-idf[w], w)):
            votes += [at(w) - i for u, i in self.postings[w] if u == t]
            times = np.count_nonzero(passage == w)
            missed, n = missed + idf[w] * times, n + times
            if missed > (1 - coverage) * weight + 1e-9 and n > (1 - coverage) * len(passage) + 1e-9:
                break
        return np.intersect1d(found, np.unique(np.concatenate(votes)[:, None] + near))

    @staticmethod
    def _coverage(passage: np.ndarray, numbers: np.ndarray, found: np.ndarray, idf: np.ndarray, slack: int) -> np.ndarray:
        """Per alignment the share of the template's words that stand where it puts them, give or take ``slack``.

        By weight or by number, whichever is larger: words that all documents
        hold weigh nothing, and the label must not hang on how many copies there are.
        """
        met = np.zeros((len(found), len(passage)), dtype=bool)
        for j in range(-slack, slack + 1):
            i = found[:, None] + np.arange(len(passage)) + j
            met |= (numbers[np.clip(i, 0, len(numbers) - 1)] == passage) & (i >= 0) & (i < len(numbers))
        return np.maximum(met @ idf[passage] / max(idf[passage].sum(), 1e-9), met.mean(axis=1))


def _words(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for first, data, offsets in tx.pieces(tx.column(batch, "text")):
        data = tx.LOWER[data]
        starts, ends, borders = tx.words(data, offsets, tx.ALNUM)
        yield first, tx.word_hashes(data, starts, ends), borders


def _frequencies(index: Index):
    """(word, n): in how many texts a template word stands; word -1 counts all texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = np.zeros(len(index.words) + 1, dtype=np.int64)
            for _, hashes, borders in _words(batch):
                numbers = index.numbers(hashes)
                at = np.flatnonzero(numbers >= 0)
                text = np.searchsorted(borders, at, side="right") - 1
                seen = np.unique(text * len(index.words) + numbers[at]) % len(index.words)
                total[1:] += np.bincount(seen, minlength=len(index.words))
                total[0] += len(borders) - 1
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(index.words)).astype(np.int32)), pa.array(total)], ["word", "n"])
    return run


def _scan(index: Index, idf: np.ndarray, slack: int, coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, hashes, borders in _words(batch):
                n = len(borders) - 1
                count, first, last = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
                base: list[set] = [set() for _ in range(n)]
                for at, label in index.base(hashes, borders):
                    text = np.searchsorted(borders, at, side="right") - 1
                    count += np.bincount(text, minlength=n)
                    np.minimum.at(first, text, at - borders[text])
                    np.maximum.at(last, text, at - borders[text])
                    for i in np.unique(text):
                        base[i].add(label)
                numbers = index.numbers(hashes)
                standing = index.standing(numbers, borders)
                labels, score = [set(b) for b in base], np.where(count > 0, 0.5, 0.0)
                for i in np.flatnonzero(standing.any(axis=1)):
                    own = numbers[borders[i]:borders[i + 1]]
                    for label, share in index.labels(own, np.flatnonzero(standing[i]).tolist(), idf, slack, coverage).items():
                        labels[i].add(label)
                        score[i] = max(score[i], share)
                none = count == 0
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, n), pa.array(np.diff(borders).astype(np.int64)), pa.array(count),
                     pa.array(first, mask=none), pa.array(last.astype(np.int64), mask=none),
                     pa.array([",".join(sorted(b)) for b in base], pa.string()),
                     pa.array([",".join(sorted(b)) for b in labels], pa.string()), pa.array(score)],
                    ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])
    return run


def license_scan(documents: DataFrame, slack: int = 2, coverage: float = 0.8) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), one row per row of ``documents``."""
    index = Index()
    docs = documents.select("doc_id", "text")
    counts = {r.word: r.n for r in docs.select("text").transform(tx.in_arrow, _frequencies(index), "word int, n bigint")
              .groupBy("word").agg(F.sum("n").alias("n")).collect()}
    total = counts.get(-1, 0)
    idf = np.array([np.log((total + 1) / (counts.get(w, 0) + 1)) for w in range(len(index.words))])
    return docs.transform(tx.in_arrow,
        _scan(index, idf, slack, coverage),
        f"doc_id {dict(docs.dtypes)['doc_id']}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, "
        "base_labels string, labels string, score double")
