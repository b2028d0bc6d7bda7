"""Licence scan by a positional rare-token index.

The words of all licence templates are counted over all documents; each template is indexed by the places of its
``ANCHORS`` highest-IDF words, so a file's highest-IDF licence words are those that the index knows. Every place of such a word in
a file votes for the places where the templates would begin; votes within a template's slack of one another are one
candidate, which needs half of the template's anchors. A candidate is verified by the template's mandatory phrases, word by word,
and by the share of all its words that stand at their places; at least ``LEAST_SHARE`` have to.

Base labels come from fixed phrases and stay whatever the index finds.

What is broadcast is the templates, which no document adds to. All places are looked up, in whole texts: none is left out for being
one of many. A document is read by one task, in pieces, of which only the places of licence words are kept.

Defined results: null text is empty; repeated rows and null ids give a row each; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import release, small_batches
from .terms import LETTERS_AND_DIGITS, bytes_of, words_of

#: Label, mandatory phrases ("/" between them), and wording of public licence notices.
TEMPLATES = [
    ("mit", "mit license", "released under the mit license"),
    ("mit", "mit license", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge/without restriction", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("apache-2.0", "apache license version 2 0", "licensed under the apache license version 2 0"),
    ("gpl-3.0", "gnu general public license/version 3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3.0", "gnu general public license/version 3", "it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-2.0", "gnu general public license/version 2", "it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-2.0", "gnu general public license/version 2", "this work is licensed under the gnu general public license version 2"),
    ("lgpl-2.1", "gnu lesser general public license/version 2 1", "it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("agpl-3.0", "gnu affero general public license/version 3", "it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("mpl-2.0", "mozilla public license", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("bsd", "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by-4.0", "cc by 4 0", "licensed under cc by 4 0"),
    ("cc-by-sa-4.0", "cc by sa 4 0", "licensed under cc by sa 4 0"),
    ("cc-by-nc-4.0", "cc by nc 4 0", "licensed under cc by nc 4 0"),
    ("cc-by-4.0", "creative commons attribution 4 0", "licensed under a creative commons attribution 4 0 international license"),
    ("unlicense", "released into the public domain", "this is free and unencumbered software released into the public domain"),
]
#: Phrases that give a label wherever they stand.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Highest-IDF words by which a template is looked up, share of its words that have to stand at their places, and words by which one may
#: shift for each ten words of the template.
ANCHORS, LEAST_SHARE, SHIFT = 4, 0.8, 1

ROWS = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


class Template:
    def __init__(self, label: str, mandatory: str, text: str) -> None:
        self.label, self.words = label, text.encode().split()
        self.mandatory = [tuple(p.encode().split()) for p in mandatory.split("/")]
        self.slack = SHIFT * (len(self.words) // 10)


def vocabulary(templates: list[Template]) -> set[bytes]:
    return {w for t in templates for w in t.words} | {w for t in templates for p in t.mandatory for w in p} | {w.encode() for p, _ in BASE for w in p.split()}


def document_counts(docs: DataFrame, words: set[bytes], text_col: str = "text") -> dict[bytes, int]:
    """How many documents have each of ``words``, and under the empty word how many there are."""
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = dict.fromkeys([*words, b""], 0)
        for batch in batches:
            for text in bytes_of(batch.column(0)):
                for w in {b"", *(w for part in words_of(text, LETTERS_AND_DIGITS) for w in words.intersection(part))}:
                    own[w] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.binary()), pa.array(list(own.values()), pa.int64())], names=["word", "n"])
        release()

    rows = docs.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(count, "word binary, n long")
    return {bytes(r.word): r.n for r in rows.groupBy("word").agg(F.sum("n").alias("n")).collect()}  # a row for each word of the templates


class Scanner:
    """The index: of each anchor word the templates and the places in them."""

    def __init__(self, templates: list[Template], counts: dict[bytes, int]) -> None:
        self.templates, self.words = templates, vocabulary(templates)
        idf = lambda w: math.log((counts.get(b"", 0) + 1) / (counts.get(w, 0) + 1))
        self.index: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.need: list[int] = []
        for number, t in enumerate(templates):
            anchors = sorted(set(t.words), key=lambda w: (-idf(w), w))[:ANCHORS]
            self.need.append(-(-len(anchors) // 2))
            for w in anchors:
                self.index[w] += [(number, i) for i, x in enumerate(t.words) if x == w]
        self.base = [(tuple(w.encode() for w in p.split()), label) for p, label in BASE]
        self.rare = frozenset(self.index) | {p[-1] for p, _ in self.base}

    def scan(self, text: bytes | None) -> tuple:
        """n_words, n_base, first_word, last_word, base_labels, labels, score."""
        at, places, known = 0, [], False
        for words in words_of(text, LETTERS_AND_DIGITS):
            known = known or not self.rare.isdisjoint(words)
            places += [(i, w) for i, w in enumerate(words, at) if w in self.words]
            at += len(words)
        if not known:
            return at, 0, None, None, "", "", 0.0
        word_at = dict(places)
        stands = lambda phrase, i: all(word_at.get(i + k) == w for k, w in enumerate(phrase))
        base = [(i, label) for i, w in places for phrase, label in self.base if w == phrase[0] and stands(phrase, i)]
        found = self._found(places, word_at, stands)
        base_labels = {label for _, label in base}
        starts = [i for i, _ in base]
        score = max(found.values(), default=0.5 if base else 0.0)
        return at, len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(base_labels)), ",".join(sorted(base_labels | set(found))), score

    def _found(self, places: list[tuple[int, bytes]], word_at: dict[int, bytes], stands) -> dict[str, float]:
        """The verified labels with the largest share of a template's words at their places."""
        votes: dict[int, list[tuple[int, bytes]]] = defaultdict(list)
        for i, w in places:
            for number, k in self.index.get(w, ()):
                votes[number].append((i - k, w))
        out: dict[str, float] = {}
        for number, own in votes.items():
            t = self.templates[number]
            own.sort()
            first = 0
            for z in range(1, len(own) + 1):
                if z < len(own) and own[z][0] - own[z - 1][0] <= t.slack:
                    continue
                near, first = own[first:z], z
                if len({w for _, w in near}) < self.need[number]:
                    continue
                starts = sorted({s for s, _ in near})
                span = range(starts[0] - t.slack, starts[-1] + len(t.words) + t.slack)
                if not all(any(stands(p, i) for i in span) for p in t.mandatory):
                    continue
                share = max(sum(any(word_at.get(s + d + k) == w for d in range(-t.slack, t.slack + 1)) for k, w in enumerate(t.words)) for s in starts) / len(t.words)
                if share >= LEAST_SHARE:
                    out[t.label] = max(share, out.get(t.label, 0.0))
        return out


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str, str]] = TEMPLATES, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: one row per document."""
    own = [Template(*t) for t in templates]
    counts = document_counts(docs, vocabulary(own), text_col)
    schema = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_words", "n_base", "first_word", "last_word")], ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(own, counts)
        for batch in batches:
            rows = [scanner.scan(text) for text in bytes_of(batch.column(1))]
            columns = zip(*rows) if rows else [[]] * (len(schema) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:]))], schema=schema)
        release()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(scan, ROWS)
