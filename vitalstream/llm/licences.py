"""Licence scans with a generalised suffix automaton over template tokens.

The automaton of all templates is built once; a document streams through it and
yields, at each word, the longest suffix read so far that occurs in some
template (matching statistics). Long matches are chained, in order in both the
text and a template, into spans; a template whose tokens a chain covers well
enough labels the document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The phrases of the contract and the labels they carry.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Opening passages and notices of public licences.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "released under the mit license"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("gpl-2", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("agpl-3", "under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc0", "has waived all copyright and related or neighboring rights to this work"),
]
MIN_MATCH, MAX_GAP, COVER = 3, 12, 0.8

#: Everything that is no word character becomes a space; A-Z becomes a-z.
FOLD = bytes(
    c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256)
)


class SuffixAutomaton:
    """Of several token sequences; a state knows all places where it ends, by template."""

    def __init__(self, sequences: list[list[int]]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[dict[int, list[int]]] = [{}]
        for t, seq in enumerate(sequences):
            last = 0
            for i, c in enumerate(seq):
                last = self._extend(last, c)
                self.ends[last].setdefault(t, []).append(i)
        for s in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            for t, places in self.ends[s].items():
                if self.link[s] > 0:
                    self.ends[self.link[s]].setdefault(t, []).extend(places)

    def _state(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        self.ends.append({})
        return len(self.next) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        copy = self._state(self.length[p] + 1)
        self.next[copy], self.link[copy] = dict(self.next[q]), self.link[q]
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, c: int) -> int:
        if (q := self.next[last].get(c)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        new, p = self._state(self.length[last] + 1), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def matches(self, tokens: list[int]) -> Iterator[tuple[int, int, int]]:
        """(end, state, length) of matching statistics, at each token of a run."""
        s, n = 0, 0
        for i, c in enumerate(tokens):
            while s and c not in self.next[s]:
                s = self.link[s]
                n = self.length[s]
            if c in self.next[s]:
                s, n = self.next[s][c], n + 1
            yield i, s, n


class Scanner:
    """Templates, base phrases and their automaton, ready to read documents."""

    def __init__(self, templates=TEMPLATES, base=BASE_PHRASES) -> None:
        self.labels = [label for label, _ in templates] + list(base.values())
        texts = [text.split() for _, text in templates] + [p.split() for p in base]
        self.vocabulary = {w.encode(): i for i, w in enumerate(dict.fromkeys(w for t in texts for w in t), 1)}
        self.sequences = [[self.vocabulary[w.encode()] for w in t] for t in texts]
        self.n_templates = len(templates)
        self.base = {len(templates) + i: self.sequences[len(templates) + i] for i in range(len(base))}
        self.least = min([MIN_MATCH, *map(len, self.base.values())])
        self.automaton = SuffixAutomaton(self.sequences)

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, str]], dict[str, float], list[tuple[str, int, int, float]]]:
        """Words, base places (start, label), best cover by label, spans (label, first word, last word, cover)."""
        words = text.translate(FOLD).split()
        known = self.vocabulary.get
        ids = np.fromiter((known(w, 0) for w in words), np.int32, len(words))
        at = np.flatnonzero(ids)
        places: list[tuple[int, str]] = []
        long: list[tuple[int, int, int, int]] = []
        if len(at):
            cut = np.flatnonzero(np.diff(at) > 1) + 1
            for run in np.split(at, cut):
                if len(run) < self.least:
                    continue
                start = int(run[0])
                tokens = ids[run[0] : run[-1] + 1].tolist()
                previous: tuple[int, int, int] | None = None
                for i, s, n in self.automaton.matches(tokens):
                    for t, seq in self.base.items():
                        if n >= len(seq) and tokens[i - len(seq) + 1 : i + 1] == seq:
                            places.append((start + i - len(seq) + 1, self.labels[t]))
                    if previous and n <= previous[2] and previous[2] >= MIN_MATCH:
                        self._note(long, start, previous)
                    previous = (i, s, n)
                if previous and previous[2] >= MIN_MATCH:
                    self._note(long, start, previous)
        covers, spans = self._chain(long)
        return len(words), places, covers, spans

    def _note(self, long: list, start: int, match: tuple[int, int, int]) -> None:
        i, s, n = match
        for t, ends in self.automaton.ends[s].items():
            if t < self.n_templates:
                long += ((t, start + i - n + 1, end - n + 1, n) for end in ends)

    def _chain(self, long: list[tuple[int, int, int, int]]) -> tuple[dict[str, float], list[tuple[str, int, int, float]]]:
        """Best colinear chains, by template: matches in order in text and template, with gaps of MAX_GAP words at most.

        A match may overlap the one before it; what both cover counts once. Of
        chains that share a place in the text the one that covers most is a span.
        """
        covers: dict[str, float] = {}
        spans = []
        by: dict[int, list[tuple[int, int, int]]] = {}
        for t, x, y, n in sorted(set(long)):
            by.setdefault(t, []).append((x, y, n))
        for t, parts in by.items():
            total, label = len(self.sequences[t]), self.labels[t]
            best: list[tuple[int, int]] = []  # words covered, first word of the text
            first = 0
            for j, (x, y, n) in enumerate(parts):
                top = (n, x)
                while parts[first][0] + total + MAX_GAP < x:  # too far back to reach x
                    first += 1
                for i in range(first, j):
                    x0, y0, n0 = parts[i]
                    shared = max(0, x0 + n0 - x, y0 + n0 - y)
                    if x0 < x and y0 < y and shared < n and x - x0 - n0 <= MAX_GAP and y - y0 - n0 <= MAX_GAP:
                        top = max(top, (best[i][0] + n - shared, best[i][1]))
                best.append(top)
            covers[label] = max(covers.get(label, 0), max(b[0] for b in best) / total)
            taken: list[tuple[int, int]] = []
            for covered, start, end in sorted((-b[0], b[1], x + n) for b, (x, _, n) in zip(best, parts, strict=True)):
                if -covered / total < COVER:
                    break
                if all(end <= a or start >= z for a, z in taken):
                    taken.append((start, end))
                    spans.append((label, start, end - 1, min(1.0, -covered / total)))
        return {k: min(1.0, v) for k, v in covers.items()}, sorted(spans, key=lambda s: s[1])


SCAN_SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "spans array<struct<label:string,first_word:long,last_word:long,cover:double>>"
)


def scan_licences(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: base places, labels, score and the covered spans.

    score is 1 with a base label, else the best cover of a template, 0 to 1.
    Null and empty texts have no words and no label; repeated rows are scanned
    each; an empty table gives an empty result. Texts of any length are scanned
    whole; where chains tie, the earlier is the span. Map-only: no shuffle, and one
    Arrow batch in memory.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        schema = None
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                n, places, covers, spans = scanner.scan(text or b"")
                base = sorted({label for _, label in places})
                every = sorted({*base, *(s[0] for s in spans)})
                starts = [p for p, _ in places]
                rows.append({
                    "doc_id": doc_id, "n_words": n, "n_base": len(places),
                    "first_word": min(starts, default=None), "last_word": max(starts, default=None),
                    "base_labels": ",".join(base), "labels": ",".join(every),
                    "score": 1.0 if base else min(1.0, max(covers.values(), default=0.0)),
                    "spans": [dict(zip(("label", "first_word", "last_word", "cover"), s, strict=True)) for s in spans],
                })
            schema = schema or pa.schema([
                ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
                ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
                ("spans", pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("cover", pa.float64())]))),
            ])
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(each, SCAN_SCHEMA)
