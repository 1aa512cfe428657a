"""License scans: winnowed template fingerprints, then banded alignment.

Every template's word shingles are hashed and winnowed: of each window of
successive hashes the least is kept. An inverted index maps a kept
hash to the templates and places that have it. A document's shingles are looked up
in the index; hits of one template on nearby diagonals make a candidate, and a
banded alignment of the template's words against the document's words around
the hits tells how much of the template is there and where.

Any stretch of ``window + shingle - 1`` template words that a document repeats unchanged is hit. A
template of over ``LONG`` words has shingles of ``SHINGLE`` words and windows of ``WINDOW``. A shorter one keeps
all its shingles, and they have so few words that however the words that may differ lie, an
unchanged shingle remains (``guaranteed``): no such notice is missed. The templates are a short fixed list or the caller's; ``TEMPLATE_WORDS`` bounds their size.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remembered, table

SHINGLE = 3
WINDOW = 3
#: Templates of at most so many words are searched without loss.
LONG = 24
BAND = 6
#: Matched share of a template's words from which it's reported.
LEAST_COVERAGE = 0.75
#: All templates together may have so many words.
TEMPLATE_WORDS = 200_000

# Notices of common licenses, in words that their publishers recommend.
# An "-opening" is the first sentence of a longer text: coverage and span tell of that sentence only, and
# licenses that share it (as BSD's with two and three clauses do) aren't told apart.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header-opening": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "bsd-opening": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "gpl-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header-opening": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "isc-opening": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "mit": "Released under the MIT License.",
    "mit-text-opening": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}

_WORD = re.compile(r"[^\W_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    """Runs of letters and digits, each lower-cased by itself, so they stand where ``_WORD`` finds them in the text."""
    if text.isascii():
        return _WORD.findall(text.lower())
    return [word.lower() for word in _WORD.findall(text)]


def guaranteed(length: int, least: float) -> int:
    """Words of the longest unchanged run that any text with ``least`` of a template's ``length`` words has."""
    wrong = length - math.ceil(least * length - 1e-9)
    return max(1, -(-(length - wrong) // (wrong + 1)))


def shingle_hashes(numbers: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hash of each run of ``size`` word numbers."""
    n = max(0, len(numbers) - size + 1)
    mixed = np.full(n, size, dtype=np.uint64)
    for i in range(size):
        mixed = (mixed ^ numbers[i : i + n]) * _MIX
        mixed ^= mixed >> np.uint64(31)
    return mixed


def winnow(hashes: np.ndarray, window: int = WINDOW) -> list[int]:
    """Places of the least hash of each window (the last of equals); all windows if there are fewer hashes than one."""
    values = hashes.tolist()
    if not values:
        return []
    kept = set()
    for start in range(max(1, len(values) - window + 1)):
        own = values[start : start + window]
        kept.add(start + max(i for i, v in enumerate(own) if v == min(own)))
    return sorted(kept)


def match_score(length: int, least: float) -> int:
    """What a match scores, so that one outweighs all words of a short template that may differ (of a longer: three)."""
    return max(2, 1 + (length - math.ceil(least * length - 1e-9) if length <= LONG else 3))


def align(template: list[str], words: list[str], low: int, high: int, match: int = 2) -> tuple[int, int, int, int]:
    """Best local alignment with diagonals (word place - template place) in [low, high].

    A match scores ``match``, a substitution or gap -1. Returns matched words, first and one past the last word, score.
    """
    best = (0, 0, 0, 0)
    above: dict[int, tuple[int, int, int]] = {}  # by word place: score, matches, start
    for i, word in enumerate(template):
        row: dict[int, tuple[int, int, int]] = {}
        for j in range(max(0, i + low), min(len(words) - 1, i + high) + 1):
            score, matches, start = above.get(j - 1, (0, 0, j))
            own = (score + match, matches + 1, start) if words[j] == word else (score - 1, matches, start)
            for s, m, a in (above.get(j, (0, 0, j)), row.get(j - 1, (0, 0, j))):
                own = max(own, (s - 1, m, a))
            row[j] = own = own if own[0] > 0 else (0, 0, j + 1)
            if own[0] > best[3]:
                best = (own[1], own[2], j + 1, own[0])
        above = row
    return best


class Scanner:
    """The inverted index of a set of templates; ``least`` is the share of a template's words that must be matched."""

    def __init__(self, templates: dict[str, str], least: float = LEAST_COVERAGE) -> None:
        self.least = least
        self.names = sorted(templates)
        self.words = [words_of(templates[n]) for n in self.names]
        if sum(map(len, self.words)) > TEMPLATE_WORDS:
            raise ValueError(f"the templates have over {TEMPLATE_WORDS} words")
        self.numbers = {w: zlib.crc32(w.encode()) or 1 for own in self.words for w in own}
        self.index: dict[int, list[tuple[int, int]]] = {}
        self.sizes: set[int] = set()
        for t, own in enumerate(self.words):
            if not own:
                continue
            short = len(own) <= LONG
            size = min(SHINGLE, guaranteed(len(own), least)) if short else SHINGLE
            self.sizes.add(size)
            hashes = shingle_hashes(np.array([self.numbers[w] for w in own], dtype=np.uint64), size)
            for place in winnow(hashes, 1 if short else WINDOW):
                self.index.setdefault(int(hashes[place]), []).append((t, place))
        self.keys = np.array(sorted(self.index), dtype=np.uint64)

    def hits(self, words: list[str]) -> dict[int, set[int]]:
        """Diagonals (document place - template place) of each template's hits."""
        get = self.numbers.get
        numbers = np.array([get(w, 0) for w in words], dtype=np.uint64)
        known = numbers != 0
        diagonals: dict[int, set[int]] = {}
        for size in self.sizes:
            n = len(words) - size + 1
            if n < 1:
                continue
            whole = known[:n].copy()
            for i in range(1, size):
                whole &= known[i : i + n]
            spots = np.flatnonzero(whole)
            if not len(spots):
                continue
            mixed = np.full(len(spots), size, dtype=np.uint64)
            for i in range(size):
                mixed = (mixed ^ numbers[spots + i]) * _MIX
                mixed ^= mixed >> np.uint64(31)
            hit = np.isin(mixed, self.keys)
            for spot, value in zip(spots[hit].tolist(), mixed[hit].tolist(), strict=True):
                for t, place in self.index[value]:
                    diagonals.setdefault(t, set()).add(spot - place)
        return diagonals

    def scan(self, text: str) -> list[tuple[str, float, int, int, int]]:
        """(template, coverage, matched words, start, end) of each occurrence; ends in code points.

        Of occurrences that overlap, the one with the best alignment counts (then the larger coverage, then the name).
        """
        words = words_of(text)
        diagonals = self.hits(words)
        if not diagonals:
            return []
        found = []
        for t, own in diagonals.items():
            template = self.words[t]
            own, vocabulary, wanted = sorted(own), set(template), self.least * len(template)
            band = min(BAND, max(1, len(template) // 2))  # repeats of a short template stay apart
            group = [own[0]]
            for d in [*own[1:], None]:
                if d is not None and d - group[-1] <= band:
                    group.append(d)
                    continue
                begin = max(0, group[0] - band)
                stretch = words[begin : max(0, group[-1] + len(template) + band)]
                if sum(w in vocabulary for w in stretch) < wanted:  # no alignment can match enough
                    group = [d]
                    continue
                matched, a, b, score = align(template, stretch, group[0] - band - begin, group[-1] + band - begin, match_score(len(template), self.least))
                if matched >= wanted:
                    found.append((-score, -matched / len(template), self.names[t], matched, begin + a, begin + b))
                group = [d]
        out: list[tuple] = []
        starts, ends = [], []  # of those kept, which are disjoint, in order
        for _, coverage, name, matched, a, b in sorted(found):
            at = bisect_left(starts, b)
            if not at or ends[at - 1] <= a:
                starts.insert(at, a)
                ends.insert(at, b)
                out.append((name, -coverage, matched, a, b))
        if not out:
            return []
        places = [m.span() for m in _WORD.finditer(text)]
        return [(name, coverage, matched, places[a][0], places[b - 1][1]) for name, coverage, matched, a, b in sorted(out, key=lambda x: (x[3], x[0]))]


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST_COVERAGE) -> DataFrame:
    """License notices in the texts of ``docs``: one row for each occurrence.

    ``doc_id, license, coverage`` (matched share of the template's words),
    ``matched_words, start, end`` (code points, end exclusive). Null and empty
    texts have none. Repeated rows each get theirs; null ids stay null; other
    columns are ignored; an empty table or no template gives no rows.
    """
    templates = TEMPLATES if templates is None else templates
    Scanner(templates, least)  # checks the size
    key = ("license scanner", tuple(sorted(templates.items())), least)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = remembered(key, lambda: Scanner(templates, least))
        for batch in batches:
            rows = [(doc, *hit) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for hit in scanner.scan(text.as_py() or "")]
            columns = zip(*rows, strict=True) if rows else [[] for _ in range(6)]
            types = [pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "license", "coverage", "matched_words", "start", "end"])

    schema = "doc_id long, license string, coverage double, matched_words int, start long, end long"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(each, schema)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: license notices in all documents."""
    return scan_licenses(table(spark, sf_dir, "documents"))
