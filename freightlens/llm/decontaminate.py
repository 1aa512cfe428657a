"""Benchmark passages in documents: pigeonhole pieces, then bit-parallel edit distance.

Texts are compared after folding: lower case, every run of ASCII white space and
punctuation one blank, as UTF-8 bytes. An item of m bytes may differ by
``e = floor(rate * m)`` edits. Cut into e + 1 pieces, at least one piece of any
such occurrence is untouched, so an automaton over all pieces finds every
candidate place; the bit-parallel distance (one word of m bits, a few
operations for each byte) then decides about the stretch around it.

A worker holds the automaton of one block of items at a time; blocks have a
bounded number of bytes and are searched one after another, so a larger
benchmark means more passes and no larger broadcast.

An item of fewer than ``LEAST_BYTES`` folded bytes is no passage that could bear edits: its exact
words are sought, from one word's beginning to a word's end. Texts aren't dropped for such items
unless asked for, as a one-word answer stands in clean texts too.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_lineage, table, worker_memory

ERROR_RATE = 0.08
#: Items of fewer folded bytes are sought as whole words without any edit.
LEAST_BYTES = 24
#: Folded bytes of the items of one block.
BLOCK_BYTES = 1_000_000

_FOLD = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))
_SCHEMA = "doc_id long, item_id long, n_matches long, distance int, start long, end long"


def fold(text: str) -> bytes:
    """The form in which texts are compared."""
    return b" ".join(text.lower().encode().translate(_FOLD).split())


def budget(length: int, rate: float = ERROR_RATE) -> int:
    """Edits that an item of ``length`` bytes may have."""
    return math.floor(rate * length)


def cut_item(item: bytes, edits: int) -> list[tuple[int, bytes]]:
    """``edits`` + 1 pieces of nearly equal length with their offsets."""
    edges = [len(item) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, item[a:b]) for a, b in zip(edges, edges[1:], strict=False)]


def distances(pattern: bytes, text: bytes) -> list[int]:
    """For each end in ``text``, the least edits of ``pattern`` against a stretch that ends there."""
    peq: dict[int, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    m = len(pattern)
    ones, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = ones, 0, m
    out = []
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (ones & ~(xh | plus))
        down = plus & xh
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = up << 1 & ones
        down = down << 1 & ones
        plus = down | (ones & ~(xv | up))
        minus = up & xv
        out.append(score)
    return out


class Finder:
    """All items of one block: finds their occurrences in a folded text."""

    def __init__(self, items: list[tuple[int, bytes]], rate: float, least: int = LEAST_BYTES) -> None:
        self.items = [(key, item, budget(len(item), rate) if len(item) >= least else 0) for key, item in items]
        self.short = [len(item) < least for _, item in items]
        self.tree = ahocorasick.Automaton()
        for at, (_, item, edits) in enumerate(self.items):
            for offset, piece in [(0, b" " + item + b" ")] if self.short[at] else cut_item(item, edits):
                word = piece.decode("latin-1")
                self.tree.get(word, None) or self.tree.add_word(word, (len(word), []))
                self.tree.get(word)[1].append((at, offset))
        if self.items:
            self.tree.make_automaton()

    def find(self, text: bytes) -> list[tuple[int, int, int, int]]:
        """(item, distance, start, end) of the disjoint best occurrences; ends in the folded text."""
        if not self.items:
            return []
        windows: dict[int, list[list[int]]] = {}
        out = []
        after_short: dict[int, int] = {}
        # a blank stands before and after the text, so every word has one on both sides
        for end, (length, uses) in self.tree.iter(" " + text.decode("latin-1") + " "):
            end -= 1
            for at, offset in uses:
                if self.short[at]:
                    if end + 1 - length >= after_short.get(at, -1):
                        after_short[at] = end
                        out.append((at, 0, end + 2 - length, end))
                    continue
                _, item, edits = self.items[at]
                begin = end + 1 - length - offset - edits
                window = [max(0, begin), min(len(text), begin + len(item) + 2 * edits)]
                own = windows.setdefault(at, [])
                if own and window[0] <= own[-1][1]:
                    own[-1][0] = min(own[-1][0], window[0])
                    own[-1][1] = max(own[-1][1], window[1])
                else:
                    own.append(window)
        for at, stretches in windows.items():
            _, item, edits = self.items[at]
            for a, b in stretches:
                stretch = text[a:b]
                scores = distances(item, stretch)
                after = 0
                while after < len(scores):
                    near = [i for i in range(after, min(len(scores), after + len(item) + 2 * edits + 1)) if scores[i] <= edits]
                    if not near:
                        after += len(item) + 2 * edits + 1
                        continue
                    # the best end among those of the first occurrence
                    until = near[0] + 2 * edits
                    end = min((i for i in near if i <= until), key=lambda i: (scores[i], i))
                    back = distances(item[::-1], stretch[: end + 1][::-1][: len(item) + edits])
                    start = end - back.index(min(back))
                    out.append((at, scores[end], a + start, a + end + 1))
                    after = end + max(1, len(item) - edits)
        return out


_RUN = re.compile(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def places(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code point spans of the text for byte spans of its folded form."""
    starts, ends, own = [], [], []
    at = 0
    for m in _RUN.finditer(text):
        size = len(m.group().lower().encode())
        starts.append(at)
        ends.append(at + size)
        own.append(m.span())
        at += size + 1
    out = []
    for a, b in spans:
        first = next(i for i, e in enumerate(ends) if e > a)
        last = max(i for i, s in enumerate(starts) if s < b)
        out.append((own[first][0], own[last][1]))
    return out


def _blocks(benchmark: DataFrame, size: int, least: int = 1) -> Iterator[tuple[bool, list[tuple[int, bytes]]]]:
    """Blocks of folded items of about ``size`` bytes, one on the driver at a time, and whether there are several."""
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text IS NOT NULL")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    number = max(1, -(-total // size))
    for i in range(number):
        mine = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(number)) == i).collect()
        items = sorted({(r["item_id"] if r["item_id"] is not None else -1, fold(r["text"])) for r in mine})
        yield number > 1, [(key, item) for key, item in items if len(item) >= least]


def find_passages(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, least: int = LEAST_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Occurrences of benchmark items in documents.

    One row for each document and item that it has: ``doc_id, item_id,
    n_matches`` (disjoint occurrences), ``distance`` (edits of the best, in
    folded bytes), ``start, end`` (its code points in the text). Items that fold to fewer than
    ``least`` bytes are found as whole words without edits; null items and those that fold to nothing
    aren't searched; a null item_id counts as -1. Null and empty texts have none. Repeated documents each get their
    rows; repeated items count once. Other columns are ignored. With an empty
    table the result is empty. Of a benchmark of several blocks each takes a pass over the documents.
    """
    found = []
    for several, items in _blocks(benchmark, block_bytes):
        name = hashlib.sha256(repr((items, rate, least)).encode()).hexdigest()

        def each(batches: Iterator[pa.RecordBatch], items: list = items, name: str = name) -> Iterator[pa.RecordBatch]:
            memory = worker_memory()
            if memory.get("finder", ("",))[0] != name:
                memory["finder"] = (name, Finder(items, rate, least))
            finder = memory["finder"][1]
            for batch in batches:
                rows = []
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    text = text.as_py() or ""
                    hits = finder.find(fold(text))
                    by: dict[int, list] = {}
                    for at, distance, a, b in hits:
                        by.setdefault(items[at][0], []).append((distance, a, b))
                    for item, own in by.items():
                        distance, a, b = min(own)
                        rows.append((doc, item, len(own), distance, *places(text, [(a, b)])[0]))
                columns = zip(*rows, strict=True) if rows else [[] for _ in range(6)]
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "item_id", "n_matches", "distance", "start", "end"])

        part = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(each, _SCHEMA)
        # of several blocks each has run before the next comes, so the driver and a worker hold one
        found.append(cut_lineage(part) if several else part)
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def _cleaner(name: str, items: list[tuple[int, bytes]], rate: float, least: int) -> Callable[[Column], Column]:
    """A column function: whether a text has none of the items."""

    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        memory = worker_memory()
        if memory.get("finder", ("",))[0] != name:
            memory["finder"] = (name, Finder(items, rate, least))
        finder = memory["finder"][1]
        return pd.Series([not finder.find(fold("" if t is None else t)) for t in texts], dtype=bool)

    return clean


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, least: int = LEAST_BYTES, block_bytes: int = BLOCK_BYTES, short_items: bool = False) -> DataFrame:
    """The rows of ``docs`` whose text has no benchmark passage, with all their columns.

    Items of fewer than ``least`` folded bytes count only with ``short_items``. Of several blocks of items each works on
    what the one before kept, read back from the shared checkpoint folder, so one block is held at a time.
    """
    out = docs
    for number, (_, items) in enumerate(_blocks(benchmark, block_bytes, 1 if short_items else least)):
        name = hashlib.sha256(repr((items, rate, least)).encode()).hexdigest()

        if number:
            out = cut_lineage(out)
        out = out.where(_cleaner(name, items, rate, least)(F.col("text").cast("string")))
    return out


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: benchmark passages in all documents."""
    return find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
