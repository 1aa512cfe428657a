"""Harmonic packing of tokenised documents into fixed-length sequences.

A document's ids (with the end id) are cut into whole sequences and a rest.
Lengths fall into reciprocal-capacity classes: class k holds the pieces of
which exactly k fit a sequence, ``capacity/(k+1) < length <= capacity/k``. A
rest that would leave much of its place unused is cut down to the largest
place that it fills exactly, and what remains is classed anew, a few times at
most. Each worker fills the sequences of a class with exactly k pieces,
knowing nothing of the others.

Pieces meet by (class, bucket) first; the fewer than k pieces a bucket leaves
in a class meet by class alone, and at most ``buckets * (k - 1)`` of them can,
whatever the input. What these leave, fewer than k pieces in each of
some ninety classes, goes to sequences by first fit.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from .common import cut_lineage, table, worker_memory

CAPACITY = 2048
END_ID = 1
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BUCKETS = 1024
#: A piece stays whole if it leaves at most this share of its place unused.
SLACK = 1 / 64
#: A rest is cut at most this often.
CUTS = 3
#: A worker keeps the ids of this many distinct words.
WORDS_KEPT = 400_000
# The vocabulary's splitter, with its white space written out.
SPLITTER = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\p{L}\p{N}]+"
)

PLAIN = re.compile("[!-~]+").fullmatch
# The vocabulary's symbols of bytes: a printable Latin-1 character stands for itself, the others count on from 256.
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
SYMBOLS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}


def added_tokens(path: str) -> tuple[re.Pattern, dict[str, bytes]]:
    """A splitter at the added tokens of a tokenizer's file, and the id of each as bytes."""
    with open(path, encoding="utf-8") as file:
        tokens = json.load(file)["added_tokens"]
    if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in tokens):
        raise ValueError("added tokens are taken as they stand in the raw text only")
    added = {t["content"]: array("I", [t["id"]]).tobytes() for t in tokens}
    return re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")"), added


class Words(dict):
    """The ids of words and of their parts, made when first asked for; it starts anew when it holds too many."""

    def __init__(self, path: str, most: int) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark spreads the work already
        self.merges = Tokenizer.from_file(path).model.tokenize
        self.added = added_tokens(path)
        self.most = most

    def __missing__(self, word: str) -> bytes:
        if word.isascii():
            low = word.lower()
            if low.isalpha():
                parts = (low,)
            elif low[:-1].isalpha() and "!" <= low[-1] <= "/":  # most words that end a phrase
                parts = (low[:-1], low[-1])
            else:
                parts = SPLITTER.findall(low)
        else:
            parts = SPLITTER.findall("".join(c.lower() for c in unicodedata.normalize("NFC", word)))
        found = b""
        for part in parts:
            own = self.get(part)
            if own is None:
                symbols = part if PLAIN(part) else part.encode().decode("latin-1").translate(SYMBOLS)
                own = self[part] = array("I", [t.id for t in self.merges(symbols)]).tobytes()
            found += own
        self[word] = found
        return found


def id_bytes(path: str, words_kept: int = WORDS_KEPT) -> Callable[[str], bytes]:
    """A function from a text to its ids as little-endian 32-bit bytes.

    No token of the vocabulary crosses a blank or the parts that its splitter
    makes, and blanks have no ids, so the ids of a text are those of its words'
    parts one after another. Each distinct word and part is encoded once while
    it is kept, which spares most of the work of encoding whole texts. The
    file's added tokens are found in the raw text first, as the tokenizer does;
    what stands between two of them is encoded by itself.
    """
    memory = worker_memory()
    if (path, words_kept) not in memory:
        memory[path, words_kept] = Words(path, words_kept)
    seen = memory[path, words_kept]
    literals, added = seen.added

    def plain(text: str) -> bytes:
        return b"".join(map(seen.__getitem__, text.replace("\n", " ").split(" ")))

    def encode(text: str) -> bytes:
        if len(seen) > seen.most:
            seen.clear()
        if not any(literal in text for literal in added):
            return plain(text)
        return b"".join(added[part] if i % 2 else plain(part) for i, part in enumerate(literals.split(text)))

    return encode


def cut_points(length: int, capacity: int, slack: float = SLACK, cuts: int = CUTS) -> list[int]:
    """Lengths of the pieces of a document of ``length`` ids; they add up to it."""
    pieces = [capacity] * (length // capacity)
    rest = length % capacity
    for _ in range(cuts):
        if not rest:
            break
        place = capacity // (capacity // rest)
        if place - rest <= slack * place:
            break
        exact = capacity // (capacity // rest + 1)
        pieces.append(exact)
        rest -= exact
    return pieces + [rest] * (rest > 0)


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Tokenise and cut: ``doc_id, start, length, ids_crc32, doc_tokens`` and, if asked for, ``ids``."""
    tail = np.array([end_id], dtype="<u4").tobytes()
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())]
    fields += [("ids", pa.list_(pa.int32()))] * with_ids

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = id_bytes(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                rows: list[tuple] = []
                for doc, text in zip(some.column(0).to_pylist(), some.column(1), strict=True):
                    ids = encode(text.as_py() or "") + tail
                    total, start = len(ids) // 4, 0
                    for n in cut_points(total, capacity):
                        own = ids[4 * start : 4 * (start + n)]
                        rows.append((doc, start, n, zlib.crc32(own), total) + ((np.frombuffer(own, "<i4"),) * with_ids))
                        start += n
                columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(each, schema)


def first_fit(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each length, in the order given; every bin holds ``capacity``."""
    used: list[int] = []
    places = []
    for n in lengths:
        at = next((i for i, u in enumerate(used) if u + n <= capacity), len(used))
        if at == len(used):
            used.append(0)
        places.append((at, used[at]))
        used[at] += n
    return places


def unused(names: list[str], columns: list[str]) -> list[str]:
    """The names, each with underscores before it until no column has it."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name in taken:
            name = "_" + name
        out.append(name)
    return out


def harmonic(cut: DataFrame, capacity: int = CAPACITY, buckets: int = BUCKETS) -> DataFrame:
    """Give each piece its ``sequence_id`` and ``offset``.

    ``cut`` has ``doc_id``, ``start``, ``length`` (1 to ``capacity``) and
    ``ids_crc32``; its other columns stay, whatever their names (but columns named ``sequence_id`` or ``offset``
    are replaced). Equal pieces are interchangeable. A sequence id is made of level, class, bucket and number in
    the bucket. An empty table gives no rows.
    """
    if buckets > 1 << 14 or capacity >= 1 << 12:
        raise ValueError("a sequence id has room for 16384 buckets and a capacity below 4096")
    order = ["doc_id", "start", "length", "ids_crc32"]
    cut = cut.drop("sequence_id", "offset")
    keep = [*cut.columns, "sequence_id", "offset"]
    k, bucket, n, of, bin_, full = unused(["k", "bucket", "n", "of", "bin", "full"], cut.columns)
    classed = cut.withColumns({
        k: F.expr(f"cast({capacity} div length as int)"),
        bucket: F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)).cast("int"),
    })

    def base(level: int) -> Column:
        return F.lit(level << 60).cast("long")

    def fill(df: DataFrame, level: int, by: list[str]) -> DataFrame:
        mine = Window.partitionBy(*by)
        inside = Window.partitionBy(*by, bin_).orderBy(n).rowsBetween(Window.unboundedPreceding, -1)
        own_bucket = F.col(bucket) if bucket in by else F.lit(0)
        numbered = df.withColumn(n, F.row_number().over(mine.orderBy(*order)) - 1).withColumn(of, F.count(F.lit(1)).over(mine))
        return numbered.withColumn(bin_, F.expr(f"{n} div {k}")).withColumns({
            full: F.expr(f"{bin_} < {of} div {k}"),
            "sequence_id": base(level) + F.shiftleft(F.col(k).cast("long"), 48) + F.shiftleft(own_bucket.cast("long"), 34) + F.col(bin_),
            "offset": F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("long"),
        })

    alone = classed.where(F.col(k) == 1).withColumns({"sequence_id": base(3) + F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    first = fill(classed.where(F.col(k) > 1), 0, [k, bucket])
    second = fill(first.where(~F.col(full)).select(*classed.columns), 1, [k])

    def last(rest: pd.DataFrame) -> pd.DataFrame:
        rest = rest.sort_values(["length", "doc_id", "start"], ascending=[False, True, True])
        places = first_fit(rest["length"].tolist(), capacity)
        rest["sequence_id"] = [(2 << 60) + b for b, _ in places]
        rest["offset"] = [o for _, o in places]
        return rest

    # fewer than k pieces of each class are left: some ten thousand rows at most, whatever the input
    left = second.where(~F.col(full)).select(*cut.columns).groupBy().applyInPandas(last, alone.select(*keep).schema)
    parts = [alone.select(*keep), first.where(F.col(full)).select(*keep), second.where(F.col(full)).select(*keep), left]
    return reduce(DataFrame.unionByName, parts)


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, end_id: int = END_ID, buckets: int = BUCKETS, with_ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack ``docs`` (``doc_id``, ``text``).

    One row for each piece: ``doc_id``, ``start`` (its document's ids before
    it), ``length``, ``ids_crc32``, ``doc_tokens``, ``ids`` if asked for,
    ``sequence_id`` and ``offset``. A null or empty text has the end id alone.
    Repeated rows are packed as often as they come; a null doc_id stays null.
    Other columns are ignored. An empty table gives no rows.
    """
    return harmonic(cut_lineage(pieces(docs, capacity, tokenizer, end_id, with_ids)), capacity, buckets)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: the pieces of all documents and their places."""
    return pack(table(spark, sf_dir, "documents"))
