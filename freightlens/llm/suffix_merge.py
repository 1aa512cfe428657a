"""Repeated substrings of a whole corpus by merging shard Burrows-Wheeler transforms.

A byte goes if a 100-byte string that covers it also starts earlier in the
corpus. Four steps, each a distributed one:

1. Every 100-byte window has an anchor, its 32-byte stretch with the least hash.
   Equal windows have equal anchors at equal places, so only anchors that occur
   twice can hold a repetition. Successive windows with one anchor are one
   segment; segments meet by anchor hash, as hashes without their bytes. Of equal
   segments (equal anchor and content hashes, 64 bits each) all but the earliest go.
2. Where a group holds different segments, the earliest of each kind is cut from
   its document, and these strings meet again by anchor hash.
3. The different segments of a group go into shards, each with a
   Burrows-Wheeler transform of its own. The transforms are merged by refining
   their interleave: each round sorts the interleave by the transforms' symbols,
   stably, so that after h rounds it's right for the first h symbols. Where
   neighbours part tells their common prefix; the blocks that have not parted
   after the rounds that make 100 bytes are the repeated intervals. No suffix is
   sorted again.
4. Of each interval the earliest occurrence stays, all others go; the removed
   windows are joined back to the documents.

A symbol is five successive bytes; each segment is read in its five phases, so
20 rounds make a window.

A very common passage gives a group with a different segment for every text around it.
Such a group's segments are cut into single windows that meet by a hash of their bytes, in
groups of equal windows whose first row stays; no group needs more memory than
``GROUP_SEGMENTS`` segments take.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut_lineage, remembered, shuffle_width, table

WINDOW = 100
ANCHOR = 32
STRIDE = 5
SHARDS = 2
#: Segment bytes that are merged together, at least; a group of segments is never split.
BATCH_BYTES = 100_000
#: A group with more different segments than this is settled window by window.
GROUP_SEGMENTS = 4096
#: Windows whose anchors are sought at a time.
PIECE = 1 << 20
PLACE_BITS = 22
# A place is first window and number of windows in one number.
START_BITS, COUNT_BITS = 56, 7

_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def anchor_hashes(data: np.ndarray, size: int = ANCHOR) -> np.ndarray:
    """A hash of every ``size`` successive bytes."""
    part = (data.astype(np.uint64) + np.uint64(1)) * _MIX
    part ^= part >> np.uint64(29)
    whole, done, step = None, 0, 1
    while True:
        if size & step:  # put the stretch of ``step`` bytes before those done
            whole = part if whole is None else part[: len(part) - done] * np.uint64(pow(_BASE, done, 1 << 64)) + whole[step:]
            done += step
        if 2 * step > size:
            break
        part = part[:-step] * np.uint64(pow(_BASE, step, 1 << 64)) + part[step:]
        step *= 2
    whole *= _MIX
    whole ^= whole >> np.uint64(32)
    return whole


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least ``size`` of them."""
    size = 1 << max(12, size - 1).bit_length()

    def make(base: int) -> np.ndarray:
        out = np.ones(size, dtype=np.uint64)
        out[1:] = np.uint64(base)
        return np.multiply.accumulate(out)

    return remembered(("substring powers", size), lambda: (make(_BASE), make(pow(_BASE, -1, 1 << 64))))


def _piece_segments(data: np.ndarray, window: int, size: int) -> tuple[np.ndarray, ...]:
    hashes = anchor_hashes(data, size)
    mask = np.uint64((1 << PLACE_BITS) - 1)
    packed = (hashes & ~mask) | np.arange(len(hashes), dtype=np.uint64)
    span, step = window - size + 1, 1
    while 2 * step <= span:
        packed = np.minimum(packed[:-step], packed[step:])
        step *= 2
    if step < span:
        packed = np.minimum(packed[: step - span], packed[span - step :])
    place = (packed & mask).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    counts = np.diff(np.concatenate([first, [len(place)]]))
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    letters = (data.astype(np.uint64) + np.uint64(1)) * _MIX
    letters ^= letters >> np.uint64(31)
    np.cumsum(letters * up[: len(data)], out=sums[1:])
    content = (sums[first + counts + (window - 1)] - sums[first]) * down[first]
    content = (content ^ counts.astype(np.uint64)) * _MIX
    content ^= content >> np.uint64(32)
    return hashes[place[first]], content, first, counts


def segments(data: np.ndarray, window: int = WINDOW, size: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """(anchor hash, content hash, first window, number of windows) of the stretches of windows with one anchor.

    A stretch that crosses the end of a piece of ``PIECE`` windows is two segments.
    """
    found = [_piece_segments(data[at : at + PIECE + window - 1], window, size) for at in range(0, len(data) - window + 1, PIECE)]
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    for i, part in enumerate(found):
        part[2][:] += i * PIECE
    return tuple(np.concatenate(column) for column in zip(*found, strict=True))


def _chains(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbol codes, previous row, first row of each string): a row for each byte and STRIDE end rows for each string."""
    lengths = np.array([len(s) for s in strings], dtype=np.int64)
    data = np.frombuffer((b"\0" * STRIDE).join(strings) + b"\0" * 2 * STRIDE, dtype=np.uint8)
    begin = np.concatenate([[0], np.cumsum(lengths + STRIDE)[:-1]])
    total = int((lengths + STRIDE).sum())
    letters = data[: total + STRIDE].astype(np.uint64) + np.uint64(1)
    ends = (begin + lengths)[:, None] + np.arange(STRIDE)
    letters[ends.ravel()] = 0
    letters[total:] = 0
    code = np.zeros(total, dtype=np.uint64)
    for i in range(STRIDE):
        code = code << np.uint64(9) | letters[i : total + i]
    code[ends.ravel()] = 0
    before = np.arange(total, dtype=np.int32) - np.int32(STRIDE)
    phase = np.arange(STRIDE)
    before[(begin[:, None] + phase).ravel()] = (begin[:, None] + lengths[:, None] + (phase - lengths[:, None]) % STRIDE).ravel()
    return code, before, begin


def shard_transform(symbols: np.ndarray, before: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows in suffix order, transform) of one shard; ``rounds`` is over the symbols of its longest chain."""
    rows = np.arange(len(symbols), dtype=np.int32)
    for _ in range(rounds):
        rows = before[rows]
        rows = rows[np.argsort(symbols[rows], kind="stable")]
    return rows, symbols[before[rows]]


def merge_transforms(transforms: list[np.ndarray], rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave of the transforms' rows that is right for ``rounds`` symbols: (shard of each place, its block).

    Places with one block have equal first ``rounds`` symbols; the round in which two
    neighbours' blocks part is one more than the symbols that they share.
    """
    shard = np.repeat(np.arange(len(transforms), dtype=np.uint8), [len(t) for t in transforms])
    block = np.zeros(len(shard), dtype=np.int32)
    symbols = np.empty(len(shard), dtype=transforms[0].dtype)
    for _ in range(rounds):
        for s, own in enumerate(transforms):
            np.place(symbols, shard == s, own)
        order = np.argsort(symbols, kind="stable")
        shard = shard[order]
        inner, letters = block[order], symbols[order]
        parts = (inner[1:] != inner[:-1]) | (letters[1:] != letters[:-1])
        block = np.concatenate([[0], np.cumsum(parts, dtype=np.int32)]).astype(np.int32)
    return shard, block


def repeated_windows(strings: list[bytes], counts: list[int], ranks: np.ndarray, window: int = WINDOW) -> list[np.ndarray]:
    """For each string, which of its windows also start earlier.

    A string has ``counts`` windows at its front; ``ranks`` (an integer for each) order the
    strings' first windows and grow by one from window to window.
    """
    rounds = window // STRIDE
    code, before, begin = _chains(strings)
    kinds, symbols = np.unique(code, return_inverse=True)
    symbols = symbols.astype(np.uint16 if len(kinds) <= 1 << 16 else np.int32)
    edges = [len(strings) * s // SHARDS for s in range(SHARDS + 1)]
    row_edges = [int(begin[e]) if e < len(begin) else len(code) for e in edges]
    longest = max(map(len, strings)) // STRIDE + 3
    made = []
    for a, b in zip(row_edges, row_edges[1:], strict=False):
        rows, transform = shard_transform(symbols[a:b], before[a:b] - a, longest)
        made.append((rows + a, transform))
    shard, block = merge_transforms([t for _, t in made], rounds)
    rows = np.empty(len(shard), dtype=np.int64)
    for s, (own, _) in enumerate(made):
        rows[shard == s] = own
    of = np.searchsorted(begin, rows, side="right") - 1
    offset = rows - begin[of]
    starts = offset < np.asarray(counts)[of]
    rows, block, key = rows[starts], block[starts], (ranks[of] + offset)[starts]
    first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    least = np.repeat(np.minimum.reduceat(key, first), np.diff(np.concatenate([first, [len(key)]])))
    later = np.zeros(len(code), dtype=bool)
    later[rows] = key > least
    return [later[b : b + n] for b, n in zip(begin.tolist(), counts, strict=True)]


class Groups:
    """Segments by anchor, each group in the order of its places; gives the windows to remove."""

    def __init__(self) -> None:
        self.anchor: int | None = None
        self.found: dict[bytes, tuple] = {}
        self.strings: list[bytes] = []
        self.counts: list[int] = []
        self.holders: list[tuple] = []
        self.size = 0

    def add(self, anchor: int, place: tuple, string: bytes, out: list[tuple]) -> None:
        """One segment at (key, first window); an equal one that came before keeps its place."""
        if anchor != self.anchor:
            self.close(out)
            self.anchor = anchor
        first = self.found.setdefault(string, place)
        if first != place:
            out.append((*place, len(string) - WINDOW + 1))

    def close(self, out: list[tuple]) -> None:
        """The group is whole: different segments are to be merged."""
        if len(self.found) > 1:
            for string, place in self.found.items():
                self.strings.append(string)
                self.counts.append(len(string) - WINDOW + 1)
                self.holders.append(place)
                self.size += len(string)
            if self.size >= BATCH_BYTES:
                self.flush(out)
        self.found = {}

    def flush(self, out: list[tuple]) -> None:
        """Merge what is held."""
        if not self.strings:
            return
        order = sorted(range(len(self.holders)), key=self.holders.__getitem__)
        ranks = np.zeros(len(order), dtype=np.int64)
        last, base = None, 0
        for i in order:  # one number line for all documents, in their order
            doc, start = self.holders[i]
            if last is not None and doc != last[0]:
                base = last[1] + WINDOW - start
            ranks[i] = base + start
            last = (doc, max(ranks[i] + self.counts[i], last[1] if last else 0))
        for later, (doc, start) in zip(repeated_windows(self.strings, self.counts, ranks), self.holders, strict=True):
            edges = np.flatnonzero(np.diff(np.concatenate([[0], later.view(np.int8), [0]])))
            out += [(doc, start + a, b - a) for a, b in edges.reshape(-1, 2).tolist()]
        self.strings, self.counts, self.holders, self.size = [], [], [], 0


def removed_windows(docs: DataFrame) -> DataFrame:
    """For each document with any, the ``runs`` (start, windows) that also start earlier; ``docs`` has ``key`` (a number of its own for each, in the documents' order) and ``body``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for at in range(0, batch.num_rows, 128):
                some = batch.slice(at, 128)
                found = [segments(np.frombuffer(body.as_py(), np.uint8)) for body in some.column(1)]
                sizes = [len(f[0]) for f in found]
                keys = np.repeat(some.column(0).to_numpy(zero_copy_only=False), sizes).astype(np.int64)
                anchors, content, starts, counts = (np.concatenate(c) for c in zip(*found, strict=True))
                made.append((anchors, content, keys, (starts.astype(np.int64) << COUNT_BITS) | counts))
            if not made:
                continue
            anchors, content, keys, place = (np.concatenate(c) for c in zip(*made, strict=True))
            if len(place):
                # of equal segments in the batch all but the earliest go at once, each to a group of its own: no anchor
                # gets more rows from a batch than it has different segments there
                order = np.lexsort((place, keys, content, anchors))
                a, b = order[:-1], order[1:]
                new = np.flatnonzero(np.concatenate([[True], (anchors[a] != anchors[b]) | (content[a] != content[b])]))
                first = np.repeat(order[new], np.diff(np.concatenate([new, [len(order)]])))
                gone = np.zeros(len(order), dtype=bool)
                gone[order] = (keys[order] != keys[first]) | (place[order] != place[first])
                alone = (keys.view(np.uint64) ^ place.view(np.uint64) * _MIX) * np.uint64(_BASE)
                anchors = np.where(gone, alone, anchors)
                place = np.where(gone, place | np.int64(-(1 << 63)), place)
            columns = (anchors.view(np.int64), content.view(np.int64), keys, place)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor", "content", "key", "place"])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = Groups()

        def table_of(out: list[tuple]) -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else [[] for _ in range(3)]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, [pa.int64()] * 2 + [pa.int32()], strict=True)], names=["key", "start", "windows"])

        for batch in batches:
            out: list[tuple] = []
            for anchor, key, start, string in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                groups.add(anchor, (key, start), string, out)
            yield table_of(out)
        out = []
        groups.close(out)
        groups.flush(out)
        yield table_of(out)

    width = shuffle_width(docs.sparkSession)
    kind, group = Window.partitionBy("anchor", "content").orderBy("key", "place"), Window.partitionBy("anchor")
    places = docs.mapInArrow(cut, "anchor long, content long, key long, place long").repartition(width, "anchor")
    places = places.withColumn("nth", F.rank().over(kind)).withColumn("kinds", F.count_if(F.col("nth") == 1).over(group))
    gone = (F.col("nth") > 1) | (F.col("place") < 0)
    places = places.where(gone | (F.col("kinds") > 1)).select(
        "key", gone.alias("gone"),
        F.expr(f"shiftright(place, {COUNT_BITS}) & {(1 << START_BITS) - 1}").alias("start"), F.expr(f"cast(place & {(1 << COUNT_BITS) - 1} as int)").alias("windows"),
        "anchor", (F.col("kinds") > GROUP_SEGMENTS).alias("crowded"),
    )
    # one list for both uses, so that the plan below it runs once
    of_doc = places.groupBy("key").agg(F.collect_list(F.struct("gone", "start", "windows", "anchor", "crowded")).alias("all"))
    single = F.transform(F.sequence(F.lit(0), F.col("part.windows") - 1), lambda i: F.struct((F.col("part.start") + i).alias("start"), F.lit(1).alias("windows")))
    parts = (
        of_doc.join(docs, "key").select("key", "body", F.explode(F.filter("all", lambda x: ~x["gone"])).alias("part"))
        .select("key", "body", "part", F.explode(F.when(F.col("part.crowded"), single).otherwise(F.array(F.struct("part.start", "part.windows")))).alias("at"))
        .select("key", "at.start", "part", F.substring("body", (F.col("at.start") + 1).cast("int"), F.col("at.windows") + WINDOW - 1).alias("string"))
        .select(F.when(F.col("part.crowded"), F.xxhash64("part.anchor", "string")).otherwise(F.col("part.anchor")).alias("anchor"), "key", "start", "string")
    )
    dealt = parts.repartition(width, "anchor").sortWithinPartitions("anchor", "key", "start")
    merged = dealt.mapInArrow(settle, "key long, start long, windows int")
    late = merged.groupBy("key").agg(F.collect_list(F.struct("start", "windows")).alias("late"))
    early = F.transform(F.filter("all", lambda x: x["gone"]), lambda x: F.struct(x["start"].alias("start"), x["windows"].alias("windows")))
    return of_doc.join(late, "key", "left").select("key", F.concat(early, F.coalesce("late", F.array())).alias("runs"))


def keyed(docs: DataFrame) -> tuple[DataFrame, Column]:
    """Rows of ``key`` (a number that orders the documents) and ``body`` (UTF-8 bytes), and the column of them that is doc_id.

    Where no doc_id comes twice (null counts as an id, as the last), it's the key itself, and nothing else is carried:
    so the texts are shuffled once for both joins that need them. Otherwise rows (with ``doc_id`` and ``hash``)
    are ordered by doc_id and 128 bits of the text's hash and numbered in that order, through a sort of the ids and
    hashes alone; rows equal in both are one document.
    """
    body = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8")
    last, own = F.lit((1 << 63) - 1), F.col("doc_id").cast("long")
    key = F.coalesce(own, last)
    most, none = docs.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"), F.count_if(own.isNull()).alias("none")).agg(F.max("n"), F.max("none")).first()
    if (most or 0) <= 1:
        return docs.select(key.alias("key"), body.alias("body")), F.when(F.col("key") != last, F.col("key")) if none else F.col("key")
    named = docs.select(own.alias("doc_id"), body.alias("body"), key.alias("key")).withColumns({"none": F.col("doc_id").isNull(), "hash": F.md5("body")})
    names = named.select("key", "none", "hash").distinct().repartitionByRange(shuffle_width(docs.sparkSession), "key", "none", "hash")
    numbered = cut_lineage(names.sortWithinPartitions("key", "none", "hash").withColumn("number", F.monotonically_increasing_id()))
    return named.join(numbered, ["key", "none", "hash"]).select("doc_id", "body", F.col("number").alias("key"), "hash"), F.col("doc_id")


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """Every document without the bytes of 100-byte strings that also start earlier.

    ``docs`` has ``doc_id`` and ``text``. One row for each of its rows: ``doc_id, n_bytes, n_removed,
    n_spans`` (maximal removed runs), ``kept_sha256`` and, if asked for, ``spans`` (start and end bytes) and
    ``kept`` (bytes). Earlier means a smaller doc_id, or the same document and an earlier
    start; a null doc_id comes last. Rows that are equal in both columns are one document; rows that
    share a doc_id only (or have none) are ordered by the text's MD5. Null texts are empty. Other columns are
    ignored; an empty table gives no rows.
    """
    rows, doc_id = keyed(docs)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", spans array<array<long>>, kept binary" * with_text

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, own in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                text, own = text.as_py(), own.as_py()
                spans: list[list[int]] = []
                for start, end in sorted((r["start"], r["start"] + r["windows"] + WINDOW - 1) for r in own or ()):
                    if spans and start <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], end)
                    else:
                        spans.append([start, end])
                at, kept = 0, []
                for start, end in spans:
                    kept.append(text[at:start])
                    at = end
                left = b"".join([*kept, text[at:]])
                row = (doc, len(text), len(text) - len(left), len(spans), hashlib.sha256(left).hexdigest())
                out.append(row + ((spans, left) if with_text else ()))
            types = [pa.int64()] * 4 + [pa.string()] + [pa.list_(pa.list_(pa.int64())), pa.binary()] * with_text
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"]
            columns = zip(*out, strict=True) if out else [[] for _ in types]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names[: len(types)])

    documents = rows if "hash" not in rows.columns else rows.groupBy("key").agg(F.first("body").alias("body"))
    return rows.join(removed_windows(documents), "key", "left").select(doc_id.alias("doc_id"), "body", "runs").mapInArrow(apply, schema)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: what remains of every document."""
    return remove_repeats(table(spark, sf_dir, "documents"))
