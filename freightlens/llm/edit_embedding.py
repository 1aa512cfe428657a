"""Document fingerprints from a randomised edit embedding.

A shared random walk reads a text: at each step a coin, fixed for (phase,
character class), decides whether the walk moves on to the next character or
writes the same one again. Two texts that differ by few edits fall back into
step soon after each edit, so edit distance becomes Hamming distance of what
was written. The coins repeat after ``PHASES`` steps; for each class and phase the
phase at which the walk leaves is a table entry, so a text costs one look-up a
character.

The fingerprint samples the written text (``SAMPLES`` places, the same for all
texts) as hashes of the few characters there. The places for a text of length
T are the first of a shared random order of all places below T: texts of
nearly equal length share nearly all of them. Bands of sampled places find
likely pairs, and the share of equal samples verifies them (``banding``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .banding import banded_classes
from .common import cut_lineage, remembered, shuffle_width, table

PHASES = 256
#: A power of two.
CLASSES = 128
SAMPLES = 64
GRAM = 4
SEED = 20
#: Sampled places are dealt into so many bands by a hash of their names, four a band on average, of which so many are used:
#: two texts with a share of 0.8 of equal samples share a band in 99 % of cases by calculation.
BANDS = 16
BANDS_USED = 10
#: Share of equal samples from which two documents are near (see ``near_groups``).
LIKENESS = 0.8
#: Characters of the texts that are held at a time, of those that walk together, and the number of texts below which each walks alone.
HELD_CHARS = 4_000_000
WALK_CHARS = 1_000_000
FEW_TEXTS = 16
#: Fingerprints of one doc_id's texts that are remembered while its rows pass; those of more texts are made again.
KNOWN_TEXTS = 10_000


def make_walk() -> tuple[list[list[int]], np.ndarray]:
    """For each class and phase: the phase of the next character, and the steps until then (at most PHASES)."""
    coins = np.random.default_rng(SEED).random((CLASSES, PHASES)) < 0.5
    coins[:, -1] |= ~coins.any(axis=1)
    wait = np.zeros((CLASSES, PHASES), dtype=np.int64)
    at = np.full(CLASSES, 0)
    for phase in range(2 * PHASES - 1, -1, -1):
        at = np.where(coins[:, phase % PHASES], 1, at + 1)
        if phase < PHASES:
            wait[:, phase] = at
    after = (np.arange(PHASES) + wait) % PHASES
    return after.tolist(), wait


def make_order(top: int) -> tuple[np.ndarray, np.ndarray]:
    """Places below 2^top in the shared random order, and their names.

    Each octave [2^a, 2^(a+1)) has places of its own; its q-th comes at time
    (q + 1/2) / 2^a, which spreads the places evenly. A name is octave and q.
    """
    many = 4 * SAMPLES
    spots, names, times = [], [], []
    for a in range(-1, top):
        low, size = (0, 1) if a < 0 else (1 << a, 1 << a)
        spots.append(low + np.random.default_rng([SEED, a + 1]).integers(0, size, many))
        names.append((a + 1) * many + np.arange(many))
        times.append((np.arange(many) + 0.5) / size)
    order = np.lexsort((np.concatenate(names), np.concatenate(times)))
    return np.concatenate(spots)[order], np.concatenate(names)[order]


def places(length: int) -> tuple[np.ndarray, np.ndarray]:
    """The first SAMPLES places below ``length`` of the shared order, and their names; sorted by name."""
    top = (length - 1).bit_length()
    spots, names = remembered(("edit order", top), lambda: make_order(top))
    first = np.flatnonzero(spots[: 4 * SAMPLES] < length)[:SAMPLES]
    if len(first) < SAMPLES:
        first = np.flatnonzero(spots < length)[:SAMPLES]
    first = first[np.argsort(names[first])]
    return spots[first], names[first]


def walk_alone(classes: np.ndarray, phase: int) -> list[int]:
    """The phase at every character of one text whose first has the phase given."""
    after, _ = remembered("edit walk", make_walk)
    phases = []
    keep = phases.append
    for row in map(after.__getitem__, classes.tolist()):
        keep(phase)
        phase = row[phase]
    return phases


def walk_together(texts: list[np.ndarray]) -> Iterator[np.ndarray]:
    """Where the walk leaves every character of texts (code points, none empty; the longest first).

    All texts take a step at a time together. Characters lie step by step: those of step i from ``starts[i]`` on, text by text.
    The last steps, which few texts take, are made text by text.
    """
    after, wait = remembered("edit walk", make_walk)
    next_phase = remembered("edit walk, flat", lambda: np.array(after, dtype=np.int32).ravel())
    waits = wait.ravel()
    lengths = np.array([len(t) for t in texts])
    active = len(texts) - np.searchsorted(lengths[::-1], np.arange(lengths[0]), side="right")
    starts = np.cumsum(active) - active
    entry = np.empty(int(lengths.sum()), dtype=np.int32)
    for j, text in enumerate(texts):
        entry[starts[: len(text)] + j] = (text & (CLASSES - 1)) * PHASES
    together = int(np.searchsorted(-active, 1 - FEW_TEXTS))
    phases = np.zeros(len(texts), dtype=np.int32)
    for start, many in zip(starts[:together].tolist(), active[:together].tolist(), strict=True):
        step = entry[start : start + many]
        step += phases[:many]
        phases = next_phase.take(step)
    for j in range(int(active[together]) if together < len(active) else 0):
        entry[starts[together : lengths[j]] + j] += np.array(walk_alone(texts[j][together:] % CLASSES, int(phases[j])), dtype=np.int32)
    for j, n in enumerate(lengths.tolist()):
        yield np.cumsum(waits.take(entry[starts[:n] + j]))


def sampled(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """GRAM characters from each sampled place on of a text of these code points, whose walk leaves its characters at ``ends``."""
    at = ends.searchsorted(places(int(ends[-1]))[0], side="right")
    return codes[np.minimum(at[:, None] + np.arange(GRAM), len(codes) - 1)]


def sample_hashes(grams: np.ndarray) -> str:
    """4 hexadecimal digits for each row of characters."""
    mixed = np.zeros(len(grams), dtype=np.uint64)
    for codes in grams.T:
        mixed = (mixed ^ codes) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return (mixed >> np.uint64(48)).astype(">u2").tobytes().hex()


def fingerprints(texts: list[str]) -> list[str]:
    """For each text the hexadecimal length of the written text, a dot, and 4 digits for each sample; "0." for the empty text.

    Texts of like length walk together, of at most ``WALK_CHARS`` characters in all (one text may have more).
    """
    marks = ["0."] * len(texts)
    order = sorted((i for i, t in enumerate(texts) if t), key=lambda i: -len(texts[i]))
    at = 0
    while at < len(order):
        end, chars = at, 0
        while end < len(order) and (end == at or chars + len(texts[order[end]]) <= WALK_CHARS):
            chars += len(texts[order[end]])
            end += 1
        group = [np.frombuffer(texts[i].encode("utf-32-le", "surrogatepass"), dtype="<u4") for i in order[at:end]]
        written = [(int(ends[-1]), sampled(codes, ends)) for codes, ends in zip(group, walk_together(group), strict=True)]
        digits, place = sample_hashes(np.concatenate([grams for _, grams in written])), 0
        for i, (total, grams) in zip(order[at:end], written, strict=True):
            marks[i] = f"{total:x}.{digits[place : place + 4 * len(grams)]}"
            place += 4 * len(grams)
        at = end
    return marks


def fingerprint(text: str) -> str:
    """The fingerprint of one text."""
    return fingerprints([text])[0]


def packed(mark: str) -> bytes:
    """A fingerprint in half the bytes."""
    length, samples = mark.split(".")
    return int(length, 16).to_bytes(8) + bytes.fromhex(samples)


def unpacked(data: bytes) -> str:
    """The fingerprint that was packed."""
    return f"{int.from_bytes(data[:8]):x}.{data[8:].hex()}"


def likeness(a: str, b: str) -> float:
    """Share of equal samples of two fingerprints among the places that either has (0 to 1)."""
    if a == b:
        return 1.0
    (m, x), (n, y) = a.split("."), b.split(".")
    if not x or not y:
        return 0.0
    x, y = np.frombuffer(bytes.fromhex(x), ">u2"), np.frombuffer(bytes.fromhex(y), ">u2")
    own, other = places(int(m, 16))[1], places(int(n, 16))[1]
    if own is other or (len(own) == len(other) and (own == other).all()):
        return float((x == y).mean())
    where = np.searchsorted(other, own)
    where[where == len(other)] = 0
    both = other[where] == own
    same = int((both & (x == y[where])).sum())
    return same / (len(own) + len(other) - int(both.sum()))


def bands(mark: str, number: int = BANDS, used: int = BANDS_USED, least: int = 3) -> list[int]:
    """Signed band keys of a fingerprint: hashes of the samples of the places that a hash of their names puts together.

    A place that only one of two texts has spoils its own band alone. Bands of fewer than
    ``least`` samples tell too little; of the others the first ``used`` are taken. Texts of so few characters that
    no band has enough are one band whole.
    """
    length, samples = mark.split(".")
    if samples:
        names = places(int(length, 16))[1]
        group = (names.astype(np.uint64) * np.uint64(2654435761) % np.uint64(1 << 32) * np.uint64(number)) >> np.uint64(32)
        order = np.argsort(group, kind="stable")
        group = group[order]
        edges = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1, [len(group)]]).tolist()
        both = np.stack([names[order], np.frombuffer(bytes.fromhex(samples), ">u2")[order]], axis=1).astype("<u4").tobytes()
        kept = [(a, b) for a, b in zip(edges, edges[1:], strict=False) if b - a >= least][:used]
        if kept:
            return [xxhash.xxh64_intdigest(both[8 * a : 8 * b], int(group[a])) - (1 << 63) for a, b in kept]
    return [name_of(mark)]


def name_of(mark: str) -> int:
    """A signed 64-bit hash that tells fingerprints apart."""
    return xxhash.xxh64_intdigest(mark) - (1 << 63)


def text_name(text: str) -> int:
    """A signed 64-bit hash that tells the texts of one id apart."""
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def marked(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``own`` (``name_of`` its fingerprint), ``body`` (the packed fingerprint), band ``keys`` and ``told`` (``text_name``) of every row, written once."""

    def done(ids: list[int | None], texts: list[str]) -> pa.RecordBatch:
        marks = fingerprints(texts)
        columns = [pa.array(ids, pa.int64()), pa.array(map(name_of, marks), pa.int64()), pa.array(map(packed, marks), pa.binary()), pa.array(map(bands, marks), pa.list_(pa.int64())), pa.array(map(text_name, texts), pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "own", "body", "keys", "told"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, chars = [], [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(doc)
                texts.append(text.as_py() or "")
                chars += len(texts[-1])
                if chars >= HELD_CHARS:
                    yield done(ids, texts)
                    ids, texts, chars = [], [], 0
            yield done(ids, texts)

    return cut_lineage(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(each, "doc_id long, own long, body binary, keys array<long>, told long"))


def near_rows(found: DataFrame, least: float = LIKENESS) -> DataFrame:
    """``doc_id``, ``own`` and ``component_id`` of every row that ``marked`` gives, as ``near_groups`` says."""
    nodes = found.select("own", "keys", F.lit(1).cast("long").alias("size"), F.lit(0).cast("long").alias("mark"))
    label = banded_classes(nodes, found.select("own", "body"), unpacked, lambda a, b: likeness(a, b) >= least)
    marks = found.groupBy("own").agg(F.min("doc_id").alias("first_id")).join(label, "own", "left").withColumn("label", F.coalesce("label", "own"))
    least_id = marks.groupBy("label").agg(F.min("first_id").alias("component_id"))
    return found.select("doc_id", "own").join(marks.join(least_id, "label").select("own", "component_id"), "own").select("doc_id", "own", "component_id")


def near_groups(docs: DataFrame, least: float = LIKENESS) -> DataFrame:
    """Group documents linked by fingerprints that share a band and are at least ``least`` alike.

    One row for each row of ``docs``: ``doc_id`` and
    ``component_id``, the smallest non-null doc_id of its group (null only if there is none). Equal texts, empty and
    null ones among them, have equal fingerprints (told by 64 bits of hash), which stand for all their
    documents. Links are found and verified by ``banding.banded_classes``: no pair of all members of a band is formed
    but where it is needed, and none that shares a band is lost. Other columns are ignored; an empty table gives no rows.
    """
    return near_rows(marked(docs), least).select("doc_id", "component_id")


def followed(docs: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """Deal the rows so that each partition has successive documents, by descending doc_id.

    Returns ``bucket, role, doc_id, text, own, component_id, body`` with rows sorted by bucket, role,
    descending id and text: role 0 rows are the documents; the first role 1 row
    of a bucket is the document after its last one (after the very last: the first). Rows of ``notes``
    (``doc_id, own, component_id, body``) have a null text and stand before the documents of their id.
    Bounds are ids of the table, so the row that a bucket needs from its neighbour is
    known by its id and sent to both. A null id comes last; null text is empty.
    """
    lowest = -(1 << 63)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    key = F.coalesce("doc_id", F.lit(lowest).cast("long"))
    width = shuffle_width(docs.sparkSession)
    shares = [i / width for i in range(1, width)] or [0.5]
    bounds = rows.agg(F.max(key), F.percentile_approx(key, shares, max(10_000, 20 * width))).first()
    cuts = np.array(sorted(set(bounds[1] or [])), dtype=np.int64)
    last = bounds[0] if bounds[0] is not None else 0

    @F.pandas_udf("array<int>")
    def targets(ids: pd.Series) -> pd.Series:
        """Own bucket times 2, and as role 1 (odd) the bucket that needs this row as its next."""
        own = np.searchsorted(cuts, ids.to_numpy(), side="left")
        out = []
        for i, b in zip(ids.tolist(), own.tolist(), strict=True):
            to = [2 * b]
            if b < len(cuts) and i == cuts[b]:
                to.append(2 * (b + 1) + 1)
            if i == last:
                to.append(1)
            out.append(to)
        return pd.Series(out)

    none = F.lit(None).cast("long")
    dealt = rows.withColumn("to", targets(key)).select(F.explode("to").alias("to"), "doc_id", "text", none.alias("own"), none.alias("component_id"), F.lit(None).cast("binary").alias("body"))
    if notes is not None:
        own = notes.withColumn("to", targets(key)[0])
        dealt = dealt.unionByName(own.select("to", "doc_id", F.lit(None).cast("string").alias("text"), "own", "component_id", "body"))
    dealt = dealt.select((F.col("to") / 2).cast("int").alias("bucket"), (F.col("to") % 2).alias("role"), "doc_id", "text", "own", "component_id", "body")
    return dealt.repartitionById(len(cuts) + 1, "bucket").sortWithinPartitions("bucket", "role", F.col("doc_id").desc_nulls_last(), F.col("text").asc_nulls_first())


def compare_edited(docs: DataFrame, least: float = LIKENESS) -> DataFrame:
    """Fingerprints of every text and of its edited form, and their likeness.

    The edited text has its last third replaced by the first characters of the
    next document by descending doc_id. Returns ``doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, component_id``, one
    row for each row of ``docs``. The last is the group of near documents by bands and verification
    (``near_groups``); it comes to the documents through the one shuffle of their texts, and so do their fingerprints, which are made once. Null texts are empty; rows that repeat an id
    follow one another by text; a null id comes last. Other columns are ignored;
    an empty table gives no rows.
    """
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, component_id long"

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "component_id"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]

    def done(rows: list[tuple]) -> pa.RecordBatch:
        """The result of rows of doc_id, n_chars, edited text, fingerprint, the next text's fingerprint and component."""
        out = [
            (doc, n, hashlib.sha256(edited.encode()).hexdigest(), mark, edited_mark, likeness(mark, edited_mark), likeness(mark, next_mark), component)
            for (doc, n, edited, mark, next_mark, component), edited_mark in zip(rows, fingerprints([r[2] for r in rows]), strict=True)
        ]
        columns = zip(*out, strict=True) if out else [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # doc_id, text, fingerprint and component of the row that awaits its next
        of_id, named, known = None, {}, {}  # of one doc_id: components by fingerprint that aren't the doc_id, and fingerprints by text
        for batch in batches:
            rows, chars = [], 0
            for bucket, role, doc, text, name, component, body in zip(*(batch.column(i) for i in range(7)), strict=True):
                bucket, role, doc, text, name = bucket.as_py(), role.as_py(), doc.as_py(), text.as_py(), name.as_py()
                if text is None:
                    if (bucket, doc) != of_id:
                        of_id, named, known = (bucket, doc), {}, {}
                    if body.is_valid and len(known) < KNOWN_TEXTS:
                        known[name] = body.as_py()
                    elif not body.is_valid:
                        named[name] = component.as_py()
                    continue
                if before is None and role:
                    continue
                made = known.get(text_name(text)) if (bucket, doc) == of_id and not role else None
                mark = fingerprint(text) if made is None else unpacked(made)
                if before is not None:
                    own_id, own, own_mark, own_component = before
                    third = len(own) // 3
                    rows.append((own_id, len(own), own[: len(own) - third] + text[:third], own_mark, mark, own_component))
                    chars += len(own)
                    if chars >= HELD_CHARS:
                        yield done(rows)
                        rows, chars = [], 0
                component = named.get(name_of(mark), doc) if (bucket, doc) == of_id else doc
                before = None if role else (doc, text, mark, component)
            yield done(rows)

    found = marked(docs)
    classes = near_rows(found, least).where(~F.col("component_id").eqNullSafe(F.col("doc_id"))).distinct()
    notes = found.select("doc_id", F.col("told").alias("own"), F.lit(None).cast("long").alias("component_id"), "body").unionByName(classes.withColumn("body", F.lit(None).cast("binary")))
    return followed(docs, notes).mapInArrow(each, schema)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: fingerprints of all documents and of their edited forms."""
    return compare_edited(table(spark, sf_dir, "documents"))
