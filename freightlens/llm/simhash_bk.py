"""SimHash near-duplicate groups found by BK-trees over pigeonhole shards.

The 64 bits of a fingerprint are cut into eight blocks of eight. Two
fingerprints that differ in at most two bits agree on at least six blocks, so
they meet in one of the 28 shards that fix six blocks. A shard leaves 16 bits
free: it can never hold more than 65,536 distinct fingerprints, however large
or repetitive the corpus is. Each shard's fingerprints become one BK-tree
(children keyed by their Hamming distance to the parent) which is searched
along the edges within the radius only. The trees stay where their shard was
shuffled to; they aren't broadcast, as all shards together grow with the input.

A shard hands on a star of links for each of its local groups, not all pairs;
the stars of all shards are joined by ``components``.

Near duplicates of training text (``near_duplicates``) are another matter: texts
of which the sets of five-word shingles have a Jaccard similarity of 0.8 at least.
At 0.8 the fingerprints of sets of one size are expected about ten bits apart (by
calculation), too far for pigeonhole blocks of 64 bits. So MinHash bands
take the shards' place, the SimHashes (with BK-trees where a band is crowded)
pick whom to compare in a band, and the shingles themselves decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .banding import BKTree, Forest, banded_classes
from .common import cut_lineage, shuffle_width, table
from .components import components

RADIUS = 2
SHINGLE_WORDS = 3
SEED = 42
BLOCK_BITS = 8
BLOCKS = 64 // BLOCK_BITS
#: Near duplicates of training text: words of a shingle, and the least Jaccard similarity.
NEAR_WORDS = 5
NEAR_LEAST = 0.8
#: Bands and hashes a band: of pairs of exactly the least similarity, all but 1 in 20,000 share a band.
BANDS = 25
BAND_HASHES = 5
#: Pairs whose SimHashes of shingles differ in more bits aren't compared: at the least similarity about
#: 10 bits differ, with a deviation of 3 (by calculation), so 24 bits miss less than one pair in 100,000.
NEAR_RADIUS = 24

_PLACE = (np.arange(8) * 256).astype(np.int64)
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * BAND_HASHES), dtype=np.uint64) | np.uint64(1)


def shingles(text: str | None, words: int = NEAR_WORDS, seed: int = SEED) -> np.ndarray:
    """Sorted distinct hashes of the text's runs of ``words`` words; a shorter text is one run."""
    tokens = text.encode().lower().split() if text else []
    if not tokens:
        return np.empty(0, np.uint64)
    grams = map(b" ".join, zip(*(tokens[i:] for i in range(min(words, len(tokens)))), strict=False))
    return np.unique(np.array([xxhash.xxh64_intdigest(g, seed) for g in grams], dtype=np.uint64))


def band_keys(hashes: np.ndarray) -> list[int]:
    """Signed keys of the MinHash bands of a set of shingles; the empty set has keys too."""
    least = np.full(BANDS * BAND_HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1024):
        least = np.minimum(least, (hashes[at : at + 1024, None] * _FACTORS[0] + _FACTORS[1]).min(axis=0))
    keys = [xxhash.xxh64_intdigest(own.tobytes(), band) for band, own in enumerate(least.reshape(BANDS, BAND_HASHES))]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def mark_of(hashes: np.ndarray) -> int:
    """The unsigned fingerprint of hashes: a bit is set if it is in over half of them; none: zero."""
    # counts of each byte value at each of the eight places, then of each bit
    seen = np.bincount((np.ascontiguousarray(hashes, "<u8").view(np.uint8).reshape(-1, 8) + _PLACE).ravel(), minlength=2048)
    ones = seen.reshape(8, 256) @ _BITS
    return int(np.packbits(2 * ones.ravel() > len(hashes), bitorder="little").view("<u8")[0])


def simhash(text: str | None, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """The unsigned fingerprint of one text; no words (or null): zero."""
    tokens = text.encode().lower().split() if text else []
    if not tokens:
        return 0
    if len(tokens) < words:
        grams = [b" ".join(tokens)]
    else:
        grams = map(b" ".join, zip(*(tokens[i:] for i in range(words)), strict=False))
    digest = xxhash.xxh64_intdigest
    return mark_of(np.array([digest(g, seed) for g in grams], dtype="<u8"))


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """``doc_id`` and the signed 64-bit ``fp`` of every row of ``docs``."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([simhash(t.as_py(), words, seed) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(each, "doc_id long, fp long")


def shard_stars(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Links (value, smallest value of its local group) of one shard's distinct values, found in its BK-tree."""
    tree, forest = BKTree(), Forest()
    for value in sorted(set(values)):
        near = tree.within(value, radius)
        tree.add(value)
        new = forest.add()
        for i in near:
            forest.join(i, new)
    return [(v, tree.values[r]) for i, v in enumerate(tree.values) if (r := forest.root(i)) != i]


def _masks(radius: int) -> list[int]:
    """Signed masks that keep all blocks but ``radius`` of them."""
    masks = []
    for free in combinations(range(BLOCKS), radius):
        mask = sum(((1 << BLOCK_BITS) - 1) << (BLOCK_BITS * b) for b in range(BLOCKS) if b not in free)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    return masks


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Stars ``a``, ``b`` of fingerprints that joins all within ``radius`` bits; ``fps`` has distinct ``fp``."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = [np.empty(0, np.int64)] * 3

        def runs(cols: list[np.ndarray], last: bool) -> tuple[list[tuple[int, int]], list[np.ndarray]]:
            shard, key, fp = cols
            if not len(fp):
                return [], cols
            cut = np.flatnonzero((shard[1:] != shard[:-1]) | (key[1:] != key[:-1])) + 1
            starts = np.concatenate([[0], cut])
            ends = np.concatenate([cut, [len(fp)]])
            done = len(starts) if last else len(starts) - 1
            out: list[tuple[int, int]] = []
            for i in np.flatnonzero(ends[:done] - starts[:done] > 1):
                out += shard_stars(fp[starts[i] : ends[i]].view(np.uint64).tolist(), radius)
            return out, [] if last else [c[starts[-1] :] for c in cols]

        def batch_of(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
            both = np.array(pairs, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["a", "b"])

        for batch in batches:
            new = [batch.column(i).to_numpy().astype(np.int64, copy=False) for i in range(3)]
            pairs, kept = runs([np.concatenate([k, n]) for k, n in zip(kept, new, strict=True)], False)
            if pairs:
                yield batch_of(pairs)
        pairs, _ = runs(kept, True)
        if pairs:
            yield batch_of(pairs)

    shards = [F.struct(F.lit(i).cast("long").alias("shard"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("key")) for i, m in enumerate(_masks(radius))]
    dealt = (
        fps.select("fp", F.explode(F.array(*shards)).alias("s")).select("s.shard", "s.key", "fp")
        .repartition(shuffle_width(fps.sparkSession), "shard", "key").sortWithinPartitions("shard", "key", "fp")
    )
    return dealt.mapInArrow(search, "a long, b long").distinct()


def fingerprint_groups(docs: DataFrame, words: int = SHINGLE_WORDS, radius: int = RADIUS, seed: int = SEED) -> DataFrame:
    """Group documents whose fingerprints are linked by chains of at most ``radius`` bits.

    Returns one row for each row of ``docs``: ``doc_id``, ``fp`` (signed) and
    ``component_id``, the smallest non-null doc_id of the group. Null and empty
    texts have fingerprint zero and are linked like any other. Repeated rows
    are returned as often as they come. A row with a null doc_id takes part and
    gets the group's id (null only if the whole group has no id). Other
    columns are ignored. An empty table gives no rows.
    """
    found = cut_lineage(fingerprints(docs, words, seed))
    fps = found.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    label = components(links(fps.select("fp"), radius)).withColumnRenamed("node", "fp")
    classes = _classes(fps, label, "fp")
    return found.join(classes, "fp").select("doc_id", "fp", "component_id")


def _classes(nodes: DataFrame, label: DataFrame, name: str) -> DataFrame:
    """Each node (``name``, with its ``first_id``) and the least first_id of its ``label``; nodes without one are alone."""
    labelled = nodes.join(label, name, "left").select(name, "first_id", F.coalesce("label", name).alias("label"))
    least = labelled.groupBy("label").agg(F.min("first_id").alias("component_id"))
    return labelled.join(least, "label").select(name, "component_id", "label")


def share_alike(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether the Jaccard similarity of two sorted sets of hashes is ``least`` at least."""
    fewer, more = sorted((len(a), len(b)))
    if fewer + 1e-9 < least * more:
        return False
    common = len(a) + len(b) - len(np.unique(np.concatenate([a, b])))
    return common + 1e-9 >= least * (len(a) + len(b) - common)


def near_rows(docs: DataFrame, words: int = NEAR_WORDS, least: float = NEAR_LEAST) -> DataFrame:
    """Group documents linked by chains of texts of which the sets of word shingles are similar.

    Two texts are linked if the Jaccard similarity of their sets of ``words``-word
    shingles (ASCII lower case, split at ASCII white space; a shorter text is one
    shingle) is ``least`` at least and they share a MinHash band. Shingles are compared
    by 64 bits of hash, equal texts are told by 64 bits of hash. Returns one row for
    each row of ``docs``: ``doc_id``, ``own`` (hash of the text), ``component_id``, the smallest
    non-null doc_id of the group, and ``label``, which names the group (groups of rows that
    share a doc_id can have one component_id). Null texts and texts without words are one group.
    Repeated rows are returned as often as they come. A row with a null doc_id takes
    part and gets the group's id (null only if the whole group has no id). Other
    columns are ignored. An empty table gives no rows.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py(), words) for t in batch.column(2)]
            columns = [pa.array([band_keys(s) for s in sets], pa.list_(pa.int64())), pa.array([len(s) for s in sets], pa.int64()), pa.array(np.array([mark_of(s) for s in sets], np.uint64).view(np.int64))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc_id", "own", "keys", "size", "mark"])

    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = texts.select("doc_id", F.xxhash64("text").alias("own"), "text")
    found = cut_lineage(texts.mapInArrow(each, "doc_id long, own long, keys array<long>, size long, mark long"))
    nodes = cut_lineage(found.groupBy("own").agg(F.min("doc_id").alias("first_id"), *[F.first(c).alias(c) for c in ("keys", "size", "mark")]))
    label = banded_classes(
        nodes.select("own", "keys", "size", "mark"), texts.select("own", F.col("text").alias("body")),
        lambda text: shingles(text, words), lambda a, b: share_alike(a, b, least), NEAR_RADIUS, least,
    )
    classes = _classes(nodes.select("own", "first_id"), label, "own")
    return found.select("doc_id", "own").join(classes, "own").select("doc_id", "own", "component_id", "label")


def near_duplicates(docs: DataFrame, words: int = NEAR_WORDS, least: float = NEAR_LEAST) -> DataFrame:
    """``doc_id`` and ``component_id`` of every row, as ``near_rows`` says."""
    return near_rows(docs, words, least).select("doc_id", "component_id")


def drop_near_duplicates(docs: DataFrame, words: int = NEAR_WORDS, least: float = NEAR_LEAST) -> DataFrame:
    """Keep one row of each group: of those with its smallest doc_id the one with the least hash of the text, with all its columns.

    Rows are told by doc_id and text, so rows that share a doc_id only are decided each by its own
    text. Of rows equal in both, one stays. Rows without a doc_id are in no group that could name
    another and all stay.
    """
    groups = near_rows(docs, words, least)
    kept = groups.where("doc_id = component_id").groupBy("label").agg(F.min("own").alias("own"), F.first("component_id").alias("id"))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("own"), F.struct("*").alias("row"))
    one = rows.where("id IS NOT NULL").join(kept.select("id", "own"), ["id", "own"], "left_semi").groupBy("id", "own").agg(F.first("row").alias("row"))
    return one.select("row.*").unionByName(docs.where(F.col("doc_id").cast("long").isNull()))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: fingerprint and component of every document."""
    out = fingerprint_groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
