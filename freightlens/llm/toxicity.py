"""Toxicity by logistic regression over hashed words, word pairs and skip-grams, fitted with FTRL-proximal.

A text's features are its distinct words, pairs of neighbouring words and pairs with one word between, each
hashed to ``BITS`` bits. A longer word also stands for its beginnings of ``HEADS`` bytes, so that rare forms of a known stem count. FTRL-proximal takes the labelled texts one at a time: every coordinate
has a learning rate of its own, which falls with the gradients it has seen, and an L1 penalty holds the weights
of coordinates without lasting evidence at exactly zero. What remains is a short list of keys and
weights that is sent to every task.

The labelled texts are a bounded sample: at most ``TRAIN_DOCS`` of them in the order of a hash of their id, and of these as many
as have ``TRAIN_FEATURES`` features in all; a longer text than the rest of that allows is passed over. Tasks extract
features; the driver gets the sample's keys (8 bytes each). All texts are scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .byte_words import WordRun, word_runs
from .common import id_crc32, remembered, table

THRESHOLD = 0.5
TRAIN_DOCS = 3500
TRAIN_FEATURES = 5_000_000
PASSES = 3
#: Keys of fewer labelled texts than this have no weight.
SEEN_IN = 4
#: Bits of a feature's key: so many that distinct features of a corpus hardly ever share a weight.
BITS = 48
HEADS = (4, 5, 6)
#: Low bits of a key that a table sifts by before the keys are compared.
_SIFT = 18
_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


def _mixed(value: np.ndarray) -> np.ndarray:
    """Keys of ``BITS`` bits from 64-bit values."""
    value = (value ^ (value >> np.uint64(31))) * _MIX[0]
    value = (value ^ (value >> np.uint64(29))) * _MIX[1]
    return (value ^ (value >> np.uint64(32))) & np.uint64((1 << BITS) - 1)


def keys_of(run: WordRun) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the words, their beginnings, pairs and skip-grams of a run, repeats included."""
    word = run.crc.astype(np.uint64) | run.length.astype(np.uint64) << np.uint64(32)
    rows, keys = [run.doc[run.again :]], [_mixed(word[run.again :])]
    for apart, mix in ((1, _MIX[1]), (2, _MIX[2])):
        second = run.pairs(apart)
        rows.append(run.doc[second])
        keys.append(_mixed(word[second - apart] * mix + word[second] * _MIX[0] + np.uint64(apart)))
    for size, (place, crc) in zip(HEADS, run.heads):
        rows.append(run.doc[place])
        keys.append(_mixed((crc.astype(np.uint64) | np.uint64(size << 32)) ^ _MIX[2]))
    return np.concatenate(rows), np.concatenate(keys)


class Ftrl:
    """FTRL-proximal for logistic loss over coordinates 0 to n - 1; coordinate 0 is the constant, without L1."""

    def __init__(self, coordinates: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 6.0, l2: float = 0.0) -> None:
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(coordinates), np.zeros(coordinates)

    def weights(self, at: np.ndarray) -> np.ndarray:
        """The weights at some coordinates, as the sums so far have them."""
        z, l1 = self.z[at], np.where(at == 0, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, label: int) -> None:
        """Take one text: its distinct coordinates and its label."""
        w = self.weights(at)
        slope = sigmoid(w.sum()) - label
        grown = self.n[at] + slope * slope
        self.z[at] += slope - (np.sqrt(grown) - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] = grown


def sigmoid(x: np.ndarray | float) -> np.ndarray | float:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Model:
    """Keys in ascending order, their weights, and the constant."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, constant: float) -> None:
        self.keys, self.weights, self.constant = keys, weights, constant

    def sift(self) -> np.ndarray:
        """Which low bits the keys have."""
        found = np.zeros(1 << _SIFT, bool)
        found[self.keys & np.uint64((1 << _SIFT) - 1)] = True
        return found

    def score(self, texts: pa.Array, sift: np.ndarray | None = None) -> np.ndarray:
        """Scores of whole texts, 0 to 1; a weight counts once a text."""
        sift = self.sift() if sift is None else sift
        total = np.full(len(texts), self.constant)
        found = []
        for run in word_runs(texts, heads=HEADS):
            rows, keys = keys_of(run)
            near = np.flatnonzero(sift[keys & np.uint64((1 << _SIFT) - 1)])
            place = np.searchsorted(self.keys, keys[near])
            hit = (place < len(self.keys)) & (self.keys[np.minimum(place, len(self.keys) - 1)] == keys[near]) if len(self.keys) else np.zeros(len(near), bool)
            found.append(np.unique(rows[near[hit]] * len(self.keys) + place[hit]))
        hits = np.unique(np.concatenate([np.empty(0, np.int64), *found]))
        if len(hits):
            np.add.at(total, hits // len(self.keys), self.weights[hits % len(self.keys)])
        return sigmoid(total)


def fit(texts: list[np.ndarray], labels: list[int], passes: int = PASSES, seen_in: int = SEEN_IN) -> Model:
    """Weights from texts (their distinct keys) and labels; keys of fewer than ``seen_in`` texts get none."""
    if not texts:
        return Model(np.empty(0, np.uint64), np.empty(0), 0.0)
    # most keys are rare: those whose low bits few texts have go first, in little memory
    low, spread = np.uint64((1 << 22) - 1), np.zeros(1 << 22, np.int32)
    for t in texts:
        spread[t & low] += 1
    texts = [t[spread[t & low] >= seen_in] for t in texts]
    keys, place, count = np.unique(np.concatenate(texts), return_inverse=True, return_counts=True)
    often = count >= seen_in
    number = np.where(often, np.cumsum(often), 0)[place]  # 0: the constant
    keys, cuts = keys[often], np.cumsum([len(t) for t in texts])[:-1]
    coordinates = [np.concatenate([[0], n[n > 0]]) for n in np.split(number, cuts)]
    model = Ftrl(len(keys) + 1)
    for _ in range(passes):
        for at, label in zip(coordinates, labels):
            model.learn(at, label)
    weights = model.weights(np.arange(len(keys) + 1))
    used = np.flatnonzero(weights[1:])
    return Model(keys[used], weights[1:][used], float(weights[0]))


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS, most: int = TRAIN_FEATURES) -> Model:
    """Fit on at most ``limit`` labelled rows with ``most`` features in all.

    Only rows whose crc32(doc_id as text) mod 5 isn't 0 are used; of repeated
    labels the highest counts; null labels aren't used; of repeated documents the
    first by text is.
    """
    chosen = (
        labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).where("toxic IS NOT NULL").where(id_crc32() % 5 != 0)
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    )

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                keys = np.unique(np.concatenate([np.empty(0, np.uint64), *(np.unique(keys_of(run)[1]) for run in word_runs(batch.column(2).slice(row, 1), heads=HEADS))]))
                fits = len(keys) <= most
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, 1), batch.column(1).slice(row, 1), pa.array([len(keys)], pa.int64()), pa.array([keys.tobytes() if fits else b""])],
                    names=["doc_id", "toxic", "n", "keys"],
                )

    held = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", F.coalesce("text", F.lit("")).alias("text"))
    found = held.mapInArrow(each, "doc_id long, toxic int, n long, keys binary").withColumn("place", F.xxhash64("doc_id"))
    order = [F.col("place"), F.col("doc_id"), F.col("n"), F.col("keys")]
    once = found.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id").orderBy("n", "keys"))).where("nth = 1")
    rows, total = [], 0
    for r in once.orderBy(*order).limit(limit).select("toxic", "n", "keys").toLocalIterator():
        if total + r["n"] <= most:
            total += r["n"]
            rows.append((np.frombuffer(bytes(r["keys"]), np.uint64), r["toxic"]))
    keys, marks = [k for k, _ in rows], [y for _, y in rows]
    del rows
    return fit(keys, marks)


def classify(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs`` (``doc_id``, ``text``).

    A null or empty text has the constant's score (0.5 if nothing was learned). A null doc_id isn't held
    out. Repeated rows are all scored; other columns are ignored; an empty table gives no rows.
    """
    parts = model.keys, model.weights, model.constant
    name = ("toxicity", hash((model.keys.tobytes(), model.weights.tobytes(), model.constant)))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*parts)
        sift = remembered(name, own.sift)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.score(batch.column(1), sift), pa.float64())], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(each, "doc_id long, score double")
    held = F.coalesce(id_crc32() % 5 == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns."""
    parts = model.keys, model.weights, model.constant

    @F.pandas_udf("double")
    def toxicity(texts: pd.Series) -> pd.Series:
        return pd.Series(Model(*parts).score(pa.array(texts, pa.string(), from_pandas=True)))

    return docs.where(toxicity(F.col("text").cast("string")) < threshold)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: toxicity of every document."""
    docs = table(spark, sf_dir, "documents")
    return classify(docs, train(docs, table(spark, sf_dir, "labels")))
