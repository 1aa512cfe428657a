"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. A line's score rests on its own features and those
of the lines before and after it; the chain's transition weights let a line
lean on its neighbours' labels. Marginals come from forward-backward over whole
documents, all documents of a batch in step, and a document's quality is the
mean marginal of its lines weighted by their length.

Features are counts of character classes, word shapes and repetitions, taken
for all lines of a batch at once. The labels of documents are the only
supervision: a labelled document's lines all carry its label. The weights are
fitted by gradient ascent of the conditional likelihood on a bounded sample of
labelled rows (``TRAIN_DOCS`` documents of at most ``TRAIN_LINES`` lines and
``TRAIN_CHARS`` characters).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_crc32, table

THRESHOLD = 0.3
TRAIN_DOCS = 4000
TRAIN_LINES = 400
TRAIN_CHARS = 50_000
STEPS = 200
#: Texts are scored in runs of about this many characters.
RUN_CHARS = 400_000

LOWER, UPPER, DIGIT, BLANK, STOP, COMMA, BAR, BANG, SIGN, WIDE, REST, BREAK = range(12)


def _classes() -> np.ndarray:
    of = np.full(256, SIGN, dtype=np.uint8)
    of[:33] = BLANK
    of[97:123], of[65:91], of[48:58] = LOWER, UPPER, DIGIT
    of[ord(".")], of[ord(",")], of[ord("|")], of[ord("!")] = STOP, COMMA, BAR, BANG
    of[128:192], of[192:256], of[10] = REST, WIDE, BREAK
    return of


_CLASS = _classes()
_POWERS = (np.arange(1, 65, dtype=np.uint32) * np.uint32(0x9E3779B1)) | np.uint32(1)
WIDTH = 22


def runs(texts: list[str]) -> Iterator[list[str]]:
    """Successive texts in runs of about ``RUN_CHARS`` characters."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= RUN_CHARS):
            size += len(texts[end])
            end += 1
        yield texts[at:end]
        at = end


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of all lines, lengths of all lines, lines of each text); a line ends at a line feed."""
    body = "\n".join(texts) + "\n"
    data = np.frombuffer(body.encode(), dtype=np.uint8)
    kind = _CLASS[data]
    ends = np.flatnonzero(kind == BREAK)
    starts = np.concatenate([[0], ends[:-1] + 1])
    per_text = np.array([t.count("\n") + 1 for t in texts])
    count = {c: np.add.reduceat(kind == c, starts, dtype=np.int32).astype(np.float32) for c in range(REST + 1)}
    length = sum(count[c] for c in range(REST))  # code points
    share = 1 / np.maximum(length, 1)
    word = (kind != BLANK) & (kind != BREAK)
    first = np.flatnonzero(word & ~np.concatenate([[False], word[:-1]]))
    last = np.flatnonzero(word & ~np.concatenate([word[1:], [False]]))
    line_of = np.searchsorted(starts, first, side="right") - 1
    lines = len(starts)

    def per_line(flags: np.ndarray) -> np.ndarray:
        return np.bincount(line_of, weights=flags, minlength=lines).astype(np.float32)

    words = per_line(np.ones(len(first)))
    # a hash of each word, for repetitions
    if len(first):
        begin = np.repeat(first.astype(np.int32), np.diff(np.concatenate([first, [len(data)]])))
        place = (np.arange(first[0], len(data), dtype=np.int32) - begin) & 63
        mixed = (data[first[0] :] + np.uint32(7)) * _POWERS[place] * word[first[0] :]
        hashes = np.add.reduceat(mixed, first - first[0])
        again = np.zeros(len(first), bool)
        for back in (1, 2, 3):
            again[back:] |= (hashes[back:] == hashes[:-back]) & (line_of[back:] == line_of[:-back])
        signed = np.isin(kind[last], (SIGN, BANG, BAR))
        capital = kind[first] == UPPER
        bare = (last == first) & (kind[first] == SIGN)
    else:
        hashes, again = np.empty(0, np.uint32), np.zeros(0, bool)
        signed = capital = bare = np.zeros(0, bool)
    per_word = 1 / np.maximum(words, 1)
    line_hash = np.zeros(lines, np.uint32)
    np.add.at(line_hash, line_of, hashes)
    doc_of = np.repeat(np.arange(len(texts)), per_text)
    same = np.zeros(lines, bool)
    same[1:] = (line_hash[1:] == line_hash[:-1]) & (doc_of[1:] == doc_of[:-1]) & (words[1:] > 0)
    upper = count[UPPER] / np.maximum(count[UPPER] + count[LOWER] + count[WIDE], 1)
    repeated = per_line(again) * per_word
    marked = per_line(signed) * per_word
    x = np.stack([
        np.log1p(length) / 5, np.log1p(words) / 4, length == 0, count[LOWER] * share, upper, upper > 0.5,
        np.minimum(1, 10 * count[DIGIT] * share), np.minimum(1, 2 * count[BLANK] * share), np.minimum(1, 10 * count[STOP] * share),
        np.minimum(1, 10 * count[COMMA] * share), np.minimum(1, 20 * count[BAR] * share), np.minimum(1, 20 * count[BANG] * share),
        np.minimum(1, 20 * count[SIGN] * share), count[WIDE] * share, np.minimum(3, length * per_word / 8), marked, marked > 0.3,
        repeated, repeated > 0.2, same, per_line(capital) * per_word, per_line(bare) * per_word,
    ], axis=1).astype(np.float32)
    return x, length.astype(np.float64), per_text


def with_neighbours(x: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    """Own features, those of the line before and after in the same text, and a constant."""
    begin = np.concatenate([[0], np.cumsum(per_text)[:-1]])
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[begin] = 0
    after[np.cumsum(per_text) - 1] = 0
    return np.concatenate([x, before, after, np.ones((len(x), 1), np.float32)], axis=1)


def marginals(good: np.ndarray, moves: np.ndarray, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of ``good`` for every line, expected moves (2x2), and the log of the partition functions' product.

    ``good`` is the score of label 1 (label 0 scores 0), ``moves`` the scores of successive labels.
    """
    begin = np.concatenate([[0], np.cumsum(per_text)[:-1]])
    order = np.argsort(-per_text, kind="stable")
    sizes, begin = per_text[order], begin[order]
    emit = np.exp(np.stack([-np.maximum(good, 0), good - np.maximum(good, 0)], axis=1))  # scaled by the larger
    move = np.exp(moves)
    forward, scale = np.empty((len(good), 2)), np.empty(len(good))
    backward = np.ones((len(good), 2))
    alive = [int(np.searchsorted(-sizes, -step, side="left")) for step in range(int(sizes[0]) if len(sizes) else 0)]
    for step, n in enumerate(alive):
        at = begin[:n] + step
        now = emit[at] * (forward[at - 1] @ move if step else 1.0)
        scale[at] = total = now.sum(axis=1)
        forward[at] = now / total[:, None]
    pairs = np.zeros((2, 2))
    for step in range(len(alive) - 2, -1, -1):
        at = begin[: alive[step + 1]] + step
        ahead = emit[at + 1] * backward[at + 1] / scale[at + 1, None]
        backward[at] = ahead @ move.T
        pairs += move * (forward[at].T @ ahead)
    return forward[:, 1] * backward[:, 1], pairs, float(np.log(scale).sum() + np.maximum(good, 0).sum())


def fit(texts: list[str], labels: list[int], steps: int = STEPS, ridge: float = 1e-3, rate: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the features and of the moves; with no text all are zero."""
    width = 3 * WIDTH + 1
    if not texts:
        return np.zeros(width), np.zeros((2, 2))
    parts = [line_features(run) for run in runs(texts)]
    per_text = np.concatenate([p[2] for p in parts])
    x = with_neighbours(np.concatenate([p[0] for p in parts]), per_text)
    y = np.repeat(np.array(labels, dtype=np.float64), per_text)
    inner = np.ones(len(y), bool)
    inner[np.cumsum(per_text) - 1] = False
    seen = np.array([[float((inner & (y == 0)).sum()), 0.0], [0.0, float((inner & (y == 1)).sum())]])
    theta, mean, square = np.zeros(width + 4), np.zeros(width + 4), np.zeros(width + 4)
    for step in range(1, steps + 1):
        moves = theta[width:].reshape(2, 2)
        p, pairs, _ = marginals(x @ theta[:width], moves, per_text)
        slope = np.concatenate([x.T @ (y - p), (seen - pairs).ravel()]) / len(per_text) - ridge * theta
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        theta = theta + rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return theta[:width], theta[width:].reshape(2, 2)


def score_texts(texts: list[str], weights: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Quality of each text: marginals of its lines weighted by length (at least 1 each)."""
    x, length, per_text = line_features(texts)
    p, _, _ = marginals(with_neighbours(x, per_text) @ weights, moves, per_text)
    begin = np.concatenate([[0], np.cumsum(per_text)[:-1]])
    weight = np.maximum(length, 1)
    return np.clip(np.add.reduceat(p * weight, begin) / np.add.reduceat(weight, begin), 0, 1)


def score_all(texts: list[str], weights: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """``score_texts`` run by run."""
    return np.concatenate([np.empty(0), *(score_texts(run, weights, moves) for run in runs(texts))])


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS, lines: int = TRAIN_LINES) -> tuple[np.ndarray, np.ndarray]:
    """Fit on at most ``limit`` labelled documents, taken in the order of a hash of their id.

    Only rows whose crc32(doc_id as text) mod 5 isn't 0 are used; of repeated
    labels the lowest counts; null labels and texts of over ``lines`` lines or
    TRAIN_CHARS characters aren't used.
    """
    chosen = (
        labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int")).where("quality IS NOT NULL").where(id_crc32() % 5 != 0)
        .groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    )
    rows = (
        docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        .join(F.broadcast(chosen), "doc_id").where(F.length("text") <= TRAIN_CHARS).where(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) < lines)
        .orderBy("doc_id", "text").limit(limit).collect()
    )
    return fit([r["text"] for r in rows], [r["quality"] for r in rows])


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``doc_id`` and ``score`` of every row; empty and null texts count as one empty line."""
    weights, moves = model

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = score_all([t or "" for t in batch.column(1).to_pylist()], weights, moves)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(each, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``.

    Learns from ``labels`` (``doc_id``, ``quality``) as ``train`` says. A null
    doc_id isn't held out. Repeated rows are all scored; other columns are
    ignored; empty tables give no rows. Without any label every score is 0.5.
    """
    scored = score(docs, train(docs, labels))
    held = F.coalesce(id_crc32() % 5 == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose predicted quality is at least ``threshold``, with all their columns."""
    weights, moves = train(docs, labels)

    @F.pandas_udf("double")
    def quality(texts: pd.Series) -> pd.Series:
        return pd.Series(score_all(["" if t is None else t for t in texts], weights, moves))

    return docs.where(quality(F.col("text").cast("string")) >= threshold)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: quality of every document."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
