"""Importance resampling towards a target distribution, by hashed n-gram counts.

Two passes over the texts. The first counts the features of the corpus and of the target in a fixed number of
buckets; the log of the buckets' ratio is the gain of a feature. The second scores every document by array
lookups: the mean gain of its features plus a Gumbel draw by its id, so that the highest scores are a sample without
replacement in proportion to the weights. Scores are written once to the checkpoint folder; the texts
aren't read again.

The draw is a distributed merge. A count of rows by score (there are some hundred thousand values at most, see
``score_counts``) gives the exact number to draw and the score below which none is drawn. The rest is sorted in
runs by the tasks that hold it, dealt into ranges of the order, and each range merges its parts of the runs by a
tournament tree that stops when the draw is complete. Counts of the ranges before give the ranks. Everything
passes in blocks of bounded size; no task or driver sees more than a range.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_words import followed_by, with_blank, word_runs
from .common import cut_lineage, shuffle_width, table

BUCKETS = 10_000
LEAST_WORDS = 20
DRAWN_PERCENT = 25
SEED = 7
#: Rows of a sorted run, and rows that a range of the order is meant to hold at most.
RUN_ROWS = 200_000
RANGE_ROWS = 500_000


def features(texts: pa.Array, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, bucket) of every word and pair of neighbouring words, and the rows of the words alone, run by run."""
    for run in word_runs(texts, carried=1):
        second = run.pairs()
        pair = followed_by(with_blank(run.crc[second - 1]), run.crc[second], run.length[second])
        own = run.doc[run.again :]
        yield np.concatenate([own, run.doc[second]]), np.concatenate([run.crc[run.again :], pair]) % np.uint32(buckets), own


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> dict[int, int]:
    """How many features of all texts fall into each bucket; tasks count in an array, at most ``buckets`` rows reach the driver."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, bucket, _ in features(batch.column(0), buckets):
                counts += np.bincount(bucket, minlength=buckets)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(counts[used], pa.int64())], names=["bucket", "n"])

    counted = texts.select(F.col("text").cast("string")).mapInArrow(each, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    return {r["bucket"]: r["n"] for r in counted.collect()}


def gains(corpus: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 * ln of the buckets' smoothed ratio), target against corpus."""
    in_corpus, in_target = sum(corpus.values()), sum(target.values())
    return np.array([
        math.floor(1000 * math.log(((target.get(b, 0) + 1) * (in_corpus + buckets)) / ((corpus.get(b, 0) + 1) * (in_target + buckets)))) for b in range(buckets)
    ], np.int64)


def noise(doc_id: int, seed: int = SEED) -> int:
    """A Gumbel draw in thousandths, fixed by the id."""
    h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """``doc_id, n_features, words, weight, score`` of every row; a row without id has no score."""
    buckets = len(gain)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            total, n, words = (np.zeros(rows, np.int64) for _ in range(3))
            for row, bucket, own in features(batch.column(1), buckets):
                total += np.bincount(row, weights=gain[bucket], minlength=rows).astype(np.int64)  # whole numbers far below 2^53
                n += np.bincount(row, minlength=rows)
                words += np.bincount(own, minlength=rows)
            weight = total // np.maximum(n, 1)
            drawn = [None if i is None else int(w) + noise(i, seed) for i, w in zip(batch.column(0).to_pylist(), weight)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.int64()) for x in (n, words, weight)), pa.array(drawn, pa.int64())],
                names=["doc_id", "n_features", "words", "weight", "score"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(each, "doc_id long, n_features long, words long, weight long, score long")


def score_counts(eligible: DataFrame) -> list[tuple[int, int]]:
    """(score, rows) from the highest score down.

    A Gumbel draw of a 32-bit number has 26,000 values at most, and gains are logs of counts, some ten thousand
    either way: the number of scores doesn't grow with the rows.
    """
    return sorted(((r["score"], r["n"]) for r in eligible.groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)


class Tournament:
    """A tree of matches between the heads of k sorted runs; a run's next head replays only its own path."""

    END = (math.inf,)

    def __init__(self, runs: list[Iterator[tuple]]) -> None:
        self.runs = [iter(r) for r in runs]
        self.size = 1 << max(0, (len(runs) - 1).bit_length())
        self.heads = [next(r, self.END) for r in self.runs] + [self.END] * (self.size - len(runs))
        self.winner = [0] * self.size + list(range(self.size))
        for node in range(self.size - 1, 0, -1):
            self._match(node)

    def _match(self, node: int) -> None:
        left, right = self.winner[2 * node], self.winner[2 * node + 1]
        self.winner[node] = left if self.heads[left] <= self.heads[right] else right

    def __iter__(self) -> Iterator[tuple]:
        while True:
            best = self.winner[1]
            head = self.heads[best]
            if head is self.END:
                return
            yield head
            self.heads[best] = next(self.runs[best], self.END) if best < len(self.runs) else self.END
            node = (self.size + best) >> 1
            while node:
                self._match(node)
                node >>= 1


def _sorted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (order, doc_id, n_features, weight, task, run) in sorted runs; ``order`` is the score with its sign turned."""
    held, rows, number = [], 0, 0

    def run() -> pa.RecordBatch:
        whole = pa.Table.from_batches(held).combine_chunks()
        place = np.lexsort([whole.column(name).to_numpy() for name in ("n_features", "doc_id", "order")])
        whole = whole.take(pa.array(place)).set_column(5, "run", pa.array(np.full(whole.num_rows, number), pa.int64()))
        return whole.to_batches()[0]

    for batch in batches:
        for start in range(0, batch.num_rows, RUN_ROWS):
            held.append(batch.slice(start, RUN_ROWS))
            rows += held[-1].num_rows
            if rows >= RUN_ROWS:
                yield run()
                held, rows, number = [], 0, number + 1
    if rows:
        yield run()


def _slices(columns: list[np.ndarray], run: np.ndarray) -> list[Iterator[tuple]]:
    """One iterator of sorted rows for each run."""
    place = np.lexsort([columns[2], columns[1], columns[0], run])  # keeps order within runs; a shuffle promises none
    cuts = np.flatnonzero(np.diff(run[place])) + 1
    return [zip(*(c[part].tolist() for c in columns)) for part in np.split(place, cuts)]


def draw(rows: DataFrame, percent: int = DRAWN_PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of all rows: the highest scores have ranks 1, 2, 3..., the rest null.

    ``rows`` is what ``scored`` gives, without lineage. Ties go to the smaller doc_id, then to fewer features;
    rows equal in all of them take successive ranks.
    """
    fits = (F.col("words") >= least_words) & F.col("score").isNotNull()
    counts = score_counts(rows.where(fits))
    wanted = percent * sum(n for _, n in counts) // 100
    lowest, held = math.inf, 0
    for score, n in counts:
        if held >= wanted:
            break
        lowest, held = score, held + n
    plain = rows.select("doc_id", "n_features", "weight", "score")
    if not wanted:
        return plain.withColumn("rank", F.lit(None).cast("long"))
    drawable = fits & (F.col("score") >= lowest)
    rest = plain.where(~F.coalesce(drawable, F.lit(False))).withColumn("rank", F.lit(None).cast("long"))
    layout = "order long, doc_id long, n_features long, weight long, task long, run long"
    runs = (
        rows.where(drawable).select((-F.col("score")).alias("order"), "doc_id", "n_features", "weight", F.spark_partition_id().cast("long").alias("task"), F.lit(0).cast("long").alias("run"))
        .mapInArrow(_sorted_runs, layout)
    )
    # the last two keys split rows that are equal in all else
    spread = F.xxhash64("task", "run", F.monotonically_increasing_id())
    ranges = runs.withColumn("spread", spread).repartitionByRange(max(shuffle_width(rows.sparkSession), -(-held // RANGE_ROWS)), "order", "doc_id", "n_features", "spread").drop("spread")
    ranges = cut_lineage(ranges.withColumn("part", F.spark_partition_id()))
    before, total = {}, 0
    for part, n in sorted((r["part"], r["n"]) for r in ranges.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()):  # a number for each range
        before[part], total = total, total + n

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        whole = pa.Table.from_batches(held).combine_chunks()
        column = {name: whole.column(name).to_numpy() for name in whole.column_names}
        rank = before[int(column["part"][0])]
        _, run = np.unique(np.stack([column["task"], column["run"]]), axis=1, return_inverse=True)
        out: list[tuple] = []
        for order, doc_id, n_features, weight in Tournament(_slices([column[c] for c in ("order", "doc_id", "n_features", "weight")], run.ravel())):
            rank += 1
            out.append((doc_id, n_features, weight, -order, rank if rank <= wanted else None))
            if len(out) == 65_536:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["doc_id", "n_features", "weight", "score", "rank"])

    return rest.unionByName(ranges.mapInArrow(merge, "doc_id long, n_features long, weight long, score long, rank long"))


def resample(docs: DataFrame, target: DataFrame, percent: int = DRAWN_PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every row of ``docs`` (``doc_id``, ``text``), drawn towards ``target`` (``text``).

    Of the N rows with at least ``least_words`` words, floor(percent * N / 100) are drawn. A null text has no
    words and weight 0. A row without id has a weight, but neither score nor rank, and doesn't count for N. Repeated
    rows are each drawn or not. Empty tables give no rows, an empty target a target of equal buckets. Other columns are ignored.
    """
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets), buckets)
    return draw(cut_lineage(scored(docs, gain, seed)), percent, least_words)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: the documents drawn towards the benchmark."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
