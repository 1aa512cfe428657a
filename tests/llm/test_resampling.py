"""Draws equal a plain computation; the tree of matches merges any runs; ranks hold over many runs and ranges."""

import hashlib
import math
import random
import re
import zlib

import pyarrow as pa
import pytest

from freightlens.llm import byte_words, resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def features(text):
    words = WORD.findall((text or "").translate(LOWER))
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def brute(docs, target, percent=25, least=20, buckets=10_000):
    def counts(texts):
        n = [0] * buckets
        for t in texts:
            for f in features(t)[1]:
                n[zlib.crc32(f.encode()) % buckets] += 1
        return n, sum(n)

    (s, S), (t, T) = counts(x for _, x in docs), counts(target)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    rows, fits = [], []
    for i, text in docs:
        words, own = features(text)
        weight = sum(gain[zlib.crc32(f.encode()) % buckets] for f in own) // len(own) if own else 0
        if i is None:
            rows.append([i, len(own), weight, None, None])
            continue
        h = int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
        if len(words) >= least:
            fits.append(rows[-1])
    for rank, row in enumerate(sorted(fits, key=lambda r: (-r[3], r[0], r[1]))[: percent * len(fits) // 100], 1):
        row[4] = rank
    return sorted(map(tuple, rows), key=repr)


def rows_of(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in df.collect()), key=repr)


@pytest.mark.parametrize(("runs", "ranges"), [(200_000, 500_000), (7, 20)])
def test_whole_table(spark, sf_dir, corpus, monkeypatch, runs, ranges):
    monkeypatch.setattr(resampling, "RUN_ROWS", runs)
    monkeypatch.setattr(resampling, "RANGE_ROWS", ranges)
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    want = brute([tuple(r) for r in corpus.select("doc_id", "text").collect()], [r.text for r in target.collect()])
    assert sum(r[4] is not None for r in want) > 30
    assert rows_of(resampling.resample(corpus.repartition(6), target)) == want


def test_awkward_rows(spark, awkward, empty):
    docs = [tuple(r) for r in awkward.select("doc_id", "text").collect()]
    assert rows_of(resampling.resample(awkward, awkward)) == brute(docs, [t for _, t in docs])
    assert rows_of(resampling.resample(awkward, empty)) == brute(docs, [])
    assert resampling.resample(empty, awkward).count() == 0


def test_ties_and_repeats(spark):
    """A third of all rows are one row; equal scores go by id; a draw ends within a tie."""
    text = " ".join(f"w{i}" for i in range(30))
    docs = [(5, text)] * 40 + [(i, text) for i in range(60)] + [(-3, None), (7, "short")]
    found = resampling.resample(spark.createDataFrame(docs, "doc_id long, text string").repartition(7), spark.createDataFrame([(text,)], "text string"))
    assert rows_of(found) == brute(docs, [text])
    assert sorted(r.rank for r in found.collect() if r.rank) == list(range(1, 26))


def test_draw_percentages(spark, corpus):
    target = spark.createDataFrame([("the of and",)], "text string")
    docs = [tuple(r) for r in corpus.select("doc_id", "text").collect()]
    for percent in (0, 1, 100):
        assert rows_of(resampling.resample(corpus, target, percent=percent)) == brute(docs, ["the of and"], percent)


def test_tournament():
    r = random.Random(2)
    for k in (*range(9), 33):
        runs = [sorted((r.randrange(20), r.randrange(9)) for _ in range(r.randrange(12))) for _ in range(k)]
        assert list(resampling.Tournament([iter(x) for x in runs])) == sorted(x for run in runs for x in run)


@pytest.mark.parametrize("size", [7, 50, 1 << 20])
def test_words_in_runs(monkeypatch, size):
    """Words, pairs and skips of texts cut anywhere equal those of whole texts."""
    monkeypatch.setattr(byte_words, "RUN_BYTES", size)
    r = random.Random(size)
    for _ in range(60):
        texts = [r.choice([None, "", "".join(r.choice("abZ9 .éß漢\x7f\n`{") for _ in range(r.randrange(80))), "x" * r.randrange(90) + " y", " " * r.randrange(3)]) for _ in range(r.randrange(9))]
        want, found = [], []
        for d, t in enumerate(texts):
            w = features(t)[0]
            want += [(0, d, zlib.crc32(x.encode())) for x in w]
            want += [(gap, d, zlib.crc32(f"{a} {b}".encode())) for gap in (1, 2) for a, b in zip(w, w[gap:])]
            want += [(3 + h, d, zlib.crc32(x.encode()[:h])) for h in (1, 4) for x in w if len(x.encode()) > h]
        for run in byte_words.word_runs(pa.array(["skipped", *texts], pa.string())[1:], heads=(1, 4)):
            found += [(0, d, c) for d, c in zip(run.doc[run.again :].tolist(), run.crc[run.again :].tolist())]
            for gap in (1, 2):
                at = run.pairs(gap)
                found += [(gap, d, c) for d, c in zip(run.doc[at].tolist(), byte_words.followed_by(byte_words.with_blank(run.crc[at - gap]), run.crc[at], run.length[at]).tolist())]
            for h, (place, crc) in zip((1, 4), run.heads):
                found += [(3 + h, d, c) for d, c in zip(run.doc[place].tolist(), crc.tolist())]
        assert sorted(found) == sorted(want)
