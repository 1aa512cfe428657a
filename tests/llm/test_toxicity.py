"""Held-out accuracy, the step rule against its formula, scores against a plain sum, and awkward rows."""

import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from freightlens.llm import byte_words, toxicity


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, toxic int, score double")


def keys(text):
    return np.unique(np.concatenate([np.empty(0, np.uint64), *(toxicity.keys_of(r)[1] for r in byte_words.word_runs(pa.array([text], pa.string()), heads=toxicity.HEADS))]))


def test_held_out(spark):
    folder = "/root/testdata/sf0.01"
    docs, marked = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    found = {r.doc_id: r for r in toxicity.classify(docs, toxicity.train(docs, marked)).collect()}
    assert len(found) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in found.items())
    held = [(found[r.doc_id].predicted, r.toxic) for r in marked.collect() if found[r.doc_id].held_out]
    assert sum(p == y for p, y in held) / len(held) > 0.93
    assert sum(p > y for p, y in held) <= 1


def test_steps():
    """One coordinate's sums and weight after some steps, by the published formulas."""
    alpha, beta, l1, l2 = 0.5, 1.0, 0.2, 0.1
    model = toxicity.Ftrl(3, alpha, beta, l1, l2)
    z, n = [0.0] * 3, [0.0] * 3
    for at, y in (([0, 1], 1), ([0, 2], 0), ([0, 1, 2], 1), ([0, 1], 1)):
        w = []
        for i in at:
            own = 0.0 if i == 0 else l1
            w.append(0.0 if abs(z[i]) <= own else -(z[i] - math.copysign(own, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2))
        g = 1 / (1 + math.exp(-sum(w))) - y
        for i, wi in zip(at, w):
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * wi
            n[i] += g * g
        model.learn(np.array(at), y)
    assert np.allclose(model.z, z) and np.allclose(model.n, n)


def test_scores_are_sums_of_distinct_features(monkeypatch):
    texts = ["you are trash", "trash trash trash", "TRASH!", None, "", "clean words only", "x " * 400 + "trash"]
    own = np.unique(np.concatenate([keys("you are trash"), keys("trash trash")]))
    model = toxicity.Model(own, np.arange(1, len(own) + 1) / 10, -2.0)
    weight = dict(zip(own.tolist(), model.weights))
    plain = [1 / (1 + math.exp(2.0 - sum(weight.get(k, 0) for k in keys(t).tolist()))) for t in texts]
    assert np.allclose(model.score(pa.array(texts)), plain)
    monkeypatch.setattr(byte_words, "RUN_BYTES", 16)
    assert np.allclose(model.score(pa.array(texts)), plain)


def test_planted_words_anywhere(spark):
    """A toxic word late in a very long text counts; clean texts are left alone."""
    r = random.Random(4)

    def text(words, toxic):
        found = [f"word{r.randrange(200)}" for _ in range(words)]
        return " ".join([*found[: words // 2], *["Fool,"] * toxic, *found[words // 2 :]])

    docs = [(i, text(r.randrange(5, 60), i % 4 == 0)) for i in range(400)]
    docs += [(1000, text(100_000, True)), (1001, text(100_000, False))]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    model = toxicity.train(frame, labels(spark, [(i, int(i % 4 == 0), 0.0) for i in range(400)]))
    found = {r.doc_id: r.predicted for r in toxicity.classify(frame, model).collect()}
    assert all(found[i] == (i % 4 == 0) for i in range(400)) and found[1000] == 1 and found[1001] == 0
    kept = {r.doc_id for r in toxicity.keep_clean(frame, model).collect()}
    assert kept == {i for i, p in found.items() if not p}


@pytest.mark.parametrize("marked", [[], [(6, 1, 0.1), (6, 0, 0.1), (7, None, 0.1), (None, 1, 0.1), (9999, 1, 0.1)]])
def test_awkward_rows(spark, awkward, empty, marked):
    model = toxicity.train(awkward, labels(spark, marked))
    found = toxicity.classify(awkward, model).collect()
    assert len(found) == awkward.count() and all(0 <= r.score <= 1 for r in found)
    assert {r.held_out for r in found if r.doc_id is None} == {False}
    assert toxicity.classify(empty, model).count() == 0
    assert toxicity.keep_clean(awkward, model).columns == awkward.columns


def test_bounded_sample(spark):
    """Texts with more features than the bound are passed over; the others are learned."""
    docs = [(i, "bad" if i % 2 else "good") for i in range(60)] + [(70, " ".join(f"w{i}" for i in range(3000)))]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    marked = labels(spark, [(i, i % 2, 0.0) for i in range(60)] + [(70, 1, 0.0)])
    model = toxicity.train(frame, marked, most=500)
    assert set(model.keys.tolist()) <= set(keys("bad").tolist() + keys("good").tolist()) and len(model.keys)
