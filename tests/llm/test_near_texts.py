"""Near duplicates by five-word shingles against all pairs of texts."""

import random

import corpus_pipeline
import pytest
from freightlens.llm import banding, simhash_bk


def plain_shingles(text):
    tokens = text.encode().lower().split()
    return {tuple(tokens[i : i + 5]) for i in range(max(1, len(tokens) - 4))} if tokens else set()


def plain_groups(texts):
    sets = {d: plain_shingles(t) for d, t in texts}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    by_size = sorted(sets, key=lambda d: len(sets[d]))
    for i, a in enumerate(by_size):
        for b in by_size[i + 1 :]:
            if len(sets[a]) < 0.8 * len(sets[b]) - 1e-9:
                break
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in sets}


def test_pipeline_drops_all_similar_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = plain_groups([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    kept = {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").select("doc_id").collect()}
    assert kept == set(want.values()) and not kept & {56, 255, 944}


@pytest.mark.parametrize("part", [2_000_000, 150])
def test_similar_groups_by_brute_force(spark, monkeypatch, part):
    r = random.Random(21)
    word = lambda: "".join(r.choice("aeinorst") for _ in range(5))
    texts = []
    for _ in range(12):
        base = [word() for _ in range(r.choice([30, 80, 200]))]
        for edits in (0, 0, 1, 2, 3, 5, 8):
            own = list(base)
            for at in r.sample(range(len(own)), edits):
                own[at] = word()
            texts.append(" ".join(own))
    texts += ["", " \n", "one two", "One  TWO", "one two three"]
    rows = list(enumerate(texts))
    monkeypatch.setattr(banding, "PART_SIZE", part)
    found = {x.doc_id: x.component_id for x in simhash_bk.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == plain_groups(rows)
    assert 12 < len(set(found.values())) < len(rows)


def test_rows_that_share_an_id_are_decided_by_their_text(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (5, "a b c d e f"), (5, "quite another text stands here"), (7, "x y z"), (7, "u v w"), (7, "u v w")], "doc_id long, text string")
    kept = sorted((r.doc_id, r.text) for r in simhash_bk.drop_near_duplicates(docs).collect())
    assert kept == [(1, "a b c d e f"), (5, "quite another text stands here"), (7, "u v w"), (7, "x y z")]


@pytest.mark.parametrize("radius", [64, 24])
def test_bands_of_many_classes_lose_no_link(spark, monkeypatch, radius):
    """Nodes are numbers, alike if they differ by one; all are in one band and some others."""
    monkeypatch.setattr(banding, "PART_SIZE", 7)
    r = random.Random(5)
    values = [10 * c + i for c in range(12) for i in range(r.randint(1, 9))]
    rows = [(i, [0, 1 + v % 3, 100 + v % 2], 1, 0) for i, v in enumerate(values)]
    nodes = spark.createDataFrame(rows, "own long, keys array<long>, size long, mark long")
    bodies = spark.createDataFrame([(i, str(v)) for i, v in enumerate(values)], "own long, body string")
    found = {x.own: x.label for x in banding.banded_classes(nodes, bodies, int, lambda a, b: abs(a - b) == 1, radius).collect()}
    first = {v // 10: i for i, v in reversed(list(enumerate(values)))}
    assert found == {i: first[v // 10] for i, v in enumerate(values) if sum(w // 10 == v // 10 for w in values) > 1}
