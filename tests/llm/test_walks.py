"""Texts that walk together have the fingerprints of the walk made a step at a time."""

import random

import numpy as np
import pytest

from freightlens.llm import edit_embedding as ee


def stepwise(text: str) -> str:
    """The fingerprint by the definition: at each step a coin of (phase, class) says whether the walk moves on."""
    if not text:
        return "0."
    coins = np.random.default_rng(ee.SEED).random((ee.CLASSES, ee.PHASES)) < 0.5
    coins[:, -1] |= ~coins.any(axis=1)
    written, at, step = [], 0, 0
    while at < len(text):
        written.append(at)
        at += bool(coins[ord(text[at]) % ee.CLASSES, step % ee.PHASES])
        step += 1
    out = ""
    for spot in ee.places(len(written))[0].tolist():
        mixed = 0
        for k in range(ee.GRAM):
            code = ord(text[min(written[spot] + k, len(text) - 1)])
            mixed = (mixed ^ code) * 0x9E3779B97F4A7C15 % (1 << 64)
            mixed ^= mixed >> 29
        out += f"{mixed >> 48:04x}"
    return f"{len(written):x}.{out}"


def some_texts(many: int, seed: int) -> list[str]:
    draw = random.Random(seed)
    return ["".join(draw.choice("ab cé一\U0001f600") for _ in range(draw.choice([0, 1, 2, 3, 7, 60, 900, 5000]))) for _ in range(many)]


@pytest.mark.parametrize("many", [0, 1, 2, ee.FEW_TEXTS - 1, ee.FEW_TEXTS, ee.FEW_TEXTS + 1, 90])
def test_together_as_stepwise(many):
    texts = some_texts(many, many)
    assert ee.fingerprints(texts) == list(map(stepwise, texts)) == list(map(ee.fingerprint, texts))


@pytest.mark.parametrize("chars", [1, 50, 6000])
def test_groups_of_any_size_give_the_same(monkeypatch, chars):
    texts = [*some_texts(40, 5), "x" * 30_000, "", "x" * 30_000]
    whole = ee.fingerprints(texts)
    monkeypatch.setattr(ee, "WALK_CHARS", chars)
    assert ee.fingerprints(texts) == whole


@pytest.mark.parametrize("length", [1, 2, 63, 64, 65, 127, 128, 129, 1000, 4095, 4097, 1_000_000])
def test_places_are_the_first_of_the_whole_order(length):
    spots, names = ee.make_order((length - 1).bit_length())
    first = np.flatnonzero(spots < length)[: ee.SAMPLES]
    assert sorted(names[first].tolist()) == ee.places(length)[1].tolist()


def test_rows_as_stepwise(spark):
    texts = [t or None for t in some_texts(30, 8)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {r.doc_id: r for r in ee.compare_edited(docs).collect()}
    assert len(found) == len(texts)
    for i, text in enumerate(texts):
        own, after = text or "", texts[(i - 1) % len(texts)] or ""
        edited = own[: len(own) - len(own) // 3] + after[: len(own) // 3]
        assert (found[i].fingerprint, found[i].edited_fingerprint, found[i].n_chars) == (stepwise(own), stepwise(edited), len(own))
        assert found[i].near_next == ee.likeness(stepwise(own), stepwise(after))


def test_rows_of_more_characters_than_are_held(spark):
    texts = [some_texts(1, k)[0] + letter * (ee.HELD_CHARS // 2 + k) for k, letter in enumerate("abc")] + ["short", None, "last"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    found = {r.doc_id: r for r in ee.compare_edited(docs).collect()}
    assert [found[i].fingerprint for i in range(len(texts))] == [ee.fingerprint(t or "") for t in texts]
    assert [found[i].n_chars for i in range(len(texts))] == [len(t or "") for t in texts]
