"""Plain numbers are no personal data, long runs of them take little time and memory, and many notices take linear time."""

import random
import time
import tracemalloc

import pytest

from freightlens.llm import decontaminate, language_id, licenses, pii


def added(text):
    base, spans = pii.find(text, pii.train())
    return sorted(set(spans) - set(base))


@pytest.mark.parametrize("text", [
    "row 10 20 30 40 50 60 70 80 90 11 12 13 end", "1 2 3 " * 200, "1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12", "12 345 6 78 901 23 4 567 89 12 345 67 8", "2019 2020 2021 2022 2023 2024",
    "7 14 21 28 35 42 49", "12 | 34 | 56 | 78 | 90 | 12", "10-20-30-40-50-60-70-80", "1000 2000 3000 4000 5000 6000 7000",
])
def test_runs_of_numbers(text):
    assert added(text) == []


def test_precision_on_tables_of_numbers():
    """Of 2,000 lines of random numbers hardly any holds an added span."""
    r = random.Random(11)
    wrong = 0
    for _ in range(2000):
        digits = r.randint(1, 5)
        line = r.choice([" ", ", ", " - ", "; "]).join(str(r.randrange(10 ** r.randint(1, digits))) for _ in range(r.randint(5, 25)))
        wrong += bool(added(f"row {line} end"))
    assert wrong <= 10


def test_entities_stay_found():
    """Spellings that the base patterns miss, as the trainer writes them, with other words."""
    for text, kind in (("call (212) 555-0187 now", "phone"), ("tel 212-555-0187.", "phone"), ("host 10[.]20[.]30[.]40 up", "ip"), ("write ann at mail dot example soon", "email")):
        assert [k for k, _, _ in added(text)] == [kind], text


def test_long_zones():
    text = "12 345 67 8901 " * 8000
    weights = pii.train()
    began = time.process_time()
    pii.find(text, weights)
    assert time.process_time() - began < 10
    tracemalloc.start()
    pii.find(text[:30_000], weights)
    assert tracemalloc.get_traced_memory()[1] < 10_000_000
    tracemalloc.stop()


def test_many_notices():
    scanner, took = licenses.Scanner(licenses.TEMPLATES), []
    for n in (4000, 16_000):
        text = "Released under the MIT License. " * n
        began = time.process_time()
        assert len(scanner.scan(text)) == n
        took.append(time.process_time() - began)
    assert took[1] < 8 * took[0]


def test_words_kept_by_bytes():
    model = language_id.Model({f"l{i}": f" alpha{i} " for i in range(400)})
    counts = language_id.Counts(model, bytes_kept=270_000)
    for i in range(500):
        assert counts[f"w{i}"] == model.packed(f"w{i}")
        assert len(counts) <= 100


def test_blocks_run_one_by_one(spark, monkeypatch):
    """Of several blocks of items each has run before the next is made."""
    texts = [f"item {i} " + " ".join(f"w{(i * 31 + k * k) % 97}" for k in range(12)) for i in range(12)]
    docs = spark.createDataFrame([(i, "before " + t + " after") for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    order, blocks, cut = [], decontaminate._blocks, decontaminate.cut_lineage

    def told(*args):
        for block in blocks(*args):
            order.append("block")
            yield block

    monkeypatch.setattr(decontaminate, "_blocks", told)
    monkeypatch.setattr(decontaminate, "cut_lineage", lambda df: (order.append("run"), cut(df))[1])
    found = decontaminate.find_passages(docs, bench, block_bytes=200)
    assert len(order) > 4 and order == ["block", "run"] * (len(order) // 2)
    whole = decontaminate.find_passages(docs, bench)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, whole.collect()))
