"""Benchmark items too short for edits are found as whole words; texts aren't dropped for them unless asked for."""

from freightlens.llm import decontaminate


def test_short_items(spark):
    texts = ["The capital is Paris.", "comparison of parishes", "Paris, PARIS and paris", None, "", "x New York y", "newyork"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([(1, "Paris"), (2, "new york!"), (3, "..."), (4, None)], "item_id long, text string")
    found = sorted(tuple(r) for r in decontaminate.find_passages(docs, items).collect())
    assert found == [(0, 1, 1, 0, 15, 20), (2, 1, 3, 0, 0, 5), (5, 2, 1, 0, 2, 10)]
    assert decontaminate.drop_contaminated(docs, items).count() == 7
    assert sorted(r.doc_id for r in decontaminate.drop_contaminated(docs, items, short_items=True).collect()) == [1, 3, 4, 6]
