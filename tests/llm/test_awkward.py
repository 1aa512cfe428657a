"""Every operator takes nulls, empty and long texts, repeats, clashing names and empty tables; one row a row where it says so."""

import pytest

from freightlens.llm import decontaminate, edit_embedding, language_id, licenses, packing, pii, quality, sharding, simhash_bk, suffix_merge


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, score double")


def run_all(spark, docs):
    marked = labels(spark, [(6, 1, 0, 0.1), (7, 0, None, None), (7, 1, 0, 0.0), (8, None, 0, 0.0), (None, 1, 0, 0.0), (1000, 1, 1, 0.0)])
    bench = spark.createDataFrame([(1, "Hello, World! 3"), (None, "no such passage in any of these texts"), (2, None), (3, "")], "item_id long, text string")
    return {
        "licenses": licenses.scan_licenses(docs), "fingerprints": edit_embedding.compare_edited(docs), "groups": edit_embedding.near_groups(docs),
        "quality": quality.classify(docs, marked), "keep_good": quality.keep_good(docs, marked), "passages": decontaminate.find_passages(docs, bench),
        "clean": decontaminate.drop_contaminated(docs, bench), "pack": packing.pack(docs), "simhash": simhash_bk.near_duplicates(docs),
        "drop": simhash_bk.drop_near_duplicates(docs), "repeats": suffix_merge.remove_repeats(docs), "pii": pii.detect(docs), "redact": pii.redact(docs),
        "language": language_id.identify(docs, language_id.train(docs)), "shards": sharding.shard_rows(docs),
    }


def test_awkward_rows(spark, awkward):
    n = awkward.count()
    found = {name: df.collect() for name, df in run_all(spark, awkward).items()}
    for name in ("fingerprints", "groups", "quality", "simhash", "repeats", "pii", "redact", "language", "shards"):
        assert len(found[name]) == n, name
    assert found["redact"][0].asDict().keys() == set(awkward.columns)
    assert all(0 <= r.score <= 1 for r in found["quality"] + found["language"])
    assert {r.lang_pred for r in found["language"] if r.doc_id in (0, 1, 2, 3)} == {"und"}
    assert sum(r.length for r in found["pack"] if r.start == 0 and r.length == 1) >= 4


def test_empty_tables(spark, empty):
    for name, df in run_all(spark, empty).items():
        assert df.count() == 0, name


@pytest.mark.parametrize("make", [quality.classify, quality.keep_good])
def test_no_labels(spark, awkward, make):
    rows = make(awkward, labels(spark, []))
    assert rows.count() == awkward.count()
