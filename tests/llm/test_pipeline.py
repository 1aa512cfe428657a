"""The pipeline's stages, each on its own input, against the operators' decisions."""

import corpus_pipeline
from freightlens.llm import decontaminate, packing, pii, quality, simhash_bk


def test_stages(spark, tmp_path):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        seen[name] = (docs, spark.read.parquet(str(tmp_path / name)))
        docs = seen[name][1]
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    before, after = seen["quality"]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    assert ids(after) == {r.doc_id for r in quality.classify(before, labels).where("predicted = 1").collect()}
    before, after = seen["near_duplicates"]
    assert ids(after) == {r.component_id for r in simhash_bk.near_duplicates(before).collect()}
    before, after = seen["decontamination"]
    assert ids(before) - ids(after) == {r.doc_id for r in decontaminate.find_passages(before, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    before, after = seen["personal_data"]
    assert ids(before) == ids(after)
    assert all(not pii.base_spans(r.text) and r.n_chars == len(r.text) for r in after.collect())
    for name in list(seen)[:-1]:
        assert seen[name][1].columns == columns
    before, after = seen["packing"]
    assert ids(after) == ids(before)
    encode = packing.id_bytes(packing.TOKENIZER)
    want = sum(len(encode(r.text)) // 4 + 1 for r in before.collect())
    assert after.agg({"length": "sum"}).first()[0] == want
    assert sorted(tuple(r)[:5] for r in corpus_pipeline.run(spark, sf_dir).collect()) == sorted(tuple(r)[:5] for r in after.collect())
