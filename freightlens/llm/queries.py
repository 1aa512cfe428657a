"""The queries that this subpackage registers, and the SQL of those that SQL can express."""

from . import centroids, decontaminate, edit_embedding, language_id, licenses, packing, pii, quality, resampling, sharding, simhash_bk, suffix_merge, toxicity

QUERIES = {
    "op1_license_scan": licenses.op1,
    "op2_edit_embedding_fingerprints": edit_embedding.op2,
    "op3_line_field_quality": quality.op3,
    "op4_pigeonhole_decontamination": decontaminate.op4,
    "op5_harmonic_packing": packing.op5,
    "op6_simhash_bk_tree": simhash_bk.op6,
    "op7_transform_merge_dedup": suffix_merge.op7,
    "op8_semi_markov_pii": pii.op8,
    "op9_cross_parsing_language": language_id.op9,
    "op10_jump_hash_shards": sharding.op10,
    "op11_exact_centroids": centroids.op11,
    "op12_importance_resampling": resampling.op12,
    "op13_ftrl_toxicity": toxicity.op13,
}

ORACLES: dict[str, str] = {"op11_exact_centroids": centroids.rounds_sql()}
