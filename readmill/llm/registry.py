"""Queries of the training-data operators."""

from readmill.llm import balls, collisions, divergence, knn, language, lm_scoring, minhash, packing, piece_codec, quality, simhash, token_counts, toxicity

QUERIES = {
    "op1_piece_codec": piece_codec.query,
    "op2_packing": packing.query,
    "op3_language_id": language.query,
    "op4_quality_resampling": quality.query,
    "op5_minhash_fingerprints": minhash.query,
    "op6_token_counts": token_counts.query,
    "op7_toxicity": toxicity.query,
    "op8_lm_scoring": lm_scoring.query,
    "op9_nearest_vectors": knn.query,
    "op10_simhash_components": simhash.query,
    "op11_embedding_near_dedup": collisions.query,
    "op12_centroid_clusters": balls.query,
    "op13_source_divergence": divergence.query,
}

#: Of the others, SQL has not the hash, the tokenizer, the trained model or the online order.
ORACLES = {"op9_nearest_vectors": knn.ORACLE, "op11_embedding_near_dedup": collisions.ORACLE, "op12_centroid_clusters": balls.ORACLE, "op13_source_divergence": divergence.ORACLE}
