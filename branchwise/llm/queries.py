"""The registered queries of this folder and their SQL."""

from __future__ import annotations

from branchwise.llm import centroids, exact_dedup, huffman, jaccard, mixing, negatives, packing, repeats, secrets, simhash, sketch, toxicity, warc


def _exact(spark, sf_dir):
    return exact_dedup.exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {
    "op1_retrieval_packing": packing.query,
    "op2_secret_scan": secrets.query,
    "op3_warc_round_trip": warc.query,
    "op4_sketch_fingerprints": sketch.query,
    "op5_toxicity_severity": toxicity.query,
    "op6_exact_dedup": _exact,
    "op7_huffman_ids": huffman.query,
    "op8_source_mixing": mixing.query,
    "op9_simhash_groups": simhash.query,
    "op10_repeated_passages": repeats.query,
    "op11_centroid_clusters": centroids.query,
    "op12_ngram_jaccard_join": jaccard.query,
    "op13_hard_negatives": negatives.query,
}
ORACLE = {
    "op6_exact_dedup": exact_dedup.ORACLE,
    "op11_centroid_clusters": centroids.ORACLE,
    "op12_ngram_jaccard_join": jaccard.ORACLE,
    "op13_hard_negatives": negatives.ORACLE,
}
