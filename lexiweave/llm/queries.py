"""Registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ball_trees, byte_pairs, chunk_dedup, licenses, merkle, mixing, multi_index, packing, pii, quality, simhash, sketches, token_counts
from .common import documents


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's rewritten text; n_entities is 0 where nothing was found."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return pii.pseudonymize(docs, pii.session_key(spark)).select("doc_id", "text", F.col("n_entities").cast("long").alias("n_entities"), "entity_kinds")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint of three-word shingles and the smallest doc_id of its component."""
    groups = simhash.near_duplicate_groups(documents(spark, sf_dir), width=3, radius=3)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each piece of each document's ids in sequences of 2048 tokens."""
    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op4_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document that shares a passage with another document."""
    return chunk_dedup.documents_with_repeats(documents(spark, sf_dir))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License labels of every document."""
    return licenses.scan(documents(spark, sf_dir))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's block, slot and place in the mixed order; weights are the roots of the sources' rows."""
    return mixing.mix(documents(spark, sf_dir).select("doc_id", "source"))


def op7_mil_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score; labels of held-out documents are not learned from."""
    return quality.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes and tokens, and the most leading code points within the limit."""
    counted = token_counts.count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > token_counts.LIMIT).alias("over_limit"), "fits")


def op9_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every vector whose id is divisible by 20."""
    return multi_index.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), every=20, k=20)


def op10_bottom_k_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's sketch and its edited text's, their likeness, and what the sketch estimates of the shingles."""
    made = sketches.edited_fingerprints(documents(spark, sf_dir))
    return made.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        sketches.as_string(F.col("sketch")).alias("fingerprint"),
        sketches.as_string(F.col("edited_sketch")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
        "next_doc_id",
        sketches.distinct_count(F.col("sketch")).alias("n_shingles"),
        sketches.containment(F.col("sketch"), F.col("edited_sketch")).alias("contained_in_edited"),
    )


def op11_ball_tree_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's centroid after three rounds, its squared distance, and the inertia of its cluster and of all."""
    return ball_trees.clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))[0]


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, subroot and proof in the manifest, and whether its tampered or own text still folds to the root."""
    made = merkle.folded(merkle.manifest(documents(spark, sf_dir), merkle.tampered_text()), F.coalesce("tampered_leaf", "leaf"))
    return made.select("doc_id", "leaf", "subroot", "root", F.sha2("siblings", 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of ids, and digests of its ids and of the bytes that they spell."""
    files = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    found = byte_pairs.decode_ids(byte_pairs.encode_texts(documents(spark, sf_dir), *files), *files)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def packed_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3's operator on instruction data: whole conversations under limits on tokens, segments and answer tokens."""
    return packing.pack_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {
    "op1_pii_surrogates": op1_pii_surrogates,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_vector_packing": op3_vector_packing,
    "op4_chunk_dedup": op4_chunk_dedup,
    "op5_license_scan": op5_license_scan,
    "op6_source_mixing": op6_source_mixing,
    "op7_mil_quality": op7_mil_quality,
    "op8_token_counts": op8_token_counts,
    "op9_inverted_multi_index": op9_inverted_multi_index,
    "op10_bottom_k_fingerprints": op10_bottom_k_fingerprints,
    "op11_ball_tree_clusters": op11_ball_tree_clusters,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_byte_pairs": op13_byte_pairs,
    "packed_conversations": packed_conversations,
}

ORACLES: dict[str, str] = {
    "op5_license_scan": licenses.oracle_sql(),
    "op11_ball_tree_clusters": ball_trees.oracle_sql(),
    "op12_merkle_manifest": merkle.oracle_sql(),
}
