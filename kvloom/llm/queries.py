"""The queries of the training-data operators over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, embed_dedup, lang_id, media, mixing, ngram_join, oracles, secrets, sharding, suffix_dedup, toxicity
from .common import read


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 5-word shingles are 80 % alike."""
    return ngram_join.jaccard_components(read(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text of documents."""
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text of documents."""
    return secrets.scan(read(spark, sf_dir, "documents"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of one label with a cosine of 0.98 or more, and their components."""
    return embed_dedup.near_vectors(read(spark, sf_dir, "embeddings"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text of documents."""
    docs = read(spark, sf_dir, "documents")
    return lang_id.predict(docs, lang_id.fit(docs))


def op6_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text of documents, and the text decoded from them, as digests."""
    return bpe.encode_digests(read(spark, sf_dir, "documents"))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all documents to weights 5, 2, 1 takes of each."""
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every whole text without the bytes of 50-byte strings that a smaller id has."""
    return suffix_dedup.repeated_passages(read(spark, sf_dir, "documents")).drop("spans")


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as a grey image, read back and hashed."""
    return media.media_features(media.text_media(read(spark, sf_dir, "documents")))


def op10_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16 shards of near-equal bytes; equal texts stay together."""
    out = sharding.shard(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_toxicity": op2_toxicity,
    "op3_secret_scan": op3_secret_scan,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_language_id": op5_language_id,
    "op6_bpe_codec": op6_bpe_codec,
    "op7_source_mix": op7_source_mix,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_media_columns": op9_media_columns,
    "op10_balanced_shards": op10_balanced_shards,
}

ORACLES: dict[str, str] = {
    "op1_ngram_jaccard": oracles.NGRAM_JACCARD,
    "op4_embedding_dedup": oracles.EMBEDDING_DEDUP,
    "op8_suffix_dedup": oracles.SUFFIX_DEDUP,
}
