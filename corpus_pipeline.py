"""A training corpus in five stages, each a Spark job over all that the stage before kept.

1. language      documents without a language go (linear-chain CRF)
2. near_copies   one document of each group of near copies stays (n-gram Jaccard join)
3. secrets       secrets are masked in the texts
4. mixture       sources are mixed to weights 5, 2, 1: a document is left out, taken, or taken twice
5. tokens        ids of every text (tokenization automaton), as counts and digests

Stages 1 to 4 return the columns of documents. Every stage takes null and empty
texts, repeated rows, empty tables and further columns as its operator's module
states.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kvloom.llm import bpe, lang_id, mixing, ngram_join, secrets
from kvloom.llm.common import materialize, read


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lang_id.keep_known(docs, lang_id.fit(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.mask(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_copies", near_copies),
    ("secrets", mask_secrets),
    ("mixture", mixture),
    ("tokens", tokens),
]

#: The fields of stages 1, 2 and 5 are no SQL expressions; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
