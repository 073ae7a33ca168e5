"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataframe.llm import mixing, neardup, pii, quality, sentencepieces
from strataframe.llm.common import materialize, table
from strataframe.sources.scratch import discard, made_folders

#: Words of a shingle in the near-duplicate stage.
SHINGLE = 5
#: The mix keeps this share of the tokens that reach it, raked under the bound of 1.
TARGETS = mixing.Targets(budget=0.7, bounded=True)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the learned list reject. A null text has no words and goes."""
    prefix = "quality_of_"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix += "_"
    return quality.judged(docs, table(spark, sf_dir, "labels"), docs.columns, prefix).filter(f"{prefix}kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, that of the smallest doc_id."""
    return neardup.keep_one(docs, SHINGLE)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to the names of their kinds; n_chars is that of the new text."""
    made = pii.redact(docs)
    return made.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else made


def target_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that calibrated sampling keeps."""
    return mixing.sample_documents(docs, TARGETS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, n_tokens and ids of every document."""
    import public_tokenizers

    made = sentencepieces.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"), carry=("doc_id", "source", "lang"), real=True)
    return made.select("doc_id", "source", "lang", "n_tokens", "ids")


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("personal data", personal_data),
    ("target mix", target_mix),
    ("encoding", encoding),
]

#: Learned rules, minima and the tokenizer have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), made_folders()
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(spark, before, docs)  # what the stage wrote for itself, and its input
    return docs
