"""From raw documents to tokens: each stage reads what the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableprep.llm import bpe, decontaminate, jaccard, pii, toxicity
from tableprep.llm.queries import held_out, table
from tableprep.scratch import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below one half."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), usable=~held_out())
    return toxicity.score(docs, model).where("toxicity < 0.5").select(*docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of at least 0.8 of five-word shingles connect."""
    return jaccard.keep_one(docs, least=80, shingle=5)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by marks."""
    return pii.redact(docs, pii.fit(docs)).withColumn("n_chars", F.length("text").cast("bigint"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document (packed, little-endian 32 bits) and whether decoding gives its bytes back."""
    import public_tokenizers

    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    # Encoded and decoded by one worker, which remembers less than it does when it has the executor to itself.
    encoded = bpe.encode(
        docs.select("doc_id", "lang", "source", "text"), ranks, public_tokenizers.PATTERN, remembered=40_000,
        remembered_pairs=100_000, verify=True,
    )
    return encoded.select("doc_id", "lang", "source", "n_tokens", "token_ids", "round_trip")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("personal_data", without_personal_data),
    ("tokens", tokens),
]

#: SQL can express neither the learnt stages nor the tokens; tests/llm compares the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
