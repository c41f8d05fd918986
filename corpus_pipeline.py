"""Documents -> quality classifier -> near duplicates -> repeated passages -> benchmark passages -> token ids.

Every stage works on all rows that the one before has kept; ``run`` writes each result to the shared scratch folder and
reads it back, so that a lost executor repeats one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hazegrid.llm import bpe, decontamination, hyperminhash, ordinal, suffixes
from hazegrid.llm.common import table
from hazegrid.session import discard, materialize

#: The stages follow a fitted model and groups of similar texts, which SQL cannot state; tests compare each stage with
#: brute force.
ORACLE_SQL = None


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier keeps."""
    model = ordinal.train(docs, table(spark, sf_dir, "labels"))
    return ordinal.score(docs, model).where("kept").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with 80 % of five-word shingles in common."""
    return hyperminhash.deduplicated(docs, shingle=5, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without bytes in 200-byte strings that start at two places."""
    return suffixes.without_repeats(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and hashes of the ids and of what they decode to."""
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode(docs, ranks, public_tokenizers.PATTERN, outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("quality classifier", select_quality),
    ("near duplicates", drop_near_duplicates),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", drop_contaminated),
    ("byte-level BPE", encode_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"stage{n}")
        discard(before)
    return docs
