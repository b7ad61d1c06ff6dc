"""From raw documents to token ids: quality rules, line dedup, near-dedup, mixing, and byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it to the shared folder and
reads it again before the next stage. All stages but the last return the columns of their documents.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from zonehour.llm import bpe, line_dedup, mixing, near_dedup, quality
from zonehour.llm.common import table
from zonehour.llm.queries import LINE_DOCS, MIX_SEED, RANKS
from zonehour.sources.shared import drop_round, save_round

#: BPE and learned rules are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the decision list learned from ``labels``."""
    return quality.kept_documents(docs, table(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines whose keys are found in many of them."""
    return line_dedup.drop_lines(docs, line_dedup.keep_bitmaps(docs, LINE_DOCS))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return near_dedup.first_of_class(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, those of sources below their target weight again, in the order of the mixture."""
    return mixing.mixed_documents(docs, seed=MIX_SEED)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of every row of the mixture."""
    return bpe.encode_documents(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", quality_rules), ("line_dedup", line_dedup_stage), ("near_dedup", near_dedup_stage),
    ("mixing", mixing_stage), ("byte_bpe", encoding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        given, docs = docs, save_round(stage(spark, docs, sf_dir), f"pipeline-{name}")
        drop_round(given)
    return docs
