"""The corpus pipeline: five operators, each on all that the one before kept.

``run`` applies the stages to ``documents``. A stage's result is written to the
shared folder as Parquet and read again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import stored, table
from lodestar.llm.neardup import distinct_documents
from lodestar.llm.packing import pack
from lodestar.llm.pii import pseudonymised_documents
from lodestar.llm.quality import kept_documents
from lodestar.llm.queries import PII_KEY, tokenizer_file
from lodestar.llm.substrings import cut_documents


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base limits or meet a learned rule go."""
    return kept_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component at a similarity of 0.8 stays."""
    return distinct_documents(docs, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of twenty words that start earlier elsewhere are cut out; n_chars counts what is left."""
    return _counted(cut_documents(docs))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal values become pseudonyms of the same format."""
    return _counted(pseudonymised_documents(docs, PII_KEY, any_area=True))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of 2048."""
    pieces = pack(docs, tokenizer_file("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def _counted(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    return docs.select(*[F.char_length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("pii", pii),
    ("packing", packing),
]

#: Learned rules, a keyed permutation and a tokenizer are beyond SQL; each stage is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that the whole pipeline makes of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
