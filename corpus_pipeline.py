"""A corpus pipeline: from raw documents to packed training sequences.

Each stage takes the documents that its predecessor kept and works on all of them; between
stages they are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gradeloom.llm import cotraining, mixing, packing, pseudonyms, simhash_groups
from gradeloom.llm.queries import PSEUDONYM_KEY
from gradeloom.llm.shared import stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the co-trained classifier keeps (score 0.5 or more)."""
    return cotraining.kept(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group alike to 0.8 in five-word shingles: the smallest id."""
    return simhash_groups.one_of_each(docs.select(*COLUMNS))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with pseudonyms in place of personal data."""
    return pseudonyms.pseudonymised(docs.select(*COLUMNS), PSEUDONYM_KEY).select(*COLUMNS)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, those of small sources up to twice."""
    return mixing.mixed(docs.select(*COLUMNS)).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens: one row per piece of a document.

    A document that the mixture repeats has pieces for each time; ``sequence_id`` and
    ``offset`` tell them apart.
    """
    return packing.pack(docs.select(*COLUMNS))


STAGES = [
    ("quality", good_quality),
    ("near duplicates", without_near_copies),
    ("personal data", without_personal_data),
    ("mixing", mixed_sources),
    ("packing", packed),
]

#: Training a classifier, hashing shingles and byte-pair encoding are beyond SQL; tests
#: hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
