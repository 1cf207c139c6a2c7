"""Documents to packed training sequences: quality rules, toxicity, near-duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all documents that the stage before it kept. All stages
bear the same cases. Nulls: a null text is an empty one, a null source is a source of its own, null ids and
nulls in other columns pass through. Very long texts are read whole, one block at a time. Repeated rows count each until near duplicates leave
one of them. Columns beyond those of `documents`, whatever their names, pass through all stages but the last,
which returns pieces. An empty table gives an empty one. What else a stage does is in its docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import host_rules, mixing, neardup, packing, toxicity
from lectern.llm.common import materialize, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail their own rules, or whose host fails, go.

    Empty and blank texts fail the length rule. A rate equal to the limit passes. Repeated rows fare alike."""
    return host_rules.keep_good(docs)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the kept documents' labels, finds toxic go.

    Empty texts stay, as they have no sentence. A score equal to the threshold is toxic. Without labels none goes.
    Repeated rows fare alike."""
    return toxicity.keep_harmless(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id, null ids last; of repeated rows, one.

    Empty texts are copies of each other; texts of fewer than five words are near copies if their words are equal."""
    return neardup.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, 2 times at most: a source's share follows its weight.

    Texts without words aren't taken if their source has none, else as their keys fall. Of repeated rows that a
    source's cut falls among, as many as fit are taken."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents' tokens, and their places in sequences.

    An empty text is its end token alone. Repeated rows are packed each. Pieces of equal lengths are
    interchangeable; they stand in the order of partitions and rows."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", drop_toxic),
    ("near duplicates", near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Toxicity, near-duplicates and tokens aren't SQL; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
