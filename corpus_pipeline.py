"""From raw documents to packed sequences: quality rules, language, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before it kept, and returns a DataFrame; all but the last return the
columns of documents. ``run`` writes each stage's rows to the shared folder and reads them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from linkscope.llm import language, nearcopies, packing, quality
from linkscope.llm.common import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, with their failing lines taken out.

    Null, empty and wordless texts are rejected; a text of any length is one row's work; repeated rows are judged one by one; empty tables
    give empty results; other columns are kept, whatever their names; n_chars is set anew.
    """
    return quality.clean(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the network knows; it learns from the rows it is given.

    Texts that are null or have no letter are rejected, and so is everything if no row is labelled; long texts are read window by window;
    repeated rows are judged one by one; empty tables give empty results; other columns are kept.
    """
    return language.confident(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of texts that share 0.8 of their five-word shingles, directly or in chains.

    SimHash by pigeonring filtering finds the candidates, whose whole sets of shingles are then compared.
    Null, empty and wordless texts are copies of each other; repeated rows are copies, and one of them stays; rows without an id come last
    in their group, and are kept if they are alone in it; rows that share an id but no text are told apart; empty tables give empty results;
    other columns are kept.
    """
    return nearcopies.keep_one(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences, with a checksum of their tokens.

    Null and empty texts are their closing token; repeated rows are packed one by one; a null id is kept; empty tables give no pieces; other
    columns are ignored.
    """
    return packing.digest(packing.pack(docs))


STAGES = [("quality_rules", quality_rules), ("language_id", language_id), ("near_dedup", near_dedup), ("packing", packed)]

#: SQL expresses neither the network nor the tokens; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
