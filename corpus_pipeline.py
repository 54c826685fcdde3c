"""The corpus pipeline: stages that each take the documents its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from remitspark.llm import exact, minhash, mixing, packing, toxicity
from remitspark.llm.common import stored, table


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity: documents that the classifier rejects go; it learns from the folder's labels.

    Null and empty texts stay; equal texts and repeated rows share their verdict; without labels nothing goes. No rows in, no rows out.
    """
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact deduplication: of equal texts the row with the largest doc_id stays.

    Null and empty texts are one group; a null id is below any other; of repeated rows one stays. No rows in, no rows out.
    """
    return exact.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-duplicates: of each class the row with the smallest doc_id stays.

    Texts without words are one class; null ids come after all others; unlike texts of one id or of none all stay. No rows in, no rows out.
    """
    return minhash.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: documents repeated, cut or left out by their source's budget.

    A null source is a source, the last; texts without words take no part; tied and repeated rows are taken one by one. No rows in, no rows out.
    """
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences.

    A null text is an empty one: a piece of its end alone; documents that stand in the mix several times are packed as often. No rows in, no rows out.
    """
    return packing.pack_documents(docs)


STAGES = [("toxicity", clean), ("exact_dedup", copies), ("near_dedup", near_copies), ("mixing", mix), ("packing", packed)]
#: No SQL: classifier, near duplicates and token ids have none; tests/llm compares the stages with plain versions
#: (toxicity with its operator's scores and the labels, packing with the rules of a packing).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each but the last is written before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
