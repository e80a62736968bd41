"""From documents to packed training sequences: toxic documents go, copies and near copies go, sources are mixed, token sequences are packed.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read again as the next one's docs. All but the last give
the columns of documents. Mixing repeats the documents of small sources, never drops one; the sequences' pieces then hold each repeat.

Null texts count as empty: toxicity scores them as texts without a known feature, exact dedup keeps one of all empty texts, near dedup links none of them, and packing gives them
the end id alone. Texts are read whole, however long. Rows that repeat a doc_id are judged by their own texts; wholly equal rows are one after exact dedup. Null
doc_ids are rows like any other, and a null source is a source of its own. An empty table passes every stage as one. Further columns of documents are kept as they are by all stages
but packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakeproof.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from lakeproof.llm._common import stage_table, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with a score below 0.5, by a classifier that is fit on the confirmed labels of ``sf_dir`` alone."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal without white space."""
    return exact_dedup.drop_exact_duplicates(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies; texts without words stay."""
    return near_dedup.drop_near_duplicates(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once or more, so that the sources' shares of tokens meet the target."""
    return mixing.mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the sequences that all documents' token ids are packed into."""
    return packing.pack_sequences(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL expresses neither the classifier nor the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage_table(stage(spark, docs, sf_dir), name)
    return docs
