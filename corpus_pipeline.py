"""From documents to packed sequences of token ids.

Five stages, each an operator of ``txrisk.llm`` over all that the stage before it kept.
Stages give DataFrames; ``run`` writes each one as Parquet in the shared folder and
reads it again as the next stage's documents. All stages but the last return
the columns of documents.

Null texts count as empty: they are not toxic, lose no lines, are no copies and not
contaminated, and become a sequence piece of the end id alone. An empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from txrisk.llm import bagminhash, linebloom, packing, toxicity, winnow
from txrisk.llm.common import stored


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the severity model rejects."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.clean(docs, toxicity.fit(docs, labels))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand in three documents and more stay in the last one only."""
    return linebloom.clean(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return bagminhash.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold benchmark passages."""
    return winnow.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences, as ``op4`` returns them."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)


STAGES = [
    ("toxicity", not_toxic),
    ("line_dedup", without_repeated_lines),
    ("minhash_near_dedup", one_of_each),
    ("benchmark_decontamination", decontaminated),
    ("packing", packed),
]

#: Model fitting and token ids cannot be said in SQL; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
