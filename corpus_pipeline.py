"""From raw documents to packed training sequences, in five stages.

Each stage takes what its predecessor kept, written as Parquet and read again, and
all but the last return the columns of `documents`.  Toxicity, near duplicates and
decontamination drop rows; line de-duplication shortens texts; packing turns what
is left into pieces of token windows.  Null or empty texts pass all filters.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobweave.llm import decontaminate, linededup, minhash, packing, queries, toxicity
from jobweave.llm.shared import shared_dir, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold by a classifier of the labelled, not held-out, ones."""
    labels = table(spark, sf_dir, "labels").where(~queries.held_out())
    return toxicity.reject(docs, toxicity.fit(docs, labels))


def delete_common_blocks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that align with an earlier one's; n_chars follows the text."""
    out = linededup.deduplicate(docs)
    return out.withColumn("n_chars", F.when(F.col("__removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
                          ).select(*docs.columns)


def keep_one_near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of every group of near duplicates (five words, 0.8).

    An id names one document: rows that repeat the smallest id of a group stay or go
    together.  Rows with a null id are compared with nothing and stay.
    """
    gone = minhash.near_duplicates(docs).where(~F.col("kept")).select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("__id"), "left_anti")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token windows filled in the corpus's proportions of sources."""
    return packing.pack(docs, queries.vocabulary())


STAGES = [
    ("toxicity", reject_toxic),
    ("line dedup", delete_common_blocks),
    ("near dedup", keep_one_near_duplicate),
    ("decontamination", drop_contaminated),
    ("packing", pack_mixture),
]
#: Learned scores, alignments and tokenizers are beyond SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    root = f"{shared_dir(spark)}/jobweave-llm/{spark.sparkContext.applicationId}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{k}")
        docs = spark.read.parquet(f"{root}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
