"""A corpus pipeline of five operators; each stage's rows are the next one's documents.

Defined results: a document with a null text has no words: it is never toxic nor contaminated,
is like other documents without words, holds no secrets and is packed as the one id 0. Rows
without an id pass the near-duplicate stage; of rows equal in id and text one does; rows of one
id and unlike texts all do. Texts of any length are worked on whole. An empty table of documents
gives an empty one; without labels seed words decide on toxicity, without benchmark items
nothing is contaminated. Further columns, whatever their names, stay until packing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tapedeck.llm import decontaminate, likeness, packing, secrets, toxicity
from tapedeck.llm.common import shared_folder, table


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects toxic documents; learns from the labelled rows among its input."""
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles of exact Jaccard
    likeness 0.8 or more. SimHash and its grid join come first, MinHash finds what they can't."""
    return likeness.keep_one(docs)


def benchmark_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold eight words in a row of any benchmark item, also with
    one of them changed, inserted or dropped."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"), min_items=1, **decontaminate.NEAR)


def secrets_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by a mark; every document stays."""
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("toxicity", toxic_out), ("near-duplicates", copies_out), ("decontamination", benchmark_out), ("secrets", secrets_out), ("packing", packed)]

#: Packing needs the tokenizer's merges, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        out = f"{folder}/{i}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
