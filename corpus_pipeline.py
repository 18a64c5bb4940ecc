"""The corpus pipeline: toxicity, exact copies, near copies, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and read again for the next one.
All but the last return the columns of documents. Nulls, empty texts, repeated rows and empty tables are treated as
the operators' docstrings say; rows without doc_id pass the filters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import exact, packing, secrets, similar, toxicity
from tidemark.llm.queries import tokenizer
from tidemark.llm.shared import stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of at least 0.5 go."""
    model = toxicity.trained(docs, table(spark, sf_dir, "labels"))
    bad = stored(toxicity.score(docs, model).where("score >= 0.5").select(F.col("doc_id").alias("gone_id")).distinct())
    return docs.join(bad, docs["doc_id"].cast("long") == bad["gone_id"], "left_anti")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest doc_id stays."""
    return exact.remove_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts joined by links of 0.8 similarity or more on five-word shingles the smallest doc_id stays."""
    return similar.remove_similar(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced; every document stays."""
    return secrets.redact(docs, secrets.trained())


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens."""
    return packing.packed(docs, tokenizer())


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("near dedup", drop_near_copies), ("secret scan", redact_secrets), ("packing", pack)]

#: A classifier, a similarity join and a tokenizer have no SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
