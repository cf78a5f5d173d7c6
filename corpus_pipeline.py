"""A corpus from raw documents to tokens: five stages, each a written table that the next one reads.

Every stage takes (spark, docs, sf_dir) and works on all documents that its predecessor kept. All
but the last return the columns of ``documents``; the last one returns tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from epitide.llm import bpe, decontam, secret_scan, simhash, toxicity
from epitide.llm.common import table
from epitide.session import cut


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects (score 0.7 or more) go."""
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model, reject=0.7)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash links stays, the one with the smallest doc_id."""
    return simhash.drop_near_duplicates(docs, shingle=3, distance=2)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item go."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"), window=10)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are masked; every document stays."""
    return secret_scan.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left, and the text that they decode to."""
    import public_tokenizers  # only this stage needs it

    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxic),
    ("simhash", near_duplicates),
    ("decontamination", benchmark_free),
    ("secrets", without_secrets),
    ("bpe", tokens),
]

#: The toxicity stage is a trained network, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
