"""The corpus pipeline: documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before kept.  The first four return the columns of documents:

1. quality rules: documents that fail the base rule or are outliers go;
2. near-duplicates: of each component the document with the smallest id stays;
3. secret scans: each secret in a text becomes ``[SECRET]``; documents stay;
4. source mixing: rows are laid out in the mixed order; documents stay;
5. packing: the pieces of all documents with their place in a sequence;
   documents are packed in runs of the mixed order, and sequences numbered by it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dropledger.llm.common import materialise, read_table, stored_order
from dropledger.llm.mixing import mixed_order
from dropledger.llm.packing import pack_documents
from dropledger.llm.quality import keep_good
from dropledger.llm.secrets import redact_secrets
from dropledger.llm.simhash import drop_near_duplicates


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and are no outliers of their language and source."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return drop_near_duplicates(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the secrets in their texts; ``n_chars`` follows the text."""
    redacted = redact_secrets(docs)
    return redacted.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")).select(docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, laid out in the mixed order of their sources."""
    return mixed_order(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences that follow the order in which the documents are stored."""
    return pack_documents(docs, order=stored_order(docs))


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_duplicates),
    ("secret_scans", secret_scans),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: SQL has no shingle fingerprints or token ids; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder for the next."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
