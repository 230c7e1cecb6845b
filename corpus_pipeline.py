"""A corpus from raw documents to packed training sequences, stage by stage.

Quality classifier, exact deduplication, SimHash near-deduplication, secret
redaction, packing. Each stage reads what its predecessor wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from policyspark.llm import exact_dedup, packing, quality, secrets, simhash
from policyspark.llm.common import discard, materialize, table
from policyspark.llm.queries import vocabulary


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of good quality that aren't toxic; the columns stay. Odd rows: see ``quality.keep_good``."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, that of the smallest doc_id; null and empty texts are equal. Odd rows: see ``exact_dedup.drop_exact_copies``."""
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that of the smallest doc_id. Odd rows: see ``simhash.drop_near_copies``."""
    return simhash.drop_near_copies(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, with secrets replaced; null texts stay null. Odd rows: see ``secrets.redact``."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences, each id of each row in one; null texts are the end id alone. Odd rows: see ``packing.pack_documents``."""
    pieces = packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality classifier", keep_good),
    ("exact dedup", drop_exact_copies),
    ("simhash near-dedup", drop_near_copies),
    ("secret scans", redact_secrets),
    ("packing", pack),
]

#: A trained model and a vantage-point tree are beyond SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed pieces of the documents of ``sf_dir``; a stage's table goes when the next one's is written."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), "stage")
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
