"""The corpus pipeline: documents in, packed sequences out.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``. Between
stages the rows are written as Parquet to the shared folder, so a lost executor costs only tasks of its own stage.

All stages take null doc_ids and texts, repeated rows, extra columns and an empty table (which gives an empty one). A null text is an
empty one everywhere and stays null; no stage changes a column but ``text`` and ``n_chars``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm import decontaminate, packing, quality, secrets, simhash
from lodestack.llm.common import materialise, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject: scores of 0.3 or more.

    Null and empty texts are scored by their (zero) statistics. Rows are judged one by one, so repeated rows fare alike; a score of
    exactly the threshold stays. Without usable labels every row scores 0.5 and stays.
    """
    return quality.keep(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group whose fingerprints link at 3 or fewer differing bits.

    The row with the smallest doc_id stays (null counts last), then the smallest fingerprint and text; of wholly equal rows one.
    Rows with one doc_id and unlike texts are judged apart. Texts without words, nulls among them, are one group.
    """
    return simhash.deduplicate(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found.

    Null and empty texts hold none and stay; repeated rows go or stay together; without usable items all stay.
    """
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark; n_chars follows.

    Null texts stay null and keep their n_chars. Overlapping and touching spans become one mark.
    """
    return secrets.redact(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document: where it stands in which sequence.

    Null and empty texts are a piece of the end id alone. Repeated rows are packed each on its own.
    """
    return packing.pack(docs)


STAGES = [
    ("quality_filter", quality_filter),
    ("simhash_dedup", simhash_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_redaction", secret_redaction),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can't express the trained and iterative stages; a test holds the whole pipeline against decisions made one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, name)
    return docs
