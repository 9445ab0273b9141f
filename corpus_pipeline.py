"""Training-data pipeline: stages over `documents`, each written and read again before the next.

Every stage takes (spark, docs, sf_dir); all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.llm import kneser_ney, packing, secret_scan, simhash_golay, template_decon
from kerbline.llm.queries import table, tokenizer_path
from kerbline.session import written


def without(docs: DataFrame, key: Column, gone: DataFrame) -> DataFrame:
    """docs but for the rows whose key, a hash of what the verdict rests on, is in gone; ids play no part. The keys are written first:
    where they are few, Spark broadcasts them by its own size check, and texts need no shuffle."""
    keys = written(gone.toDF("gone_key").distinct(), "gone")
    return docs.join(keys, key == keys.gone_key, "left_anti")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the perplexity bands reject go. A verdict rests on the language and the text of the row, so null
    and repeated ids change nothing, and repeated rows stay or go together. Null and empty texts go: they fail the base rules."""
    return without(docs, kneser_ney.text_key(docs.lang, docs.text), kneser_ney.judge(docs, keys=True).where("not kept").select("key"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts 0.8 similar by five-word shingles, or more, one row stays: that with the smallest id, null ids last, then the
    least hash of the text; of wholly repeated rows one. Texts without words are one group."""
    return simhash_golay.survivors(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go, judged by the text of the row alone. Null texts stay; without items all stay."""
    return without(docs, template_decon.text_key(docs.text), template_decon.matches(docs, table(spark, sf_dir, "benchmark")).select("doc"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; n_chars follows. No row goes, null ids and repeated rows included; null texts stay null, with n_chars null."""
    masked = secret_scan.redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, with their ids. Every row is packed by itself, repeated rows, null ids and null texts (one end token) too."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scans),
    ("packing", pack_sequences),
]

#: Perplexity, components and tokenization are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, "stage")
    return docs
