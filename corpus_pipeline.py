"""A corpus pipeline: documents go through five stages, each one of the operators.

Every stage works on all rows that the one before kept, is written as Parquet into
the shared folder and read again. All stages but the last return the columns of
documents; the last one returns token ids.

Defined results, of every stage: only the columns of documents are read and returned,
so further ones, whatever they are called, are left out; null ids, languages, sources
and sizes are kept as they are; texts are read whole, however long; rows that are
repeated are rows of their own but in near_duplicates; an empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import decontaminate, ngram_join, quality_classifier, secret_scan, spm_codec
from weftline.llm.common import shared_dir, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go.

    Null and empty texts are judged by their other columns; rows alike are judged alike;
    without labels of both kinds every document stays.
    """
    docs = docs.select(COLUMNS)
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.classify(docs, model).where("kept").select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one of least id stays.

    Equal sets of shingles are linked, so of repeated rows one stays; ties of the id go by
    the row's hash, null ids come last; null texts and those without words all stay.
    """
    return ngram_join.keep_one(docs.select(COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold half a benchmark item or more go. Null and empty texts, and items, match nothing; repeated rows go together."""
    return decontaminate.decontaminate(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets and the parts linked to them are replaced by a mark; no document goes. A null text stays null, a text without secrets as it is; n_chars follows the text."""
    clean = secret_scan.redact(docs.select(COLUMNS))
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with what was verified of them. A null or empty text has no ids."""
    return spm_codec.encode(docs.select(COLUMNS)).select("doc_id", "lang", "source", "n_chars", "n_tokens", "ids_sha256", "parity", "round_trip", "ids")


STAGES = [
    ("quality_classifier", quality),
    ("ngram_join", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scans", secrets),
    ("sentencepiece", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage over the documents of sf_dir."""
    docs, place = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{place}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{place}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL cannot express the classifier, nor what follows from it.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
