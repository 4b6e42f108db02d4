"""The corpus pipeline: language ID, near-dedup, decontamination, PII, packing.

Each stage works on all that its predecessor kept and calls one operator.  A
row travels as one struct beside its text, so columns of any name keep their
values.

Edge cases, the same in all stages: rows are told apart as rows, never by
doc_id, so null and repeated ids lose nothing; null and empty texts and texts
without a letter have no language and go in the first stage; of rows that are
equal or near copies that with the smallest doc_id stays (null ids last, ties
by a hash of the row); very long texts are judged whole; an empty table gives
an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from markloom.llm import crf_langid, near_copies, residual_packing, skipchain_pii, winnow_decontam
from markloom.llm._store import cleared, made, small_batches, written

#: A document is rejected if no language is found or its words are labelled with less certainty than this on average.
LEAST_CERTAINTY = 0.5

ORACLE_SQL = None  # learned labels, fingerprints and packing are not SQL's


def _rows(docs: DataFrame) -> DataFrame:
    """(doc, text): the whole row as a struct, and its text."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.col("text"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the random field can tell, in one language or several."""
    small_batches(spark)
    model = crf_langid.train(docs, F.lit(True))
    found = crf_langid.identify(_rows(docs), model, ["doc"])
    return found.where((F.col("lang_pred") != crf_langid.UNKNOWN) & (F.col("certainty") >= LEAST_CERTAINTY)).select("doc.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingle similarities of 0.8 or more: that with the smallest doc_id."""
    small_batches(spark)
    return near_copies.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    small_batches(spark)
    found = winnow_decontam.decontaminate(_rows(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), ["doc"])
    return found.where("not contaminated").select("doc.*")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked and n_chars brought up to date."""
    small_batches(spark)
    masked = skipchain_pii.mask(_rows(docs), skipchain_pii.train(docs))
    now = {"text": F.col("text"), "n_chars": F.length("text")}
    return masked.select(*(now.get(f.name, F.col(f"doc.`{f.name}`")).cast(f.dataType).alias(f.name) for f in docs.schema.fields))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, packed into sequences."""
    small_batches(spark)
    return residual_packing.sequences(docs.select("doc_id", "text"))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each but the last is written once, and the tables of the one before are deleted then."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    since = made(spark)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        cleared(spark, since, keep=1)
    return STAGES[-1][1](spark, docs, sf_dir)
