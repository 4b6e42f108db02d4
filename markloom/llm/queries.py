"""Queries opN_<name> over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import anchor_dedup, columnwise_suffix, crf_langid, lm_score, piece_encoding, ranked_search, residual_packing, simhash_pivot, skipchain_pii, spelling_variants, spotsigs, warc_source, winnow_decontam
from ._store import new_path, small_batches
from .oracles import ORACLE_SQL


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash_pivot.near_duplicates(docs).drop("fp")


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


def op3_anchor_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anchor_dedup.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept")


def op4_winnow_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = winnow_decontam.decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    return out.drop("item_ids")


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def op5_crf_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = crf_langid.identify(docs.select("doc_id", "text"), crf_langid.train(docs, ~held_out()), ["doc_id"])
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op6_skipchain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return skipchain_pii.detect(docs, skipchain_pii.train(docs), ["doc_id"])


def op7_warc_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc_source.write(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    back = warc_source.read(spark, path)
    whole = F.col("record_type") == "response"  # what the archive holds, not what its headers say
    size = F.when(whole, F.length("payload").cast("long")).otherwise(F.col("payload_bytes"))
    digest = F.when(whole, F.sha1("payload")).otherwise(F.col("payload_digest"))
    return back.select("page_id", size.alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to")


def op8_columnwise_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columnwise_suffix.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept")


def op9_residual_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return residual_packing.sequences(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.edited_likeness(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    coded = piece_encoding.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
    ids = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256")
    digests = coded.select(F.struct("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids).alias("doc"), "ids")
    out = piece_encoding.decode(digests, ["doc"])
    return out.select("doc.*", F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return ranked_search.search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


QUERIES = {f.__name__: f for f in (op1_simhash_pivot, op2_lm_score, op3_anchor_dedup, op4_winnow_decontam, op5_crf_langid, op6_skipchain_pii, op7_warc_source, op8_columnwise_suffix, op9_residual_packing, op10_spotsigs, op11_spelling_variants, op12_piece_encoding, op13_ranked_search)}
__all__ = ["ORACLE_SQL", "QUERIES"]
