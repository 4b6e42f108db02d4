"""Inputs and outputs kept as files: title lists, articles, saved articles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

SUFFIXES = "*.{wiki,txt}"


def title_list(spark: SparkSession, path: str) -> DataFrame:
    """S02. (file, title) of line files; blank lines and those with a # in front are dropped, repeats stay."""
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.trim("value").alias("title"))
    return lines.where((F.col("title") != "") & ~F.startswith("title", F.lit("#")))


def articles(spark: SparkSession, path: str) -> DataFrame:
    """S02, S03. (title, text) of the .wiki and .txt files of a folder; the title is the file's name with blanks for underscores."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter=SUFFIXES)
    name = F.regexp_replace(F.col("_metadata.file_name"), r"\.(wiki|txt)$", "")
    return files.select(F.replace(name, F.lit("_"), F.lit(" ")).alias("title"), F.col("value").alias("text"))


def save_articles(done: DataFrame, path: str) -> None:
    """K04. Appends finished articles (title, text, target_lang), one folder for each language."""
    done.write.mode("append").partitionBy("target_lang").parquet(path)


def unsaved(wanted: DataFrame, path: str, target_lang: str) -> DataFrame:
    """S12, K04. wanted (title) that no saved article of the language has; only that language's folder is read."""
    saved = wanted.sparkSession.read.parquet(path).where(F.col("target_lang") == target_lang).select("title")
    return wanted.join(saved, "title", "left_anti")
