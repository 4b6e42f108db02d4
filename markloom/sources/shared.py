"""The folder that driver and executors share, for tables that a query writes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; a fresh local folder only where it is unset and all runs in one machine, as in tests."""
    found = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(CHECKPOINT_DIR, None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="markloom-")
        spark.conf.set(CHECKPOINT_DIR, found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def plain_unions(spark: SparkSession) -> None:
    """Unions claim no partitioning in this session, so that what is above one deals its rows itself.

    By Spark 4.1's default a union of parts dealt alike counts as dealt so; when
    adaptive execution then changes one part, the union has the tasks of all
    parts one after another, while joins above it still zip it as planned.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
