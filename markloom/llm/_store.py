"""Tables written to the shared folder, so that lost executors cost no lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
BATCH_BYTES, MOST = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


_made: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a fresh local one only where none is set and all runs in one machine, as in tests."""
    found = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(CHECKPOINT_DIR, None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="markloom-")
        spark.conf.set(CHECKPOINT_DIR, found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """df, written once as Parquet and read back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes a written path through Spark's own file system layer."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def made(spark: SparkSession) -> int:
    """How many paths the application has written and not cleared."""
    return len(_made.get(spark.sparkContext.applicationId, []))


def cleared(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Deletes the application's written paths from number ``since`` on, but for the last ``keep``; for when the results that read them are stored."""
    own = _made.get(spark.sparkContext.applicationId, [])
    for path in own[since : len(own) - keep]:
        dropped(spark, path)
    del own[since : len(own) - keep]


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by their bytes, as 10,000 long texts would fill 64 MB on both sides of each worker."""
    held = spark.conf.get(BATCH_BYTES)
    if not held.rstrip("b").isdigit() or int(held.rstrip("b")) > MOST:
        spark.conf.set(BATCH_BYTES, str(MOST))
