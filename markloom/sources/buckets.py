"""A key-value store in buckets, so that gets and upserts leave the store where it is.

Rows (k, v, created, hits) lie in a table bucketed and sorted by k; a join with
other rows on k deals those by the same buckets, and the store's side needs no
exchange.  An upsert joins, and writes the next table; the store's name points
to the newest, and the one before is dropped at the upsert that follows.  Files
lie in the shared folder, and stay there until it is cleared.

Edge cases: null keys are never stored nor found; of several new rows of a key
the one of the largest seq counts, ties by the larger value; created stays that
of the first write; an empty store answers nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from .shared import new_path

BUCKETS = 16


class Store:
    """A bucketed store of one session's catalog."""

    def __init__(self, spark: SparkSession, name: str, buckets: int = BUCKETS):
        self.spark, self.name, self.buckets = spark, name, buckets
        self.tables: list[str] = []

    def _save(self, rows: DataFrame) -> None:
        table = f"{self.name}_{uuid.uuid4().hex[:12]}"
        path = new_path(self.spark, table)
        rows.repartition(self.buckets, "k").write.bucketBy(self.buckets, "k").sortBy("k").format("parquet").option("path", path).saveAsTable(table)
        self.tables.append(table)
        for old in self.tables[:-2]:
            self.spark.sql(f"DROP TABLE IF EXISTS {old}")
        self.tables = self.tables[-2:]

    def rows(self) -> DataFrame:
        """The store (k, v, created, hits)."""
        return self.spark.table(self.tables[-1])

    def create(self, rows: DataFrame) -> None:
        """The store of rows (k, v, seq), the largest seq of a key; created is the smallest."""
        self._save(_newest(rows).select("k", "v", F.col("first").alias("created"), F.lit(0).cast("long").alias("hits")))

    def get(self, wanted: DataFrame) -> DataFrame:
        """U02, U04. wanted (k) with v, null where it is missing; each row is answered."""
        own = wanted.select("k").repartition(self.buckets, "k")
        return own.join(self.rows().select("k", "v").hint("merge"), "k", "left")

    def upsert(self, rows: DataFrame) -> None:
        """U03, U08. Writes rows (k, v, seq) over the store's values; created and hits stay, new keys take their smallest seq."""
        new = _newest(rows).repartition(self.buckets, "k").alias("n")
        old = self.rows().hint("merge").alias("o")
        joined = old.join(new, F.col("o.k") == F.col("n.k"), "full")
        self._save(joined.select(F.coalesce("o.k", "n.k").alias("k"), F.when(F.col("n.k").isNotNull(), F.col("n.v")).otherwise(F.col("o.v")).alias("v"), F.coalesce("o.created", "n.first").alias("created"), F.coalesce("o.hits", F.lit(0)).alias("hits")))

    def count_hits(self, wanted: DataFrame) -> None:
        """U02. Adds the number of times each key is wanted."""
        asked = wanted.where("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("more")).repartition(self.buckets, "k")
        self._save(self.rows().hint("merge").join(asked, "k", "left").select("k", "v", "created", (F.col("hits") + F.coalesce("more", F.lit(0))).alias("hits")))

    def drop(self) -> None:
        for table in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self.tables = []


def _newest(rows: DataFrame) -> DataFrame:
    return rows.where("k IS NOT NULL").groupBy("k").agg(F.max(F.struct("seq", "v")).alias("x"), F.min("seq").alias("first")).select("k", "x.v", "first")
