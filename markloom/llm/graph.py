"""Connected components by alternating large and small stars, in DataFrame joins.

Every round is written to the shared folder; a hub's edges meet its minimum in
a join that adaptive execution may split, never in one group's collection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ._store import dropped, written


def _star(edges: DataFrame, by: str) -> DataFrame:
    """(node, least) of each node's smallest neighbour, itself included."""
    return edges.groupBy(F.col(by).alias("k")).agg(F.min("v").alias("m")).select("k", F.least("k", "m").alias("m"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): root is the smallest node of the component; edges: columns u and v.

    Null ends and loops are ignored; nodes without edges do not appear.
    """
    spark = edges.sparkSession
    now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    last = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_star(both, "u"), both["u"] == F.col("k")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # v > u and m <= u: what comes out is (v, m) with v > m
        large = large.distinct()
        least = _star(large, "u")
        small = large.join(least, large["u"] == F.col("k")).select("u", "v", "m")
        pairs = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        new = written(pairs.where("u <> v").distinct(), "edges")
        stat = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        for path in {p.rsplit("/", 1)[0] for p in now.inputFiles()}:
            dropped(spark, path)
        now = new
        if stat == last:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        last = stat
    raise RuntimeError(f"components did not settle in {rounds} rounds")
