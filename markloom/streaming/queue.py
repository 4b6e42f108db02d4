"""The work queue as streams; the same functions serve tables.

State is bounded by watermarks: a claim is kept until it is answered or stale,
a window until no late row can reach it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import PythonException
from pyspark.sql import DataFrame, functions as F

LATE = "10 minutes"


class Unanswered(Exception):
    """What a handler raises if its engine cannot answer a batch."""


def unanswered_claims(claims: DataFrame, done: DataFrame, hours: int = 3, late: str = LATE) -> DataFrame:
    """Q01, Q02. claims (id, worker, ts) with no done (done_id, done_ts) within the hours after them.

    On streams a claim comes out once the watermark shows that no answer can follow.
    """
    c, d = claims.withWatermark("ts", late), done.withWatermark("done_ts", late)
    near = F.expr(f"id = done_id AND done_ts >= ts AND done_ts <= ts + INTERVAL {hours} HOURS")
    return c.join(d, near, "left_outer").where("done_id IS NULL").select("id", "worker", "ts")


def usage_windows(usage: DataFrame, width: str = "1 hour", late: str = LATE) -> DataFrame:
    """A01 on a stream. usage (model, ts, tokens): calls and tokens of each model by window of event time."""
    w = usage.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "model")
    return w.agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens")).select("w.start", "model", "calls", "tokens")


def drained(items: DataFrame, handle: Callable[[DataFrame], DataFrame], answers: str, checkpoint: str) -> None:
    """Q01. Takes what the queue holds now, batch by batch, and appends handle's answers to a folder; returns when it is empty.

    items is a stream (article, ...); handle takes a batch, each article once, and returns (article, ok).  A batch whose
    handler raises Unanswered, or whose Python functions raise in a task, is answered with ok = false for all of its
    articles; other errors, such as lost executors or a full disk, end the run, and a restart takes the batch again.  The source's own limit (maxFilesPerTrigger) bounds a
    batch.  A restart goes on behind the last finished batch, and a batch has its own folder, so it is written once.
    """

    def run(batch: DataFrame, number: int) -> None:
        own = batch.dropDuplicates(["article"])
        path = f"{answers}/batch={number}"
        try:
            handle(own).select("article", "ok").write.mode("overwrite").parquet(path)
        except (Unanswered, PythonException):  # a failing engine answers for its batch, the queue goes on
            own.select("article", F.lit(False).alias("ok")).write.mode("overwrite").parquet(path)

    query = items.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
