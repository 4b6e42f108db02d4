"""The queue's claims as keyed state with timers (Q01, Q02, Q04).

One processor keeps an article's status, worker, time of claim and attempts.
Requests (article, kind, worker, ts, seq) are claims, successes and failures;
every request is answered in one row, and a claim that nobody answers comes out
as stale when a later request of the article or the watermark shows it.

- A claim is granted to one worker until it is answered or stale, and while the
  article has attempts left.  The worker's own claim again changes nothing.
- A success ends the article, whoever brings it.
- A failure counts only from the worker that holds the claim; later ones are
  too late, as another may have it by then.

State is bounded: an article without requests for ``keep`` is forgotten by a
timer, its attempts too.  Requests of a batch are taken in order of time, then
seq; one that arrives in a later batch with an earlier time meets the state as
it is, and one behind the watermark is dropped by Spark.  A batch's requests of
one article are sorted in its task; the source's limit on a batch bounds them.

Edge cases: a null article is a key like any other; null kinds and kinds of
another name are answered with "unknown"; repeated rows are requests of their
own; a null worker holds claims like a named one; an empty stream gives none.
The session's state store becomes RocksDB, which timers need.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor

LATE = "10 minutes"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HOUR = 3_600_000
ANSWERS = "seq long, at long, kind string, worker string, outcome string, status string, attempts int"
FREE, CLAIMED, DONE, FAILED = "PENDING", "CLAIMED", "DONE", "FAILED"


class Claims(StatefulProcessor):
    """The processor of one article; times are milliseconds."""

    def __init__(self, stale: int, keep: int, most: int):
        self.stale, self.keep, self.most = stale, keep, most

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("claim", "status string, worker string, since long, attempts int, last long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        found = sorted(((r.at, r.seq, r.kind, r.worker) for r in rows), key=lambda r: (r[0], r[1] is not None, r[1] or 0))
        state = self._held()
        for ts, seq, kind, worker in found:
            if ts >= state[4] + self.keep:
                state = (FREE, None, 0, 0, ts)
            elif self._over(state, ts):
                yield self._expired(key, state)
                state = (FREE, None, 0, state[3], state[4])
            state, outcome = self._answered(state, ts, kind, worker)
            yield self._row(key, seq, ts, kind, worker, outcome, state)
        self._keep(state)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self.state.exists():
            return
        state, now = self._held(), expiredTimerInfo.getExpiryTimeInMs()
        if self._over(state, now):
            yield self._expired(key, state)
            self._keep((FREE, None, 0, state[3], state[4]))
        elif now >= state[4] + self.keep:
            self.state.clear()

    def close(self) -> None:
        pass

    def _held(self) -> tuple:
        return tuple(self.state.get()) if self.state.exists() else (FREE, None, 0, 0, 0)

    def _over(self, state: tuple, now: int) -> bool:
        return state[0] == CLAIMED and now >= state[2] + self.stale

    def _answered(self, state: tuple, ts: int, kind: str, worker: str) -> tuple[tuple, str]:
        status, holder, since, attempts, last = state
        last = max(last, ts)
        if kind == "claim":
            if status == DONE:
                outcome = "done"
            elif status == CLAIMED:
                outcome = "repeated" if holder == worker else "taken"
            elif attempts >= self.most:
                outcome = "exhausted"
            else:
                return (CLAIMED, worker, ts, attempts + 1, last), "granted"
        elif kind == "success":
            return (DONE, None, 0, attempts, last), "repeated" if status == DONE else "accepted"
        elif kind == "failure":
            if status == CLAIMED and holder == worker:
                return (FAILED, None, 0, attempts, last), "accepted"
            outcome = "late"
        else:
            outcome = "unknown"
        return (status, holder, since, attempts, last), outcome

    def _keep(self, state: tuple) -> None:
        """Writes the state and leaves two timers at most: the claim's end, and when the article is forgotten."""
        self.state.update(state)
        wanted = {state[4] + self.keep, *([state[2] + self.stale] if state[0] == CLAIMED else [])}
        held = set(self.handle.listTimers())
        for at in held - wanted:
            self.handle.deleteTimer(at)
        for at in wanted - held:
            self.handle.registerTimer(at)

    def _expired(self, key, state: tuple) -> Row:
        return self._row(key, None, state[2] + self.stale, "expiry", state[1], "stale", (FREE, None, 0, state[3], state[4]))

    def _row(self, key, seq, ts: int, kind, worker, outcome: str, state: tuple) -> Row:
        return Row(article=key[0], seq=seq, at=ts, kind=kind, worker=worker, outcome=outcome, status=state[0], attempts=state[3])


def answered(requests: DataFrame, stale_hours: float = 3, keep_hours: float = 24 * 30, most: int = 3, late: str = LATE) -> DataFrame:
    """Q01, Q02, Q04. The answers (article, ANSWERS) to a stream of requests; null times are left out."""
    requests.sparkSession.conf.set(PROVIDER, ROCKSDB)
    kind = requests.schema["article"].dataType.simpleString()
    own = requests.where("ts IS NOT NULL").select("article", "kind", "worker", "ts", F.unix_millis("ts").alias("at"), "seq").withWatermark("ts", late).groupBy("article")
    out = own.transformWithState(Claims(round(stale_hours * HOUR), round(keep_hours * HOUR), most), f"article {kind}, {ANSWERS}", "Append", "EventTime")
    return out.withColumn("at", F.timestamp_millis("at")).withColumnRenamed("at", "ts")


def settled(requests: DataFrame, answers: str, checkpoint: str, **how) -> DataFrame:
    """Runs the queue over what the stream of requests holds now, appends its answers to a folder and returns all of them.

    A restart with the same folders goes on behind the last finished batch; state is that of the checkpoint.
    """
    spark: SparkSession = requests.sparkSession
    out = answered(requests, **how)
    query = out.writeStream.format("parquet").option("path", answers).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(answers)
