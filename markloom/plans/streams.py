"""Queries that run as streams over the driver's tables, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.shared import new_path
from ..streaming import claims

_KIND = "CASE WHEN event_type = 'error' THEN 'failure' WHEN event_type = 'signup' AND event_id % 4 = 0 THEN 'other' WHEN event_type = 'purchase' AND event_id % 12 = 0 THEN 'success' ELSE 'claim' END"
_HOURS, _MOST = 6, 12


def q_queue_answers(s, d):
    staged, answers, mark = (new_path(s, x) for x in ("requests", "answers", "mark"))
    rows = s.read.parquet(f"{d}/events.parquet").selectExpr("user_id AS article", f"{_KIND} AS kind", "concat('w', event_id % 3) AS worker", "CAST(ts AS TIMESTAMP) AS ts", "event_id AS seq")
    rows.write.parquet(staged)
    out = claims.settled(s.readStream.schema(rows.schema).parquet(staged), answers, mark, stale_hours=_HOURS, keep_hours=24 * 365, most=_MOST)
    return out.select("article", "seq", F.unix_millis("ts").alias("at"), "kind", "worker", "outcome", "status", "attempts")


QUERIES = {n[2:]: f for n, f in list(globals().items()) if n.startswith("q_")}

ORACLE_SQL = {
    "queue_answers": f"""WITH RECURSIVE e AS (SELECT user_id AS article, event_id AS seq, epoch_us(ts) // 1000 AS at_ms, {_KIND} AS kind, 'w' || event_id % 3 AS worker, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS n FROM events),
      s AS (SELECT DISTINCT article, 0::BIGINT AS n, 'PENDING' AS status, NULL::VARCHAR AS holder, 0::BIGINT AS since, 0 AS attempts, NULL::VARCHAR AS outcome, false AS ended, NULL::VARCHAR AS old, 0::BIGINT AS until, 0 AS had FROM e
        UNION ALL SELECT article, n, CASE outcome WHEN 'granted' THEN 'CLAIMED' WHEN 'accepted' THEN CASE kind WHEN 'success' THEN 'DONE' ELSE 'FAILED' END ELSE st END, CASE outcome WHEN 'granted' THEN worker WHEN 'accepted' THEN NULL ELSE h END,
          CASE outcome WHEN 'granted' THEN at_ms ELSE since END, attempts + CASE outcome WHEN 'granted' THEN 1 ELSE 0 END, outcome, ended, old, until, attempts
        FROM (SELECT *, CASE kind WHEN 'claim' THEN CASE WHEN st = 'DONE' THEN 'done' WHEN st = 'CLAIMED' THEN CASE WHEN h = worker THEN 'repeated' ELSE 'taken' END WHEN attempts >= {_MOST} THEN 'exhausted' ELSE 'granted' END
            WHEN 'success' THEN CASE WHEN st = 'DONE' THEN 'repeated' ELSE 'accepted' END WHEN 'failure' THEN CASE WHEN st = 'CLAIMED' AND h = worker THEN 'accepted' ELSE 'late' END ELSE 'unknown' END AS outcome
          FROM (SELECT e.*, s.since, s.attempts, x.ended, s.holder AS old, s.since + {_HOURS} * 3600000 AS until, CASE WHEN x.ended THEN 'PENDING' ELSE s.status END AS st, CASE WHEN x.ended THEN NULL ELSE s.holder END AS h
            FROM s JOIN e ON e.article = s.article AND e.n = s.n + 1, LATERAL (SELECT s.status = 'CLAIMED' AND e.at_ms >= s.since + {_HOURS} * 3600000 AS ended) x))),
      l AS (SELECT * FROM s QUALIFY n = max(n) OVER (PARTITION BY article))
      SELECT s.article, e.seq, e.at_ms AS at, e.kind, e.worker, s.outcome, s.status, s.attempts FROM s JOIN e USING (article, n)
      UNION ALL SELECT article, NULL, until, 'expiry', old, 'stale', 'PENDING', had FROM s WHERE ended
      UNION ALL SELECT article, NULL, since + {_HOURS} * 3600000, 'expiry', holder, 'stale', 'PENDING', attempts FROM l WHERE status = 'CLAIMED' AND since + {_HOURS} * 3600000 <= (SELECT max(epoch_us(ts) // 1000) - 600000 FROM events)""",
}
