import os
import random
from datetime import datetime, timedelta

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from markloom.streaming import claims

START = datetime(2024, 1, 1)
SCHEMA = "article long, kind string, worker string, ts timestamp, seq long"
HOUR = 3600


def brute(batches, stale, most, late=600):
    """The answers batch by batch: requests behind the watermark of the batch before are dropped, claims end by it afterwards."""
    state, out, mark, top = {}, [], None, None

    def end(article, now):
        s = state[article]
        if s["status"] == "CLAIMED" and now >= s["since"] + stale:
            out.append((article, None, s["since"] + stale, "expiry", s["worker"], "stale", "PENDING", s["attempts"]))
            s.update(status="PENDING", worker=None)

    for batch in [*batches, []]:
        for article, kind, worker, ts, seq in sorted(batch, key=lambda r: (r[3], r[4])):
            if mark is not None and ts <= mark:
                continue
            s = state.setdefault(article, {"status": "PENDING", "worker": None, "since": 0, "attempts": 0})
            end(article, ts)
            if kind == "claim":
                if s["status"] == "DONE":
                    outcome = "done"
                elif s["status"] == "CLAIMED":
                    outcome = "repeated" if s["worker"] == worker else "taken"
                elif s["attempts"] >= most:
                    outcome = "exhausted"
                else:
                    outcome = "granted"
                    s.update(status="CLAIMED", worker=worker, since=ts, attempts=s["attempts"] + 1)
            elif kind == "success":
                outcome = "repeated" if s["status"] == "DONE" else "accepted"
                s.update(status="DONE", worker=None)
            elif kind == "failure" and s["status"] == "CLAIMED" and s["worker"] == worker:
                outcome = "accepted"
                s.update(status="FAILED", worker=None)
            else:
                outcome = "late" if kind == "failure" else "unknown"
            out.append((article, seq, ts, kind, worker, outcome, s["status"], s["attempts"]))
        if batch:
            top = max([r[3] for r in batch] + ([top] if top is not None else []))
        elif top is not None:
            for article in state:
                end(article, top - late)
        mark = None if top is None else top - late
    return out


def added(spark, folder, n, batch):
    os.makedirs(folder, exist_ok=True)
    rows = [(a, k, w, START + timedelta(seconds=t), s) for a, k, w, t, s in batch]
    path = f"{folder}/{n}.parquet"
    pq.write_table(spark.createDataFrame(rows, SCHEMA).toArrow(), path)
    os.utime(path, (1e9 + n, 1e9 + n))


def requests(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def got(df):
    seconds = ((F.unix_millis("ts") - int(START.timestamp() * 1000)) / 1000).cast("long")
    return sorted((tuple(r) for r in df.select("article", "seq", seconds, "kind", "worker", "outcome", "status", "attempts").collect()), key=repr)


def made(seed, n, start, first):
    rng = random.Random(seed)
    kinds = ["claim", "claim", "claim", "success", "failure", "failure", "other"]
    return [(rng.randrange(6), rng.choice(kinds), rng.choice("ab"), start + rng.randrange(0, 12 * HOUR), first + i) for i in range(n)]


def test_answers_match_brute_force_over_a_restart(spark, tmp_path):
    batches = [made(i, 40, i * 12 * HOUR, 100 * i) for i in range(4)]
    batches[2] += [(1, "claim", "a", HOUR, 900), (2, "success", "b", 2 * HOUR, 901)]  # behind the watermark
    batches[3] += [batches[3][0]] * 2  # repeated rows
    folder, out, mark = (f"{tmp_path}/{x}" for x in ("in", "out", "mark"))
    for n, b in enumerate(batches[:2]):
        added(spark, folder, n, b)
    claims.settled(requests(spark, folder), out, mark, stale_hours=3, most=3)
    for n, b in enumerate(batches[2:], 2):
        added(spark, folder, n, b)
    answers = claims.settled(requests(spark, folder), out, mark, stale_hours=3, most=3)
    expected = sorted(brute(batches, 3 * HOUR, 3), key=repr)
    assert got(answers) == expected
    assert {r[5] for r in expected} >= {"granted", "repeated", "taken", "exhausted", "stale", "late", "accepted", "done", "unknown"}
    assert claims.settled(requests(spark, folder), out, mark, stale_hours=3, most=3).count() == len(expected)


def test_idle_articles_are_forgotten(spark, tmp_path):
    folder, out, mark = (f"{tmp_path}/{x}" for x in ("in", "out", "mark"))
    day = 24 * HOUR
    added(spark, folder, 0, [(i, "success", "a", 10, i) for i in range(50)] + [(99, "claim", "a", 20, 60)])
    added(spark, folder, 1, [(100, "claim", "a", 3 * day, 70)])
    added(spark, folder, 2, [(0, "claim", "b", 3 * day + 60, 80), (99, "claim", "b", 3 * day + 60, 81)])
    answers = claims.settled(requests(spark, folder), out, mark, keep_hours=24, most=1)
    last = {r[0]: r for r in got(answers) if r[1] in (80, 81)}
    assert (last[0][5], last[0][7]) == ("granted", 1)
    assert (last[99][5], last[99][7]) == ("granted", 1)
    held = spark.read.format("statestore").option("path", mark).option("stateVarName", "claim").load()
    assert sorted(r.key.article for r in held.collect()) == [0, 99, 100]


@pytest.mark.parametrize("rows", [[], [(None, "claim", None, 5, 1), (None, None, None, 6, 2), (None, "failure", None, 7, 3)]])
def test_nulls_and_nothing(spark, tmp_path, rows):
    folder, out, mark = (f"{tmp_path}/{x}" for x in ("in", "out", "mark"))
    added(spark, folder, 0, rows)
    answers = claims.settled(requests(spark, folder), out, mark)
    assert [r[5] for r in got(answers)] == (["granted", "unknown", "accepted"] if rows else [])
