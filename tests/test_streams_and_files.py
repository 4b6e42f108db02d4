from datetime import datetime, timedelta

from markloom.sources import files
from markloom.streaming import queue

START = datetime(2024, 1, 1)


def stream(spark, path, frames):
    """A file stream that takes one frame a batch."""
    import os

    for i, f in enumerate(frames):
        target = f"{path}/{i}.parquet"
        os.makedirs(path, exist_ok=True)
        f.toPandas().to_parquet(target, coerce_timestamps="us", allow_truncated_timestamps=True)
        os.utime(target, (1e9 + i, 1e9 + i))
    return spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(path)


def result(spark, df, name, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return sorted(tuple(r) for r in spark.table(name).collect())


def test_unanswered_claims_come_out_once(spark, tmp_path):
    at = lambda h: START + timedelta(hours=h)
    claims = [spark.createDataFrame(rows, "id long, worker string, ts timestamp") for rows in ([(1, "a", at(0)), (2, "a", at(0)), (3, "b", at(1))], [(4, "b", at(20))], [(5, "c", at(40))])]
    done = [spark.createDataFrame(rows, "done_id long, done_ts timestamp") for rows in ([(1, at(2)), (2, at(4))], [(4, at(21))], [(9, at(40))])]
    got = result(spark, queue.unanswered_claims(stream(spark, f"{tmp_path}/c", claims), stream(spark, f"{tmp_path}/d", done)), "stale", tmp_path)
    assert [r[:2] for r in got] == [(2, "a"), (3, "b")]
    table = queue.unanswered_claims(claims[0].union(claims[1]).union(claims[2]), done[0].union(done[1]).union(done[2]))
    assert sorted(r.id for r in table.collect()) == [2, 3, 5]


def test_usage_windows_close_behind_the_watermark(spark, tmp_path):
    frames = [spark.createDataFrame(rows, "model string, ts timestamp, tokens long") for rows in ([("x", START, 1), ("x", START + timedelta(minutes=59), 2), ("y", START, 5)], [("x", START + timedelta(hours=5), 7)])]
    got = result(spark, queue.usage_windows(stream(spark, f"{tmp_path}/u", frames)), "usage", tmp_path)
    assert [r[1:] for r in got] == [("x", 2, 3), ("y", 1, 5)]


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "A_b.wiki").write_text("x\ny\n")
    (tmp_path / "in" / "C.txt").write_text("z")
    (tmp_path / "in" / "D.md").write_text("no")
    (tmp_path / "titles").write_text("Paris \n\n  # no\nParis\n")
    assert sorted(tuple(r) for r in files.articles(spark, f"{tmp_path}/in").collect()) == [("A b", "x\ny\n"), ("C", "z")]
    titles = files.title_list(spark, f"{tmp_path}/titles")
    assert [r.title for r in titles.collect()] == ["Paris", "Paris"]
    files.save_articles(spark.createDataFrame([("C", "z", "sq"), ("A b", "q", "de")], "title string, text string, target_lang string"), f"{tmp_path}/out")
    left = files.unsaved(files.articles(spark, f"{tmp_path}/in").select("title"), f"{tmp_path}/out", "sq")
    assert [r.title for r in left.collect()] == ["A b"]
