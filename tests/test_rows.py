import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from markloom.operators import expansion, languages
from markloom.sources.buckets import Store
from markloom.streaming import figures

SF = "/root/testdata/sf0.01"


def brute_ranks(text):
    t = re.sub(r"[ \t\r\n\f]+", " ", text).strip(" ").lower()
    n = Counter(t[i : i + 3] for i in range(len(t) - 2))
    return {g: i for i, g in enumerate(sorted(n, key=lambda g: (-n[g], g.encode()))[: languages.RANKS], 1)}


def test_guesses_match_brute_force(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choices(a, k=rng.randrange(40, 300))) for a in ("abc dé", "xyz ab", "mnñ o\n") for _ in range(25)]
    langs = ["a", "x", "m"]
    frame = spark.createDataFrame([(i, t, langs[i // 25]) for i, t in enumerate(texts)] + [(99, None, "a"), (98, "zz", None), (97, "ﬃ" * 60, None)], "id long, text string, lang string")
    learned = {g: brute_ranks("") for g in langs}
    for g in langs:
        n = Counter()
        for t, own in zip(texts, (langs[i // 25] for i in range(75)), strict=True):
            if own == g:
                u = re.sub(r"[ \t\r\n\f]+", " ", t).strip(" ").lower()
                n.update(u[i : i + 3] for i in range(len(u) - 2))
        learned[g] = {x: i for i, x in enumerate(sorted(n, key=lambda x: (-n[x], x.encode()))[: languages.RANKS], 1)}
    want = {99: None, 98: None, 97: None}
    for i, t in enumerate(texts):
        own = brute_ranks(t)
        far = {g: sum(abs(r - p[x]) - languages.RANKS for x, r in own.items() if x in p) for g, p in learned.items() if any(x in p for x in own)}
        want[i] = min(far, key=lambda g: (far[g], g)) if far and len(t.strip(" ")) >= languages.LEAST else None
    got = {r.id: r.lang for r in languages.guessed(frame.select("id", "text"), languages.profiles(frame)).collect()}
    assert got == want


def test_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("out", F.crc32(F.col("doc_id").cast("string")) % 4 == 2)
    known = languages.profiles(docs.where("NOT out"))
    found = languages.guessed(docs.where("out").selectExpr("doc_id AS id", "text"), known).join(docs.selectExpr("doc_id AS id", "lang AS truth"), "id").where("lang IS NOT NULL").collect()
    assert len(found) > 200 and sum(r.lang == r.truth for r in found) >= 0.98 * len(found)


def test_pages_say_their_language(spark):
    known = spark.createDataFrame([("en", "the", 1), ("de", "der", 1)], "lang string, gram string, rank int")
    long = "the the the the the the the the the the the the the the"
    pages = [(1, "sq, en", f"<html lang=de>{long}"), (2, None, f"<HTML class=x lang='DE-at'><p>{long}"), (3, "", f"<p>{long}</p>"), (4, None, "<p>the</p>"), (5, None, None), (6, None, " " * 6000 + "<html lang=fr>" + long)]
    got = {r.id: (r.lang, r.source) for r in languages.page_languages(spark.createDataFrame(pages, "id long, header string, html string"), known).collect()}
    assert got == {1: ("sq", "header"), 2: ("de", "page"), 3: ("en", "text"), 4: (None, None), 5: (None, None), 6: ("en", "text")}


def test_nested_and_cyclic_calls(spark):
    bodies = [("A", "<{{b|{{{1}}}}}>"), ("b", "({{{1|none}}},{{{k|0}}})"), ("c", "{{d}}"), ("D", "x{{C}}"), ("self", "{{self}}"), ("uses", "{{c}}!"), ("b", None), (None, "n")]
    texts = [(1, "{{a|1}} {{A}} {{ B |k=2|3}}"), (2, "{{b|{{b|{{b}}}}}}"), (3, "{{c}} {{self|x}} {{uses}}"), (4, "{{unknown|{{a|z}}}}"), (5, None), (6, ""), (7, "{{b_|q}} {{b|1=w}}")]
    got = {r.id: (r.text, r.n, r.left) for r in expansion.expanded(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(bodies, "name string, body string")).collect()}
    assert got == {
        1: ("<(1,0)> <{{b|{{{1}}}}}> (3,2)", 4, 0),
        2: ("(((none,0),0),0)", 3, 0),
        3: ("{{c}} {{self|x}} {{c}}!", 1, 3),
        4: ("{{unknown|<(z,0)>}}", 2, 0),
        5: (None, 0, 0),
        6: ("", 0, 0),
        7: ("(q,0) (w,0)", 2, 0),
    }
    assert sorted(r.name for r in expansion.circles(spark.createDataFrame(bodies, "name string, body string").where("name IS NOT NULL AND body IS NOT NULL")).collect()) == ["c", "d", "self"]
    assert expansion.expanded(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([], "name string, body string")).where("n > 0").count() == 0


def test_figures_come_from_the_run(spark, tmp_path):
    usage = spark.range(1000).selectExpr("id AS tokens", "0.5D AS cost")
    seen = figures.written_with_figures(usage, f"{tmp_path}/u", *figures.usage_metrics())
    assert seen == {"calls": 1000, "tokens": 499500, "cost": 500.0}
    assert figures.written_with_figures(usage.limit(0), f"{tmp_path}/v", *figures.usage_metrics()) == {"calls": 0, "tokens": 0, "cost": 0.0}
    stream = spark.readStream.schema(usage.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/u")
    files = len([p for p in (tmp_path / "u").iterdir() if p.suffix == ".parquet"])
    listener = figures.Progress("usage", 1000)
    spark.streams.addListener(listener)
    try:
        query = stream.observe("usage", *figures.usage_metrics()).writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        query.awaitTermination(120)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(20_000)
    finally:
        spark.streams.removeListener(listener)
    assert listener.figures == {"calls": 1000, "tokens": 499500, "cost": 500.0}
    assert files > 1 and len(listener.milestones) == files and listener.milestones[-1] == (1000, 1000)


def test_milestones_and_time_left():
    p = figures.Progress("x", 25)
    assert p.eta_seconds(10) is None
    for _ in range(25):
        p.add({"calls": 1, "tokens": None})
    assert [m[0] for m in p.milestones] == [2, 4, 6, 8, 10, 12, 14, 16, 18, 20, 22, 24, 25]
    assert p.eta_seconds(10) == 0 and figures.milestone_every(3) == 1


@pytest.fixture()
def store(spark):
    s = Store(spark, "kept", 4)
    s.create(spark.createDataFrame([(1, "a", 1), (1, "b", 5), (2, "c", 2), (3, None, 3), (None, "n", 4)], "k long, v string, seq long"))
    yield s
    s.drop()


def test_store_stays_where_it_is(spark, store):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = store.get(spark.createDataFrame([(1,), (2,), (9,), (1,), (None,)], "k long"))
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "SelectedBucketsCount" in plan
        assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted([(1, "b"), (2, "c"), (9, None), (1, "b"), (None, None)], key=repr)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_upserts_and_hits(spark, store):
    store.count_hits(spark.createDataFrame([(1,), (1,), (7,), (None,)], "k long"))
    store.upsert(spark.createDataFrame([(1, "z", 9), (4, "d", 8), (4, "e", 8), (None, "x", 1)], "k long, v string, seq long"))
    assert sorted(tuple(r) for r in store.rows().collect() if r.k != 3) == [(1, "z", 1, 2), (2, "c", 2, 0), (4, "e", 8, 0)]
    assert store.rows().count() == 4 and len(store.tables) == 2
